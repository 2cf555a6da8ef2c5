import itertools
import random

from pyspark.sql import functions as F

from corvelo.llm.packing import best_boundaries, container_patterns, pack_texts, token_counter, unused_space


def padding(lengths, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= v) - v) for v, n in zip(lengths, counts))


def test_boundaries_are_optimal():
    rng = random.Random(1)
    for _ in range(20):
        lengths = sorted(rng.sample(range(1, 30), 6))
        counts = [rng.randint(1, 9) for _ in lengths]
        got = best_boundaries(lengths, counts, 3, 32)
        options = [sorted({*c, 32}) for r in range(3) for c in itertools.combinations(lengths, r)]
        assert len(got) <= 3 and got[-1] == 32
        assert padding(lengths, counts, got) == min(padding(lengths, counts, o) for o in options)


def test_patterns_hold_everything():
    sizes, counts = [3, 5, 10], [100, 7, 4]
    used = [0, 0, 0]
    for times, pattern in container_patterns(sizes, counts, 10):
        assert sum(sizes[k] * m for k, m in pattern.items()) <= 10
        for k, m in pattern.items():
            used[k] += times * m
    assert used == counts


def test_containers(spark):
    rng = random.Random(2)
    sizes = [rng.randint(0, 250) for _ in range(400)] + [50] * 200
    d = spark.createDataFrame([(k, n, "x") for k, n in enumerate(sizes)], "doc_id bigint, n int, container_id string")
    packed = pack_texts(d, F.col("n"), capacity=100, buckets=16, rows_a_task=20)
    rows = packed.collect()
    held = {}
    for r in rows:
        held.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert all(sum(x[1] for x in held[k]) == n for k, n in enumerate(sizes))
    assert all(len(held[k]) == 1 for k, n in enumerate(sizes) if n <= 100)
    full = {}
    for r in rows:
        if r.container_id is not None:
            full[r.container_id] = full.get(r.container_id, 0) + r.n_tokens
    assert max(full.values()) <= 100 and {r.doc_id for r in rows if r.container_id is None} == {k for k, n in enumerate(sizes) if n == 0}
    assert unused_space(packed, 100).first().unused_share < 0.12
    again = pack_texts(d.repartition(7), F.col("n"), capacity=100, buckets=16, rows_a_task=20).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert pack_texts(d.limit(0), F.col("n"), 100).count() == 0


def test_token_counts(spark):
    d = spark.createDataFrame([("Hello world",), (None,), ("",), ("ação " * 20_000,)], "t string")
    got = [r[0] for r in d.select(token_counter(spark)(F.col("t"))).collect()]
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] >= 20_000
