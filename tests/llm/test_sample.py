from pyspark.sql import functions as F

from corvelo.llm.sample import counter_draw, extend_ledger, halving_rates, paper_key, update_ledger


def records(spark, rows):
    return spark.createDataFrame(rows, "key string, epoch int, seq int, draw string")


def test_members_stay_as_data_grow(spark):
    old = [(f"k{k}", k % 20, k, "x") for k in range(800)]
    late = [(f"k{k}", 0, 1000 + k, "x") for k in range(0, 800, 3)]  # repeats that claim an older epoch
    new = [(f"n{k}", 21, 2000 + k, "x") for k in range(300)]
    first = extend_ledger(records(spark, old), None, halving_rates())
    again = extend_ledger(records(spark, old + late + new).repartition(9), None, halving_rates())
    grown = extend_ledger(records(spark, late + new), first, halving_rates(0.9))
    lines = lambda d: {r.key: tuple(r) for r in d.collect()}
    a, b, c = lines(first), lines(again), lines(grown)
    assert all(b[k] == a[k] and c[k] == a[k] for k in a) and len(b) == len(c) == 1100
    chosen = sum(x[-1] for x in a.values())
    assert 60 < chosen < 180


def test_draws_are_even(spark):
    d = spark.range(20_000).select(counter_draw(F.col("id").cast("string"), "s").alias("u"), counter_draw(F.col("id").cast("string"), "s", 1).alias("v"))
    r = d.agg(F.avg("u"), F.min("u"), F.max("u"), F.corr("u", "v")).first()
    assert abs(r[0] - 0.5) < 0.01 and r[1] >= 0 and r[2] < 1 and abs(r[3]) < 0.03


def test_keys_and_edges(spark):
    d = spark.createDataFrame([("v", "1", "t"), (None, "1", "t"), ("v", " ", "t"), ("v", None, "t"), ("v", "", " ")], "venue_key string, paper_id string, title string")
    assert [r[0] for r in d.select(paper_key()).collect()] == ["id|v|1", "id||1", "title|t", "title|t", None]
    odd = records(spark, [(None, 1, 1, ""), ("a", None, 2, ""), ("a", None, 2, "")])
    line = extend_ledger(odd, None, halving_rates()).collect()
    assert len(line) == 1 and line[0].first_epoch == 0
    assert extend_ledger(records(spark, []), None, halving_rates()).count() == 0


def test_kept_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    old = records(spark, [(f"k{k}", k % 3, k, "") for k in range(60)])
    one = {r.key: tuple(r) for r in update_ledger(old, path, halving_rates(0.5)).collect()}
    more = old.unionByName(records(spark, [(f"n{k}", k % 5, 100 + k, "") for k in range(50)]))
    two = {r.key: tuple(r) for r in update_ledger(more, path, lambda e: F.lit(0.01)).collect()}
    assert all(two[k] == one[k] for k in one) and len(two) == 110
    assert {r[2] for k, r in two.items() if k[0] == "n" and r[1] < 3} == {0.5}  # frozen
    assert {r[2] for k, r in two.items() if r[1] >= 3} == {0.01}
    assert update_ledger(more, path, halving_rates()).count() == 110


def test_two_runs_at_once_write_no_key_twice(spark, tmp_path, monkeypatch):
    from corvelo.llm import sample

    path, rate = str(tmp_path / "ledger"), halving_rates(0.5)
    d = spark.createDataFrame([(f"k{n}", 0, n) for n in range(50)], "key string, epoch int, seq int")
    real, calls = sample.new_lines, []

    def late(records, *rest):  # another run gets in while the first is being drawn
        calls.append(1)
        if len(calls) == 1:
            update_ledger(d.where("seq < 30"), path, rate)
        return real(records, *rest)

    monkeypatch.setattr(sample, "new_lines", late)
    got = update_ledger(d, path, rate)
    assert got.count() == got.select("key").distinct().count() == 50 and len(calls) == 3
    assert not [p for p in (tmp_path / "ledger").iterdir() if p.name.startswith("_")]
