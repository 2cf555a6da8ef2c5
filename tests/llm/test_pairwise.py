import random

import numpy as np

from corvelo.llm.pairwise import rank_models, spring_strengths

SCHEMA = "g string, winner string, loser string, weight double, tied boolean"


def test_against_direct_solution(spark):
    rng = random.Random(3)
    names = [f"m{k}" for k in range(9)]
    rows = [("x", *rng.sample(names, 2), 1.0, rng.random() < 0.2) for _ in range(300)]
    rows += [("x", "m0", "m1", 1.0, False)] * 500  # a hot pair
    n, b = np.zeros((9, 9)), np.zeros(9)
    for _, w, l, _, tied in rows:
        i, j = int(w[1]), int(l[1])
        n[i, j] += 1
        n[j, i] += 1
        if not tied:
            b[i] += 1
            b[j] -= 1
    want = np.linalg.solve(np.diag(n.sum(axis=1) + 0.01) - n, b)
    got = {r.item: r.strength for r in spring_strengths(spark.createDataFrame(rows, SCHEMA), "g").collect()}
    assert max(abs(got[f"m{k}"] - want[k]) for k in range(9)) < 1e-6


def test_edge_cases(spark):
    assert spring_strengths(spark.createDataFrame([], SCHEMA), "g").count() == 0
    odd = spark.createDataFrame([("g", "a", None, 1.0, False), ("g", "a", "a", 1.0, False), ("g", "a", "b", None, None)], SCHEMA)
    got = {r.item: r.strength for r in spring_strengths(odd, "g").collect()}
    assert set(got) == {"a", "b"} and got["a"] > 0 > got["b"]
    ties = spark.createDataFrame([("g", "a", "b", 1.0, True)], SCHEMA)
    assert all(abs(r.strength) < 1e-9 for r in spring_strengths(ties, "g").collect())


def test_decisions(spark):
    rows = [
        (1, "d", "s1", "A || B", "A", True, 1), (2, "d", "s1", "b||a", "A", True, 2), (3, "d", "s2", "A  ||  C", " c ", True, 1), (4, "d", "s3", "A || B", "unstable", False, 1),
        (5, "d", "s4", None, "A", True, 1), (6, "d", "s5", "A || B", None, None, 1), (7, "d", "s6", "B || C", "tie", True, 1), (8, "d", "s7", "B || C", "Z", True, 1),
    ]
    d = spark.createDataFrame(rows, "seq int, direction string, segment_id string, model_pair string, preferred_model string, stable boolean, judged_at int")
    got = [(r.rank_no, r.model) for r in rank_models(d).orderBy("rank_no").collect()]
    assert [m for _, m in got] == ["C", "A", "B"] and [n for n, _ in got] == [1, 2, 3]
