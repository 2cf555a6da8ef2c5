import random

from corvelo.llm import queries as Q
from corvelo.llm.leaks import find_leaks

WORDS = [f"w{k}" for k in range(400)]


def make(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string")


def test_recall_against_planted_cases(spark):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice(WORDS) for _ in range(rng.randint(38, 95)))) for k in range(30)]
    docs, want = [], set()
    for k in range(300):
        words = [rng.choice(WORDS) for _ in range(rng.choice([5, 80, 900]))]
        if k % 3 == 0:
            item, text = rng.choice(items)
            own = text.split()
            share = rng.choice([0.3, 0.6, 1.0])
            part = own[: int(share * len(own))]
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," if n % 11 == 3 else w for n, w in enumerate(part)]
            if share > 0.5:
                want.add((k, item))
        docs.append((k, "\n".join(words), "x"))
    d, i = make(spark, docs, items)
    got = {(r.doc_id, r.item_id) for r in find_leaks(d, i).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in find_leaks(d, i, block=7).collect()} == want


def test_edges(spark):
    text = " ".join(WORDS[:50])
    d, i = make(spark, [(1, None, ""), (2, "", ""), (3, text, ""), (3, text, ""), (4, "y " * 200_000 + text, "")], [(1, text), (2, None), (3, "two words"), (4, text)])
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(d, i).collect()) == [(3, 1), (3, 4), (4, 1), (4, 4)]
    assert find_leaks(d.limit(0), i).count() == 0 and find_leaks(d, i.limit(0)).count() == 0


def test_query(spark, folder):
    assert Q.p8_found(spark, folder).columns == ["doc_id", "item_id"]
