import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corvelo.llm import queries as Q
from corvelo.llm.subjects import assign_subjects, learn_votes, seed_terms, sentences, terms
from corvelo.session import table


def test_sentences():
    text = "# Title\n\nOne two three four. Menu\nHome\n\n```\na b c d e.\n```\nFive six seven eight!"
    assert sentences(text) == [(1, "one two three four"), (2, "five six seven eight")]
    assert sentences(None) == sentences("") == sentences("Home | About | Share") == []


def test_votes():
    names = ["seed", "share", "count", "section", "title", "address"]
    p = pd.DataFrame([[1, 1, 1, 1, 0, 0, 50], [-1, -1, -1, -1, 0, 0, 60], [1, 1, 1, -1, 0, 0, 5], [-1, -1, 0, -1, 1, 0, 5]], columns=[*names, "n"])
    got = learn_votes(p)
    assert got[0] > 0.9 and got[1] < 0.1 and got[2] > 0.5 > got[3]


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = table(spark, folder, "subject_label")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    got = assign_subjects(table(spark, folder, "documents"), table(spark, folder, "subject_area"), labels.where(half == 0))
    gold = {tuple(r) for r in labels.where(half == 1).select("doc_id", "subject").distinct().collect()}
    docs = {d for d, _ in gold}
    found = {(r.doc_id, r.subject) for r in got.collect() if r.doc_id in docs}
    assert len(gold & found) / len(gold) > 0.9 and len(gold & found) / len(found) > 0.9


def test_edges(spark, folder):
    d = table(spark, folder, "documents").limit(0)
    labels, areas = table(spark, folder, "subject_label"), table(spark, folder, "subject_area")
    assert assign_subjects(d, areas, labels).count() == 0
    odd = table(spark, folder, "documents").select("doc_id", "text", "title", "source").unionByName(spark.createDataFrame([(-1, None, None, None), (-2, "", "", ""), (-3, "Home | About", "x", "y")], "doc_id bigint, text string, title string, source string"))
    got = assign_subjects(odd.unionByName(odd), areas, labels).collect()
    assert all(r.doc_id >= 0 for r in got) and len(got) == len({(r.doc_id, r.subject) for r in got}) > 0
    assert Q.p9_found(spark, folder).columns == ["doc_id", "subject"]


def test_blocks_change_nothing(spark, folder):
    d, areas, labels = (table(spark, folder, n) for n in ("documents", "subject_area", "subject_label"))
    whole, parts = ({tuple(r)[:2] for r in assign_subjects(d, areas, labels, block=b).collect()} for b in (500_000, 300))
    assert whole and whole == parts


def test_seed_terms(spark):
    rows = [(s, f"Texts on {a}, point of {b} and the like.", None) for s, a, b in [("x", "apple pie", "view"), ("y", "iron", "sale"), ("z", "sea", "order")]]
    got = seed_terms(spark.createDataFrame(rows, "subject string, description_en string, description_pt string"))
    assert got["apple pie"] == "x" and got["iron"] == "y" and got["sea"] == "z" and not any("texts" in t or "like" in t for t in got)


def test_terms_stay_within_sentences():
    words, at = np.array([11, 20, 31, 41], dtype=np.uint64), np.array([0, 0, 0, 1])  # an odd hash is a word of three letters
    found, where = terms(words, at)
    assert len(found) == len(set(found.tolist())) == 5 and where.tolist() == [0, 0, 1, 0, 0]
