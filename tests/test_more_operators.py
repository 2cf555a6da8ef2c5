"""Affiliations in front matter, translation evaluation, small record helpers."""

import pytest
from pyspark.sql import functions as F

from corvelo.operators import affiliations as A
from corvelo.operators import records as R
from corvelo.operators import translation as X
from corvelo.sources import pages


def test_front_matter():
    text = "A Title\nAna B\n1University of X, Bra-\nzil 2Acme Research, Berlin, Germany\nAbstract\nIn France we met."
    assert A.candidates(text) == ["University of X, Brazil", "Acme Research, Berlin, Germany", "University of X, Brazil 2Acme Research, Berlin, Germany"]
    assert A.numbered_parts("no marks") == [] and A.region("") == ""
    assert A.candidates("Title\nAna B\nSkylab, Recife\nAbstract\nx") == []
    assert A.candidates("Title\nAna B\nSkylab, Recife\nAbstract\nx", known=["skylab"]) == ["Skylab, Recife"]
    assert A.candidates("Association for Computational Linguistics, University Press\nAbstract") == []
    assert A.candidates("Universitat de X\nUniversitét Y\nabstract") == ["Universitat de X", "Universitét Y"]


def test_region_before_correspondence():
    """Columns may put affiliations after the introduction; the note that follows them shows where they are."""
    text = "Title\nAbstract\nText of it.\n1. Introduction\nWords of the left column in Canada.\n*Equal contribution. 1Department of Physics,\nUniversity of Lisbon, Portugal\n2Graz University, Austria. Correspondence to: ana@example.org\nProceedings, Vancouver, Canada.\n"
    found = A.region(text)
    assert found.startswith("*Equal contribution") and "left column" not in found and "Vancouver" not in found
    plain = "Title\n1 University of Perth\n2 King's College\nAbstract\nJapanese learners.\n1 Introduction\n"
    assert "Perth" in A.region(plain) and "Japanese" not in A.region(plain)
    unnumbered = "\n".join(f"line {k}" for k in range(60)) + "\nCorrespondence to: x"
    assert A.region(unnumbered).splitlines() == [f"line {k}" for k in range(45, 60)]


def test_augment(spark):
    kind = "affiliations array<struct<institution_id:string,institution_name:string,country_code:string,institution_type:string>>, diagnostics array<struct<stage:string,outcome:string,detail:string>>, t string"
    d = spark.createDataFrame([([], [], "X University, Brazil\nAbstract\nFrance"), ([("I", "n", "US", None)], None, "USA and Brazil\nAbstract"), ([], [], "Nothing\nAbstract"), (None, None, None)], kind)
    got = [([a.country_code for a in r.affiliations or []], [x.outcome for x in r.diagnostics or []]) for r in A.augment_countries(d, "t").collect()]
    assert got == [(["BR"], ["success"]), (["US", "BR"], ["success"]), ([], ["unresolved"]), ([], ["not_available"])]


def test_targets(spark):
    queue = spark.createDataFrame([("v", "1", "Ana | Bo", "fail", 2), ("v", "2", "", "pass", 1)], "venue string, paper_id string, authors string, review_status string, queue_seq int")
    papers = spark.createDataFrame([("v", "1", "old", [], 1), ("v", "1", "new", [], 2)], "venue_key string, paper_id string, title string, authors array<string>, seq int")
    got = A.review_targets(queue, papers, "seq").collect()
    assert len(got) == 1 and got[0].title == "new" and got[0].authors == ["Ana", "Bo"]
    with pytest.raises(ValueError):
        A.review_targets(queue, papers.limit(0), "seq")


def test_overlap(spark):
    d = spark.createDataFrame([("a", "the cat sat", "the cat sat"), ("b", "the cat sat", "a dog ran"), ("b", "x", None)], "g string, reference string, prediction string")
    got = {r.g: r for r in X.overlap_scores(d, ["g"]).collect()}
    assert got["a"].chrf == pytest.approx(100) and got["a"].word_error_rate == 0
    assert got["b"].chrf < 20 and got["b"].word_error_rate == 100
    assert got["a"].bleu == pytest.approx(0) and got["a"].ter == 0 and got["b"].bleu == 0  # three words have no run of four
    assert X.shift_edits("a b c d e".split(), "d e a b c".split()) == 1 and X.word_edits("a b c d e".split(), "d e a b c".split()) == 4
    long = spark.createDataFrame([("g", "the cat sat on the mat today", "the cat sat on the mat today"), ("h", "the cat sat on the mat today .", "the cat sat on a mat today .")], "g string, reference string, prediction string")
    got = {r.g: r for r in X.overlap_scores(long, ["g"]).collect()}
    assert got["g"].bleu == pytest.approx(100) and got["h"].bleu == pytest.approx(100 * (7 / 8 * 5 / 7 * 3 / 6 * 1 / 5) ** 0.25) and got["h"].ter == pytest.approx(12.5)


def test_models_and_sources(spark):
    p = spark.createDataFrame([("Alpha",), ("Beta",)], "model string")
    assert X.filter_models(p, {"a": "Alpha", "b": "Beta"}, ["a", "a"]).count() == 1
    with pytest.raises(ValueError):
        X.filter_models(p, {"a": "Alpha"}, ["z"])
    with pytest.raises(ValueError):
        X.filter_models(p, {"a": "Gamma"}, ["a"])
    c = spark.createDataFrame([("posts/a.ipynb",), ("posts/b.ipynb",), ("posts/b-pt.ipynb",), ("x/c.ipynb",)], "path string")
    assert [r.path for r in X.translation_sources(c, "posts/", ".ipynb", "-pt.ipynb").collect()] == ["posts/a.ipynb"]
    cells = spark.createDataFrame([("en", 1, "# Hi **you**"), ("pt", 3, "Oi [v](u)")], "document string, cell int, text string")
    assert tuple(X.parallel_passages(cells, [(1, 3)], "en", "pt").first())[3:] == ("Hi you", "Oi v")


def test_record_helpers(spark):
    d = spark.createDataFrame([(1, "Brazil,Brazil,US", "Academia,Industry")], "k int, c string, s string")
    assert sorted(tuple(r) for r in R.zipped(d, ["k"], "c", "s").collect()) == [(1, "Brazil", "Academia"), (1, "Brazil", "Industry"), (1, "US", "")]
    assert [r.c for r in R.remap(spark.createDataFrame([("a",), ("b",), ("c",)], "c string"), "c", {"a": "x"}, ["b"]).collect()] == ["x", "c"]
    with pytest.raises(ValueError):
        R.merge_one_to_one(d.union(d), d, ["k"])
    assert R.training_hash(d.union(d), ["k", "c"]).first() == R.training_hash(d.union(d).repartition(3), ["k", "c"]).first()
    routes = d.select(R.fetch_route(F.lit("v"), F.lit(""), F.lit("u"), {"w": "api"}), R.fetch_route(F.lit("w"), F.lit(""), F.lit("u"), {"w": "api"})).first()
    assert tuple(routes) == ("page", "api")


def test_issue_page():
    page = '<div class="obj_article_summary"><h3 class="title"><a href="https://x/view/42">T</a></h3><div class="authors">Ana, Bo</div></div>'
    assert pages.issue_articles(page, "10.1/aies")[0]["doi"] == "10.1/aies.42"


def test_revisions(spark):
    now = spark.createDataFrame([("a", "x", 1), ("b", "y", 4)], "k string, v string, revision int")
    edits = spark.createDataFrame([("a", "x2", 1), ("a", "x3", 1), ("b", "late", 3), ("c", "new", 1)], "k string, v string, revision int")
    after, refused = R.next_revision(now, edits, ["k"])
    assert sorted(tuple(r) for r in after.collect()) == [("a", "x2", 2), ("b", "y", 4)]
    assert sorted(tuple(r) for r in refused.collect()) == [("a", "x3", 1), ("b", "late", 3), ("c", "new", 1)]


def test_filters_with_odd_values(spark):
    d = spark.createDataFrame([("2024-02-29", "a"), ("2024-02-30", "a"), ("2024-03", "a"), (None, "a"), ("2024-01-01", " "), ("2023-12-31", "a")], "day string, v string")
    assert [r.day for r in R.between_dates(d, "day", "2024-01-01", "2024-12-31", ["v"]).collect()] == ["2024-02-29"]
    ids = spark.createDataFrame([(" a ",), ("",), (None,), ("b",)], "id string")
    assert sorted(r.id for r in R.distinct_ids([ids, ids], "id").collect()) == ["a", "b"]
    kind = "k int, affiliations array<struct<country_code:string>>"
    assert [r.k for r in R.without_country(spark.createDataFrame([(1, [("BR",)]), (2, [("",), (None,)]), (3, []), (4, None)], kind)).orderBy("k").collect()] == [2, 3, 4]


def test_selection_stays_within_folds(spark):
    from corvelo.operators import ml

    rows = [(k, ("alpha beta red " if k % 2 else "gamma delta blue ") * (1 + k % 3) + f"w{k % 5}", float(k % 2)) for k in range(40)]
    d = spark.createDataFrame(rows, "k int, t string, label double")
    got = ml.nested_selection(d, "t", "label", "k", {"cost": [0.01]}, outer=2, inner=2).collect()
    assert len(got) == 40 and len({r.k for r in got}) == 40 and all(r.predicted == (r.label == 1) for r in got)
    runs = spark.createDataFrame([("Ab, c",)], "t string").selectExpr(f"{ml.word_letters('t', 3, 4)} AS r").first().r
    assert set(runs) == {" ab", "ab ", " ab ", " c "}


def test_folds_share_tokens_and_costs_share_vectors(spark, monkeypatch):
    from corvelo.operators import ml

    rows = [(k, ("alpha beta red " if k % 3 else "gamma delta blue ") * (1 + k % 3) + f"w{k % 5}", float(k % 2), k % 2) for k in range(24)]
    d = spark.createDataFrame(rows, "k int, t string, label double, fold int")
    made = {"token_stages": 0, "vector_stages": 0}
    for name in made:
        monkeypatch.setattr(ml, name, lambda *a, _n=name, _f=getattr(ml, name), **b: (made.update({_n: made[_n] + 1}), _f(*a, **b))[1])
    crossed = {r.k: r.probability for r in ml.cross_scored(d, "t", "label", "fold", ["k"]).collect()}
    assert made == {"token_stages": 1, "vector_stages": 2}
    apart = {r.k: r.probability for r in ml.score(ml.train(d.where("fold <> 1"), "t", "label"), d.where("fold = 1"), ["k"]).collect()}
    assert len(crossed) == 24 and all(crossed[k] == pytest.approx(p, abs=1e-6) for k, p in apart.items())
    made.update(token_stages=0, vector_stages=0)
    got = ml.nested_selection(d.drop("fold"), "t", "label", "k", {"cost": [0.01, 0.1]}, outer=2, inner=2).collect()
    assert len({r.k for r in got}) == len(got) == 24 and made == {"token_stages": 1, "vector_stages": 6}
