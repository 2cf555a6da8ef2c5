"""Semantics of the core operators on literal frames."""

import pytest
from pyspark.sql import functions as F

from corvelo.functions import text as T
from corvelo.functions import web as W
from corvelo.functions.ranking import competition_rank, positional_rank, spread_row_number
from corvelo.operators import checks, evaluate, explain, indicators, matching, records, review, sampling
from corvelo.operators.alignment import monotonic_steps


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.fixture
def panel(spark):
    return spark.createDataFrame([("BR",), ("US",), ("CN",)], "country_code string")


def papers(spark, data):
    return spark.createDataFrame(data, "venue string, countries array<string>")


def test_ranks_with_ties(spark):
    d = spark.createDataFrame([("BR", 2), ("US", 4), ("CN", 2)], "c string, v int").withColumn("s", F.lit(1))
    assert rows(d.select("c", competition_rank("v", ["s"]))) == [("BR", 2), ("CN", 2), ("US", 1)]
    assert rows(d.select("c", positional_rank("v", "c", ["s"]))) == [("BR", 3), ("CN", 2), ("US", 1)]


def test_spread_row_number_equals_window(spark):
    d = spark.createDataFrame([(g, float(v % 7), k) for k, (g, v) in enumerate((g, v) for g in "ab" for v in range(50))] + [("c", None, 1), ("c", 2.0, 2)], "g string, v double, k int")
    from pyspark.sql import Window

    want = d.withColumn("rank_no", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc_nulls_last(), "k")))
    assert rows(spread_row_number(d, ["g"], "v", "k", buckets=5).select("g", "k", "rank_no")) == rows(want.select("g", "k", "rank_no"))
    assert spread_row_number(d.limit(0), ["g"], "v", "k").count() == 0


def test_full_and_fractional_counts(spark, panel):
    r = papers(spark, [("v", ["BR", "US"]), ("v", ["BR"]), ("v", [])])
    got = {(x.scope, x.country_code): (x.full_count, x.fractional_count) for x in indicators.country_counts(r, panel).collect()}
    assert got["all", "BR"] == (2, 1.5) and got["v", "CN"] == (0, 0.0)
    assert {x.scope: x.universe for x in indicators.coverage(r).collect()} == {"all": 3, "v": 3}


def test_sensitivity_bounds(spark, panel):
    r = papers(spark, [("v", ["BR", "US"]), ("v", ["US"]), ("v", [])])
    br = next(x for x in indicators.country_sensitivity(r, panel).collect() if x.country_code == "BR")
    assert (br.coverage, br.observed_full_share, br.observed_fractional_share, br.mar_full_count) == (0.66666667, 0.5, 0.25, 1.5)
    assert (br.lower_bound, br.upper_bound, br.low_coverage) == (0.33333333, 0.66666667, True)


def test_pooling_weights(spark, panel):
    r = papers(spark, [("large", ["US"])] * 9 + [("small", ["BR"])])
    got = {(x.estimator, x.country_code): x.estimate for x in indicators.pooled_estimates(r, panel).where("scenario = 'all_venues'").collect()}
    assert got["equal_venue", "BR"] == got["equal_venue", "US"] == 0.5
    assert (got["paper_weighted", "BR"], got["paper_weighted", "US"]) == (0.1, 0.9)


def test_gate_uses_official_totals(spark):
    r = papers(spark, [("v", ["US"])] * 9)
    gate = indicators.coverage_gate(r, spark.createDataFrame([("v", 10)], "venue string, official int")).first()
    assert (gate.lowest, gate.passes) == (0.9, True)


def test_censoring(spark, panel):
    got = {x.country_code: x for x in indicators.censored_top(spark.createDataFrame([("US", 10.0), ("CA", 2.0)], "country_code string, value double"), panel, 15).collect()}
    assert got["BR"].value is None and got["BR"].upper_bound_if_unreported == 2.0 and got["US"].rank_among_reported == 1


def test_sectors_and_dense_zeros(spark, panel):
    d = spark.createDataFrame([(1, "BR", "academia"), (1, "BR", "industry"), (1, "US", "industry")], "p int, country_code string, sector string")
    one = indicators.collapsed_sectors(d, ["p", "country_code"], "sector")
    assert rows(one.select("country_code", "sector")) == [("BR", "mixed"), ("US", "industry")]
    mix = {(x.country_code, x.sector): x for x in indicators.sector_mix(one, panel).collect()}
    assert mix["BR", "mixed"].sector_share == 1.0 and mix["CN", "other"].sector_share is None and len(mix) == 12
    dense = indicators.dense_totals(spark.createDataFrame([("BR", 2.5)], "country_code string, r double"), panel, "country_code", total="r")
    assert rows(dense) == [("BR", 1, 2.5), ("CN", 0, 0.0), ("US", 0, 0.0)]


def test_active_institutions(spark):
    h = spark.createDataFrame([([("A", 2010, 2018), ("B", 2020, None), ("B", 2021, 2023), ("C", None, None)],)], "h array<struct<institution_name:string,start_year:int,end_year:int>>")
    assert h.select(indicators.interval_active(F.col("h"), 2022)).first()[0] == ["B", "C"]


def test_record_algebra(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    upd = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (9, "z", 1)], "k int, v string, at int")
    assert sorted(rows(records.overlay(base, upd, ["k"], "at").where("k IS NOT NULL"))) == [(1, "a"), (2, "y")]
    with pytest.raises(ValueError):
        records.overlay(base, upd, ["k"], "at", strict=True)
    assert rows(records.complement(base, base.where("k = 1 OR k IS NULL"), ["k"])) == [(2, "b")]
    ctx = spark.createDataFrame([(1, 1, "", "ok"), (1, 2, "e", "bad"), (2, 1, "e", "x"), (2, 2, "f", "y")], "k int, at int, error string, v string")
    assert rows(records.context_precedence(ctx, ["k"], "at", "error").select("k", "v")) == [(1, "ok"), (2, "y")]
    assert rows(records.first_per_key(ctx, ["k"], [F.col("at")]).select("k", "v")) == [(1, "ok"), (2, "x")]
    assert rows(records.last_value_first_place(ctx, ["k"], "at").select("k", "v", "position")) == [(1, "bad", 1), (2, "y", 1)]
    conflict = records.conflict_checked(spark.createDataFrame([("k", "a", "s1"), ("k", "b", "s2")], "k string, l string, s string"), ["k"], ["l"], "s").first()
    assert conflict.conflict and conflict.source_set == "s1|s2"


def test_affiliation_merge(spark):
    kind = "array<struct<institution_id:string,institution_name:string,country_code:string,institution_type:string>>"
    d = spark.createDataFrame([([("", "Acme Lab", "US", None), ("I1", "ACME lab", "US", None), ("", "Other", None, None), ("", "other", None, "x")],)], f"a {kind}")
    got = d.select(records.merge_affiliations(F.col("a"))).first()[0]
    assert [(x.institution_id, x.institution_name) for x in got] == [("I1", "ACME lab"), ("", "Other")]

    def merged(*items):
        return [(x.institution_name, x.country_code) for x in spark.createDataFrame([([("", n, c, None) for n, c in items],)], f"a {kind}").select(records.merge_affiliations(F.col("a"))).first()[0]]

    assert merged(("Association for Computational Linguistics", "US"), ("Xi University", "CN")) == [("Xi University", "CN")]
    assert merged(("Acme Deep.", None), ("Equal contribution 1Acme Deep.", None), ("Acme Deep.", "US")) == [("Acme Deep.", "US")]
    assert merged(("Equally contributed: Acme Deep.", None), ("Acme Deep.", None)) == [("Acme Deep.", None)]
    assert merged(("Acme", "US"), ("Beta", None), ("ACME", "BR"), ("Ácme", "US"), ("", "US"), (None, None)) == [("Ácme", "US"), ("Beta", None), ("ACME", "BR")]
    assert spark.createDataFrame([(None,)], f"a {kind}").select(records.merge_affiliations(F.col("a"))).first()[0] is None


def test_checks(spark):
    d = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(ValueError):
        checks.require_unique(d, ["k"])
    with pytest.raises(ValueError):
        checks.require_same_keys(d, d.where("k > 1"), ["k"])
    with pytest.raises(ValueError):
        checks.require_rows(d.limit(0))
    assert d.select(checks.violations(big=F.col("k") > 5, known=F.col("k") == 1)).first()[0] == ["big"]


def test_samples(spark):
    d = spark.range(200).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3).alias("s"))
    a = rows(sampling.hash_top(d, ["s"], 4, sampling.stable_key("id")))
    assert a == rows(sampling.hash_top(d.repartition(7), ["s"], 4, sampling.stable_key("id"))) and len(a) == 12
    one, two = sampling.seeded_sample(d, ["id"], 10, 7), sampling.seeded_sample(d.repartition(5), ["id"], 10, 7)
    assert rows(one) == rows(two) and records.complement(d, one, ["id"]).count() == 190
    with pytest.raises(ValueError):
        sampling.seeded_sample(d, ["id"], 999, 7)
    decisions = [("en", f"g{k:02d}", "A || B", ["A", "B", "tie"][k % 3], k % 7 != 0) for k in range(40)] + [("en", f"g{k:02d}", "A || C", "A", True) for k in range(12)]
    d = spark.createDataFrame(decisions, "direction string, segment_id string, model_pair string, preferred_model string, stable boolean")
    penalties = [("en", f"g{k:02d}", m, (k * (3 if m == "A" else 5)) % 9) for k in range(40) for m in "AB"]
    cases = sampling.human_candidates(d, spark.createDataFrame(penalties, "direction string, segment_id string, model string, penalty int"))
    known = {(g, m): x for _, g, m, x in penalties}
    for r in cases.collect():
        a, b = (known.get((r.segment_id, m)) for m in (r.left_model, r.right_model))
        better = None if a is None or b is None else "tie" if a == b else r.left_model if a < b else r.right_model
        apart = not r.stable or better is not None and r.preferred_model not in (better, "tie")
        assert r.stratum == ("disagreement" if apart else "borderline" if b is not None and abs(a - b) <= 2 else "clear")
    # the picks one by one
    left, wanted, used = [r.asDict() for r in cases.collect()], [], set()
    for pair in ("A || B", "A || C"):
        pool = [r for r in left if r["model_pair"] == pair]
        before = len(wanted)
        for s in ("clear", "borderline", "disagreement"):
            fit = sorted((r for r in pool if r["stratum"] == s and r["segment_id"] not in used), key=lambda r: (-r["penalty_gap"] if s == "clear" else r["penalty_gap"], r["segment_id"]))[:3]
            wanted += fit
            used |= {r["segment_id"] for r in fit}
        if len(wanted) - before < 9:
            fit = sorted((r for r in pool if r["segment_id"] not in used), key=lambda r: (r["penalty_gap"], r["segment_id"]))[: 9 - len(wanted) + before]
            wanted += fit
            used |= {r["segment_id"] for r in fit}
    picked = sampling.human_sample(cases).collect()
    assert [(r.model_pair, r.segment_id) for r in picked] == [(r["model_pair"], r["segment_id"]) for r in wanted[:18]] and picked[0].sample_id == "human-01"
    import hashlib

    assert all(r.swap == (int(hashlib.sha256(r.segment_id.encode()).hexdigest(), 16) % 2 == 0) for r in picked)


def test_metrics(spark):
    d = spark.createDataFrame([(True, True), (True, False), (False, False), (False, False)], "t boolean, p boolean")
    m = evaluate.binary_metrics(d, "t", "p").first()
    assert (m.tp, m.fn, m.tn, m.precision, m.recall, m.specificity) == (1, 1, 2, 1.0, 0.5, 1.0)
    assert evaluate.binary_metrics(d.limit(0), "t", "p").first().precision == 0.0
    scored = spark.createDataFrame([(True, 0.9), (False, 0.4), (True, 0.6)], "t boolean, s double")
    grid = {r.threshold: (r.tp, r.fp) for r in evaluate.threshold_grid(scored, "t", "s", 0.0, 1.0, 11).collect()}
    assert grid[0.4] == (2, 1) and grid[0.6] == (2, 0) and grid[0.7] == (1, 0) and grid[1.0] == (0, 0)
    assert evaluate.choose_threshold(evaluate.threshold_grid(scored, "t", "s", 0.0, 1.0, 11)).first().threshold == 0.5


def test_pairwise_stability(spark):
    j = spark.createDataFrame([("s", 1, "x", "y", "B"), ("s", 2, "y", "x", "A"), ("u", 1, "x", "y", "A"), ("u", 2, "y", "x", "A")], "seg string, order int, model_a string, model_b string, winner string")
    assert rows(evaluate.pairwise_decisions(j, ["seg"])) == [("s", "y", True, 2), ("u", "unstable", False, 2)]


def test_pairs_are_decided_without_shuffling_judgments(spark, folder):
    from corvelo.plans.judging import pairwise_stability

    c = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 5.0), ("g", 3, 6.0), ("g", 10, 20.0), ("h", 1, 1.0)], "g string, m int, q double")
    winner = lambda a, b: F.when(a["q"] == b["q"], "tie").when(F.abs(a["q"] - b["q"]) < 3, "A").when(a["q"] > b["q"], "A").otherwise("B")
    both = [("1 || 10", "10", True), ("1 || 2", "tie", True), ("1 || 3", "unstable", False), ("2 || 10", "10", True), ("2 || 3", "unstable", False), ("3 || 10", "10", True)]
    assert rows(evaluate.decide_pairs(c, ["g"], "m", winner)) == [("g", *x, 2) for x in both]
    plan = pairwise_stability(spark, folder)._jdf.queryExecution().sparkPlan().toString(), pairwise_stability(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan[0] and plan[0].count("Join") == 1 and "Exchange" not in plan[1].split("Join")[0]


def test_agreement_and_penalties(spark):
    d = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "a"), ("a", "b")], "l string, r string")
    k = evaluate.cohen_kappa(d, "l", "r").first()
    assert (k.agreement, k.passes) == (0.75, True) and k.kappa == pytest.approx(0.5)
    e = spark.createDataFrame([([("bad", "accuracy", "major", ""), ("", "omission", "minor", "")], "a bad text")], "errors array<struct<span:string,category:string,severity:string,explanation:string>>, text string")
    m = evaluate.mqm_segments(e).first()
    assert (m.mqm_penalty, m.major_errors, m.omission_errors) == (6, 1, 1)
    assert e.select(evaluate.valid_spans(F.col("errors"), F.col("text"))).first()[0]
    ci = {r.g: r for r in evaluate.bootstrap_mean_ci(spark.createDataFrame([("x", k, float(k % 5)) for k in range(50)] + [("y", 1, 3.0)], "g string, k int, v double"), ["g"], "k", "v").collect()}
    assert ci["y"].ci_low == ci["y"].ci_high == 3.0 and ci["x"].ci_low < 2.0 < ci["x"].ci_high


def test_text_functions(spark):
    d = spark.createDataFrame([("Café &amp; <b>Bar</b>  X", "Dr. Ana saw 3.5 km. Then she left! Yes", "A, B; C and D", "expected countries: Brazil, UK, US; pipeline: FR", "France and the United King-\ndom, USA")], "a string, s string, n string, note string, c string")
    r = d.select(T.title_key(F.col("a")), T.strip_tags(F.col("a")), T.split_sentences(F.col("s")), T.split_authors(F.col("n")), T.noted_countries(F.col("note")), T.country_codes(F.col("c"))).first()
    assert r[0] == "cafe b bar b x" and r[1] == "Café &amp; Bar X"
    assert r[2] == ["Dr. Ana saw 3.5 km.", "Then she left!", "Yes"] and r[3] == ["A", "B", "C", "D"]
    assert r[4] == ["BR", "GB", "US"] and r[5] == ["FR", "GB", "US"]
    m = spark.createDataFrame([("see `x+1` and $y$ now",)], "t string").select(T.protect(F.col("t")).alias("p")).select("p.masked", T.restore(F.col("p.masked"), F.col("p.kept"))).first()
    assert "`" not in m[0] and m[1] == "see `x+1` and $y$ now"
    n = spark.createDataFrame([("1,234.5",), ("x",)], "t string").select(T.number(F.col("t"))).collect()
    assert [x[0] for x in n] == [1234.5, None]
    i = spark.createDataFrame([("2025-03-01",), ("2025-03",), ("2025-13-01",)], "t string").select(T.iso_date(F.col("t"))).collect()
    assert [str(x[0]) for x in i] == ["2025-03-01", "None", "None"]


def test_ngrams_and_repetition(spark):
    from corvelo.operators.screening import repetition_screen_frame

    d = spark.createDataFrame([(1, "the cat sat on mats " * 5), (2, "one two"), (3, None)], "k int, t string")
    got = repetition_screen_frame(d, "k", "t").collect()
    assert len(got) == 1 and got[0].flagged and got[0].max_occurrences == 5 and got[0].repeated_ngram == "the cat sat on"


def test_web_functions(spark):
    d = spark.createDataFrame([("https://www.mit.edu/x",), ("https://orcid.org/0",), ("https://br.linkedin.com/in/ana-silva",), ("https://a.example",), (None,)], "u string")
    assert [r[0] for r in d.select(W.source_authority(F.col("u"))).collect()] == [0, 1, 3, 2, 2]
    assert d.select(W.retry_delay(F.lit(4), 1.0, 60.0, F.lit(20.0))).first()[0] == 20.0


def test_matching(spark):
    left = spark.createDataFrame([(1, "deep nets for cats"), (2, "a study of dogs"), (3, "zzz")], "l int, key string")
    right = spark.createDataFrame([("a", "deep nets for cats"), ("b", "a studyy of dogs")], "r string, key string")
    got = matching.exact_then_fuzzy(left, right, "l", "r", "key", [F.substring("key", 1, 3)])
    assert [(x[0], x[1], x[2]) for x in rows(got)] == [(1, "a", "exact"), (2, "b", "fuzzy")]
    texts = spark.createDataFrame([(1, "lab of acme research group"), (2, "none")], "i int, k string")
    names = spark.createDataFrame([("acme", "A"), ("acme research", "B")], "alias string, e string")
    assert rows(matching.containment_match(texts, "i", "k", names, "alias", "e")) == [(1, "B", "acme research")]


def test_fuzzy_pairs_are_complete(spark):
    from difflib import SequenceMatcher

    left = ["divergence bounds and tensor factorisation for robot grasping across languages", "online tensor factorisation for energy markets in 3 dimensions", "sparse memory replay for flood warning", "abc", "a"]
    right = ["divergence bounds tensor factorisation for robot grasping across languuages", "online tesor factorisation for energy marketsin 3 dimensions", "xsparse memroy replay for flood warningz", "abd", "a", "sparse memory replay for floods warning"]
    frame = lambda keys, id_: spark.createDataFrame([(k, x) for k, x in enumerate(keys)], f"{id_} int, key string")
    for least in (0.6, 0.92):
        brute = {(x, y) for x in left for y in right if SequenceMatcher(None, x, y, autojunk=False).ratio() >= least}
        got = matching.similar_pairs(frame(left, "l"), frame(right, "r"), "key", least, size=2)
        assert sorted((x._l, x._r) for x in got.collect()) == sorted(brute)
    got = {(x.l, x.r): x.method for x in matching.exact_then_fuzzy(frame(left, "l"), frame(right, "r"), "l", "r", "key").collect()}
    assert got == {(0, 0): "fuzzy", (1, 1): "fuzzy", (2, 5): "fuzzy", (4, 4): "exact"}


def test_near_letters_lose_no_pair():
    from collections import Counter

    import numpy as np

    random = np.random.default_rng(5)
    for n, m, letters, most in ((30, 33, "abcdefgh é", 9.0), (8, 8, "ab", 0.5), (1, 1, "xyz", 1.0), (400, 380, "aaaaab\U0001f600", 62.4)):
        left, right = ([''.join(random.choice(list(letters), k)) for _ in range(70)] for k in (n, m))
        right[3:6] = [(x * 2)[:m] for x in left[3:6]]
        apart = lambda x, y: sum(((c := Counter(chr(ord(z) % 64) for z in x)) - (d := Counter(chr(ord(z) % 64) for z in y))).values()) + sum((d - c).values())
        brute = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if apart(x, y) <= most]
        assert brute and list(zip(*map(np.ndarray.tolist, matching.near_letters(left, right, most)))) == brute


def test_cosine_search_looks_at_all_rows(spark):
    import numpy as np

    v = np.random.default_rng(3).normal(size=(90, 5))
    e = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)] + [(90, [0.0] * 5), (91, None)], "i long, v array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = {(x.query, x.rank_no): x.neighbour for x in matching.cosine_search(e.where("i % 9 = 0"), e, "i", "v", 3, size=20).collect()}
    assert got == {(q, n + 1): int(d) for q in range(0, 90, 9) for n, d in enumerate([d for d in np.argsort(-(u @ u[q])) if d != q][:3])}


def test_ladder_weighs_similar_titles(spark, tmp_path):
    from corvelo.plans.matching import reconcile_ladder

    titles = ["Sparse memory replay for flood warning in cities", "Token pruning for hospitals", "Graph anchors", "Robust parsing of long theorem proofs"]
    other = ["Sparse memory repaly for flood warning in cities", "Token pruning for hospitals xy", "Speech", "Robust parsing of long theorem proofs"]
    spark.createDataFrame([(k, None, t) for k, t in enumerate(titles)], "seq long, doi string, title string").write.parquet(f"{tmp_path}/paper.parquet")
    spark.createDataFrame([(f"W{k}", None, t) for k, t in enumerate(other)], "openalex_id string, doi string, title string").write.parquet(f"{tmp_path}/openalex_work.parquet")
    got = {x.seq: (x.openalex_id, x.match_method, x.stages) for x in reconcile_ladder(spark, str(tmp_path)).collect()}
    # the second is similar by 0.947, tried and rejected
    assert got == {0: ("W0", "title", 1), 1: (None, None, 1), 2: (None, None, 0), 3: ("W3", "title", 1)}


def test_best_pairs_first(spark):
    # 2 loses y to 1 and is then free for x, before 3
    pairs = spark.createDataFrame([(1, "y", 0.99), (2, "y", 0.98), (2, "x", 0.97), (3, "x", 0.95)], "l int, r string, similarity double")
    assert [(x.l, x.r) for x in matching.best_first(pairs, "l", "r").orderBy("l").collect()] == [(1, "y"), (2, "x")]


def test_alignment_moves():
    same = lambda a, b: 1.0 if sorted(a.split()) == sorted(b.split()) else -1.0
    steps = monotonic_steps(["a b", "c", "d"], ["a b c", "d"], same)
    assert [(s[1], s[3]) for s in steps] == [(2, 1), (1, 1)]


def test_explanation(spark):
    d = spark.createDataFrame([(1.0, True), (2.0, True), (3.0, False), (4.0, False)], "x double, y boolean")
    q = {(r.op, r.threshold): (r.coverage, r.precision) for r in explain.rule_quality(d, ["x"], "y").collect()}
    assert q["<=", 2.0] == (0.5, 1.0) and q[">", 2.0] == (0.5, 0.0)
    best = explain.beam_anchors(d, ["x"], "y", {"x": 1.0})
    assert best[0][1] == 1.0
    assert explain.median_absolute_deviation(d, ["x"]).first().mad == 1.0
    v = spark.createDataFrame([([1.0, 2.0], [1.0, 5.0])], "a array<double>, b array<double>")
    assert v.select(explain.sparsity(F.col("a"), F.col("b"))).first()[0] == 0.5
    c = explain.counterfactuals(spark.createDataFrame([(1, [2.0, 0.0])], "k int, f array<double>"), "k", "f", [1.0, 0.0], 0.0, [1.0, 1.0]).collect()
    assert len(c) == 3 and all(r.probability < 0.5 for r in c)


def test_system_signals(spark):
    kind = "w string, a array<struct<institution_id:string,institution_name:string,country_code:string,institution_type:string>>, m string"
    at = lambda n, c: ("", n, c, None)
    d = spark.createDataFrame([
        ("W", [], "title"), (None, None, None), ("W", [at("Uni", None)], "title"), ("W", [at("Google DeepMind.", None), at("IIT", "IN")], "title+v2-pdf-ner"),
        ("W", [at("Equal contribution 1Google DeepMind.", None), at("Google DeepMind.", "US")], "title+v2-pdf-ner"), (None, [at("Uni", "US")], "fallback"), ("W", [at("Uni", "US")], "title+fallback"), ("W", [at("Uni", "US"), at("Lab", None)], "title"),
    ], kind)
    got = d.select(*review.system_signal(F.col("w"), F.col("a"), F.col("m"))).collect()
    assert [r[0] for r in got] == ["unreconciled", "unreconciled", "country_missing", "ambiguous_multinational_branch", "mixed_sources", "fallback_only", "mixed_sources", "automatic_pass"]
    assert [r[1] for r in got] == ["high"] * 4 + ["medium"] * 3 + ["low"] and got[3][2] == "Branch location is unresolved for: Google DeepMind."


def test_countries_named_and_noted(spark):
    texts = {
        "A campus usage study": [], "KAIST, South Korea": ["KR"], "Indian Institute of Science, India": ["IN"], "The Hong Kong University of Science and Technology (Guangzhou), China": ["CN"],
        "Chinese University of Hong Kong, Shenzhen, China": ["CN"], "Univ of Hong Kong": ["HK"], "Tel Aviv, Israel; Amsterdam, Nether-\nlands": ["IL", "NL"], "xUSx, USy": ["US"], "aus BUSY": [], "us and uk": ["GB"], "well- \n known China": ["CN"],
    }
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(T.country_codes(F.col("t"))).collect()
    assert [r[0] for r in got] == list(texts.values())
    notes = {
        "- Expected countries: Austria and United Kingdom\n- Pipeline countries: Switzerland\nExpected country set: AT, GB, not CH.": ["AT", "GB"], "Google New York means a clear US institution": ["US"], "Expected CN and SG; pipeline CN SG and US.": ["CN", "SG"],
        "Expected country set: Brazil": ["BR"], "expected country is BR": ["BR"], "expected countries: PDF says BR and UK": ["BR", "GB"], "Expected AE HK ZA XX.": ["AE", "HK", "ZA"], "": [],
    }
    got = spark.createDataFrame(list(enumerate(notes)), "k int, t string").orderBy("k").select(T.noted_countries(F.col("t"))).collect()
    assert [r[0] for r in got] == list(notes.values())


def test_context_by_sentence_and_title(spark):
    from corvelo.functions.vocabulary import CONTEXT, CONTEXT_EXCLUDED, CONTEXT_TITLE, any_of

    patterns = {n: (any_of(CONTEXT[n]), any_of(CONTEXT_TITLE[n]), any_of(CONTEXT_EXCLUDED[n])) for n in CONTEXT}
    cases = {
        ("", "We offer actionable algorithmic recourse."): ["transparency_explainability"], ("", "A jailbreak evades the guardrails of model safety."): ["security_safety"], ("", "The optimizer shows a simplicity bias."): [], ("", "Instance discrimination is the objective."): [],
        ("", "Earlier prior work names fairness as one example. We measure fairness for protected groups and quantify demographic disparities."): ["fairness"],
        ("Interpretability of small nets", "We train nets."): ["transparency_explainability"], ("Privacy first", ""): ["privacy_data_governance"], ("", "Interpretability of small nets."): [], (None, None): [],
        ("", "Adversarial example training improves domain generalization in unseen environments."): [], ("", "Fundamentally different problems, such as measuring bias or fairness, exist."): [],
        ("Nets", "Ana Silva Abstract We study trains. 1 Introduction A jailbreak is bad."): [],
    }
    rows = [(k, *c) for k, c in enumerate(cases)]
    got = spark.createDataFrame(rows, "k int, title string, text string").orderBy("k").select(T.classify_units(T.evidence_units(F.col("title"), F.col("text")), patterns)).collect()
    assert [r[0] for r in got] == list(cases.values())


def test_support_by_distinctive_words(spark):
    text = "key laboratory ministry of education of china xiamen university p r china skywork ai"
    names = {"xiamen university": True, "skyworks solutions united states": False, "ministry of public security of the people s republic of china": False, "the xiamen university": True, "university of skywork ai research institute": True, "google deepmind": False, "": False}
    got = spark.createDataFrame(list(enumerate(names)), "k int, n string").orderBy("k").select(T.text_supports(F.col("n"), F.lit(text)), T.lexically_supported(F.col("n"), F.lit(text))).collect()
    assert [r[0] for r in got] == list(names.values()) and [r[1] for r in got] == [True, False, True, False, True, False, False]
    assert spark.range(1).select(T.mentions_all(F.array(F.lit("bank"), F.lit("of"), F.lit("rio")), F.array(F.lit("rio"), F.lit("bank"))), T.mentions_all(F.array(F.lit("of")), F.array(F.lit("of")))).first()[:] == (True, False)
    urls = {"https://www.x.edu/a": True, "https://ror.org/1": True, "https://acme-labs.com/": True, "https://acmelabs.com/": False, "https://research.com/": False, "https://linkedin.com/in/a": False}
    got = spark.createDataFrame(list(enumerate(urls)), "k int, u string").orderBy("k").select(W.first_party(F.col("u"), F.array(F.lit("acme"), F.lit("research"), F.lit("ai")))).collect()
    assert [r[0] for r in got] == list(urls.values())


def test_gate_with_dimensions(spark):
    slices = evaluate.metric_slices(spark.createDataFrame([(True, True, "v")] * 12, "t boolean, p boolean, v string"), "t", "p", "v", F.lit(True))
    labels = spark.createDataFrame([("safety | none", "safe|fairness"), (None, "fairness")], "t string, p string")
    rows_ = labels.select(evaluate.dimension_names(F.col("t"), {"safe": "safety"}).alias("t"), evaluate.dimension_names(F.col("p"), {"safe": "safety"}).alias("p"))
    assert rows_.first()[:] == (["safety"], ["safety", "fairness"])
    gate = evaluate.release_gate(slices, evaluate.dimension_metrics(rows_, ["safety", "fairness"], "t", "p")).first()
    assert (gate.passes, gate.validated_dimensions, gate.dimensions_pass) == (True, "safety", False)


def test_human_agreement(spark):
    review_ = spark.createDataFrame([(f"s{k}", "A" if k < 7 else " B ") for k in range(10)] + [("s10", ""), ("s11", "tie")], "sample_id string, choice string")
    key = spark.createDataFrame([(f"s{k}", "A" if k < 6 else "B") for k in range(11)] + [("s11", "unstable")], "sample_id string, judge_choice string")
    got = evaluate.human_agreement(review_, key).first()
    assert (got.completed_items, got.stable_judge_items, got.unstable_judge_items, got.raw_agreement, got.passes) == (11, 10, 1, 0.9, True)
    assert abs(got.cohen_kappa - (0.9 - 0.54) / 0.46) < 1e-9 and got.agreement_ci_low < 0.9 <= got.agreement_ci_high
    with pytest.raises(ValueError):
        evaluate.human_agreement(review_, key.where("judge_choice = 'unstable'"))


def test_review_rules(spark):
    d = spark.createDataFrame([("fail", "high", "", ""), ("pass", "low", "", "")], "review_status string, confidence string, failure_codes string, review_note string")
    assert [r[0] for r in d.select(review.edit_violations()).collect()] == [["fail_needs_code"], []]
