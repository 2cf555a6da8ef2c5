"""Queries of classification metrics and translation judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvelo.functions.text import transition_score
from corvelo.operators import evaluate as E
from corvelo.operators.alignment import freeze_alignments, reused_sentences
from corvelo.plans.registry import registry
from corvelo.session import table

REGISTERED, query = registry()

RULE = r"(?i)\b(statute|ruling|court|judge|liability|legislation|plaintiff|estatuto|juiz|tribunal|legisla)"
JUDGED_SQL = f"j AS (SELECT d.doc_id, doc_kind, d.doc_id IN (SELECT doc_id FROM subject_label WHERE subject = 'law') AS truth, regexp_matches(coalesce(text, ''), '{RULE}') AS predicted FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM subject_label))"
RATES_SQL = """CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall,
  CASE WHEN tn + fp = 0 THEN 0.0 ELSE tn / (tn + fp) END AS specificity, CASE WHEN tp + fp + fn + tn = 0 THEN 0.0 ELSE (tp + tn) / (tp + fp + fn + tn) END AS accuracy,
  CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1"""
COUNTS_SQL = "CAST(count(*) FILTER (truth AND predicted) AS BIGINT) AS tp, CAST(count(*) FILTER (NOT truth AND predicted) AS BIGINT) AS fp, CAST(count(*) FILTER (truth AND NOT predicted) AS BIGINT) AS fn, CAST(count(*) FILTER (NOT truth AND NOT predicted) AS BIGINT) AS tn"


def _judged(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "subject_label").groupBy("doc_id").agg(F.max(F.col("subject") == "law").alias("truth"))
    return table(spark, folder, "documents").join(labels, "doc_id").select("doc_id", "doc_kind", "truth", F.coalesce("text", F.lit("")).rlike(RULE).alias("predicted"))


@query(f"WITH {JUDGED_SQL}, c AS (SELECT {COUNTS_SQL} FROM j) SELECT *, {RATES_SQL} FROM c")
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return E.binary_metrics(_judged(spark, folder), "truth", "predicted")


SLICES_SQL = f"""{JUDGED_SQL}, s AS (SELECT 'overall' AS slice, * FROM j UNION ALL SELECT 'core', * FROM j WHERE doc_kind IN ('abstract', 'report') UNION ALL SELECT 'venue:' || doc_kind, * FROM j),
c AS (SELECT slice, {COUNTS_SQL} FROM s GROUP BY 1), m AS (SELECT *, {RATES_SQL} FROM c)"""


def _slices(spark: SparkSession, folder: str) -> DataFrame:
    return E.metric_slices(_judged(spark, folder), "truth", "predicted", "doc_kind", F.col("doc_kind").isin("abstract", "report"))


@query(f"WITH {SLICES_SQL} SELECT * FROM m")
def per_slice_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _slices(spark, folder)


@query(f"""WITH {JUDGED_SQL} SELECT 'all' AS scope, truth, predicted, count(*) AS n FROM j GROUP BY ALL UNION ALL SELECT doc_kind, truth, predicted, count(*) FROM j GROUP BY ALL""")
def label_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return E.label_pairs(_judged(spark, folder), "truth", "predicted", "doc_kind")


@query(f"WITH {JUDGED_SQL}, c AS (SELECT truth, predicted, count(*) AS n FROM j GROUP BY ALL) SELECT truth, predicted, n, n / sum(n) OVER (PARTITION BY truth) AS share FROM c")
def confusion_shares(spark: SparkSession, folder: str) -> DataFrame:
    return E.confusion_shares(_judged(spark, folder), "truth", "predicted")


DIMENSIONS = ["law", "health", "sport", "climate"]
WORDS = {"law": "(?i)(statute|court|judge|juiz)", "health": "(?i)(patient|vaccine|surgery|vacina)", "sport": "(?i)(goalkeeper|referee|championship|goleiro)", "climate": "(?i)(rainfall|wildfire|glacier|chuva)"}


@query(f"""WITH l AS (SELECT doc_id, list(DISTINCT subject) AS t FROM subject_label GROUP BY 1), d AS (SELECT t, coalesce(text, '') AS x FROM documents JOIN l USING (doc_id)),
j AS ({' UNION ALL '.join(f"SELECT '{n}' AS dimension, list_contains(t, '{n}') AS truth, regexp_matches(x, '{WORDS[n]}') AS predicted FROM d" for n in DIMENSIONS)}), c AS (SELECT dimension, {COUNTS_SQL} FROM j GROUP BY 1) SELECT *, {RATES_SQL} FROM c""")
def dimension_metrics(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.functions.text import screen

    labels = table(spark, folder, "subject_label").groupBy("doc_id").agg(F.collect_set("subject").alias("t"))
    d = table(spark, folder, "documents").join(labels, "doc_id").select("t", screen(F.coalesce("text", F.lit("")), WORDS).alias("p"))
    return E.dimension_metrics(d, DIMENSIONS, "t", "p")


@query(f"""WITH l AS (SELECT doc_id, list(DISTINCT subject) AS t FROM subject_label GROUP BY 1), d AS (SELECT t, coalesce(text, '') AS x FROM documents JOIN l USING (doc_id)),
dj AS ({' UNION ALL '.join(f"SELECT '{n}' AS dimension, list_contains(t, '{n}') AS truth, regexp_matches(x, '{WORDS[n]}') AS predicted FROM d" for n in DIMENSIONS)}), dc AS (SELECT dimension, {COUNTS_SQL} FROM dj GROUP BY 1), dm AS (SELECT *, {RATES_SQL} FROM dc), {SLICES_SQL},
g AS (SELECT bool_and(CASE WHEN slice = 'overall' THEN precision >= 0.9 AND recall >= 0.9 WHEN slice LIKE 'venue:%' THEN (tp + fp < 10 OR precision >= 0.8) AND (tp + fn < 10 OR recall >= 0.8) ELSE true END) AS passes FROM m)
SELECT passes, (SELECT coalesce(string_agg(dimension, '|' ORDER BY dimension), '') FROM dm WHERE precision >= 0.9 AND recall >= 0.9) AS validated_dimensions, (SELECT bool_and(precision >= 0.9 AND recall >= 0.9) FROM dm) AS dimensions_pass FROM g""")
def release_gate(spark: SparkSession, folder: str) -> DataFrame:
    return E.release_gate(_slices(spark, folder), dimension_metrics(spark, folder))


GRID_SQL = """s AS (SELECT doc_kind = 'abstract' AS truth, least(1.0, n_chars / 3000.0) AS score FROM documents WHERE n_chars IS NOT NULL),
g AS (SELECT unnest(range(0, 161)) AS step), a AS (SELECT truth, greatest(0, least(161, CAST(floor((score - 0.1) / 0.005 + 1e-9) AS INTEGER) + 1)) AS reach, count(*) AS n FROM s GROUP BY 1, 2),
c AS (SELECT step, CAST(coalesce(sum(n) FILTER (truth AND reach > step), 0) AS BIGINT) AS tp, CAST(coalesce(sum(n) FILTER (NOT truth AND reach > step), 0) AS BIGINT) AS fp,
  CAST(coalesce(sum(n) FILTER (truth AND reach <= step), 0) AS BIGINT) AS fn, CAST(coalesce(sum(n) FILTER (NOT truth AND reach <= step), 0) AS BIGINT) AS tn FROM g CROSS JOIN a GROUP BY 1),
m AS (SELECT CAST(step AS INTEGER) AS step, round(0.1 + step * 0.005, 6) AS threshold, tp, fp, fn, tn, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM c)"""


def _grid(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("n_chars IS NOT NULL").select((F.col("doc_kind") == "abstract").alias("truth"), F.least(F.lit(1.0), F.col("n_chars") / 3000.0).alias("score"))
    return E.threshold_grid(d, "truth", "score", 0.1, 0.9, 161)


@query(f"WITH {GRID_SQL} SELECT * FROM m")
def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    return _grid(spark, folder)


@query(f"WITH {GRID_SQL} SELECT threshold, precision, recall FROM m ORDER BY recall >= 0.9 DESC, precision DESC, recall DESC, threshold LIMIT 1")
def chosen_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return E.choose_threshold(_grid(spark, folder))


ERRORS_SQL = """e AS (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 5 ELSE 10 END AS w, CASE l_returnflag WHEN 'A' THEN 'minor' WHEN 'N' THEN 'major' ELSE 'critical' END AS severity FROM lineitem),
s AS (SELECT o_orderpriority AS model, o_orderkey, coalesce(sum(w), 0) AS penalty, count(*) FILTER (severity = 'critical') AS critical FROM orders LEFT JOIN e ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    error = F.struct(F.lit("").alias("span"), F.element_at(F.array(*map(F.lit, E.CATEGORIES)), (F.col("l_linenumber") % 8 + 1).cast("int")).alias("category"), F.when(flag == "A", "minor").when(flag == "N", "major").otherwise("critical").alias("severity"), F.lit("").alias("explanation"))
    errors = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list(error).alias("errors"))
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("model"))
    joined = o.join(errors, "l_orderkey", "left").withColumn("errors", F.coalesce("errors", F.array().cast(errors.schema["errors"].dataType)))
    return E.mqm_segments(joined)


@query(f"""WITH {ERRORS_SQL} SELECT model, count(*) AS segments, avg(penalty) AS mean_penalty, median(penalty) AS median_penalty, CAST(sum(penalty) AS BIGINT) AS total_penalty FROM s GROUP BY 1""")
def mqm_summary(spark: SparkSession, folder: str) -> DataFrame:
    return E.penalty_summary(_segments(spark, folder), ["model"], "mqm_penalty")


@query(f"""WITH {ERRORS_SQL}, n AS (SELECT l_orderkey, l_linenumber % 8 AS c, CASE l_returnflag WHEN 'A' THEN 'minor' WHEN 'N' THEN 'major' ELSE 'critical' END AS s FROM lineitem)
SELECT model, o_orderkey AS segment, CAST(max(penalty) AS INTEGER) AS mqm_penalty, {', '.join(f"CAST(count(*) FILTER (n.s = '{s}') AS INTEGER) AS {s}_errors" for s in E.SEVERITY)}, {', '.join(f"CAST(count(*) FILTER (n.c = {k}) AS INTEGER) AS {c}_errors" for k, c in enumerate(E.CATEGORIES))}
FROM s LEFT JOIN n ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def mqm_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder).select("model", F.col("l_orderkey").alias("segment"), "mqm_penalty", *(f"{x}_errors" for x in [*E.SEVERITY, *E.CATEGORIES]))


@query()
def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    return E.bootstrap_mean_ci(_segments(spark, folder), ["model"], "l_orderkey", "mqm_penalty")


@query("""WITH m AS (SELECT direction, list_transform(string_split(model_pair, '||'), lambda x: trim(x)) AS m, trim(preferred_model) AS p, stable FROM translation_eval_pairwise_decisions), e AS (SELECT direction, unnest(m) AS model, p, stable FROM m)
SELECT direction, model, avg(CASE WHEN stable THEN CASE WHEN p = 'tie' THEN 0.5 WHEN p = model THEN 1.0 ELSE 0.0 END END) AS preference_rate, CAST(count(*) FILTER (stable) AS BIGINT) AS stable, CAST(count(*) FILTER (NOT stable) AS BIGINT) AS unstable FROM e GROUP BY 1, 2""")
def preference_rate(spark: SparkSession, folder: str) -> DataFrame:
    return E.preference_rates(table(spark, folder, "translation_eval_pairwise_decisions"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2), p AS (SELECT a.l_orderkey, a.l_partkey AS a, b.l_partkey AS b, a.q AS qa, b.q AS qb FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)
SELECT l_orderkey, a || ' || ' || b AS model_pair, CASE WHEN qa = qb THEN 'tie' WHEN abs(qa - qb) < 3 THEN 'unstable' WHEN qa > qb THEN CAST(a AS VARCHAR) ELSE CAST(b AS VARCHAR) END AS preferred_model, qa = qb OR abs(qa - qb) >= 3 AS stable, CAST(2 AS BIGINT) AS orders_present FROM p""")
def pairwise_stability(spark: SparkSession, folder: str) -> DataFrame:
    # the parts of an order compete on quantity; a close call goes to whichever is shown first
    parts = table(spark, folder, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"))
    winner = lambda a, b: F.when(a["q"] == b["q"], "tie").when(F.abs(a["q"] - b["q"]) < 3, "A").when(a["q"] > b["q"], "A").otherwise("B")
    return E.decide_pairs(parts, ["l_orderkey"], "l_partkey", winner)


@query("""WITH r AS (SELECT l_linestatus AS a, CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END AS b FROM lineitem), t AS (SELECT count(*) AS n, count(*) FILTER (a = b) / count(*) AS agreement FROM r),
c AS (SELECT sum(x.n * y.n) / (max(t.n) * max(t.n)) AS chance FROM (SELECT a, count(*) AS n FROM r GROUP BY 1) x JOIN (SELECT b, count(*) AS n FROM r GROUP BY 1) y ON a = b CROSS JOIN t)
SELECT n, agreement, chance, (agreement - chance) / (1 - chance) AS kappa, agreement >= 0.7 AS passes FROM t CROSS JOIN c""")
def cohen_kappa(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "lineitem").select(F.col("l_linestatus").alias("a"), F.when(F.col("l_returnflag") == "N", "O").otherwise("F").alias("b"))
    return E.cohen_kappa(r, "a", "b")


@query("""WITH r AS (SELECT *, coalesce(nullif(regexp_replace(reviewed_english, '^ +| +$', '', 'g'), ''), regexp_replace(english, '^ +| +$', '', 'g')) AS en, coalesce(nullif(regexp_replace(reviewed_portuguese, '^ +| +$', '', 'g'), ''), regexp_replace(portuguese, '^ +| +$', '', 'g')) AS pt FROM translation_eval_alignment_review WHERE review_status = 'accept')
SELECT alignment_id AS segment_id, pair_id, english_sentence_ids, portuguese_sentence_ids, en AS english, pt AS portuguese, en <> regexp_replace(english, '^ +| +$', '', 'g') OR pt <> regexp_replace(portuguese, '^ +| +$', '', 'g') AS reference_was_edited, review_note FROM r WHERE length(en) > 0 AND length(pt) > 0""")
def freeze_segments(spark: SparkSession, folder: str) -> DataFrame:
    return freeze_alignments(table(spark, folder, "translation_eval_alignment_review"))


@query("""WITH i AS (SELECT unnest(list_filter(string_split(coalesce(english_sentence_ids, '') || '|' || coalesce(portuguese_sentence_ids, ''), '|'), lambda x: x <> '')) AS sentence_id FROM translation_eval_alignment_review)
SELECT sentence_id, count(*) AS n FROM i GROUP BY 1 HAVING count(*) > 1""")
def reused_sentence_ids(spark: SparkSession, folder: str) -> DataFrame:
    return reused_sentences(table(spark, folder, "translation_eval_alignment_review"))


@query("""WITH r AS (SELECT seq, labse_similarity AS s, CAST(string_split(alignment_type, ':')[1] AS INTEGER) AS a, CAST(string_split(alignment_type, ':')[2] AS INTEGER) AS b, length(english) AS x, length(portuguese) AS y FROM translation_eval_alignment_review WHERE labse_similarity IS NOT NULL)
SELECT seq, round(s - 0.08 * (a + b - 2) - 0.08 * abs(ln((x + 1) / (y + 1))), 6) AS score FROM r""")
def transition_scores(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "translation_eval_alignment_review").where("labse_similarity IS NOT NULL")
    kind = F.split("alignment_type", ":")
    score = transition_score(F.col("labse_similarity"), kind[0].cast("int"), kind[1].cast("int"), F.length("english"), F.length("portuguese"))
    return r.select("seq", F.round(score, 6).alias("score"))


@query("SELECT direction, count(*) AS jobs, count(DISTINCT segment_id) AS segments FROM translation_eval_pairwise_decisions GROUP BY 1")
def job_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "translation_eval_pairwise_decisions").groupBy("direction").agg(F.count(F.lit(1)).alias("jobs"), F.count_distinct("segment_id").alias("segments"))


@query()
def tfidf_logreg(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.operators import ml, sampling

    labels = table(spark, folder, "subject_label").groupBy("doc_id").agg(F.max((F.col("subject") == "law").cast("double")).alias("label"))
    d = table(spark, folder, "documents").select("doc_id", "doc_kind", ml.feature_text(F.col("title"), F.col("text"), F.array().cast("array<string>")).alias("body"))
    known = sampling.folds(d.join(labels, "doc_id"), ["label"], "doc_id", 3)
    scored = ml.cross_scored(known, "body", "label", "fold", ["doc_id", "label"])
    return E.binary_metrics(scored.select((F.col("label") == 1).alias("truth"), (F.col("probability") >= 0.5).alias("predicted")), "truth", "predicted")


@query()
def nested_selection(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.operators import ml

    labels = table(spark, folder, "subject_label").groupBy("doc_id").agg(F.max((F.col("subject") == "law").cast("double")).alias("label"))
    d = table(spark, folder, "documents").select("doc_id", ml.feature_text(F.col("title"), F.col("text"), F.array().cast("array<string>")).alias("body"))
    scored = ml.nested_selection(d.join(labels, "doc_id"), "body", "label", "doc_id", {"cost": [0.003, 0.03]}, outer=2, inner=2)
    return E.binary_metrics(scored.select((F.col("label") == 1).alias("truth"), "predicted"), "truth", "predicted")
