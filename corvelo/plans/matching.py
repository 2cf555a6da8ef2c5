"""Queries of record matching, alignment and explanation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvelo.functions import text as T
from corvelo.operators import explain as X
from corvelo.operators import matching as M
from corvelo.plans.base import blank
from corvelo.plans.registry import registry
from corvelo.session import table

REGISTERED, query = registry()

KEY = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


def _keyed(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, folder, "paper").where(blank("title").isNotNull()).select("seq", T.title_key(F.col("title")).alias("key"))
    w = table(spark, folder, "openalex_work").where(blank("title").isNotNull()).select("seq", "openalex_id", T.title_key(F.col("title")).alias("key"))
    papers = p.groupBy("key").agg(F.min("seq").alias("paper_seq"))
    works = w.groupBy("openalex_id").agg(F.min_by("key", "seq").alias("key"))
    return papers.where("key <> ''"), works.where("key <> ''")


@query()
def fuzzy_title_match(spark: SparkSession, folder: str) -> DataFrame:
    papers, works = _keyed(spark, folder)
    return M.exact_then_fuzzy(papers, works, "paper_seq", "openalex_id", "key")


@query(f"""WITH n AS (SELECT DISTINCT a.institution_name AS name FROM (SELECT unnest(affiliations) AS a FROM reconciled)), t AS (SELECT name, {KEY.format('name')} AS k FROM n WHERE name IS NOT NULL),
h AS (SELECT DISTINCT {KEY.format('h.institution_name')} AS alias FROM (SELECT unnest(history) AS h FROM author_profile))
SELECT name, alias FROM t JOIN h ON alias <> '' AND contains(' ' || k || ' ', ' ' || alias || ' ') QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(alias) DESC, alias DESC) = 1""")
def containment_match(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "reconciled").select(F.explode("affiliations.institution_name").alias("name")).where("name IS NOT NULL").distinct().withColumn("k", T.reduce_key(F.col("name")))
    aliases = table(spark, folder, "author_profile").select(F.explode("history.institution_name").alias("h")).select(T.reduce_key(F.col("h")).alias("alias")).where("alias <> ''").distinct()
    return M.containment_match(names, "name", "k", aliases.withColumn("entity", F.col("alias")), "alias", "entity").select("name", "alias")


@query(f"""WITH n AS (SELECT {KEY.format('a.institution_name')} AS k, a.institution_id AS id FROM (SELECT unnest(affiliations) AS a FROM reconciled) WHERE a.institution_id <> ''),
u AS (SELECT k, min(id) AS institution_id FROM n GROUP BY 1 HAVING count(DISTINCT id) = 1), m AS (SELECT DISTINCT {KEY.format('h.institution_name')} AS k FROM (SELECT unnest(history) AS h FROM author_profile))
SELECT m.k AS k, institution_id FROM m JOIN u ON u.k = m.k WHERE len(string_split(m.k, ' ')) >= 2""")
def unique_alias(spark: SparkSession, folder: str) -> DataFrame:
    a = table(spark, folder, "reconciled").select(F.explode("affiliations").alias("a")).where(F.col("a.institution_id") != "")
    aliases = a.select(T.reduce_key(F.col("a.institution_name")).alias("alias"), F.col("a.institution_id").alias("institution_id"))
    names = table(spark, folder, "author_profile").select(F.explode("history.institution_name").alias("h")).select(T.reduce_key(F.col("h")).alias("k")).where("k IS NOT NULL").distinct()
    return M.unique_alias(names, "k", aliases, "alias", "institution_id")


@query("""WITH q AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS query, d.vec_id AS neighbour, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS similarity
  FROM q JOIN embeddings d ON d.label = q.label AND d.vec_id <> q.vec_id)
SELECT query, neighbour, similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS INTEGER) AS rank_no FROM p QUALIFY rank_no <= 10""")
def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    return M.cosine_top(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", "label", 10)


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS query, d.vec_id AS neighbour, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS similarity
  FROM q JOIN embeddings d ON d.vec_id <> q.vec_id WHERE list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) IS NOT NULL)
SELECT query, neighbour, similarity, CAST(row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS INTEGER) AS rank_no FROM p QUALIFY rank_no <= 10""")
def cosine_topk_all(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return M.cosine_search(e.where("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)


@query()
def reconcile_ladder(spark: SparkSession, folder: str) -> DataFrame:
    # candidates by equal DOI and by similar title key, as a frozen catalogue offers them
    doi = lambda c: F.nullif(F.regexp_replace(F.regexp_extract(F.lower(c), r"(10\.\d+/\S+)", 1), r"[.,;\s]+$", ""), F.lit(""))
    p = table(spark, folder, "paper").select("seq", doi("doi").alias("d"), T.title_key(F.col("title")).alias("k"))
    w = table(spark, folder, "openalex_work").select("openalex_id", doi("doi").alias("d"), T.title_key(F.col("title")).alias("k")).distinct()
    none = F.array().cast("array<string>").alias("affiliations")
    by_doi = p.where("d IS NOT NULL").join(w.where("d IS NOT NULL"), "d").select("seq", F.lit("doi").alias("stage"), "openalex_id", F.lit(1.0).alias("similarity"), none)
    # titles somewhat below the ladder's threshold come along, so that it decides and the trail tells of them
    similar = M.similar_pairs(p, w, "k", 0.92)
    by_title = p.join(similar.withColumnRenamed("_l", "k"), "k").join(w.select("openalex_id", F.col("k").alias("_r")), "_r").select("seq", F.lit("title").alias("stage"), "openalex_id", "similarity", none)
    return M.reconcile(table(spark, folder, "paper").select("seq"), by_doi.unionByName(by_title), "seq").select("seq", "openalex_id", "match_method", F.size("diagnostics").alias("stages"))


@query()
def alignment_steps(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.operators.alignment import align_by
    from corvelo.plans.likeness import shared_marks

    p = table(spark, folder, "translation_benchmark_passages").groupBy("pair_id").agg(F.max_by("english", "seq").alias("e"), F.max_by("portuguese", "seq").alias("p"))
    lines = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return align_by(p.select("pair_id", lines("e").alias("left"), lines("p").alias("right")), shared_marks)


FEATURES = ["l_quantity", "l_discount", "l_tax"]
RULES_SQL = """v AS (SELECT feature, threshold, count(*) AS n, sum(y) AS pos FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_discount, l_tax]) AS threshold, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y FROM lineitem) GROUP BY 1, 2),
c AS (SELECT feature, threshold, sum(n) OVER w AS n_le, sum(pos) OVER w AS pos_le, sum(n) OVER (PARTITION BY feature) AS n_all, sum(pos) OVER (PARTITION BY feature) AS pos_all FROM v WINDOW w AS (PARTITION BY feature ORDER BY threshold)),
r AS (SELECT feature, '<=' AS op, threshold, n_le AS n, pos_le AS pos, n_all FROM c UNION ALL SELECT feature, '>', threshold, n_all - n_le, pos_all - pos_le, n_all FROM c)"""


@query(f"WITH {RULES_SQL} SELECT feature, op, threshold, CAST(n AS BIGINT) AS covered, n / n_all AS coverage, CASE WHEN n > 0 THEN pos / n ELSE 0.0 END AS precision FROM r")
def anchor_rules(spark: SparkSession, folder: str) -> DataFrame:
    return X.rule_quality(table(spark, folder, "lineitem").select(*FEATURES, (F.col("l_returnflag") == "R").alias("y")), FEATURES, "y")


@query("""SELECT avg(CASE WHEN l_quantity > 25 AND l_discount <= 0.05 THEN 1.0 ELSE 0.0 END) AS coverage, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) FILTER (l_quantity > 25 AND l_discount <= 0.05) AS precision FROM lineitem""")
def anchor_quality(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select(*FEATURES, (F.col("l_returnflag") == "R").alias("y"))
    return X.anchor_quality(rows, [("l_quantity", ">", 25.0), ("l_discount", "<=", 0.05)], "y")


@query("""WITH l AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]) AS value FROM lineitem),
m AS (SELECT feature, quantile_disc(value, 0.5) AS median FROM l GROUP BY 1) SELECT feature, median, quantile_disc(abs(value - median), 0.5) AS mad FROM l JOIN m USING (feature) GROUP BY 1, 2""")
def mad_features(spark: SparkSession, folder: str) -> DataFrame:
    return X.median_absolute_deviation(table(spark, folder, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("""WITH v AS (SELECT l_orderkey, arg_min([l_quantity, l_discount, l_tax], [CAST(l_linenumber AS DOUBLE), l_partkey, l_suppkey, l_quantity, l_discount, l_tax]) AS a, arg_max([l_quantity, l_discount, l_tax], [CAST(l_linenumber AS DOUBLE), l_partkey, l_suppkey, l_quantity, l_discount, l_tax]) AS b FROM lineitem GROUP BY 1)
SELECT l_orderkey, 1 - list_sum(list_transform([1, 2, 3], lambda i: CASE WHEN a[i] <> b[i] THEN 1 ELSE 0 END)) / 3 AS sparsity, list_sum(list_transform([1, 2, 3], lambda i: abs(a[i] - b[i]) / [12.0, 0.03, 0.02][i])) / 3 AS distance FROM v""")
def sparsity_metric(spark: SparkSession, folder: str) -> DataFrame:
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", *FEATURES)
    line = F.array(*FEATURES)
    v = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.min_by(line, at).alias("a"), F.max_by(line, at).alias("b"))
    return v.select("l_orderkey", X.sparsity(F.col("a"), F.col("b")).alias("sparsity"), X.scaled_distance(F.col("a"), F.col("b"), F.array(F.lit(12.0), F.lit(0.03), F.lit(0.02))).alias("distance"))
