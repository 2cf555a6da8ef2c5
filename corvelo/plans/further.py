"""Queries of matching over bridges, comparisons, unions, windows and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvelo.functions import text as T
from corvelo.operators import evaluate as E
from corvelo.operators import matching as M
from corvelo.operators import records as R
from corvelo.operators.indicators import distinct_codes
from corvelo.plans.base import blank
from corvelo.plans.registry import registry
from corvelo.session import table

REGISTERED, query = registry()


@query("SELECT seq, paper.paper_id AS paper_id FROM reconciled WHERE len(list_filter(coalesce(affiliations, []), lambda a: coalesce(a.country_code, '') <> '')) = 0")
def missing_country(spark: SparkSession, folder: str) -> DataFrame:
    return R.without_country(table(spark, folder, "reconciled").select("seq", "paper.paper_id", "affiliations")).select("seq", "paper_id")


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m') WHEN 1 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)
SELECT o_orderkey, day FROM o WHERE o_orderkey % 7 > 1 AND day BETWEEN '1994-03-01' AND '1996-02-29'""")
def date_range(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey") % 7
    day = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM")).when(k == 1, "unknown").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return R.between_dates(table(spark, folder, "orders").select("o_orderkey", day.alias("day")), "day", "1994-03-01", "1996-02-29", ["day"])


@query("""WITH i AS (SELECT trim(alignment_id) AS id FROM translation_eval_alignment_review WHERE review_status <> 'needs_review' UNION SELECT trim(segment_id) FROM translation_eval_segments)
SELECT id FROM i WHERE id <> ''""")
def reviewed_ids(spark: SparkSession, folder: str) -> DataFrame:
    review = table(spark, folder, "translation_eval_alignment_review").where("review_status <> 'needs_review'").select(F.col("alignment_id").alias("id"))
    return R.distinct_ids([review, table(spark, folder, "translation_eval_segments").select(F.col("segment_id").alias("id"))], "id")


@query("""WITH p AS (SELECT profile_id, unnest(history).institution_name AS institution_name FROM author_profile),
r AS (SELECT DISTINCT a.institution_name AS institution_name, a.institution_id AS institution_id FROM (SELECT unnest(affiliations) AS a FROM reconciled) WHERE a.institution_id <> ''),
k AS (SELECT DISTINCT coalesce(venue_key, '') AS venue, coalesce(paper_id, '') AS paper_id, unnest(authors) AS name FROM paper),
n AS (SELECT preferred_name AS name, profile_id FROM author_profile)
SELECT DISTINCT venue, paper_id, institution_id FROM k JOIN n USING (name) JOIN p USING (profile_id) JOIN r USING (institution_name)""")
def bridged_institutions(spark: SparkSession, folder: str) -> DataFrame:
    none = F.lit("")
    names = table(spark, folder, "author_profile").select(F.col("preferred_name").alias("name"), "profile_id").distinct()
    papers = table(spark, folder, "paper").select(F.coalesce("venue_key", none).alias("venue"), F.coalesce("paper_id", none).alias("paper_id"), F.explode("authors").alias("name")).distinct().join(names, "name").groupBy("venue", "paper_id").agg(F.collect_set("profile_id").alias("author_ids"))
    people = table(spark, folder, "author_profile").select("profile_id", F.col("history.institution_name").alias("names"))
    resolved = table(spark, folder, "reconciled").select(F.explode("affiliations").alias("a")).where("a.institution_id <> ''").select("a.institution_name", "a.institution_id").distinct()
    return M.bridge(papers, "author_ids", people, "profile_id", "names", resolved, ["venue", "paper_id", "institution_id"]).select("venue", "paper_id", "institution_id")


@query("""WITH k AS (SELECT coalesce(paper.venue_key, '') || '/' || coalesce(nullif(trim(paper.paper_id), ''), paper.title, '') AS id, seq,
  list_sort(list_distinct(list_filter(list_transform(coalesce(affiliations, []), lambda a: a.country_code), lambda c: c IS NOT NULL AND c <> ''))) AS c FROM reconciled),
g AS (SELECT id, arg_min(c, seq) AS b, arg_max(c, seq) AS a, list_sort(list_distinct(flatten(list(c)))) AS e FROM k GROUP BY 1)
SELECT id, array_to_string(list_filter(e, lambda x: NOT list_contains(a, x)), '|') AS missing, array_to_string(list_filter(a, lambda x: NOT list_contains(e, x)), '|') AS extra, b = e AS exact_before, a = e AS exact_after FROM g""")
def before_after(spark: SparkSession, folder: str) -> DataFrame:
    """The union of a record's countries is expected; its first and last version are before and after."""
    key = F.concat(F.coalesce("paper.venue_key", F.lit("")), F.lit("/"), F.coalesce(blank("paper.paper_id"), "paper.title", F.lit("")))
    r = table(spark, folder, "reconciled").select(key.alias("id"), "seq", distinct_codes(F.col("affiliations.country_code")).alias("c"))
    g = r.groupBy("id").agg(F.min_by("c", "seq").alias("b"), F.max_by("c", "seq").alias("a"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("c")))).alias("e"))
    side = lambda c: g.select("id", F.col(c).alias("codes"))
    found = R.before_after(side("e"), side("b"), side("a"), "id", "codes")
    return found.select("id", F.array_join("missing", "|").alias("missing"), F.array_join("extra", "|").alias("extra"), "exact_before", "exact_after")


@query("""WITH e AS (SELECT user_id, event_id, event_type = 'purchase' AS hit FROM events), s AS (SELECT *, coalesce(max(hit::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM e)
SELECT user_id, event_id, hit AS assigned FROM s WHERE done = 0""")
def first_assignment(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "event_id", F.when(F.col("event_type") == "purchase", "auto_assign").otherwise("defer").alias("decision"))
    _, log = M.search_until_assigned(e, ["user_id"], "event_id")
    return log.select("user_id", "event_id", (F.col("decision") == "auto_assign").alias("assigned"))


@query("""SELECT 'papers' AS source_set, paper_id AS id, title, year FROM paper UNION ALL SELECT 'works', openalex_id, title, publication_year FROM openalex_work UNION ALL SELECT 'documents', CAST(doc_id AS VARCHAR), title, NULL FROM documents""")
def labelled_union(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "title", F.lit(None).cast("int").alias("year"))
    return R.labelled_union({"papers": (table(spark, folder, "paper"), {"id": "paper_id"}), "works": (table(spark, folder, "openalex_work"), {"id": "openalex_id", "year": "publication_year"}), "documents": (d, {"id": "doc_id"})}, ["id", "title", "year"])


@query("SELECT alignment_type, count(*) AS n, avg(labse_similarity) AS mean_labse_similarity FROM translation_eval_alignment_review WHERE labse_similarity IS NOT NULL GROUP BY 1")
def grouped_means(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "translation_eval_alignment_review").where("labse_similarity IS NOT NULL")
    return E.grouped_means(r, r.select("seq"), ["seq"], ["alignment_type"], "labse_similarity")


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\p{Z}]+', ' ', 'g')) AS x FROM documents),
h AS (SELECT *, length(regexp_extract(substr(x, 1, 1200), '(?is)^(.*?\babstract\b)', 1)) AS n FROM t)
SELECT doc_id, CASE WHEN n > 0 THEN regexp_replace(substr(x, n + 1), '(?is)\b(?:1\.?\s+introduction|introduction\s+1)\b.*$', '') ELSE x END AS part FROM h""")
def abstract_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.abstract_part(F.col("text")).alias("part"))


@query("""WITH n AS (SELECT DISTINCT paper.title AS title, list_filter(string_split(paper.title, ' '), lambda w: w <> '') AS w FROM reconciled WHERE paper.title IS NOT NULL)
SELECT title, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i]), list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS run FROM n""")
def title_windows(spark: SparkSession, folder: str) -> DataFrame:
    titles = table(spark, folder, "reconciled").select("paper.title").where("title IS NOT NULL").distinct()
    return titles.select("title", F.explode(T.windows(T.split_list(F.col("title"), " "), 3)).alias("run"))


@query("""WITH e AS (SELECT l_partkey AS k, CASE WHEN l_returnflag = 'A' THEN 'BR' WHEN l_returnflag = 'R' THEN 'US' END AS country, l_suppkey AS host, l_linenumber = 1 AS first_party, l_linenumber % 3 AS gap, l_linenumber = 7 AS profile FROM lineitem),
c AS (SELECT k, country, count(DISTINCT host) AS hosts, bool_or(first_party AND gap <= 1) AS own, bool_or(profile AND gap <= 1) AS recent, count(*) AS n FROM e WHERE country IS NOT NULL GROUP BY 1, 2),
a AS (SELECT k, count(*) AS countries, count(*) FILTER (hosts >= 2 AND own) AS strong, min(country) FILTER (hosts >= 2 AND own) AS best, min(country) AS sole, sum(n) AS n, bool_or(recent) AS recent FROM c GROUP BY 1),
d AS (SELECT k, CASE WHEN strong = 1 AND countries = 1 THEN 'auto_assign' WHEN countries = 1 AND n = 1 AND recent THEN 'auto_assign' ELSE 'defer' END AS decision,
  CASE WHEN strong >= 1 THEN CASE WHEN countries = 1 THEN best END WHEN countries = 1 AND n = 1 AND recent THEN sole END AS country, CASE WHEN strong = 1 AND countries = 1 THEN 'high' WHEN countries = 1 AND n = 1 AND recent THEN 'medium' ELSE 'low' END AS confidence FROM a)
SELECT * FROM d UNION ALL SELECT DISTINCT k, 'no_evidence', NULL, 'none' FROM e WHERE k NOT IN (SELECT k FROM a)""")
def evidence_decisions(spark: SparkSession, folder: str) -> DataFrame:
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    e = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("k"), F.when(flag == "A", "BR").when(flag == "R", "US").alias("country"), F.col("l_suppkey").alias("host"), (line == 1).alias("first_party"), (line % 3).alias("year_gap"), (line == 7).alias("profile"))
    return M.decide_affiliation(e, ["k"]).select("k", "decision", "country", "confidence")


@query("""SELECT direction, segment_id, trim(string_split(model_pair, '||')[1]) AS left_model, trim(string_split(model_pair, '||')[2]) AS right_model,
  CASE WHEN NOT stable THEN 'disagreement' WHEN preferred_model NOT IN ('tie', CASE WHEN x = y THEN 'tie' WHEN x < y THEN trim(string_split(model_pair, '||')[1]) ELSE trim(string_split(model_pair, '||')[2]) END) THEN 'disagreement' WHEN abs(x - y) <= 2 THEN 'borderline' ELSE 'clear' END AS stratum, abs(x - y) AS penalty_gap, seq
FROM (SELECT *, length(segment_id) + length(trim(string_split(model_pair, '||')[1])) % 5 AS x, length(segment_id) + length(trim(string_split(model_pair, '||')[2])) % 5 AS y FROM translation_eval_pairwise_decisions WHERE stable IS NOT NULL AND preferred_model IS NOT NULL)""")
def human_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Penalties that stand in for judgments of single candidates, by lengths of names, which SQL can follow."""
    from corvelo.operators.sampling import human_candidates

    d = table(spark, folder, "translation_eval_pairwise_decisions").where("stable IS NOT NULL AND preferred_model IS NOT NULL").select("seq", "direction", "segment_id", "model_pair", "preferred_model", "stable")
    each = d.select("direction", "segment_id", F.explode(F.transform(F.split("model_pair", r"\|\|"), lambda m: F.trim(m))).alias("model")).distinct()
    found = human_candidates(d, each.withColumn("penalty", F.length("segment_id") + F.length("model") % 5))
    return found.select("direction", "segment_id", "left_model", "right_model", "stratum", "penalty_gap", "seq")
