"""Queries of text functions and rule classifiers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvelo.functions import text as T
from corvelo.functions.ranking import numbered
from corvelo.functions.vocabulary import AMBIGUOUS_TITLE, CAMPUSES, CONTEXT, CONTEXT_EXCLUDED, CONTEXT_TITLE, COUNTRY_ALIASES, NO_EVIDENCE, TITLE_SCREEN, any_of
from corvelo.functions.web import host, source_authority
from corvelo.operators.screening import repetition_screen_frame, screen_gate
from corvelo.plans.registry import registry
from corvelo.session import table

REGISTERED, query = registry()


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _screen_sql(column: str, patterns: dict[str, list[str]]) -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({column}, {_quoted(any_of(p))}) THEN '{name}' END" for name, p in patterns.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


@query(f"""SELECT seq, array_to_string({_screen_sql('title', TITLE_SCREEN)}, '|') AS dimensions, regexp_matches(title, {_quoted(any_of(AMBIGUOUS_TITLE))}) AS ambiguous FROM paper WHERE title IS NOT NULL""")
def title_screen(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "paper").where("title IS NOT NULL")
    return p.select("seq", F.array_join(T.screen(F.col("title"), {k: any_of(v) for k, v in TITLE_SCREEN.items()}), "|").alias("dimensions"), F.col("title").rlike(any_of(AMBIGUOUS_TITLE)).alias("ambiguous"))


def _context_case(name: str) -> str:
    include, title, exclude = any_of(CONTEXT[name]), any_of(CONTEXT_TITLE[name]), any_of(CONTEXT_EXCLUDED[name])
    match = f"regexp_matches(u, {_quoted(include)})" + (f" OR (i = 1 AND regexp_matches(u, {_quoted(title)}))" if title else "")
    clause = f" AND NOT regexp_matches(units[1] || '. ' || u, {_quoted(exclude)})" if exclude else ""
    return f"CASE WHEN len(list_filter(units, lambda u, i: ({match}){clause})) > 0 THEN '{name}' END"


@query(rf"""WITH t AS (SELECT doc_id, trim(lower(coalesce(title, ''))) AS title, trim(regexp_replace(coalesce(text, ''), '[\s\p{{Z}}]+', ' ', 'g')) AS x FROM documents),
h AS (SELECT *, length(regexp_extract(substr(x, 1, 1200), '(?is)^(.*?\babstract\b)', 1)) AS n FROM t),
a AS (SELECT doc_id, title, lower(CASE WHEN n > 0 THEN regexp_replace(substr(x, n + 1), '(?is)\b(?:1\.?\s+introduction|introduction\s+1)\b.*$', '') ELSE x END) AS x FROM h),
u AS (SELECT doc_id, list_transform([title] || list_filter(list_transform(string_split(regexp_replace(x, '([.!?])\s+', '\1¶', 'g'), '¶'), lambda s: trim(s)), lambda s: s <> ''), lambda s: regexp_replace(s, {_quoted(NO_EVIDENCE)}, '', 'g')) AS units FROM a)
SELECT doc_id, array_to_string(list_filter([{', '.join(_context_case(n) for n in CONTEXT)}], lambda x: x IS NOT NULL), '|') AS dimensions FROM u""")
def context_classify(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", T.evidence_units(F.col("title"), F.col("text")).alias("units"))
    patterns = {n: (any_of(CONTEXT[n]), any_of(CONTEXT_TITLE[n]), any_of(CONTEXT_EXCLUDED[n])) for n in CONTEXT}
    return d.select("doc_id", F.array_join(T.classify_units(F.col("units"), patterns), "|").alias("dimensions"))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s])') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(range(1, len(w) - 2)) AS p, w FROM t WHERE len(w) >= 4),
c AS (SELECT doc_id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS gram, count(*) AS n, min(p) AS p FROM g GROUP BY 1, 2)
SELECT doc_id, n >= 4 AS flagged, n AS max_occurrences, gram AS repeated_ngram FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) = 1""")
def repetition_screen(spark: SparkSession, folder: str) -> DataFrame:
    return repetition_screen_frame(table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", "text"), "doc_id", "text")


@query(r"""WITH t AS (SELECT doc_id, doc_kind, regexp_extract_all(lower(text), '([\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s])') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(range(1, len(w) - 2)) AS p, w FROM t WHERE len(w) >= 4),
c AS (SELECT doc_id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] AS gram, count(*) AS n FROM g GROUP BY 1, 2),
m AS (SELECT doc_id, max(n) >= 4 AS flagged FROM c GROUP BY 1)
SELECT doc_kind, count(*) AS texts, avg(CASE WHEN coalesce(flagged, false) THEN 1.0 ELSE 0.0 END) AS flagged_share, avg(CASE WHEN coalesce(flagged, false) THEN 1.0 ELSE 0.0 END) <= 0.05 AS passes FROM t LEFT JOIN m USING (doc_id) GROUP BY 1""")
def model_screen_gate(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_kind", "text")
    return screen_gate(d, "text", ["doc_kind"], ["doc_kind"])


def _mention_sql() -> str:
    cases = []
    for code, names in COUNTRY_ALIASES.items():
        whole = "|".join(map(re.escape, names))
        test = f"regexp_matches(y, {_quoted(rf'(?i)(^|[^\p{{L}}\p{{M}}\p{{N}}_])({whole})([^\p{{L}}\p{{M}}\p{{N}}_]|$)')})"
        if code in ("US", "GB"):
            test += f" OR regexp_matches(y, '(^|[^A-Z]){'US' if code == 'US' else 'UK'}([^A-Z]|$)')"
        cases.append(f"CASE WHEN {test} THEN '{code}' END")
    return f"list_sort(list_filter([{', '.join(cases)}], lambda c: c IS NOT NULL))"


def _campus_sql(text: str) -> str:
    joined = rf"regexp_replace(regexp_replace({text}, '([\p{{L}}\p{{N}}_])-\s*\n\s*([\p{{L}}\p{{N}}_])', '\1\2', 'g'), '[\s\p{{Z}}]+', ' ', 'g')"
    for pattern, name in CAMPUSES:
        joined = f"regexp_replace({joined}, {_quoted(pattern)}, '{name}', 'g')"
    return joined


@query(f"""WITH n AS (SELECT DISTINCT a.institution_name AS x FROM (SELECT unnest(affiliations) AS a FROM reconciled)), k AS (SELECT x, {_campus_sql('x')} AS y FROM n WHERE x IS NOT NULL), c AS (SELECT x AS institution_name, {_mention_sql()} AS codes FROM k)
SELECT institution_name, array_to_string(codes, '|') AS codes, CASE WHEN len(codes) = 1 THEN codes[1] END AS single_country FROM c""")
def country_mentions(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "reconciled").select(F.explode("affiliations.institution_name").alias("institution_name")).where("institution_name IS NOT NULL").distinct()
    coded = names.withColumn("c", T.country_codes(F.col("institution_name")))
    return coded.select("institution_name", F.array_join("c", "|").alias("codes"), T.single_country(F.col("c")).alias("single_country"))


@query(r"""SELECT seq, trim(regexp_replace(regexp_replace(title, '<[^>]+>', ' ', 'g'), '[\s\p{Z}]+', ' ', 'g')) AS title FROM openalex_work WHERE title IS NOT NULL""")
def tagless_titles(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "openalex_work").where("title IS NOT NULL").select("seq", T.strip_tags(F.col("title")).alias("title"))


@query(r"""SELECT seq, lower(regexp_replace(regexp_replace(title, '\\[A-Za-z]+\{([^{}]*)\}', '\1', 'g'), '[^A-Za-z0-9]+', '', 'g')) AS key FROM openalex_work""")
def compact_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "openalex_work").select("seq", T.compact_key(F.col("title")).alias("key"))


#: Hosts of every rank, beside which the tables' own addresses stand.
HOSTS = ["physics.uni.edu", "www.cs.ox.ac.uk", "stats.gov", "data.gov.sg", "orcid.org", "ror.org", "www.linkedin.com", "researchgate.net", "edu.example", "notlinkedin.com.example"]
ADDRESS_SQL = """a AS (SELECT seq, official_url AS url FROM paper WHERE official_url <> '' UNION ALL SELECT p.seq, 'https://' || h || '/' || regexp_replace(official_url, '^[a-z]+://[^/]*/?', '') FROM paper p CROSS JOIN (SELECT unnest([""" + ", ".join(f"'{h}'" for h in HOSTS) + """]) AS h) WHERE official_url <> ''),
r AS (SELECT seq, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)', 1)) AS full_host FROM a),
k AS (SELECT seq, url, regexp_replace(full_host, '^www\\.', '') AS host, CAST(CASE WHEN regexp_matches(full_host, '(\\.edu|\\.ac\\.uk|\\.edu\\.sg|\\.gov|\\.gov\\.sg)$') THEN 0 WHEN full_host IN ('orcid.org', 'ror.org') THEN 1
  WHEN regexp_matches(full_host, '(linkedin\\.com|researchgate\\.net)$') THEN 3 ELSE 2 END AS INTEGER) AS source_rank FROM r)"""


def addresses(spark: SparkSession, folder: str) -> DataFrame:
    """The tables' addresses, and the same pages under hosts of every rank."""
    own = table(spark, folder, "paper").where(F.col("official_url") != "").select("seq", F.col("official_url").alias("url"))
    page = F.regexp_replace("url", "^[a-z]+://[^/]*/?", "")
    return own.unionByName(own.select("seq", F.explode(F.array(*(F.concat(F.lit(f"https://{h}/"), page) for h in HOSTS))).alias("url")))


@query(f"WITH {ADDRESS_SQL} SELECT seq, url, host, source_rank FROM k")
def url_source_rank(spark: SparkSession, folder: str) -> DataFrame:
    return addresses(spark, folder).select("seq", "url", host(F.col("url")).alias("host"), source_authority(F.col("url")).alias("source_rank"))


@query(r"""SELECT seq, nullif(regexp_replace(regexp_extract(lower(doi), '(10\.\d+/\S+)', 1), '[.,;\s]+$', ''), '') AS clean, regexp_matches(doi, '^10\.') AS bare FROM openalex_work WHERE doi <> ''""")
def clean_dois(spark: SparkSession, folder: str) -> DataFrame:
    found = F.regexp_replace(F.regexp_extract(F.lower("doi"), r"(10\.\d+/\S+)", 1), r"[.,;\s]+$", "")
    return table(spark, folder, "openalex_work").where(F.col("doi") != "").select("seq", F.nullif(found, F.lit("")).alias("clean"), F.col("doi").rlike(r"^10\.").alias("bare"))


@query(r"""SELECT doc_kind, sum(len(string_split_regex(trim(text), '\s+'))) AS words, count(*) AS texts FROM documents WHERE trim(text) <> '' GROUP BY 1""")
def word_totals(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where(F.trim("text") != "")
    return d.groupBy("doc_kind").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).cast("decimal(38,0)").alias("words"), F.count(F.lit(1)).alias("texts"))


@query("""WITH p AS (SELECT pair_id, arg_max(english, seq) AS english FROM translation_benchmark_passages GROUP BY 1),
l AS (SELECT pair_id, unnest(list_filter(list_transform(string_split(english, chr(10)), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> '')) AS line, generate_subscripts(list_filter(list_transform(string_split(english, chr(10)), lambda x: regexp_replace(x, '^ +| +$', '', 'g')), lambda x: x <> ''), 1) AS n FROM p)
SELECT pair_id, 'en' || CASE WHEN n < 10 THEN '0' || n ELSE CAST(n AS VARCHAR) END AS sentence_id, line FROM l""")
def sentence_ids(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "translation_benchmark_passages").groupBy("pair_id").agg(F.max_by("english", "seq").alias("english"))
    lines = p.select("pair_id", F.posexplode(F.filter(F.transform(F.split("english", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("at", "line"))
    return numbered(lines, ["pair_id"], ["at"], "en", "sentence_id").select("pair_id", "sentence_id", "line")


@query("""SELECT doc_kind, count(*) AS texts, CAST(count(*) FILTER (text IS NULL OR text = '') AS BIGINT) AS missing, CAST(count(*) FILTER (lang = 'en') AS BIGINT) AS english, count(*) FILTER (lang = 'en') / count(*) AS share FROM documents GROUP BY 1""")
def corpus_summary(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_kind", "text", "lang")
    english = F.coalesce(F.sum((F.col("lang") == "en").cast("int")), F.lit(0))
    return d.groupBy("doc_kind").agg(F.count(F.lit(1)).alias("texts"), F.sum((F.coalesce(F.length("text"), F.lit(0)) == 0).cast("int")).alias("missing"), english.alias("english"), (english / F.count(F.lit(1))).alias("share"))


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '(?m)^\s*```')) AS fences, len(regexp_extract_all(text, '(?m)^\s*:::+\s*\{?[A-Za-z0-9_.]')) AS opened, len(regexp_extract_all(text, '(?m)^\s*:::+\s*$')) AS closed FROM documents WHERE text IS NOT NULL)
SELECT doc_id, fences % 2 = 0 AND opened = closed AS balanced FROM c""")
def markdown_shape(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", T.balanced_fences(F.col("text")).alias("balanced"))


@query("SELECT p_partkey, CAST(levenshtein(p_brand, p_type) AS INTEGER) AS distance FROM part")
def edit_distances(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", F.levenshtein("p_brand", "p_type").alias("distance"))


@query("SELECT user_id, event_type, sha256(coalesce(CAST(user_id AS VARCHAR), '') || '|' || coalesce(event_type, '')) AS key FROM (SELECT DISTINCT user_id, event_type FROM events)")
def stable_keys(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.operators.sampling import stable_key

    return table(spark, folder, "events").select("user_id", "event_type").distinct().withColumn("key", stable_key(F.col("user_id").cast("string"), "event_type"))
