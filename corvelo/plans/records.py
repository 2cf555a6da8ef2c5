"""Queries of record algebra, sampling and review."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvelo.functions.vocabulary import LEADING_NOTE, MULTINATIONALS
from corvelo.functions.web import host, source_authority
from corvelo.operators import records as R
from corvelo.operators import sampling as S
from corvelo.operators.checks import duplicates
from corvelo.operators.review import status_snapshot, system_signal
from corvelo.plans.base import blank
from corvelo.plans.registry import registry
from corvelo.plans.texts import ADDRESS_SQL, addresses
from corvelo.session import table

REGISTERED, query = registry()

KEY_SQL = "coalesce(venue_key, '') AS venue_key, coalesce(nullif(trim(paper_id), ''), title, '') AS paper_key"


def _papers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "paper").select(F.coalesce("venue_key", F.lit("")).alias("venue_key"), F.coalesce(blank("paper_id"), "title", F.lit("")).alias("paper_key"), "title", "year", "track", "batch_no", "seq")


@query(f"""WITH p AS (SELECT {KEY_SQL}, title, year, batch_no, seq FROM paper),
base AS (SELECT venue_key, paper_key, arg_max(title, seq) AS title, max(seq) AS seq FROM p WHERE batch_no < 8 GROUP BY 1, 2),
upd AS (SELECT venue_key, paper_key, arg_max({{'t': title, 's': seq}}, seq) AS u FROM p WHERE batch_no >= 8 GROUP BY 1, 2)
SELECT venue_key, paper_key, CASE WHEN u IS NOT NULL THEN u.t ELSE title END AS title, CASE WHEN u IS NOT NULL THEN u.s ELSE seq END AS seq FROM base LEFT JOIN upd USING (venue_key, paper_key)""")
def overlay(spark: SparkSession, folder: str) -> DataFrame:
    p = _papers(spark, folder)
    base = R.last_per_key(p.where("batch_no < 8").select("venue_key", "paper_key", "title", "seq"), ["venue_key", "paper_key"], "seq")
    return R.overlay(base, p.where("batch_no >= 8"), ["venue_key", "paper_key"], "seq")


# characters that stand for one of ASCII, for which DuckDB has no decomposition
_LIKE_ASCII = {chr(c): d for c in range(128, 0x20000) if len(d := unicodedata.normalize("NFKD", chr(c))) == 1 and d.isascii() and d.isalnum()}


def canonical_sql(name: str) -> str:
    """SQL of an organisation's comparison key."""
    bare = f"regexp_replace(coalesce({name}, ''), '{LEADING_NOTE}', '')"
    return f"trim(regexp_replace(lower(strip_accents(translate({bare}, '{''.join(_LIKE_ASCII)}', '{''.join(_LIKE_ASCII.values())}'))), '[^a-z0-9]+', ' ', 'g'))"


MERGE_SQL = f"""r AS (SELECT coalesce(paper.venue_key, '') AS venue_key, coalesce(nullif(trim(paper.paper_id), ''), paper.title, '') AS paper_key, openalex_id, match_method, coalesce(affiliations, []) AS aff, coalesce(diagnostics, []) AS diag, affiliations, diagnostics, seq FROM reconciled),
f AS (SELECT venue_key, paper_key, min(seq) AS first_seq, max(seq) AS last_seq FROM r GROUP BY 1, 2),
b AS (SELECT f.*, r.openalex_id, r.match_method, r.aff, r.diag FROM f JOIN r ON r.seq = f.first_seq),
u AS (SELECT f.venue_key, f.paper_key, r.openalex_id AS uo, r.match_method AS um, r.aff AS ua, r.diag AS ud FROM f JOIN r ON r.seq = f.last_seq WHERE last_seq <> first_seq),
j AS (SELECT b.*, uo, um, ua, ud, u.paper_key IS NOT NULL AS has FROM b LEFT JOIN u ON u.venue_key = b.venue_key AND u.paper_key = b.paper_key),
m AS (SELECT *, list_filter(string_split(coalesce(match_method, ''), '+') || string_split(coalesce(um, ''), '+'), lambda x: x <> '') AS l FROM j),
e AS (SELECT venue_key, paper_key, unnest(aff || ua) AS x, unnest(range(len(aff) + len(ua))) AS spot FROM j WHERE has),
k AS (SELECT *, {canonical_sql('x.institution_name')} AS name, coalesce(x.country_code, '') AS country FROM e),
o AS (SELECT * FROM k WHERE name <> '' AND name NOT LIKE '%association for computational linguistics%'),
s AS (SELECT * FROM o WHERE country <> '' OR (venue_key, paper_key, name) NOT IN (SELECT (venue_key, paper_key, name) FROM o WHERE country <> '')),
c AS (SELECT venue_key, paper_key, name, country, min(spot) AS first_at, CASE WHEN country <> '' THEN arg_max(x, spot) ELSE arg_min(x, length(x.institution_name) * 1000 + spot) END AS x FROM s GROUP BY 1, 2, 3, 4),
g AS (SELECT venue_key, paper_key, string_agg(coalesce(x.institution_id, '') || '/' || x.institution_name || '/' || country, '; ' ORDER BY first_at) AS merged FROM c GROUP BY 1, 2)"""


@query(f"""WITH {MERGE_SQL}
SELECT m.venue_key, m.paper_key, coalesce(nullif(uo, ''), openalex_id) AS openalex_id,
  CASE WHEN has THEN nullif(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '+'), '') ELSE match_method END AS match_method,
  CASE WHEN has THEN coalesce(merged, '') ELSE array_to_string(list_transform(aff, lambda x: coalesce(x.institution_id, '') || '/' || coalesce(x.institution_name, '') || '/' || coalesce(x.country_code, '')), '; ') END AS affiliations,
  array_to_string(list_transform(CASE WHEN has THEN list_filter(diag || ud, lambda x, i: list_position(diag || ud, x) = i) ELSE diag END, lambda x: coalesce(x.stage, '') || '/' || coalesce(x.outcome, '') || '/' || coalesce(x.detail, '')), '; ') AS diagnostics
FROM m LEFT JOIN g ON g.venue_key = m.venue_key AND g.paper_key = m.paper_key""")
def merge_evidence(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "reconciled").select(F.coalesce("paper.venue_key", F.lit("")).alias("venue_key"), F.coalesce(blank("paper.paper_id"), "paper.title", F.lit("")).alias("paper_key"), "openalex_id", "match_method", "affiliations", "diagnostics", "seq")
    keys = ["venue_key", "paper_key"]
    first, last = R.first_per_key(r, keys, [F.col("seq")]), R.last_per_key(r, keys, "seq")
    updates = last.join(first.select(*keys, F.col("seq").alias("_s")), keys).where("seq <> _s").drop("_s")
    none = lambda c: F.coalesce(c, F.lit(""))
    shown = lambda c, *fields: F.coalesce(F.array_join(F.transform(c, lambda x: F.concat_ws("/", *(none(x[f]) for f in fields))), "; "), F.lit("")).alias(c)
    return R.merge_evidence(first, updates, keys).select(*keys, "openalex_id", "match_method", shown("affiliations", "institution_id", "institution_name", "country_code"), shown("diagnostics", "stage", "outcome", "detail"))


@query("""SELECT doc_id, doc_id IN (SELECT doc_id FROM subject_label) AS labelled, n_chars FROM documents""")
def select_complement(spark: SparkSession, folder: str) -> DataFrame:
    d, labels = table(spark, folder, "documents").select("doc_id", "n_chars"), table(spark, folder, "subject_label")
    chosen, rest = R.select_records(d, labels, ["doc_id"]), R.complement(d, labels, ["doc_id"])
    return chosen.withColumn("labelled", F.lit(True)).unionByName(rest.withColumn("labelled", F.lit(False)))


@query("""SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'error') DESC, event_id DESC) = 1""")
def context_precedence(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type", "value", F.when(F.col("event_type") == "error", "failed").otherwise("").alias("error"))
    return R.context_precedence(e, ["user_id"], "event_id", "error").drop("error")


@query("""SELECT sha256(text) AS text_hash, min(coalesce(lang, '')) AS lang, array_to_string(list_sort(list(DISTINCT source)), '|') AS source_set, count(DISTINCT coalesce(lang, '')) > 1 AS conflict FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def conflict_dedup(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("text_hash"), F.coalesce("lang", F.lit("")).alias("lang"), "source")
    return R.conflict_checked(d, ["text_hash"], ["lang"], "source")


@query(f"""WITH p AS (SELECT {KEY_SQL}, title, seq FROM paper)
SELECT venue_key, paper_key, arg_min(title, seq) AS first_title, arg_max(title, seq) AS last_title, min(seq) AS position FROM p WHERE title IS NOT NULL GROUP BY 1, 2""")
def first_last_wins(spark: SparkSession, folder: str) -> DataFrame:
    p, keys = _papers(spark, folder).where("title IS NOT NULL").select("venue_key", "paper_key", "title", "seq"), ["venue_key", "paper_key"]
    first = R.first_per_key(p, keys, [F.col("seq")]).select(*keys, F.col("title").alias("first_title"))
    return R.last_value_first_place(p, keys, "seq").select(*keys, F.col("title").alias("last_title"), "position").join(first, keys)


@query(f"WITH p AS (SELECT {KEY_SQL} FROM paper) SELECT venue_key, paper_key, count(*) AS n FROM p GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, folder: str) -> DataFrame:
    return duplicates(_papers(spark, folder), ["venue_key", "paper_key"])


@query("SELECT CASE WHEN venue_key = 'nalcon' THEN 'nalcon-2' ELSE venue_key END AS venue_key, count(*) AS n FROM paper GROUP BY 1")
def venue_relabel(spark: SparkSession, folder: str) -> DataFrame:
    return R.relabel(table(spark, folder, "paper"), "venue_key", "nalcon", "nalcon-2").groupBy("venue_key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT seq, paper.venue_key AS venue_key, paper.paper_id AS paper_id FROM reconciled WHERE len(list_filter(diagnostics, lambda d: d.outcome = 'api_error')) > 0")
def api_error_papers(spark: SparkSession, folder: str) -> DataFrame:
    return R.with_outcome(table(spark, folder, "reconciled"), "api_error").select("seq", "paper.venue_key", "paper.paper_id")


@query(f"""WITH p AS (SELECT {KEY_SQL}, batch_no, seq FROM paper), f AS (SELECT DISTINCT venue_key, paper_key FROM p WHERE batch_no >= 8)
SELECT venue_key, paper_key, seq FROM p WHERE batch_no >= 8 OR (venue_key, paper_key) NOT IN (SELECT (venue_key, paper_key) FROM f)""")
def replace_union(spark: SparkSession, folder: str) -> DataFrame:
    p = _papers(spark, folder).select("venue_key", "paper_key", "seq", "batch_no")
    return R.replace_group(p.where("batch_no < 8"), p.where("batch_no >= 8"), ["venue_key", "paper_key"]).drop("batch_no")


@query("""SELECT venue_key, paper_id, seq FROM (SELECT DISTINCT coalesce(venue_key, '') AS venue_key, coalesce(paper_id, '') AS paper_id, seq FROM paper) p
WHERE NOT EXISTS (SELECT 1 FROM reconciled r WHERE coalesce(r.paper.venue_key, '') = p.venue_key AND coalesce(r.paper.paper_id, '') = p.paper_id)""")
def resume_pending(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.streaming.resume import pending

    key = lambda p: [F.coalesce(f"{p}venue_key", F.lit("")).alias("venue_key"), F.coalesce(f"{p}paper_id", F.lit("")).alias("paper_id")]
    return pending(table(spark, folder, "paper").select(*key(""), "seq"), table(spark, folder, "reconciled").select(*key("paper.")), ["venue_key", "paper_id"])


SAMPLE_SQL = "sha256(coalesce(CAST(doc_id AS VARCHAR), ''))"


@query(f"SELECT doc_kind, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY doc_kind ORDER BY {SAMPLE_SQL}) <= 5")
def stable_stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_kind", "doc_id")
    return S.hash_top(d, ["doc_kind"], 5, S.stable_key(F.col("doc_id").cast("string")))


@query(f"""WITH d AS (SELECT doc_kind, doc_id, n_chars / 3000.0 AS score FROM documents WHERE n_chars IS NOT NULL),
h AS (SELECT *, 'hash' AS pick FROM d QUALIFY row_number() OVER (PARTITION BY doc_kind ORDER BY {SAMPLE_SQL}) <= 5),
t AS (SELECT *, 'threshold' AS pick FROM d WHERE doc_id NOT IN (SELECT doc_id FROM h) QUALIFY row_number() OVER (PARTITION BY doc_kind ORDER BY abs(score - 0.5), {SAMPLE_SQL}) <= 5)
SELECT * FROM h UNION ALL SELECT * FROM t""")
def near_threshold_sample(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").where("n_chars IS NOT NULL").select("doc_kind", "doc_id", (F.col("n_chars") / 3000.0).alias("score"))
    return S.near_threshold(d, ["doc_kind"], 5, 5, "score", 0.5, "doc_id")


@query(f"SELECT doc_kind, doc_id, CAST((row_number() OVER (PARTITION BY doc_kind ORDER BY {SAMPLE_SQL}, doc_id) - 1) % 5 AS INTEGER) AS fold FROM documents")
def stratified_folds(spark: SparkSession, folder: str) -> DataFrame:
    return S.folds(table(spark, folder, "documents").select("doc_kind", "doc_id"), ["doc_kind"], "doc_id", 5)


@query(f"""WITH d AS (SELECT d.doc_id, doc_kind, subject, n_chars FROM documents d LEFT JOIN (SELECT doc_id, min(subject) AS subject FROM subject_label GROUP BY 1) l ON l.doc_id = d.doc_id),
a AS (SELECT doc_id FROM d WHERE subject IS NOT NULL QUALIFY row_number() OVER (PARTITION BY subject ORDER BY {SAMPLE_SQL}) <= 8),
b AS (SELECT doc_id FROM d WHERE n_chars BETWEEN 300 AND 400 QUALIFY row_number() OVER (PARTITION BY doc_kind ORDER BY {SAMPLE_SQL}) <= 4),
c AS (SELECT doc_id FROM d WHERE subject IS NULL QUALIFY row_number() OVER (PARTITION BY doc_kind ORDER BY {SAMPLE_SQL}) <= 5)
SELECT doc_id FROM a UNION SELECT doc_id FROM b UNION SELECT doc_id FROM c""")
def validation_sample(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "subject_label").groupBy("doc_id").agg(F.min("subject").alias("subject"))
    d = table(spark, folder, "documents").select("doc_id", "doc_kind", "n_chars").join(labels, "doc_id", "left")
    return S.stratified_validation(d, "subject", F.col("n_chars").between(300, 400), F.col("subject").isNull(), "doc_kind", "doc_id")


@query()
def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    return S.seeded_sample(table(spark, folder, "paper").select("seq", "venue_key", "paper_id"), ["seq"], 25, 20250727)


@query()
def human_sample(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "translation_eval_pairwise_decisions").where("stable IS NOT NULL AND preferred_model IS NOT NULL").groupBy("direction", "segment_id", "model_pair").agg(F.max_by(F.struct("preferred_model", "stable"), "seq").alias("d")).select("direction", "segment_id", "model_pair", "d.*")
    # penalties stand in for judgments of single candidates, which the tables do not hold
    each = d.select("direction", "segment_id", F.explode(F.transform(F.split("model_pair", r"\|\|"), lambda m: F.trim(m))).alias("model")).distinct()
    penalties = each.withColumn("penalty", F.pmod(F.crc32(F.concat_ws("|", "segment_id", "model")), F.lit(11)).cast("int"))
    return S.human_sample(S.human_candidates(d, penalties))


@query("""WITH s AS (SELECT unnest(['O', 'F', 'P', 'X']) AS o_orderstatus) SELECT s.o_orderstatus, count(o_orderkey) AS n FROM s LEFT JOIN orders USING (o_orderstatus) GROUP BY 1""")
def order_status_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return status_snapshot(table(spark, folder, "orders"), "o_orderstatus", ("O", "F", "P", "X"))


@query(f"""WITH r AS (SELECT coalesce(affiliations, []) AS a, coalesce(openalex_id, '') AS w, coalesce(match_method, '') AS m FROM reconciled),
k AS (SELECT *, list_transform(list_filter(a, lambda x: coalesce(x.country_code, '') <> ''), lambda x: {canonical_sql('x.institution_name')}) AS resolved, list_filter(a, lambda x: coalesce(x.country_code, '') = '') AS bare FROM r),
s AS (SELECT CASE WHEN len(a) = 0 THEN 'unreconciled' WHEN len(bare) = len(a) THEN 'country_missing'
  WHEN len(list_filter(bare, lambda x: list_contains([{', '.join(f"'{n}'" for n in MULTINATIONALS)}], {canonical_sql('x.institution_name')}) AND NOT list_contains(resolved, {canonical_sql('x.institution_name')}))) > 0 THEN 'ambiguous_multinational_branch'
  WHEN w = '' THEN 'fallback_only' WHEN contains(m, 'fallback') OR contains(m, 'pdf-ner') THEN 'mixed_sources' ELSE 'automatic_pass' END AS system_signal FROM k)
SELECT system_signal, CASE WHEN system_signal IN ('unreconciled', 'country_missing', 'ambiguous_multinational_branch') THEN 'high' WHEN system_signal = 'automatic_pass' THEN 'low' ELSE 'medium' END AS priority, count(*) AS n FROM s GROUP BY 1, 2""")
def review_signals(spark: SparkSession, folder: str) -> DataFrame:
    signal, priority, _ = system_signal(F.col("openalex_id"), F.col("affiliations"), F.col("match_method"))
    return table(spark, folder, "reconciled").select(signal.alias("system_signal"), priority.alias("priority")).groupBy("system_signal", "priority").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ADDRESS_SQL} SELECT seq % 50 AS page, host, source_rank FROM k QUALIFY row_number() OVER (PARTITION BY seq % 50 ORDER BY source_rank, seq, host) = 1")
def url_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Pages told apart by a number stand for URLs: several addresses of every rank share each."""
    u = addresses(spark, folder).select((F.col("seq") % 50).alias("page"), host(F.col("url")).alias("host"), source_authority(F.col("url")).alias("source_rank"), F.struct("seq", host(F.col("url"))).alias("place"))
    return R.url_first(u, "page", "source_rank", "place").select("page", "host", "source_rank")


@query(f"""WITH k AS (SELECT coalesce(paper.venue_key, '') AS venue_key, coalesce(nullif(trim(paper.paper_id), ''), paper.title, '') AS paper_key, seq,
  list_sort(list_distinct(list_filter(list_transform(coalesce(affiliations, []), lambda a: a.country_code), lambda c: c IS NOT NULL AND c <> ''))) AS c FROM reconciled),
p AS (SELECT venue_key, paper_key, arg_min(c, seq) AS e, arg_max(c, seq) AS f FROM k GROUP BY 1, 2)
SELECT count(*) AS cases, CAST(count(*) FILTER (e = f) AS BIGINT) AS exact, sum(len(list_intersect(e, f))) / sum(len(e)) AS micro_recall, CAST(count(*) FILTER (len(list_filter(f, lambda x: NOT list_contains(e, x))) > 0) AS BIGINT) AS with_extra FROM p""")
def set_recall(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.operators.evaluate import set_agreement
    from corvelo.operators.indicators import distinct_codes

    r = table(spark, folder, "reconciled").select(F.coalesce("paper.venue_key", F.lit("")).alias("v"), F.coalesce(blank("paper.paper_id"), "paper.title", F.lit("")).alias("k"), "seq", distinct_codes(F.col("affiliations.country_code")).alias("c"))
    return set_agreement(r.groupBy("v", "k").agg(F.min_by("c", "seq").alias("expected"), F.max_by("c", "seq").alias("found")), "expected", "found")
