"""Queries of counts, coverage, pooling, gates and dense indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvelo.functions.ranking import positional_rank
from corvelo.operators import indicators as I
from corvelo.plans.base import PANEL_SQL, RECORDS_SQL, panel, records
from corvelo.plans.registry import registry
from corvelo.session import table

REGISTERED, query = registry()

COUNTS_SQL = f"""{RECORDS_SQL}, {PANEL_SQL},
each AS (SELECT venue, unnest(countries) AS country_code, len(countries) AS k FROM records),
scoped AS (SELECT venue AS scope, country_code, k FROM each UNION ALL SELECT 'all', country_code, k FROM each),
by_size AS (SELECT scope, country_code, k, count(*) AS n FROM scoped GROUP BY ALL),
counts AS (SELECT scope, country_code, CAST(sum(n) AS BIGINT) AS full_count, round(sum(n / k), 9) AS fractional_count FROM by_size GROUP BY ALL),
scopes AS (SELECT DISTINCT venue AS scope FROM records UNION ALL SELECT 'all'),
cells AS (SELECT s.scope, p.country_code, coalesce(c.full_count, 0) AS full_count, coalesce(c.fractional_count, 0.0) AS fractional_count
          FROM scopes s CROSS JOIN panel p LEFT JOIN counts c ON c.scope = s.scope AND c.country_code = p.country_code),
cover AS (SELECT scope, count(*) AS universe, count(*) FILTER (len(countries) > 0) AS with_country
          FROM (SELECT venue AS scope, countries FROM records UNION ALL SELECT 'all', countries FROM records) GROUP BY 1)"""


@query(f"""WITH {COUNTS_SQL}, x AS (
  SELECT c.scope AS venue, country_code, universe, with_country, universe - with_country AS missing_country,
         CASE WHEN universe = 0 THEN 0.0 ELSE with_country / universe END AS cov, full_count, fractional_count,
         CAST(rank() OVER (PARTITION BY c.scope ORDER BY full_count DESC) AS INTEGER) AS full_rank,
         CAST(rank() OVER (PARTITION BY c.scope ORDER BY fractional_count DESC) AS INTEGER) AS fractional_rank
  FROM cells c JOIN cover v ON v.scope = c.scope WHERE c.scope <> 'all')
SELECT venue, country_code, universe, with_country, missing_country, round(cov, 8) AS coverage, full_count, round(fractional_count, 6) AS fractional_count,
  CASE WHEN with_country = 0 THEN 0.0 ELSE round(full_count / with_country, 8) END AS observed_full_share,
  CASE WHEN with_country = 0 THEN 0.0 ELSE round(fractional_count / with_country, 8) END AS observed_fractional_share,
  CASE WHEN cov = 0 THEN 0.0 ELSE round(full_count / cov, 6) END AS mar_full_count,
  CASE WHEN universe = 0 THEN 0.0 ELSE round(full_count / universe, 8) END AS lower_bound,
  CASE WHEN universe = 0 THEN 0.0 ELSE round((full_count + missing_country) / universe, 8) END AS upper_bound,
  full_rank, fractional_rank, full_rank - fractional_rank AS rank_change, cov < 0.9 AS low_coverage FROM x""")
def country_sensitivity(spark: SparkSession, folder: str) -> DataFrame:
    return I.country_sensitivity(records(spark, folder), panel(spark))


@query(f"WITH {COUNTS_SQL} SELECT scope, country_code, full_count, round(fractional_count, 6) AS fractional_count FROM cells")
def country_counts_all_scopes(spark: SparkSession, folder: str) -> DataFrame:
    return I.country_counts(records(spark, folder), panel(spark)).withColumn("fractional_count", F.round("fractional_count", 6))


@query(f"WITH {COUNTS_SQL} SELECT scope, universe, with_country, universe - with_country AS missing_country, with_country / universe AS coverage FROM cover")
def coverage_by_scope(spark: SparkSession, folder: str) -> DataFrame:
    return I.coverage(records(spark, folder))


@query(f"""WITH {COUNTS_SQL}, v AS (SELECT c.scope AS venue, country_code, fractional_count AS f, with_country AS observed FROM cells c JOIN cover u ON u.scope = c.scope WHERE c.scope <> 'all'),
scenarios AS (SELECT 'all_venues' AS scenario, NULL AS excluded UNION ALL SELECT 'leave_out_' || venue, venue FROM (SELECT DISTINCT venue FROM records)),
sums AS (SELECT scenario, country_code, CAST(count(*) FILTER (observed > 0) AS BIGINT) AS venue_count, coalesce(avg(f / observed) FILTER (observed > 0), 0.0) AS equal_venue,
                CASE WHEN sum(observed) = 0 THEN 0.0 ELSE sum(f) / sum(observed) END AS paper_weighted
         FROM v JOIN scenarios ON excluded IS NULL OR venue <> excluded GROUP BY 1, 2),
long AS (SELECT scenario, country_code, venue_count, 'equal_venue' AS estimator, round(equal_venue, 12) AS value FROM sums UNION ALL SELECT scenario, country_code, venue_count, 'paper_weighted', round(paper_weighted, 12) FROM sums)
SELECT scenario, estimator, country_code, venue_count, round(value, 8) AS estimate, CAST(rank() OVER (PARTITION BY scenario, estimator ORDER BY value DESC) AS INTEGER) AS rank_in_panel FROM long""")
def pooled_leave_one_out(spark: SparkSession, folder: str) -> DataFrame:
    return I.pooled_estimates(records(spark, folder), panel(spark))


@query(f"""WITH {RECORDS_SQL}, official AS (SELECT coalesce(nullif(trim(venue_key), ''), 'none') AS venue, count(DISTINCT coalesce(nullif(trim(paper_id), ''), title)) AS official FROM paper GROUP BY 1),
held AS (SELECT venue, count(*) FILTER (len(countries) > 0) AS held FROM records GROUP BY 1),
r AS (SELECT coalesce(held, 0) / official AS rate FROM official LEFT JOIN held USING (venue))
SELECT count(*) AS venues, round(min(rate), 6) AS lowest, round(max(rate), 6) AS highest, round(max(rate) - min(rate), 6) AS spread, min(rate) >= 0.9 AND max(rate) - min(rate) <= 0.15 AS passes FROM r""")
def coverage_gate(spark: SparkSession, folder: str) -> DataFrame:
    p = table(spark, folder, "paper").select(F.coalesce(F.nullif(F.trim("venue_key"), F.lit("")), F.lit("none")).alias("venue"), F.coalesce(F.nullif(F.trim("paper_id"), F.lit("")), "title").alias("k"))
    return I.coverage_gate(records(spark, folder), p.groupBy("venue").agg(F.count_distinct("k").alias("official")))


@query("""SELECT CAST(count(*) AS BIGINT) AS enumerated, CAST(count(*) FILTER (openalex_id <> '') AS BIGINT) AS matched, CAST(count(*) FILTER (len(affiliations) > 0) AS BIGINT) AS with_affiliation,
  CAST(count(*) FILTER (len(list_filter(affiliations, lambda a: a.country_code <> '')) > 0) AS BIGINT) AS with_country,
  count(*) FILTER (openalex_id <> '') / count(*) AS match_rate, count(*) FILTER (len(affiliations) > 0) / count(*) AS affiliation_rate,
  count(*) FILTER (len(list_filter(affiliations, lambda a: a.country_code <> '')) > 0) / count(*) AS country_rate,
  count(*) FILTER (openalex_id <> '') / count(*) >= 0.95 AND count(*) FILTER (len(affiliations) > 0) / count(*) >= 0.9
    AND count(*) FILTER (len(list_filter(affiliations, lambda a: a.country_code <> '')) > 0) / count(*) >= 0.85 AS passes FROM reconciled""")
def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "reconciled")
    return I.quality_report(r.select(F.lit(True).alias("enumerated"), F.coalesce(F.length("openalex_id") > 0, F.lit(False)).alias("matched"), F.coalesce(F.size("affiliations") > 0, F.lit(False)).alias("with_affiliation"), (F.size(I.distinct_codes(F.col("affiliations.country_code"))) > 0).alias("with_country")))


@query("""SELECT n_nationkey, count(s_suppkey) AS n, round(coalesce(sum(s_acctbal), 0), 6) AS rmax FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""")
def hpc_by_country(spark: SparkSession, folder: str) -> DataFrame:
    facts = table(spark, folder, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_acctbal")
    return I.dense_totals(facts, table(spark, folder, "nation"), "n_nationkey", rmax="s_acctbal").withColumn("rmax", F.round("rmax", 6))


def _revenue(spark: SparkSession, folder: str) -> DataFrame:
    o, c, n = table(spark, folder, "orders"), table(spark, folder, "customer"), table(spark, folder, "nation")
    by = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    return by.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country_code"), "value")


REVENUE_SQL = "rev AS (SELECT n_name AS country_code, round(sum(o_totalprice), 2) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)"


@query(f"""WITH {REVENUE_SQL}, top AS (SELECT * FROM rev ORDER BY value DESC, country_code LIMIT 15), bound AS (SELECT min(value) AS b FROM top)
SELECT n_name AS country_code, value, CASE WHEN value IS NULL THEN b END AS upper_bound_if_unreported,
  CASE WHEN value IS NOT NULL THEN CAST(rank() OVER (ORDER BY value DESC NULLS LAST) AS DOUBLE) END AS rank_among_reported, CASE WHEN value IS NULL THEN 'not_in_top' ELSE 'reported' END AS observation_status
FROM nation LEFT JOIN top ON n_name = country_code CROSS JOIN bound""")
def censored_top15(spark: SparkSession, folder: str) -> DataFrame:
    return I.censored_top(_revenue(spark, folder), table(spark, folder, "nation").select(F.col("n_name").alias("country_code")), 15).withColumn("rank_among_reported", F.col("rank_among_reported").cast("double"))


@query(f"""WITH {REVENUE_SQL}, f AS (SELECT max(value) AS focus_value FROM rev WHERE country_code = 'NATION_3') SELECT 1 + count(*) FILTER (value > focus_value) AS focus_rank, max(focus_value) AS focus_value FROM rev CROSS JOIN f""")
def rank_gt_count(spark: SparkSession, folder: str) -> DataFrame:
    return I.rank_by_greater(_revenue(spark, folder), "value", F.col("country_code") == "NATION_3")


@query(f"""WITH {REVENUE_SQL}, r AS (SELECT country_code, floor(value / 1e7) AS value FROM rev) SELECT country_code, value, CAST(row_number() OVER (ORDER BY value DESC, country_code DESC) AS INTEGER) AS place FROM r""")
def rank_tiebreak(spark: SparkSession, folder: str) -> DataFrame:
    r = _revenue(spark, folder).withColumn("value", F.floor(F.col("value") / 1e7).cast("double")).withColumn("_all", F.lit(1))
    return r.withColumn("place", positional_rank("value", "country_code", ["_all"])).drop("_all")


@query(f"""WITH {PANEL_SQL}, e AS (SELECT seq, unnest(affiliations) AS a FROM reconciled WHERE reconciled_at >= TIMESTAMP '2025-01-01' AND reconciled_at < TIMESTAMP '2026-01-01'),
s AS (SELECT seq, a.country_code AS country_code, CASE a.institution_type WHEN 'company' THEN 'industry' WHEN 'education' THEN 'academia' ELSE 'other' END AS sector FROM e WHERE a.country_code <> ''),
k AS (SELECT seq, country_code, CASE WHEN bool_or(sector = 'industry') AND bool_or(sector = 'academia') THEN 'mixed' WHEN bool_or(sector = 'industry') THEN 'industry' WHEN bool_or(sector = 'academia') THEN 'academia' ELSE 'other' END AS sector FROM s GROUP BY 1, 2),
c AS (SELECT country_code, sector, count(*) AS n FROM k GROUP BY 1, 2),
d AS (SELECT p.country_code, x.sector, coalesce(n, 0) AS n FROM panel p CROSS JOIN (SELECT unnest(['industry', 'academia', 'mixed', 'other']) AS sector) x LEFT JOIN c ON c.country_code = p.country_code AND c.sector = x.sector)
SELECT country_code, sector, n AS model_count, CAST(sum(n) OVER w AS BIGINT) AS country_total, CASE WHEN sum(n) OVER w > 0 THEN round(n / sum(n) OVER w, 10) END AS sector_share FROM d WINDOW w AS (PARTITION BY country_code)""")
def sector_mix(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "reconciled").where((F.col("reconciled_at") >= F.lit("2025-01-01").cast("timestamp_ntz")) & (F.col("reconciled_at") < F.lit("2026-01-01").cast("timestamp_ntz")))
    # two fields by name: of an exploded struct the scan would read all
    e = r.select("seq", F.explode(F.arrays_zip("affiliations.country_code", "affiliations.institution_type")).alias("a")).select("seq", F.col("a.country_code").alias("country_code"), F.when(F.col("a.institution_type") == "company", "industry").when(F.col("a.institution_type") == "education", "academia").otherwise("other").alias("sector"))
    return I.sector_mix(I.collapsed_sectors(e.where(F.col("country_code") != ""), ["seq", "country_code"], "sector"), panel(spark))


@query("""WITH grid AS (SELECT user_id, event_type FROM (SELECT DISTINCT user_id FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error')),
l AS (SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events WHERE event_type <> 'error' AND value IS NOT NULL GROUP BY 1, 2)
SELECT user_id, event_type, value, event_id, CASE WHEN value IS NULL THEN 'missing' ELSE 'observed' END AS observation_status FROM grid LEFT JOIN l USING (user_id, event_type)""")
def latest_observation(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kinds = e.where(F.col("event_type") != "error").select("event_type").distinct()
    grid = e.select("user_id").distinct().crossJoin(F.broadcast(kinds))  # event types are a handful
    return I.latest_observation(e.where(F.col("event_type") != "error"), grid, ["user_id", "event_type"], "event_id", "value")


@query("""WITH a AS (SELECT profile_id, seq, list_sort(list_distinct(list_transform(list_filter(history, lambda h: (h.start_year IS NULL OR h.start_year <= 2022) AND (h.end_year IS NULL OR h.end_year >= 2022) AND h.institution_name IS NOT NULL), lambda h: h.institution_name))) AS x FROM author_profile)
SELECT seq, profile_id, CAST(len(x) AS INTEGER) AS active, x[1] AS first_name FROM a""")
def interval_overlap_active(spark: SparkSession, folder: str) -> DataFrame:
    x = F.array_sort(I.interval_active(F.coalesce(F.col("history"), F.array()), 2022))
    return table(spark, folder, "author_profile").select("seq", "profile_id", F.size(x).alias("active"), F.get(x, F.lit(0)).alias("first_name"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_events(spark: SparkSession, folder: str) -> DataFrame:
    from corvelo.streaming.resume import windowed_counts

    return windowed_counts(table(spark, folder, "events"), "ts", "1 hour", "10 minutes", ["event_type"])
