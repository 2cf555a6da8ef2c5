"""Country counts, coverage, sensitivity, pooled estimators, censored and dense indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvelo.functions.ranking import competition_rank


def distinct_codes(values: Column) -> Column:
    """The sorted distinct non-blank entries of an array; null gives an empty array."""
    kept = F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda c: c.isNotNull() & (c != ""))
    return F.array_sort(F.array_distinct(kept))


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, 0.0 where the denominator is 0 or null."""
    return F.when(F.coalesce(bottom, F.lit(0)) == 0, F.lit(0.0)).otherwise(top / bottom)


def country_counts(records: DataFrame, panel: DataFrame) -> DataFrame:
    """Full and fractional counts (scope, country_code, full_count, fractional_count) of records (venue,
    countries), for each venue and the scope `all`, every panel country (country_code) everywhere.

    Fractions are counted by number of countries first, so sums do not depend on row order.
    """
    by_size = records.select("venue", F.explode("countries").alias("country_code"), F.size("countries").alias("k")).groupingSets(
        [[F.col("venue"), F.col("country_code"), F.col("k")], [F.col("country_code"), F.col("k")]], F.col("venue"), F.col("country_code"), F.col("k")
    )
    counts = by_size.agg(F.count(F.lit(1)).alias("n"), F.grouping("venue").alias("whole")).select(F.when(F.col("whole") == 1, "all").otherwise(F.col("venue")).alias("scope"), "country_code", "k", "n")
    counts = counts.groupBy("scope", "country_code").agg(F.sum("n").alias("full_count"), F.round(F.sum(F.col("n") / F.col("k")), 9).alias("fractional_count"))
    scopes = records.select(F.col("venue").alias("scope")).distinct().unionByName(records.sparkSession.range(1).select(F.lit("all").alias("scope")))
    dense = scopes.crossJoin(F.broadcast(panel.select("country_code")))  # venues by panel countries
    return dense.join(counts, ["scope", "country_code"], "left").fillna(0, ["full_count", "fractional_count"])


def coverage(records: DataFrame) -> DataFrame:
    """(scope, universe, with_country, missing_country, coverage) per venue and for `all`."""
    held = (F.size("countries") > 0).cast("int")
    grouped = records.groupingSets([[F.col("venue")], []], F.col("venue")).agg(F.count(F.lit(1)).alias("universe"), F.sum(held).alias("with_country"), F.grouping("venue").alias("whole"))
    grouped = grouped.select(F.when(F.col("whole") == 1, "all").otherwise(F.col("venue")).alias("scope"), "universe", F.coalesce("with_country", F.lit(0)).alias("with_country"))
    return grouped.withColumn("missing_country", F.col("universe") - F.col("with_country")).withColumn("coverage", ratio(F.col("with_country"), F.col("universe")))


def country_sensitivity(records: DataFrame, panel: DataFrame, warn_below: float = 0.9) -> DataFrame:
    """Observed shares, the estimate under missing at random, bounds and ranks per venue and country."""
    joined = country_counts(records, panel).where(F.col("scope") != "all").join(coverage(records), "scope")
    full, share = F.col("full_count"), F.col("coverage")
    joined = (
        joined.withColumn("full_rank", competition_rank("full_count", ["scope"]))
        .withColumn("fractional_rank", competition_rank("fractional_count", ["scope"]))
        .withColumn("observed_full_share", F.round(ratio(full, F.col("with_country")), 8))
        .withColumn("observed_fractional_share", F.round(ratio(F.col("fractional_count"), F.col("with_country")), 8))
        .withColumn("mar_full_count", F.round(ratio(full, share), 6))
        .withColumn("lower_bound", F.round(ratio(full, F.col("universe")), 8))
        .withColumn("upper_bound", F.round(ratio(full + F.col("missing_country"), F.col("universe")), 8))
    )
    return joined.select(
        F.col("scope").alias("venue"), "country_code", "universe", "with_country", "missing_country", F.round("coverage", 8).alias("coverage"), "full_count", F.round("fractional_count", 6).alias("fractional_count"),
        "observed_full_share", "observed_fractional_share", "mar_full_count", "lower_bound", "upper_bound", "full_rank", "fractional_rank", (F.col("full_rank") - F.col("fractional_rank")).alias("rank_change"), (share < warn_below).alias("low_coverage"),
    )


def pooled_estimates(records: DataFrame, panel: DataFrame) -> DataFrame:
    """Equal-venue and paper-weighted country shares over all venues and with each venue left out
    (scenario, estimator, country_code, venue_count, estimate, rank_in_panel)."""
    cells = country_counts(records, panel).where(F.col("scope") != "all").join(coverage(records), "scope")
    cells = cells.select(F.col("scope").alias("venue"), "country_code", F.col("fractional_count").alias("f"), F.col("with_country").alias("observed"))
    venues = records.select("venue").distinct()
    scenarios = venues.select(F.concat(F.lit("leave_out_"), "venue").alias("scenario"), F.col("venue").alias("excluded")).unionByName(
        records.sparkSession.range(1).select(F.lit("all_venues").alias("scenario"), F.lit(None).cast("string").alias("excluded"))
    )
    kept = cells.crossJoin(F.broadcast(scenarios)).where(F.col("excluded").isNull() | (F.col("venue") != F.col("excluded")))  # venues squared by panel
    sums = kept.groupBy("scenario", "country_code").agg(
        F.sum((F.col("observed") > 0).cast("int")).alias("venue_count"),
        F.coalesce(F.avg(F.when(F.col("observed") > 0, F.col("f") / F.col("observed"))), F.lit(0.0)).alias("equal_venue"),
        ratio(F.sum("f"), F.sum("observed")).alias("paper_weighted"),
    )
    long = sums.select("scenario", "country_code", "venue_count", F.explode(F.create_map(F.lit("equal_venue"), "equal_venue", F.lit("paper_weighted"), "paper_weighted")).alias("estimator", "value"))
    long = long.withColumn("value", F.round("value", 12)).withColumn("rank_in_panel", competition_rank("value", ["scenario", "estimator"]))
    return long.select("scenario", "estimator", "country_code", "venue_count", F.round("value", 8).alias("estimate"), "rank_in_panel")


def coverage_gate(records: DataFrame, official: DataFrame, least: float = 0.9, most_spread: float = 0.15) -> DataFrame:
    """One row: lowest and highest coverage against official totals (venue, official), spread, verdict."""
    held = records.groupBy("venue").agg(F.sum((F.size("countries") > 0).cast("int")).alias("held"))
    rates = official.join(held, "venue", "left").select((F.coalesce("held", F.lit(0)) / F.col("official")).alias("rate"))
    gate = rates.agg(F.count(F.lit(1)).alias("venues"), F.min("rate").alias("low"), F.max("rate").alias("high"))
    return gate.select("venues", F.round("low", 6).alias("lowest"), F.round("high", 6).alias("highest"), F.round(F.col("high") - F.col("low"), 6).alias("spread"), ((F.col("low") >= least) & (F.col("high") - F.col("low") <= most_spread)).alias("passes"))


def quality_report(found: DataFrame) -> DataFrame:
    """One row of rates over papers (enumerated, matched, with_affiliation, with_country as booleans) and
    the verdict .95 / .90 / .85."""
    sums = found.agg(*(F.coalesce(F.sum(F.col(c).cast("int")), F.lit(0)).alias(c) for c in ("enumerated", "matched", "with_affiliation", "with_country")))
    rates = sums.withColumn("match_rate", ratio(F.col("matched"), F.col("enumerated"))).withColumn("affiliation_rate", ratio(F.col("with_affiliation"), F.col("enumerated"))).withColumn("country_rate", ratio(F.col("with_country"), F.col("enumerated")))
    return rates.withColumn("passes", (F.col("match_rate") >= 0.95) & (F.col("affiliation_rate") >= 0.90) & (F.col("country_rate") >= 0.85))


def dense_totals(facts: DataFrame, panel: DataFrame, key: str, **sums: str) -> DataFrame:
    """Counts and sums of facts for every panel key, zero where there is none."""
    totals = facts.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))
    return F.broadcast(panel.select(key)).join(totals, key, "left").fillna(0, ["n", *sums])


def censored_top(values: DataFrame, panel: DataFrame, top: int) -> DataFrame:
    """Reported values of the `top` countries only (country_code, value): panel countries outside have a
    null value and the lowest reported value as upper bound; ranks among the reported panel."""
    reported = values.orderBy(F.desc("value"), "country_code").limit(top).select("country_code", "value")
    bound = reported.agg(F.min("value").alias("bound"))
    joined = F.broadcast(panel.select("country_code")).join(reported, "country_code", "left").crossJoin(F.broadcast(bound))
    rank = F.when(F.col("value").isNotNull(), F.rank().over(Window.orderBy(F.col("value").desc_nulls_last())))
    return joined.select("country_code", "value", F.when(F.col("value").isNull(), F.col("bound")).alias("upper_bound_if_unreported"), rank.alias("rank_among_reported"), F.when(F.col("value").isNull(), "not_in_top").otherwise("reported").alias("observation_status"))


def collapsed_sectors(rows: DataFrame, keys: list[str], sector: str) -> DataFrame:
    """One sector per `keys`: mixed where industry and academia meet, else industry, academia, other."""
    has = lambda s: F.max(F.col(sector) == s)
    both = rows.groupBy(*keys).agg(has("industry").alias("i"), has("academia").alias("a"))
    return both.select(*keys, F.when(F.col("i") & F.col("a"), "mixed").when(F.col("i"), "industry").when(F.col("a"), "academia").otherwise("other").alias("sector"))


SECTORS = ("industry", "academia", "mixed", "other")


def sector_mix(rows: DataFrame, panel: DataFrame) -> DataFrame:
    """Counts by panel country and sector of (country_code, sector), dense over both, with shares of the
    country's total to 10 places, null where the total is 0."""
    spark = rows.sparkSession
    counts = rows.groupBy("country_code", "sector").agg(F.count(F.lit(1)).alias("n"))
    grid = panel.select("country_code").crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in SECTORS], "sector string")))
    dense = grid.join(counts, ["country_code", "sector"], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy("country_code"))
    return dense.select("country_code", "sector", F.col("n").alias("model_count"), total.alias("country_total"), F.when(total > 0, F.round(F.col("n") / total, 10)).alias("sector_share"))


def latest_observation(rows: DataFrame, grid: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The latest non-null value per key of a dense grid, with its time, or status `missing`."""
    last = rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.max_by(value, order).alias(value), F.max(order).alias(order))
    return grid.join(last, keys, "left").withColumn("observation_status", F.when(F.col(value).isNull(), "missing").otherwise("observed"))


def rank_by_greater(rows: DataFrame, value: str, focus: Column) -> DataFrame:
    """One row: 1 + how many values exceed that of the focus row."""
    at = rows.where(focus).agg(F.max(value).alias("focus_value"))
    return rows.crossJoin(F.broadcast(at)).agg((1 + F.sum((F.col(value) > F.col("focus_value")).cast("int"))).alias("focus_rank"), F.max("focus_value").alias("focus_value"))


def interval_active(history: Column, year: Column | int) -> Column:
    """Names of an array of (institution_name, start_year, end_year) active in a year; open ends count;
    first-seen order, no repeats."""
    y = F.lit(year) if isinstance(year, int) else year
    kept = F.filter(history, lambda h: (h["start_year"].isNull() | (h["start_year"] <= y)) & (h["end_year"].isNull() | (h["end_year"] >= y)) & h["institution_name"].isNotNull())
    return F.array_distinct(F.transform(kept, lambda h: h["institution_name"]))
