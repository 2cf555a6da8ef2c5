"""Frames shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvelo.operators.indicators import distinct_codes
from corvelo.session import table

#: The country panel of the queries.
PANEL = ("AU", "BR", "CA", "CH", "CN", "DE", "ES", "FR", "GB", "IN", "IT", "JP", "KR", "MX", "SE", "US")


def panel(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c,) for c in PANEL], "country_code string")


PANEL_SQL = "panel AS (SELECT unnest([" + ", ".join(f"'{c}'" for c in PANEL) + "]) AS country_code)"


def blank(name: str):
    """The trimmed text, null where blank. (Spelled out, as `nullif` keeps whole structs from being pruned.)"""
    return F.when(F.trim(F.col(name)) != "", F.trim(F.col(name)))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """The last reconciled record of each paper (venue, paper_key, countries), papers without id by title."""
    rows = table(spark, folder, "reconciled").select(
        F.coalesce(blank("paper.venue_key"), F.lit("none")).alias("venue"), F.coalesce(blank("paper.paper_id"), F.col("paper.title"), F.lit("")).alias("paper_key"), "seq", distinct_codes(F.col("affiliations.country_code")).alias("countries")
    )
    return rows.groupBy("venue", "paper_key").agg(F.max_by("countries", "seq").alias("countries"))


RECORDS_SQL = """records AS (
  SELECT coalesce(nullif(trim(paper.venue_key), ''), 'none') AS venue, coalesce(nullif(trim(paper.paper_id), ''), paper.title, '') AS paper_key,
         arg_max(list_sort(list_distinct(list_filter(list_transform(coalesce(affiliations, []), lambda a: a.country_code), lambda c: c IS NOT NULL AND c <> ''))), seq) AS countries
  FROM reconciled GROUP BY 1, 2)"""
