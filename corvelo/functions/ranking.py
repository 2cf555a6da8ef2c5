"""Positions within groups, without sorting a whole group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spread_row_number(frame: DataFrame, group: list[str], value: str, tie: str, into: str = "rank_no", buckets: int = 1024) -> DataFrame:
    """Row number by `value` descending, then `tie` ascending, within `group`.

    The range of `value` of each group is cut into `buckets` equal parts. A row's number is the count of
    rows in higher parts, a table of at most `buckets` rows a group, plus its place inside its part, so
    no task sorts more than one part. Null values come last. An empty frame gives an empty frame.
    """
    span = frame.groupBy(*group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    null_safe = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in group]
    width = F.col("_high") - F.col("_low")
    part = F.when(F.col(value).isNull(), F.lit(-1)).when(width > 0, F.floor((F.col(value) - F.col("_low")) / width * buckets).cast("int")).otherwise(0)
    parted = frame.alias("a").join(span.alias("b"), null_safe).select("a.*", "_low", "_high").withColumn("_part", part).drop("_low", "_high")
    counts = parted.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    above = Window.partitionBy(*group).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*group, "_part").orderBy(F.col(value).desc_nulls_last(), F.col(tie).asc_nulls_last())
    null_safe = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in [*group, "_part"]]
    return (
        parted.alias("a")
        .join(offsets.alias("b"), null_safe)
        .select("a.*", "_above")
        .withColumn(into, (F.col("_above") + F.row_number().over(inside)).cast("int"))
        .drop("_above", "_part")
    )


def competition_rank(value, scope: list[str]):
    """Rank 1, 2, 2, 4 by value descending within `scope`; nulls last. Rank unrounded values."""
    return F.rank().over(Window.partitionBy(*scope).orderBy(F.col(value).desc_nulls_last()))


def positional_rank(value, code: str, scope: list[str]):
    """Rank 1, 2, 3, 4 by value descending, ties by `code` descending."""
    return F.row_number().over(Window.partitionBy(*scope).orderBy(F.col(value).desc_nulls_last(), F.col(code).desc()))


def numbered(frame: DataFrame, group: list[str], order: list[str], prefix: str, into: str) -> DataFrame:
    """Ordinal ids such as `en01`, counted within `group`."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return frame.withColumn(into, F.concat(F.lit(prefix), F.lpad(place.cast("string"), F.greatest(F.lit(2), F.length(place.cast("string"))), F.lit("0"))))
