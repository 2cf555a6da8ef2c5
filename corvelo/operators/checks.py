"""Assertions on frames. Each runs one small aggregation and raises with a few examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _none(frame: DataFrame, what: str) -> None:
    if rows := frame.take(5):
        raise ValueError(f"{what}: {[tuple(r) for r in rows]}")


def duplicates(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with their count `n`."""
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require_unique(frame: DataFrame, keys: list[str]) -> DataFrame:
    _none(duplicates(frame, keys), "duplicate keys")
    return frame


def require_covered(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Every key of `left` is in `right` (null keys equal each other)."""
    _none(missing_keys(left, right, keys), "keys without a partner")
    return left


def missing_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of `left` that `right` lacks; nulls equal nulls."""
    a, b = left.select(*keys).distinct().alias("a"), right.select(*keys).distinct().alias("b")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "left_anti")


def require_same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> None:
    """Both sides hold the same set of keys."""
    require_covered(left, right, keys)
    require_covered(right, left, keys)


def require_domain(frame: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    _none(frame.where(~F.col(column).isin(allowed)).select(column).distinct(), f"{column} outside its domain")
    return frame


def require_rows(frame: DataFrame) -> DataFrame:
    if frame.isEmpty():
        raise ValueError("no rows")
    return frame


def single_value(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The one distinct combination of `columns`; raises if there are more."""
    found = frame.select(*columns).distinct()
    if len(found.take(2)) > 1:
        raise ValueError(f"several values of {columns}")
    return found


def violations(**rules: Column) -> Column:
    """The names of the rules (conditions that must hold) that a row breaks; null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def valid_rows(frame: DataFrame, **rules: Column) -> DataFrame:
    return frame.where(F.size(violations(**rules)) == 0)
