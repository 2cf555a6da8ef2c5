"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from corvelo.plans import catalogue

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def views(folder):
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, (bool, str)):
        return value
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, folder, views, name):
    frame = entry.queries()[name](spark, folder)
    result = views.execute(SQL[name])
    assert table(frame.columns, [tuple(r) for r in frame.collect()]) == table([d[0] for d in result.description], result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
