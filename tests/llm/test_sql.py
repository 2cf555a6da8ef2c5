import glob
import os

import duckdb

from corvelo.llm import queries as Q


def test_sample_sql(spark, folder):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = {r[0]: r[1:] for r in c.execute(Q.oracle_sql()["p5_sample"]).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in Q.p5_sample(spark, folder).collect()}
    assert got == want and got
