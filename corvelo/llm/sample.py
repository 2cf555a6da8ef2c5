"""Problem 5: a sample that is the same on every run and keeps its members as data grows.

Epoch-rate selection: a record is drawn once, when it is first seen, against the rate frozen for that
epoch, with a random number that depends on nothing but the record's identifier, the seed and a counter.
The ledger of (key, first epoch, frozen rate, draw, chosen) is what is persisted between runs: a key in
it keeps its line for ever, whatever arrives later.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Draws are whole numbers below this.
DRAWS = 2**52


def counter_draw(key: Column, seed: str, counter: int = 0) -> Column:
    """A draw in [0, 1) from a counter-based generator: the leading 52 bits of SHA-256 over seed, counter
    and key. The same for every run, order and partitioning; null gives null."""
    word = F.substring(F.sha2(F.concat_ws("|", F.lit(seed), F.lit(str(counter)), key), 256), 1, 13)
    return F.when(key.isNotNull(), F.conv(word, 16, 10).cast("bigint") / F.lit(float(DRAWS)))


def halving_rates(first: float = 0.2, every: int = 12) -> Callable[[Column], Column]:
    """A schedule of frozen rates: `first` for the epochs below `every`, half of it for the next, and so on."""
    return lambda epoch: F.lit(first) / F.pow(F.lit(2.0), F.floor(F.coalesce(epoch, F.lit(0)) / every))


def new_lines(records: DataFrame, ledger: DataFrame | None, rate: Callable[[Column], Column], seed: str = "sample", key: str = "key", epoch: str = "epoch", order: str = "seq") -> DataFrame:
    """The lines (key, first_epoch, rate, draw, chosen) that `records` add to a ledger.

    A key's epoch is that of its first row by `order`, the order of arrival, so neither later repeats
    nor rows that arrive late with an older epoch change it. An epoch that the ledger holds keeps its
    frozen rate; `rate` gives that of a new one. Null keys are left out; a null epoch counts as 0. Repeats
    of a key are combined before the shuffle, so one key may hold any share of the rows. Other columns of
    `records`, whatever their names, do no harm.
    """
    first = records.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min_by(F.coalesce(F.col(epoch), F.lit(0)), F.col(order)).alias("first_epoch"))
    wanted = rate(F.col("first_epoch"))
    if ledger is not None:
        frozen = ledger.groupBy("first_epoch").agg(F.min("rate").alias("frozen"))
        first = first.join(ledger.select("key"), "key", "left_anti").join(frozen, "first_epoch", "left")
        wanted = F.coalesce("frozen", wanted)
    drawn = first.select("key", "first_epoch", wanted.alias("rate"), counter_draw(F.col("key"), seed).alias("draw"))
    return drawn.withColumn("chosen", F.col("draw") < F.col("rate"))


def extend_ledger(records: DataFrame, ledger: DataFrame | None, rate: Callable[[Column], Column], seed: str = "sample", key: str = "key", epoch: str = "epoch", order: str = "seq") -> DataFrame:
    """The ledger after `records` arrived: its lines as they are and those of `new_lines`."""
    drawn = new_lines(records, ledger, rate, seed, key, epoch, order)
    return drawn if ledger is None else ledger.select(drawn.columns).unionByName(drawn)


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The ledger kept at `path`, None where there is none yet, and the number of its runs."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    runs = [s.getPath().toString() for s in files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, "run-*")) or []]
    return (spark.read.parquet(*runs) if runs else None), len(runs)


def update_ledger(records: DataFrame, path: str, rate: Callable[[Column], Column], seed: str = "sample", key: str = "key", epoch: str = "epoch", order: str = "seq") -> DataFrame:
    """Adds the lines of new keys to the ledger kept at `path` and returns the whole. A second run over the
    same records adds nothing.

    A run is written aside and put in place by one renaming that fails where another run of that number has come
    first; it is then drawn again against the longer ledger. So a run is whole or absent, and two at a
    time write no key twice."""
    spark = records.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    while True:
        held, runs = read_ledger(spark, path)
        aside = f"{path}/_run-{uuid.uuid4().hex}"
        new_lines(records, held, rate, seed, key, epoch, order).write.parquet(aside)
        files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(Path(aside).toUri(), spark._jsc.hadoopConfiguration()) if "://" in aside else spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
        try:
            files.rename(Path(aside), Path(f"{path}/run-{runs:06d}"), spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            files.delete(Path(aside), True)
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            continue
        return read_ledger(spark, path)[0]


def paper_key() -> Column:
    """A paper's identity: venue and id, or, where the id is blank, the title. Null where both are blank."""
    blank = lambda name: F.nullif(F.trim(F.col(name)), F.lit(""))
    by_id = F.concat(F.lit("id|"), F.coalesce(blank("venue_key"), F.lit("")), F.lit("|"), blank("paper_id"))
    return F.coalesce(by_id, F.concat(F.lit("title|"), blank("title")))
