"""Sessions, table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: After so many cuts the driver collects its garbage: shuffle files and broadcasts of plans that are done with go
#: only then, and the plans themselves pile up in its memory.
TIDY = 6
#: So does it at any cut where its heap has grown to this share of its limit: a heap that was once needed for garbage is
#: kept, beside the classes and code that grow with the number of plans, until a whole collection gives it back.
GROWN = 0.5
_cuts = [0]


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "corvelo") -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of a folder of Parquet tables; pruning and pushdown are left to Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def prepare_checkpoints(spark: SparkSession) -> None:
    """Makes `checkpoint()` usable: the shared folder of `spark.checkpoint.dir`, or, where that is
    unset and the master is local, a temporary folder. On a cluster without that setting it raises,
    as a folder of one machine would not survive the loss of an executor.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: iterative operators need a folder shared by all executors")
        shared = os.path.join(tempfile.gettempdir(), f"corvelo-checkpoints-{os.getpid()}")
    context.setCheckpointDir(shared)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder, deleted when the application ends."""
    prepare_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def _tidy(spark: SparkSession) -> bool:
    """Counts a cut and lets the driver collect its garbage where that is due; returns whether it was."""
    _cuts[0] += 1
    heap = spark._jvm.java.lang.Runtime.getRuntime()
    due = _cuts[0] % TIDY == 0 or heap.totalMemory() >= GROWN * heap.maxMemory()
    if due:
        spark._jvm.System.gc()
    return due


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Writes the frame as a table into the checkpoint folder and goes on from there.

    Survives the loss of executors. Unlike `checkpoint()`, the table has its true size, so small ones may
    be broadcast behind Spark's own check, and loops do not pile up estimates (a checkpointed frame keeps
    those of its plan, which multiply with each join). Tables go when the application ends, or earlier by
    `drop_cut`.
    """
    spark = frame.sparkSession
    path = shared_path(spark, "cut")
    frame.write.parquet(path)
    _tidy(spark)
    written = spark.read.schema(frame.schema).parquet(path)
    written._cut = path
    return written


def cut_size(frame: DataFrame) -> int:
    """Bytes of the table of a frame that `cut_lineage` returned."""
    spark = frame.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(frame._cut)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def drop_cut(*frames: DataFrame) -> None:
    """Deletes the tables of frames that `cut_lineage` returned and nothing uses any more."""
    for frame in frames:
        if path := getattr(frame, "_cut", None):
            spark = frame.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package, also where the driver's path is not theirs by default."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    held = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, held]))
