"""Session, table loading and lineage cutting shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the local bench; a cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillmesh")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only a local master may fall back to a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that every executor reaches")
    own = os.path.join(tempfile.gettempdir(), f"quillmesh-{os.getuid()}")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """This application's folder below the shared one; the driver's file system removes it when the driver ends."""
    path = f"{shared_dir(spark)}/quillmesh-{spark.sparkContext.applicationId}"
    if path not in _OWNED:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)
        _OWNED.add(path)
    return path


def release(spark: SparkSession) -> None:
    """Removes what the application has cut so far; DataFrames that read it are of no more use."""
    path = _own_dir(spark)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _OWNED.discard(path)
    _SNAPSHOTS.clear()


_OWNED: set[str] = set()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    The lineage ends there, so a lost executor costs a re-read and never a recomputation, and every
    later pass sees the same rows in the same partitions.
    """
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SNAPSHOTS: dict[tuple, DataFrame] = {}


def snapshot(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` derives from the tables of ``folder`` alone, whatever is asked of it, written once for a session and
    the state of the folder's files, as an index is; a file that changes makes it anew."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    state = tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))
    key = (spark.sparkContext.applicationId, folder, name, state)
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = cut(build())
    return _SNAPSHOTS[key]


#: Bytes of a partition from which a pass in Python is worth a task of its own.
TASK_BYTES = 64 * 2**20


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as there are cores, if it is estimated to be too small to have them by its size: a
    pass in Python over a small table would else run in one task. What lies in a file for every core, or is large, stays
    as it is and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * TASK_BYTES and len(df.inputFiles()) < cores else df


#: Rows up to which a side of a join is sent to every task.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` written once and, only if it has at most ``rows`` rows, marked to be broadcast; beyond that Catalyst
    chooses, and a join without an equality runs in blocks of partitions."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= rows else kept
