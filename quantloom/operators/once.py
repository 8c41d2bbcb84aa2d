"""What several steps read is computed once, and kept in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset in local mode (tests), a fresh one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_folder(spark)}/quantloom/{tag}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_sweep, spark)
    _made.append(path)
    return path


def _sweep(spark: SparkSession) -> None:
    try:
        sc = spark.sparkContext
        for path in _made if sc._jsc is not None and not sc._jsc.sc().isStopped() else ():
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    except (OSError, Py4JError):  # the driver's JVM is gone already
        pass


def once(df: DataFrame) -> DataFrame:
    """df, written now as Parquet and read from there by all that follows: lineage is cut, a lost executor loses nothing, and what reads it prunes columns and
    knows its size. A table that is kept already is as it is."""
    if getattr(df, "_quantloom_kept", False):
        return df
    spark = df.sparkSession
    path = fresh_path(spark, "once")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quantloom_kept = True
    return out


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df by hash of the columns, over as many tasks as there are cores, twice. The rows are few and the work on each is long, so they aren't to be
    brought together again for their size."""
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *columns)
