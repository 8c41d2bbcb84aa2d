"""Shared plumbing: the shared folder, materialised tables, Arrow slices."""

from __future__ import annotations

import atexit
import os
import sys
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PACKAGE = Path(__file__).resolve().parents[1]
_made: list[str] = []
#: Bytes of an Arrow batch, about.
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where it is unset in local mode (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quantloom-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; removed when the driver's Python ends."""
    ready(spark)
    path = f"{shared_dir(spark)}/quantloom/{tag}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_sweep, spark)
    _made.append(path)
    return path


def _sweep(spark: SparkSession) -> None:
    try:
        for path in _made:
            delete(spark, path)
    except (OSError, Py4JError):  # the driver's JVM is gone already
        pass


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder; a path that is gone, or a session that has ended, is no error."""
    sc = spark.sparkContext
    if sc._jsc is None or sc._jsc.sc().isStopped():  # the session is over: the folder's own clean-up has it
        return
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def keep(df: DataFrame, tag: str, group_rows: int | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor loses nothing.

    group_rows: the most rows of a row group, for large rows: a reader takes a group's rows, up to some thousands, into memory at once.
    batch_bytes: of the Arrow batches that Python workers get while df is written, about.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    ready(spark, batch_bytes)
    df.write.options(**({"parquet.block.row.count.limit": group_rows} if group_rows else {})).parquet(path)
    ready(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._quantloom_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete what keep() wrote; only once nothing lazy reads it."""
    delete(df.sparkSession, df._quantloom_path)


def ready(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Python workers can import this package, and get Arrow batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_bytes))
    sc = spark.sparkContext
    root = str(_PACKAGE.parent)
    seen = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in seen or os.path.realpath(os.getcwd()) == root or getattr(sc, "_quantloom_sent", False):
        return
    archive = Path(tempfile.mkdtemp(prefix="quantloom-py-")) / "quantloom.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    sc.addPyFile(str(archive))
    sc._quantloom_sent = True


def schema(df: DataFrame, keys: list[str], more: str) -> T.StructType:
    """The columns `keys` of df, and those of a DDL string."""
    return T.StructType([*(T.StructField(c, df.schema[c].dataType) for c in keys), *T.StructType.fromDDL(more).fields])


def pack(docs: DataFrame, used: list[str], results: tuple[str, ...] = ()) -> DataFrame:
    """docs with the columns `used` and all others in one, so that names of working columns can't clash with theirs. Columns with the name of a
    result, in whatever case, give way to it."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in used and not named(c, results)]
    return docs.select(*(c for c in used if c in docs.columns), (F.struct(*rest) if rest else F.lit(None).cast("int")).alias("_others"))


def unpack(df: DataFrame, columns: list[str], used: list[str], results: tuple[str, ...] = ()) -> list:
    """The Columns that pack() took, in their order."""
    return [F.col(c) if c in used else F.col(f"_others.`{c}`").alias(c) for c in columns if not named(c, results)]


def named(column: str, names) -> bool:
    """Whether a column has one of the names (None is none), as Spark compares them: without case."""
    return column.lower() in {n.lower() for n in names if n}


def slices(column: pa.Array | pa.ChunkedArray, size: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about `size` bytes: (first row, end row, bytes, offsets into them). Null counts as ''."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def log(*what) -> None:
    if os.environ.get("QUANTLOOM_LOG"):
        print(*what, file=sys.stderr, flush=True)
