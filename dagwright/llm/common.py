"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Sessions whose tables are removed when the program ends.
SESSIONS: set[str] = set()
#: Rows of a few numbers, and stored bytes, that make one file of an intermediate table, about.
FILE_ROWS, FILE_BYTES = 1 << 16, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session has one of its own and a cluster an error."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        at = f"{tempfile.gettempdir()}/dagwright-shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(at)
    return at.rstrip("/")


def tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read back. Tables go with the session, or with drop().

    `files` is how many files its rows fill at most. Without Hadoop's native library an executor starts a process
    to set the mode of each file, checksum and folder, and all the executor's memory counts twice until that
    process runs its program; so a small table is not left in as many files as there are shuffle partitions.
    """
    spark = df.sparkSession
    at = f"{tables_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df = df if files is None else df.coalesce(files)
    df.write.option("compression", "zstd").parquet(at)
    if spark.sparkContext.applicationId not in SESSIONS:
        SESSIONS.add(spark.sparkContext.applicationId)
        atexit.register(at_end, spark)
    out = spark.read.schema(df.schema).parquet(at)
    out.written_at = at
    return out


def removed(spark: SparkSession, at: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(table: DataFrame) -> int:
    """Bytes of the files of a table that written() has returned."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.written_at)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def drop(*tables: DataFrame) -> None:
    """Removes tables that written() has returned and that nothing reads any more."""
    for t in tables:
        removed(t.sparkSession, t.written_at)


def drop_tables(spark: SparkSession) -> None:
    """Removes every table that written() has left in this session; DataFrames that read them are of no use afterwards."""
    removed(spark, tables_dir(spark))


def at_end(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        drop_tables(spark)


def text_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Rows, and bytes of text, of all docs: one scan of one column."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.col(text)).cast("long")), F.lit(0))).first()
    return int(n), int(size)


def pieces(total: int, each: int) -> int:
    return max(1, -(-int(total) // int(each)))


def freed() -> None:
    """Hands memory that nothing uses back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def kept_by_worker(group: str, name: str, make):
    """An object that a Python worker builds once and keeps over its tasks, until one of another group is asked for."""
    at = sys.modules.setdefault("_dagwright_kept", types.ModuleType("_dagwright_kept")).__dict__
    if at.get("group") != group:
        at["group"], at["kept"] = group, {}
        freed()
    if name not in at["kept"]:
        at["kept"][name] = make()
    return at["kept"][name]
