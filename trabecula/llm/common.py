"""What the operators share: tables, the shared work folder, words."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
A_Z, LOWER_A_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Only a local session may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        base = f"{tempfile.gettempdir()}/trabecula-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def staged(df: DataFrame, name: str, by: str | None = None, arrow_rows: int | None = None) -> DataFrame:
    """df written to the shared folder, in a folder for each value of `by`, and read again: the plan is cut there and a lost
    executor costs no recomputation. `arrow_rows`: rows that go to Python at once while it is written.

    The table goes when the session's JVM ends, or with discard() as soon as nothing reads it any more.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if arrow_rows:
        spark.conf.set(key, str(min(arrow_rows, int(before)) if int(before) > 0 else arrow_rows))
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        if arrow_rows:
            spark.conf.set(key, before)
    store, at = _place(spark, path)
    store.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*tables: DataFrame, only: str = "") -> None:
    """Deletes staged tables, or the one folder `only` of them; others are left alone."""
    for t in tables:
        if path := getattr(t, "staged_at", None):
            store, at = _place(t.sparkSession, f"{path}/{only}" if only else path)
            store.delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of what has been written; they would stay until the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Hands memory that this Python process no longer uses back to the system: Spark keeps its workers, and what they hold, for
    the tasks and stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def thrifty(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The kernel of a mapInArrow, which gives memory back at the end of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            give_back()

    return run


def words(text: Column) -> Column:
    """The words of a text in order; null and empty texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bucket_of(column: str, modulus: int) -> Column:
    """crc32 of the column as text, modulo: the folds of the contracts. Null counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
