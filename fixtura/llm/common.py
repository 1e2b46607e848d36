"""What the training-data operators share: columns, scratch tables and sampling."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import inspect
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six characters (fixed by the contracts).
WORD_BREAKS = " \t\n\u000b\f\r"
BREAK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def give_back() -> None:
    """Return what a worker has freed to the system: workers live on between tasks, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(function):
    """The same function for Spark's Arrow operators, with memory given back at its end."""
    if inspect.isgeneratorfunction(function):

        @functools.wraps(function)
        def each(batches):
            yield from function(batches)
            give_back()

        return each

    def whole(key, table):  # Spark counts the arguments of these
        try:
            return function(key, table)
        finally:
            give_back()

    def both(key, left, right):
        try:
            return function(key, left, right)
        finally:
            give_back()

    return whole if len(inspect.signature(function).parameters) == 2 else both


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches joined to at least so many rows: for short rows that are worked on together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held and any(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


#: Rows that Spark sends to a Python worker at once; texts are long, its own 10,000 are tens of megabytes.
BATCH_ROWS = "500"


def text_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches for this session, unless it has chosen its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; a folder of our own only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return root or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, goes when the session ends."""
    spark = df.sparkSession
    text_batches(spark)
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; a projection would be inlined into every lambda that names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def unit_hash(*cols: Column) -> Column:
    """A seeded, reproducible number in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)).cast("double") / float(1 << 40)


def utf8(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).cast("binary")


def partitions_for(amount: float, per_partition: float, least: int = 1) -> int:
    return max(least, int(-(-amount // per_partition)))
