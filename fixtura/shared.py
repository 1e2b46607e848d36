"""What several layers need: size-checked broadcasts, scratch tables, column checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many rows; beyond that Spark chooses.
BROADCAST_ROWS = 100_000


class SchemaError(ValueError):
    """A table lacks required columns."""


class DataError(ValueError):
    """Rows break a rule that admits no exception."""


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> DataFrame:
    if missing := [c for c in columns if c not in df.columns]:
        raise SchemaError(f"{name}: missing columns {', '.join(missing)}")
    return df


def small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the cluster names in spark.checkpoint.dir, gone when the session ends."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    path = f"{root}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back, for loops that would grow a plan."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def refuse(df: DataFrame, message: str) -> None:
    """Raise if df has rows; they are named in the error."""
    if rows := df.limit(5).collect():
        raise DataError(f"{message}: {[r.asDict() for r in rows]}")
