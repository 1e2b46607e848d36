"""Delimited text with provenance: every cell a string, empty for missing, the file and line it came from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fixtura.shared import SchemaError


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first file, read by Spark's own reader (it drops a byte-order mark)."""
    return spark.read.option("header", True).csv(path).columns


def scan(spark: SparkSession, path: str, required: Sequence[str] = (), columns: dict[str, str] | None = None) -> DataFrame:
    """All columns as text, nulls as ''. columns maps names in the file to names wanted; missing ones come out null.
    source_file is the file's name. Where the file has no natural row key, use numbered()."""
    names = header_of(spark, path)
    if missing := [c for c in required if c not in names]:
        raise SchemaError(f"{path}: missing columns {', '.join(missing)}")
    schema = StructType([StructField(c, StringType()) for c in names])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    rows = rows.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in names], F.col("_metadata.file_name").alias("source_file"))
    if columns is None:
        return rows
    return rows.select(*[F.col(f"`{old}`").alias(new) if old in names else F.lit(None).cast("string").alias(new) for old, new in columns.items()], "source_file")


def numbered(df: DataFrame, name: str = "source_row", first: int = 2) -> DataFrame:
    """df with dense line numbers in read order, the header being line 1. The one place where row order itself is
    data; Spark numbers partitions after counting them, nothing is gathered."""
    schema = StructType([*df.schema.fields, StructField(name, LongType())])
    return df.sparkSession.createDataFrame(df.rdd.zipWithIndex().map(lambda x: (*x[0], x[1] + first)), schema)


def read_table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None, limit: int | None = None) -> DataFrame:
    """A named table of a folder: <name>.parquet, else <name>.csv.gz, else <name>.csv; columns and limit are pushed down."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    there = lambda file: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{file}"))
    if there(f"{name}.parquet"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
    else:
        file = next((f for f in (f"{name}.csv.gz", f"{name}.csv") if there(f)), None)
        if file is None:
            raise FileNotFoundError(f"{folder} has no table {name}")
        df = scan(spark, f"{folder}/{file}").drop("source_file")
    df = df.select(*columns) if columns else df
    return df.limit(limit) if limit else df


def table_names(spark: SparkSession, folder: str) -> list[str]:
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files = [s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(folder))]
    return sorted({f.split(".")[0] for f in files if f.endswith((".parquet", ".csv", ".csv.gz"))})


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """file and sha256 of every file under path."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"))


def optional(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """The table at path with these columns as text, cast to schema; columns the file lacks are null, and a missing
    file is an empty table unless it is required."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    empty = spark.createDataFrame([], schema)
    if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        if required:
            raise FileNotFoundError(path)
        return empty
    rows = scan(spark, path)
    cells = [(F.nullif(F.trim(f"`{f.name}`"), F.lit("")).try_cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in empty.schema.fields]
    return rows.select(*cells)


def settings(lines: DataFrame, taken: list[str]) -> DataFrame:
    """key and value of lines (seq, line) KEY=VALUE. Blank lines, comments (#) and lines without "=" give nothing; the
    value may hold "=" itself; the first line of a key holds, and keys already taken are never set anew."""
    clean = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    rows = lines.select("seq", clean(F.col("line")).alias("line")).where("line not like '#%' and instr(line, '=') > 0")
    key, value = clean(F.substring_index("line", "=", 1)), clean(F.expr("substring(line, instr(line, '=') + 1)"))
    pairs = rows.select("seq", key.alias("key"), value.alias("value")).where((F.col("key") != "") & ~F.col("key").isin(taken))
    return pairs.groupBy("key").agg(F.min_by("value", "seq").alias("value"))
