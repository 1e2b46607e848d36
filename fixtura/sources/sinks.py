"""Writers that refuse to overwrite what differs, and content-derived versions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.shared import DataError


def exists(df: DataFrame, path: str) -> bool:
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_table(df: DataFrame, path: str, force: bool = False, partition_by: list[str] | None = None) -> None:
    """Parquet at path; an existing table stays unless force."""
    writer = df.write.mode("overwrite" if force else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_audit(parts: Mapping[str, DataFrame], folder: str, force: bool = False) -> None:
    """One folder of CSV per audit frame."""
    for name, df in parts.items():
        df.write.mode("overwrite" if force else "errorifexists").option("header", True).csv(f"{folder}/{name}")


def write_report(df: DataFrame, folder: str, force: bool = False) -> None:
    """A finished report for people (CSV with a header) and for programs (JSON lines, nulls kept), evaluated once."""
    write_table(df, f"{folder}/rows", force)
    rows = df.sparkSession.read.schema(df.schema).parquet(f"{folder}/rows")
    write_audit({"csv": rows}, folder, force)
    rows.write.mode("overwrite" if force else "errorifexists").option("ignoreNullFields", False).json(f"{folder}/json")


def version_of(parts: Mapping[str, object]) -> str:
    """Sixteen digits of the hash of what a dataset was made from."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def write_manifest(spark, manifest: Mapping[str, object], path: str) -> None:
    """A one-row JSON table; writing other content to the same path is refused."""
    text = json.dumps(manifest, sort_keys=True)
    row = spark.createDataFrame([(text,)], "manifest string")
    if exists(row, path):
        if spark.read.text(path).first()[0] != text:
            raise DataError(f"{path} holds another manifest")
        return
    row.write.text(path)


def content_hash(df: DataFrame) -> str:
    """The same for the same rows in any order: sums of row hashes, halves apart so that none overflows."""
    rows = df.select(F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{k}") for k in range(8)]
    got = rows.agg(F.count("*").cast("string").alias("n"), *parts).first()
    return hashlib.sha256("|".join(x or "" for x in got).encode()).hexdigest()
