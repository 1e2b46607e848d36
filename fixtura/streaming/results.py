"""Results and evidence as streams: latest-wins intake, late evidence windows, rating updates batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.operators.ratings import TIMELINE, EloSettings, folded, rating_steps, ratings_as_of


def timely_evidence(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Evidence known before kickoff (available_at, kickoff_at), late rows dropped by the watermark."""
    return stream.withWatermark("available_at", delay).where(F.col("available_at") < F.col("kickoff_at"))


def evidence_counts(stream: DataFrame, key: str, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Evidence per key and tumbling window of its availability."""
    return timely_evidence(stream, delay).groupBy(F.window("available_at", window), key).agg(F.count("*").alias("n")).select(key, F.col("window.start").alias("from"), "n")


def latest_results(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps the latest row per key in Parquet folders path/v<batch>: corrections supersede.
    A batch that is run again writes the same folder again."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        folder = lambda k: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{k}")
        there = lambda k: folder(k).getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder(k))
        every = batch
        if batch_id and there(batch_id - 1):
            every = batch.unionByName(spark.read.schema(batch.schema).parquet(f"{path}/v{batch_id - 1}"))
        newest = every.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        newest.write.mode("overwrite").parquet(f"{path}/v{batch_id}")

    return write


def rating_batches(path: str, settings: EloSettings = EloSettings()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that rates each batch of matches in order, on from the ratings the batch before left. It
    writes path/timeline/v<batch> and path/ratings/v<batch>, the latter one row per team."""

    def rate(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ratings/v{batch_id - 1}")
        known = spark.read.parquet(last.toString()) if batch_id and last.getFileSystem(spark._jsc.hadoopConfiguration()).exists(last) else None
        start = {r["team"]: r["rating"] for r in known.collect()} if known is not None else {}
        steps = rating_steps(batch, settings).repartition(1).sortWithinPartitions("date", "source_row")
        steps.mapInPandas(folded(settings, start), TIMELINE).write.mode("overwrite").parquet(f"{path}/timeline/v{batch_id}")
        made = spark.read.parquet(f"{path}/timeline/v{batch_id}")
        new = ratings_as_of(made, F.lit("9999-12-31").cast("date"))
        if known is not None:
            new = new.unionByName(known.join(new, "team", "left_anti"))
        new.write.mode("overwrite").parquet(f"{path}/ratings/v{batch_id}")

    return rate
