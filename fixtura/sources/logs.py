"""Append-only, hash-chained logs: each entry's hash covers the one before it and its own payload.

Appending is sequential by nature and runs over the new entries only, as one ordered stream; verifying is not, and
runs in parallel: every entry names the hash it follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.shared import DataError, refuse

GENESIS = "0" * 64
CHAIN = "seq long, payload string, prev_hash string, entry_hash string"


def chained(start: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = start
        for batch in batches:
            rows = []
            for seq, payload in zip(batch["seq"], batch["payload"], strict=True):
                entry = hashlib.sha256((last + payload).encode()).hexdigest()
                rows.append((seq, payload, last, entry))
                last = entry
            yield pd.DataFrame(rows, columns=["seq", "payload", "prev_hash", "entry_hash"])

    return run


def chain(payloads: DataFrame, start: str = GENESIS) -> DataFrame:
    """payloads (seq, payload) in the order of seq with their links, following the hash `start`."""
    return payloads.select("seq", "payload").repartition(1).sortWithinPartitions("seq").mapInPandas(chained(start), CHAIN)


def tail(log: DataFrame) -> tuple[int, str]:
    """The last entry's number and hash."""
    row = log.agg(F.max("seq").alias("seq"), F.max_by("entry_hash", "seq").alias("entry_hash")).first()
    return (-1, GENESIS) if row["seq"] is None else (row["seq"], row["entry_hash"])


def append(log: DataFrame, payloads: DataFrame, key: list[str]) -> DataFrame:
    """The new entries for payloads (order, payload, and the key columns), refused if a key repeats or is in the log
    (whose key columns are fields of its JSON payloads)."""
    refuse(payloads.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "repeated keys in new entries")
    old = log.select(*[F.get_json_object("payload", f"$.{k}").alias(k) for k in key])
    refuse(payloads.select(*[F.col(k).cast("string").alias(k) for k in key]).join(old, key, "left_semi"), "the log already has entries")
    last, start = tail(log)
    numbered = payloads.withColumn("seq", F.row_number().over(Window.orderBy("order")) + F.lit(last).cast("long"))
    return chain(numbered, start)


def broken(log: DataFrame) -> DataFrame:
    """seq and problem of entries that don't follow the one before or whose hash isn't that of their payload. The
    order is that of seq; the neighbour is found by equality on seq, so no entry waits for another."""
    before = log.select((F.col("seq") + 1).alias("seq"), F.col("entry_hash").alias("expected"))
    met = log.join(before, "seq", "left").withColumn("expected", F.coalesce("expected", F.lit(GENESIS)))
    gap = met.where(F.col("prev_hash") != F.col("expected")).select("seq", F.lit("chain").alias("problem"))
    edited = log.where(F.sha2(F.concat("prev_hash", "payload"), 256) != F.col("entry_hash")).select("seq", F.lit("payload").alias("problem"))
    return gap.union(edited)


def log_hash(log: DataFrame) -> str:
    """The hash of the entries' hashes in order: a log of n entries sends n hashes of 64 characters to one task."""
    rows = log.select("seq", "entry_hash").orderBy("seq").agg(F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("seq", "entry_hash"))), lambda x: x["entry_hash"])), 256).alias("h")).first()
    return rows["h"]


def check_results(results: DataFrame, known: DataFrame) -> DataFrame:
    """new results (fixture_id, home_goals, away_goals, completed_at, kickoff_date, corrects, reason) with the first rule
    that refuses each, or null. known: active results (fixture_id, entry_hash) and all entries' hashes."""
    active = known.select("fixture_id", F.col("entry_hash").alias("active_hash"))
    met = results.join(active, "fixture_id", "left")
    target = known.select(F.col("entry_hash").alias("corrects"), F.col("fixture_id").alias("target_fixture"))
    met = met.join(target, "corrects", "left")
    completed = F.col("completed_at").try_cast("timestamp")
    reason = (
        F.when((F.col("home_goals") < 0) | (F.col("away_goals") < 0), "negative_goals")
        .when(completed.isNull(), "unparseable_completed_at")
        .when(completed.cast("date") < F.col("kickoff_date"), "completed_before_kickoff")
        .when(F.col("active_hash").isNotNull() & F.col("corrects").isNull(), "result_exists")
        .when(F.col("corrects").isNotNull() & (F.coalesce("reason", F.lit("")) == ""), "correction_without_reason")
        .when(F.col("corrects").isNotNull() & F.col("target_fixture").isNull(), "unknown_target")
        .when(F.col("target_fixture") != F.col("fixture_id"), "other_fixture")
        .when(F.col("corrects").isNotNull() & (F.col("corrects") != F.col("active_hash")), "not_the_active_result")
    )
    return met.select(*results.columns, reason.alias("refused"))


def accept(checked: DataFrame) -> DataFrame:
    if rows := checked.where("refused is not null").limit(5).collect():
        raise DataError(f"results refused: {[(r['fixture_id'], r['refused']) for r in rows]}")
    return checked.drop("refused")


def find_by_prefix(log: DataFrame, prefix: str) -> DataFrame:
    """The entry whose hash or fixture starts with the prefix, if it is the only one; else none."""
    hits = log.where(F.col("entry_hash").startswith(prefix) | F.get_json_object("payload", "$.fixture_id").startswith(prefix))
    return hits.withColumn("n_", F.count("*").over(Window.partitionBy())).where("n_ = 1").drop("n_")
