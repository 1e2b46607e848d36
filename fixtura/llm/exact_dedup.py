"""Exact dedup by composable polynomial fingerprints.

A text (A-Z lowered, UTF-8) is cut into chunks; each chunk's polynomial hash is independent of the others and
two neighbours combine as h(xy) = h(x) * base**len(y) + h(y), so a huge text needs one chunk in memory at a
time and chunks may be hashed in any order. Texts of equal fingerprint are then compared with the row that
stays, chunk by chunk; one that differs is set apart by its SHA-256.

Defined cases: a null text counts as empty; empty texts form one group; a null doc_id takes part but is never
the smallest or largest id; of rows repeated with one doc_id and one text exactly one has kept = true; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.llm.common import ascii_lower, released, settle, utf8

CHUNK = 1 << 16
#: A Mersenne prime with two bases; a chunk's sum of 255 * prime * CHUNK stays below 2**63.
FIELDS = (((1 << 31) - 1, 1_103_515_245), ((1 << 31) - 1, 1_664_525_017))
#: Rows of a group that are compared with one copy of the row that stays.
FAN = 512


def power_table(prime: int, base: int) -> np.ndarray:
    """base**(CHUNK-1) ... base**0 modulo prime."""
    out = np.ones(1, dtype=np.int64)
    while len(out) < CHUNK:
        out = np.concatenate([out * pow(base, len(out), prime) % prime, out])
    return out[-CHUNK:]


def combine(left: tuple[int, int], right: tuple[int, int], prime: int, base: int) -> tuple[int, int]:
    """(hash, length) of two neighbours as one."""
    return (left[0] * pow(base, right[1], prime) + right[0]) % prime, left[1] + right[1]


def fingerprint(data: bytes, tables: list[np.ndarray]) -> list[int]:
    sums = [(0, 0)] * len(FIELDS)
    for at in range(0, len(data), CHUNK):
        part = np.frombuffer(data, dtype=np.uint8, count=min(CHUNK, len(data) - at), offset=at).astype(np.int64)
        for k, (prime, base) in enumerate(FIELDS):
            own = (int(np.dot(part, tables[k][CHUNK - len(part) :])) % prime, len(part))
            sums[k] = combine(sums[k], own, prime, base)
    return [h for h, _ in sums]


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables = [power_table(*f) for f in FIELDS]
    for batch in batches:
        texts = [x.lower() for x in batch.column(1).to_pylist()]
        prints = [fingerprint(x, tables) for x in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *(pa.array([p[k] for p in prints], pa.int64()) for k in range(len(FIELDS))),
                pa.array([len(x) for x in texts], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
            ],
            names=["doc_id", "fp_a", "fp_b", "n_bytes", "text_sha256"],
        )


PRINT = ["fp_a", "fp_b", "n_bytes"]
#: Groups of more than one row in so many are met by broadcast: there are at most as many such groups.
HOT = 10_000


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows joined to their groups (with group_size) by keys. A large group's rows stay where they are: of total rows,
    at most HOT groups have more than one in HOT, so these are broadcast; the rest is dealt, and no key of it is hot."""
    most = max(FAN, total // HOT)
    large = F.broadcast(groups.where(F.col("group_size") > most))
    dealt = rows.join(large.select(*keys), keys, "left_anti").join(groups.where(F.col("group_size") <= most), keys)
    return rows.join(large, keys).unionByName(dealt)


def differing(docs: DataFrame, digests: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Rows (doc_id, text_sha256) whose text differs from that of the row that stays though the fingerprints agree."""
    many = groups.where("group_size > 1").select(*PRINT, "keep_id", "group_size")
    members = with_groups(digests.where("doc_id is not null"), many, PRINT, total).distinct()
    body = ascii_lower(F.coalesce("text", F.lit(""))).cast("binary")
    text = docs.select("doc_id", body.alias("body"), F.sha2(body, 256).alias("text_sha256"))
    texts = settle(text.join(members, ["doc_id", "text_sha256"]), "copies")
    lanes = F.floor((F.col("group_size") - 1) / FAN).cast("int")
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor(F.length("body") / CHUNK).cast("int")),
        lambda i: F.struct(i.alias("no"), F.substring("body", i * CHUNK + 1, F.lit(CHUNK)).alias("part")),
    )
    lane = F.pmod(F.xxhash64("doc_id"), lanes + 1).cast("int").alias("lane")
    own = texts.where("doc_id <> keep_id").select("doc_id", "text_sha256", *PRINT, "keep_id", lane, F.explode(chunks).alias("c"))
    stays = texts.where("doc_id = keep_id").dropDuplicates([*PRINT, "keep_id"])
    stays = stays.select(*PRINT, "keep_id", F.explode(F.sequence(F.lit(0), lanes)).alias("lane"), "body")
    stays = stays.select(*PRINT, "keep_id", "lane", F.explode(chunks).alias("c"))
    keys = [*PRINT, "keep_id", "lane", "no"]
    pairs = own.select("*", F.col("c.no").alias("no"), F.col("c.part").alias("own")).join(stays.select("*", F.col("c.no").alias("no"), F.col("c.part").alias("stays")).drop("c"), keys)
    return pairs.where("own <> stays").select("doc_id", "text_sha256").distinct()


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (largest doc_id of equal texts stays)."""
    source = docs.select("doc_id", utf8(F.col("text")).alias("body"))
    digests = settle(source.mapInArrow(released(_digest), "doc_id long, fp_a long, fp_b long, n_bytes long, text_sha256 string"), "digests")
    total = digests.count()
    whole = settle(digests.groupBy(*PRINT).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    apart = differing(docs, digests, whole, total).withColumn("apart", F.lit(True))
    classed = digests.join(apart, ["doc_id", "text_sha256"], "left").withColumn("class", F.when(F.col("apart"), F.col("text_sha256")).otherwise(F.lit("")))
    classed = settle(classed.drop("apart"), "classed")
    groups = settle(classed.groupBy(*PRINT, "class").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    first = F.row_number().over(Window.partitionBy("doc_id", *PRINT, "class").orderBy("text_sha256")) == 1
    once = classed.withColumn("first", first)
    out = with_groups(once, groups, [*PRINT, "class"], total)
    return out.select("doc_id", "keep_id", "group_size", (F.col("first") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops."""
    key = lambda doc_id, sha: F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), sha)
    kept = exact_dedup(docs).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("dedup_key"))
    own = F.sha2(ascii_lower(F.coalesce("text", F.lit(""))).cast("binary"), 256)
    rows = docs.select(key(F.col("doc_id"), own).alias("dedup_key"), F.struct(*docs.columns).alias("row"))  # whatever docs' columns are called
    return rows.join(kept, "dedup_key", "left_semi").dropDuplicates(["dedup_key"]).select("row.*")
