"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

Sizes are counted once. Every source gets a target: its weight's share of all words, stopped at `cap` times its
own size, with the excess reshared by weight (the level is solved in closed form over the sorted stops). A source's
house is its target in blocks of equal size; the source's shards, by hash of their documents, are the parties, with
their words as votes v: the house's blocks go to the highest quotients v / 1, v / 3, v / 5, ... and exactly as many
as the house has. Only contested blocks are ever compared: a party surely gets floor(v (H - n/2) / V + 1/2) of the H
blocks of n parties with V votes, and never more than floor(v (H + n/2) / V + 1/2), which leaves about two quotients
a party to rank, and they are ranked in bins. Inside a shard the documents lie in a seeded order, the quota's whole
rounds repeat the shard and its remaining blocks are the first ones of that order, so at most one document per shard
is cut. Shards are sized by words, so a source with a third of all rows is many shards.

Defined cases: null or wordless texts have size 0 and taken 0; a null source is a source of its own and sorts
last; null and repeated doc_ids are told apart by their texts; rows of one doc_id and text are separate documents in
one shard; an empty table gives an empty result; extra columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.llm.common import BREAK_CLASS, WORD_BREAKS, settle

WEIGHTS = (5.0, 2.0, 1.0)


def word_count(text: Column) -> Column:
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WORD_BREAKS))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, f"{BREAK_CLASS}+"))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """source, source_no (by code point, null last), source_size, target: one row per source, which is all the windows see."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("source_no", F.row_number().over(order))
    pick = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("source_no") - 1, F.lit(len(weights))).cast("int") + 1)
    sources = sources.withColumn("weight", pick).withColumn("stop", F.col("source_size") * F.lit(cap))
    rising = Window.orderBy(F.col("stop") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = F.sum("source_size").over(every) - F.coalesce(F.sum("stop").over(before), F.lit(0.0))
    level = free / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    sources = sources.withColumn("level", level).withColumn("nth", F.row_number().over(rising))
    # The first row whose stop is at or above its own level sets the level; levels rise along the rows before it.
    first = F.min(F.when(F.col("stop") / F.col("weight") >= F.col("level"), F.struct("nth", "level"))).over(every)
    target = F.least(F.col("stop"), F.coalesce(first["level"], F.lit(float("inf"))) * F.col("weight"))
    return sources.select("source", "source_no", "source_size", target.alias("target"))


def shard_quotas(parties: DataFrame) -> DataFrame:
    """source_no, shard, blocks: of each source's `house` blocks, those its shards (with `held` votes each) get by
    highest quotients; of equal ones the lower shard's come first."""
    votes = parties.where("held > 0 and house > 0")
    sums = votes.groupBy("source_no").agg(F.sum("held").alias("votes"), F.count("*").alias("parties"))
    rows = votes.join(sums, "source_no")
    share = lambda seats: F.col("held") * seats / F.col("votes") + 0.5
    sure = F.greatest(F.lit(0), F.floor(share(F.col("house") - F.col("parties") / 2) - 1e-6)).cast("long")
    most = F.floor(share(F.col("house") + F.col("parties") / 2) + 1e-6).cast("long")
    rows = settle(rows.select("source_no", "shard", "house", "held", "votes", sure.alias("sure"), most.alias("most")), "parties")
    left = rows.groupBy("source_no").agg((F.max("house") - F.sum("sure")).alias("left"))
    seats = rows.where("most > sure").select("source_no", "shard", "held", "votes", "house", F.explode(F.sequence(F.col("sure") + 1, F.col("most"))).alias("seat"))
    # The inverse quotient, scaled to be about 1 where the last block goes: low ones first. Bins are ranked by their counts.
    inverse = (2 * F.col("seat") - 1) / F.col("held")
    seats = seats.select("source_no", "shard", inverse.alias("inverse"), F.floor(inverse * F.col("votes") / F.col("house") * (1 << 19)).alias("bin"))
    bins = seats.groupBy("source_no", "bin").agg(F.count("*").alias("n"))
    bins = bins.withColumn("before", F.sum("n").over(Window.partitionBy("source_no").orderBy("bin")) - F.col("n")).join(left, "source_no").where("before < left")
    place = F.col("before") + F.row_number().over(Window.partitionBy("source_no", "bin").orderBy("inverse", "shard"))
    won = seats.join(bins, ["source_no", "bin"]).withColumn("place", place).where("place <= left").groupBy("source_no", "shard").agg(F.count("*").alias("won"))
    return rows.join(won, ["source_no", "shard"], "left").select("source_no", "shard", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("blocks"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = 3, shard_words: int = 250_000, seed: int = 17) -> DataFrame:
    """doc_id, mark (of the text), size, source, source_size, target, taken, rounds, part: words taken, as whole rounds
    and a leading part."""
    sizes = settle(docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), word_count(F.col("text")).alias("size")), "sizes")
    targets = settle(source_targets(sizes, weights, float(cap)), "targets")
    least = targets.where("target > 0").agg(F.min("target")).first()[0]
    block = max(1, min(256, int((least or 0) // 256)))  # even the smallest source gets some 256 blocks
    named = targets.select(F.col("source").alias("source_"), "source_no", "source_size", "target", F.round(F.col("target") / block).cast("long").alias("house"))
    rows = sizes.join(named, sizes["source"].eqNullSafe(named["source_"])).drop("source_")
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))
    rows = rows.withColumn("lot", F.xxhash64(F.lit(seed), "doc_id", "mark")).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "mark"), shards))
    quotas = shard_quotas(rows.groupBy("source_no", "shard").agg(F.sum("size").alias("held"), F.max("house").alias("house")))
    shard = Window.partitionBy("source_no", "shard")
    held = F.sum("size").over(shard).alias("held")
    before = (F.sum("size").over(shard.orderBy("lot", "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("before")
    rows = rows.select("*", held, before).join(quotas, ["source_no", "shard"], "left")
    quota = F.least(F.coalesce("blocks", F.lit(0)) * block, F.col("held") * cap)
    rows = rows.withColumn("quota", quota.cast("long"))
    rows = rows.withColumn("rounds", F.when(F.col("held") > 0, F.floor(F.col("quota") / F.greatest("held", F.lit(1)))).otherwise(F.lit(0)).cast("long"))
    left = F.col("quota") - F.col("rounds") * F.col("held")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("before"))).cast("long"))
    return rows.select("doc_id", "mark", "size", "source", "source_size", "target", (F.col("rounds") * F.col("size") + F.col("part")).alias("taken"), "rounds", "part")


def apply_mix(docs: DataFrame, mix: DataFrame) -> DataFrame:
    """docs with every document as often, and as far, as the mix takes it: whole copies, then one of its leading words.
    Rows of one doc_id, source and text share a decision."""
    per_row = mix.groupBy("doc_id", "source", "mark").agg(F.max("size").alias("size"), F.max("rounds").alias("rounds"), F.max("part").alias("part"))
    sized = docs.select(F.xxhash64("text").alias("own"), F.struct(*docs.columns).alias("row"))  # whatever docs' columns are called
    met = sized.join(per_row, F.col("row.doc_id").eqNullSafe(per_row["doc_id"]) & F.col("row.source").eqNullSafe(per_row["source"]) & (F.col("own") == F.col("mark")))
    whole = F.col("rounds") + F.when((F.col("part") == F.col("size")) & (F.col("size") > 0), 1).otherwise(0)
    cut = F.when((F.col("part") > 0) & (F.col("part") < F.col("size")), F.col("part")).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<long>")))
    out = met.select("row", F.explode(copies).alias("take"))
    words = F.split(F.btrim("row.text", F.lit(WORD_BREAKS)), f"{BREAK_CLASS}+")
    text = F.when(F.col("take") == 0, F.col("row.text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("take").cast("int")), " "))
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("take") == 0, F.col("row.n_chars")).otherwise(F.length(text))
    return out.select(*[made.get(c, F.col("row")[c]).cast(kind).alias(c) for c, kind in docs.dtypes])
