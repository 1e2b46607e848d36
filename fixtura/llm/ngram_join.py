"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, kept sparse by size bounds.

A document is its set of hashed word n-grams; documents of equal sets are one class with its smallest doc_id as
representative. Two sets of sizes m <= n can reach the threshold only if m >= t n and if they differ in at most
(m + n)(1 - t)/(1 + t) n-grams; both bounds follow from sizes alone and decide which cells of the product are
ever looked at:

* Sets from `small` n-grams on: their n-grams are dealt by hash into more parts than a pair may differ in, so a
  pair that links has a non-empty part in common, whole. Parts are counted per size bucket, and a set takes part
  in its own bucket and the next smaller one. Columns of the product are these parts: about five n-grams each,
  so unrelated texts, shared lines and frequent phrases hardly ever meet. A set whose parts can't give the
  guarantee (its hashes are very uneven: one in some 10,000 small sets) takes part with its n-grams dealt in
  further ways, until one gives it. Sets that none of TRIES ways helps are compared with each other.
* Smaller sets: with n-grams in the order of rising frequency, a pair that links shares one among the first
  n - ceil(t n) + 1 of each; columns are those n-grams.

Columns are dealt to blocks as packed arrays. Before that a task joins equal columns of its own: it sends one
entry per column, so a column of a third of all texts arrives once per task. In each column one member, the hub that
shares most columns, is first compared with the others: links found so connect nearly all of any group of near
copies. Then, exactly, come the pairs of a column whose members are not all connected. Both members differ from
the hub in known n-grams, and a pair that links must have enough of those in common: that bound again leaves few
pairs, where all pairs of a group that merely resembles its hub would be a square. Comparison is the product
itself: blocks of rows whose n-gram lists are intersected, overlap counts accumulated, and pairs below the bound
o >= t (m + n) / (1 + t) discarded.

Defined cases: null, empty and wordless texts have no n-grams and link with nothing; fewer words than the n-gram
length make one n-gram of them all; repeated rows are one class; rows that share a doc_id are one node; a null
doc_id belongs to its class but is nobody's component_id; an empty table gives an empty result; extra columns
are ignored. N-grams are equal when their 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.llm.common import partitions_for, released, settle, utf8
from fixtura.llm.components import connected_components

MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x94D049BB133111EB)
ENTRY = np.dtype([("column", "<u8"), ("doc", "<i8")])
#: The column of sets whose parts don't give the guarantee.
UNSOUND = 0
#: Bits of the filter of wanted ids (1 MB).
FILTER_BITS = 1 << 23
#: Pairs, of 20 bytes, that are broadcast to their sets; more are dealt by document.
FEW_PAIRS = 100_000
#: Columns of up to so many members are looked at pair by pair.
FEW = 16
#: Entries a task holds before it joins its equal columns and sends them on.
HELD = 250_000
#: Entries of a piece of a task's list of shared columns.
LISTED = 4_096
#: Ways to deal a set's n-grams to parts that are tried until one gives the guarantee.
TRIES = 4


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MULTIPLIERS[3])
    x = (x ^ (x >> np.uint64(29))) * np.uint64(MULTIPLIERS[4])
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """Hashes of words, computed once each while they are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def ngram_set(text: bytes, n: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct n-grams of the words of text (A-Z lowered)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    if len(words) < n:
        return mixed(np.array([int(sum(int(c) * MULTIPLIERS[i] for i, c in enumerate(codes)) + len(words)) & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))
    grams = np.zeros(len(words) - n + 1, dtype=np.uint64)
    for i in range(n):
        grams += codes[i : len(words) - n + 1 + i] * np.uint64(MULTIPLIERS[i])
    return np.unique(mixed(grams))


class Sizes:
    """What sizes alone say, for pairs that link when 100 |A and B| >= percent |A or B|."""

    def __init__(self, percent: int, small: int) -> None:
        self.percent, self.small = percent, small
        self.lows = [small]
        while self.lows[-1] < 1 << 40:
            self.lows.append(self.lows[-1] * 100 // percent + 1)

    def bucket(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def most_apart(self, m: int, n: int) -> int:
        """How many n-grams two linked sets of these sizes may differ in."""
        return (m + n) * (100 - self.percent) // (100 + self.percent)

    def parts(self, bucket: int) -> int:
        high = self.lows[bucket + 1] - 1
        return (self.most_apart(high, high * 100 // self.percent) + 1) * 11 // 10 + 3

    def schemes(self, n: int) -> list[tuple[int, int]]:
        """(bucket of the smaller set, most n-grams apart) of the pairs a set of n can be in."""
        own = self.bucket(n)
        found = [(own, self.most_apart(n, n * 100 // self.percent))]
        return found if own == 0 else [*found, (own - 1, self.most_apart(n, self.lows[own] - 1))]


def set_rows(n: int, list_below: int):
    """doc_id, size and digest of each set; the n-grams too of the smaller ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [ngram_set(t, n, hashes) for t in batch.column(1).to_pylist()]
            prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            grams = [s.view(np.int64).tolist() if 0 < len(s) < list_below else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.binary()), pa.array(grams, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "grams"])

    return run


def columns_of(grams: np.ndarray, sizes: Sizes, way: int = 0) -> tuple[np.ndarray, bool]:
    """The columns a set has entries in when its n-grams are dealt that way, and whether they give the guarantee."""
    found, sound = [], True
    spread, weight = mixed(grams ^ np.uint64(MULTIPLIERS[5] ^ way << 20)), mixed(grams ^ np.uint64(MULTIPLIERS[6] ^ way << 20))
    for bucket, apart in sizes.schemes(len(grams)):
        parts = sizes.parts(bucket)
        part = (spread % np.uint64(parts)).astype(np.int64)
        sums = np.zeros(parts, dtype=np.uint64)
        np.add.at(sums, part, weight)
        filled = np.flatnonzero(np.bincount(part, minlength=parts))
        sound &= len(filled) > apart
        found.append(mixed(sums[filled] ^ mixed((filled + (bucket << 40)).astype(np.uint64))))
    return np.concatenate(found), sound


def all_columns(grams: np.ndarray, sizes: Sizes) -> np.ndarray:
    """The columns of a set: those of the first way that gives the guarantee and of all before it, which every set
    that needed no more ways has too; UNSOUND besides if none of TRIES ways does. A pair that links shares a column of
    a way that is sound for either set, so only two sets that have UNSOUND must be compared whatever they share."""
    found = []
    for way in range(TRIES):
        columns, sound = columns_of(grams, sizes, way)
        found.append(columns)
        if sound:
            break
    else:
        found.append(np.array([UNSOUND], dtype=np.uint64))
    return np.concatenate(found)


def column_entries(n: int, sizes: Sizes, blocks: int):
    """Packed (column, doc) entries by block; of a task's equal columns the least doc goes to the block and all go to a list (block < 0), which needn't meet."""

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(held)
        every = every[np.lexsort((every["doc"], every["column"]))]
        new = np.concatenate([[True], every["column"][1:] != every["column"][:-1]])
        shared = ~new | (every["column"] == UNSOUND)
        shared[:-1] |= ~new[1:]
        first = every[new]
        block = (first["column"] % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        first, block = first[order], block[order]
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))  # the blocks that have entries, however many there are
        rows = [(int(block[a]), first[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        # A list's columns are known to be shared and meet nobody: lists are spread by their content, a frequent column with them.
        listed = every[shared]
        for i in range(0, len(listed), LISTED):
            part = listed[i : i + LISTED]
            rows.append((-1 - int(mixed(part["doc"][:1].view(np.uint64) + part["column"][-1:])[0] % np.uint64(blocks)), part.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, seen = WordHashes(), [], 0, set()
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = ngram_set(text, n, hashes)
                if len(grams) < sizes.small or doc is None:
                    continue
                own = hashlib.blake2b(grams.tobytes(), digest_size=16).digest()
                if own in seen:  # its class has sent these columns
                    continue
                seen.add(own)
                columns = all_columns(grams, sizes)
                entries = np.empty(len(columns), ENTRY)
                entries["column"], entries["doc"] = columns, doc
                held.append(entries)
                size += len(entries)
                if size > HELD:
                    yield from send(held)
                    held, size, seen = [], 0, set()
        if held:
            yield from send(held)

    return run


def shared_columns(block, table):
    """The entries of columns with two documents or more."""
    every = np.concatenate([np.frombuffer(b, ENTRY) for b in table.column("entries").to_pylist()])
    if block[0].as_py() >= 0:  # lists hold shared columns only
        every = every[np.argsort(every["column"], kind="stable")]
        same = every["column"][1:] == every["column"][:-1]
        keep = np.zeros(len(every), dtype=bool)
        keep[1:] |= same
        keep[:-1] |= same
        every = every[keep]
    return pa.table({"column": pa.array(every["column"].view(np.int64)), "doc_id": pa.array(every["doc"])})


def sketch(grams: np.ndarray) -> bytes:
    """How many n-grams fall in each of 256 hash bins (255: or more): two sets share at most the sum of the minima."""
    return np.minimum(np.bincount((mixed(grams) >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def id_bits(ids: np.ndarray) -> np.ndarray:
    """Two bits of each id in a filter of fixed size."""
    hashed = mixed(ids.view(np.uint64) + np.uint64(MULTIPLIERS[7]))
    return np.concatenate([hashed & np.uint64(FILTER_BITS - 1), hashed >> np.uint64(32) & np.uint64(FILTER_BITS - 1)]).astype(np.int64)


def filter_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits, any_id = np.zeros(FILTER_BITS, dtype=bool), False
    for batch in batches:
        bits[id_bits(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))] = any_id = True
    rows = [np.packbits(bits).tobytes()] if any_id else []
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["bits"])


def filter_union(lane, table):
    every = [np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]
    return pa.table({"bits": pa.array([np.bitwise_or.reduce(every).tobytes()], pa.binary())})


def id_filter(ids: DataFrame) -> bytes:
    """A filter of FILTER_BITS bits over ids, however many: what it lets through is a superset, so it only saves work."""
    parts = ids.mapInArrow(released(filter_parts), "bits binary").withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(16)))
    rows = parts.groupBy("lane").applyInArrow(released(filter_union), "bits binary").collect()  # 16 rows of FILTER_BITS bits
    return np.bitwise_or.reduce([np.frombuffer(r["bits"], np.uint8) for r in rows]).tobytes() if rows else b""


def passed(bits: bytes):
    """Rows whose doc_id the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = id_bits(ids)
            keep = table[at[: len(ids)]] & table[at[len(ids) :]] if len(table) else np.zeros(len(ids), bool)
            yield batch.filter(pa.array(keep))

    return run


def set_blobs(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [ngram_set(t, n, hashes) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([sketch(s) for s in sets], pa.binary()), pa.array(map(len, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "grams", "sketch", "n"])

    return run


def likely(percent: int):
    """Pairs whose sketches leave room for the overlap that a link needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 256) for k in (2, 3))
            sizes = batch.column(4).to_numpy() + batch.column(5).to_numpy()
            room = np.minimum(a, b).sum(axis=1, dtype=np.int64)
            full = (a == 255).any(axis=1) | (b == 255).any(axis=1)
            keep = full | ((100 + percent) * room >= percent * sizes)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1, 5)], names=["a", "b", "n"])

    return run


def multiply(percent: int):
    """Per block: overlap counts of each first row with its other rows; pairs that reach the threshold."""

    def run(block, table):
        first: dict[tuple[int, int], list[np.ndarray]] = {}
        other: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for a, lane, doc, grams in zip(*(table.column(c).to_pylist() for c in ("a", "lane", "doc_id", "grams")), strict=True):
            own = np.frombuffer(grams, np.uint64)
            if doc == a:
                first.setdefault((a, lane), []).append(own)
            else:
                other.setdefault((a, lane), []).append((doc, own))
        links = []
        for key, rows in other.items():
            sizes = np.array([len(r) for _, r in rows])
            cells = np.concatenate([r for _, r in rows])
            starts = np.cumsum(sizes) - sizes
            for own in first.get(key, []):
                hit = np.searchsorted(own, cells)
                hit[hit == len(own)] = 0
                overlap = np.add.reduceat((own[hit] == cells).astype(np.int64), starts)
                links += [(key[0], rows[i][0]) for i in np.flatnonzero((100 + percent) * overlap >= percent * (len(own) + sizes))]
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


#: The place of a row of deltas() that is a link already.
LINK = -1
GRAMS = "hub long, gram long, place long, rep long, n long, apart long"


def prefix(hub: np.ndarray, own: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, int]:
    """The n-grams in which own differs from its hub that a linked pair must meet in, and how many differ at all."""
    differ = np.concatenate([np.setdiff1d(own, hub, assume_unique=True), np.setdiff1d(hub, own, assume_unique=True)])
    apart, n, m = len(differ), len(own), len(hub)
    if apart <= sizes.most_apart(n, m):
        slack = -(-max(0, n - m) * (100 - sizes.percent) // (100 + sizes.percent)) + 1
        least = max(1, -(-(apart - slack) // 2))
    else:
        least = max(1, apart - sizes.most_apart(n, n * 100 // sizes.percent))
    return differ[: max(0, apart - least + 1)], apart


def links_around(sets: list[np.ndarray], component: np.ndarray, prefixes: list[np.ndarray], apart: np.ndarray, sizes: Sizes) -> list[tuple[int, int]]:
    """Pairs of a hub's rows, of different components, that reach the threshold: the product over shared n-grams of
    their prefixes, then over their sets."""
    lengths = np.array([len(p) for p in prefixes])
    grams, row = np.concatenate(prefixes), np.repeat(np.arange(len(prefixes)), lengths)
    place = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(grams, kind="stable")
    grams, row, place = grams[order], row[order], place[order]
    n = np.array([len(s) for s in sets])
    cuts = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1], [True]])) if len(grams) else np.zeros(1, int)
    found: set[int] = set()
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a < 2 or (component[row[a:b]] == component[row[a]]).all():
            continue
        for i in range(a, b - 1):  # one row of the column's product at a time
            x, y = row[i], row[i + 1 : b]
            most = (n[x] + n[y]) * (100 - sizes.percent) // (100 + sizes.percent)
            rest = np.minimum(apart[x] - place[i], apart[y] - place[i + 1 : b])
            keep = (component[y] != component[x]) & (np.abs(apart[x] - apart[y]) <= most) & (2 * rest >= apart[x] + apart[y] - most) & (100 * np.minimum(n[x], n[y]) >= sizes.percent * np.maximum(n[x], n[y]))
            found.update((np.minimum(x, y[keep]) * len(sets) + np.maximum(x, y[keep])).tolist())
    pairs = [divmod(k, len(sets)) for k in sorted(found)]
    overlap = lambda i, j: len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    return [(i, j) for i, j in pairs if (100 + sizes.percent) * overlap(i, j) >= sizes.percent * (n[i] + n[j])]


def deltas(sizes: Sizes):
    """Per block, the rows of each hub: their links, if all of them are here; else how each differs from the hub, as the
    n-grams that a linked pair must have in common.

    With D(x) the n-grams in which x and the hub differ, x and y differ in |D(x)| + |D(y)| - 2 |D(x) and D(y)|. If
    they link but not both through the hub, that leaves a least number of common members of D(x) and D(y); so, in
    one order of n-grams (those not in the hub first), they share one of the first |D| - least + 1 of each."""

    def run(block, table):
        first: dict[tuple[int, int], bytes] = {}
        groups: dict[tuple[int, int], list[tuple]] = {}
        for a, lanes, lane, doc, component, grams in zip(*(table.column(c).to_pylist() for c in ("a", "lanes", "lane", "doc_id", "component", "grams")), strict=True):
            if doc == a:
                first[a, lane] = min(first.get((a, lane), grams), grams)
            else:
                groups.setdefault((a, lane), []).append((lanes, doc, component, np.frombuffer(grams, np.uint64)))
        out: list[tuple[np.ndarray, ...]] = []
        for (a, lane), rows in groups.items():
            hub = np.frombuffer(first[a, lane], np.uint64)
            made = [prefix(hub, own, sizes) for *_, own in rows]
            if rows[0][0] == 1:
                apart = np.array([x for _, x in made])
                found = links_around([r[3] for r in rows], np.array([r[2] for r in rows]), [p for p, _ in made], apart, sizes)
                out += [tuple(np.array([v], np.int64) for v in (rows[i][1], 0, LINK, rows[j][1], 0, 0)) for i, j in found]
                continue
            for (_, doc, _, own), (keep, apart) in zip(rows, made, strict=True):
                same = lambda x, k=len(keep): np.full(k, x, np.int64)
                out.append((same(a), keep.view(np.int64), np.arange(len(keep)), same(doc), same(len(own)), same(apart)))
        names = [c.split()[0] for c in GRAMS.split(", ")]
        return pa.table({name: pa.array(np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64), pa.int64()) for k, name in enumerate(names)})

    return run


def fits(a: str, b: str, percent: int) -> Column:
    return (F.least(a, b) * 100) >= (F.greatest(a, b) * percent)


def in_blocks(pairs: DataFrame, sets: DataFrame, block_grams: int = 600_000) -> DataFrame:
    """The sets of pairs (a, b, n) by block, each a with all its b; n is the size of b's set. Blocks hold about
    block_grams n-grams, and an a whose b have more than half of that is dealt in lanes."""
    pairs = settle(pairs, "pairs")
    counted = pairs.agg(F.sum("n").alias("total"), F.count("*").alias("pairs")).first()
    total = counted["total"] or 0
    lanes = pairs.groupBy("a").agg(F.ceil(F.sum("n") / (block_grams / 2)).cast("int").alias("lanes"))
    component = F.col("component") if "component" in pairs.columns else F.lit(None).cast("long")
    others = pairs.join(lanes, "a").select("a", "lanes", F.pmod(F.xxhash64("b"), F.col("lanes")).cast("int").alias("lane"), F.col("b").alias("doc_id"), component.alias("component"))
    firsts = lanes.select("a", "lanes", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.col("a").alias("doc_id"), F.lit(None).cast("long").alias("component"))
    rows = others.union(firsts)
    if counted["pairs"] <= FEW_PAIRS:  # then the sets, far larger, stay where they are
        rows = F.broadcast(rows)
    rows = sets.select("doc_id", "grams").join(rows, "doc_id")
    return rows.withColumn("block", F.pmod(F.xxhash64("a", "lane"), F.lit(partitions_for(1.5 * total, block_grams, 1))))


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold: sketches first, then the sets of what they leave."""
    side = lambda s: sets.select(F.col("doc_id").alias(s), F.col("sketch").alias(f"sketch_{s}"), F.col("n").alias(f"n_{s}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b")
    left = met.mapInArrow(released(likely(percent)), "a long, b long, n long").groupBy("a", "b").agg(F.max("n").alias("n"))
    return in_blocks(left, sets).groupBy("block").applyInArrow(released(multiply(percent)), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, n: int = 4, percent: int = 85, small: int = 100, block_entries: int = 600_000) -> DataFrame:
    """doc_id, n_shingles, component_id, n_class of every document (n_class: documents of an equal set)."""
    sizes = Sizes(percent, small)
    limit = small * 100 // percent + 1
    rows = docs.select("doc_id", utf8(F.col("text")).alias("body"))
    sets = settle(rows.mapInArrow(released(set_rows(n, limit)), "doc_id long, n_shingles long, print binary, grams array<long>"), "sets")
    classes = sets.where("n_shingles > 0").groupBy("print", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_class"))
    member = settle(sets.select("doc_id", "n_shingles", "print").join(classes.drop("n_shingles"), "print", "left"), "members")
    total = sets.agg(F.sum("n_shingles")).first()[0] or 0
    node = member.where("rep is not null and doc_id is not null").select("doc_id", "rep", "n_shingles")

    # Columns of the larger sets.
    blocks = partitions_for(0.4 * total, block_entries, 1)
    packed = rows.mapInArrow(released(column_entries(n, sizes, blocks)), "block long, entries binary")
    shared = packed.groupBy("block").applyInArrow(released(shared_columns), "column long, doc_id long")
    large = shared.join(node, "doc_id").select("column", "rep", "n_shingles")

    # Columns of the smaller sets: their rarest n-grams.
    one = sets.where("grams is not null").join(classes.select(F.col("rep").alias("doc_id"), "print"), ["doc_id", "print"]).dropDuplicates(["doc_id", "print"])
    cells = one.select(F.col("doc_id").alias("rep"), "n_shingles", F.explode("grams").alias("column"))
    often = cells.groupBy("column").agg(F.count("*").alias("often")).where("often > 1")
    ranked = cells.join(often, "column", "left").withColumn("nth", F.row_number().over(Window.partitionBy("rep", "n_shingles").orderBy(F.coalesce("often", F.lit(1)), "column")))
    prefix = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    rare = ranked.where((F.col("nth") <= prefix) & F.col("often").isNotNull()).select("column", "rep", "n_shingles")
    every = settle(large.union(rare).distinct(), "columns")
    columns = every.where(F.col("column") != UNSOUND)

    # First the member of each column that shares most columns, the one with the fewest changes, with the others.
    shares = columns.groupBy("rep").agg(F.count("*").alias("shares"))
    columns = settle(columns.join(shares, "rep"), "shared")
    hub = columns.groupBy("column").agg(F.max(F.struct("shares", "rep", "n_shingles")).alias("hub"))
    stars = columns.join(hub, "column").where((F.col("rep") != F.col("hub.rep")) & fits("n_shingles", "hub.n_shingles", percent)).select(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).distinct()
    more = unsound_pairs(every.where(F.col("column") == UNSOUND), sizes)
    wanted = columns.select(F.col("rep").alias("doc_id")).distinct()
    wanted = wanted if more is None else wanted.union(more.select(F.explode(F.array("a", "b")))).distinct()
    wanted = settle(wanted, "wanted")
    some = rows.mapInArrow(released(passed(id_filter(wanted))), rows.schema)
    blobs = settle(some.join(wanted, "doc_id", "left_semi").mapInArrow(released(set_blobs(n)), "doc_id long, grams binary, sketch binary, n long"), "blobs")
    stars = settle(stars if more is None else stars.union(more).distinct(), "stars")
    twice = node.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    found = connected_components(settle(linked(stars, blobs, percent).union(twice), "links"))

    # Then every pair of a column that is not all one component: by how its members differ from its hub.
    placed = columns.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_columns = placed.groupBy("column").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo < hi").select("column", "members")
    opened = settle(placed.join(open_columns, "column"), "open")
    pair = lambda df, keys, names: [df.select(*keys, *[F.col(c).alias(f"{c}_{s}") for c in names]) for s in "xy"]
    x, y = pair(opened.where(F.col("members") <= FEW), ["column"], ["rep", "n_shingles", "component"])
    few = x.join(y, "column").where((F.col("component_x") < F.col("component_y")) & fits("n_shingles_x", "n_shingles_y", percent)).select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b"))

    around = opened.where(F.col("members") > FEW).select("column", "rep", "n_shingles", "component").join(hub, "column").where("rep <> hub.rep")
    around = around.groupBy(F.col("hub.rep").alias("a"), F.col("rep").alias("b")).agg(F.max("n_shingles").alias("n"), F.max("component").alias("component"))
    told = settle(in_blocks(around, blobs).groupBy("block").applyInArrow(released(deltas(sizes)), GRAMS), "deltas")
    direct = told.where(F.col("place") == LINK).select(F.col("hub").alias("a"), F.col("rep").alias("b"))
    grams = told.where(F.col("place") != LINK).join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed_grams = grams.groupBy("hub", "gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("hub", "gram")
    x, y = pair(grams.join(mixed_grams, ["hub", "gram"]), ["hub", "gram"], ["rep", "n", "apart", "place", "component"])
    # A pair that links has a first common n-gram, and what is left from there on in both must suffice.
    most_apart = F.floor((F.col("n_x") + F.col("n_y")) * (100 - percent) / (100 + percent))
    rest = F.least(F.col("apart_x") - F.col("place_x"), F.col("apart_y") - F.col("place_y"))
    near = (F.abs(F.col("apart_x") - F.col("apart_y")) <= most_apart) & (2 * rest >= F.col("apart_x") + F.col("apart_y") - most_apart)
    cross = x.join(y, ["hub", "gram"]).where((F.col("component_x") < F.col("component_y")) & fits("n_x", "n_y", percent) & near)
    cross = cross.select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b")).union(few).distinct()
    late = settle(linked(cross, blobs, percent).union(direct).distinct(), "late")
    of = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"{side}_of"))
    bridges = late.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
    joined = connected_components(bridges)

    whole = member.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    whole = whole.join(joined.select(F.col("node").alias("component"), F.col("component").alias("joined")), "component", "left")
    return whole.select("doc_id", "n_shingles", F.coalesce("joined", "component", "doc_id").alias("component_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"))


def unsound_pairs(weak: DataFrame, sizes: Sizes) -> DataFrame | None:
    """Pairs of fitting size of the sets without the guarantee; None where there are none, as good as always."""
    if weak.limit(1).count() == 0:
        return None
    low = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(100 / sizes.percent)))
    reps = weak.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), low.alias("level")).distinct()
    near = weak.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.explode(F.sequence(low - 1, low + 1)).alias("level")).distinct()
    return near.join(reps, "level").where((F.col("a") != F.col("b")) & fits("n_a", "n_b", sizes.percent)).select("a", "b").distinct()


def drop_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, **options) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each component; rows without an id stay."""
    found = jaccard_components(docs, n=n, percent=percent, **options)
    gone = found.where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
