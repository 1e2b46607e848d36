"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction.

Lengths are integers up to the capacity, so the whole instance is its histogram: at most `capacity` numbers,
whatever the corpus holds. The plan is made on that histogram. Reduction first: for the longest remaining length
the set {longest} (nothing fits beside it), or {longest, k} with k the longest that fits, is fixed for good when
it dominates every other set that holds the longest one: it fills the capacity, no two others fit together, or
at most two others fit and no such two are as long as k. What it can't fix is packed best-fit decreasing. The plan becomes slots
(length, ranks from..to, sequence, offset); each piece finds its slot by its rank among the pieces of its length,
numbered per hash bucket with the buckets' counts added up, so no length is ever gathered in one place.

Defined cases: a null or empty text is one piece, id 0 alone; null and repeated doc_ids are packed row by row; a
very long text is cut into full pieces and a rest; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fixtura.llm.common import partitions_for, released, settle, utf8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Words whose ids are kept from the texts before, in either of two generations (some 25 MB each) and for one task.
KEPT_WORDS = 150_000
#: Bytes of text whose new words are encoded together.
CHUNK = 1 << 18
#: A control character that stands between words while many are encoded at once; words that hold it go one by one.
FENCE = "\x01"
#: ASCII signs after a small letter are tokens of their own: a word that closes with them is the word and the signs.
CLOSED = re.compile(rb"(.*[a-z])([!-/:-@\[-`{-~]+)", re.S)


def byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write bytes as printable characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def splits_letters_from_signs(parts: dict) -> tuple[bool, bool]:
    """(whether A-Z are lowered, whether a small word of letters, and signs after it, reach the merges unchanged and
    apart), as a tokenizer's own description says: it normalises to NFC, white space and lower case only, and splits
    runs of letters, digits and other signs, where no earlier way to split begins with a letter or is signs alone."""
    kinds = [n["type"] for n in (parts.get("normalizer") or {}).get("normalizers", [])]
    steps = (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])
    ways = steps[0].get("pattern", {}).get("Regex", "").split("|") if steps and steps[0]["type"] == "Split" else []
    early = [w for w in ways if not w.startswith("[")]
    plain = set(kinds) <= {"NFC", "Replace", "Lowercase"} and "[\\p{L}]+" in ways and "[^\\s\\p{L}\\p{N}]+" in ways
    plain = plain and all(w[0] == "'" and w[1:].isalpha() for w in early) and [s["type"] for s in steps[1:]] == ["ByteLevel"]
    plain = plain and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and bool(parts["model"].get("end_of_word_suffix"))
    return "Lowercase" in kinds, plain and "Lowercase" in kinds


class WordIds:
    """Ids of words as little-endian 32-bit numbers. Tokens never span white space, so a word is encoded once.

    A word of small letters in normal form needs no normalisation and no splitting: it goes to the merges alone, as
    its bytes' letters (the short way), if the tokenizer's description allows it. Any other word takes the whole
    tokenizer. Added tokens are matched in raw text, case and all: a word that holds one, in any case, goes through
    the whole tokenizer as it was written, neither lower-cased nor split. Words of the last texts are kept in two
    generations: when the younger one is full it becomes the older one, so frequent words are never lost."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        parts = json.loads(Path(path).read_text(encoding="utf-8"))
        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)  # the same model, not a copy
        self.merges.pre_tokenizer = WhitespaceSplit()
        self.letters = byte_letters()
        self.added = [t["content"].encode().lower() for t in parts.get("added_tokens", [])]
        vocabulary, suffix = parts["model"]["vocab"], parts["model"].get("end_of_word_suffix") or "\n"
        self.last = np.zeros(max([*vocabulary.values(), *(t["id"] for t in parts.get("added_tokens", []))]) + 1, dtype=bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith(suffix)]] = True  # tokens that end a word
        self.lower, self.short = splits_letters_from_signs(parts)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def one(self, word: bytes) -> bytes:
        return np.array(self.whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, words: list[bytes], short: bool) -> list[bytes]:
        """The ids of each word. Short ways know a word's end by its last token, the whole tokenizer by a fence."""
        if short:
            text = " ".join([w.decode("latin-1").translate(self.letters) for w in words])
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
            starts = [0, *ends[:-1]]
        else:
            text = f" {FENCE} ".join([w.decode("utf-8", "replace") for w in words])
            ids = np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            mark = self.whole.encode(FENCE, add_special_tokens=False).ids
            cuts = (4 * np.flatnonzero(ids == mark[0])).tolist() if len(mark) == 1 else []
            starts, ends = [0, *[c + 4 for c in cuts]], [*cuts, 4 * len(ids)]
        if len(ends) != len(words):
            return [self.one(w) for w in words]
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(starts, ends, strict=True)]

    def special(self, word: bytes) -> bool:
        low = word.lower()
        return any(a in low for a in self.added)

    def plain(self, word: bytes) -> bool:
        if word.isalpha():  # ASCII letters; they are small by now
            return True
        text = word.decode("utf-8", "replace")
        return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)

    def learn(self, words: set[bytes]) -> None:
        known, closed = self.known, {}
        if self.short:
            closed = {w: m.groups() for w in words if not w.isalpha() and (m := CLOSED.fullmatch(w)) and not self.special(w)}
            words = words.difference(closed).union(*closed.values()).difference(known)
        plain = [w for w in words if self.plain(w)] if self.short else []
        other = words.difference(plain) if plain else words
        for short, part in ((True, plain), (False, [w for w in other if FENCE.encode() not in w])):
            for i in range(0, len(part), 4096):
                known.update(zip(part[i : i + 4096], self.encode(part[i : i + 4096], short), strict=True))
        for w in other:
            if w not in known:
                known[w] = self.one(w)
        for w, (word, signs) in closed.items():
            known[w] = known[word] + known[signs]

    def words(self, text: bytes) -> list[bytes]:
        low = text.lower() if self.lower else text
        words = low.split()
        if self.lower and self.special(low):
            words = [raw if self.special(w) else w for w, raw in zip(words, text.split(), strict=True)]
        return words

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.older = {}, self.known
        lists = [self.words(t) for t in texts]
        new = set().union(*lists).difference(self.known)
        kept = [w for w in new if w in self.older]
        self.known.update(zip(kept, map(self.older.__getitem__, kept), strict=True))
        self.learn(new.difference(kept))
        return [b"".join(map(self.known.__getitem__, words)) for words in lists]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One tokenizer per Python worker, however many tasks it runs; the words it knows go with each task."""
    return WordIds(path)


def chunks(texts: list[bytes], size: int) -> Iterator[list[bytes]]:
    """Runs of texts of some size bytes together; a longer text is a run of its own."""
    run, held = [], 0
    for t in texts:
        if run and held + len(t) > size:
            yield run
            run, held = [], 0
        run.append(t)
        held += len(t)
    if run:
        yield run


def cut_pieces(tokenizer_path: str, capacity: int, end_id: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(tokenizer_path), end_id.to_bytes(4, "little")
        encode.forget()
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            made = (ids for run in chunks(batch.column(1).to_pylist(), CHUNK) for ids in encode(run))
            for doc_id, ids in zip(batch.column(0).to_pylist(), made, strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    for column, value in zip(rows, (doc_id, piece, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        encode.forget()

    return cut


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """(sets fixed for good, as (length: how many) and how often; the counts that remain)."""
    left = {s: c for s, c in counts.items() if c > 0}
    fixed: list[tuple[dict[int, int], int]] = []

    def take(items: tuple[int, ...], times: int) -> None:
        need = Counter(items)
        fixed.append((dict(need), times))
        for s, n in need.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]

    for longest in sorted(left, reverse=True):
        while longest in left:
            room = capacity - longest
            others = dict(left)
            others[longest] -= 1
            sizes = sorted(s for s, c in others.items() if c > 0 and s <= room)
            if not sizes:
                take((longest,), left[longest])
                continue
            best = sizes[-1]
            small: list[int] = []
            for s in sizes[:3]:
                small += [s] * min(3, others[s])
            fits_two, fits_three = len(small) > 1 and sum(small[:2]) <= room, len(small) > 2 and sum(small[:3]) <= room
            sound = best == room or not fits_two
            if not sound and not fits_three:
                pair = 0
                for a in sizes:
                    top = bisect_right(sizes, room - a) - 1
                    if top >= 0 and (sizes[top] != a or others[a] > 1 or top > 0):
                        b = sizes[top] if sizes[top] != a or others[a] > 1 else sizes[top - 1]
                        pair = max(pair, a + b)
                sound = best >= pair
            if not sound:
                break
            take((longest, best), left[longest] // 2 if best == longest else min(left[longest], left[best]))
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best-fit decreasing over a histogram; equal bins are kept as one entry with a count."""
    open_bins: dict[int, list[tuple[dict[int, int], int]]] = {}
    for size in sorted(counts, reverse=True):
        todo = counts[size]
        for room in sorted(r for r in open_bins if r >= size):
            if not todo:
                break
            each, kept = room // size, []
            for bins, times in open_bins.pop(room):
                full = min(times, todo // each)
                todo -= full * each
                rest = todo if full < times and todo else 0
                todo -= rest
                for n, k in ((each, full), (rest, 1 if rest else 0)):
                    if k:
                        open_bins.setdefault(room - n * size, []).append((bins | {size: n}, k))
                if times - full - bool(rest):
                    kept.append((bins, times - full - bool(rest)))
            if kept:
                open_bins.setdefault(room, []).extend(kept)
        if todo:
            each = capacity // size
            if todo // each:
                open_bins.setdefault(capacity - each * size, []).append(({size: each}, todo // each))
            if todo % each:
                open_bins.setdefault(capacity - todo % each * size, []).append(({size: todo % each}, 1))
    return [x for bins in open_bins.values() for x in bins]


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, how many a sequence holds, first sequence, offset) for every run of slots."""
    fixed, left = reduce_by_dominance(counts, capacity)
    used: Counter[int] = Counter()
    slots, sequence = [], 0
    for bins, times in fixed + best_fit(left, capacity):
        offset = 0
        for size, n in sorted(bins.items(), reverse=True):
            slots.append((size, used[size], used[size] + n * times - 1, n, sequence, offset))
            used[size] += n * times
            offset += n * size
        sequence += times
    return slots


def pack(pieces: DataFrame, capacity: int, bucket_rows: int = 200_000) -> DataFrame:
    """pieces (with a column length) plus sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots = plan_slots(counts, capacity)
    plan = spark.createDataFrame(slots, "slot_length long, low long, high long, each long, first long, at long")
    buckets = partitions_for(sum(counts.values()), bucket_rows, 8)
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    sums = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sums = sums.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).drop("n")
    order = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("nth", F.row_number().over(order) - 1).join(sums, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth"))
    # The plan's size is bounded by the capacity, not by the corpus: under 2 runs of bins per length, under 64 lengths in each.
    met = ranked.join(F.broadcast(plan), (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("low"), F.col("high")))
    nth = F.col("rank") - F.col("low")
    met = met.withColumn("sequence_id", F.col("first") + F.floor(nth / F.col("each")))
    return met.withColumn("offset", F.col("at") + F.pmod(nth, F.col("each")) * F.col("length")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every document."""
    source = docs.select("doc_id", utf8(F.col("text")).alias("body"))
    return pack(settle(source.mapInArrow(released(cut_pieces(tokenizer_path, capacity, end_id)), PIECES), "pieces"), capacity)
