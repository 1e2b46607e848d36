"""Subword lattice likelihood: every segmentation of a word into pieces of an existing vocabulary counts.

The vocabulary's pieces (with and without word end) keep their identity; their unigram scores, one table for a
word's first piece and one for later ones, start from the vocabulary's own ranks and are re-estimated by expectation
maximisation on the training words, each as often as it occurs. A word's probability is the sum over all its
segmentations, by the forward recursion in log space, and nothing else: a word seen in training scores by its pieces
like any other. A text is its words, each preceded by the choice not to end, and the end. Every choice's
probabilities sum to at most 1, so scores are those of a proper distribution over texts; all single bytes are
pieces, so no word is impossible.

Beside it, lexicon_score: the same with words seen in training as pieces of their own, by absolute discounting (a
word's count less `discount`; the lattice shares out what the discounts leave).

Words are counted over all training documents; each distinct word's lattice is computed once. Documents meet
their words' scores in hash blocks of bounded size: a block needs each of its words once, however often it occurs.

Defined cases: null, empty and wordless texts are the end alone; a null doc_id is neither trained on nor held
out; without training documents counts are 0 and scores are those of the vocabulary's ranks; very long texts and
words are scored whole; repeated rows are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.llm.common import crc_fold, gathered, partitions_for, released, settle, utf8

END_OF_WORD = "</w>"
#: Words worked on together.
TOGETHER = 20_000
#: Words of one length whose lattices are computed together.
SLAB = 1 << 14
HASH = 0x9E3779B97F4A7C15


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_pieces(path: str) -> list[tuple[bytes, bool]]:
    """(bytes, ends a word) of every ordinary piece, by rank."""
    vocab = json.loads(Path(path).read_text(encoding="utf-8"))
    special = {t["content"] for t in vocab["added_tokens"]}
    to_byte = byte_alphabet()
    found = {}
    for piece, rank in sorted(vocab["model"]["vocab"].items(), key=lambda x: x[1]):
        final = piece.endswith(END_OF_WORD)
        inner = piece.removesuffix(END_OF_WORD) if final else piece
        if piece not in special and inner and all(c in to_byte for c in inner):
            found.setdefault((bytes(to_byte[c] for c in inner), final), rank)
    return list(found)


class Lattice:
    """Pieces by length as sorted hashes, and their log probabilities."""

    def __init__(self, pieces: list[tuple[bytes, bool]], log_p: np.ndarray) -> None:
        self.log_p = log_p
        grouped: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        for i, (piece, final) in enumerate(pieces):
            key = 0
            for b in piece:
                key = (key * HASH + b + 1) & 0xFFFFFFFFFFFFFFFF
            grouped.setdefault((len(piece), final), []).append((key, i))
        self.tables = {}
        for k, rows in grouped.items():
            rows.sort()
            self.tables[k] = np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows], dtype=np.int64)
        self.longest = max((n for n, _ in self.tables), default=0)

    def lookup(self, keys: np.ndarray, n: int, final: bool) -> np.ndarray:
        """Piece numbers, -1 where there is none."""
        if (n, final) not in self.tables:
            return np.full(keys.shape, -1, dtype=np.int64)
        hashes, ids = self.tables[n, final]
        at = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
        return np.where(hashes[at] == keys, ids[at], -1)

    def edges(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) of every edge of the words (rows of bytes of one length), by end."""
        length = words.shape[1]
        keys = np.zeros(words.shape, dtype=np.uint64)
        found = []
        codes = words.astype(np.uint64) + np.uint64(1)
        for n in range(1, min(self.longest, length) + 1):
            keys = keys[:, : length - n + 1] * np.uint64(HASH) + codes[:, n - 1 :]
            for final, starts in ((False, slice(0, length - n)), (True, slice(length - n, length - n + 1))):
                if (n, final) not in self.tables or starts.start == starts.stop:
                    continue
                ids = self.lookup(keys[:, starts], n, final)
                for k in range(ids.shape[1]):
                    rows = np.flatnonzero(ids[:, k] >= 0)
                    if len(rows):
                        found.append((starts.start + k, starts.start + k + n, rows, ids[rows, k]))
        found.sort(key=lambda e: (e[1], e[0]))
        return found

    def forward(self, words: np.ndarray) -> tuple[np.ndarray, list]:
        """alpha[:, e] = log of the sum over segmentations of the first e bytes."""
        edges = self.edges(words)
        alpha = np.full((words.shape[0], words.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0
        for start, end, rows, ids in edges:
            alpha[rows, end] = np.logaddexp(alpha[rows, end], alpha[rows, start] + self.log_p[int(start > 0), ids])
        return alpha, edges

    def expect(self, words: np.ndarray, times: np.ndarray, out: np.ndarray) -> None:
        """Add to out (first pieces, later pieces) how often each piece is expected in the words, which occur so many times."""
        alpha, edges = self.forward(words)
        length = words.shape[1]
        beta = np.full(alpha.shape, -np.inf)
        beta[:, length] = 0
        for start, end, rows, ids in sorted(edges, key=lambda e: -e[1]):
            through = beta[rows, end] + self.log_p[int(start > 0), ids]
            share = np.exp(alpha[rows, start] + through - alpha[rows, length])
            np.add.at(out[int(start > 0)], ids, share * times[rows])
            beta[rows, start] = np.logaddexp(beta[rows, start], through)


def slabs(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, bytes as rows) of the words by length."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(lengths, kind="stable")
    edges = np.flatnonzero(np.diff(lengths[order])) + 1
    for group in np.split(order, edges):
        n = int(lengths[group[0]]) if len(group) else 0
        size = max(1, min(SLAB, (1 << 21) // max(1, n)))
        for i in range(0, len(group) if n else 0, size):
            part = group[i : i + size]
            yield part, np.frombuffer(b"".join([words[k] for k in part]), dtype=np.uint8).reshape(len(part), n)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word and its count in training texts (0 for words of other texts only), added up per task."""
    seen: Counter[bytes] = Counter()
    other: set[bytes] = set()

    def flush() -> pa.RecordBatch:
        words = [*seen, *(w for w in other if w not in seen)]
        counts = [*seen.values(), *[0] * (len(words) - len(seen))]
        seen.clear()
        other.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int64())], names=["word", "n"])

    for batch in batches:
        for learn, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if learn:
                seen.update(text.lower().split())
            else:
                other.update(text.lower().split())
            if len(seen) + len(other) > 400_000:
                yield flush()
    yield flush()


def _expectations(pieces: list, log_p: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, out = Lattice(pieces, log_p), np.zeros(log_p.shape)
        for batch in gathered(batches, TOGETHER):
            times = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            for at, rows in slabs(batch.column(0).to_pylist()):
                lattice.expect(rows, times[at], out)
        ids = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out.ravel()[ids], pa.float64())], names=["piece", "n"])

    return run


def _word_scores(pieces: list, log_p: np.ndarray, learnt: int, distinct: int, discount: float):
    """The words' log10 probabilities: what their lattices give (log_p), and their discounted counts besides (seen_p)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, log_p)
        for batch in gathered(batches, TOGETHER):
            words = batch.column(0).to_pylist()
            out = np.zeros(len(words))
            for at, rows in slabs(words):
                out[at] = lattice.forward(rows)[0][:, -1]
            seen = out
            if learnt:
                counts = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=np.float64)
                with np.errstate(divide="ignore"):
                    seen = np.logaddexp(np.log(np.maximum(counts - discount, 0) / learnt), out + math.log(discount * distinct / learnt))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out / math.log(10), pa.float64()), pa.array(seen / math.log(10), pa.float64())], names=["word", "n", "log_p", "seen_p"])

    return run


def _block_words(key, table):
    words: set[bytes] = set()
    for text in table.column("body").to_pylist():
        words.update(text.lower().split())
    return pa.table({"block": pa.array([key[0].as_py()] * len(words), pa.int64()), "word": pa.array(list(words), pa.binary())})


def _score_block(model: dict):
    def run(key, docs, words):
        number = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        counts = words.column("n").to_numpy().astype(np.float64)
        log_p, seen_p = words.column("log_p").to_numpy(), words.column("seen_p").to_numpy()
        base = np.log10((counts + 1) / model["base"])
        known = counts > 0
        rows: tuple[list, ...] = ([], [], [], [], [])
        for text in docs.column("body").to_pylist():
            own = text.lower().split()
            at = np.fromiter(map(number.__getitem__, own), dtype=np.int64, count=len(own))
            ends = len(own) * model["go_on"] + model["stop"]
            values = len(own) + 1, int(known[at].sum()) + model["end_known"], float(base[at].sum()) + model["base_end"], float(log_p[at].sum()) + ends, float(seen_p[at].sum()) + ends
            for column, value in zip(rows, values, strict=True):
                column.append(value)
        out = {"doc_id": docs.column("doc_id"), "held_out": docs.column("held_out")}
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64(), "lexicon_score": pa.float64()}
        return pa.table(out | {n: pa.array(v, k) for (n, k), v in zip(kinds.items(), rows, strict=True)})

    return run


def fit_pieces(words: DataFrame, pieces: list, rounds: int, smoothing: float = 0.05) -> np.ndarray:
    """Log probabilities of the pieces, from their ranks on, by `rounds` of expectation maximisation over all words."""
    p = 1 / (np.arange(len(pieces)) + 100.0)
    log_p = np.log(np.stack([p, p]) / p.sum())
    used = words.where("n > 0").select("word", "n")
    for _ in range(rounds):
        found = used.mapInArrow(released(_expectations(pieces, log_p)), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        rows = found.collect()  # two rows per piece of the vocabulary at most
        if not rows:
            break
        out = np.full(log_p.shape, smoothing)
        for r in rows:
            out.flat[r["piece"]] += r["n"]
        log_p = np.log(out / out.sum(axis=1, keepdims=True))
    return log_p


def score_texts(docs: DataFrame, vocabulary: str, folds: int = 7, held: int = 2, rounds: int = 2, block_bytes: int = 24_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lexicon_score of every document (scores in log10)."""
    fold = crc_fold(F.col("doc_id"), folds)
    rows = docs.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), F.coalesce(fold != held, F.lit(False)).alias("learn"), utf8(F.col("text")).alias("body"))
    counted = rows.select("learn", "body").mapInArrow(released(_count_words), "word binary, n long")
    words = settle(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    totals = words.agg(F.sum("n").alias("n"), *[F.sum((F.col("n") >= k if k == 1 else F.col("n") == k - 1).cast("long")).alias(v) for k, v in ((1, "v"), (2, "once"), (3, "twice"))]).first()
    texts = rows.agg(F.sum(F.col("learn").cast("long")).alias("learn"), F.sum(F.octet_length("body")).alias("bytes")).first()
    learnt, ends = int(totals["n"] or 0), int(texts["learn"] or 0)
    total, distinct = learnt + ends, int(totals["v"] or 0) + (ends > 0)
    discount = ((totals["once"] or 0) + 0.5) / ((totals["once"] or 0) + 2 * (totals["twice"] or 0) + 1.0)
    pieces = read_pieces(vocabulary)
    log_p = fit_pieces(words, pieces, rounds)
    scored = words.mapInArrow(released(_word_scores(pieces, log_p, learnt, int(totals["v"] or 0), discount)), "word binary, n long, log_p double, seen_p double")
    stop = (ends + 0.5) / (total + 1.0)
    base = total + 1.0 * (distinct + 1)
    model = {"base": base, "end_known": int(ends > 0), "base_end": math.log10((ends + 1) / base), "go_on": math.log10(1 - stop), "stop": math.log10(stop)}
    blocks = partitions_for(texts["bytes"] or 0, block_bytes, 1)
    placed = rows.select("doc_id", "held_out", "body", F.pmod(F.xxhash64("doc_id", F.substring("body", 1, 64)), F.lit(blocks)).alias("block"))
    needed = placed.groupBy("block").applyInArrow(released(_block_words), "block long, word binary").join(scored, "word")
    out = placed.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(released(_score_block(model)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, lexicon_score double")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))
