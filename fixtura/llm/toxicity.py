"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts, over labelled documents, in how many toxic and clean documents each term occurs (a term is a
word without its outer punctuation, or the first five letters of a longer one) and takes log-odds with an
informative Dirichlet prior proportional to the term's overall frequency; terms whose z-score passes `min_z` are
the lexicon. A text is the sequence of its words' scores, a word outside the lexicon costing `drift`; one linear-time
scan (Ruzzo and Tompa) yields every maximal segment. Segment scores are made comparable by extreme-value
statistics (Karlin and Altschul): a segment of score s in n words has E = K n exp(-lambda s), with lambda and K
from the segments of the clean training texts, and a segment with E below `alpha` is
significant. A document's evidence, the sum of lambda s - ln(K n) over its significant segments, becomes a
probability by a one-variable logistic fit on the training rows.

Defined cases: null, empty and wordless texts have no segment and get the score of no evidence; without labels
of both classes every score is the toxic share of the labels (0 without any); a null doc_id is never trained on
nor held out; repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.llm.common import crc_fold, released, unit_hash, utf8

OUTER = b".,;:!?\"'()[]{}|*$%&#<>-"
STEM = 5
SEGMENTS = "array<struct<start:int,end:int,score:double,e_value:double>>"


def terms_of(word: bytes) -> tuple[bytes, ...]:
    word = word.strip(OUTER)
    if not word:
        return ()
    text = word.decode("utf-8", "replace").lower()
    return (word, b"^" + text[:STEM].encode()) if len(text) > STEM else (word, b"^" + text.encode()) if len(text) == STEM else (word,)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, list[int]] = {}

    def flush() -> pa.RecordBatch:
        rows = [pa.array(list(seen), pa.binary()), *(pa.array([v[k] for v in seen.values()], pa.int64()) for k in (0, 1))]
        seen.clear()
        return pa.RecordBatch.from_arrays(rows, names=["term", "toxic", "clean"])

    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for term in {t for w in set(text.lower().split()) for t in terms_of(w)}:
                seen.setdefault(term, [0, 0])[0 if label else 1] += 1
        if len(seen) > 500_000:
            yield flush()
    yield flush()


def segments_of(scored: list[tuple[int, float]], drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence that is -drift but for the places in scored.

    One pass over the places, as Ruzzo and Tompa; cumulative scores between places follow from the drift. Each open
    segment keeps the number of the last one before it whose total before is lower, so a search for the segment to
    join leaps from one to the next and no step of it is ever repeated: time is linear in the places.
    """
    out: list[tuple[int, int, float, float, int]] = []  # start, end, total before, total after, last lower one
    total, last = 0.0, 0
    for at, score in scored:
        total -= drift * (at - last)
        last = at + 1
        before, total = total, total + score
        if score <= 0:
            continue
        start, j = at, len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= total:
                break
            start, _, before, _, lower = out[j]
            del out[j:]
            j = lower
        out.append((start, at + 1, before, total, j))
    return [(a, b, after - before) for a, b, before, after, _ in out]


class Scale:
    """lambda and K of the extreme-value law, and the logistic calibration of the evidence."""

    def __init__(self, lexicon: dict[bytes, float], drift: float, alpha: float) -> None:
        self.lexicon, self.drift, self.alpha = lexicon, drift, alpha
        self.lam, self.log_k, self.slope, self.start = 1.0, 0.0, 1.0, -3.0

    def segments(self, text: bytes) -> tuple[int, list[tuple[int, int, float]]]:
        words = text.lower().split()
        lexicon, stem = self.lexicon, self.stem
        known: dict[bytes, float] = {}
        scored = []
        for i, w in enumerate(words):
            s = known.get(w)
            if s is None:
                s = known[w] = max([lexicon[t] for t in stem(w) if t in lexicon], default=0.0, key=abs)
            if s:
                scored.append((i, s))
        return len(words), segments_of(scored, self.drift)

    @staticmethod
    def stem(word: bytes) -> tuple[bytes, ...]:
        return terms_of(word)

    def e_value(self, score: float, n: int) -> float:
        return math.exp(min(50.0, self.log_k + math.log(max(n, 1)) - self.lam * score))

    def evidence(self, n: int, found: list[tuple[int, int, float]]) -> float:
        return sum(-math.log(max(e, 1e-300)) for _, _, s in found if (e := self.e_value(s, n)) < self.alpha)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.start + self.slope * math.log1p(evidence)))))

    def calibrate(self, rows: list[tuple[int, int, list[tuple[int, int, float]]]]) -> None:
        """rows: (label, words, segments). The law of segments in clean texts, then a logistic fit."""
        # The tail of the clean texts' segments: exponential above the least score, as many per word as they show.
        clean = [x for label, _, found in rows if not label for _, _, x in found]
        least = min(self.lexicon.values(), default=1.0)
        excess = sum(x - least for x in clean) / max(1, len(clean))
        self.lam = 1 / max(excess, 0.02) if len(clean) >= 30 else 1.0  # 1 is the scale of log-odds
        words = sum(n for label, n, _ in rows if not label) or 1
        self.log_k = math.log((len(clean) + 0.5) / words) + self.lam * least
        points = [(math.log1p(self.evidence(n, found)), label) for label, n, found in rows]
        a, b = -3.0, 1.0
        for _ in range(400):
            ga = gb = haa = hab = hbb = 0.0
            for (x, y), times in Counter(points).items():
                p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x))))
                r, v = times * (p - y), times * max(p * (1 - p), 1e-9)
                ga, gb, haa, hab, hbb = ga + r, gb + r * x, haa + v, hab + v * x, hbb + v * x * x
            ga, gb, haa, hbb = ga + 1e-2 * a, gb + 1e-2 * b, haa + 1e-2, hbb + 1e-2
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            size = max(1.0, abs(da), abs(db))
            a, b = a - da / size, b - db / size
            if abs(da) + abs(db) < 1e-9:
                break
        self.start, self.slope = a, max(b, 0.0)


def _segments_for_fit(scale: Scale):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scale.segments(t) for t in batch.column(1).to_pylist()]
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([[s for _, _, s in found] for _, found in rows], kind)], names=["label", "n", "scores"])

    return find


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 12_000, min_z: float = 3.3, prior: float = 0.1, drift: float = 0.3, alpha: float = 0.05, folds: int = 3, held: int = 1, seed: int = 41) -> Scale | None:
    """Learn from about per_class labelled rows of each class (drawn by hash) outside the held-out fold."""
    marked = labels.where(F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held)).select("doc_id", (F.col("toxic") != 0).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in marked.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        scale = Scale({}, drift, alpha)
        scale.slope, scale.start = 0.0, 30.0 if counts.get(1) else -30.0
        return scale
    share = F.when(F.col("label") == 1, F.lit(min(1.0, per_class / counts[1]))).otherwise(F.lit(min(1.0, per_class / counts[0])))
    sample = marked.where(unit_hash(F.lit(seed), F.col("doc_id")) < share).dropDuplicates(["doc_id"])
    # Two classes of about per_class rows of 12 bytes: bounded by the parameter.
    texts = docs.select("doc_id", utf8(F.col("text")).alias("body")).join(F.broadcast(sample), "doc_id").select("label", "body")
    terms = texts.mapInArrow(released(_count_terms), "term binary, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    total = terms.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    sum_t, sum_c = float(total["t"] or 0), float(total["c"] or 0)
    alpha_w, alpha_0 = prior * (F.col("toxic") + F.col("clean")), prior * (sum_t + sum_c)
    odds = lambda y, n: F.log((F.col(y) + alpha_w) / F.greatest(n + alpha_0 - F.col(y) - alpha_w, F.lit(0.5)))
    delta = odds("toxic", sum_t) - odds("clean", sum_c)
    z = delta / F.sqrt(1 / (F.col("toxic") + alpha_w) + 1 / (F.col("clean") + alpha_w))
    kept = terms.where("toxic >= 2").select("term", delta.alias("delta"), z.alias("z")).where((F.col("z") >= min_z) & (F.col("delta") >= 1.0))
    # Every term that passes is used. There can't be more than the drawn rows' terms, and z needs several rows of each.
    scale = Scale({bytes(r["term"]): float(r["delta"]) for r in kept.collect()}, drift, alpha)
    rows = texts.mapInArrow(released(_segments_for_fit(scale)), "label int, n long, scores array<double>").collect()  # about 2 * per_class rows
    scale.calibrate([(r["label"], r["n"], [(0, 0, s) for s in r["scores"]]) for r in rows])
    return scale


def scorer(scale: Scale, threshold: float):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, passages = [], []
            for text in batch.column(2).to_pylist():
                n, found = scale.segments(text)
                scores.append(scale.probability(scale.evidence(n, found)))
                passages.append([{"start": a, "end": b, "score": s, "e_value": e} for a, b, s in found if (e := scale.e_value(s, n)) < scale.alpha])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))
            arrays = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32()), pa.array(passages, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "score", "predicted", "passages"])

    return score


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 3, held: int = 1, **bounds) -> DataFrame:
    """doc_id, held_out, score, predicted, passages (word ranges of the significant segments) of every document."""
    scale = fit(docs, labels, folds=folds, held=held, **bounds)
    held_out = F.coalesce(crc_fold(F.col("doc_id"), folds) == held, F.lit(False))
    source = docs.select("doc_id", held_out.alias("held_out"), utf8(F.col("text")).alias("body"))
    return source.mapInArrow(released(scorer(scale, threshold)), f"doc_id long, held_out boolean, score double, predicted int, passages {SEGMENTS}")
