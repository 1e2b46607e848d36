"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it.

Features are hashed byte bigrams and trigrams of the text with A-Z lowered, digits and ASCII signs folded into
word breaks, as square roots of shares (a unit vector, so margins compare across lengths). One linear SVM per
family against the rest picks the family; within a family every pair of languages has its own SVM and the
language with most wins (then most margin) is taken. The classifiers are fitted on the driver, on a hash-drawn
sample of about `per_language` texts of each language: that bound, not the corpus, sizes what is collected.

Defined cases: null texts and texts without a letter are `und` with score 0; a table without any usable training
row predicts `und` throughout; one learned language is predicted for every text with a letter; a null doc_id is
never trained on nor held out; repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.llm.common import crc_fold, released, unit_hash, utf8

DIMS = 4096
UNKNOWN = "und"
#: Language families by ISO 639-1 code; codes not listed share one family.
FAMILIES = {
    "germanic": "af da de en fy is lb nl nb nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
LETTER = regex.compile(r"\p{L}")


def family_of(lang: str) -> str:
    return FAMILY.get(lang.lower().replace("_", "-").split("-")[0], "other")


def fold_table() -> np.ndarray:
    """Byte to byte: ASCII capitals to small letters, other ASCII that is no letter to a space."""
    table = np.arange(256, dtype=np.uint32)
    for c in range(128):
        small = chr(c).lower()
        table[c] = ord(small) if "a" <= small <= "z" else 32
    return table


def features(text: bytes, fold: np.ndarray) -> np.ndarray:
    raw = fold[np.frombuffer(b" " + text + b" ", dtype=np.uint8)]
    raw = raw[np.concatenate([[True], (raw[1:] != 32) | (raw[:-1] != 32)])]
    if len(raw) < 3:
        return np.zeros(DIMS, dtype=np.float32)
    two = raw[:-1] | raw[1:] << np.uint32(8)
    three = two[:-1] | raw[2:] << np.uint32(16) | np.uint32(1 << 24)
    grams = np.concatenate([two, three]) * np.uint32(2_654_435_761) >> np.uint32(20)
    counts = np.bincount(grams, minlength=DIMS)
    return np.sqrt(counts / counts.sum()).astype(np.float32)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold = fold_table()
    for batch in batches:
        rows = [features(t, fold).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["lang", "vector"])


def fit_svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-4, steps: int = 120) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss and classes of equal weight, by accelerated gradient descent."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, dtype=np.float32)
    ahead, prior = w.copy(), w.copy()
    rate = 1 / (2 * 2.0 + reg)  # rows have norm 1 and a bias of 1
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ ahead[:-1] + ahead[-1]))
        pull = -2 * share * y * slack
        grad = np.append(x.T @ pull, pull.sum()) + reg * np.append(ahead[:-1], 0)
        w = (ahead - rate * grad).astype(np.float32)
        ahead = w + np.float32(t / (t + 3)) * (w - prior)
        prior = w
    return w[:-1], float(w[-1])


class Model:
    """Families and, in each, the pairwise classifiers, as one matrix of weights."""

    def __init__(self, x: np.ndarray, langs: list[str]) -> None:
        named = np.array(langs)
        self.families = {f: sorted(g) for f in sorted({family_of(v) for v in langs}) if (g := {v for v in langs if family_of(v) == f})}
        family = np.array([family_of(v) for v in langs])
        columns = []
        self.family_at, self.pair_at = {}, {}
        if len(self.families) > 1:
            for f in self.families:
                self.family_at[f] = len(columns)
                columns.append(fit_svm(x, np.where(family == f, 1, -1).astype(np.float32)))
        for group in self.families.values():
            for a, b in combinations(group, 2):
                own = (named == a) | (named == b)
                self.pair_at[a, b] = len(columns)
                columns.append(fit_svm(x[own], np.where(named[own] == a, 1, -1).astype(np.float32)))
        self.weights = np.stack([w for w, _ in columns], axis=1) if columns else np.zeros((DIMS, 0), np.float32)
        self.bias = np.array([b for _, b in columns], dtype=np.float32)

    def predict(self, margins: np.ndarray) -> tuple[str, float]:
        """The language, and how sure each decision on its way was (1 / (1 + exp(-2 margin)), multiplied)."""
        sure = lambda m: 1 / (1 + np.exp(-2 * np.clip(m, -20, 20)))
        family = max(self.families, key=lambda f: margins[self.family_at[f]]) if self.family_at else next(iter(self.families))
        score = float(sure(margins[self.family_at[family]])) if self.family_at else 1.0
        group = self.families[family]
        wins = {lang: [0, 0.0] for lang in group}
        for a, b in combinations(group, 2):
            m = float(margins[self.pair_at[a, b]])
            for lang, own in ((a, m), (b, -m)):
                wins[lang][0] += own > 0
                wins[lang][1] += own
        best = max(group, key=lambda lang: (*wins[lang], lang))
        for (a, b), k in self.pair_at.items():
            if best in (a, b):
                score *= float(sure(margins[k] if best == a else -margins[k]))
        return best, score


def train(labelled: DataFrame, per_language: int = 600, seed: int = 29) -> Model | None:
    """Fit on (lang, body, doc_id) rows; about per_language of each language are drawn by hash and collected."""
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return None
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, per_language / n))).otherwise(share)
    drawn = labelled.where(unit_hash(F.lit(seed), F.col("doc_id")) < share).select("lang", "body")
    rows = sorted((r["lang"], bytes(r["vector"])) for r in drawn.mapInArrow(released(_featurise), "lang string, vector binary").collect())
    if not rows:
        return None
    return Model(np.stack([np.frombuffer(v, dtype=np.float32) for _, v in rows]), [lang for lang, _ in rows])


def scorer(model: Model | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = fold_table()
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(2).to_pylist():
                if model is None or not LETTER.search(text.decode("utf-8", "replace")):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                lang, sure = model.predict(features(text, fold) @ model.weights + model.bias)
                langs.append(lang)
                scores.append(sure)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return score


def fit_on(docs: DataFrame, folds: int = 4, held: int = 2, **bounds) -> Model | None:
    fold = crc_fold(F.col("doc_id"), folds)
    body = utf8(F.col("text"))
    return train(docs.where((fold != held) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", body.alias("body")), **bounds)


def identify(docs: DataFrame, folds: int = 4, held: int = 2, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; learned from the rows outside the held-out fold."""
    model = fit_on(docs, folds, held, **bounds)
    held_out = F.coalesce(crc_fold(F.col("doc_id"), folds) == held, F.lit(False))
    source = docs.select("doc_id", held_out.alias("held_out"), utf8(F.col("text")).alias("body"))
    return source.mapInArrow(released(scorer(model)), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.1, **bounds) -> DataFrame:
    """The rows of docs whose language is identified: `und` rows go, and rows whose language is predicted with a score
    under `least`, as those of no learned language are. A null lang becomes the predicted one. Without any usable
    training row nothing can be predicted, and every row with a letter stays as it is."""
    model = fit_on(docs, **bounds)
    scored = scorer(model)
    at = docs.columns.index("text")
    named = docs.columns.index("lang") if "lang" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = pa.array([t or b"" for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.binary())
            blank = pa.nulls(len(bodies))
            if model is None:
                yield batch.filter(pa.array([bool(LETTER.search(t.decode("utf-8", "replace"))) for t in bodies.to_pylist()], pa.bool_()))
                continue
            found = next(scored(iter([pa.RecordBatch.from_arrays([blank, blank, bodies], names=["doc_id", "held_out", "body"])])))
            langs, scores = found.column(2), found.column(3)
            columns = list(batch.columns)
            if named is not None:
                columns[named] = pc.coalesce(columns[named], langs.cast(columns[named].type))
            keep = pc.and_(pc.not_equal(langs, UNKNOWN), pc.greater_equal(scores, least))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return docs.mapInArrow(released(run), docs.schema)
