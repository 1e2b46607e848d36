"""Learned decision lists for text quality, in DataFrame operations only.

Statistics of every text are SQL expressions. A bounded, hash-drawn sample of labelled rows is brought to the
driver as statistics and sequential covering learns from it: a rule grows by the threshold with the best
information gain, is pruned from its end on held-back rows, and joins the list while it is precise there; the
rows it covers go and the next rule is grown. The list is emitted as one ordered conditional expression.

Defined cases: null, empty and wordless texts have all counts 0, fail the base rules and are not kept; without
labels of both kinds the list is empty and only the base rules speak; labels of null or unknown ids are unused;
of repeated labels each counts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.llm.common import BREAK_CLASS, UPPER, WORD_BREAKS, let, unit_hash

SYMBOLS = "#*$%&|<>"
#: Statistics that rules may use: shares and means, not sizes, so that a rule means the same for short and long texts.
FEATURES = ("symbol_share", "upper_share", "mark_share", "digit_share", "mean_word", "dup_line_share", "repeat_share", "distinct_share")
Rule = list[tuple[str, str, float]]


def word_array(text: Column) -> Column:
    inner = F.btrim(text, F.lit(WORD_BREAKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"{BREAK_CLASS}+"))


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows found twice or more."""

    def of(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))

    def covered(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("at"))))

        def twice(p: Column) -> Column:
            places = F.transform(F.filter(p, lambda x, i: F.coalesce(F.get(p, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(p, i + 1)["h"] == x["h"], F.lit(False))), lambda x: x["at"])
            return F.sort_array(places)

        step = lambda acc, at: F.struct((at + 3).alias("end"), (acc["n"] + at + 3 - F.greatest(at, acc["end"])).alias("n"))
        return F.aggregate(let(placed, twice), F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    return let(words, of)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the contract, and FEATURES."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", t.alias("body"), word_array(t).alias("words"))
    body = F.col("body")
    without = lambda chars: F.length(F.translate(body, chars, ""))
    n_chars = F.length(body)
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.btrim(x, F.lit(WORD_BREAKS)) != "")
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        without(WORD_BREAKS).cast("long").alias("word_chars"),
        (n_chars - without(SYMBOLS)).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("lines"),
        repeated_words(F.col("words")).cast("long").alias("n_repeat_words"),
        (n_chars - without(UPPER)).alias("n_upper"),
        (n_chars - without("!?")).alias("n_marks"),
        (n_chars - without("0123456789")).alias("n_digits"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    rows = rows.withColumn("n_lines", F.col("lines.n")).withColumn("n_dup_lines", F.col("lines.dup").cast("long")).drop("lines")
    made = {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "mark_share": share("n_marks", "word_chars"),
        "digit_share": share("n_digits", "word_chars"),
        "mean_word": share("word_chars", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "distinct_share": share("n_distinct", "n_words"),
    }
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[made[f].alias(f) for f in FEATURES])


def holds(rule: Rule, row: dict[str, float]) -> bool:
    return all(row[f] >= cut if sign == ">=" else row[f] <= cut for f, sign, cut in rule)


def tally(rule: Rule, rows: list[tuple[dict[str, float], bool]]) -> tuple[int, int]:
    hit = [bad for row, bad in rows if holds(rule, row)]
    return sum(hit), len(hit) - sum(hit)


def grow(rows: list[tuple[dict[str, float], bool]], cuts: int, longest: int) -> Rule:
    """Add the condition of the best FOIL gain until no good row is covered or nothing helps."""
    rule: Rule = []
    while len(rule) < longest:
        bad = sum(b for _, b in rows)
        if not bad or bad == len(rows):
            break
        before, best = math.log2(bad / len(rows)), (0.0, None)
        for f in FEATURES:
            ordered = sorted((row[f], b) for row, b in rows)
            steps = max(1, len(ordered) // cuts)
            low_p = low_n = 0
            for i, (value, b) in enumerate(ordered):
                low_p, low_n = low_p + b, low_n + (not b)
                if i + 1 == len(ordered) or ordered[i + 1][0] == value or (i % steps and ordered[i + 1][1] == b):
                    continue
                cut = (value + ordered[i + 1][0]) / 2
                for sign, p, n in (("<=", low_p, low_n), (">=", bad - low_p, len(rows) - bad - low_n)):
                    if p and (gain := p * (math.log2(p / (p + n)) - before)) > best[0] + 1e-9:
                        best = (gain, (f, sign, cut))
        if best[1] is None:
            break
        rule.append(best[1])
        rows = [x for x in rows if holds([best[1]], x[0])]
    return rule


def learn_rules(rows: list[tuple[dict[str, float], bool]], most: int = 12, cuts: int = 64, longest: int = 4, precise: float = 0.9) -> list[Rule]:
    """rows: (statistics, bad). Every third row is held back for pruning."""
    growing, pruning = [x for i, x in enumerate(rows) if i % 3], rows[::3]
    rules: list[Rule] = []
    while len(rules) < most:
        rule = grow(growing, cuts, longest)
        if not rule:
            break
        worth = {}
        for k in range(1, len(rule) + 1):
            p, n = tally(rule[:k], pruning)
            worth[k] = (p - n) / (p + n) if p + n else -1.0
        rule = rule[: max(worth, key=lambda k: (worth[k], -k))]
        p, n = tally(rule, pruning)
        gp, gn = tally(rule, growing)
        if p + gp < 5 or p < precise * (p + n) or gp < precise * (gp + gn):
            break
        rules.append(rule)
        growing, pruning = ([x for x in part if not holds(rule, x[0])] for part in (growing, pruning))
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: the number of the first rule that holds, from 1; 0 where none does."""
    out = F
    for k, rule in enumerate(rules, 1):
        test = F.lit(True)
        for f, sign, cut in rule:
            test = test & (F.col(f) >= cut if sign == ">=" else F.col(f) <= cut)
        out = out.when(test, F.lit(k))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def fit_rules(docs: DataFrame, labels: DataFrame, per_class: int = 3_000, seed: int = 53, **options) -> list[Rule]:
    """Rules from about per_class labelled ids of each quality, drawn by hash and collected as statistics. However often
    an id is labelled alike, it counts once; of several texts of one id the one of the least statistics counts."""
    marked = labels.where("quality is not null and doc_id is not null").select("doc_id", (F.col("quality") == 0).alias("bad")).distinct()
    counts = {r["bad"]: r["n"] for r in marked.groupBy("bad").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return []
    share = F.when(F.col("bad"), F.lit(min(1.0, per_class / counts[True]))).otherwise(F.lit(min(1.0, per_class / counts[False])))
    lot = unit_hash(F.lit(seed), F.col("doc_id"))
    sample = F.broadcast(marked.withColumn("lot", lot).where(F.col("lot") < share))  # about 2 * per_class short rows
    drawn = docs.select("doc_id", "text").join(sample, "doc_id", "left_semi")
    one = statistics(drawn).groupBy("doc_id").agg(F.min(F.struct(*FEATURES)).alias("counts"))
    rows = one.join(sample, "doc_id").select("lot", "doc_id", "bad", "counts.*").collect()
    return learn_rules([({f: float(r[f]) for f in FEATURES}, bool(r["bad"])) for r in sorted(rows, key=lambda r: (r["lot"], r["doc_id"]))], **options)


def judge_quality(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The counts, base_failed, rule (0: none spoke) and kept of every document."""
    rules = fit_rules(docs, labels, **options)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = statistics(docs).withColumn("base_failed", failed).withColumn("rule", verdict(rules))
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
