"""Secret scans in DataFrame operations only: three base patterns, and sliding-window entropy over candidate strings.

A pattern's matches and the pieces between them (split by the same pattern) give every match's place in code
points. The method adds candidate strings, runs of 20 or more key-like characters with a digit, whose entropy
in some window of `window` characters reaches the threshold of their character class. A window moves one
character at a time: its counts and its sum of c * log2(c) change by one count up and one down. Candidates on
the allow-list, and those that touch a base span, are suppressed.

Defined cases: null and empty texts have no spans (hash of the empty string); very long texts cost linear time
for a candidate's length; repeated rows give repeated results; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.llm.common import let

#: Fixed patterns: kind, expression, group whose length counts, least length.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
KEY = "[A-Za-z0-9+/_=-]"
#: A run is tried at its first character only, so a scan stays linear.
CANDIDATE = rf"(?<!{KEY})(?=[A-Za-z+/_=-]*+[0-9]){KEY}{{20,}}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes, first that fits, with the bits a window of 20 must reach; None: never a secret.
CLASSES = ((r"^[0-9_=+/-]+$", None), (r"^[0-9a-fA-F]+$", 3.0), (r"^[a-z0-9_-]+$", 3.7), (r"^[A-Z0-9_-]+$", 3.7), (r"", 3.9))
#: Strings that look random but are known not to be secrets.
ALLOWED = r"(?i)example|placeholder|changeme|sample|dummy|x{6,}|0123456|abcdefg|^[0-9a-f]{8}-[0-9a-f]{4}-|^(19|20)[0-9]{2}-[0-9]{2}-"
SPAN = "array<struct<start:int,place:int,end:int,kind:string>>"


def located(text: Column, pattern: str, group: int, least: int, place: int, kind: str, keep=None) -> Column:
    """The matches of pattern as spans, those kept that are long enough (and that keep accepts)."""
    hits = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), F.slice(F.split(text, pattern, -1), 1, 2**31 - 1).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["m"])
        good = F.length(x["g"]) >= least
        if keep is not None:
            good = good & keep(x["m"])
        span = F.struct(begin.alias("start"), F.lit(place).alias("place"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(F.filter(hits, lambda x: x["m"].isNotNull()), start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def peak_entropy(candidate: Column, window: int) -> Column:
    """The highest Shannon entropy, in bits, of any window of the candidate."""
    costs = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))

    def over(codes: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            come = F.get(codes, i)
            gone = F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(0))
            up, down = F.get(acc["counts"], come), F.get(acc["counts"], gone)
            change = F.get(costs, up + 1) - F.get(costs, up) + F.when(gone > 0, F.get(costs, down - 1) - F.get(costs, down)).otherwise(F.lit(0.0))
            total = acc["total"] + F.when(come == gone, F.lit(0.0)).otherwise(change)
            counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == come, 1).otherwise(0) - F.when((k == gone) & (gone > 0), 1).otherwise(0))
            return let(total, lambda t: F.struct(counts.alias("counts"), t.alias("total"), F.when(i >= window - 1, F.greatest(acc["best"], F.lit(math.log2(window)) - t / window)).otherwise(acc["best"]).alias("best")))

        start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda acc: acc["best"])

    return let(codes, over)


def suspicious(candidate: Column, window: int) -> Column:
    bits = F.lit(None).cast("double")
    for pattern, least in reversed(CLASSES):
        bits = F.when(candidate.rlike(pattern), F.lit(least).cast("double")).otherwise(bits) if pattern else F.lit(least)
    return F.when(candidate.rlike(ALLOWED), F.lit(False)).otherwise(let(bits, lambda least: F.when(least.isNull(), F.lit(False)).otherwise(peak_entropy(candidate, window) >= least)))


def scan_secrets(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, base (spans of the patterns) and added (spans of the method), each sorted by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("body"))
    body = F.col("body")
    base = [located(body, p, g, n, i, kind) for i, (kind, p, g, n) in enumerate(KINDS)]
    rows = rows.select("doc_id", F.sort_array(F.concat(*base)).alias("base"), located(body, CANDIDATE, 0, window, len(KINDS), "entropy", lambda c: suspicious(c, window)).alias("more"))
    clear = let(F.col("base"), lambda base: F.filter("more", lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    return rows.select("doc_id", "base", clear.alias("added"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(scanned: DataFrame) -> DataFrame:
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = joined(F.sort_array(F.concat("base", "added")))
    return scanned.select("doc_id", *[count(kind) for kind, *_ in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), F.size("added").alias("n_added"))
