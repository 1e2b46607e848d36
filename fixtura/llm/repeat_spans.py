"""Repeated passages by prefix-free parsing: every byte in a string of `width` bytes that also starts elsewhere.

Dealing. A rolling hash of `key` bytes runs over each text; in every window of `width` bytes the least hash
(rightmost on ties) is its trigger. Triggers depend on content only, so equal windows have equal triggers at equal
offsets, and windows can be dealt by trigger. Consecutive windows with one trigger make a section: its bytes run from
the first window's start to the last one's end, so neighbours overlap by width - 1 bytes and every window lies in
exactly one. A section found twice is repeated whole, all its windows are. A section found once whose trigger no
other section has is not repeated at all. This settles most text: long repeats are runs of repeated sections, unique
text has unique triggers. What is left are distinct sections that share a trigger: the ends of repeats.

Order. These meet by trigger and are parsed prefix-free (corpus_order): wherever a rolling hash of CUT_KEY bytes is
0 modulo CUT_EVERY, a phrase ends and the next one begins with those same bytes, so no phrase's suffix is the beginning
of another's. The dictionary is the distinct phrases, the parse the sections as runs of phrases; both get suffix
arrays, by prefix doubling. A window's place in the order of all text is that of its phrase's suffix in the
dictionary, then that of the parse behind it. Equal windows are neighbours in that order, and neighbours are compared
byte by byte. Answers go back to the texts' blocks.

Counts are combined within a block of texts before they are dealt, so a section of a third of all texts counts once
per block. A trigger with more than HOT_SECTIONS sections (a frequent line in ever different surroundings) is split:
its windows are dealt by their own hashes, combined per block, and counted. Equality of sections, and of such
windows, is that of two 64-bit hashes.

Defined cases: null and empty texts have 0 bytes, nothing removed and the hash of the empty string; texts under
`width` bytes keep everything; repeated rows are removed whole (from `width` bytes on); a null doc_id is a row
like any; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.llm.common import partitions_for, released, utf8

BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text whose hashes are held at once; a longer text is a chunk of its own.
CHUNK = 1 << 20
#: Low bits of a packed hash that hold a place, so that the least one is the rightmost of equals.
PLACE = 24
PHRASE = np.dtype([("trigger", "<u8"), ("phrase", "<u8")])
LOOSE, REPEATED, ASKED, HOT = 0, 1, 2, 4
#: Sections of one trigger that are sorted in one task; a trigger with more of them is split by its windows.
HOT_SECTIONS = 2_000
#: A phrase of the parse ends where the hash of its last CUT_KEY bytes is 0 modulo CUT_EVERY.
CUT_KEY, CUT_EVERY = 6, 16
#: Symbols of 9 bits in a first key of the dictionary's suffixes.
PACKED = 7


def powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


class Parser:
    """Phrases of texts: where their windows start and end, their trigger's hash and their own."""

    def __init__(self, width: int, key: int) -> None:
        self.width, self.key = width, key
        self.up = powers(BASE, CHUNK + 1)
        self.down = powers(UNBASE, CHUNK + 1)

    def chunks(self, texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
        """(number of the first text, texts) with some CHUNK bytes together."""
        first, size = 0, 0
        for i, t in enumerate(texts):
            if i > first and size + len(t) > CHUNK:
                yield first, texts[first:i]
                first, size = i, 0
            size += len(t)
        if texts:
            yield first, texts[first:]

    def parse(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(joined texts, ends of texts, first and last window of each phrase, their hashes)."""
        data = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        none = np.zeros(0, dtype=np.int64)
        n, width, key = len(data), self.width, self.key
        if n < width:
            return data, ends, none, none, np.zeros(0, PHRASE)
        if n + 1 > len(self.up):
            self.up, self.down = powers(BASE, n + 1), powers(UNBASE, n + 1)
        raw = np.frombuffer(data, dtype=np.uint8)
        sums = self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        keys = mixed((sums[key:] - sums[:-key]) * self.down[: n - key + 1])
        place = np.arange(len(keys), dtype=np.uint64) & np.uint64((1 << PLACE) - 1)
        least = (keys >> np.uint64(PLACE) << np.uint64(PLACE)) | (np.uint64((1 << PLACE) - 1) - place)
        span, have = width - key + 1, 1
        while have * 2 <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < span:
            least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
        starts = np.arange(n - width + 1)
        low = (np.uint64((1 << PLACE) - 1) - (least & np.uint64((1 << PLACE) - 1))).astype(np.int64)
        trigger = starts + ((low - starts) & ((1 << PLACE) - 1))
        text_of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        inside = text_of[: n - width + 1] == text_of[width - 1 :]
        same = inside[1:] & inside[:-1] & (trigger[1:] == trigger[:-1])
        first = np.flatnonzero(inside & np.concatenate([[True], ~same]))
        last = np.flatnonzero(inside & np.concatenate([~same, [True]]))
        out = np.empty(len(first), PHRASE)
        at = trigger[first]
        out["trigger"] = keys[at]
        own = (sums[last + width] - sums[first]) * self.down[first]
        out["phrase"] = mixed(own + mixed(((last - first) << 32 | (at - first)).astype(np.uint64)))
        return data, ends, first, last, out


def windows_of(parser: Parser, first: int, last: int, phrase: np.void) -> np.ndarray:
    """The (trigger, own hash) of a section's windows in the text that was parsed last."""
    starts = np.arange(first, last + 1)
    out = np.empty(len(starts), PHRASE)
    out["trigger"] = phrase["trigger"]
    out["phrase"] = mixed((parser.sums[starts + parser.width] - parser.sums[starts]) * parser.down[starts])
    return out


def counted(records: np.ndarray) -> np.ndarray:
    """The distinct records, marked if found twice."""
    kinds, times = np.unique(records, return_counts=True)
    out = np.empty(len(kinds), COUNT)
    out["trigger"], out["phrase"], out["state"] = kinds["trigger"], kinds["phrase"], times > 1
    return out


def blobs(numbers: np.ndarray, records: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """records dealt by numbers modulo parts: the parts that get some, however many there are."""
    part = (mixed(numbers) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, records = part[order], records[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(1, np.int64)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(part[a]), records[a:b]


def rows_of(kinds: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(kinds.items())})


COUNTED = {"part": pa.int64(), "block": pa.int64(), "counts": pa.binary()}
TOLD = {"block": pa.int64(), "counts": pa.binary()}
ENTRIES = {"part": pa.int64(), "block": pa.int64(), "entries": pa.binary(), "lengths": pa.binary(), "bytes": pa.binary()}
FOUND = {"block": pa.int64(), "entries": pa.binary(), "lengths": pa.binary(), "bits": pa.binary()}
COUNT = np.dtype([("trigger", "<u8"), ("phrase", "<u8"), ("state", "u1")])


def schema(kinds: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{n} {'long' if k == pa.int64() else 'binary'}" for n, k in kinds.items())


def count_phrases(width: int, key: int, parts: int):
    """Per block: its distinct phrases, marked if found twice in it."""

    def run(block, docs):
        parser = Parser(width, key)
        texts = docs.column("body").to_pylist()
        found = [parser.parse(t)[4] for _, t in parser.chunks(texts)]
        rows = []
        if found:
            counts = counted(np.concatenate(found))
            rows = [(k, block[0].as_py(), v.tobytes()) for k, v in blobs(counts["trigger"], counts, parts)]
        return rows_of(COUNTED, rows)

    return run


def settle_phrases(part, table):
    """Per part: which phrases are repeated, and which must be looked at byte by byte, told to their blocks."""
    blocks = table.column("block").to_pylist()
    held = [np.frombuffer(b, dtype=COUNT) for b in table.column("counts").to_pylist()]
    owner = np.repeat(np.arange(len(blocks)), [len(h) for h in held])
    every = np.concatenate(held)
    order = np.lexsort((owner, every["phrase"], every["trigger"]))
    every, owner = every[order], owner[order]
    new_trigger = np.concatenate([[True], every["trigger"][1:] != every["trigger"][:-1]])
    new_phrase = new_trigger | np.concatenate([[True], every["phrase"][1:] != every["phrase"][:-1]])
    phrase = np.cumsum(new_phrase) - 1
    copies = np.bincount(phrase, weights=1 + every["state"]) > 1  # by phrase
    trigger = np.cumsum(new_trigger[new_phrase]) - 1  # by phrase
    kinds = np.bincount(trigger)
    loose = np.bincount(trigger, weights=~copies)
    asked = (kinds > 1) & (loose > 0)  # by trigger
    how = np.where(kinds > HOT_SECTIONS, HOT, ASKED)  # by trigger
    state = np.where(copies[phrase], REPEATED, LOOSE) | np.where(asked[trigger[phrase]] & new_phrase, how[trigger[phrase]], 0)
    told = np.empty(len(every), COUNT)
    told["trigger"], told["phrase"], told["state"] = every["trigger"], every["phrase"], state
    keep = state > 0
    told, owner = told[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(blocks) + 1))
    return rows_of(TOLD, [(blocks[k], told[order[cuts[k] : cuts[k + 1]]].tobytes()) for k in range(len(blocks)) if cuts[k] < cuts[k + 1]])


def states_of(phrases: np.ndarray, told: np.ndarray) -> np.ndarray:
    """The state of each phrase; told is sorted."""
    if not len(told):
        return np.zeros(len(phrases), dtype=np.uint8)
    kinds = np.empty(len(told), PHRASE)
    kinds["trigger"], kinds["phrase"] = told["trigger"], told["phrase"]
    both, back = np.unique(np.concatenate([kinds, phrases]), return_inverse=True)
    state = np.zeros(len(both), dtype=np.uint8)
    state[back[: len(kinds)]] = told["state"]
    return state[back[len(kinds) :]]


def joined_counts(table: pa.Table, column: str) -> np.ndarray:
    held = [np.frombuffer(b, dtype=COUNT) for b in table.column(column).to_pylist() if b is not None]
    return np.concatenate(held) if held else np.zeros(0, COUNT)


def write_dictionary(width: int, key: int, parts: int):
    """Per block: the bytes of the sections asked for, dealt by trigger; the hashes of hot ones' windows, dealt by
    themselves (parts from `parts` on); and its repeated and hot sections, for itself (part -1 - block)."""

    def run(block, docs, told):
        number = block[0].as_py()
        counts = joined_counts(told, "counts")
        rows = []
        noted = counts[counts["state"] & (REPEATED | HOT) > 0]
        if len(noted):
            rows.append((-1 - number, number, noted.tobytes(), None, None))
        asked = counts[counts["state"] & (ASKED | HOT) > 0]
        if len(asked):
            parser, sent, hot = Parser(width, key), set(), []
            deals: dict[int, tuple[list, list, list]] = {}
            for _, texts in parser.chunks(docs.column("body").to_pylist()):
                data, _, first, last, phrases = parser.parse(texts)
                states = states_of(phrases, asked)
                for i in np.flatnonzero(states):
                    kind = phrases[i].tobytes()
                    if kind not in sent:
                        sent.add(kind)
                        if states[i] & HOT:
                            hot.append(windows_of(parser, first[i], last[i], phrases[i]))
                            continue
                        deal = deals.setdefault(int(mixed(phrases["trigger"][i : i + 1])[0] % np.uint64(parts)), ([], [], []))
                        deal[0].append(kind)
                        deal[1].append(int(last[i] + width - first[i]))
                        deal[2].append(data[first[i] : last[i] + width])
            rows += [(k, number, b"".join(a), np.array(n, "<u4").tobytes(), b"".join(t)) for k, (a, n, t) in deals.items()]
            if hot:
                windows = counted(np.concatenate(hot))
                rows += [(parts + k, number, v.tobytes(), b"", None) for k, v in blobs(windows["phrase"], windows, parts)]
        return rows_of(ENTRIES, rows)

    return run


def suffix_ranks(keys: np.ndarray, left: np.ndarray, span: int, depth: int) -> np.ndarray:
    """The order of suffixes to `depth` symbols at least, as ranks that equal ones share. keys orders them by their
    first `span` symbols, left tells how many each has. Prefix doubling: only what is still tied is sorted again."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    while span < depth:
        tied = np.flatnonzero((np.bincount(rank, minlength=len(rank))[rank] > 1) & (left > span))
        if not len(tied):
            break
        then = rank[tied + span]
        order = np.lexsort((then, rank[tied]))
        tied, then = tied[order], then[order]
        old, at = rank[tied], np.arange(len(tied))
        other = np.concatenate([[True], old[1:] != old[:-1]])
        new = other | np.concatenate([[True], then[1:] != then[:-1]])
        rank[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(other, at, 0))
        span *= 2
    return rank


def corpus_order(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the texts with one more after each, starts of all windows, their order by content to `width` bytes).

    Prefix-free parsing: symbols are bytes + 1, and 0 ends a text."""
    raw = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    symbols = raw.astype(np.uint64) + np.uint64(1)
    symbols[ends] = 0
    n = len(symbols)
    # Where phrases end: after a trigger that lies in one text, and at a text's end.
    hashed = np.zeros(n, dtype=np.uint64)
    for j in range(CUT_KEY):
        hashed[CUT_KEY - 1 :] += symbols[CUT_KEY - 1 - j : n - j] * np.uint64(pow(BASE, j, 1 << 64))
    cut = mixed(hashed) % np.uint64(CUT_EVERY) == 0
    cut &= np.arange(n) - np.repeat(begins, sizes + 1) >= CUT_KEY - 1
    cut[ends] = True
    stop = np.flatnonzero(cut)
    closes = symbols[stop] == 0
    start = np.concatenate([[0], np.where(closes[:-1], stop[:-1] + 1, stop[:-1] - CUT_KEY + 1)])
    # The dictionary: distinct phrases, one after the other, and the order of their suffixes.
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(symbols * powers(BASE, n), out=sums[1:])
    prints = mixed((sums[stop + 1] - sums[start]) * powers(UNBASE, n)[start] + mixed((stop - start).astype(np.uint64)))
    _, one, kind = np.unique(prints, return_index=True, return_inverse=True)
    lengths = (stop - start + 1)[one]
    offset = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()))
    left = np.repeat(offset + lengths, lengths) - at
    words = np.concatenate([symbols[np.repeat(start[one] - offset, lengths) + at], np.zeros(PACKED, np.uint64)])
    keys = np.zeros(len(at), dtype=np.uint64)
    for j in range(PACKED):
        keys = keys * np.uint64(512) + np.where(left > j, words[j : len(at) + j] + np.uint64(1), np.uint64(0))
    suffix = suffix_ranks(keys, left, PACKED, width)
    # The parse: texts as runs of phrases, in the phrases' order, and the order of its suffixes.
    last = np.searchsorted(stop, ends)  # the phrase that closes each text
    behind = np.repeat(last, np.diff(np.concatenate([[-1], last]))) - np.arange(len(stop)) + 1
    parse = suffix_ranks(suffix[offset[kind]], behind, 1, width)
    follows = np.concatenate([np.where(behind[:-1] > 1, parse[1:] + 1, 0), [0]])
    # Both together: a window's phrase is the last one that has more than a trigger left behind the window's start.
    spans = np.maximum(0, sizes - width + 1)
    starts = np.repeat(begins - np.cumsum(spans) + spans, spans) + np.arange(int(spans.sum()))
    phrase = np.searchsorted(stop - CUT_KEY, starts)
    own = suffix[offset[kind[phrase]] + starts - start[phrase]]
    return raw, starts, np.argsort(own * (len(stop) + 2) + follows[phrase], kind="stable")


def repeated_windows(texts: list[bytes], width: int, slab: int = 1 << 14) -> list[np.ndarray]:
    """Which windows of each text equal another one: neighbours in the texts' order, compared byte by byte."""
    raw, starts, order = corpus_order(texts, width)
    rows = np.lib.stride_tricks.sliding_window_view(raw, width)
    equal = np.zeros(len(starts), dtype=bool)
    for i in range(0, len(order) - 1, slab):
        part = order[i : i + slab + 1]
        own = rows[starts[part]]
        same = (own[1:] == own[:-1]).all(axis=1)
        equal[part[1:][same]] = True
        equal[part[:-1][same]] = True
    return np.split(equal, np.cumsum([max(0, len(t) - width + 1) for t in texts])[:-1])


def repeated_hashes(blocks: list[int], held: list[np.ndarray]) -> list[tuple]:
    """Rows that tell each block which of its windows' hashes are repeated."""
    every = np.concatenate(held)
    kinds, back = np.unique(every[["trigger", "phrase"]].astype(PHRASE), return_inverse=True)
    twice = np.bincount(back, weights=1 + every["state"], minlength=len(kinds)) > 1
    rows, at = [], 0
    for block, own in zip(blocks, held, strict=True):
        told = own[twice[back[at : at + len(own)]]]
        at += len(own)
        if len(told):
            rows.append((block, told.tobytes(), b"", None))
    return rows


def sort_dictionary(width: int, parts: int):
    """Per part: the repeated windows of its sections, told to each one's block."""

    def run(part, table):
        if part[0].as_py() < 0:  # what a block noted for itself
            return pa.table({"block": table.column("block"), "entries": table.column("entries"), "lengths": table.column("lengths"), "bits": table.column("bytes")}, schema=pa.schema(FOUND))
        if part[0].as_py() >= parts:  # hashes of windows
            return rows_of(FOUND, repeated_hashes(table.column("block").to_pylist(), [np.frombuffer(b, COUNT) for b in table.column("entries").to_pylist()]))
        rows = []
        held = []
        for block, entries, lengths, data in zip(*(table.column(c).to_pylist() for c in ("block", "entries", "lengths", "bytes")), strict=True):
            sizes = np.frombuffer(lengths, "<u4").astype(np.int64)
            held.append((block, np.frombuffer(entries, PHRASE), sizes, data, np.cumsum(sizes) - sizes))
        # One trigger after another, so that what is sorted at once stays small: only phrases of one trigger can have equal windows.
        triggers = np.concatenate([h[1]["trigger"] for h in held])
        source = np.repeat(np.arange(len(held)), [len(h[1]) for h in held])
        nth = np.concatenate([np.arange(len(h[1])) for h in held])
        order = np.argsort(triggers, kind="stable")
        answers: list[dict[int, np.ndarray]] = [{} for _ in held]
        size, group = 0, []
        ends = np.concatenate([triggers[order][1:] != triggers[order][:-1], [True]]) if len(order) else []

        def solve() -> None:
            texts = []
            for k, i in group:
                _, _, sizes, data, offset = held[k]
                texts.append(data[offset[i] : offset[i] + sizes[i]])
            for (k, i), own in zip(group, repeated_windows(texts, width), strict=True):
                if own.any():
                    answers[k][i] = own

        for place, end in zip(order, ends, strict=True):
            k, i = int(source[place]), int(nth[place])
            group.append((k, i))
            size += int(held[k][2][i])
            if end and size > 4_000_000 // 8:
                solve()
                size, group = 0, []
        if group:
            solve()
        for (block, entries, _, _, _), own in zip(held, answers, strict=True):
            if own:
                picked = sorted(own)
                rows.append((block, entries[picked].tobytes(), np.array([len(own[i]) for i in picked], "<u4").tobytes(), b"".join(np.packbits(own[i]).tobytes() for i in picked)))
        return rows_of(FOUND, rows)

    return run


OUT = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}


def cut_texts(width: int, key: int):
    """Per block: the bytes its repeated windows cover go."""

    def run(block, docs, found):
        whole, hashes, partly = [], [], {}
        for entries, lengths, bits in zip(*(found.column(c).to_pylist() for c in ("entries", "lengths", "bits")), strict=True):
            if bits is None:
                (whole if lengths is None else hashes).append(np.frombuffer(entries, COUNT))
                continue
            at, packed = 0, np.frombuffer(bits, np.uint8)
            for i, n in enumerate(np.frombuffer(lengths, "<u4").tolist()):
                partly[entries[16 * i : 16 * i + 16]] = np.unpackbits(packed[at : at + (n + 7) // 8], count=n).astype(bool)
                at += (n + 7) // 8
        told = [np.concatenate(whole)] if whole else []
        if partly:
            more = np.zeros(len(partly), COUNT)
            kinds = np.frombuffer(b"".join(partly), PHRASE)
            more["trigger"], more["phrase"], more["state"] = kinds["trigger"], kinds["phrase"], ASKED
            # A phrase that is repeated whole needs no windows.
            told = [more, *told]
        state_of = np.concatenate(told) if told else np.zeros(0, COUNT)
        marked = np.concatenate(hashes) if hashes else np.zeros(0, COUNT)
        marked = np.sort(marked[["trigger", "phrase"]].astype(PHRASE))
        parser = Parser(width, key)
        rows: tuple[list, ...] = ([], [], [], [])
        for _, texts in parser.chunks(docs.column("body").to_pylist()):
            data, ends, first, last, phrases = parser.parse(texts)
            change = np.zeros(len(data) + 1, dtype=np.int32)
            if len(phrases) and len(state_of):
                state = states_of(phrases, state_of)
                repeated = state & REPEATED > 0
                np.add.at(change, first[repeated], 1)
                np.add.at(change, last[repeated] + width, -1)
                for i in np.flatnonzero(state == ASKED):
                    starts = first[i] + np.flatnonzero(partly[phrases[i].tobytes()])
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + width, -1)
                for i in np.flatnonzero(state == HOT) if len(marked) else ():
                    starts = first[i] + np.flatnonzero(np.isin(windows_of(parser, first[i], last[i], phrases[i])["phrase"], marked["phrase"][np.searchsorted(marked["trigger"], phrases["trigger"][i]) : np.searchsorted(marked["trigger"], phrases["trigger"][i], "right")]))
                    np.add.at(change, starts, 1)
                    np.add.at(change, starts + width, -1)
            gone = np.cumsum(change[:-1]) > 0
            raw = np.frombuffer(data, np.uint8)
            begin = 0
            for end in ends.tolist():
                own = gone[begin:end]
                removed = int(np.count_nonzero(own))
                spans = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(bool(len(own)) and bool(own[0]))
                kept = raw[begin:end][~own].tobytes() if removed else data[begin:end]
                for column, value in zip(rows, (end - begin, removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    column.append(value)
                begin = end
        kinds = list(OUT.items())[1:]
        return pa.table({"doc_id": docs.column("doc_id")} | {n: pa.array(v, k) for (n, k), v in zip(kinds, rows, strict=True)})

    return run


def remove_repeats(docs: DataFrame, width: int = 200, key: int = 100, block_bytes: int = 24_000_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    rows = docs.select("doc_id", utf8(F.col("text")).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body")).alias("n")).first()["n"] or 0
    blocks = partitions_for(size, block_bytes, 1)
    parts = partitions_for(size, block_bytes // 2, 12)
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.substring("body", 1, 64)), F.lit(blocks)))
    by_block = placed.groupBy("block")
    counted = by_block.applyInArrow(released(count_phrases(width, key, parts)), schema(COUNTED))
    told = counted.groupBy("part").applyInArrow(released(settle_phrases), schema(TOLD))
    entries = by_block.cogroup(told.groupBy("block")).applyInArrow(released(write_dictionary(width, key, parts)), schema(ENTRIES))
    found = entries.groupBy("part").applyInArrow(released(sort_dictionary(width, parts)), schema(FOUND))
    return by_block.cogroup(found.groupBy("block")).applyInArrow(released(cut_texts(width, key)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
