"""Identities: text and row hashes that don't depend on the engine."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Multipliers of the 32-bit mixer and of the numbers that are drawn for (small enough for signed 64-bit products).
MIXER, STRIDE = 73_244_475, 2_654_435_769


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def match_identity(*parts: Column) -> Column:
    """The hash of the trimmed, lower-cased parts; scores are left out so that a correction keeps the identity."""
    return F.sha2(F.concat_ws("|", *[F.lower(F.trim(p)) for p in parts]), 256)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A compact JSON object with its keys in order; numbers and strings by Spark's writer."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def hash_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the parts' SHA-256: the same in any engine."""
    digits = F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 48)


def uniform_text(*parts: object) -> float:
    """hash_uniform of these parts, in Python."""
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:12], 16) / float(1 << 48)


def draw_seed(seed: str) -> int:
    return int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16)


def mixed32(x: Column) -> Column:
    for _ in range(2):
        x = x.bitwiseXOR(F.shiftright(x, 16)) * F.lit(MIXER).cast("long") % F.lit(1 << 32)
    return x.bitwiseXOR(F.shiftright(x, 16))


def draw_uniform(seed: str, sim: Column, number: Column) -> Column:
    """A number in [0, 1) for each (simulation, what is drawn): 32-bit counter hashing, the same in any engine."""
    stream = mixed32((sim.cast("long") + draw_seed(seed)) % F.lit(1 << 32))
    return mixed32((stream + F.pmod(number.cast("long"), F.lit(1 << 31)) * F.lit(STRIDE)) % F.lit(1 << 32)) / float(1 << 32)


def draw_uniforms(seed: str, sims: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """draw_uniform of every simulation (rows) and number (columns)."""

    def mix(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = (x ^ (x >> np.uint64(16))) * np.uint64(MIXER) & np.uint64(0xFFFFFFFF)
        return x ^ (x >> np.uint64(16))

    stream = mix((sims.astype(np.uint64) + np.uint64(draw_seed(seed))) & np.uint64(0xFFFFFFFF))
    steps = (numbers % (1 << 31)).astype(np.uint64) * np.uint64(STRIDE)
    return mix((stream[:, None] + steps[None, :]) & np.uint64(0xFFFFFFFF)) / float(1 << 32)
