"""MinHash signatures over FNV-1a-64 with wrapping 64-bit arithmetic, in Arrow batches."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIZE = 64
#: FNV-1a of 64 bits, and the generator that the permutations' factors come from.
FNV_START, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
SEED, FACTOR, STEP = 0x9E3779B97F4A7C15, 6364136223846793005, 1442695040888963407
_MASK = (1 << 64) - 1


@functools.cache
def permutations(size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    a, b, s = [], [], SEED
    for _ in range(size):
        s = (s * FACTOR + STEP) & _MASK
        a.append(s | 1)
        s = (s * FACTOR + STEP) & _MASK
        b.append(s)
    return np.array(a, np.uint64), np.array(b, np.uint64)


def fnv1a(strings: list[str]) -> np.ndarray:
    """Hash of each string's UTF-8, all strings a byte at a time."""
    raw = [s.encode() for s in strings]
    n = np.array([len(r) for r in raw], np.int64)
    h = np.full(len(raw), FNV_START, np.uint64)
    if not len(raw):
        return h
    flat, at = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum(n)[:-1]])
    live = np.flatnonzero(n)
    i = 0
    while len(live):
        h[live] = (h[live] ^ flat[at[live] + i]) * np.uint64(FNV_PRIME)
        i += 1
        live = live[n[live] > i]
    return h


def signature_of(strings: list[str], size: int = SIZE) -> np.ndarray:
    """Least value of each permutation; of an empty set all ones."""
    a, b = permutations(size)
    out = np.full(size, _MASK, np.uint64)
    h = fnv1a(strings)
    for at in range(0, len(h), 4096):
        out = np.minimum(out, (h[at : at + 4096, None] * a + b).min(axis=0))
    return out


@F.pandas_udf(T.ArrayType(T.LongType()))
def _signatures(sets: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in sets:
        yield pd.Series([signature_of(list(x) if x is not None else []).view(np.int64) for x in s])


def signature(shingle_set: Column) -> Column:
    """64 slots as longs of the same bits; only equality of slots is used downstream."""
    return _signatures(shingle_set)


def similarity(a: Column, b: Column) -> Column:
    """Share of equal slots."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / F.size(a)


def bands(sig: Column, threshold: float, size: int = SIZE) -> Column:
    """Keys of which two signatures at the threshold share one at least: more bands than slots that may differ."""
    need = -(-int(round(threshold * size * 1e9)) // 10**9)
    n = size - need + 1
    cuts = [size * i // n for i in range(n + 1)]
    return F.array(*[F.xxhash64(F.lit(i), *[F.element_at(sig, k + 1) for k in range(x, y)]) for i, (x, y) in enumerate(zip(cuts, cuts[1:]))])
