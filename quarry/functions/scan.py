"""Trigrams and MinHash signatures of whole texts, in Arrow batches a few rows at a time: what a worker holds beside the
batch follows neither the number of its rows nor their length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import minhash

#: Bytes of text that are looked at together; a longer text is alone.
SLICE_BYTES = 1 << 20
#: A byte as a lower-cased ASCII letter or digit, others 0.
_PLAIN = np.array([ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 0 for b in range(256)], np.uint8)


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes as in _PLAIN, where each row begins and the last ends) of some rows at a time."""
    texts = pa.concat_arrays([texts.fill_null("").cast(pa.large_string())])
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + SLICE_BYTES, side="right")) - 1)
        yield _PLAIN[raw[offs[at] : offs[end]]], offs[at : end + 1] - offs[at]
        at = end


def _runs(plain: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, row) of each run of letters and digits within a row."""
    edge = np.zeros(len(plain) + 1, bool)
    edge[offs] = True
    is_ = plain > 0
    before, after = np.zeros_like(is_), np.zeros_like(is_)
    before[1:], after[:-1] = is_[:-1], is_[1:]
    begin = np.flatnonzero(is_ & (~before | edge[:-1]))
    end = np.flatnonzero(is_ & (~after | edge[1:])) + 1
    return begin, end, np.searchsorted(offs, begin, side="right") - 1


def _fnv(state: np.ndarray, flat: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FNV-1a of n bytes from begin, going on from state. Longest first, so what goes on is always a prefix."""
    order = np.argsort(-n, kind="stable")
    h, at, many = state[order], begin[order], n[order]
    live = len(many) - np.searchsorted(many[::-1], np.arange(1, int(many[0]) + 1 if len(many) else 1))
    for i, k in enumerate(live.tolist()):
        h[:k] = (h[:k] ^ flat[at[:k] + i]) * np.uint64(minhash.FNV_PRIME)
    out = np.empty_like(h)
    out[order] = h
    return out


def signatures_of(texts: pa.Array) -> np.ndarray:
    """minhash.signature_of() the set of two consecutive tokens, joined by a blank, of each text."""
    a, b = minhash.permutations()
    out = [np.zeros((0, minhash.SIZE), np.uint64)]
    for plain, offs in _slices(texts):
        begin, end, row = _runs(plain, offs)
        long = end - begin >= 3
        begin, n, row = begin[long], (end - begin)[long], row[long]
        word = _fnv(np.full(len(begin), minhash.FNV_START, np.uint64), plain, begin, n)
        pair = np.flatnonzero(row[1:] == row[:-1])
        blank = (word[pair] ^ np.uint64(32)) * np.uint64(minhash.FNV_PRIME)
        count = np.bincount(row, minlength=len(offs) - 1)
        alone = np.flatnonzero(count[row] == 1)
        of = np.concatenate([row[pair], row[alone]])
        order = np.argsort(of, kind="stable")
        h = np.concatenate([_fnv(blank, plain, begin[pair + 1], n[pair + 1]), word[alone]])[order]
        found, first = np.unique(of[order], return_index=True)
        least = np.full((len(offs) - 1, minhash.SIZE), minhash._MASK, np.uint64)
        if len(found):
            for p in range(minhash.SIZE):
                least[found, p] = np.minimum.reduceat(h * a[p] + b[p], first)
        out.append(least)
    return np.concatenate(out)


@F.arrow_udf(T.ArrayType(T.LongType()))
def _signatures(texts: pa.Array) -> pa.Array:
    found = signatures_of(texts)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * minhash.SIZE), pa.array(found.view(np.int64).ravel()))


def signature(s: Column) -> Column:
    """minhash.signature(text.shingles(text.tokens(s)))."""
    return _signatures(s)


def trigrams_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, where those of each text begin): each text's set of text.char_ngrams() of three bytes, as numbers."""
    codes, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for plain, offs in _slices(texts):
        begin, _, row = _runs(plain, offs)
        at = np.flatnonzero(plain)
        rows, first = np.unique(row, return_index=True)  # rows with any run, and its first run
        run = np.zeros(len(plain) + 1, np.int64)
        run[begin] = 1
        run = np.cumsum(run)[at]  # from 1
        before = np.searchsorted(first, run - 1, side="right") - 1  # filled rows before this one
        place = np.arange(len(at)) + run + before
        flat = np.full(len(at) + len(begin) + len(rows), 32, np.int32)
        flat[place] = plain[at]
        start = np.append(np.searchsorted(at, begin[first]) + first + np.arange(len(rows)), len(flat))
        code = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
        of = np.repeat(np.arange(len(rows)), np.diff(start))
        whole = of[:-2] == of[2:]
        key = np.unique((of[:-2][whole] << 24) | code[whole])
        codes.append((key & 0xFFFFFF).astype(np.int32))
        many = np.zeros(len(offs) - 1, np.int64)
        many[rows] = np.bincount(key >> 24, minlength=len(rows))
        counts.append(many)
    return np.concatenate(codes), np.cumsum(np.concatenate(counts))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _trigrams(texts: pa.Array) -> pa.Array:
    codes, bounds = trigrams_of(texts)
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(codes))


def trigram_codes(s: Column) -> Column:
    """The set text.trigram_codes(s), in order."""
    return _trigrams(s)
