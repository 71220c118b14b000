"""Words of whole texts as flat numpy and Arrow buffers, a bounded slice of a batch at a time.

A slice is a run of rows whose texts hold about SLICE_BYTES together; a text longer than that is a slice of its
own, so memory follows the longest text and never the batch. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 2 << 20

#: Byte tables: 1 where a byte belongs to a word. Every byte of a non-ASCII character is 0x80 or more.
_BYTES = np.arange(256)
NON_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
ALPHANUMERIC = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows in them) of a string or binary column; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if offsets is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of bounded runs of rows."""
    raw, offs = text_buffers(column)
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
        yield at, end, raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def bounded(batches: Iterable[pa.RecordBatch], column: int = 1, size: int = 4 * SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about so many bytes of a text column, so a worker's memory follows neither
    the number nor the length of a batch's rows."""
    for batch in batches:
        at, n = 0, len(batch)
        offs = text_buffers(batch.column(column))[1] if n else None
        while at < n:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


@dataclass
class Words:
    """Words of some rows. text: each word followed by one blank. at: where words begin in it, and its length.
    rows: where the words of each row begin among all words, and their number."""

    text: np.ndarray
    at: np.ndarray
    rows: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def array(self) -> pa.Array:
        """The words as Arrow strings, each with the blank after it."""
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.at.astype(np.int64)), pa.py_buffer(self.text)])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))


def split(raw: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool = False) -> Words:
    """Words of the rows: maximal runs of bytes that table marks; no word crosses a row."""
    buf = np.insert(raw, offs[1:], 0x20)
    ends_of_rows = offs[1:] + np.arange(len(offs) - 1)
    if lower:
        buf = LOWER[buf]
    word = table[buf]
    after = np.zeros(len(word), bool)
    after[1:] = word[:-1] & ~word[1:]
    last = np.flatnonzero(after)
    keep = word | after
    text = buf[keep]
    text[~word[keep]] = 0x20
    at = np.zeros(len(last) + 1, np.int64)
    at[1:] = np.cumsum(keep)[last] if len(last) else 0
    rows = np.zeros(len(offs), np.int64)
    rows[1:] = np.searchsorted(last, ends_of_rows, side="right")
    return Words(text, at, rows)


#: Odd multiplier of the rolling hash and its inverse modulo 2**64; a value for each byte.
_STEP = 0x9FB21C651E98DF25
_BACK = pow(_STEP, -1, 1 << 64)
_OF_BYTE = np.array([xxhash.xxh3_64_intdigest(bytes([b]), 7) for b in range(256)], np.uint64)


def powers(base: int, n: int, _kept: dict[int, np.ndarray] = {}) -> np.ndarray:  # noqa: B006
    """base**0 to base**(n - 1) modulo 2**64, n at least; what is kept is bounded by a slice's length."""
    have = _kept.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(10, int(n).bit_length()), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) <= 4 * SLICE_BYTES:
            _kept[base] = have
    return have


def hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of each word; different words may share one, so exact uses verify."""
    n = len(words.text)
    if not len(words):
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_OF_BYTE[words.text] * powers(_STEP, n)[:n], out=total[1:])
    at = words.at
    return mix((total[at[1:]] - total[at[:-1]]) * powers(_BACK, n)[at[:-1]])


def rolled(values: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n consecutive values."""
    size = len(values)
    if size < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(size + 1, np.uint64)
    np.cumsum(values * powers(_STEP, size)[:size], out=total[1:])
    return mix((total[n:] - total[:-n]) * powers(_BACK, size)[: size - n + 1])


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that leaves no order among them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i + 1]] for each i; 0 for an empty run."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
