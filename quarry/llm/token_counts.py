"""Token counts of a byte-level BPE by prefix dynamic programming.

A text is cut to the pattern's pieces; the pieces of a batch, distinct and sorted, are walked as a trie whose states
hold the number of tokens at every prefix. A text's count is a sum over its pieces; the count of any prefix is a sum
and one state, so truncation and budget questions need no encoding.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import PrefixBPE, byte_level
from quarry.llm.frames import whole_id
from quarry.llm.words import bounded, slices, sums, text_buffers

LIMIT = 512
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: The white space of Unicode outside the separator categories, and contractions by length.
_CONTROL_SPACE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85)
_SHORT, _LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")


@functools.cache
def _classes() -> np.ndarray:
    kind = {"L": _LETTER, "N": _NUMBER, "Z": _SPACE}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(_CONTROL_SPACE)] = _SPACE
    return out


@functools.cache
def encoder(path: str) -> tuple[PrefixBPE, tuple[str, ...]]:
    return byte_level(path)


def _specials(raw: bytes, offs: np.ndarray, specials: tuple[str, ...]) -> list[tuple[int, int]]:
    """Byte ranges of special strings within rows, the leftmost first and of those the longest."""
    found = []
    names = sorted((s.encode() for s in specials), key=len, reverse=True)
    if not any(s in raw for s in names):
        return found
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        while True:
            hits = [(k, -len(s)) for s in names if (k := raw.find(s, a, b)) >= 0]
            if not hits:
                break
            k, n = min(hits)
            found.append((k, k - n))
            a = k - n
    return found


def pieces(raw: np.ndarray, offs: np.ndarray, specials: tuple[str, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte offsets of the pieces, where those of each row begin, whether each is a special string). The pieces are
    those of the pattern that goes with byte-level vocabularies, found by comparing neighbouring characters."""
    data = raw.tobytes()
    char_at = np.flatnonzero((raw & 0xC0) != 0x80)
    cps = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    cls, n = _classes()[cps], len(cps)
    special = _specials(data, offs, specials)
    edge = np.zeros(n + 1, bool)
    bounds = np.unique(np.concatenate([offs, np.array([x for s in special for x in s], np.int64)]))
    edge[np.searchsorted(char_at, bounds)] = True
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(len(offs), np.int64), np.zeros(0, bool)
    run = edge[:n].copy()
    run[1:] |= cls[1:] != cls[:-1]
    new = run.copy()
    after_space = np.zeros(n, bool)
    after_space[1:] = run[1:] & ~edge[1:n] & (cls[1:] != _SPACE) & (cls[:-1] == _SPACE)
    at = np.flatnonzero(after_space)
    new[at - 1] = True
    new[at[cps[at - 1] == 0x20]] = False
    quote = np.flatnonzero((cps == 0x27) & new & run)
    quote = quote[quote + 1 < n]
    quote = quote[run[quote + 1] & ~edge[quote + 1] & (cls[quote + 1] == _LETTER)]
    if len(quote):
        one = cps[quote + 1]
        two = np.where((quote + 2 < n) & ~edge[np.minimum(quote + 2, n)], cps[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in _SHORT])
        long = ~short & np.any([(one == ord(c[0])) & (two == ord(c[1])) for c in _LONG], axis=0)
        new[quote[short | long] + 1] = False
        for hit, size in ((quote[short], 2), (quote[long], 3)):
            end = hit + size
            new[end[end < n]] = True
    starts = np.flatnonzero(new)
    is_special = np.zeros(0, bool)
    if special:
        inside = np.zeros(n, bool)
        for a, b in special:
            inside[np.searchsorted(char_at, a) + 1 : np.searchsorted(char_at, b)] = True
        starts = starts[~inside[starts]]
        is_special = np.isin(char_at[starts], [a for a, _ in special])
    at_byte = char_at[starts]
    return np.append(at_byte, len(raw)), np.searchsorted(at_byte, offs), is_special if special else np.zeros(len(starts), bool)


def count_tokens(column: pa.Array, encoder: PrefixBPE, specials: tuple[str, ...]) -> np.ndarray:
    """Tokens of each text of a column. A batch's distinct pieces are walked once."""
    coded, distinct = [], []
    for start, end, raw, offs in slices(column):
        at, rows, special = pieces(raw, offs, specials)
        array = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        coded.append((start, end, array.indices.to_numpy(zero_copy_only=False), rows, special))
        distinct.append(array.dictionary)
    n = np.zeros(len(column), np.int64)
    if not coded:
        return n
    every = pc.unique(pa.chunked_array(distinct))
    order = pc.sort_indices(every).to_numpy()
    counts = np.zeros(len(every), np.int64)
    counts[order] = np.fromiter((c[-1] for _, _, c in encoder.walk(every.take(pa.array(order)).to_pylist())), np.int64, len(every))
    for (start, end, codes, rows, special), own in zip(coded, distinct):
        of = counts[pc.index_in(own, every).to_numpy()][codes]
        of[special] = 1
        n[start:end] = sums(of, rows)
    return n


def prefix_counts(text: str, encoder: PrefixBPE, specials: tuple[str, ...] = ()) -> np.ndarray:
    """Tokens of text[:i] for each i from 0 to len(text), special strings handled as in whole texts."""
    out, total, at = np.zeros(len(text) + 1, np.int64), 0, 0
    bounds = _specials(text.encode(), np.array([0, len(text.encode())]), specials)
    raw = text.encode()
    chars = [(len(raw[:a].decode()), len(raw[:b].decode())) for a, b in bounds]
    for a, b in [*chars, (len(text), len(text))]:
        upto = max(a, b - 1)
        out[at : upto + 1] = total + _plain_prefixes(text[at:upto], encoder)
        total = int(out[a]) + (b > a)
        out[b] = total
        at = b
    return out


def _plain_prefixes(text: str, encoder: PrefixBPE) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    at, _, _ = pieces(raw, np.array([0, len(raw)]))
    char_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    out, total, data = np.zeros(len(text) + 1, np.int64), 0, raw.tobytes()
    c = 0
    spaces = 0  # first character of the white space before here, where a prefix may end
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        piece = data[a:b]
        (state,) = ([*s] for _, _, s in encoder.walk([piece]))
        word = piece.decode()
        contraction = len(word) == 3 and word[0] == "'" and word[1:] in _LONG
        for i, ch in enumerate(word, 1):
            k = int(char_at[c + i]) - a
            if ch.isspace() and ch not in "\x1c\x1d\x1e\x1f":
                if not (c + i - 1 > spaces and _is_space(text[c + i - 2])):
                    spaces = c + i - 1
                run = text[spaces : c + i].encode()
                (tail,) = ([*s] for _, _, s in encoder.walk([run]))
                out[c + i] = out[spaces] + tail[-1]
            else:
                out[c + i] = total + (2 if contraction and i == 2 else state[k])
        total += state[-1]
        c += len(word)
    return out


def _is_space(ch: str) -> bool:
    return ch.isspace() and ch not in "\x1c\x1d\x1e\x1f"


def fitting_prefix(text: str, budget: int, encoder: PrefixBPE, specials: tuple[str, ...] = ()) -> int:
    """The most characters of text whose prefix has at most budget tokens."""
    return int(np.flatnonzero(prefix_counts(text, encoder, specials) <= budget)[-1]) if budget >= 0 else 0


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit, as the tokenizers library counts for the
    byte-level BPE file at path, which each executor reads. Null texts count as empty: no tokens. Repeated rows and null
    ids stay. Other columns are ignored; no rows give no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, specials = encoder(path)
        for batch in bounded(batches):
            n_bytes = np.diff(text_buffers(batch.column(1))[1])
            n = count_tokens(batch.column(1), coder, specials)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def truncate(docs: DataFrame, path: str, budget: int = LIMIT, text_col: str = "text") -> DataFrame:
    """docs with text cut to the longest prefix of at most budget tokens, read from prefix counts; columns as they
    were. Null texts stay null."""
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, specials = encoder(path)
        for batch in bounded(batches, at):
            over = np.flatnonzero(count_tokens(batch.column(at), coder, specials) > budget)
            if len(over):
                texts = batch.column(at).to_pylist()
                for i in over.tolist():
                    texts[i] = texts[i][: fitting_prefix(texts[i], budget, coder, specials)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
