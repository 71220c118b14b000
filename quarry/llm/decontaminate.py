"""Benchmark decontamination: an FM-index per training shard, searched backwards for the benchmark's windows.

A shard is a bounded run of documents. Its text for the index is the words that the benchmark knows, as codes; a word
that it doesn't know ends a stretch, and stretches shorter than the shortest window hold no occurrence and are left
out, so nothing is lost. All windows are searched at once through wavelet-tree ranks; occurrences are located by
sampled suffix positions and merged to removal spans. The benchmark is a query set: it is taken in blocks of bounded
size, all broadcast; the one pass over the rows opens a block, searches a run of documents for it and closes it before
the next, so neither a worker nor the driver holds more than one. Documents never move.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.fm_index import FMIndex
from quarry.llm.frames import text_bytes, unused
from quarry.llm.words import ALPHANUMERIC, bounded, slices, split

WINDOW = 10
#: Windows of a block take some 70 times the bytes of its texts while they are sorted, and 16 times when broadcast.
BLOCK_BYTES = 4 << 20
SHARD_WORDS = 400_000
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class Phrases:
    """The windows of some benchmark items, by length, and the items of each window."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        names = sorted({i for i, _ in items})
        code_of = {i: k for k, i in enumerate(names)}
        self.items = names
        texts = pa.array([t for _, t in items], pa.large_string())
        found = list(slices(texts, 1 << 62))
        self.vocabulary = pa.array([], pa.large_binary())
        self.by_length: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.shortest = 1
        if not found:
            return
        words = split(found[0][2], found[0][3], ALPHANUMERIC, lower=True)
        coded = words.array().dictionary_encode()
        self.vocabulary = coded.dictionary
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 2
        owner = np.array([code_of[i] for i, _ in items], np.int64)
        count = np.diff(words.rows)
        for n in sorted({min(int(c), window) for c in count if c}):
            of = np.flatnonzero(count >= window) if n == window else np.flatnonzero(count == n)
            many = count[of] - n + 1
            at = np.repeat(words.rows[of] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            whole = codes[at[:, None] + np.arange(n)]
            distinct, back = np.unique(whole, axis=0, return_inverse=True)
            pairs = np.unique(np.stack([back.ravel(), np.repeat(owner[of], many)]), axis=1)
            self.by_length.append((distinct, np.searchsorted(pairs[0], np.arange(len(distinct) + 1)), pairs[1]))
        if self.by_length:
            self.shortest = self.by_length[0][0].shape[1]

    def find(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(position, length) of each occurrence in the text of a shard; (position, item) of each item's windows."""
        index = FMIndex(text, len(self.vocabulary) + 1)
        at, length, item_at, item = [], [], [], []
        for distinct, first, owner in self.by_length:
            which, low, high = index.search(distinct)
            places = index.locate(low, high)
            window = np.repeat(which, high - low)
            at.append(places)
            length.append(np.full(len(places), distinct.shape[1]))
            many = first[window + 1] - first[window]
            item_at.append(np.repeat(places, many))
            item.append(owner[np.repeat(first[window] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if len(window) else owner[:0])
        return tuple(np.concatenate(x).astype(np.int64) for x in (at, length, item_at, item))


def _stretches(known: np.ndarray, rows: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the runs of known words within rows, where a window may fit."""
    begin = known.copy()
    begin[1:] &= ~known[:-1]
    heads = rows[:-1][np.diff(rows) > 0]
    begin[heads] = known[heads]
    end = known.copy()
    end[:-1] &= ~known[1:]
    tails = heads - 1
    tails = tails[tails >= 0]
    end[tails] |= known[tails]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    long = b - a >= shortest
    return a[long], b[long]


def _merge_spans(row: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((first, row))
    row, first, end = row[order], first[order], end[order]
    if not len(row):
        return row, first, end
    reach = np.maximum.accumulate(row * (1 << 40) + end)
    new = np.ones(len(row), bool)
    new[1:] = row[1:] * (1 << 40) + first[1:] > reach[:-1]
    new[1:] |= row[1:] != row[:-1]
    at = np.flatnonzero(new)
    return row[at], first[at], np.concatenate([reach[at[1:] - 1], reach[-1:]]) % (1 << 40)


def _search_batch(text: pa.Array, phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[list[str]]]:
    """(number of words, merged spans of word places (n, 2), items) of each row."""
    n = len(text)
    n_words, spans, items = np.zeros(n, np.int64), [np.zeros((0, 2), np.int64)] * n, [[] for _ in range(n)]
    held: list[tuple] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            codes, row, first = (np.concatenate(x) for x in zip(*held))
            # codes hold a 1 after each stretch; row and first tell where each code's word stands
            at, length, item_at, item = phrases.find(codes)
            r, a, b = _merge_spans(row[at], first[at], first[at] + length)
            cuts = np.flatnonzero(np.diff(r)) + 1
            for rr, aa, bb in zip(np.split(r, cuts), np.split(a, cuts), np.split(b, cuts)):
                if len(rr):
                    spans[rr[0]] = np.stack([aa, bb], axis=1)
            for rr, ii in np.unique(np.stack([row[item_at], item]), axis=1).T.tolist():
                items[rr].append(phrases.items[ii])
        held, size = [], 0

    for start, end, raw, offs in slices(text):
        words = split(raw, offs, ALPHANUMERIC, lower=True)
        n_words[start:end] = np.diff(words.rows)
        if not phrases.by_length or not len(words):
            continue
        codes = pc.index_in(words.array(), phrases.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        a, b = _stretches(codes > 1, words.rows, phrases.shortest)
        if not len(a):
            continue
        n_in = b - a + 1
        place = np.repeat(a - np.concatenate([[0], np.cumsum(n_in)[:-1]]), n_in) + np.arange(n_in.sum())
        closing = np.cumsum(n_in) - 1
        in_text = codes[np.minimum(place, len(codes) - 1)]
        in_text[closing] = 1
        row = np.repeat(np.searchsorted(words.rows, a, side="right") - 1, n_in)
        held.append((in_text, row + start, place - words.rows[row]))
        size += len(in_text)
        if size >= SHARD_WORDS:
            flush()
    flush()
    return n_words, spans, items


def cut_spans(text: str, spans: list) -> str:
    """text without the words of the spans and what stands between them."""
    raw = text.encode()
    words = [m.span() for m in _WORD.finditer(raw)]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : words[a][0]])
        at = words[b - 1][1]
    return b"".join([*out, raw[at:]]).decode()


_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType())]))


def find_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, remove: bool = False, names: list[str] | None = None) -> DataFrame:
    """docs with n_words, spans (word places of removal spans, merged) and items (item ids as strings, sorted), or three
    other names, which docs must not have.

    A window is that many consecutive words of an item, or the whole item if shorter; items without words have none.
    Null texts have no words. A null item id is the item "null"; rows of one item id are one item. The benchmark is
    read in blocks of about block_bytes, so any size of it is searched whole. remove: cut the spans out of the texts, too.
    """
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("id"), F.col(item_text_col).alias("text"))
    blocks = max(1, -(-text_bytes(items, "text") // block_bytes))
    n_words, spans, items_of = names = names or ["n_words", "spans", "items"]
    out = docs.withColumns({n_words: F.lit(0).cast("long"), spans: F.array().cast(_SPANS), items_of: F.array().cast("array<string>")})
    held = []
    for b in range(blocks):
        part = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == b)
        held.append(docs.sparkSession.sparkContext.broadcast(Phrases([(r[0], r[1]) for r in part.collect()], window)))
        _closed(held[-1], blocks)
    return out.mapInArrow(_annotate(held, text_col, names, remove), out.schema)


def _closed(block, blocks: int) -> None:
    """Lets go of the copy of a broadcast block that this process holds, where there are more and it can be read again
    from its file."""
    if blocks > 1 and getattr(block, "_path", None) is not None:
        block.__dict__.pop("_value", None)


def _annotate(blocks: list, text_col: str, names: list[str], remove: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            yield from map(one, bounded([first], first.schema.get_field_index(text_col)))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.schema.get_field_index(text_col)
        for k, block in enumerate(blocks):
            n_words, own_spans, own_items = _search_batch(batch.column(column), block.value)
            _closed(block, len(blocks))
            if not k:
                spans, items = own_spans, own_items
                continue
            for i in (i for i, x in enumerate(own_items) if x):
                both = np.concatenate([spans[i], own_spans[i]])
                _, a, e = _merge_spans(np.zeros(len(both), np.int64), both[:, 0], both[:, 1])
                spans[i], items[i] = np.stack([a, e], axis=1), list({*items[i], *own_items[i]})
        offsets = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
        flat = np.concatenate(spans)
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["first", "end"])
        new = {names[0]: pa.array(n_words), names[1]: pa.ListArray.from_arrays(pa.array(offsets), pairs), names[2]: pa.array([sorted(x) for x in items], pa.list_(pa.string()))}
        if remove and len(flat):
            texts = batch.column(column).to_pylist()
            for i, s in enumerate(spans):
                if len(s):
                    texts[i] = cut_spans(texts[i], s.tolist())
            new[text_col] = pa.array(texts, batch.schema.field(column).type)
        return pa.RecordBatch.from_arrays([new.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)], names=batch.schema.names)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans; see find_spans()."""
    found = find_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, window=window)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with the removal spans cut out of the text, columns as they were. A text without a hit, null included, stays
    unchanged; a document of which no word is left is dropped. Other columns keep their values."""
    names = unused(docs, "n_words", "spans", "items")
    found = find_spans(docs, benchmark, text_col=text_col, window=window, remove=True, names=names)
    hit = F.aggregate(names[1], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    return found.filter((F.size(names[1]) == 0) | (hit < F.col(names[0]))).drop(*names)


_TOKENS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
with it as (select cast(item_id as varchar) as item, {_TOKENS} as w from benchmark),
iw as (select distinct item, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as g
       from it, unnest(range(1, greatest(len(w) - 9, 1) + 1)) u(i) where len(w) > 0),
d as (select doc_id, coalesce({_TOKENS}, []) as w from documents),
dw as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g
       from d, (select distinct n from iw) l, unnest(range(1, len(w) - n + 2)) u(i) where len(w) >= n),
occ as (select doc_id, n, i, item from dw join iw using (n, g)),
hit as (select doc_id, count(distinct i + k) as n_hit from occ, unnest(range(0, n)) v(k) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from occ) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""
