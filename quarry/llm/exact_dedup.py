"""Exact dedup: a tree of merges over sorted runs of digests.

Each partition sorts its digests once, into a run with one entry per text. Then nodes exchange runs in binomial rounds: in
round r a node keeps the entries whose home has its own r-th bit, and sends the others to the node that differs from it
in that bit. The runs that meet at a node are merged as they are, two and two by where each entry falls in the other
run; none is sorted again. Entries of one text, verified by its length and a second hash, become one at each merge and
keep the identifier that stays and the number of rows. So a text that a third of all rows share is one entry a run from
the first merge on, a node's run shrinks to its share of distinct texts, and texts themselves never move.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import cut, partitions, spread_join, unused, whole_id

RUN_ROWS = 500_000
#: Rows for each node that takes part, up to as many nodes as a shuffle has partitions.
NODE_ROWS = 1 << 14
_KEY = ["digest", "check", "size"]
_DIGEST, _BYTES = 32, 48
_PACKED = "node long, keys binary, ids binary, there binary, many binary"


@dataclass
class Run:
    """Entries in the order of keys, each key once. key: digest, second hash and length, as bytes. there: whether any row
    had an identifier, and so whether id is one. many: rows."""

    key: np.ndarray
    id: np.ndarray
    there: np.ndarray
    many: np.ndarray

    def take(self, which: np.ndarray) -> Run:
        return Run(self.key[which], self.id[which], self.there[which], self.many[which])

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.key, self.id, self.there, self.many)]


def unpacked(keys, ids, there, many) -> Run:
    return Run(np.frombuffer(keys, f"S{_BYTES}"), np.frombuffer(ids, np.int64), np.frombuffer(there, bool), np.frombuffer(many, np.int64))


def _better(keep: str, a: np.ndarray, a_there: np.ndarray, b: np.ndarray, b_there: np.ndarray) -> np.ndarray:
    """Of paired identifiers the one that stays."""
    both = np.maximum(a, b) if keep == "max" else np.minimum(a, b)
    return np.where(a_there & b_there, both, np.where(a_there, a, b))


def merged(a: Run, b: Run, keep: str) -> Run:
    """Two runs as one. Each entry of b falls on its equal in a, or before the first larger one."""
    if not len(a.key) or not len(b.key):
        return a if len(a.key) else b
    at = np.searchsorted(a.key, b.key)
    near = np.minimum(at, len(a.key) - 1)
    same = a.key[near] == b.key
    to, new = near[same], ~same
    out = Run(a.key, a.id.copy(), a.there.copy(), a.many.copy())
    out.id[to] = _better(keep, a.id[to], a.there[to], b.id[same], b.there[same])
    out.there[to] |= b.there[same]
    out.many[to] += b.many[same]
    return Run(*(np.insert(x, at[new], y[new]) for x, y in ((out.key, b.key), (out.id, b.id), (out.there, b.there), (out.many, b.many))))


def merged_all(runs: list[Run], keep: str) -> Run:
    """Any number of runs as one: neighbours are merged until one is left."""
    while len(runs) > 1:
        runs = [merged(runs[i], runs[i + 1], keep) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0]


def sorted_run(batches: list[pa.RecordBatch], keep: str) -> Run:
    """The rows (digest, check, size, id) of some batches as a run: the one sort."""
    column = lambda i, t: np.concatenate([b.column(i).to_numpy(zero_copy_only=False).astype(t) for b in batches])
    raw = b"".join(b"".join(b.column(0).to_pylist()) for b in batches)
    n = len(raw) // _DIGEST
    key = np.zeros((n, _BYTES), np.uint8)
    key[:, :_DIGEST] = np.frombuffer(raw, np.uint8).reshape(n, _DIGEST)
    for i, at in ((1, _DIGEST), (2, _DIGEST + 8)):
        key[:, at : at + 8] = column(i, np.int64).astype(">i8").view(np.uint8).reshape(n, 8)
    key = key.reshape(-1).view(f"S{_BYTES}")
    there = np.concatenate([b.column(3).is_valid().to_numpy(zero_copy_only=False) for b in batches])
    ids = np.concatenate([b.column(3).fill_null(0).to_numpy() for b in batches])
    order = np.argsort(key, kind="stable")
    key, there, ids = key[order], there[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.zeros(0, np.int64)
    none = np.iinfo(np.int64).min if keep == "max" else np.iinfo(np.int64).max
    reduce = np.maximum.reduceat if keep == "max" else np.minimum.reduceat
    if not n:
        return Run(key, ids, there, np.zeros(0, np.int64))
    return Run(key[first], reduce(np.where(there, ids, none), first), np.logical_or.reduceat(there, first), np.diff(np.append(first, n)))


def _row(node: int, run: Run) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), *[pa.array([x], pa.binary()) for x in run.packed()]], ["node", "keys", "ids", "there", "many"])


def _home(key: np.ndarray, nodes: int) -> np.ndarray:
    """The node that gets a key in the end: the digest's first bits. nodes is a power of two."""
    head = np.ascontiguousarray(key.view(np.uint8).reshape(-1, _BYTES)[:, :4]).view(">u4").ravel()
    return head.astype(np.int64) & (nodes - 1)


def _parted(node: int, run: Run, low: int, bits: int, nodes: int) -> Iterator[pa.RecordBatch]:
    """What a node keeps in the round of so many bits from the low one, and what it sends to each of its partners."""
    mask = (1 << bits) - 1 << low
    home = _home(run.key, nodes) & mask
    for k in range(1 << bits):
        which = home == k << low
        if which.any():
            yield _row(node & ~mask | k << low, run.take(which))


def _runs(keep: str, bits: int, nodes: int):
    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId() % nodes
        held: list[pa.RecordBatch] = []
        for b in batches:
            if len(b):
                held.append(b)
            if sum(map(len, held)) >= RUN_ROWS:
                yield from _parted(node, sorted_run(held, keep), 0, bits, nodes)
                held = []
        if held:
            yield from _parted(node, sorted_run(held, keep), 0, bits, nodes)

    return build


def _round(keep: str, nodes: int, low: int = 0, bits: int = 0):
    """A node's runs as one, and parted for the round of the bits that come next; without any, its entries as rows."""

    def merge(table: pa.Table) -> pa.Table:
        node = table.column("node")[0].as_py()
        run = merged_all([unpacked(*(c.as_buffer() for c in row)) for row in zip(*(table.column(c) for c in ("keys", "ids", "there", "many")))], keep)
        if bits:
            return pa.Table.from_batches(list(_parted(node, run, low, bits, nodes)))
        raw = run.key.view(np.uint8).reshape(-1, _BYTES)
        number = lambda at: pa.array(np.ascontiguousarray(raw[:, at : at + 8]).view(">i8").ravel().astype(np.int64))
        digest = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_DIGEST), len(raw), [None, pa.py_buffer(np.ascontiguousarray(raw[:, :_DIGEST]))]).cast(pa.binary())
        return pa.table([digest, number(_DIGEST), number(_DIGEST + 8), pa.array(run.id, mask=~run.there), pa.array(run.many)], [*_KEY, "id", "n"])

    return merge


def digests(docs: DataFrame, id_col: str, text_col: str, normalise=None, bits: int = 1) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    return docs.select(whole_id(docs, id_col).alias("id"), F.unhex(F.sha2(text, 256)).alias("digest"), F.xxhash64(text).alias("check"), F.octet_length(text).cast("long").alias("size"))


def merge_tree(rows: DataFrame, keep: str = "max", bits: int = 1) -> DataFrame:
    """(digest, check, size, id, n): of rows (id, digest, check, size), one entry per text with the id that stays. bits:
    2**bits nodes meet in a round; two in a binomial one. rows are counted first, since few need few nodes and rounds."""
    width = max(1, (min(partitions(rows.sparkSession), 1 + rows.count() // NODE_ROWS) - 1).bit_length())
    nodes = 1 << width
    first = min(bits, width)
    run = rows.select(*_KEY, "id").mapInArrow(_runs(keep, first, nodes), _PACKED)
    for low in range(first, width, bits):
        run = run.groupBy("node").applyInArrow(_round(keep, nodes, low, min(bits, width - low)), _PACKED)
    return run.groupBy("node").applyInArrow(_round(keep, nodes), "digest binary, check long, size long, id long, n long")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=None, bits: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "max" or "min", which identifier of equal texts stays. normalise: a function of the text column, or None.
    Null text counts as empty. Null ids never stay while the text has another id; a group of null ids alone has a null
    keep_id and all its rows count as kept. Rows that repeat id and text are kept or dropped together. Other columns
    are ignored; no rows give no rows.
    """
    rows = cut(digests(docs, id_col, text_col, normalise))
    groups = cut(merge_tree(rows, keep, bits).filter("n > 1").select(*_KEY, F.col("id").alias("keep_id"), "n"))
    found = spread_join(rows, groups, _KEY, "left")
    keep_id = F.coalesce("keep_id", "id")
    return found.select(
        F.col("id").alias("doc_id"), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", normalise=None, bits: int = 1) -> DataFrame:
    """docs with one row of each text, columns as they were; edge cases as above, but rows that repeat id and text
    leave one."""
    rows = digests(docs, id_col, text_col, normalise)
    digest, ident = unused(docs, "digest", "id")
    stay = merge_tree(rows, keep, bits).select(F.col("digest").alias(digest), F.col("id").alias(ident))
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    marked = docs.withColumns({digest: F.unhex(F.sha2(text, 256)), ident: whole_id(docs, id_col)})
    joined = marked.alias("d").join(stay.alias("k"), F.col(f"d.{digest}").eqNullSafe(F.col(f"k.{digest}")) & F.col(f"d.{ident}").eqNullSafe(F.col(f"k.{ident}")), "left_semi")
    return joined.dropDuplicates([digest, ident]).drop(digest, ident)


ORACLE = """
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window w as (partition by coalesce(text, ''))
"""
