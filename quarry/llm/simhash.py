"""SimHash near-dedup with deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that, of two fingerprints within the distance, some segment
differs by one bit at most: two segments could each differ by two, so a distance of 4 takes three. Each segment is
indexed once per wildcard position, that bit set to 0; two segments that differ by at most one bit share such a
variant. An equality join on variants finds the candidates and the whole fingerprints verify them. Only distinct
fingerprints are indexed, so copies cost nothing; a group that shares a variant gives a spanning forest of its links,
not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.frames import cut, partitions, spread_join, whole_id
from quarry.llm.words import NON_SPACE, Words, bounded, slices, split

SHINGLE = 4
DISTANCE = 4
SEED = 42
LINK_ROWS = 200_000
#: A component's fingerprints are joined to its id in so many parts, since one may be large.
SALTS = 32
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(words: Words, size: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle, where those of each row begin). Rows of fewer words have one, of none none."""
    count = np.diff(words.rows)
    many = np.where(count == 0, 0, np.maximum(count - size + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(many)])
    first = np.repeat(words.rows[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
    end = np.minimum(first + size, np.repeat(words.rows[1:], many))
    text, begin, stop = words.text.tobytes(), words.at[first].tolist(), (words.at[end] - 1).tolist()
    return np.fromiter(map(xxhash.xxh64_intdigest, map(text.__getitem__, map(slice, begin, stop)), repeat(seed)), np.uint64, len(first)), bounds


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each row's hashes, the bits set in over half; 0 for a row of none. Eight byte counters share a word while
    they count up to 255 hashes."""
    n = np.diff(bounds)
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    pieces = -(-n[full] // 255)
    piece_row = np.concatenate([[0], np.cumsum(pieces)])
    start = np.repeat(bounds[full] - 255 * piece_row[:-1], pieces) + 255 * np.arange(piece_row[-1])
    counts = np.zeros((len(full), 64), np.int64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, start)
        eight = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        counts[:, shift::8] = np.add.reduceat(eight, piece_row[:-1], axis=0)
    bits = counts * 2 > n[full][:, None]
    out[full] = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, also: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp) of each row, and the long columns named in also."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            got = [majority_bits(*shingle_hashes(split(raw, offs, NON_SPACE, lower=True), shingle)) for _, _, raw, offs in slices(batch.column(1))]
            if got:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(got).view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *also])

    return docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"), *also).mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *also)))


def segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, number of bits) of segments of which one differs by at most one bit."""
    n = (distance + 2) // 2
    bounds = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:])]


def variants(fp: Column, distance: int) -> Column:
    """One key per bit of the fingerprint: its segment with that bit as the wildcard. Keys tell the bit, too."""
    keys = []
    for low, n in segments(distance):
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << n) - 1))
        keys += [segment.bitwiseAND(F.lit(((1 << n) - 1) & ~(1 << i))).bitwiseOR(F.lit((low + i) << 32)) for i in range(n)]
    return F.array(*keys)


def _near(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= distance


def _forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is within distance, each fingerprint compared with those not reached yet."""
    out, free = [], np.arange(len(fps))
    while len(free):
        todo, free = [int(free[0])], free[1:]
        while todo and len(free):
            at = todo.pop()
            near = _near(fps[at], fps[free], distance)
            if near.any():
                out.append((np.full(near.sum(), fps[at]), fps[free[near]]))
                todo += free[near].tolist()
                free = free[~near]
    return out


def _links(distance: int):
    def of(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        n = np.diff(np.concatenate([first, [len(key)]]))
        group = np.repeat(np.arange(len(first)), n)
        leader = fp[first][group]
        near = _near(leader, fp, distance)
        star = near.copy()
        star[first] = False
        found = [(leader[star], fp[star])]
        for g in np.flatnonzero(np.bincount(group, near, len(first)) < n):
            found += _forest(fp[first[g] : first[g] + n[g]], distance)
        u, v = (np.concatenate(x) for x in zip(*found))
        both = np.unique(np.stack([u, v]).view(np.int64), axis=1) if len(u) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, size = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            fps.append(batch.column(1).to_numpy().view(np.uint64))
            size += len(batch)
            if size >= LINK_ROWS:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                end = int(np.searchsorted(key, key[-1]))
                if end:
                    yield of(key[:end], fp[:end])
                keys, fps, size = [key[end:]], [fp[end:]], len(key) - end
        if size:
            yield of(np.concatenate(keys), np.concatenate(fps))

    return run


def links(distinct: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): links that connect the distinct fingerprints in column fp as all pairs within distance would."""
    n = 4 * partitions(distinct.sparkSession)
    # spread first: a small table is in few partitions, and a row becomes 64
    keyed = distinct.select("fp").repartition(n, "fp").select(F.explode(variants(F.col("fp"), distance)).alias("key"), "fp")
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_links(distance), "u long, v long")


def _classes(prints: DataFrame, distance: int) -> DataFrame:
    """(fp, component_id, n) of each distinct fingerprint; n rows have it."""
    own = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")))
    placed = own.join(components(links(own, distance)), F.col("fp") == F.col("node"), "left").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)))
    linked = placed.filter("root is not null")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    alone = placed.filter("root is null").select("fp", F.col("least_id").alias("component_id"), "n")
    return cut(alone.unionByName(linked.join(least, ["root", "salt"]).select("fp", "component_id", "n")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint, component_id.

    Null and empty texts have the fingerprint zero and are linked like others. component_id is the smallest id
    reachable over links of at most distance bits; null where all ids reachable are null. Repeated rows stay. Other
    columns are ignored; no rows give no rows.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    return spread_join(prints, _classes(prints, distance), ["fp"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE + 1) -> DataFrame:
    """docs with the row of the smallest id of each component, columns as they were.

    Three segments serve a distance of 5 as well as one of 4, so that is the default here. Rows with null ids are
    nobody's copy and stay, as do rows that repeat an id and text that stays; other edge cases as above.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash.alias("text_hash"))
    prints = cut(fingerprints(keyed, shingle=shingle, also=("text_hash",)))
    gone = spread_join(prints, _classes(prints, distance), ["fp"]).filter("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    return docs.join(gone, (whole_id(docs, id_col) == gone["__id"]) & (text_hash == gone["__hash"]), "left_anti")
