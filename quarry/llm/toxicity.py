"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the buckets of its words, of its pairs of neighbouring words and of its pairs with one word
between, each bucket once. Learning goes over a bounded sample of labelled rows, one after another in one task, with a
rate of its own for each bucket; the L1 term keeps all but few weights at zero, and those few are broadcast to a pass
over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.frames import cut, unused, whole_id
from quarry.llm.words import ALPHANUMERIC, Words, bounded, hashes, mix, slices, split

#: At most this many labelled rows are learned from, those whose ids have the least hashes.
MAX_ROWS = 8000
BITS = 22
ALPHA, BETA, L1, L2, ROUNDS = 1.0, 1.0, 10.0, 0.1, 5


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, pair and skip pair, repeats included."""
    h, row = hashes(words), words.row_of()
    shift = np.uint64(64 - bits)
    rows, buckets = [row], [h >> shift]
    for gap, salt in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            inside = np.flatnonzero(row[gap:] == row[:-gap])
            rows.append(row[inside])
            buckets.append(mix(h[inside] * np.uint64(salt) + h[inside + gap]) >> shift)
    return np.concatenate(rows), np.concatenate(buckets).astype(np.int64)


class FTRL:
    """FTRL-proximal (McMahan et al., 2013) for logistic loss; the last weight is the bias, which has no L1 term."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.full(len(z), self.l1)
        if (at.stop == len(self.z)) if isinstance(at, slice) else (len(at) and at[-1] == len(self.z) - 1):
            l1[-1] = 0.0
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, buckets: np.ndarray, label: float) -> None:
        at = np.append(buckets, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _featured(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 2):
            for start, end, raw, offs in slices(batch.column(2)):
                row, bucket = features(split(raw, offs, ALPHANUMERIC, lower=True), bits)
                both = np.unique(row << bits | bucket)
                at = np.searchsorted(both, np.arange(end - start + 1) << bits)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array((both & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start), lists], ["place", "label", "buckets"])

    return run


def _learned(bits: int, max_rows: int, alpha: float, beta: float, l1: float, l2: float, rounds: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, float]] = []
        for batch in batches:
            for buckets, label in zip(batch.column(2), batch.column(1).to_pylist()):
                if len(kept) < max_rows:
                    kept.append((buckets.values.to_numpy(), float(label)))
        model = FTRL(1 << bits, alpha, beta, l1, l2)
        for _ in range(rounds):
            for buckets, label in kept:
                model.learn(buckets, label)
        size = len(model.z)
        parts = [slice(a, min(a + (1 << 18), size)) for a in range(0, size, 1 << 18)]
        w = np.concatenate([model.weights(p) for p in parts])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(w[at])], ["bucket", "weight"])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2, rounds: int = ROUNDS) -> DataFrame:
    """(bucket, weight), at most 2**bits + 1 rows; bucket 2**bits is the bias. labels: rows (id, label) to learn from.

    Of the labelled ids, the max_rows with the least hashes are learned from, in that order, and never more rows than
    that. Null ids and labels are left out; ids labelled more than once are toxic if any of their labels says so. An
    empty table gives no weights, and so scores of 0.5.
    """
    chosen = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(whole_id(labels, id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = chosen.withColumn("place", F.xxhash64("id")).orderBy("place", "id").limit(max_rows)
    rows = docs.select(whole_id(docs, id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("place", "label", "text")
    seen = rows.mapInArrow(_featured(bits), "place long, label int, buckets array<int>")
    return seen.repartition(1).sortWithinPartitions("place", "buckets").mapInArrow(_learned(bits, max_rows, alpha, beta, l1, l2, rounds), "bucket int, weight double")


def _scores(bits: int, model, text_col: str, name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w = model.value
        dense = np.zeros((1 << bits) + 1, np.float32)
        dense[at] = w
        for whole in batches:
            column = whole.schema.get_field_index(text_col)
            for batch in bounded([whole], column):
                got = []
                for start, end, raw, offs in slices(batch.column(column)):
                    row, bucket = features(split(raw, offs, ALPHANUMERIC, lower=True), bits)
                    hit = dense[bucket] != 0
                    both = np.unique(row[hit] << bits | bucket[hit])
                    total = np.bincount(both >> bits, dense[both & ((1 << bits) - 1)], end - start)
                    got.append(1 / (1 + np.exp(-(total + dense[-1]))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(got))], [*batch.schema.names, name])

    return run


def with_scores(docs: DataFrame, weights: DataFrame, text_col: str = "text", bits: int = BITS, name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 in a column so named, which docs must not have; null and empty texts have the bias's score. weights reach the driver and each
    executor as arrays of bounded size."""
    found = cut(weights).collect()
    model = docs.sparkSession.sparkContext.broadcast((np.array([r[0] for r in found], np.int64), np.array([r[1] for r in found], np.float64)))
    return docs.mapInArrow(_scores(bits, model, text_col, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from: the CRC-32 of the id as text is divisible by 5; null ids are, too."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 from 0.5 on). Repeated rows and null ids stay,
    other columns are ignored; options and edge cases as in train()."""
    weights = train(docs, labels.filter(~held_out(F.col(id_col))), id_col, text_col, label_col, **options)
    scored = with_scores(docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")), weights, bits=options.get("bits", BITS))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, **options) -> DataFrame:
    """docs without those scored at threshold or more; columns as they were."""
    weights = train(docs, labels.filter(~held_out(F.col(id_col))), id_col, text_col, label_col, **options)
    (score,) = unused(docs, "score")
    return with_scores(docs, weights, text_col, options.get("bits", BITS), score).filter(F.col(score) < threshold).drop(score)
