"""Cross-tokenizer alignment: where two tokenizers cut a text alike, and which of their tokens overlap.

Runs of documents of bounded size are encoded by both tokenizers. The cumulative token ends of either are two sorted
lists; they are merged, ends that both have cut the text into groups, and each stretch between neighbouring ends is the
overlap of exactly one token of either side: a link. A run keeps the distinct pairs that it links and, per document,
which of them and how often. Spark counts the documents of each pair over the corpus, takes the highest count of each
id of the first side, and brings both back to the runs.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import pieces, token_counts
from quarry.llm.bpe import byte_letters
from quarry.llm.frames import cut, spread_join, whole_id
from quarry.llm.words import bounded, slices, text_buffers

RUN_BYTES = 4 << 20
#: Words whose ids a worker keeps; of more, it begins anew.
WORDS_KEPT = 250_000
_RUN = "run long, doc_ids array<long>, n_a array<int>, n_b array<int>, n_groups array<int>, n_links array<int>, digests array<string>, pair array<long>, docs array<int>, linked binary"


class Ids:
    """Ids of words, each encoded once while it is kept."""

    def __init__(self, encode: Callable[[list], Iterator[list[int]]]):
        self.encode = encode
        self._clear()

    def _clear(self) -> None:
        self.row: dict = {}
        self.flat, self.first, self.n = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words one after another, where those of each word begin)."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.row) + len(names) > WORDS_KEPT:
            self._clear()
        new = [w for w in names if w not in self.row]
        if new:
            ids = list(self.encode(new))
            self.row.update(zip(new, range(len(self.row), len(self.row) + len(new))))
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(n) - n])
            self.flat = np.concatenate([self.flat, np.fromiter((i for w in ids for i in w), np.int32, int(n.sum()))])
            self.n = np.concatenate([self.n, n])
        row = np.fromiter(map(self.row.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy(zero_copy_only=False)]
        many = self.n[row]
        return self.flat[pieces._spread(self.first[row], many)], np.concatenate([[0], np.cumsum(many)])


class Side:
    """A tokenizer of texts with one blank before them. lengths: bytes of each id; shown, shown_at: those bytes."""

    def __init__(self, shown: list[bytes]):
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.lengths = np.array([len(s) for s in shown], np.int64)
        self.shown_at = np.concatenate([[0], np.cumsum(self.lengths)])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The ids' bytes, one after another."""
        return self.shown[pieces._spread(self.shown_at[ids], self.lengths[ids])]


class ByteLevel(Side):
    """A byte-level BPE file of the tokenizers library; special strings in a text are plain text. Texts are cut to the
    pattern's pieces, and the library's model encodes each distinct one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        whole, letters = Tokenizer.from_file(path), byte_letters()
        model, added = whole.model, {t.content for t in whole.get_added_tokens_decoder().values()}
        vocab = {t: i for t, i in whole.get_vocab().items() if t not in added}
        shown = [b""] * (max(vocab.values(), default=-1) + 1)
        for token, i in vocab.items():
            shown[i] = bytes(letters[c] for c in token)
        super().__init__(shown)
        letter = {b: c for c, b in letters.items()}
        self.words = Ids(lambda words: ([t.id for t in model.tokenize(w.decode("latin-1").translate(letter))] for w in words))

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where those of each row begin) of rows that begin with a blank."""
        at, rows, _ = token_counts.pieces(raw, offs)
        ids, of = self.words.of(pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]))
        return ids, of[rows]


class Marked(Side):
    """A SentencePiece model that puts a blank before a text itself. Texts are cut before each run of blanks, which no
    piece crosses, and the library encodes each distinct word; the blank it adds stands for the word's own first one."""

    def __init__(self, path: str):
        import sentencepiece

        spec = pieces.load(path)
        if not spec.dummy:
            raise ValueError(f"{path}: the model puts no blank before a text")
        shown = spec.shown.tobytes()
        super().__init__([shown[a:b] for a, b in zip(spec.shown_at[:-1].tolist(), spec.shown_at[1:].tolist())])
        model, lone = sentencepiece.SentencePieceProcessor(model_file=path), [spec.vocab[pieces.MARK]]
        self.words = Ids(lambda words: (ids if w != pieces.MARK else lone for w, ids in zip(words, model.encode([w[1:] for w in words], num_threads=1))))

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, rows = pieces.marked_words(raw, offs, False)
        ids, of = self.words.of(words)
        return ids, of[rows]


@functools.cache
def side(path: str) -> Side:
    return Marked(path) if path.endswith(".model") else ByteLevel(path)


def _led(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the rows, each that isn't empty with one blank before it."""
    raw, offs = text_buffers(column)
    some = np.diff(offs) > 0
    return np.insert(raw, offs[:-1][some], 0x20), offs + np.concatenate([[0], np.cumsum(some)])


def _encoded(own: Side, column: pa.Array, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where those of each row begin, whether each row's ids stand for its bytes)."""
    ids, rows, at = [], [np.zeros(1, np.int64)], 0
    for first, end, _, _ in slices(column):
        part, of = own.encode(raw[offs[first] : offs[end]], offs[first : end + 1] - offs[first])
        ids.append(part)
        rows.append(of[1:] + at)
        at += len(part)
    ids, rows = np.concatenate(ids) if ids else np.zeros(0, np.int32), np.concatenate(rows)
    ends = np.concatenate([[0], np.cumsum(own.lengths[ids])])[rows]
    same = np.diff(ends) == np.diff(offs)
    joined = own.joined(ids)
    if not (same.all() and np.array_equal(joined, raw)):
        for i in np.flatnonzero(same).tolist():
            same[i] = np.array_equal(joined[ends[i] : ends[i + 1]], raw[offs[i] : offs[i + 1]])
    return ids, rows, same


class Aligned:
    """Rows of one column under two tokenizers; rows whose bytes either doesn't give back have no tokens.

    a, b: ids; a_rows, b_rows: where each row's begin. links: (index of a, index of b) of each link, in order; link_rows.
    a_group, b_group: the group of each token, numbered through; group_rows."""

    def __init__(self, column: pa.Array, one: Side, two: Side):
        raw, offs = _led(column)
        a, a_rows, a_same = _encoded(one, column, raw, offs)
        b, b_rows, b_same = _encoded(two, column, raw, offs)
        stay = a_same & b_same & (np.diff(offs) > 0)
        keep = lambda ids, rows: (ids[np.repeat(stay, np.diff(rows))], np.concatenate([[0], np.cumsum(np.where(stay, np.diff(rows), 0))]))
        (self.a, self.a_rows), (self.b, self.b_rows) = keep(a, a_rows), keep(b, b_rows)
        # two sorted lists of ends, merged by where each falls among the other
        ends_a, ends_b = np.cumsum(one.lengths[self.a]), np.cumsum(two.lengths[self.b])
        in_b, in_a = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
        a_shared = ends_b[np.minimum(in_b, len(ends_b) - 1)] == ends_a if len(ends_a) else np.zeros(0, bool)
        b_shared = ends_a[np.minimum(in_a, len(ends_a) - 1)] == ends_b if len(ends_b) else np.zeros(0, bool)
        shared_before = np.cumsum(b_shared) - b_shared
        place = np.arange(len(ends_a)) + in_b - np.concatenate([[0], np.cumsum(b_shared)])[in_b]
        only = np.flatnonzero(~b_shared)
        self.links = np.empty((2, len(ends_a) + len(only)), np.int64)
        self.links[:, place] = np.arange(len(ends_a)), in_b
        self.links[:, only + in_a[only] - shared_before[only]] = in_a[only], only
        self.link_rows = np.searchsorted(self.links[0], self.a_rows)
        self.a_last, self.b_last = a_shared, b_shared
        self.a_group, self.b_group = np.cumsum(a_shared) - a_shared, np.cumsum(b_shared) - b_shared
        self.group_rows = np.concatenate([[0], np.cumsum(a_shared)])[self.a_rows]

    def rendered(self) -> Iterator[str]:
        """SHA-256 of each row's groups, `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        n_groups = int(self.group_rows[-1])
        before_b = np.concatenate([[0], np.cumsum(np.bincount(self.b_group, minlength=n_groups))])
        upto_a = np.cumsum(np.bincount(self.a_group, minlength=n_groups))
        order = np.empty(len(self.a) + len(self.b), np.int64)
        size, table = _names(int(max(self.a.max(initial=0), self.b.max(initial=0))).bit_length())
        order[np.arange(len(self.a)) + before_b[self.a_group]] = self.a + np.where(self.a_last, size, 0)
        order[np.arange(len(self.b)) + upto_a[self.b_group]] = self.b + np.where(self.b_last, 2 * size, 0)
        raw, offs = text_buffers(table.take(pa.array(order)))
        data = memoryview(raw)
        for i, j in zip(offs[(self.a_rows + self.b_rows)[:-1]].tolist(), offs[(self.a_rows + self.b_rows)[1:]].tolist()):
            yield hashlib.sha256(data[i : j - 1]).hexdigest() if j > i else ""


@functools.cache
def _names(bits: int) -> tuple[int, pa.Array]:
    """(number of ids, each id followed by a comma, then by a bar, then by a semicolon)."""
    size = 1 << bits
    return size, pa.array([f"{i}{mark}" for mark in ",|;" for i in range(size)], pa.large_string())


def _ranks(sorted_: np.ndarray) -> np.ndarray:
    """Whether each sorted value is the first of its kind."""
    first = np.ones(len(sorted_), bool)
    first[1:] = sorted_[1:] != sorted_[:-1]
    return first


def _packed(found: Aligned, n_rows: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(distinct pairs, documents of each, packed: per document the pairs it links and how often)."""
    pair = found.a[found.links[0]].astype(np.int64) << 32 | found.b[found.links[1]]
    pairs, number = np.unique(pair, return_inverse=True)
    row = np.repeat(np.arange(n_rows), np.diff(found.link_rows))
    key = np.sort(row * len(pairs) + number)
    first = np.flatnonzero(_ranks(key))
    key, times = key[first], np.diff(np.append(first, len(key)))
    row, number = np.divmod(key, max(1, len(pairs)))
    docs = np.bincount(number, minlength=len(pairs))
    step = np.diff(key, prepend=0)  # over all rows: ascending, so small
    width = np.stack([step & 0xFF, step >> 8 & 0xFF, step >> 16 & 0xFF, step >> 24]).astype(np.uint32)
    body = b"".join(w.astype(np.uint8 if k < 3 else np.uint32).tobytes() for k, w in enumerate(width))
    return pairs, docs, zstandard.ZstdCompressor(level=3).compress(np.int64(len(key)).tobytes() + body + np.minimum(times, 255).astype(np.uint8).tobytes() + times[times >= 255].astype(np.uint32).tobytes())


def _unpacked(blob: bytes, n_pairs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, how often)."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, step = 8, np.zeros(n, np.int64)
    for k in range(4):
        step |= np.frombuffer(raw, np.uint8 if k < 3 else np.uint32, n, at).astype(np.int64) << 8 * k
        at += n * (1 if k < 3 else 4)
    times = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    times[times == 255] = np.frombuffer(raw, np.uint32, -1, at + n)
    row, number = np.divmod(np.cumsum(step), max(1, n_pairs))
    return row, number, times


def _runs(path_a: str, path_b: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        k = (task.partitionId() if task else 0) << 32
        for batch in bounded(batches, size=RUN_BYTES):
            found = Aligned(batch.column(1), side(path_a), side(path_b))
            pairs, docs, linked = _packed(found, len(batch))
            ints = lambda x, t=pa.int32(): pa.array([x], pa.list_(t))
            sizes = [ints(np.diff(x)) for x in (found.a_rows, found.b_rows, found.group_rows, found.link_rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), batch.column(0)), *sizes, pa.array([list(found.rendered())], pa.list_(pa.string())), ints(pairs, pa.int64()), ints(docs), pa.array([linked], pa.binary())],
                ["run", "doc_ids", "n_a", "n_b", "n_groups", "n_links", "digests", "pair", "docs", "linked"],
            )
            k += 1

    return run


def _scored(runs: pa.Table, counts: pa.Table) -> pa.Table:
    """The rows of a run's documents, from the run and the corpus-wide counts of its pairs."""
    own = runs.to_pylist()
    ids = own[0]["doc_ids"] if own else []
    n_pairs, at = len(counts), counts.column("at").to_numpy()
    count, best = np.zeros(n_pairs, np.int64), np.zeros(n_pairs, bool)
    count[at] = counts.column("count").to_numpy()
    best[at] = counts.column("best").to_numpy(zero_copy_only=False)
    row, number, times = _unpacked(own[0]["linked"], n_pairs) if own else (np.zeros(0, np.int64),) * 3
    total = lambda x: pa.array(np.bincount(row, x, len(ids)).astype(np.int64)) if x.sum() < 1 << 53 else pa.array([int(x[row == i].sum()) for i in range(len(ids))], pa.int64())
    sizes = [pa.array(own[0][c] if own else [], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    return pa.table([pa.array(ids, pa.int64()), *sizes, total(times * best[number]), total(times * count[number]), pa.array(own[0]["digests"] if own else [], pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))


def _of_runs(runs: DataFrame) -> DataFrame:
    """(of_run, at, pair, docs): each run's distinct pairs, numbered."""
    return runs.select(F.col("run").alias("of_run"), F.posexplode(F.arrays_zip("pair", "docs")).alias("at", "x")).select("of_run", "at", F.col("x.pair").alias("pair"), F.col("x.docs").alias("docs"))


def _counted(pairs: DataFrame) -> DataFrame:
    """(pair, count, n, best): how many documents and runs hold a pair, and whether no pair of its first id has more.
    The highest counts are a row for each id of a vocabulary, so they are broadcast."""
    counts = pairs.groupBy("pair").agg(F.sum("docs").alias("count"), F.count("*").alias("n"))
    counts = cut(counts.withColumn("a", F.shiftright("pair", 32).cast("int")))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "count", "n", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Each text, with a blank before it, is encoded by the files at path_a and path_b, which each executor reads: a
    byte-level BPE (.json) or a SentencePiece model that adds the blank itself (.model). Byte offsets where tokens of
    both end cut them into groups; each overlapping pair of tokens is a link. The count of a pair of ids is the number
    of rows that link it; n_best counts the links whose pair no other of the same first id outnumbers, ties included,
    and count_sum adds up the links' counts. Null and empty texts, and texts that either side doesn't give back byte by
    byte (say, with U+2581 in them), have no tokens: zeros, and '' for the digest. Repeated rows are documents of their
    own; null ids stay null. Other columns are ignored; no rows give no rows.
    """
    runs = cut(_rows(docs, id_col, text_col).mapInArrow(_runs(path_a, path_b), _RUN))
    pairs = _of_runs(runs)
    counts = spread_join(pairs, cut(_counted(pairs)), ["pair"]).select("of_run", "at", "count", "best")
    kept = runs.drop("pair", "docs")
    return kept.groupBy("run").cogroup(counts.groupBy("of_run")).applyInArrow(_scored, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, a and b (ids), a_ends and b_ends: how many ids of either side the text has up to
    the end of each group. Edge cases as in alignment()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, size=RUN_BYTES):
            f = Aligned(batch.column(1), side(path_a), side(path_b))
            lists = lambda x, rows: pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(x.astype(np.int32)))
            ends = lambda last, rows: np.flatnonzero(last) + 1 - np.repeat(rows[:-1], np.diff(f.group_rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(f.a, f.a_rows), lists(f.b, f.b_rows), lists(ends(f.a_last, f.a_rows), f.group_rows), lists(ends(f.b_last, f.b_rows), f.group_rows)], ["doc_id", "a", "b", "a_ends", "b_ends"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>")


def pair_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a, b, n_docs, best): each pair of ids that overlaps anywhere, in how many rows, and whether it is among the most
    frequent of its first id. Edge cases as in alignment()."""
    runs = cut(_rows(docs, id_col, text_col).mapInArrow(_runs(path_a, path_b), _RUN))
    return _counted(_of_runs(runs)).select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), F.col("count").alias("n_docs"), "best")
