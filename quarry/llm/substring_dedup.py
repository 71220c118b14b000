"""Substring dedup by super-k-mers.

Documents are dealt to groups of bounded size. In a group, each window of consecutive words has a minimiser, the least
hash of a few words in it; consecutive windows with one minimiser travel as one packed string to the bucket of that
minimiser, so equal windows meet in one bucket. Equal packed strings of a group travel once. A bucket sorts its windows
by a hash, compares the words of windows that the sort brings together, and answers each group with the windows that
occur more than once. The group, dealt out once for both uses, then removes the words they cover.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import text_bytes, whole_id
from quarry.llm.words import NON_SPACE, Words, hashes, mix, rolled, slices, split

WINDOW = 35
MER = 4
GROUP_BYTES = 8 << 20
BUCKET_BYTES = 5 << 20
LONGEST_RUN = 256


def _least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n consecutive values."""
    width = 1
    while 2 * width <= n:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return np.minimum(values[: len(values) - (n - width)], values[n - width :]) if width < n else values


def super_kmers(words: Words, window: int, mer: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser) of runs of consecutive windows of a row with one minimiser."""
    n = len(words) - window + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64)
    least = _least(rolled(hashes(words), mer), window - mer + 1)
    count = np.diff(words.rows)
    inside = np.zeros(len(words) + 1, np.int64)
    long = np.flatnonzero(count >= window)
    np.add.at(inside, words.rows[long], 1)
    np.add.at(inside, words.rows[long + 1] - window + 1, -1)
    inside = np.cumsum(inside)[:n] > 0
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    new[words.rows[long]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.concatenate([start, [n]]))
    ends = np.cumsum(inside)
    size = ends[start + size - 1] - np.where(start > 0, ends[start - 1], 0)
    start, size = start[size > 0], size[size > 0]
    pieces = -(-size // LONGEST_RUN)
    piece = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, size = np.repeat(start, pieces) + LONGEST_RUN * piece, np.minimum(np.repeat(size, pieces) - LONGEST_RUN * piece, LONGEST_RUN)
    return start, size, least[start]


def _packed(column: pa.Array, window: int, mer: int) -> Iterator[tuple[int, Words, np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    for at, _, raw, offs in slices(column):
        words = split(raw, offs, NON_SPACE)
        start, size, least = super_kmers(words, window, mer)
        text = words.text.tobytes()
        strings = list(map(text.__getitem__, map(slice, words.at[start].tolist(), words.at[start + size + window - 1].tolist())))
        yield at, words, start, size, least, strings


def _ordered(docs: pa.Table) -> pa.Table:
    """A group's rows in one order, since a shuffle delivers them in any: strings are numbered in this order twice."""
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _emit(window: int, mer: int, buckets: int):
    """A group's packed strings, a row per bucket: the strings joined by line ends, their numbers within the group, and
    whether each occurs more than once there."""

    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        number: dict[bytes, int] = {}
        bucket: list[int] = []
        again: set[int] = set()
        for _, _, _, _, least, strings in _packed(table.column("text"), window, mer):
            for s, b in zip(strings, (mix(least) % np.uint64(buckets)).tolist()):
                k = number.setdefault(s, len(bucket))
                if k == len(bucket):
                    bucket.append(b)
                else:
                    again.add(k)
        group = table.column("grp")[0].as_py()
        names, order = list(number), np.argsort(np.array(bucket, np.int64), kind="stable")
        of = np.array(bucket, np.int64)[order]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else np.zeros(1, np.int64)
        zip_up = zstandard.ZstdCompressor(level=3)
        rows: list[tuple] = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            ks = order[a:b]
            twice = np.fromiter((k in again for k in ks.tolist()), np.uint8, len(ks))
            rows.append((int(of[a]), group, zip_up.compress(b"\n".join([names[k] for k in ks.tolist()])), zip_up.compress(np.diff(ks, prepend=0).astype(np.uint32).tobytes() + twice.tobytes()), len(ks)))
        cols = list(zip(*rows)) or [[]] * 5
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.binary()), pa.array(cols[4], pa.int64())], ["bucket", "grp", "strings", "numbers", "n"])

    return run


def _unequal(codes: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Where the windows that begin at a and b differ."""
    bad = np.zeros(len(a), bool)
    for j in range(window):
        bad |= codes[a + j] != codes[b + j]
    return bad


def repeated_windows(words: Words, twice: np.ndarray, window: int) -> np.ndarray:
    """Whether each window's word sequence occurs more than once: the window at word i of a packed string. Sorted by a
    64-bit hash, verified word by word; twice marks strings that a group holds more than once."""
    n = len(words) - window + 1
    repeated = np.zeros(max(n, 0), bool)
    if n <= 0:
        return repeated
    many = np.diff(words.rows) - window + 1
    valid = np.repeat(words.rows[:-1] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
    h = rolled(hashes(words), window)[valid]
    order = np.argsort(h, kind="stable")
    ordered, at = h[order], valid[order]
    same = ordered[1:] == ordered[:-1]
    if same.any():
        codes = words.array().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        pairs = np.flatnonzero(same)
        bad = _unequal(codes, at[pairs], at[pairs + 1], window)
        good = pairs[~bad]
        repeated[at[good]] = repeated[at[good + 1]] = True
        if bad.any():  # different windows under one hash: their whole run by its words
            run = np.concatenate([[0], np.cumsum(~same)])
            for r in np.unique(run[pairs[bad]]).tolist():
                places = at[run == r]
                seen: dict[bytes, int] = {}
                for p in places.tolist():
                    key = codes[p : p + window].tobytes()
                    if key in seen:
                        repeated[p] = repeated[seen[key]] = True
                    else:
                        seen[key] = p
    row = np.repeat(np.arange(len(many)), many)
    repeated[valid[twice[row]]] = True
    return repeated


def _count(window: int):
    """A bucket's answer to each group: (string number, first, end) of runs of repeated windows."""

    def run(table: pa.Table) -> pa.Table:
        unzip = zstandard.ZstdDecompressor()
        n = table.column("n").to_numpy()
        group = table.column("grp").to_numpy()
        texts = [unzip.decompress(x.as_buffer()) for x in table.column("strings")]
        numbers, twice = [], []
        for x, k in zip(table.column("numbers"), n.tolist()):
            raw = unzip.decompress(x.as_buffer())
            numbers.append(np.cumsum(np.frombuffer(raw, np.uint32, k), dtype=np.int64))
            twice.append(np.frombuffer(raw, np.uint8, k, 4 * k).astype(bool))
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        del texts
        offs = np.concatenate([[0], np.flatnonzero(raw == 0x0A) + 1, [len(raw)]])
        words = split(raw, offs, NON_SPACE)
        del raw
        repeated = repeated_windows(words, np.concatenate(twice), window)
        # runs of repeated windows; a string's last window is window - 1 words before the next string
        edge = np.diff(np.concatenate([[0], repeated.astype(np.int8), [0]]))
        first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        row = np.searchsorted(words.rows, first, side="right") - 1
        number = np.concatenate(numbers)[row]
        owner = np.repeat(group, n)[row]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else np.zeros(1, np.int64)
        out, zip_up = [], zstandard.ZstdCompressor(level=1)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            base = words.rows[row[a:b]]
            out.append((int(owner[a]), zip_up.compress(np.stack([number[a:b], first[a:b] - base, end[a:b] - base]).astype(np.uint32).tobytes())))
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], ["grp", "runs"])

    return run


def _remove(window: int, mer: int):
    """A group's documents without the words under repeated windows."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        ids, n_words, n_removed, kept = [], [], [], []
        unzip = zstandard.ZstdDecompressor()
        runs = [np.frombuffer(unzip.decompress(x.as_buffer()), np.uint32).reshape(3, -1) for x in answers.column("runs")]
        runs = np.concatenate(runs, axis=1).astype(np.int64) if runs else np.zeros((3, 0), np.int64)
        runs = runs[:, np.argsort(runs[0], kind="stable")]
        number: dict[bytes, int] = {}
        for _, words, start, _, _, strings in _packed(docs.column("text"), window, mer):
            which = np.fromiter((number.setdefault(s, len(number)) for s in strings), np.int64, len(strings))
            low, high = np.searchsorted(runs[0], which), np.searchsorted(runs[0], which, side="right")
            many = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else low
            begin = np.repeat(start, many)
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, begin + runs[1][at], 1)
            np.add.at(cover, begin + runs[2][at] + window - 1, -1)
            stay = np.cumsum(cover)[:-1] == 0
            left = np.concatenate([[0], np.cumsum(stay)])
            n_words.append(np.diff(words.rows))
            n_removed.append(n_words[-1] - (left[words.rows[1:]] - left[words.rows[:-1]]))
            bytes_stay = np.repeat(stay, np.diff(words.at))
            text = words.text[bytes_stay].tobytes()
            ends = np.concatenate([[0], np.cumsum(np.where(stay, np.diff(words.at), 0))])[words.rows]
            kept += [text[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
        ids = docs.column("doc_id")
        flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return pa.table([ids, pa.array(flat(n_words)), pa.array(flat(n_removed)), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, mer: int = MER, texts: bool = True, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with texts, kept (words joined by a blank).

    Each word under a window of that many words whose sequence also starts elsewhere, in the same document or another,
    is removed; windows are judged on the input. Null and empty texts have no words, and texts shorter than a window
    lose none. Repeated rows are documents of their own, whose windows repeat; rows alike in id and text share a group,
    since a group is told by the row alone. Null ids stay null. Other columns are ignored; no rows give no rows.
    """
    total = text_bytes(docs, text_col)
    groups, buckets = 1 + total // group_bytes, 1 + 3 * total // bucket_bytes
    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 256)), F.lit(groups)))
    dealt = rows.repartition("grp")
    sent = dealt.groupBy("grp").applyInArrow(_emit(window, mer, buckets), "bucket long, grp long, strings binary, numbers binary, n long")
    answers = sent.groupBy("bucket").applyInArrow(_count(window), "grp long, runs binary")
    out = dealt.groupBy("grp").cogroup(answers.groupBy("grp")).applyInArrow(_remove(window, mer) if texts else _digested(_remove(window, mer)), "doc_id long, n_words long, n_removed long, kept " + ("binary" if texts else "string"))
    if texts:
        return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept").cast("string").alias("kept"))
    return out.withColumnRenamed("kept", "kept_sha256")


def _digested(remove):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        t = remove(docs, answers)
        return t.set_column(3, "kept", pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in t.column("kept")], pa.string()))

    return run


ORACLE = r"""
with d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 34], ' ') as g from d, unnest(range(1, len(w) - 33)) u(i) where len(w) >= 35),
rep as (select doc_id, i from (select doc_id, i, count(*) over (partition by g) as n from win) where n > 1),
gone as (select doc_id, list(distinct i + k) as p from rep, unnest(range(0, 35)) v(k) group by doc_id),
word as (select doc_id, j, w[j] as x, list_contains(coalesce(p, []), j) as out
         from d left join gone using (doc_id), unnest(range(1, len(w) + 1)) v(j)),
sums as (select doc_id, count_if(out) as n_removed, string_agg(case when not out then x end, ' ' order by j) as s from word group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(s, '')) as kept_sha256
from d left join sums using (doc_id)
"""
