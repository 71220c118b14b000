"""Suffix arrays and the dedup built on them, against sorting and scanning."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import suffix_dedup
from quarry.llm.lyndon import suffix_order


def sorted_suffixes(symbols, ends):
    out, a = [], 0
    for e in ends:

        def key(i, e=e):
            stop = next(j for j in range(i, e) if symbols[j] == 0)
            return [(1, x) for x in symbols[i:stop]] + [(0, -stop)]

        out += sorted(range(a, e), key=key)
        a = e
    return out


def test_order_of_lanes():
    rng = np.random.default_rng(6)
    for _ in range(400):
        symbols, ends = [], []
        for _ in range(rng.integers(1, 5)):
            for _ in range(rng.integers(1, 4)):
                symbols += [*rng.integers(1, rng.integers(2, 5), rng.integers(0, 14)).tolist(), 0]
            ends.append(len(symbols))
        assert suffix_order(np.array(symbols), np.array(ends)).tolist() == sorted_suffixes(symbols, ends)


@pytest.mark.parametrize("word", [[1] * 300, [1, 2] * 150, [2, 1] * 150, list(range(1, 200)), list(range(200, 0, -1)), [1, 1, 2] * 90 + [1]])
def test_order_of_regular_texts(word):
    symbols = [*word, 0, *word[7:], 0]
    assert suffix_order(np.array(symbols), np.array([len(symbols)])).tolist() == sorted_suffixes(symbols, [len(symbols)])
    assert len(suffix_order(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def plain(rows, window=50):
    """(id, bytes, removed, spans, digest) of each row, as often as it occurs."""
    raw = [(i, (t or "").encode()) for i, t in rows]
    rank = lambda i: (1 << 63) - 1 if i is None else i
    least: dict[bytes, int] = {}
    for i, b in raw:
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            least[w] = min(rank(i), least.get(w, 1 << 63))
    out = Counter()
    for i, b in raw:
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - window + 1):
            if least[b[k : k + window]] < rank(i):
                gone[k] += 1
                gone[min(len(b), k + window)] -= 1
        gone = np.cumsum(gone)[: len(b)] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    return out


def passages(seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)] + ["é", "中文"]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [body(30) for _ in range(6)]
    line = "All rights reserved by the authors of this very common line."
    rows = []
    for i in range(150):
        parts = [body(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared)[rng.randint(0, 40) :], body(rng.randint(1, 9))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, f"{body(3)} {line} {body(3)}") for i in range(60)]
    rows += [(300 + i, rows[7][1]) for i in range(40)] + [(None, rows[8][1]), (None, rows[8][1]), (9, rows[9][1]), (9, rows[10][1]), (-5, rows[11][1][:80])]
    rows += [(400, "x" * 400), (401, "x" * 49), (402, "x" * 50), (403, "xy" * 100), (404, "y" + "xy" * 70), (405, "")]
    return rows


@pytest.mark.parametrize("settings", [{}, {"group_bytes": 3000, "bucket_anchors": 300, "bucket_bytes": 2000}, {"group_bytes": 5000, "hot": 3, "bucket_bytes": 4000}, {"group_bytes": 3000, "hot": 0}, {"anchor": 50, "group_bytes": 9000}, {"anchor": 1, "group_bytes": 9000}])
def test_dedup_bytes(spark, settings):
    rows = passages()
    docs = spark.createDataFrame([(i, t, 1, "x", "x", 2) for i, t in rows], "doc_id long, text string, grp int, bucket string, kept string, n_bytes int").repartition(5)
    got = suffix_dedup.dedup_bytes(docs, texts=False, **settings)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert Counter(map(tuple, got.collect())) == plain(rows)


def test_odd_rows_and_kept_bytes(spark, odd, odd_rows):
    rows = [(i, t if t is None or len(t) < 5000 else t) for i, t in odd_rows]
    got = suffix_dedup.dedup_bytes(odd, group_bytes=100_000).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == plain(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in got)


def test_no_rows(spark, empty):
    assert suffix_dedup.dedup_bytes(empty).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (None, None)], "doc_id long, text string")
    assert Counter(map(tuple, suffix_dedup.dedup_bytes(nothing, texts=False).collect())) == plain([(1, None), (2, ""), (None, None)])
    with pytest.raises(ValueError):
        suffix_dedup.dedup_bytes(nothing, anchor=51)


def test_tables_against_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    got = Counter(map(tuple, suffix_dedup.dedup_bytes(spark.read.parquet(path), texts=False).collect()))
    con = duckdb.connect()
    con.execute(f"create view documents as from '{path}'")
    assert got == Counter(con.execute(suffix_dedup.ORACLE).fetchall())
    assert sum(n for (_, _, removed, _, _), n in got.items() if removed) > 5


def test_segments_hold_every_window_once():
    texts = pa.table({"doc_id": pa.array([1, 2, 3, 4]), "text": pa.array(["ab" * 90, "q" * 130, "short", "the end of it " * 11])})
    s = suffix_dedup.Segments(texts, 50, 32)
    begins = sorted(b for a, n in zip(s.start.tolist(), s.windows.tolist()) for b in range(a, a + n))
    assert begins == [int(r) + k for r, n in zip(s.rows[:-1], np.diff(s.rows)) for k in range(max(0, n - 49))]
    assert max(s.windows) <= 19
