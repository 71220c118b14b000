"""Alignment against the two libraries and a scan of token ends, one text at a time."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import alignment
from quarry.llm.bpe import byte_letters
from quarry.llm.queries import vocabulary

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
MORE = [(500, "a mark ▁ inside"), (501, " leading  blanks"), (502, "<|endoftext|> and <s> are text"), (503, "naïve 中文 \U0001f600 don't stop"), (504, "a\tb\r\nc\x00"), (505, "▁")]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(vocabulary(A))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=vocabulary(B))
    letters = byte_letters()

    def encoded(text):
        ids = one.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(letters[c] for c in one.id_to_token(i))) for i in ids]
        b = []
        for i in two.encode(text):
            p = two.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()))
        return a, b

    return encoded


def scanned(text, encoded):
    """(ids of a, ids of b, groups, links) of a text, by walking both token lists together."""
    if not text:
        return [], [], [], []
    a, b = encoded(text)
    whole = (" " + text).encode()
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return [], [], [], []
    spans = lambda side: [(i, sum(len(y) for _, y in side[:k]), sum(len(y) for _, y in side[: k + 1])) for k, (i, _) in enumerate(side)]
    if len(a) > 2000:  # the same, without the square
        ends = lambda side: np.cumsum([len(y) for _, y in side]).tolist()
        sa = [(i, e - len(y), e) for (i, y), e in zip(a, ends(a))]
        sb = [(i, e - len(y), e) for (i, y), e in zip(b, ends(b))]
    else:
        sa, sb = spans(a), spans(b)
    common = sorted({e for *_, e in sa} & {e for *_, e in sb})
    low, groups, links, j = 0, [], [], 0
    ia = ib = 0
    for e in common:
        ga, gb = [], []
        while ia < len(sa) and sa[ia][2] <= e:
            ga.append(sa[ia][0])
            ia += 1
        while ib < len(sb) and sb[ib][2] <= e:
            gb.append(sb[ib][0])
            ib += 1
        groups.append((ga, gb))
    for i, x, y in sa:
        while j and sb[j - 1][2] > x:
            j -= 1
        while j < len(sb) and sb[j][2] <= x:
            j += 1
        k = j
        while k < len(sb) and sb[k][1] < y:
            links.append((i, sb[k][0]))
            k += 1
    return [i for i, *_ in sa], [i for i, *_ in sb], groups, links


def test_alignment(spark, odd, odd_rows, libraries):
    rows = [*odd_rows, *MORE]
    docs = odd.unionByName(spark.createDataFrame(MORE, "doc_id long, text string"), allowMissingColumns=True)
    found = [scanned(t, libraries) for _, t in rows]
    count = Counter(p for *_, links in found for p in set(links))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    want = Counter()
    for (i, _), (a, b, groups, links) in zip(rows, found):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[i, len(a), len(b), len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if text else ""] += 1
    out = alignment.alignment(docs, vocabulary(A), vocabulary(B))
    assert out.dtypes == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), ("groups_sha256", "string")]
    assert Counter(map(tuple, out.collect())) == want
    pairs = {(r.a, r.b): (r.n_docs, r.best) for r in alignment.pair_counts(docs, vocabulary(A), vocabulary(B)).collect()}
    assert pairs == {p: (n, n == most[p[0]]) for p, n in count.items()}
    got = Counter()
    for r in alignment.groups(docs, vocabulary(A), vocabulary(B)).collect():
        cuts = lambda ids, ends: [tuple(ids[x:y]) for x, y in zip([0, *ends], ends)]
        got[r.doc_id, tuple(zip(cuts(r.a, r.a_ends), cuts(r.b, r.b_ends)))] += 1
    assert got == Counter((i, tuple((tuple(x), tuple(y)) for x, y in groups)) for (i, _), (_, _, groups, _) in zip(rows, found))


def test_alignment_of_the_tables(spark, libraries):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in alignment.alignment(docs, vocabulary(A), vocabulary(B)).collect()}
    found = {r.doc_id: scanned(r.text, libraries) for r in docs.collect()}
    count = Counter(p for *_, links in found.values() for p in set(links))
    for i, (a, b, groups, links) in found.items():
        assert (got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links, got[i].count_sum) == (len(a), len(b), len(groups), len(links), sum(count[p] for p in links))


def test_alignment_of_no_rows(spark, empty):
    for f in (alignment.alignment, alignment.groups, alignment.pair_counts):
        assert f(empty, vocabulary(A), vocabulary(B)).count() == 0
    nothing = spark.createDataFrame([(1, None), (None, ""), (3, "▁")], "doc_id long, text string")
    assert Counter(map(tuple, alignment.alignment(nothing, vocabulary(A), vocabulary(B)).collect())) == Counter((i, 0, 0, 0, 0, 0, 0, "") for i in (1, None, 3))


def test_packed_links_come_back():
    one, two = alignment.side(vocabulary(A)), alignment.side(vocabulary(B))
    column = pa.array(["abc " * 2000, "", None, "xyz don't", *[""] * 5000, "abc"])
    found = alignment.Aligned(column, one, two)
    pairs, docs, blob = alignment._packed(found, len(column))
    row, number, times = alignment._unpacked(blob, len(pairs))
    pair = found.a[found.links[0]].astype(np.int64) << 32 | found.b[found.links[1]]
    want = Counter(zip(np.repeat(np.arange(len(column)), np.diff(found.link_rows)).tolist(), pair.tolist()))
    assert want == Counter({(r, int(pairs[k])): t for r, k, t in zip(row.tolist(), number.tolist(), times.tolist())})
    assert max(want.values()) > 255 and docs.tolist() == [sum(p == q for _, q in want) for p in pairs.tolist()]


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(alignment, "WORDS_KEPT", 3)
    ids = alignment.Ids(lambda words: ([len(w)] * 2 for w in words))
    for words in (["a", "bb"], ["ccc", "a", "a"], ["dddd"], []):
        flat, at = ids.of(pa.array(words, pa.string()))
        assert flat.tolist() == [len(w) for w in words for _ in range(2)] and at.tolist() == [2 * k for k in range(len(words) + 1)]
    assert len(ids.row) <= 3
