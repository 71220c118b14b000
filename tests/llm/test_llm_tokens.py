"""Encoders against the libraries, round trips, and prefix counts against encoding every prefix."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import pieces, token_counts

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "I'm", "they're", "we've", " ", "  ", "\n", "\t", "'s", "'", "''", "!'s", "é", "中文", "😀", "1", "23", "<|endoftext|>", "<|endof", "▁", " ▁", "\x1c", "\x85", "ll", "'ll", "'r", "don't", "...", "\r\n", "²", "<s>", "<0x0A>", "\x00", "tion", "ing"]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", " ", "\n", "▁▁ a", "a" * 5000, " " * 3000, "'" * 50]


@pytest.fixture(scope="module")
def byte_level():
    return token_counts.encoder(BYTES)


def test_counts_match_the_library(byte_level):
    some = texts(2000, 1)
    want = [len(e.ids) for e in Tokenizer.from_file(BYTES).encode_batch(some, add_special_tokens=False)]
    assert token_counts.count_tokens(pa.array(some), *byte_level).tolist() == want


def test_prefix_counts_match_encoding_prefixes(byte_level):
    library = Tokenizer.from_file(BYTES)
    for t in texts(250, 2):
        t = t[:60]
        want = [len(e.ids) for e in library.encode_batch([t[:i] for i in range(len(t) + 1)], add_special_tokens=False)]
        assert token_counts.prefix_counts(t, *byte_level).tolist() == want
        fit = token_counts.fitting_prefix(t, 5, *byte_level)
        assert want[fit] <= 5 and all(n > 5 for n in want[fit + 1 :])


def test_count_query_over_odd_rows(spark, odd, odd_rows, empty):
    library = Tokenizer.from_file(BYTES)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(odd, BYTES).collect())
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in odd_rows]
    assert got == sorted((i is not None, i or 0, len((t or "").encode()), k, k > 512) for (i, t), k in zip(odd_rows, n))
    assert token_counts.token_counts(empty, BYTES).count() == 0
    short = token_counts.truncate(odd, BYTES, budget=50)
    assert short.columns == odd.columns
    for r in short.collect():
        assert r.text is None or len(library.encode(r.text, add_special_tokens=False).ids) <= 50


def test_pieces_match_the_library():
    some = texts(2000, 3)
    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), pieces.load(PIECES)
    got, back = [], []
    for ids, rows in pieces.encode_column(pa.array(some), model):
        got += [ids[a:b].tolist() for a, b in zip(rows[:-1], rows[1:])]
        raw, offs = pieces.decode_ids(ids, rows, model)
        back += [raw[a:b].tobytes().decode() for a, b in zip(offs[:-1], offs[1:])]
    assert got == [library.encode(t) for t in some]
    assert back == [t.replace("▁", " ") for t in some]


def test_piece_queries_over_odd_rows(spark, odd, odd_rows, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    encoded = pieces.encode(odd, PIECES)
    key = lambda i, x: (i is not None, i or 0, x)
    assert sorted(key(r.doc_id, tuple(r.ids)) for r in encoded.collect()) == sorted(key(i, tuple(library.encode(t or ""))) for i, t in odd_rows)
    assert sorted(key(r.doc_id, r.text) for r in pieces.decode(encoded, PIECES).collect()) == sorted(key(i, t or "") for i, t in odd_rows)
    assert pieces.encoding_digests(odd, PIECES).filter("not round_trip").count() == 0
    assert pieces.encode(empty, PIECES).count() == 0


def test_viterbi_shares_prefixes_and_is_optimal():
    model = pieces.load(PIECES)
    rng = np.random.default_rng(0)
    vocab = {w: i for i, w in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "aa"])}
    toy = object.__new__(pieces.Pieces)
    toy.vocab, toy.score, toy.bytes, toy.unknown = vocab, {w: float(-rng.random() * 3 - len(w)) for w in vocab}, {}, 0
    toy.longest, toy.penalty, toy.unigram = 3, -20.0, True
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 8))) for _ in range(200)})

    def best(w):
        return max(((toy.score[w[:n]] + best(w[n:])[0], [vocab[w[:n]], *best(w[n:])[1]]) for n in (1, 2, 3) if w[:n] in vocab and len(w) >= n), default=(0.0, [])) if w else (0.0, [])

    for w, ids in zip(words, toy.encode_words(words)):
        names = list(vocab)
        assert abs(sum(toy.score[names[i]] for i in ids) - best(w)[0]) < 1e-9
    assert model.bpe is not None


@pytest.mark.parametrize("kind", [pieces._UNIGRAM, pieces._BPE])
def test_unknown_runs_without_byte_fallback(tmp_path, kind):
    import sentencepiece.sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    for name, k in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=name, score=0.0, type=k)
    for rank, name in enumerate(["▁", "a", "b", "c", "ab", "▁a", "bc", "▁ab", "abc", "▁abc", "é"]):
        model.pieces.add(piece=name, score=-1.0 - rank * 0.7 if kind == pieces._UNIGRAM else -float(rank), type=1)
    model.trainer_spec.model_type = kind
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces, model.normalizer_spec.escape_whitespaces = True, False, True
    path = tmp_path / "m.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = random.Random(3)
    some = ["xyz", "x y", "xx", "", " ", "aéx中文b", "zz abc zz"] + ["".join(rng.choice("abcxyz é中  ") for _ in range(rng.randint(0, 20))) for _ in range(600)]
    got = [ids[a:b].tolist() for ids, rows in pieces.encode_column(pa.array(some), pieces.Pieces(str(path))) for a, b in zip(rows[:-1], rows[1:])]
    assert got == [library.encode(t) for t in some]
