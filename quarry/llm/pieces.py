"""SentencePiece encoding and decoding with states shared by common prefixes.

A text gets its dummy prefix and its blanks as marks, and is cut before each run of marks; no piece crosses such a cut.
The distinct marked words of a batch are sorted, which lays them out as a trie in depth-first order; a forward pass
keeps one state per prefix and goes on from the states of the prefix shared with the word before. For a unigram model
the state is the best score (Viterbi). A BPE model's encoding isn't the best-scored one, so there the state is the last
piece of the prefix's own encoding, which is exact (see bpe). Words become ids once; texts are put together from them.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import PrefixBPE, path as backwards
from quarry.llm.frames import whole_id
from quarry.llm.words import bounded, slices

MARK = "▁"
_MARK = MARK.encode()
_BPE, _UNIGRAM = 2, 1
_NORMAL, _UNKNOWN, _CONTROL, _USER, _BYTE, _UNUSED = 1, 2, 3, 4, 6, 5


class Pieces:
    """A model file whose texts are normalised by nothing but blanks; others are refused."""

    def __init__(self, path: str):
        import sentencepiece.sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm = model.normalizer_spec
        kinds = {p.type for p in model.pieces}
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or _USER in kinds or _UNUSED in kinds or model.trainer_spec.treat_whitespace_as_suffix or model.trainer_spec.model_type not in (_BPE, _UNIGRAM):
            raise ValueError(f"{path}: only models without normalisation rules, user-defined and unused pieces are read")
        self.dummy = norm.add_dummy_prefix
        self.vocab = {p.piece: i for i, p in enumerate(model.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == _NORMAL}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == _UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == _BYTE}
        self.unigram = model.trainer_spec.model_type == _UNIGRAM
        if any(MARK in p.lstrip(MARK) for p in self.vocab):
            raise ValueError(f"{path}: pieces cross the start of a marked word")
        score = self.score

        def rank(a: str, b: str):
            s = score.get(a + b)
            return None if s is None else -s

        self.bpe = PrefixBPE(self.vocab, rank)
        self.longest = max(map(len, self.vocab))
        self.penalty = min(self.score.values(), default=0.0) - 10.0
        #: What each id decodes to, in UTF-8; control pieces and the unknown one decode to nothing.
        shown = [b"" if p.type in (_CONTROL, _UNKNOWN) else bytes([int(p.piece[3:5], 16)]) if p.type == _BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_at = np.concatenate([[0], np.cumsum([len(s) for s in shown])])

    def _ids(self, token: str, ident: int) -> list[int]:
        if ident >= 0:
            return [ident]
        return [self.bytes[b] for b in token.encode()] if self.bytes else [self.unknown]

    def encode_words(self, words: list[str]) -> Iterator[list[int]]:
        """Ids of each of the sorted words."""
        if self.unigram:
            yield from self._viterbi(words)
            return
        for token, ident, _ in self.bpe.walk(words):
            if -1 in ident:
                yield [i for t, k in backwards(token, ident) for i in self._ids(t, k)]
            else:
                out, at = [], len(token) - 1
                while at > 0:
                    out.append(ident[at])
                    at -= len(token[at])
                out.reverse()
                yield out

    def _viterbi(self, words: list[str]) -> Iterator[list[int]]:
        best, back, before = [0.0], [0], ""
        for w in words:
            same, top = 0, min(len(w), len(before))
            while same < top and w[same] == before[same]:
                same += 1
            del best[same + 1 :], back[same + 1 :]
            for i in range(same + 1, len(w) + 1):
                score, length = best[i - 1] + self.penalty, 1
                for n in range(1, min(i, self.longest) + 1):
                    s = self.score.get(w[i - n : i])
                    if s is not None and (best[i - n] + s > score or n == 1):
                        score, length = best[i - n] + s, n
                best.append(score)
                back.append(length)
            before = w
            out, at = [], len(w)
            while at > 0:
                t = w[at - back[at] : at]
                out.append(self._ids(t, self.vocab.get(t, -1)))
                at -= back[at]
            yield [i for ids in reversed(out) for i in ids]


@functools.cache
def load(path: str) -> Pieces:
    return Pieces(path)


def marked_words(raw: np.ndarray, offs: np.ndarray, dummy: bool) -> tuple[pa.Array, np.ndarray]:
    """(marked words of the rows one after another, where those of each row begin)."""
    text = raw.tobytes()
    n = np.diff(offs)
    head = offs[:-1][n > 0] if dummy else offs[:0]
    buf = np.insert(raw, head, 0x20)
    offs = offs + np.concatenate([[0], np.cumsum(n > 0)]) * dummy
    blank = buf == 0x20
    width = np.where(blank, 3, 1)
    to = np.concatenate([[0], np.cumsum(width)])
    out = np.empty(to[-1], np.uint8)
    out[to[:-1]] = buf
    at = to[:-1][blank]
    for i, b in enumerate(_MARK):
        out[at + i] = b
    mark = blank.copy()
    if _MARK in text:  # marks in the text itself are like blanks from here on
        hit = np.flatnonzero((buf[:-2] == _MARK[0]) & (buf[1:-1] == _MARK[1]) & (buf[2:] == _MARK[2]))
        mark[hit] = True
        tail = np.zeros(len(buf), bool)
        tail[hit + 1] = tail[hit + 2] = True
    else:
        tail = None
    new = mark.copy()
    if tail is None:
        new[1:] &= ~mark[:-1]
    else:
        new[1:] &= ~(blank[:-1] | tail[:-1])
    starts_of_rows = offs[:-1][np.diff(offs) > 0]
    new[starts_of_rows] = True
    start = np.flatnonzero(new)
    rows = np.searchsorted(start, offs)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(np.append(to[start], to[-1]).astype(np.int64)), pa.py_buffer(out)])
    return words, rows


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... n[i] of them, for each i."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else first


def encode_column(column: pa.Array, model: Pieces) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids of some rows, where those of each row begin) of the rows of a column in order."""
    coded, distinct = [], []
    for _, _, raw, offs in slices(column):
        words, rows = marked_words(raw, offs, model.dummy)
        array = words.dictionary_encode()
        coded.append((array.indices.to_numpy(zero_copy_only=False), rows))
        distinct.append(array.dictionary)
    if not coded:
        return
    every = pc.unique(pa.chunked_array(distinct))
    order = pc.sort_indices(every)
    flat, n = [], np.zeros(len(every), np.int64)
    where = order.to_numpy()
    for k, ids in zip(where.tolist(), model.encode_words(every.take(order).to_pylist())):
        n[k] = len(ids)
        flat.extend(ids)
    flat = np.array(flat, np.int32)
    first = np.zeros(len(every), np.int64)
    first[where] = np.concatenate([[0], np.cumsum(n[where])[:-1]])
    for (codes, rows), own in zip(coded, distinct):
        word = pc.index_in(own, every).to_numpy()[codes]
        many = n[word]
        ids, rows = flat[_spread(first[word], many)], np.concatenate([[0], np.cumsum(many)])[rows]
        if not model.bytes:  # neighbouring unknown pieces of a text are one
            again = np.zeros(len(ids), bool)
            again[1:] = (ids[1:] == model.unknown) & (ids[:-1] == model.unknown)
            again[rows[:-1][np.diff(rows) > 0]] = False
            ids, rows = ids[~again], np.concatenate([[0], np.cumsum(~again)])[rows]
        yield ids, rows


def decode_ids(ids: np.ndarray, rows: np.ndarray, model: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the rows) that the ids stand for, without the dummy prefix."""
    low, n = model.shown_at[ids], model.shown_at[ids + 1] - model.shown_at[ids]
    raw = model.shown[_spread(low, n)]
    offs = np.concatenate([[0], np.cumsum(n)])[rows]
    if model.dummy:
        heads = offs[:-1][np.diff(offs) > 0]
        heads = heads[raw[heads] == 0x20]
        stay = np.ones(len(raw), bool)
        stay[heads] = False
        offs = np.concatenate([[0], np.cumsum(stay)])[offs]
        raw = raw[stay]
    return raw, offs


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, ids. Null and empty texts have no ids; repeated rows and null ids stay. path is
    read by each executor. Other columns are ignored; no rows give no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            at = 0
            for ids, rows in encode_column(batch.column(1), load(path)):
                end = at + len(rows) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])
                at = end

    return docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """doc_id and text of encode()'s rows. Null ids decode to an empty text; bytes that are no UTF-8 become the
    replacement character."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).fill_null([])
            rows = lists.offsets.to_numpy().astype(np.int64)
            raw, offs = decode_ids(lists.flatten().to_numpy(), rows - rows[0], load(path))
            data = raw.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[a:b].decode(errors="replace") for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")


def encoding_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_ids, ids_sha256 (of the ids, comma-joined), decoded_sha256 (of the text that
    the ids decode to) and round_trip (that text is the text, marks in it taken as blanks). Edge cases as in encode()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([str(i) for i in range(len(load(path).shown_at) - 1)], object)
        for batch in bounded(batches):
            at = 0
            texts = slices(batch.column(1))
            for (ids, rows), (_, _, raw, offs) in zip(encode_column(batch.column(1), load(path)), texts):
                end = at + len(rows) - 1
                back, back_at = decode_ids(ids, rows, load(path))
                data, own = back.tobytes(), raw.tobytes()
                if _MARK in own:
                    same = [data[a:b] == own[c:d].replace(_MARK, b" ") for a, b, c, d in zip(back_at[:-1].tolist(), back_at[1:].tolist(), offs[:-1].tolist(), offs[1:].tolist())]
                else:
                    same = [data[a:b] == own[c:d] for a, b, c, d in zip(back_at[:-1].tolist(), back_at[1:].tolist(), offs[:-1].tolist(), offs[1:].tolist())]
                decoded = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(back_at[:-1].tolist(), back_at[1:].tolist())]
                joined = [hashlib.sha256(",".join(names[ids[a:b]]).encode()).hexdigest() for a, b in zip(rows[:-1].tolist(), rows[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array(np.diff(rows)), pa.array(joined), pa.array(decoded), pa.array(same)], ["doc_id", "n_ids", "ids_sha256", "decoded_sha256", "round_trip"])
                at = end

    return docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean")
