"""Suffix-array dedup of byte strings that also start in a document with a smaller id.

Documents are dealt to groups of bounded size. Each window of that many bytes has an anchor, the least hash of the
shorter strings in it, so equal windows have equal anchors; consecutive windows with one anchor are a segment. Groups
send their distinct anchors' hashes to buckets, which answer those that more than one document has. Only segments of
these go on, as packed bytes, to the bucket of their anchor, equal ones of a group once. A bucket merges equal segments,
lays the parts of the others that may repeat, those with one anchor, side by side, and puts their suffixes in order by
linear grouping (see lyndon): windows alike are neighbours there, and each learns the least id of a document that has it. The group, dealt out once for all
three uses, removes the bytes under windows whose least id is smaller than the document's own.

An anchor that very many segments hold is hot. Its segments are cut into single windows, rows of their own, whose least
ids Spark's grouping finds with partial sums; so no bucket holds more than HOT segments of one anchor.
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
from quarry.llm.lyndon import spread, suffix_order
from quarry.llm.substring_dedup import _least
from quarry.llm.words import _BACK, _OF_BYTE, _STEP, mix, powers, slices, text_buffers

WINDOW = 50
ANCHOR = 32
GROUP_BYTES = 8 << 20
#: Distinct anchors, and bytes of packed segments, that a bucket gets on the average.
BUCKET_ANCHORS = 1 << 20
BUCKET_BYTES = 4 << 20
#: More segments with one anchor than this, added up over groups, make it hot; a bucket compares so many strings at most.
HOT = 1 << 16
LANE = 512
_LAST = (1 << 63) - 1
_NONE, _SHARED, _HOT = range(3)


def _high(x: np.ndarray, n: int) -> np.ndarray:
    """x * n / 2**64 for 64-bit x: a number below n, in the order of x. n is below 2**31."""
    k = np.uint64(n)
    return (((x >> np.uint64(32)) * k + ((x & np.uint64(0xFFFFFFFF)) * k >> np.uint64(32))) >> np.uint64(32)).astype(np.int64)


class Segments:
    """Runs of consecutive windows of a row with one anchor, of all rows of a group: row, start (byte of the group's
    text), windows, anchor and a hash of the bytes. rows: where each row's bytes begin."""

    def __init__(self, docs: pa.Table, window: int, anchor: int):
        self.raw, self.rows = text_buffers(docs.column("text"))
        ids = docs.column("doc_id")
        self.ids = ids.fill_null(_LAST).to_numpy()
        self.window, found, base = window, [], 0
        for first, _, raw, offs in slices(docs.column("text").combine_chunks()):
            found.append(self._of(raw, offs, first, base, anchor))
            base += len(raw)
        cat = lambda k, t: np.concatenate([f[k] for f in found]) if found else np.zeros(0, t)
        self.row, self.start, self.windows, self.anchor, self.hash = cat(0, np.int64), cat(1, np.int64), cat(2, np.int64), cat(3, np.uint64), cat(4, np.uint64)

    def _of(self, raw: np.ndarray, offs: np.ndarray, first: int, base: int, anchor: int) -> tuple:
        n = len(raw) - self.window + 1
        none = np.zeros(0, np.int64)
        if n <= 0:
            return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
        total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_OF_BYTE[raw] * powers(_STEP, len(raw))[: len(raw)], out=total[1:])
        back = powers(_BACK, len(raw))
        size = len(raw) - anchor + 1
        least = total[anchor:] - total[:-anchor]
        least *= back[:size]
        least = _least(least, self.window - anchor + 1)
        inside = np.zeros(len(raw) + 1, np.int32)
        long = np.flatnonzero(np.diff(offs) >= self.window)
        np.add.at(inside, offs[long], 1)
        np.add.at(inside, offs[long + 1] - self.window + 1, -1)
        inside = np.cumsum(inside)[:n] > 0
        new = np.ones(n, bool)
        new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        new[offs[long]] = True
        start = np.flatnonzero(new & inside)
        edge = np.append(np.flatnonzero(new | ~inside), n)
        end = edge[np.searchsorted(edge, start, side="right")]
        # anchors alike for long, as in a run of one letter: pieces of as many windows as an anchor can reach
        reach = self.window - anchor + 1
        pieces = -(-(end - start) // reach)
        piece = spread(np.zeros(len(start), np.int64), pieces)
        start, end = np.repeat(start, pieces) + reach * piece, np.repeat(end, pieces)
        windows = np.minimum(end - start, reach)
        stop = start + windows + self.window - 1
        hashed = mix((total[stop] - total[start]) * back[start] + windows.astype(np.uint64))
        row = np.searchsorted(offs, start, side="right") - 1
        return row + first, start + base, windows, mix(least[start]), hashed  # mixed, since least ones are small

    def text(self, k: int) -> bytes:
        a = int(self.start[k])
        return self.raw[a : a + int(self.windows[k]) + self.window - 1].tobytes()

    def single(self, which: np.ndarray) -> Iterator[bytes]:
        """Each window of the segments."""
        for k in which.tolist():
            text = self.text(k)
            for p in range(len(text) - self.window + 1):
                yield text[p : p + self.window]


def _ordered(docs: pa.Table) -> pa.Table:
    """A group's rows in one order, since a shuffle delivers them in any: segments are numbered in this order."""
    return docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def _distinct(segments: Segments, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct anchors in order, bucket of each, whether more than one id has it, its distinct segments)."""
    order = np.lexsort((segments.hash, segments.anchor))
    a, h = segments.anchor[order], segments.hash[order]
    ids = segments.ids[segments.row[order]]
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    at = np.flatnonzero(new)
    if not len(at):
        return a, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at)
    own = new.copy()
    own[1:] |= h[1:] != h[:-1]
    return a[at], _high(a[at], buckets), several, np.add.reduceat(own.astype(np.int64), at)


def _cuts(of: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(value, first, end) of the runs of an ordered array."""
    edge = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else np.zeros(1, np.int64)
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        yield int(of[a]), a, b


def _rest(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """40 bits of each anchor that its bucket doesn't tell. Anchors that agree in them are taken for one, which only
    sends on segments in vain."""
    return (anchors * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _ask(window: int, anchor: int, buckets: int):
    """A group's distinct anchors, a row per bucket."""

    def run(table: pa.Table) -> pa.Table:
        anchors, bucket, several, n = _distinct(Segments(_ordered(table), window, anchor), buckets)
        rest, zip_up, rows = _rest(anchors, buckets), zstandard.ZstdCompressor(level=1), []
        for b, i, j in _cuts(bucket):
            step = np.diff(rest[i:j], prepend=0)
            body = b"".join((step >> 8 * k & 0xFF).astype(np.uint8).tobytes() for k in range(5))
            rows.append((b, zip_up.compress(body + (np.minimum(n[i:j], 127) * 2 + several[i:j]).astype(np.uint8).tobytes())))
        group = table.column("grp")[0].as_py()
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([group] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["bucket", "grp", "asked"])

    return run


def _answer(hot: int):
    """A bucket's answer to each group: of each of its anchors whether it is shared by documents, and hot."""

    def run(table: pa.Table) -> pa.Table:
        unzip, zip_up = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        rests, marks, sizes = [], [], []
        for x in table.column("asked"):
            raw = np.frombuffer(unzip.decompress(x.as_buffer()), np.uint8).reshape(6, -1)
            step = np.zeros(raw.shape[1], np.int64)
            for k in range(5):
                step |= raw[k].astype(np.int64) << 8 * k
            rests.append(np.cumsum(step))
            marks.append(raw[5])
            sizes.append(raw.shape[1])
        rest, mark = np.concatenate(rests), np.concatenate(marks)
        order = np.argsort(rest, kind="stable")
        new = np.ones(len(rest), bool)
        new[1:] = rest[order][1:] != rest[order][:-1]
        at = np.flatnonzero(new)
        many = np.diff(np.append(at, len(rest)))
        shared = (many > 1) | (np.maximum.reduceat(mark[order] & 1, at) > 0)
        total = np.add.reduceat(mark[order].astype(np.int64) >> 1, at)
        say = np.where(shared, np.where(total > hot, _HOT, _SHARED), _NONE).astype(np.uint8)
        out = np.empty(len(rest), np.uint8)
        out[order] = np.repeat(say, many)
        ends = np.cumsum(sizes)
        blobs = [zip_up.compress(out[e - n : e].tobytes()) for n, e in zip(sizes, ends.tolist())]
        return pa.table([table.column("bucket"), table.column("grp"), pa.array(blobs, pa.binary())], ["bucket", "grp", "answer"])

    return run


def _emit(window: int, anchor: int, asked: int, buckets: int):
    """A group's segments with shared anchors, a row per bucket: distinct bytes, and for each the number of the first
    segment with them, the first 32 bits of the anchor and the least and largest id. Windows of hot anchors go to
    buckets below 0, their numbers with the window's place."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        segments = Segments(_ordered(docs), window, anchor)
        order = np.argsort(segments.anchor)
        anchors = segments.anchor[order]
        new = np.ones(len(anchors), bool)
        new[1:] = anchors[1:] != anchors[:-1]
        bucket = _high(anchors[new], asked)
        say = np.zeros(len(bucket), np.uint8)
        blobs = dict(zip(answers.column("bucket").to_pylist(), answers.column("answer").to_pylist()))
        unzip, zip_up = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        for b, i, j in _cuts(bucket):
            say[i:j] = np.frombuffer(unzip.decompress(blobs[b]), np.uint8)
        of = np.empty(len(order), np.uint8)
        of[order] = say[np.cumsum(new) - 1]
        group, rows = docs.column("grp")[0].as_py(), []
        for kind in (_SHARED, _HOT):
            which = np.flatnonzero(of == kind)
            owner, place = which, np.zeros(len(which), np.int64)
            if kind == _HOT:
                owner, place = np.repeat(which, segments.windows[which]), spread(place, segments.windows[which])
            if not len(owner):
                continue
            known: dict[bytes, int] = {}
            parts = map(segments.text, which.tolist()) if kind == _SHARED else segments.single(which)
            string = np.fromiter((known.setdefault(p, len(known)) for p in parts), np.int64, len(owner))
            texts = list(known)
            del known
            low, high = np.full(len(texts), _LAST, np.int64), np.full(len(texts), -_LAST - 1, np.int64)
            first = np.empty(len(texts), np.int64)
            first[string[::-1]] = np.arange(len(string))[::-1]
            ids = segments.ids[segments.row[owner]]
            np.minimum.at(low, string, ids)
            np.maximum.at(high, string, ids)
            number, place = owner[first], place[first]
            own = segments.anchor[number]
            to = _high(own, buckets) if kind == _SHARED else -1 - _high(mix(own + place.astype(np.uint64)), buckets)
            order = np.argsort(to, kind="stable")
            length = np.array(list(map(len, texts)), np.int64)
            for b, i, j in _cuts(to[order]):
                ks = order[i:j]
                numbers = np.concatenate([number[ks], place[ks], length[ks], (own[ks] >> np.uint64(32)).astype(np.int64), low[ks], high[ks] - low[ks]])
                rows.append((b, zip_up.compress(b"".join(texts[k] for k in ks.tolist())), _planes(numbers, zip_up)))
        cols = list(zip(*rows)) or [[]] * 3
        return pa.table([pa.array(cols[0], pa.int64()), pa.array([group] * len(rows), pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], ["bucket", "grp", "texts", "numbers"])

    return run


def _planes(numbers: np.ndarray, zip_up) -> bytes:
    """64-bit numbers by their bytes, the low ones first: high bytes are mostly alike and pack away."""
    return zip_up.compress(np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _numbers(blob, unzip) -> np.ndarray:
    """_planes() undone, six rows."""
    raw = np.frombuffer(unzip.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(raw.T).view(np.int64).reshape(6, -1)


def least_ids(text: np.ndarray, at: np.ndarray, low: np.ndarray, lane: np.ndarray, window: int) -> np.ndarray:
    """The least id of each window: of the strings text[at[i]:at[i + 1]], each of the id low[i], those of equal lane are
    compared. One value a byte, of which those where a window begins count. Lanes are ordered."""
    out = np.repeat(low, np.diff(at))
    n = np.diff(at)
    alone = np.ones(len(lane), bool)
    same = lane[1:] == lane[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    pick = np.flatnonzero(~alone)
    if not len(pick):
        return out
    # each string, its symbols above 0, and a separator
    size = n[pick] + 1
    ends = np.cumsum(size)
    symbols, where = np.zeros(int(ends[-1]), np.int64), np.full(int(ends[-1]), -1, np.int64)
    to = spread(ends - size, n[pick])
    where[to] = spread(at[pick], n[pick])
    symbols[to] = text[where[to]].astype(np.int64) + 1
    last = np.append(lane[pick][1:] != lane[pick][:-1], True)
    order = suffix_order(symbols, ends[last])
    whole = np.zeros(len(symbols), bool)
    whole[spread(ends - size, np.maximum(n[pick] - window + 1, 0))] = True
    order = order[whole[order]]
    of_lane = np.searchsorted(ends[last], order, side="right")
    # neighbours that agree in a whole window
    alike = of_lane[1:] == of_lane[:-1]
    left, right = order[:-1][alike], order[1:][alike]
    differ = np.zeros(len(left), bool)
    for k in range(window - 1, -1, -1):
        differ |= symbols[left + k] != symbols[right + k]
    alike[alike] = ~differ
    first = np.flatnonzero(np.concatenate([[True], ~alike])) if len(order) else np.zeros(0, np.int64)
    if len(first):
        place = where[order]
        out[place] = np.repeat(np.minimum.reduceat(out[place], first), np.diff(np.append(first, len(order))))
    return out


def _again(text: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, windows) of the runs of windows of the strings text[at[i]:at[i + 1]] whose hash occurs again; others
    have no equal."""
    total = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_OF_BYTE[text] * powers(_STEP, len(text))[: len(text)], out=total[1:])
    place = spread(at[:-1], np.diff(at) - window + 1)
    hashed = (total[place + window] - total[place]) * powers(_BACK, len(text))[place]
    order = np.argsort(hashed, kind="stable")
    same = hashed[order][1:] == hashed[order][:-1]
    again = np.zeros(len(place), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    of = np.repeat(np.arange(len(at) - 1), np.diff(at) - window + 1)
    new = np.ones(len(place), bool)
    new[1:] = ~again[:-1] | (of[1:] != of[:-1])
    start = np.flatnonzero(again & new)
    stop = np.append(np.flatnonzero(~again | new), len(place))
    return place[start], stop[np.searchsorted(stop, start, side="right")] - start


def _least_of_windows(text: np.ndarray, at: np.ndarray, low: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """The least id of each window: as least_ids(), of strings that are put in lanes of bounded size by key. Only runs of
    windows that may have equals are compared, equal ones of a key once."""
    out = np.repeat(low, np.diff(at))
    start, many = _again(text, at, window)
    of = np.searchsorted(at, start, side="right") - 1
    lane = key[of]
    # a lane of too many strings: its windows one by one, dealt by their bytes
    known: dict[bytes, int] = {}
    raw = text.tobytes()
    string = np.fromiter((known.setdefault(raw[a : a + n + window - 1], len(known)) for a, n in zip(start.tolist(), many.tolist())), np.int64, len(start))
    of_string = np.empty(len(known), np.int64)
    of_string[string] = lane
    _, where, strings = np.unique(of_string, return_inverse=True, return_counts=True)
    wide = strings[where[string]] > LANE if len(string) else np.zeros(0, bool)
    if wide.any():
        place = spread(start[wide], many[wide])
        single = np.fromiter((known.setdefault(raw[a : a + window], len(known)) for a in place.tolist()), np.int64, len(place))
        head, string = np.concatenate([start[~wide], place]), np.concatenate([string[~wide], single])
        of = np.concatenate([of[~wide], np.repeat(of[wide], many[wide])])
        lane = np.concatenate([lane[~wide], -1 - (single % (1 + len(place) // LANE))])
        many = np.concatenate([many[~wide], np.ones(len(place), np.int64)])
        start = head
    names = list(known)
    del known, raw
    best, lanes = np.full(len(names), _LAST, np.int64), np.zeros(len(names), np.int64)
    np.minimum.at(best, string, low[of])
    lanes[string] = lane
    used = np.flatnonzero(np.bincount(string, minlength=len(names))) if len(names) else np.zeros(0, np.int64)
    used = used[np.argsort(lanes[used], kind="stable")]
    size = np.array([len(names[k]) for k in used.tolist()], np.int64)
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    least = least_ids(np.frombuffer(b"".join([names[k] for k in used.tolist()]), np.uint8), ends, best[used], lanes[used], window)
    begin = np.zeros(len(names), np.int64)
    begin[used] = ends[:-1]
    out[spread(start, many)] = least[spread(begin[string], many)]
    return out


def _count(window: int):
    """A bucket's answer to each group: (number, place, first, end, least id) of runs of windows that some document
    with a smaller id has."""

    def run(table: pa.Table) -> pa.Table:
        empty = pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], ["grp", "runs"])
        if table.column("bucket")[0].as_py() < 0:
            return empty
        unzip, zip_up = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1)
        known: dict[bytes, int] = {}
        string, entry, group, lows, keys = [], [], [], [], []
        for g, texts, numbers in zip(table.column("grp").to_pylist(), table.column("texts"), table.column("numbers")):
            raw, own = unzip.decompress(texts.as_buffer()), _numbers(numbers.as_buffer(), unzip)
            ends = np.cumsum(own[2])
            parts = map(raw.__getitem__, map(slice, (ends - own[2]).tolist(), ends.tolist()))
            string.append(np.fromiter((known.setdefault(p, len(known)) for p in parts), np.int64, len(ends)))
            group.append(np.full(len(ends), g, np.int64))
            entry.append(own)
        string, group, entry = np.concatenate(string), np.concatenate(group), np.concatenate(entry, axis=1)
        low = np.full(len(known), _LAST, np.int64)
        np.minimum.at(low, string, entry[4])
        key = np.zeros(len(known), np.int64)
        key[string] = entry[3]
        order = np.argsort(key, kind="stable")
        names = list(known)
        del known
        text = np.frombuffer(b"".join([names[k] for k in order.tolist()]), np.uint8)
        size = np.array([len(x) for x in names], np.int64)[order]
        del names
        at = np.concatenate([[0], np.cumsum(size)])
        least = _least_of_windows(text, at, low[order], key[order], window)
        # runs of windows of one string with one least id
        many = size - window + 1
        place = spread(at[:-1], many)
        of = np.repeat(np.arange(len(size)), many)
        value = least[place]
        new = np.ones(len(place), bool)
        new[1:] = (of[1:] != of[:-1]) | (value[1:] != value[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(place))
        begin = np.cumsum(many) - many
        runs = np.stack([start - begin[of[start]], end - begin[of[start]], value[start]])
        of = of[start]
        low_run, high_run = np.searchsorted(of, np.arange(len(size))), np.searchsorted(of, np.arange(len(size)), side="right")
        back = np.empty(len(size), np.int64)
        back[order] = np.arange(len(size))
        k = back[string]
        n = high_run[k] - low_run[k]
        which = spread(low_run[k], n)
        e = np.repeat(np.arange(len(k)), n)
        useful = runs[2][which] < (entry[4] + entry[5])[e]
        which, e = which[useful], e[useful]
        rows = []
        for g, i, j in _cuts(group[e]):
            own = np.stack([entry[0][e[i:j]], np.full(j - i, -1), runs[0][which[i:j]], runs[1][which[i:j]], runs[2][which[i:j]], np.zeros(j - i, np.int64)])
            rows.append((g, _planes(own, zip_up)))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["grp", "runs"])

    return run


def _hot_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bytes, grp, number, place, low, high) of the windows in buckets below 0."""
    unzip = zstandard.ZstdDecompressor()
    for batch in batches:
        for b, g, texts, numbers in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            if b >= 0:
                continue
            raw, own = unzip.decompress(texts.as_buffer()), _numbers(numbers.as_buffer(), unzip)
            offs = np.concatenate([[0], np.cumsum(own[2])]).astype(np.int32)
            parts = pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(offs), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([parts, pa.array(np.full(len(parts), g)), pa.array(own[0]), pa.array(own[1]), pa.array(own[4]), pa.array(own[4] + own[5])], ["bytes", "grp", "number", "place", "low", "high"])


def _hot_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, number, place, least) as runs of one window, packed by group."""
    zip_up = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        group, number, place, least = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        order = np.argsort(group, kind="stable")
        rows = [(g, _planes(np.stack([number[k], place[k], np.zeros(len(k), np.int64), np.ones(len(k), np.int64), least[k], np.zeros(len(k), np.int64)]), zip_up)) for g, i, j in _cuts(group[order]) for k in [order[i:j]]]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["grp", "runs"])


def _covered(segments: Segments, runs: np.ndarray) -> np.ndarray:
    """Which bytes of a group lie under windows whose least id is smaller than their row's."""
    window, cover = segments.window, np.zeros(len(segments.raw) + 1, np.int32)
    ids = segments.ids[segments.row]
    for hot in (False, True):
        own = runs[:, (runs[1] >= 0) == hot]
        own = own[:, np.lexsort((own[1], own[0]))]
        if not own.shape[1]:
            continue
        head = np.flatnonzero(np.concatenate([[True], (own[0][1:] != own[0][:-1]) | (own[1][1:] != own[1][:-1])]))
        texts = [segments.text(k) if not hot else segments.text(k)[p : p + window] for k, p in zip(own[0][head].tolist(), own[1][head].tolist())]
        which = dict(zip(texts, range(len(texts))))
        anchors = np.sort(segments.anchor[own[0][head]])
        at = np.minimum(np.searchsorted(anchors, segments.anchor), len(anchors) - 1)
        k = np.flatnonzero(anchors[at] == segments.anchor)
        parts = segments.single(k) if hot else map(segments.text, k.tolist())
        k, p = (np.repeat(k, segments.windows[k]), spread(np.zeros(len(k), np.int64), segments.windows[k])) if hot else (k, np.zeros(len(k), np.int64))
        w = np.fromiter((which.get(x, -1) for x in parts), np.int64, len(k))
        k, p, w = k[w >= 0], p[w >= 0], w[w >= 0]
        n = np.diff(np.append(head, own.shape[1]))[w]
        run = spread(head[w], n)
        k, p = np.repeat(k, n), np.repeat(p, n)
        less = own[4][run] < ids[k]
        k, p, run = k[less], p[less], run[less]
        begin = segments.start[k] + p
        np.add.at(cover, begin + own[2][run], 1)
        np.add.at(cover, begin + own[3][run] + window - 1, -1)
    return np.cumsum(cover)[:-1] > 0


def _remove(window: int, anchor: int, texts: bool):
    """A group's documents without the bytes under such windows."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs = _ordered(docs)
        segments, unzip = Segments(docs, window, anchor), zstandard.ZstdDecompressor()
        blobs = [_numbers(x.as_buffer(), unzip) for x in answers.column("runs")]
        gone = _covered(segments, np.concatenate(blobs, axis=1) if blobs else np.zeros((6, 0), np.int64))
        rows = segments.rows
        left = np.concatenate([[0], np.cumsum(~gone)])
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        heads = rows[:-1][rows[:-1] < rows[1:]]
        edge[heads] = gone[heads]
        spans = np.concatenate([[0], np.cumsum(edge)])
        stay, n = segments.raw[~gone], np.diff(rows)
        ends = left[rows].tolist()
        kept = [stay[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
        digests = [hashlib.sha256(x).hexdigest() for x in kept]
        cols = [docs.column("doc_id"), pa.array(n), pa.array(n - np.diff(left[rows])), pa.array(np.diff(spans[rows])), pa.array(digests, pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        return pa.table([*cols, pa.array(kept, pa.binary())], [*names, "kept"]) if texts else pa.table(cols, names)

    return run


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, texts: bool = True, group_bytes: int = GROUP_BYTES, bucket_anchors: int = BUCKET_ANCHORS, bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with texts, kept (binary, since a
    cut may fall inside a character).

    Each byte under a string of window bytes that also starts in a row with a smaller id is removed; strings don't cross
    rows, and are judged on the input. n_spans counts maximal runs of removed bytes. Null and empty texts have no bytes;
    texts shorter than a window lose none. Rows that repeat an id remove nothing from each other; a null id counts as
    larger than all others, and stays null. Other columns are ignored; no rows give no rows.
    """
    if not 0 < anchor <= window:
        raise ValueError("an anchor is part of a window")
    total = text_bytes(docs, text_col)
    reach = (window - anchor + 2) / 2  # bytes to an anchor, on the average
    groups, asked, buckets = 1 + total // group_bytes, 1 + int(total / reach) // bucket_anchors, 1 + total // bucket_bytes
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(whole_id(docs, id_col).alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.substring("text", 1, 256)), F.lit(groups)))
    dealt = rows.repartition("grp")
    ask = dealt.groupBy("grp").applyInArrow(_ask(window, anchor, asked), "bucket long, grp long, asked binary")
    answer = ask.groupBy("bucket").applyInArrow(_answer(hot), "bucket long, grp long, answer binary")
    sent = dealt.groupBy("grp").cogroup(answer.groupBy("grp")).applyInArrow(_emit(window, anchor, asked, buckets), "bucket long, grp long, texts binary, numbers binary").repartition("bucket")
    runs = sent.groupBy("bucket").applyInArrow(_count(window), "grp long, runs binary")
    windows = sent.mapInArrow(_hot_windows, "bytes binary, grp long, number long, place long, low long, high long")
    least = windows.groupBy("bytes").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most")
    found = windows.join(least, "bytes").filter("least < high").select("grp", "number", "place", "least")
    runs = runs.unionByName(found.mapInArrow(_hot_runs, "grp long, runs binary"))
    kinds = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts
    return dealt.groupBy("grp").cogroup(runs.groupBy("grp")).applyInArrow(_remove(window, anchor, texts), kinds)


ORACLE = """
with d as materialized (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
part as materialized (select r, c, substr(h, 2000 * c + 1, 2098) as p from d, unnest(range(0, length(h) // 2000 + 1)) u(c)),
win as materialized (select r, 1000 * c + i as i, md5_number(substr(p, 2 * i + 1, 100)) as g from part, unnest(range(0, least(1000, length(p) // 2 - 49))) u(i) where length(p) >= 100),
least as (select g, min(doc_id) as low from win join d using (r) group by g having min(doc_id) < max(doc_id)),
hit as materialized (select r, i from win join least using (g) join d using (r) where low < doc_id),
byte as (select r, j, x, coalesce(j <= max(i) over (partition by r order by j range between 49 preceding and current row) + 49, false) as gone
 from (select r, j, x, i from (select r, unnest(range(0, length(h) // 2)) as j, unnest(regexp_extract_all(h, '..')) as x from d where r in (select r from hit)) left join (select r, i as j, i from hit) using (r, j))),
cut as (select r, j, x, gone, coalesce(lag(gone) over (partition by r order by j), false) as before from byte),
sums as (select r, count_if(gone) as n_removed, count_if(gone and not before) as n_spans, string_agg(case when not gone then x end, '' order by j) as s from cut group by r)
select doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, cast(coalesce(n_spans, 0) as bigint) as n_spans,
 case when n_removed is null then sha256(unhex(h)) else sha256(unhex(coalesce(s, ''))) end as kept_sha256
from d left join sums using (r)
"""
