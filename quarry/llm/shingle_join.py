"""Near-dedup by SimHash at an exact Jaccard similarity of word shingles, losing no pair.

SimHash goes first: fingerprints of the shingle sets, deletion variants and an equality join find what is near, and whole
sets verify it. At the similarity many pairs are further apart than any distance that selects something, so a prefix
filter then looks for links between rows that SimHash's verified links have left in different components.

Of two sets with a similarity of t or more, under any one order of all shingles, the first n - ceil(t * n) + 1 of each
share one. The order puts shingles that few sets have first, by counts of all of them, so that a passage which many
texts repeat is rarely among them; a shingle of one set alone takes its place and is never looked up. Counts end at
COMMON: a run of texts in which a shingle is that common tells it once instead of once a text, so no shingle gathers
more than COMMON entries a run. An equality join on the first shingles finds the candidates. Two exact bounds spare most
of them: the ratio of the sizes, and parity bitmaps, which differ in at most as many bits as the sets in shingles. The
rest are verified by whole sets.

A group that shares a shingle isn't made into pairs: neighbours in two orders are verified first, and then only pairs
that these links have left in different components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import simhash
from quarry.llm.components import components
from quarry.llm.frames import cut, partitions, whole_id
from quarry.llm.simhash import LINK_ROWS, SALTS
from quarry.llm.words import NON_SPACE, Words, bounded, mix, rolled, slices, split
from quarry.llm.words import hashes as word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: Bits that SimHash's fingerprints may differ in; three segments serve it.
DISTANCE = 5
#: Where counts end, and bits of the filter of texts that have candidates.
COMMON = 64
FILTER_BITS = 24
#: Bits of a parity bitmap; neighbours in larger groups verified before components are known; rows compared at a time.
BITS = 256
WORDS = BITS // 64
NEAR = 4
ROWS = 256
#: Of each set's first shingles so many, the least, travel along: two sets that share any of these are paired at the
#: least one shared and nowhere else.
LEAST = 8
#: Groups of at most so many are compared whole at once, and rows that have no partner there are dropped before.
SMALL = 64
#: So many rows that go are broadcast, so texts don't move; more are joined.
BROADCAST_ROWS = 500_000
#: A slice's rows and the high bits of hashes share 64 bits while sorting.
_ROW_BITS = 21
_COUNTED, _COMMON, _TOLD = range(3)


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each n consecutive words of a row, where those of each row begin). Rows of fewer words have one, of none
    none."""
    own = word_hashes(words)
    count = np.diff(words.rows)
    many = np.where(count == 0, 0, np.maximum(count - n + 1, 1))
    bounds = np.concatenate([[0], np.cumsum(many)])
    if len(own) < n:
        out = np.zeros(bounds[-1], np.uint64)
    else:
        whole = rolled(own, n)
        first = np.repeat(words.rows[:-1] - bounds[:-1], many) + np.arange(bounds[-1])
        out = whole[np.minimum(first, len(whole) - 1)]
    for c in np.unique(count[(count > 0) & (count < n)]).tolist():
        rows = np.flatnonzero(count == c)
        out[bounds[rows]] = mix(rolled(own, c)[words.rows[rows]] ^ np.uint64(c))
    return out, bounds


def _sets(batches: Iterable[pa.RecordBatch], shingle: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, sorted distinct shingle hashes, where those of each row begin), some rows at a time; texts are column 1."""
    for batch in batches:
        for first, end, raw, offs in slices(batch.column(1)):
            for at in range(first, end, 1 << _ROW_BITS):
                upto = min(end, at + (1 << _ROW_BITS))
                own = offs[at - first : upto - first + 1]
                hashes, bounds = shingles(split(raw[own[0] : own[-1]], own - own[0], NON_SPACE, lower=True), shingle)
                row = np.repeat(np.arange(upto - at), np.diff(bounds))
                key = (row.astype(np.uint64) << np.uint64(64 - _ROW_BITS)) | (hashes >> np.uint64(_ROW_BITS))
                order = np.argsort(key)
                key, sets = key[order], hashes[order]
                tie = key[1:] == key[:-1]
                if np.any(tie & (sets[1:] != sets[:-1])):  # different hashes that are alike in their high bits
                    sets, tie = hashes[np.lexsort((hashes, row))], None
                new = np.ones(len(sets), bool)
                new[1:] = ~tie if tie is not None else (sets[1:] != sets[:-1]) | (row[1:] != row[:-1])
                yield batch.slice(at, upto - at), sets[new], np.searchsorted(row[new], np.arange(upto - at + 1))


def _nodes(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set; 0 for the empty one."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes), out=total[1:])
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def _bitmaps(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per set, the parity of how many of its shingles fall on each bit."""
    n = len(bounds) - 1
    bit = (mix(hashes) & np.uint64(BITS - 1)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(n), np.diff(bounds)) * BITS + bit, minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1, bitorder="little").view("<u8")


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Runs of values as binary strings."""
    values = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int64)), pa.py_buffer(values)]).cast(pa.binary())


def _dealt(part: np.ndarray, kind: int, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each part: the values of its entries as binary strings, in the order given."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    bounds = np.append(first, len(part))
    return pa.RecordBatch.from_arrays([pa.array(part[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32)), *(_binary(c[order], bounds) for c in columns.values())], ["part", "kind", *columns])


def _gathered(batches: Iterable[pa.RecordBatch], types: dict[int, dict]) -> dict[tuple[int, int], list[np.ndarray]]:
    """The columns of a partition's entries by part and kind; types: those of each kind's columns."""
    found: dict[tuple[int, int], list[list]] = {}
    for batch in batches:
        for k, (part, kind) in enumerate(zip(batch.column("part").to_pylist(), batch.column("kind").to_pylist())):
            for column, name in zip(found.setdefault((part, kind), [[] for _ in types[kind]]), types[kind]):
                column.append(batch.column(name)[k].as_buffer())
    return {at: [np.frombuffer(b"".join(column), t) for column, t in zip(columns, types[at[1]].values())] for at, columns in found.items()}


def least_overlap(size: np.ndarray, similarity: float) -> np.ndarray:
    """Of a set's shingles, how many any set of that similarity shares at least."""
    return np.ceil(similarity * size - 1e-9).astype(np.int64)


_ENTRIES = "part int, kind int, node binary, token binary, spare binary"


def _entries(shingle: int, similarity: float, n: int):
    """Each set's shingles, dealt to n parts, with how many of the set aren't wanted. A token is a shingle's part and the
    next 32 bits of its hash, so tokens gain bits with the number of parts; two shingles with one token count together,
    which changes the work and not the result."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            held = []
            for _, hashes, bounds in _sets([batch], shingle):
                low = hashes & np.uint64(0xFFFFFFFF)
                token = (hashes >> np.uint64(32)) * np.uint64(n) + (low * np.uint64(n) >> np.uint64(32))  # in the order of hashes
                row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                new = np.ones(len(token), bool)
                new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
                token, row = token[new], row[new]
                size = np.diff(bounds)
                spare = np.bincount(row, minlength=len(size)) - (size - least_overlap(size, similarity) + 1)
                held.append((_nodes(hashes, bounds)[row], token, spare[row].astype(np.int32)))
            node, token, spare = (np.concatenate(x) for x in zip(*held))
            if not len(token):
                continue
            ordered = np.sort(token)
            common = np.unique(ordered[COMMON - 1 :][ordered[COMMON - 1 :] == ordered[: max(0, len(ordered) - COMMON + 1)]])
            part = (token >> np.uint64(32)).astype(np.int64)
            if len(common):
                of = np.isin(token, common)
                # dealt by set and not by token: a common token's part would gather them all
                yield _dealt(_part(node[of], n), _COMMON, node=node[of], token=token[of], spare=spare[of])
                none = np.zeros(len(common), np.int64)
                yield _dealt((common >> np.uint64(32)).astype(np.int64), _TOLD, node=none, token=common, spare=none)
                node, token, spare, part = node[~of], token[~of], spare[~of], part[~of]
            yield _dealt(part, _COUNTED, node=node, token=token.astype(np.uint32), spare=spare)

    return run


def _part(node: np.ndarray, n: int) -> np.ndarray:
    return (mix(node.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def _run_lengths(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each run of equal values begins, its length)."""
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(values)))


def _counted(n: int):
    """The entries whose token several sets have, with its count, dealt by set."""
    wide = {"node": np.int64, "token": np.uint64, "spare": np.int32}
    types = {_COUNTED: wide | {"token": np.uint32}, _COMMON: wide, _TOLD: {"token": np.uint64}}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _gathered(batches, types)
        for (part, kind), columns in found.items():
            if kind == _TOLD:
                continue
            node, token, spare = columns
            if kind == _COMMON:
                count = np.full(len(token), COMMON, np.uint8)
            else:
                told = np.unique(found[part, _TOLD][0].astype(np.uint32)) if (part, _TOLD) in found else None
                order = np.argsort(token)
                _, many = _run_lengths(token[order])
                alone = np.repeat(many == 1, many)
                if told is not None:
                    alone &= ~np.isin(token[order], told)
                order = order[~alone]
                node, token, spare = node[order], token[order], spare[order]
                order = np.lexsort((node, token))
                node, token, spare = node[order], token[order], spare[order]
                new = np.ones(len(node), bool)  # several rows may have one set
                new[1:] = (node[1:] != node[:-1]) | (token[1:] != token[:-1])
                node, token, spare = node[new], token[new], spare[new]
                first, many = _run_lengths(token)
                count = np.repeat(np.where(np.isin(token[first], told), COMMON, np.minimum(many, COMMON)) if told is not None else np.minimum(many, COMMON), many).astype(np.uint8)
                keep = count > 1
                node, token, spare, count = node[keep], token[keep] | np.uint64(part << 32), spare[keep], count[keep]
            yield _dealt(_part(node, n), _COUNTED, node=node, token=token, spare=spare, count=count)

    return run


def _first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, least): of each set, the first shingles in the order of counts and tokens, but those of one set alone;
    with each, the LEAST least of them, filled up with the greatest number."""
    for node, token, spare, count in _gathered(batches, {_COUNTED: {"node": np.int64, "token": np.uint64, "spare": np.int32, "count": np.uint8}}).values():
        order = np.lexsort((token, count, node))
        node, token, spare = node[order], token[order], spare[order]
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (token[1:] != token[:-1])
        node, token, spare = node[new], token[new], spare[new]
        first, many = _run_lengths(node)
        keep = np.arange(len(node)) - np.repeat(first, many) < np.repeat(many - spare[first], many)
        token, node = token[keep], node[keep]
        order = np.lexsort((token, node))
        token, node = token[order], node[order]
        first, many = _run_lengths(node)
        least = np.full((len(first), LEAST), np.iinfo(np.uint64).max, np.uint64)
        place = np.arange(len(node)) - np.repeat(first, many)
        low = place < LEAST
        of = np.repeat(np.arange(len(first)), many)
        least[of[low], place[low]] = token[low]
        yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(node), _binary(least[of].ravel(), LEAST * np.arange(len(node) + 1))], ["key", "node", "least"])


def prefixes(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(key, node, least): the shingles of each set of docs (doc_id, text) by which candidates are found."""
    n = partitions(docs.sparkSession)
    counted = docs.mapInArrow(_entries(shingle, similarity, n), _ENTRIES).repartitionById(n, "part").mapInArrow(_counted(n), _ENTRIES + ", count binary")
    return counted.repartitionById(n, "part").mapInArrow(_first, "key long, node long, least binary")


def _groups(batches: Iterable[pa.RecordBatch], of) -> Iterator[pa.RecordBatch]:
    """of() on runs of batches, sorted by their first column, that hold whole groups of it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= LINK_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            key = table.column(0).to_numpy()
            end = int(np.searchsorted(key, key[-1]))
            if end:
                yield of(table.slice(0, end).combine_chunks())
            held = table.slice(end).combine_chunks().to_batches()
    if sum(map(len, held)):
        yield of(pa.Table.from_batches(held).combine_chunks())


def _allowed(a: np.ndarray, b: np.ndarray, size: np.ndarray, bits: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the bounds leave rows a and b the similarity."""
    most = (1 - similarity) / (1 + similarity) * (size[a] + size[b]) + 1e-6
    out = np.minimum(size[a], size[b]) >= similarity * np.maximum(size[a], size[b]) - 1e-6
    fit = np.flatnonzero(out)
    out[fit] = np.bitwise_count(bits[a[fit]] ^ bits[b[fit]]).sum(-1) <= most[fit]
    return out


def _bits(table: pa.Table, column: str = "bits", width: int = WORDS) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint64).reshape(-1, width)


def _here(a: np.ndarray, b: np.ndarray, key: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Whether rows a and b of a group are paired in it: not if they meet at another of their least shingles."""
    out = np.ones(len(a), bool)
    for at in range(0, len(a), LINK_ROWS // LEAST):
        part = slice(at, at + LINK_ROWS // LEAST)
        one, other = least[a[part]], least[b[part]]
        shared = (one[:, :, None] == other[:, None, :]).any(axis=2) & (one != np.iinfo(np.uint64).max)
        first = one[np.arange(len(one)), shared.argmax(axis=1)]
        out[part] = ~shared.any(axis=1) | (first == key[a[part]].view(np.uint64))
    return out


def _plausible(similarity: float):
    """The rows (key, node, size, bits, least) but those of small groups that the bounds leave no partner."""

    def of(table: pa.Table) -> pa.RecordBatch:
        key, size, bits = table.column("key").to_numpy(), table.column("size").to_numpy(), _bits(table)
        many = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
        keep = np.repeat(many, many) > SMALL
        for k in range(1, min(SMALL, len(key))):
            a = np.flatnonzero((key[k:] == key[:-k]) & ~(keep[k:] & keep[:-k]))
            if not len(a):
                continue
            ok = a[_allowed(a, a + k, size, bits, similarity)]
            keep[ok] = keep[ok + k] = True
        return table.filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else pa.RecordBatch.from_pylist([], table.schema)

    return lambda batches: _groups(batches, of)


def _pairs(similarity: float, across: bool):
    """Pairs to verify within groups of rows (key, node, size, bits, least, root): of different roots whose bounds allow
    the similarity. Neighbours and whole small groups, or across: all pairs of the other groups."""

    def of(table: pa.Table) -> pa.RecordBatch:
        key, node, size, root = (table.column(c).to_numpy() for c in ("key", "node", "size", "root"))
        bits, least = _bits(table), _bits(table, "least", LEAST)

        found = [np.zeros((0, 2), np.int64)]

        def add(a: np.ndarray, b: np.ndarray, once: np.ndarray | bool = True) -> None:
            """once: which pairs are kept to one group."""
            ok = _allowed(a, b, size, bits, similarity)
            a, b, once = a[ok], b[ok], np.broadcast_to(once, ok.shape)[ok]
            here = ~once
            here[once] = _here(a[once], b[once], key, least)
            a, b = node[a[here]], node[b[here]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))

        if not across:
            many = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
            for order in (np.lexsort((node, key)), np.lexsort((node, size, key))):
                small = np.repeat(many, many)[order] <= SMALL
                for k in range(1, min(SMALL, len(order))):
                    a, b = order[:-k], order[k:]
                    same = (key[a] == key[b]) & (small[:-k] | (k <= NEAR))
                    if not same.any():
                        break
                    same &= root[a] != root[b]
                    add(a[same], b[same], small[:-k][same])
        else:
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            for at, end in zip(first, np.append(first[1:], len(key))):
                if end - at <= SMALL:
                    continue
                names, which, n = np.unique(root[at:end], return_inverse=True, return_counts=True)
                if len(names) == 1:
                    continue
                rest, every = at + np.flatnonzero(which != n.argmax()), np.arange(at, end)
                for k in range(0, len(rest), ROWS):
                    a, b = (x.ravel() for x in np.meshgrid(rest[k : k + ROWS], every, indexing="ij"))
                    apart = root[a] != root[b]
                    for j in range(0, len(a), LINK_ROWS):
                        part = slice(j, j + LINK_ROWS)
                        add(a[part][apart[part]], b[part][apart[part]])
                found[:] = [np.unique(np.concatenate(found), axis=0)]
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    return lambda batches: _groups(batches, of)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity."""
    a, b = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"of_{c}")) for c in "uv")
    both = F.size(F.array_intersect("of_u", "of_v"))
    return cut(pairs.join(a, "u").join(b, "v").filter(both >= F.lit(similarity) * (F.size("of_u") + F.size("of_v") - both) - 1e-9).select("u", "v"))


def _filter(hashes: DataFrame) -> np.ndarray:
    """A table of bits with those of all hashes in column text_hash set."""
    words = hashes.select(F.pmod("text_hash", F.lit(1 << FILTER_BITS)).alias("bit")).selectExpr("shiftright(bit, 5) as w", "shiftleft(1L, cast(bit % 32 as int)) as b").groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("b").to_numpy()
    return out


def fingerprint_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(u, v): pairs of different sets that connect what SimHash finds near, not verified yet. prints: (node, fp)."""
    own = cut(prints.groupBy("node").agg(F.first("fp").alias("fp")))
    first = cut(own.groupBy("fp").agg(F.min("node").alias("first")))
    same = own.join(first, "fp").filter("node <> first").select(F.col("first").alias("u"), F.col("node").alias("v"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}")) for c in "uv")
    near = simhash.links(first, distance).distinct().join(a, "u").join(b, "v").select(F.col("first_u").alias("u"), F.col("first_v").alias("v"))
    return same.union(near)


def _leaders(links: DataFrame) -> DataFrame:
    """(node, root) of each node of links (u, v): its least neighbour or itself. Nodes of one root are connected, though
    connected ones may have different roots; it takes one grouping where components take a dozen and more."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root"))


def roots_of(docs: DataFrame, prints: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(node, root) of the sets of docs (doc_id, text, text_hash) that have a link: components as all pairs of the
    similarity would give. prints: (text_hash, node, size, bits, fp) of its rows. SimHash's links come first, the prefix
    filter's between what these leave apart. Components are found before large groups are compared, and again only if
    links come of that, from the stars found before."""
    spark = docs.sparkSession
    n = partitions(spark)
    own = prints.groupBy("node").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    dealt = prefixes(docs, shingle, similarity).join(own, "node").select("key", "node", "size", "bits", "least").repartition(n, "key").sortWithinPartitions("key")
    shared = cut(dealt.mapInArrow(_plausible(similarity), "key long, node long, size long, bits binary, least binary"))
    nodes = shared.select("node").distinct()
    wanted = spark.sparkContext.broadcast(_filter(prints.join(nodes, "node").groupBy("node").agg(F.min("text_hash").alias("text_hash"))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = wanted.value
        for batch in batches:
            bit = batch.column(2).to_numpy() & ((1 << FILTER_BITS) - 1)
            batch = batch.filter(pa.array(((table[bit >> 5] >> (bit & 31).astype(np.uint32)) & np.uint32(1)).astype(bool)))
            for _, hashes, bounds in _sets(bounded([batch]), shingle):
                yield pa.RecordBatch.from_arrays([pa.array(_nodes(hashes, bounds)), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))], ["node", "hashes"])

    found = docs.mapInArrow(run, "node long, hashes array<long>").join(nodes, "node", "left_semi")
    sets = cut(found.dropDuplicates(["node"]))

    def pairs(roots: DataFrame, across: bool) -> DataFrame:
        rows = shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = rows.select("key", "node", "size", "bits", "least", "root").repartition(n, "key").sortWithinPartitions("key")
        return rows.mapInArrow(_pairs(similarity, across), "u long, v long").distinct()

    hashed = _verified(fingerprint_links(prints), sets, similarity)
    # here roots only spare pairs, of which small groups and neighbours are few anyway
    near = hashed.union(_verified(pairs(_leaders(hashed), False), sets, similarity))
    roots = components(near)
    rest = cut(pairs(roots, True))
    if rest.isEmpty() or (more := _verified(rest, sets, similarity)).isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the row of the smallest id of each component, columns as they were. Links are all pairs of rows whose
    sets of lower-cased word shingles have a Jaccard similarity of at least so much.

    A text of fewer words is one shingle; null and blank texts have none and are copies of one another. Rows with null
    ids are nobody's copy and stay, as do rows that repeat an id and text that stays; no rows give no rows.
    """
    text_hash = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(whole_id(docs, id_col).alias("doc_id"), F.col(text_col).alias("text"), text_hash.alias("text_hash"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, hashes, bounds in _sets(bounded(batches), shingle):
            bits = _binary(_bitmaps(hashes, bounds).ravel(), WORDS * np.arange(len(rows) + 1))
            fp = simhash.majority_bits(mix(hashes), bounds).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(_nodes(hashes, bounds)), pa.array(np.diff(bounds)), bits, pa.array(fp)], ["doc_id", "text_hash", "node", "size", "bits", "fp"])

    prints = cut(texts.mapInArrow(run, "doc_id long, text_hash long, node long, size long, bits binary, fp long"))
    own = cut(prints.groupBy("node").agg(F.min("doc_id").alias("least_id")))
    found = roots_of(texts, prints, shingle, similarity)
    placed = own.select("node", "least_id").join(found, "node", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    linked = placed.filter("root is not null")
    least = linked.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    classes = placed.filter("root is null").select("node", F.col("least_id").alias("component_id")).unionByName(linked.join(least, ["root", "salt"]).select("node", "component_id"))
    gone = cut(prints.join(classes, "node").filter("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, (whole_id(docs, id_col) == gone["__id"]) & (text_hash == gone["__hash"]), "left_anti")
