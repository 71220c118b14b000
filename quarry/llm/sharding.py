"""Sharding: best-fit-decreasing packing of indivisible groups of equal texts.

Packing takes the groups in order of size, the largest first, and puts each into the bin whose remaining capacity is
the tightest that still holds it. Groups of one size are alike, so the driver packs a histogram: a run of groups of one
size enters the tightest bin until that bin holds no more. The histogram has at most sqrt(2 x total bytes) entries,
since different sizes add up; no document or group reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.frames import cut, positioned, spread_join, whole_id

#: Runs of the plan that are broadcast; of more, each block of so many places meets its runs in a shuffle.
PLAN_ROWS = 100_000
BLOCK_PLACES = 65_536


class _Node:
    __slots__ = ("key", "level", "less", "more")

    def __init__(self, key):
        self.key, self.level, self.less, self.more = key, 1, None, None


def _skew(t):
    if t.less is not None and t.less.level == t.level:
        low = t.less
        t.less, low.more = low.more, t
        return low
    return t


def _split(t):
    if t.more is not None and t.more.more is not None and t.more.more.level == t.level:
        high = t.more
        t.more, high.less = high.less, t
        high.level += 1
        return high
    return t


class Remaining:
    """Bins by (remaining capacity, bin) in a balanced tree (AA tree): logarithmic insert, remove and tightest fit."""

    def __init__(self):
        self.root = None

    def insert(self, key) -> None:
        def put(t):
            if t is None:
                return _Node(key)
            if key < t.key:
                t.less = put(t.less)
            else:
                t.more = put(t.more)
            return _split(_skew(t))

        self.root = put(self.root)

    def remove(self, key) -> None:
        def out(t, key):
            if t is None:
                return None
            if key < t.key:
                t.less = out(t.less, key)
            elif t.key < key:
                t.more = out(t.more, key)
            elif t.less is None and t.more is None:
                return None
            elif t.less is None:
                near = t.more
                while near.less is not None:
                    near = near.less
                t.key = near.key
                t.more = out(t.more, near.key)
            else:
                near = t.less
                while near.more is not None:
                    near = near.more
                t.key = near.key
                t.less = out(t.less, near.key)
            level = min(t.less.level if t.less else 0, t.more.level if t.more else 0) + 1
            if level < t.level:
                t.level = level
                if t.more is not None and t.more.level > level:
                    t.more.level = level
            t = _skew(t)
            if t.more is not None:
                t.more = _skew(t.more)
                if t.more.more is not None:
                    t.more.more = _skew(t.more.more)
            t = _split(t)
            if t.more is not None:
                t.more = _split(t.more)
            return t

        self.root = out(self.root, key)

    def tightest(self, need: int):
        """The least key with at least that capacity, or None."""
        t, best = self.root, None
        while t is not None:
            if t.key[0] >= need:
                best, t = t.key, t.less
            else:
                t = t.more
        return best


def pack(sizes: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple[int, int, int]] | None:
    """Best-fit-decreasing: (size, number of groups, bin) in the order of packing. sizes: (size, number of groups).

    Without bins, a new bin opens where none fits (a larger group than capacity gets one alone); with bins, all are
    open from the start and the result is None if a group fits nowhere.
    """
    tree, made = Remaining(), 0
    for b in range(bins or 0):
        tree.insert((capacity, b))
        made = b + 1
    runs = []
    for size, left in sorted(sizes, reverse=True):
        while left:
            place = tree.tightest(size)
            if place is None:
                if bins is not None:
                    return None
                place = (max(capacity, size), made)
                made += 1
            else:
                tree.remove(place)
            room, b = place
            take = min(left, room // size if size else left)
            runs.append((size, take, b))
            left -= take
            tree.insert((room - take * size, b))
    return runs


def pack_evenly(sizes: list[tuple[int, int]], bins: int) -> list[tuple[int, int, int]]:
    """pack() into a fixed number of bins at the least capacity found. Groups over an even share get bins alone, the
    rest share the other bins evenly."""
    todo = {s: n for s, n in sizes if n}
    total, runs, free = sum(s * n for s, n in todo.items()), [], bins
    while todo and free > 1 and (top := max(todo)) * free > total:
        runs.append((top, 1, bins - free))
        total, free = total - top, free - 1
        todo[top] -= 1
        if not todo[top]:
            del todo[top]
    if todo:
        rest, low = list(todo.items()), -(-total // free)
        high = low + max(todo)
        best = pack(rest, low, free)
        while best is None and low + 1 < high:
            mid = (low + high) // 2
            if pack(rest, mid, free) is None:
                low = mid
            else:
                high = mid
        runs += [(s, n, b + bins - free) for s, n, b in best or pack(rest, high, free)]
    return runs


def shard(docs: DataFrame, shards: int | None = 24, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = 8) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ("bytes"), shard, slot, grown_shard (null).

    shards: that many of nearly equal bytes; or None, and as few as best-fit-decreasing finds of the given capacity.
    Equal texts stay together; null counts as empty. Size: bytes of the text plus overhead. Slots are gapless from 0 in
    each shard, in the order of groups and ids, nulls first; repeated rows get slots of their own. Other columns are
    ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = cut(docs.select(whole_id(docs, id_col).alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")))
    groups = rows.groupBy("digest").agg(F.sum("size").alias("weight"), F.count("*").alias("n"))
    groups = positioned(groups, F.desc("weight"), F.col("digest"), name="place")
    sizes = [(r[0], r[1]) for r in groups.groupBy("weight").count().collect()]
    runs = pack_evenly(sizes, shards) if capacity is None else pack(sizes, capacity)
    plan, at = [], 0
    for _, n, b in sorted(runs, key=lambda r: -r[0]):
        plan.append((at, at + n, b))
        at += n
    names = T.StructType([T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("shard", T.IntegerType())])
    block = lambda c: F.floor(c / BLOCK_PLACES)
    plan_df = spark.createDataFrame(plan, names).withColumn("block", F.explode(F.sequence(block(F.col("low")), block(F.col("high") - 1))))
    plan_df = F.broadcast(plan_df) if len(plan) <= PLAN_ROWS and at <= PLAN_ROWS * BLOCK_PLACES else plan_df
    placed = groups.withColumn("block", block(F.col("place"))).join(plan_df, "block").filter("place >= low and place < high").select("digest", "n", "shard", "place")
    dealt = positioned(spread_join(rows, cut(placed), ["digest"]), F.col("shard"), F.col("place"), F.col("doc_id"), name="at")
    counts = dict(dealt.groupBy("shard").count().collect())
    first, total = {}, 0
    for b in sorted(counts):
        first[b], total = total, total + counts[b]
    base = F.element_at(F.create_map(*[F.lit(x) for kv in first.items() for x in kv]), F.col("shard")) if first else F.lit(0)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - base).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
