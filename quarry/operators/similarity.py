"""Exact similarity joins of two tables of sets, by an inverted index over what similar sets must share.

Items are put in one order, rare ones first. A set that is to share so many of its items with another may miss only the
rest; so of its first items, k more than it may miss, k at least are shared. Only these are joined, on equal items, and
pairs that share fewer of them are out. Each other pair is verified once, on whole sets. Joins are on equal keys
throughout, and an item that many sets have is seldom among a set's first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import minhash, text

#: Of grams, which are common, so many have to be shared among the first.
SHARED = 16
#: Keeps rounding of thresholds on the side of one candidate more.
_MARGIN = 1e-9


def _least(threshold: float, n: Column) -> Column:
    """The fewest of n items that are a share of at least threshold."""
    return F.ceil(threshold * n - _MARGIN)


def _first(items: Column, spare: Column) -> Column:
    """How many of the items (fields: many), taken in order, hold more than spare occurrences."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("k"))
    step = lambda a, x: F.when(a["sum"] > spare, a).otherwise(F.struct((a["sum"] + x["many"]).alias("sum"), (a["k"] + 1).alias("k")))
    return F.aggregate(items, start, step)["k"]


def containment_candidates(held: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    """(id, new_id) of all pairs, and few others, where b has a share of at least threshold of a's items, repeats
    counted. held: (id, a), asked: (new_id, b), arrays. Items that no b has are missing for certain and never move."""
    wanted = asked.select("new_id", F.explode(F.array_distinct("b")).alias("item"))
    common = wanted.groupBy("item").agg(F.count("*").alias("df"))
    present = held.select("id", F.size("a").alias("n"), F.explode("a").alias("item")).join(common, "item").groupBy("id", "n", "item", "df").agg(F.count("*").alias("many"))
    sets = present.groupBy("id", "n").agg(F.sum("many").alias("present"), F.array_sort(F.collect_list(F.struct("df", "item", "many"))).alias("items"))
    sets = sets.filter(F.col("present") >= _least(threshold, F.col("n")))
    first = sets.select("id", F.explode(F.slice("items", F.lit(1), _first(F.col("items"), F.col("present") - _least(threshold, F.col("n"))))).alias("x"))
    return first.select("id", F.col("x.item").alias("item")).join(wanted, "item").select("id", "new_id").distinct()


def _bucket(n: Column, threshold: float) -> Column:
    """A logarithm of n whose step is the largest ratio of two similar sets' sizes: theirs differ by one at most."""
    return F.floor(F.log(n) / F.log(F.lit(1 / threshold)) + _MARGIN)


def jaccard_candidates(held: DataFrame, asked: DataFrame, threshold: float, shared: int = SHARED) -> DataFrame:
    """(id, new_id) of all pairs, and few others, whose sets have a Jaccard similarity of at least threshold.
    held: (id, a), asked: (new_id, b), arrays without repeats. Sets meet only where their sizes allow it."""
    sized = lambda df, c: df.filter(F.size(c) > 0).withColumn("n", F.size(c)).withColumn("size", _bucket(F.col("n"), threshold))
    near = F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))
    sizes = sized(asked, "b").select(near.alias("size")).distinct()  # one row for each power of a ratio: a few dozen
    left = sized(held, "a").join(F.broadcast(sizes), "size", "left_semi").select("id", "n", "size", F.explode("a").alias("item"))
    right = sized(asked, "b").select("new_id", "n", "size", F.explode("b").alias("item"))
    count = lambda df, name: df.groupBy("item").agg(F.count("*").alias(name))
    common = count(left, "x").join(count(right, "y"), "item").select("item", (F.col("x") + F.col("y")).alias("df"))

    def first(rows: DataFrame, key: str) -> DataFrame:
        sets = rows.join(common, "item").groupBy(key, "n", "size").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("items"))
        spare = F.size("items") - _least(threshold, F.col("n"))
        return sets.filter(spare >= 0).select(key, "n", "size", F.size("items").alias("present"), F.posexplode(F.slice("items", F.lit(1), (spare + shared).cast("int"))).alias("at", "x")).select(key, "n", "size", (F.col("present") - F.col("at") - 1).alias("rest"), F.col("x.item").alias("item"))

    a = first(left, "id")
    b = first(right, "new_id").select("new_id", F.col("n").alias("m"), near.alias("size"), F.col("rest").alias("other"), "item")
    pairs = a.join(b, ["item", "size"]).filter(F.least("n", "m") >= threshold * F.greatest("n", "m") - _MARGIN)
    met = pairs.groupBy("id", "new_id", "n", "m").agg(F.count("*").alias("met"), F.least(F.min("rest"), F.min("other")).alias("more"))
    # all that the sets share up to the last item met has been met; what follows it is at most the shorter rest
    need = F.ceil(threshold / (1 + threshold) * (F.col("n") + F.col("m")) - _MARGIN)
    return met.filter((F.col("met") >= F.least(F.lit(shared), need)) & (F.col("met") + F.col("more") >= need)).select("id", "new_id")


def verified(held: DataFrame, asked: DataFrame, candidates: DataFrame, score: Callable[[Column, Column], Column], threshold: float) -> DataFrame:
    """(id, new_id, score) of the candidates that score at least the threshold. Whole sets meet a pair once."""
    pairs = candidates.join(held, "id").join(asked, "new_id")
    return pairs.select("id", "new_id", score(F.col("a"), F.col("b")).alias("score")).filter(F.col("score") >= threshold)


def containment_join(held: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    return verified(held, asked, containment_candidates(held, asked, threshold), text.token_overlap, threshold)


def jaccard_join(held: DataFrame, asked: DataFrame, threshold: float) -> DataFrame:
    return verified(held, asked, jaccard_candidates(held, asked, threshold), text.jaccard, threshold)


def signature_join(held: DataFrame, asked: DataFrame, threshold: float, which: Column | None = None) -> DataFrame:
    """(id, new_id, score) of signatures with a share of at least threshold of equal slots. Bands are so many that each
    such pair shares one; a pair is made at the first that it shares. which: a condition on the ids, if any."""
    banded = lambda df, key, c, to: df.select(key, F.col(c).alias(to), minhash.bands(F.col(c), threshold).alias(f"{to}_bands"))
    left, right = banded(held, "id", "a", "a"), banded(asked, "new_id", "b", "b")
    exploded = lambda df, c: df.select("*", F.posexplode(f"{c}_bands").alias("band", "key"))
    pairs = exploded(left, "a").join(exploded(right, "b").select("new_id", "b", "b_bands", "band", "key"), ["band", "key"])
    first = F.array_position(F.zip_with("a_bands", "b_bands", lambda x, y: x == y), True) - 1
    once = (pairs if which is None else pairs.filter(which)).filter(F.col("band") == first)
    return once.select("id", "new_id", minhash.similarity(F.col("a"), F.col("b")).alias("score")).filter(F.col("score") >= threshold)
