"""Call graph: resolving references to symbols, neighbours, and PageRank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.operators.lineage import cut, dealt


def winners(names: DataFrame, order: list[Column]) -> DataFrame:
    """(ref_name, to_id): of the symbols of each name (id, name, ...) the last in the order given."""
    return names.groupBy(F.col("name").alias("ref_name")).agg(F.max_by("id", F.struct(*order)).alias("to_id"))


def resolved(refs: DataFrame, last: DataFrame) -> DataFrame:
    """(from_id, to_id, ref_name): refs (caller_id, ref_name) to the winners of their names; calls of oneself and
    unknown names are dropped, repeats kept once."""
    return refs.join(last, "ref_name").filter("caller_id <> to_id").select(F.col("caller_id").alias("from_id"), "to_id", "ref_name").distinct()


def call_edges(refs: DataFrame, names: DataFrame, order: list[Column]) -> DataFrame:
    """(from_id, to_id): refs (caller_id, ref_name) to the symbol of that name, the last in the order given of names
    (id, name, ...)."""
    return resolved(refs, winners(names, order)).select("from_id", "to_id")


def refreshed_edges(edges: DataFrame, refs: DataFrame, was: DataFrame, names: DataFrame, stale: DataFrame, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(edges kept, edges made anew) after symbols were replaced. edges: (from_id, to_id, ref_name) of before; refs:
    (caller_id, ref_name) and names of now, was: names of before; stale: (id, name) of the symbols that went or came.
    An edge is kept unless its caller is stale or the winner of its name is another one."""
    touched = stale.select(F.col("name").alias("ref_name")).distinct()
    last = lambda table: winners(table.join(touched, table["name"] == touched["ref_name"], "left_semi"), order)
    before, now = last(was).withColumnRenamed("to_id", "old"), last(names)
    moved = cut(before.join(now, "ref_name", "full_outer").filter(~F.col("old").eqNullSafe(F.col("to_id"))).select("ref_name"))
    callers_ = cut(stale.select(F.col("id").alias("caller_id")).distinct())
    kept = edges.join(moved, "ref_name", "left_anti").join(callers_, edges["from_id"] == callers_["caller_id"], "left_anti")
    again = refs.join(callers_, "caller_id", "left_semi").unionByName(refs.join(callers_, "caller_id", "left_anti").join(moved, "ref_name", "left_semi"))
    asked = again.select("ref_name").distinct()
    known = winners(names.join(asked, names["name"] == asked["ref_name"], "left_semi"), order)
    return kept.select("from_id", "to_id", "ref_name"), resolved(again, known)


def callers(symbols: DataFrame, edges: DataFrame, id_: Column) -> DataFrame:
    return symbols.join(edges.filter(F.col("to_id") == id_), symbols.id == edges.from_id, "left_semi")


def callees(symbols: DataFrame, edges: DataFrame, id_: Column) -> DataFrame:
    return symbols.join(edges.filter(F.col("from_id") == id_), symbols.id == edges.to_id, "left_semi")


def out_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, out_degree) of every node; 0 for dangling ones."""
    n = edges.groupBy("from_id").agg(F.count("*").alias("out_degree"))
    return nodes.select("id").join(n, F.col("id") == F.col("from_id"), "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


#: Rounds between checkpoints; in between, a round's ranks are held by the executors and can be made again.
CHECKPOINT_ROUNDS = 5


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float = 1e-6, start: DataFrame | None = None, told: dict | None = None) -> DataFrame:
    """(id, rank) of every node. Dangling mass is spread evenly; ends after the round whose ranks changed by less than
    tolerance together. A round is one join, one aggregation and one number back. start: (id, rank) to go on from, for
    nodes that were there before; others begin at an even share, and all are brought to a sum of one. told: gets the
    rounds made and the last change."""
    n = nodes.count()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    degree = cut(out_degrees(nodes, edges))
    # dealt and sorted by caller once; a round then moves ranks and sums, not links
    links = dealt(cut(edges.select("from_id", "to_id").join(degree.withColumnRenamed("id", "from_id"), "from_id")), "from_id", 1).sortWithinPartitions("from_id").persist()
    rank = degree.select("id", "out_degree", F.lit(1.0 / n).alias("rank"))
    if start is not None:
        rank = degree.join(start.select("id", "rank"), "id", "left").select("id", "out_degree", F.coalesce("rank", F.lit(1.0 / n)).alias("rank"))
        rank = cut(rank)
        rank = rank.withColumn("rank", F.col("rank") / F.lit(rank.agg(F.sum("rank")).first()[0]))
    loose = F.coalesce(F.sum(F.when(F.col("out_degree") == 0, F.col("rank"))), F.lit(0.0))
    dangling = rank.agg(loose).first()[0]
    held: list[DataFrame] = []
    for k in range(1, rounds + 1):
        came = links.join(rank.select(F.col("id").alias("from_id"), "rank"), "from_id").groupBy("to_id").agg(F.sum(F.col("rank") / F.col("out_degree")).alias("came"))
        new = rank.join(came, rank.id == came.to_id, "left").select(
            "id", "out_degree", (F.lit((1 - damping) / n + damping * dangling / n) + damping * F.coalesce("came", F.lit(0.0))).alias("rank"), F.col("rank").alias("was"))
        new = cut(new) if k % CHECKPOINT_ROUNDS == 0 else new.persist()
        held += [] if k % CHECKPOINT_ROUNDS == 0 else [new]
        change, dangling = new.agg(F.coalesce(F.sum(F.abs(F.col("rank") - F.col("was"))), F.lit(0.0)), loose).first()
        rank = new.drop("was")
        if told is not None:
            told.update(rounds=k, change=change)
        if change < tolerance:
            break
    out = cut(rank.select("id", "rank"))
    for df in [*held, links]:
        df.unpersist()
    return out


def relevant_edges(symbols: DataFrame, edges: DataFrame, description: str, cap: int = 20) -> DataFrame:
    """(ord, direction, line, other_id): "caller() → callee()" for the callers and callees of symbols whose name has a
    word of the description (over three bytes). Symbols come in their order; one that begins at most cap lines in is
    listed whole, later ones are not. So at most cap + 1 symbols are listed, and only their counts are added up."""
    words = [w for w in description.lower().split() if len(w.encode()) > 3]
    wanted = symbols.filter(F.exists(F.lit(words) if words else F.array().cast("array<string>"), lambda w: F.contains(F.lower("name"), w))).select("id", "ord", "name")
    side = lambda direction, own, other: wanted.join(edges, F.col("id") == F.col(own)).select("id", "ord", "name", F.lit(direction).alias("direction"), F.col(other).alias("other_id"))
    links = side("caller", "to_id", "from_id").unionByName(side("callee", "from_id", "to_id"))
    found = links.join(symbols.select(F.col("id").alias("other_id"), F.col("name").alias("other")), "other_id")
    first = found.groupBy("id", "ord").agg(F.count("*").alias("n")).orderBy("ord", "id").limit(cap + 1)
    before = F.coalesce(F.sum("n").over(W.Window.orderBy("ord", "id").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    listed = first.withColumn("before", before).filter(F.col("before") <= cap).select("id")
    line = F.when(F.col("direction") == "caller", F.format_string("%s() → %s()", "other", "name")).otherwise(F.format_string("%s() → %s()", "name", "other"))
    return found.join(F.broadcast(listed), "id").select("ord", "direction", line.alias("line"), "other_id")
