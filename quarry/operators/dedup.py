"""Near-duplicate tasks: four similarity layers, their cascade, an all-pairs join by MinHash and ordered admission.

New descriptions meet tasks by inverted indexes (see similarity), so every join is on equal keys. Equal descriptions are
one class: a class is compared once, and its task of highest priority stands for it.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.functions import minhash, scan, text
from quarry.operators import similarity
from quarry.operators.lineage import cut, dealt, spread

#: Three sets of statuses that count as active: for the first-match layer and admission, for scored layers, for counts.
FIRST_MATCH_ORDER = ("executing", "pending", "approved", "created", "classified")
NOT_SCORED = ("done", "failed", "rejected", "pending_clarification")
NOT_COUNTED = ("done", "failed", "rejected", "interrupted")


@dataclass(frozen=True)
class Layer:
    """prepare: from a description to what score() compares. score(existing, new) is from 0 to 1. join(held, asked,
    threshold): (id, new_id, score) of all pairs of held (id, a) and asked (new_id, b) that score at least that."""

    name: str
    threshold: float
    prepare: Callable[[Column], Column]
    score: Callable[[Column, Column], Column]
    join: Callable[[DataFrame, DataFrame, float], DataFrame]


KEYWORD = Layer("keyword", 0.80, text.tokens, text.token_overlap, similarity.containment_join)
TRIGRAM = Layer("trigram", 0.55, scan.trigram_codes, text.jaccard, similarity.jaccard_join)
MINHASH = Layer("minhash", 0.70, scan.signature, minhash.similarity, similarity.signature_join)
TFIDF_THRESHOLD = 0.60
#: What share of the limit a description's light terms may add at most.
LIGHT = 0.5
#: Tasks of a partition where their terms, and what they share with new descriptions, are added up.
HIT_ROWS = 5_000
#: So many terms, or pairs, are broadcast; more are joined.
ASKED_ROWS = 500_000


def threshold(value: str | None, default: float) -> float:
    """A threshold from a setting: a number above 0 and up to 1, else the default."""
    try:
        x = float(value) if value is not None else default
    except ValueError:
        return default
    return x if 0 < x <= 1 else default


def _joined(tasks: DataFrame, new: DataFrame, layer: Layer) -> DataFrame:
    """(id, new_id, score) of all pairs of tasks (id, description) and new (new_id, description) that reach the
    layer's threshold. Both sides are prepared once and kept, since an index reads them more than once."""
    held = cut(spread(tasks.select("id", "description")).select("id", layer.prepare(F.col("description")).alias("a")))
    asked = cut(new.select("new_id", layer.prepare(F.col("description")).alias("b")))
    return layer.join(held, asked, layer.threshold)


def scored(tasks: DataFrame, new: DataFrame, layer: Layer) -> DataFrame:
    """(new_id, id, created_at, status, score) of all pairs that score at least the layer's threshold.
    tasks: (id, description, status, created_at); new: (new_id, description)."""
    return _joined(tasks, new, layer).join(tasks.select("id", "created_at", "status"), "id").select("new_id", "id", "created_at", "status", "score")


def _classes(tasks: DataFrame, *priority: Column) -> DataFrame:
    """tasks with one row for each description: the first by priority, then by id."""
    cols = ("id", "description", "status", "created_at")
    first = F.min_by(F.struct(*cols), F.struct(*priority, F.col("id")))
    return tasks.groupBy(F.sha2(F.coalesce("description", F.lit("")), 256)).agg(first.alias("t")).select("t.*")


def _age() -> Column:
    """Sorts the newest first, for times and numbers alike."""
    return -F.col("created_at").cast("double")


def _priority() -> Column:
    return F.array_position(F.lit(list(FIRST_MATCH_ORDER)), F.col("status"))


def first_match(tasks: DataFrame, new: DataFrame, layer: Layer = KEYWORD) -> DataFrame:
    """(new_id, id, score): of each new description the first hit by status, then the newest."""
    order = (_priority(), _age())
    hits = scored(_classes(tasks.filter(F.col("status").isin(*FIRST_MATCH_ORDER)), *order), new, layer)
    return hits.groupBy("new_id").agg(F.min_by(F.struct("id", "score"), F.struct(*order, "id")).alias("m")).select("new_id", "m.id", "m.score")


def best_match(tasks: DataFrame, new: DataFrame, layer: Layer) -> DataFrame:
    """(new_id, id, score): the best hit, of equal ones the newest."""
    return _best(scored(_classes(tasks.filter(~F.col("status").isin(*NOT_SCORED)), _age()), new, layer))


def _best(hits: DataFrame) -> DataFrame:
    return hits.filter("score > 0").groupBy("new_id").agg(F.min_by(F.struct("id", "score"), F.struct(-F.round("score", 12), _age(), "id")).alias("m")).select("new_id", "m.id", "m.score")


def tfidf_scores(tasks: DataFrame, new: DataFrame, limit: float = TFIDF_THRESHOLD) -> DataFrame:
    """(new_id, id, created_at, score) of cosines of at least limit. Each new description has a corpus of its own, the
    tasks and itself, so its own terms count once more: shared terms alone change a task's norm.

    A description's lightest terms, the common ones, together add less than a part of the limit to any cosine. So its
    others are joined first, and only where these come so near that the light ones could decide, are they joined, too."""
    n = tasks.count() + 1
    words = dealt(tasks.select("id", "created_at", text.tokens(F.col("description")).alias("w")), "id", n // HIT_ROWS)
    # dealt by task, so that all that is grouped by task and more stays where it is
    tf = words.select("id", "created_at", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("id", "created_at", "len", "term").agg((F.count("*") / F.first("len")).alias("tf")).drop("len")
    df = cut(tf.groupBy("term").agg(F.count("*").alias("df")))
    idf = lambda d: F.log(F.lit(1 + n) / (1 + d)) + 1
    asked = new.select("new_id", text.tokens(F.col("description")).alias("w")).select("new_id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("new_id", "len", "term").agg((F.count("*") / F.first("len")).alias("qtf"))
    asked = asked.join(df, "term", "left").select("new_id", "term", idf(F.col("df")).alias("idf0"), idf(F.col("df") + 1).alias("idf1"), (F.col("qtf") * idf(F.coalesce("df", F.lit(0)) + 1)).alias("qw"))
    order = W.Window.partitionBy("new_id").orderBy("qw", "term").rowsBetween(W.Window.unboundedPreceding, 0)
    square = F.pow("qw", F.lit(2))
    asked = asked.withColumn("upto", F.sqrt(F.sum(square).over(order))).withColumn("qnorm", F.sqrt(F.sum(square).over(W.Window.partitionBy("new_id"))))
    light = F.col("upto") < LIGHT * (limit - 1e-9) * F.col("qnorm")
    asked = cut(asked.withColumn("light", light).withColumn("below", F.max(F.when(F.col("light"), F.col("upto")).otherwise(0.0)).over(W.Window.partitionBy("new_id"))).drop("upto"))
    dot, more = F.sum(F.col("tf") * F.col("idf1") * F.col("qw")), F.sum(F.pow("tf", F.lit(2)) * (F.pow("idf1", F.lit(2)) - F.pow("idf0", F.lit(2))))
    # what is asked has its terms' frequencies, so tasks' terms needn't meet them, and stay where they are if it is small
    held = lambda rows: F.broadcast(rows) if rows.count() <= ASKED_ROWS else rows
    # a task's norm in the description's corpus is at least so much of its own
    least = min([0.998] + [1 - math.log((2 + d) / (1 + d)) / (math.log((1 + n) / (1 + d)) + 1) for d in range(1, min(n, 1000))])
    base = tf.join(held(df), "term").groupBy("id").agg(F.sum(F.pow(F.col("tf") * idf(F.col("df")), 2)).alias("base"))
    first = tf.join(held(asked.filter("not light").drop("light")), "term").groupBy("new_id", "id", "created_at", "qnorm", "below").agg(dot.alias("dot"), more.alias("more")).join(base, "id")
    near = cut(first.filter(F.col("dot") / (least * F.sqrt("base")) + F.col("below") >= (limit - 1e-9) * F.col("qnorm")))
    rest = tf.drop("created_at").join(held(near.select("new_id", "id")), "id").join(held(asked.filter("light").select("new_id", "term", "qw", "idf0", "idf1")), ["new_id", "term"]).groupBy("new_id", "id").agg(dot.alias("dot2"), more.alias("more2"))
    whole = near.join(rest, ["new_id", "id"], "left").fillna(0.0, ["dot2", "more2"])
    score = (F.col("dot") + F.col("dot2")) / (F.sqrt(F.col("base") + F.col("more") + F.col("more2")) * F.col("qnorm"))
    return whole.select("new_id", "id", "created_at", score.alias("score")).filter(F.col("score") >= limit)


def best_tfidf(tasks: DataFrame, new: DataFrame, limit: float = TFIDF_THRESHOLD) -> DataFrame:
    return _best(tfidf_scores(tasks.filter(~F.col("status").isin(*NOT_SCORED)), new, limit))


def cascade(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, layer, id, score): the first of keyword, trigram, TF-IDF and MinHash that hits. A layer sees only what
    the layers before it left."""
    out, rest = None, new
    for name, run in (("keyword", first_match), ("trigram", lambda t, n: best_match(t, n, TRIGRAM)), ("tfidf", best_tfidf), ("minhash", lambda t, n: best_match(t, n, MINHASH))):
        # kept: each later layer asks what this one left, and would find it anew
        hit = cut(run(tasks, rest).withColumn("layer", F.lit(name)))
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(hit.select("new_id"), "new_id", "left_anti")
    return out.select("new_id", "layer", "id", "score")


def admission_hits(tasks: DataFrame, new: DataFrame) -> DataFrame:
    """(new_id, id): the check at insertion, keyword or trigram, by status and then the least id."""
    live = _classes(tasks.filter(F.col("status").isin(*FIRST_MATCH_ORDER)), _priority())
    hits = scored(live, new, KEYWORD).unionByName(scored(live, new, TRIGRAM))
    return hits.groupBy("new_id").agg(F.min_by("id", F.struct(_priority(), "id")).alias("id"))


def candidates_by_tokens(tasks: DataFrame, new: DataFrame, top: int = 5) -> DataFrame:
    """(new_id, place, id, hits): the tasks with the most token occurrences in common, the newest first among equals.
    Where fewer share any token, the newest others follow without hits, as far as there are tasks."""
    live = tasks.filter(~F.col("status").isin(*NOT_SCORED))
    # a task's hits are added up where it is; of these only each partition's first places move
    held = dealt(live.select("id", "created_at", "description"), "id", live.count() // HIT_ROWS).select("id", "created_at", F.explode(text.tokens(F.col("description"))).alias("token"))
    asked = cut(new.select("new_id", F.explode(F.array_distinct(text.tokens(F.col("description")))).alias("token")))
    asked = F.broadcast(asked) if asked.count() <= ASKED_ROWS else asked
    hits = held.join(asked, "token").groupBy("id", "created_at", "new_id").agg(F.count("*").alias("hits")).select("new_id", "id", "created_at", "hits")
    order = W.Window.partitionBy("new_id").orderBy(F.desc("hits"), F.desc("created_at"), "id")
    best = cut(hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top))
    # of the newest 2 * top - 1 tasks, at most top - 1 are among a description's hits when those are fewer than top
    newest = [tuple(r) for r in live.select("id", "created_at").orderBy(F.desc("created_at"), "id").limit(2 * top - 1).collect()]
    short = new.select("new_id").join(best.filter(F.col("place") == top).select("new_id"), "new_id", "left_anti")
    kind = live.select("id", "created_at").schema
    rest = short.select("new_id", F.explode(F.lit([r[0] for r in newest]) if newest else F.array().cast("array<long>")).alias("id"))
    times = new.sparkSession.createDataFrame(newest, kind)
    rest = rest.join(F.broadcast(times), "id").join(best.select("new_id", "id"), ["new_id", "id"], "left_anti").withColumn("hits", F.lit(0).cast("long"))
    whole = best.drop("place").unionByName(rest.select("new_id", "id", "created_at", "hits"))
    return whole.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top).select("new_id", "place", "id", "hits")


def signatures(tasks: DataFrame) -> DataFrame:
    """(id, signature)."""
    return spread(tasks.select("id", "description")).select("id", scan.signature(F.col("description")).alias("signature"))


def signature_classes(tasks: DataFrame) -> DataFrame:
    """(class_id, signature, n): tasks of one signature, named by the least id."""
    return signatures(tasks).groupBy("signature").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).select("class_id", "signature", "n")


def minhash_pairs(tasks: DataFrame, limit: float = MINHASH.threshold) -> DataFrame:
    """(a, b, similarity) of all pairs of different signatures at limit or more, as class ids, a < b. Bands are so many
    that none is missed, and a pair is made at the first it shares; copies are one class and make no pairs."""
    classes = cut(signature_classes(tasks))
    held, asked = classes.select(F.col("class_id").alias("id"), F.col("signature").alias("a")), classes.select(F.col("class_id").alias("new_id"), F.col("signature").alias("b"))
    pairs = similarity.signature_join(held, asked, limit, F.col("id") < F.col("new_id"))
    return pairs.select(F.col("id").alias("a"), F.col("new_id").alias("b"), F.col("score").alias("similarity"))


def admit(existing: DataFrame, new: DataFrame) -> DataFrame:
    """new with accepted: what inserting one after another by new_id would accept, each checked (keyword or trigram)
    against the active tasks and those accepted before it. In rounds: a row with no undecided or accepted earlier hit
    is accepted, a row with an accepted one is not.

    Rows of one description with any letter or digit hit each other and the same other rows, so the first is judged for
    all and the rest go; descriptions without any hit nothing and are all accepted."""
    plain = ~F.coalesce("description", F.lit("")).rlike("[A-Za-z0-9]")
    first = new.groupBy(F.sha2(F.coalesce("description", F.lit("")), 256).alias("digest")).agg(F.min_by(F.struct("new_id", "description"), "new_id").alias("t")).select("t.*")
    active = _classes(existing.filter(F.col("status").isin(*FIRST_MATCH_ORDER)))
    blocked = scored(active, first, KEYWORD).select("new_id").union(scored(active, first, TRIGRAM).select("new_id")).distinct()
    open_ = cut(first.join(blocked, "new_id", "left_anti"))
    as_tasks = open_.select(F.col("new_id").alias("id"), "description")
    links = cut(_joined(as_tasks, open_, KEYWORD).unionByName(_joined(as_tasks, open_, TRIGRAM)).filter("id < new_id").select("new_id", F.col("id").alias("earlier")).distinct())
    state = cut(open_.select("new_id").withColumn("accepted", F.lit(None).cast("boolean")))
    while not state.filter("accepted is null").isEmpty():
        earlier = links.join(state.select(F.col("new_id").alias("earlier"), F.col("accepted").alias("was")), "earlier")
        seen = earlier.groupBy("new_id").agg(F.max(F.coalesce("was", F.lit(False))).alias("hit"), F.max(F.col("was").isNull()).alias("waits"))
        state = cut(state.join(seen, "new_id", "left").select("new_id", F.coalesce("accepted", F.when(F.coalesce("hit", F.lit(False)), False).when(~F.coalesce("waits", F.lit(False)), True)).alias("accepted")))
    return new.join(state, "new_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False)) | plain)


#: What a match by each layer is called, and how its score is told.
REASONS = {"trigram": ("near-duplicate", "%.2f"), "tfidf": ("tf-idf duplicate", "cos=%.2f"), "minhash": ("minhash duplicate", "jaccard≈%.2f")}


def reason(layer: str, id: Column, status: Column, score: Column) -> Column:  # noqa: A002
    """Why a description counts as a duplicate of a task."""
    name, shown = REASONS[layer]
    where = F.when(status == "executing", f"{name} in progress as task #").otherwise(f"{name} of task #")
    return F.concat(where, id.cast("string"), F.lit(f" ({layer} "), F.format_string(shown, score.cast("double")), F.lit(")"))


def judged(pairs: DataFrame, layers: tuple[str, ...] = ("keyword", "trigram", "tfidf", "minhash", "cascade")) -> DataFrame:
    """(layer, category, duplicate, predicted): what each layer says of labelled pairs (a, b, duplicate, category), b
    held against a as the only task. The cascade says what the first layer that hits says: whether any does."""
    tests = {x.name: (x.prepare, x.score, x.threshold) for x in (KEYWORD, TRIGRAM, MINHASH)} | {"tfidf": (text.tokens, text.pair_cosine, TFIDF_THRESHOLD)}
    unknown = set(layers) - set(tests) - {"cascade"}
    if unknown:
        raise ValueError(f"no such layer: {sorted(unknown)[0]}")
    used = tests if "cascade" in layers else layers
    # prepared in columns of their own: within a score's lambdas they would be prepared anew for each item
    kinds = {prepare for name, (prepare, _, _) in tests.items() if name in used}
    column = {(prepare, c): f"_{k}{c}" for k, prepare in enumerate(kinds) for c in "ab"}
    ready = pairs.select("category", "duplicate", *[prepare(F.col(c)).alias(name) for (prepare, c), name in column.items()])
    said = {name: F.coalesce(score(F.col(column[prepare, "a"]), F.col(column[prepare, "b"])) >= limit, F.lit(False)) for name, (prepare, score, limit) in tests.items() if name in used}
    rows = ready.select("category", "duplicate", *[c.alias(f"_{name}") for name, c in said.items()])
    whole = {name: F.col(f"_{name}") for name in said} | {"cascade": F.array_contains(F.array(*[F.col(f"_{name}") for name in said]), True)}
    told = F.explode(F.array(*[F.struct(F.lit(name).alias("layer"), whole[name].alias("predicted")) for name in layers]))
    return rows.select("category", "duplicate", told.alias("x")).select("x.layer", "category", "duplicate", "x.predicted")


def evaluated(pairs: DataFrame, layers: tuple[str, ...] = ("keyword", "trigram", "tfidf", "minhash", "cascade")) -> DataFrame:
    """confusion() of each layer with mean_ms, the wall clock of judging all pairs by it alone, for one pair."""
    out = None
    for name in layers:
        began = time.monotonic()
        rows = confusion(judged(pairs, (name,)), ["layer"]).collect()
        took = 1000 * (time.monotonic() - began)
        n = sum(r[k] for r in rows for k in ("tp", "fp", "tn", "fn"))
        part = confusion(judged(pairs, (name,)), ["layer"]).withColumn("mean_ms", F.lit(took / n if n else 0.0))
        out = part if out is None else out.unionByName(part)
    return out


#: The most candidates that a callable is asked about for one description.
JUDGE_CANDIDATES = 5


@dataclass(frozen=True)
class Verdict:
    """What a judge says of a description: the task that it repeats, or None, and why."""

    task_id: int | None = None
    reason: str = ""


Judge = Callable[[str, list[tuple[int, str, str]]], Verdict]


def asked(tasks: DataFrame, new: DataFrame, judge: Judge, layer: str = "llm", top: int = JUDGE_CANDIDATES) -> DataFrame:
    """(new_id, layer, is_duplicate, id, reason, error): what a callable says of each new description and its candidates,
    (id, status, description) of at most top tasks, the best first. It runs in the executors, a description at a time.

    Advice only: an error makes no duplicate and is told in error, as is a task that isn't among the candidates. Without
    candidates it isn't asked. A reason names the task; without one the task alone does."""
    best = candidates_by_tokens(tasks, new, min(top, JUDGE_CANDIDATES)).join(tasks.select("id", "status", F.col("description").alias("held")), "id")
    listed = best.groupBy("new_id").agg(F.array_sort(F.collect_list(F.struct("place", "id", "status", "held"))).alias("c"))
    rows = new.select("new_id", "description").join(listed, "new_id", "left")

    def one(description: str | None, candidates) -> tuple:
        given = [(int(c["id"]), c["status"], c["held"]) for c in (candidates if candidates is not None else [])]
        if not given:
            return False, None, "no active candidates", None
        try:
            said = judge(description or "", given)
            if said is None or said.task_id is None:
                return False, None, said.reason if said is not None else "", None
            if said.task_id not in {i for i, _, _ in given}:
                return False, None, said.reason, f"task #{said.task_id} is no candidate"
            why = said.reason.strip()
            return True, said.task_id, f"{why} (task #{said.task_id})" if why else f"semantically duplicates task #{said.task_id}", None
        except Exception as e:  # advice only, whatever goes wrong
            return False, None, "", f"{type(e).__name__}: {e}"

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = [one(d, c) for d, c in zip(frame["description"], frame["c"])]
            yield pd.DataFrame({"new_id": frame["new_id"], "layer": layer, "is_duplicate": [s[0] for s in said], "id": pd.array([s[1] for s in said], "Int64"), "reason": [s[2] for s in said], "error": [s[3] for s in said]})

    return rows.mapInPandas(run, "new_id long, layer string, is_duplicate boolean, id long, reason string, error string")


def confusion(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Of (duplicate, predicted): counts, precision, recall and F1, 0 where there is nothing to divide by."""
    d, p = F.col("duplicate"), F.col("predicted")
    counts = judged.groupBy(*keys).agg(F.count_if(d & p).alias("tp"), F.count_if(~d & p).alias("fp"), F.count_if(~d & ~p).alias("tn"), F.count_if(d & ~p).alias("fn"))
    share = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b == 0, 1).otherwise(b))
    counts = counts.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return counts.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
