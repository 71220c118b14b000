"""One handle on the tables of a repository; every answer is a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import dedup, graph, index, lifecycle, search
from quarry.operators.lineage import cut, placed
from quarry.sources import extract, files
from quarry.sources.store import Store

TASK_SCHEMA = (
    "id long, name string, description string, status string, session_id string, classification string, plan string, source_repo string, source_task_id long, created_by string, acceptance string, "
    "result string, branch string, tokens_used long, tools_used map<string,long>, plan_json string, needs_input boolean, created_at timestamp, updated_at timestamp"
)
STEP_SCHEMA = (
    "task_id long, seq int, verb string, target_file string, symbols array<string>, acceptance string, depends_on array<int>, description string, status string, model_override string, "
    "result string, session_id string, tokens_used long, duration_ms long, retry_count int, commit_sha string, updated_at timestamp"
)
MAX_DESCRIPTION = 4096
SEARCHED = ["id", "name", "signature", "doc_comment"]
#: Keys of what is known about the last build.
HEAD, SETTLED = "last_indexed_commit", "ranks_settled"


def _order() -> list:
    """Of symbols of one name the last by these is what the name means."""
    return [F.col("file_path"), F.col("line"), F.col("id")]


def _refs(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.col("id").alias("caller_id"), F.explode("refs").alias("ref_name"))


class Engine:
    def __init__(self, spark: SparkSession, root: str, tags: DataFrame | None = None):
        """tags: what a tagger found (see sources.lines.tags), for files of languages without a scanner."""
        self.spark, self.store, self.tags = spark, Store(spark, root), tags

    # --- index ---

    def build(self, repository: str) -> None:
        """Scan, extract, resolve and rank a whole repository; tables are swapped in once written."""
        head = files.git_head(repository)
        walked = self.store.write("files_raw", files.scan(self.spark, repository))
        whole = self.store.write("parsed", self._parsed(walked))
        self._write_files(walked.drop("content"), whole)
        symbols = self.store.write("symbols_unranked", self._distinct(whole))
        edges = self.store.write("edges", graph.resolved(_refs(whole), graph.winners(symbols, _order())))
        self._rank(symbols, edges)
        n = symbols.count()
        blocks = max(1, n // search.BLOCK_DOCS)
        self._write_postings(search.indexed(symbols, "id", SEARCHED, blocks), symbols, blocks)
        self.store.put_meta(HEAD, head or "")

    def _parsed(self, found: DataFrame) -> DataFrame:
        """Symbols of files with their references; files that aren't UTF-8 have their odd bytes replaced."""
        parsed = extract.symbols(found.withColumn("content", F.make_valid_utf8(F.col("content").cast("string"))), self.tags)
        return index.with_symbol_ids(parsed.withColumnRenamed("path", "file_path").withColumn("ordinal", F.monotonically_increasing_id()))

    def _distinct(self, parsed: DataFrame) -> DataFrame:
        return index.last_per_key(parsed.drop("refs"), ["id"], [F.col("line"), F.col("ordinal")]).drop("ordinal")

    def _write_files(self, walked: DataFrame, parsed: DataFrame) -> None:
        counts = parsed.groupBy(F.col("file_path").alias("path")).agg(F.count("*").cast("int").alias("symbol_count"))
        self.store.write("files", walked.drop("symbol_count").join(counts, "path", "left").fillna(0, ["symbol_count"]))

    def _write_postings(self, postings: DataFrame, symbols: DataFrame, blocks: int) -> None:
        stored = self.store.write("postings", postings.repartition("bucket").sortWithinPartitions("bucket", "term", "block"), ["bucket"])
        self.store.write("bounds", search.block_bounds(stored).repartition("bucket").sortWithinPartitions("bucket", "term"), ["bucket"])
        size = search.lengths(symbols, "id", SEARCHED).agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("average"), F.lit(blocks).alias("blocks"))
        self.store.write("search_stats", size)

    def _rank(self, symbols: DataFrame, edges: DataFrame, start: DataFrame | None = None) -> None:
        """Ranks go on from former ones where those had come to rest."""
        told: dict = {}
        settled = start is not None and self.store.meta(SETTLED) == "yes"
        ranks = graph.pagerank(symbols, edges, start=start if settled else None, told=told)
        self.store.write("symbols", symbols.drop("rank").join(ranks, "id"))
        self.store.put_meta(SETTLED, "yes" if told.get("change", 0.0) < 1e-6 else "no")

    def refresh(self, repository: str) -> DataFrame:
        """Bring the index up to date; (path, action) of the files looked at. In a repository only files are read that
        its history and status name; elsewhere all, and only those are parsed whose time and content changed."""
        head, last = files.git_head(repository), self.store.meta(HEAD)
        empty = not self.store.exists("files")
        diff = files.git_changes(self.spark, repository, last) if head and last and head != last else None
        plan = "full" if empty else index.freshness(head is not None, empty, head, last, diff is not None)
        if plan == "full":
            self.build(repository)
            return self.store.read("files").select("path", F.lit("parse").alias("action"))
        old = self.store.read("files")
        gone = self.spark.createDataFrame([], "path string")
        if plan == "incremental":
            now = self.store.write("files_raw", files.scan(self.spark, repository))
            actions = cut(index.change_plan(old, now))
            gone = cut(index.deleted_files(old, now).select("path"))
        else:
            named = diff if plan == "changed" else files.git_dirty(self.spark, repository)
            now = self.store.write("files_raw", files.from_listing(self.spark, repository, named))
            hashes = old.select("path", F.col("content_hash").alias("was"))
            same = F.when(F.col("was") == F.col("content_hash"), "same_content").otherwise("parse")
            actions = cut(now.join(hashes, "path", "left").select("path", same.alias("action")))
            if plan == "changed":
                there = self.spark.createDataFrame([(p,) for p in files.git_listing(repository) or []], "path string")
                gone = cut(old.join(there, "path", "left_anti").select("path"))
        changed = actions.filter("action = 'parse'").select("path")
        if not (changed.isEmpty() and gone.isEmpty()):
            self._update(now.join(changed, "path", "left_semi"), changed.unionByName(gone))
        if plan == "changed":
            self.store.put_meta(HEAD, head)
        return actions.unionByName(gone.select("path", F.lit("delete").alias("action")))

    def _update(self, found: DataFrame, replaced: DataFrame) -> None:
        """Put the files found in place of those replaced (path). What other files have stays as it is: their symbols,
        their postings, and their edges but for those to names that now mean another symbol."""
        before, edges, postings = self.store.read("symbols"), self.store.read("edges"), self.store.read("postings")
        of = lambda df, how, c="file_path": df.join(replaced, df[c] == replaced["path"], how)
        fresh = cut(self._parsed(found))
        parsed = self.store.write("parsed", of(self.store.read("parsed"), "left_anti").unionByName(fresh))
        self._write_files(of(self.store.read("files"), "left_anti", "path").unionByName(found.drop("content"), allowMissingColumns=True), parsed)
        added, removed = cut(self._distinct(fresh)), of(before, "left_semi")
        symbols = self.store.write("symbols_unranked", of(before, "left_anti").drop("rank").unionByName(added))
        stale = cut(removed.select("id", "name").unionByName(added.select("id", "name")).distinct())
        kept, made = graph.refreshed_edges(edges, _refs(parsed), before, symbols, stale, _order())
        now = self.store.write("edges", kept.unionByName(made))
        self._rank(symbols, now, before.select("id", "rank"))
        blocks = self.store.read("search_stats").first()["blocks"]
        new = search.indexed(added, "id", SEARCHED, blocks)
        self._write_postings(postings.join(stale.select("id"), "id", "left_anti").unionByName(new), symbols, blocks)

    def symbols(self) -> DataFrame:
        return self.store.read("symbols")

    def edges(self) -> DataFrame:
        return self.store.read("edges").select("from_id", "to_id")

    def search_symbols(self, query: str, limit: int = 20) -> DataFrame:
        """The best symbols for a query, by stored postings: terms, phrases, prefixes, AND, OR, NOT, NEAR, columns."""
        stats = self.store.read("search_stats").first()
        hits = search.search_stored(self.store.read("postings"), self.store.read("bounds"), stats["n"], stats["average"] or 1.0, query, SEARCHED, limit)
        return self.symbols().join(F.broadcast(hits), "id").orderBy("score", "id")

    def call_graph(self, symbol_id: str) -> DataFrame:
        """Callers and callees with their direction."""
        at = F.lit(symbol_id)
        up = graph.callers(self.symbols(), self.edges(), at).withColumn("direction", F.lit("caller"))
        return up.unionByName(graph.callees(self.symbols(), self.edges(), at).withColumn("direction", F.lit("callee")))

    def file_context(self, path: str, verbose: bool = False) -> DataFrame:
        cols = ["name", "kind", "line", "end_line", text.cap(F.col("signature"), 200).alias("signature"), *(["doc_comment"] if verbose else [])]
        return self.symbols().filter(F.col("file_path") == path).orderBy("line", "id").select(*cols)

    def overview(self, top: int = 20) -> DataFrame:
        kinds = ("function", "method", "struct", "interface", "class", "type")
        return self.symbols().filter(F.col("kind").isin(*kinds)).orderBy(F.desc("rank"), "id").limit(top)

    def counts(self) -> DataFrame:
        """(files, symbols, edges): how many the index has."""
        return index.counts(self.store.read("files"), self.symbols(), self.edges())

    def snapshot(self, branch: str) -> DataFrame:
        return self.store.write(f"branches/{branch}", self.symbols())

    def diff(self, branch: str) -> DataFrame:
        return index.snapshot_diff(self.store.read(f"branches/{branch}"), self.symbols())

    # --- tasks ---

    def tasks(self) -> DataFrame:
        return self.store.read("tasks") if self.store.exists("tasks") else self.spark.createDataFrame([], TASK_SCHEMA)

    def steps(self) -> DataFrame:
        none = self.spark.createDataFrame([], STEP_SCHEMA)
        return none.unionByName(self.store.read("steps"), allowMissingColumns=True) if self.store.exists("steps") else none

    def list_steps(self, task_id: int) -> DataFrame:
        """Steps of a task in their order."""
        return self.steps().filter(F.col("task_id") == task_id).orderBy("seq")

    def update_step(self, task_id: int, seq: int, **values) -> None:
        """Set values of a step, see lifecycle.STEP_VALUES; an unknown step, column or status is an error."""
        steps = self.steps()
        hit = (F.col("task_id") == task_id) & (F.col("seq") == seq)
        if steps.filter(hit).isEmpty():
            raise KeyError(f"task #{task_id} has no step {seq}")
        self.store.write("steps", lifecycle.with_step(steps, hit, **values))

    def dedup(self, new: DataFrame) -> DataFrame:
        return dedup.cascade(self.tasks(), new)

    def create_tasks(self, new: DataFrame, source_repo: str = "") -> DataFrame:
        """Insert (new_id, description) in the order of new_id, each checked against what is there by then; the rows of
        new with accepted. Empty and overlong descriptions are not accepted."""
        fit = new.filter((F.octet_length(F.coalesce("description", F.lit(""))) <= MAX_DESCRIPTION) & (text.trimmed(F.coalesce("description", F.lit(""))) != ""))
        verdict = cut(dedup.admit(self.tasks(), fit).select("new_id", "description", "accepted"))
        last = self.tasks().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        now = F.current_timestamp()
        ids = placed(verdict.filter("accepted"), F.col("new_id")).withColumn("id", F.col("place") + last)
        made = {"name": text.task_name(F.col("description")), "status": F.lit("created"), "created_by": F.lit(source_repo), "source_repo": F.lit(source_repo), "tokens_used": F.lit(0).cast("long"), "needs_input": F.lit(False), "created_at": now, "updated_at": now}
        shape = self.spark.createDataFrame([], TASK_SCHEMA).schema
        rows = ids.select(*[(made[f.name] if f.name in made else F.col(f.name) if f.name in ("id", "description") else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])
        self.store.write("tasks", self.tasks().unionByName(rows))
        return verdict

    def _set(self, task_id: int, allowed: Callable | None = None, **values) -> None:
        tasks = self.tasks()
        row = tasks.filter(F.col("id") == task_id).select("status").first()
        if row is None:
            raise KeyError(f"task #{task_id} not found")
        if allowed is not None and not allowed(row[0]):
            raise ValueError(f"task #{task_id} is {row[0]}")
        hit = F.col("id") == task_id
        new = {k: F.when(hit, v if not isinstance(v, str | int | bool) else F.lit(v)).otherwise(F.col(k)) for k, v in {**values, "updated_at": F.current_timestamp()}.items()}
        self.store.write("tasks", tasks.withColumns(new))

    def show_task(self, task_id: int) -> DataFrame:
        return self.tasks().filter(F.col("id") == task_id)

    def list_tasks(self, status: str | None = None) -> DataFrame:
        t = self.tasks() if status is None else self.tasks().filter(F.col("status") == status)
        return t.orderBy(F.desc("created_at"), "id")

    def approve_task(self, task_id: int, models: dict[str, str] | None = None) -> DataFrame:
        self._set(task_id, lambda s: s in lifecycle.APPROVABLE, status="approved")
        made = lifecycle.materialised(self.show_task(task_id).filter("plan_json is not null"), self.steps(), models)
        return self.store.write("steps", self.steps().unionByName(made, allowMissingColumns=True)).filter(F.col("task_id") == task_id)

    def reject_task(self, task_id: int) -> None:
        self._set(task_id, status="rejected")

    def finish_task(self, task_id: int) -> None:
        self._set(task_id, status="done")

    def update_task(self, task_id: int, **values) -> None:
        """Set values of a task, see lifecycle.TASK_VALUES; an unknown task, column or status is an error."""
        if unknown := set(values) - set(lifecycle.TASK_VALUES):
            raise ValueError(f"an update can't set {sorted(unknown)}")
        if values.get("status", "created") not in lifecycle.STATUSES:
            raise ValueError(f"{values['status']!r} is no status")
        self._set(task_id, **values)

    def delete_task(self, task_id: int) -> None:
        row = self.show_task(task_id).select("status").first()
        if row is None:
            raise KeyError(f"task #{task_id} not found")
        if row[0] == "executing":
            raise ValueError(f"task #{task_id} is executing")
        self.store.write("steps", self.steps().filter(F.col("task_id") != task_id))
        self.store.write("tasks", self.tasks().filter(F.col("id") != task_id))

    def clarify_task(self, task_id: int, answers: list[tuple[str, str]]) -> None:
        """Append answered questions to the description; back to created for another classification."""
        given = F.array(*[F.struct(F.lit(q).alias("question"), F.lit(a).alias("answer")) for q, a in answers]) if answers else F.lit(None)
        self._set(task_id, lambda s: s == "pending_clarification", description=text.clarified(F.col("description"), given), status="created")

    def status(self) -> DataFrame:
        return lifecycle.rollup(self.tasks())

    def sweep(self) -> None:
        self.store.write("tasks", lifecycle.swept(self.tasks()))
