"""Tasks and steps: status sets, transitions, rollups, orders and slots. Everything is a column or a grouped table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.operators.lineage import placed

STATUSES = ("created", "classified", "pending", "pending_clarification", "approved", "queued", "executing", "done", "failed", "interrupted", "rejected")
TERMINAL = ("done", "failed", "rejected", "interrupted")
WAITING = ("pending", "created", "classified")
UNDER_WAY = ("executing", "queued", "approved")
#: Statuses that can be approved, and the order of a dashboard; what isn't named comes last.
APPROVABLE = ("pending", "classified", "created", "approved")
DASHBOARD = {"executing": 0, "queued": 1, "approved": 2, "pending": 3, "classified": 3, "created": 4, "interrupted": 5, "failed": 6, "done": 7, "rejected": 8}
STEP_STATUSES = ("pending", "executing", "done", "failed", "skipped")
STEP_DONE = ("done", "skipped")
ORPHAN_RESULT = "interrupted: the process that ran it is gone"


def after_classification(classification: Column, needs_clarification: Column, auto_small: Column, delegated: Column, failed: Column) -> Column:
    """Status after classification; a caller that ignores delegation passes false."""
    return (
        F.when(failed, "pending").when(classification == "reject", "rejected").when(needs_clarification, "pending_clarification")
        .when((classification == "small") & (auto_small | delegated), "approved").otherwise("pending")
    )


def approved(status: Column) -> Column:
    """approved where that is allowed, else null."""
    return F.when(status.isin(*APPROVABLE), F.lit("approved"))


def final_status(failed: Column, merged: Column, has_commits: Column, has_result: Column) -> Column:
    return F.when(failed, "interrupted").when(merged, "done").when(has_commits, "interrupted").when(has_result, "done").otherwise("interrupted")


def refreshed(tasks: DataFrame, merged_branches: DataFrame) -> DataFrame:
    """Interrupted tasks whose branch (branch) is among the merged ones are done."""
    hit = merged_branches.select(F.col("branch").alias("__b")).distinct().withColumn("__merged", F.lit(True))
    joined = tasks.join(hit, tasks.branch == F.col("__b"), "left")
    done = (F.col("status") == "interrupted") & (F.coalesce("branch", F.lit("")) != "") & F.coalesce("__merged", F.lit(False))
    return joined.withColumn("status", F.when(done, "done").otherwise(F.col("status"))).drop("__b", "__merged")


def swept(tasks: DataFrame) -> DataFrame:
    """At start nothing can be executing."""
    on = F.col("status") == "executing"
    return tasks.withColumns({"status": F.when(on, "interrupted").otherwise(F.col("status")), "result": F.when(on, ORPHAN_RESULT).otherwise(F.col("result"))})


def rollup(tasks: DataFrame, *keys: str) -> DataFrame:
    s = F.col("status")
    return tasks.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(s.isin(*WAITING)).alias("pending"), F.count_if(s == "pending_clarification").alias("needs_clarification"),
        F.count_if(s == "executing").alias("executing"), F.count_if(s.isin(*UNDER_WAY)).alias("active"),
        F.coalesce(F.sum(F.when(F.col("tokens_used") > 0, F.col("tokens_used"))), F.lit(0)).alias("tokens"),
    )


def one_liner(tasks: DataFrame) -> DataFrame:
    """(line): the counts above nothing, and the tasks that wait for input, in one line."""
    s = F.col("status")
    waits = F.array_sort(F.collect_list(F.when((s == "executing") & F.col("needs_input"), F.col("id"))))
    counts = tasks.agg(F.count_if(s == "executing").alias("e"), F.count_if(s.isin(*WAITING)).alias("p"), F.count_if(s == "pending_clarification").alias("c"), waits.alias("ids"))
    part = lambda n, what: F.when(F.col(n) > 0, F.concat(F.col(n).cast("string"), F.lit(what)))
    ids = F.when(F.size("ids") > 0, F.concat(F.array_join(F.transform("ids", lambda i: F.concat(F.lit("#"), i.cast("string"))), " "), F.lit(" waiting approval")))
    line = F.concat_ws(" · ", part("e", " exec"), part("p", " pending"), part("c", " needs clarify"), ids)
    return counts.select(F.when(line == "", "idle").otherwise(line).alias("line"))


def dashboard_rank(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DASHBOARD.items() for x in kv]), status), F.lit(9))


def dashboard(tasks: DataFrame) -> DataFrame:
    return tasks.orderBy(dashboard_rank(F.col("status")), F.desc("created_at"), "id")


def oldest_needing_input(tasks: DataFrame) -> DataFrame:
    hit = tasks.filter((F.col("status") == "executing") & F.col("needs_input"))
    return hit.agg(F.min_by(F.struct("repo", "id", "created_at"), F.struct("created_at", "id")).alias("t")).filter("t is not null").select("t.*")


def slots(tasks: DataFrame, capacity: int = 1) -> DataFrame:
    """(id, state, queue_place) of approved tasks by age: running in a free slot, else queued."""
    queue = placed(tasks.filter(F.col("status") == "approved").select("id", "created_at"), F.col("created_at"), F.col("id"))
    return queue.select("id", F.when(F.col("place") <= capacity, "running").otherwise("queued").alias("state"), F.greatest(F.col("place") - capacity, F.lit(0)).alias("queue_place"))


def materialised(tasks: DataFrame, existing: DataFrame, models: dict[str, str] | None = None) -> DataFrame:
    """Steps of tasks' plans (plan_json) as rows; tasks that have steps get none again."""
    step = "struct<verb:string,target_file:string,symbols:array<string>,acceptance:string,depends_on:array<int>,description:string>"
    override = F.try_element_at(F.create_map(*[F.lit(x) for kv in models.items() for x in kv]), F.col("s.verb")) if models else F.lit(None).cast("string")
    rows = tasks.join(existing.select(F.col("task_id").alias("__t")).distinct(), F.col("id") == F.col("__t"), "left_anti")
    rows = rows.select(F.col("id").alias("task_id"), F.posexplode(F.from_json("plan_json", f"array<{step}>")).alias("i", "s"))
    return rows.select("task_id", (F.col("i") + 1).alias("seq"), "s.*", F.lit("pending").alias("status"), override.alias("model_override"))


#: What an update of a task may set, and of a step.
TASK_VALUES = ("status", "session_id", "classification", "plan", "result", "branch", "tokens_used", "tools_used", "plan_json", "needs_input")
STEP_VALUES = ("status", "result", "session_id", "model_override", "tokens_used", "duration_ms", "retry_count", "commit_sha")


def with_step(steps: DataFrame, which: Column, **values) -> DataFrame:
    """steps with the values set where which holds, and the time of it."""
    if unknown := set(values) - set(STEP_VALUES):
        raise ValueError(f"an update can't set {sorted(unknown)}")
    if values.get("status", "pending") not in STEP_STATUSES:
        raise ValueError(f"{values['status']!r} is no step status")
    hit = F.coalesce(which, F.lit(False))
    new = {k: F.when(hit, F.lit(v).cast(steps.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()}
    return steps.withColumns({**new, "updated_at": F.when(hit, F.current_timestamp()).otherwise(F.col("updated_at"))})


def step_summary(steps: DataFrame) -> DataFrame:
    s = F.col("status")
    return steps.groupBy("task_id").agg(F.count("*").alias("total"), *[F.count_if(s == x).alias(x) for x in ("pending", "executing", "done", "failed", "skipped")])


def next_steps(steps: DataFrame) -> DataFrame:
    """(task_id, seq): the first step that is neither done nor skipped; null where all are."""
    return steps.groupBy("task_id").agg(F.min(F.when(~F.col("status").isin(*STEP_DONE), F.col("seq"))).alias("seq"))


def step_progress(steps: DataFrame) -> DataFrame:
    bad = F.when(F.col("status") == "failed", F.col("seq"))
    return steps.groupBy("task_id").agg(F.count_if(F.col("status") == "done").alias("done"), F.count("*").alias("total"), F.min(bad).alias("first_failed"))


def executed(attempts: DataFrame, retries: int = 1) -> DataFrame:
    """(task_id, seq, status, retry_count) from attempts (task_id, seq, attempt, ok): a step fails once its retries are
    used up and the steps after it stay pending."""
    per = attempts.groupBy("task_id", "seq").agg(F.min(F.when(F.col("ok"), F.col("attempt"))).alias("won"), F.count("*").alias("n"))
    per = per.withColumn("good", F.coalesce(F.col("won") <= retries + 1, F.lit(False)))
    stop = F.min(F.when(~F.col("good"), F.col("seq"))).over(W.Window.partitionBy("task_id"))
    per = per.withColumn("stop", stop)
    status = F.when(F.col("stop").isNotNull() & (F.col("seq") > F.col("stop")), "pending").when(F.col("good"), "done").when(F.col("n") > retries, "failed").otherwise("executing")
    used = F.when(status == "pending", 0).otherwise(F.least(F.coalesce(F.col("won"), F.col("n")), F.lit(retries + 1)) - 1)
    return per.select("task_id", "seq", status.alias("status"), used.cast("int").alias("retry_count"))


def merged_pipeline(classified: DataFrame, planned: DataFrame) -> DataFrame:
    """Both results of a task (id): the classifier decides the size, the plan's files and symbols go first where it has
    any, and its error counts for nothing where the task was rejected or needs clarification."""
    c, p = classified.alias("c"), planned.alias("p")
    some = lambda x: F.coalesce(F.size(x), F.lit(0)) > 0
    size = F.when(F.coalesce("c.classification", F.lit("")) == "", "ambiguous").otherwise(F.col("c.classification"))
    pick = lambda n: F.when(some(F.col(f"p.{n}")), F.col(f"p.{n}")).otherwise(F.col(f"c.{n}")).alias(n)
    hushed = F.coalesce(F.col("c.needs_clarification"), F.lit(False)) | (size == "reject")
    reason = F.when((F.coalesce("c.classification", F.lit("")) == "") & F.col("c.error").isNotNull(), F.concat(F.lit("classify failed: "), "c.error")).otherwise(F.col("c.reason"))
    return c.join(p, "id", "full_outer").select("id", size.alias("classification"), reason.alias("reason"), pick("files_affected"), pick("symbols_affected"), F.col("p.plan").alias("plan"), F.when(~hushed, F.col("p.error")).alias("plan_error"))


def input_changes(panes: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Panes (id, needs_input, tail) whose need for input changes: (id, needs_input) as it is now."""
    now = wants_approval(F.col("tail"), patterns)
    return panes.withColumn("__now", now).filter(F.col("__now") != F.col("needs_input")).select("id", F.col("__now").alias("needs_input"))


#: Prompts that wait for an answer. \\z is the end of the text in this dialect.
APPROVAL_PATTERNS = (
    r"(?i)do you want to proceed\??", r"(?i)continue\??\s*\[y/n\]", r"(?i)continue\??\s*\(y/n\)", r"(?i)apply these edits\??",
    r"(?i)confirm\??\s*\[y/n\]", r"(?i)press\s+(enter|return)\s+to\s+continue", r"(?i)\(y/n\)\s*:?\s*\z", r"(?i)\[y/n\]\s*:?\s*\z",
)


def invalid_patterns(patterns: list[str]) -> list[str]:
    """Those that the engine that runs them, Java's, can't read."""
    from py4j.protocol import Py4JJavaError
    from pyspark import SparkContext
    from pyspark.errors import PySparkException

    bad = []
    for p in patterns:
        try:
            SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(p)
        except (Py4JJavaError, PySparkException):
            bad.append(p)
    return bad


def wants_approval(s: Column, patterns: list[str] | None = None) -> Column:
    """Any pattern holds; a list of one's own replaces the defaults, its invalid entries are passed over."""
    use = [p for p in patterns if p not in invalid_patterns(patterns)] if patterns else list(APPROVAL_PATTERNS)
    out = F.lit(False)
    for p in use:
        out = out | F.coalesce(s, F.lit("")).rlike(p)
    return out


#: What leads a step's line, and a status's colour as a terminal takes it.
STEP_MARKS = {"done": "✓", "failed": "✗", "executing": "→", "skipped": "·"}


COLOURS = {
    "executing": "\x1b[1;33m", "queued": "\x1b[1;33m", "approved": "\x1b[1;34m", "pending": "\x1b[36m", "created": "\x1b[36m", "classified": "\x1b[36m",
    "pending_clarification": "\x1b[1;93m", "done": "\x1b[32m", "failed": "\x1b[1;31m", "interrupted": "\x1b[35m", "rejected": "\x1b[2m",
}
#: What may be done next about a task of another repository, by its status.
NEXT = {
    "pending": "read the plan, then approve the task or ask for guidance", "approved": "approved by itself; wait for it if its result is needed",
    "executing": "under way; wait for it to end", "done": "ended already; read plan and result", "pending_clarification": "ambiguous; pass its questions on and record the answers",
    **dict.fromkeys(("failed", "interrupted", "rejected"), "ended without a result; tell the reason and don't try again unasked"),
}


def _named(names: dict[str, str], status: Column, default: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), status), F.lit(default))


def colour(status: Column) -> Column:
    return _named(COLOURS, status, "")


def next_action(status: Column) -> Column:
    return _named(NEXT, status, "fetch the task to see where it stands")


def has_steps(steps: DataFrame, tasks: DataFrame) -> DataFrame:
    """(id, has_steps) of tasks."""
    made = steps.select(F.col("task_id").alias("id"), F.lit(True).alias("has_steps")).distinct()
    return tasks.select("id").join(made, "id", "left").fillna(False, ["has_steps"])


def step_mark(status: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STEP_MARKS.items() for x in kv]), status), F.lit(" "))


def test_command(files: DataFrame) -> DataFrame:
    """(command) for a repository's root files (name, content), by what is there first."""
    here = lambda n: F.coalesce(F.bool_or(F.col("name") == n), F.lit(False))
    npm = F.coalesce(F.bool_or((F.col("name") == "package.json") & F.contains("content", F.lit('"test"'))), F.lit(False))
    return files.agg(F.when(here("go.mod"), "go test ./...").when(npm, "npm test").when(here("pytest.ini") | here("pyproject.toml"), "pytest").when(here("Cargo.toml"), "cargo test").otherwise("").alias("command"))
