"""Session usage and benchmark figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE = "struct<type:string,timestamp:string,message:struct<role:string,content:array<struct<type:string,name:string>>,usage:struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint>>>"


def parsed_sessions(lines: DataFrame) -> DataFrame:
    """Assistant turns of JSON lines (session_id, value); blank and broken lines and those of another shape are none."""
    rows = lines.select("session_id", F.from_json("value", MESSAGE, {"mode": "PERMISSIVE"}).alias("e"), F.get_json_object("value", "$.message.content").alias("raw"))
    shaped = F.coalesce(F.col("raw"), F.lit("[]")).startswith("[") | (F.col("raw") == "null")
    return rows.filter((F.col("e.type") == "assistant") & (F.col("e.message.role") == "assistant") & shaped).select("session_id", "e.timestamp", "e.message.content", "e.message.usage.*")


def session_usage(turns: DataFrame) -> DataFrame:
    """One row per session: turns, token sums, effective input (a tenth of what was read from a cache, rounded down),
    tool calls and their numbers by name, and seconds from first to last turn."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    tools = F.filter(F.coalesce("content", F.array().cast("array<struct<type:string,name:string>>")), lambda x: x["type"] == "tool_use")
    at = F.try_to_timestamp("timestamp")
    sums = turns.groupBy("session_id").agg(
        F.count("*").alias("turns"), n("input_tokens"), n("output_tokens"), n("cache_creation_input_tokens"), n("cache_read_input_tokens"),
        F.coalesce(F.sum(F.size(tools)), F.lit(0)).alias("tool_calls"), (F.unix_millis(F.max(at)) - F.unix_millis(F.min(at))).alias("wall_clock_ms"),
    )
    names = turns.select("session_id", F.explode(tools).alias("t")).filter(F.coalesce("t.name", F.lit("")) != "").groupBy("session_id", F.col("t.name").alias("name")).agg(F.count("*").alias("n"))
    maps = names.groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "n")))).alias("tool_calls_by_name"))
    effective = F.col("input_tokens") + F.expr("cache_read_input_tokens div 10")
    return sums.withColumn("effective_input", effective).join(maps, "session_id", "left")


RESULT = "struct<repo:string,task_id:string,variant:string,wall_clock_sec:double,usage:struct<effective_input_billed:bigint,tool_calls:bigint,wall_clock_sec:double>>"


def read_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """(session_id, value): the lines of a folder's .jsonl files; the session is the file's name."""
    from quarry.sources.files import texts

    lines = texts(spark, folder, ".jsonl", False).select("path", F.explode(F.split("content", r"\r?\n")).alias("value"))
    return lines.select(F.regexp_extract("path", r"([^/]*)\.jsonl\z", 1).alias("session_id"), "value")


def latest_session(files: DataFrame) -> DataFrame:
    """(session_id): of files (path, modified) the .jsonl file modified last, without its ending; null where none is."""
    logs = files.filter(F.endswith("path", F.lit(".jsonl")))
    return logs.agg(F.regexp_extract(F.max_by("path", F.struct("modified", "path")), r"([^/]*)\.jsonl\z", 1).alias("session_id"))


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """(path, repo, task_id, variant, wall_clock_sec, effective, tool_calls) of the .json files under a folder, one
    result each; files of another form are left out."""
    from quarry.sources.files import texts

    rows = texts(spark, folder, ".json").select("path", F.from_json("content", RESULT).alias("r")).filter("r.repo is not null and r.task_id is not null")
    return rows.select("path", "r.repo", "r.task_id", "r.variant", "r.wall_clock_sec", F.col("r.usage.effective_input_billed").alias("effective"), F.col("r.usage.tool_calls").alias("tool_calls"))


def markdown_report(table: DataFrame) -> DataFrame:
    """(place, line): head, a line for each task and, where any has a baseline, one for all of them."""
    titles = ("repo", "task", "classify wall (s)", "baseline effective", "with MCP effective", "ratio", "baseline tools", "MCP tools")
    rows = markdown(table).select(F.struct(F.lit(2).alias("part"), "repo", "task_id").alias("place"), "line")
    spark = table.sparkSession
    head = spark.createDataFrame([(0, "| " + " | ".join(titles) + " |"), (1, "|" + "---|" * len(titles))], "part int, line string")
    last = overall(table).filter("tasks > 0").select(F.lit(3).alias("part"), F.format_string("**Aggregate over %d tasks: %.1f%% reduction in effective input tokens (ratio %.2f).**", "tasks", "reduction_pct", "ratio").alias("line"))
    fixed = head.unionByName(last).select(F.struct("part", F.lit("").alias("repo"), F.lit("").alias("task_id")).alias("place"), "line")
    return rows.unionByName(fixed).orderBy("place")


def latest_runs(rows: DataFrame) -> DataFrame:
    """Of runs of one (repo, task_id, variant) the one of the last path."""
    cols = [c for c in rows.columns if c != "path"]
    return rows.groupBy("repo", "task_id", "variant").agg(F.max_by(F.struct(*cols), "path").alias("r")).select("r.*")


def variant_table(runs: DataFrame) -> DataFrame:
    """One row per (repo, task_id): figures of the variants side by side, 0 where one is missing, and the ratio."""
    wide = runs.groupBy("repo", "task_id").pivot("variant", ["classify", "baseline", "mcp"]).agg(F.first("wall_clock_sec").alias("wall"), F.first("effective").alias("eff"), F.first("tool_calls").alias("tools"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return wide.select(
        "repo", "task_id", zero("classify_wall").alias("classify_wall"), zero("baseline_eff").alias("baseline"), zero("mcp_eff").alias("mcp"),
        F.when(zero("baseline_eff") > 0, zero("mcp_eff") / zero("baseline_eff")).otherwise(0.0).alias("ratio"), zero("baseline_tools").alias("baseline_tools"), zero("mcp_tools").alias("mcp_tools"),
    )


def overall(table: DataFrame) -> DataFrame:
    """(tasks, ratio, reduction_pct): a ratio of sums over tasks with a baseline."""
    some = F.col("baseline") > 0
    ratio = F.sum(F.when(some, F.col("mcp"))) / F.sum(F.when(some, F.col("baseline")))
    return table.agg(F.count_if(some).alias("tasks"), ratio.alias("ratio"), ((1 - ratio) * 100).alias("reduction_pct"))


def markdown(table: DataFrame) -> DataFrame:
    """(repo, task_id, line): the table's rows in Markdown."""
    return table.select("repo", "task_id", F.format_string("| %s | %s | %.1f | %d | %d | %.2f | %d | %d |", "repo", "task_id", F.col("classify_wall").cast("double"), F.col("baseline").cast("long"), F.col("mcp").cast("long"), "ratio", F.col("baseline_tools").cast("long"), F.col("mcp_tools").cast("long")).alias("line"))
