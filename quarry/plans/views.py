"""The library's tables, made from the driver's: as DataFrames, and as SQL for the other side of a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import lineage

#: Lines of a partition where all of a task's are held.
LINE_ROWS = 500_000
STATUS_BY_REMAINDER = ("executing", "pending", "approved", "created", "classified", "queued", "interrupted", "done", "failed", "rejected", "pending_clarification")
KIND_BY_REMAINDER = ("function", "method", "struct", "interface", "class", "type", "property", "enum", "field")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(column, values) -> Column:
    return F.element_at(F.lit(list(values)), (column % len(values)).cast("int") + 1)


def _pick_sql(column: str, values) -> str:
    return f"case {column} % {len(values)} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + " end"


def tasks(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("description"), _pick(F.col("doc_id"), STATUS_BY_REMAINDER).alias("status"), F.col("source").alias("repo"),
        F.col("n_chars").alias("tokens_used"), (F.col("doc_id") % 17).alias("created_at"), (F.col("doc_id") % 3 == 0).alias("needs_input"),
    )


TASKS = f"""tasks as (select doc_id as id, coalesce(text, '') as description, {_pick_sql('doc_id', STATUS_BY_REMAINDER)} as status, source as repo,
  n_chars as tokens_used, doc_id % 17 as created_at, doc_id % 3 = 0 as needs_input from documents)"""


def new_tasks(spark, sf_dir) -> DataFrame:
    """Descriptions to hold against the tasks: a stated query set."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("new_id"), F.coalesce("text", F.lit("")).alias("description"))


NEW = "new as (select item_id as new_id, coalesce(text, '') as description from benchmark)"


def symbols(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), _pick(F.col("p_partkey"), KIND_BY_REMAINDER).alias("kind"), F.concat("p_brand", F.lit("/"), "p_type").alias("file_path"),
        F.col("p_size").cast("int").alias("line"), F.concat("p_type", F.lit(" "), "p_name").alias("signature"), F.col("p_partkey").alias("ord"),
    )


SYMBOLS = f"""symbols as (select cast(p_partkey as varchar) as id, p_name as name, {_pick_sql('p_partkey', KIND_BY_REMAINDER)} as kind, p_brand || '/' || p_type as file_path,
  cast(p_size as integer) as line, p_type || ' ' || p_name as signature, p_partkey as ord from part)"""


def refs(spark, sf_dir) -> DataFrame:
    """(caller_id, ref_name): a part refers to the next part of its order."""
    from pyspark.sql import window as W

    line = table(spark, sf_dir, "lineitem")
    order = W.Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    nexts = line.select(F.col("l_partkey").alias("caller"), F.lead("l_partkey").over(order).alias("callee")).filter("callee is not null").distinct()
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("callee"), F.col("p_name").alias("ref_name"))
    return nexts.join(names, "callee").select(F.col("caller").cast("string").alias("caller_id"), "ref_name")


REFS = """refs as (select cast(caller as varchar) as caller_id, p_name as ref_name from (select l_partkey as caller,
  lead(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) as callee from lineitem) r join part on p_partkey = callee)"""


def edges(spark, sf_dir) -> DataFrame:
    from quarry.operators import graph

    return graph.call_edges(refs(spark, sf_dir), symbols(spark, sf_dir), [F.col("ord")])


EDGES = f"""{SYMBOLS}, {REFS}, last as (select name, arg_max(id, ord) as to_id from symbols group by name),
  edges as (select distinct caller_id as from_id, to_id from refs join last on ref_name = name where caller_id <> to_id)"""


def steps(spark, sf_dir) -> DataFrame:
    flag = F.col("l_returnflag")
    status = F.when(flag == "A", "done").when(flag == "R", F.when(F.col("l_linestatus") == "F", "skipped").otherwise("failed")).otherwise(F.when(F.col("l_linestatus") == "O", "pending").otherwise("failed"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").cast("int").alias("seq"), status.alias("status"))


STEPS = """steps as (select l_orderkey as task_id, cast(l_linenumber as integer) as seq, case when l_returnflag = 'A' then 'done'
  when l_returnflag = 'R' then case when l_linestatus = 'F' then 'skipped' else 'failed' end else case when l_linestatus = 'O' then 'pending' else 'failed' end end as status from lineitem)"""


def attempts(spark, sf_dir) -> DataFrame:
    """Two attempts of each line: the first is good for an early discount, the second for a low tax."""
    rows = table(spark, sf_dir, "lineitem")
    # by task, so that what follows moves nothing and holds a bounded number of rows
    line = lineage.dealt(rows.select(F.col("l_orderkey").alias("task_id"), "l_linenumber", "l_discount", "l_tax"), "task_id", rows.count() // LINE_ROWS)
    line = line.groupBy("task_id", F.col("l_linenumber").cast("int").alias("seq")).agg(F.max("l_discount").alias("d"), F.max("l_tax").alias("t"))
    return line.select("task_id", "seq", F.explode(F.array(F.struct(F.lit(1).alias("attempt"), (F.col("d") < 0.09).alias("ok")), F.struct(F.lit(2).alias("attempt"), (F.col("t") < 0.06).alias("ok")))).alias("a")).select("task_id", "seq", "a.*")


ATTEMPTS = """attempts as (select task_id, seq, attempt, case when attempt = 1 then d < 0.09 else t < 0.06 end as ok from
  (select l_orderkey as task_id, cast(l_linenumber as integer) as seq, max(l_discount) as d, max(l_tax) as t from lineitem group by 1, 2), unnest([1, 2]) u(attempt))"""


def session_lines(spark, sf_dir) -> DataFrame:
    """JSON lines of sessions, made from conversations: one a turn."""
    c = table(spark, sf_dir, "conversations")
    n = F.length(F.coalesce("text", F.lit(""))).cast("long")
    usage = F.struct(n.alias("input_tokens"), F.expr("length(coalesce(text, '')) div 3").cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("cache_creation_input_tokens"), (n * 7).alias("cache_read_input_tokens"))
    content = F.array(F.struct(F.when(n % 2 == 0, "tool_use").otherwise("text").alias("type"), F.when(n % 4 == 0, "search").otherwise("graph").alias("name")))
    value = F.to_json(F.struct(F.col("role").alias("type"), F.format_string("2024-01-01T00:%02d:00Z", F.col("turn") % 60).alias("timestamp"), F.struct("role", content.alias("content"), usage.alias("usage")).alias("message")))
    return c.select(F.col("conv_id").alias("session_id"), value.alias("value"))
