"""What keeps a query's figures in proportion to its input: where rows move, and what is found once."""

from pyspark.sql import functions as F

from quarry.operators import dedup, graph, lifecycle
from quarry.plans import views as V
from quarry.sources import extract

SMALL = "/root/testdata/sf0.001"
TASKS = "id long, description string, status string, created_at long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def dealt(monkeypatch, module):
    seen, real = [], module.dealt
    monkeypatch.setattr(module, "dealt", lambda df, key, n: seen.append((key, n)) or real(df, key, n))
    return seen


def tasks(spark):
    rows = [(i, f"mend the old gate number{i % 7} by the barn", "pending", i) for i in range(40)]
    return spark.createDataFrame(rows, TASKS), spark.createDataFrame([(1, "mend the old gate number3 by the barn"), (2, "sand oak")], "new_id long, description string")


def test_cascade_finds_each_layer_once(spark):
    assert "Exchange" not in plan(dedup.cascade(*tasks(spark)))


def test_hits_are_added_up_by_task(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HIT_ROWS", 10)
    seen = dealt(monkeypatch, dedup)
    assert dedup.candidates_by_tokens(*tasks(spark)).filter("new_id = 1").count() == 5
    assert [(r.new_id, r.n) for r in dedup.tfidf_scores(*tasks(spark)).groupBy("new_id").agg(F.count("*").alias("n")).collect()] == [(1, 6)]
    assert seen == [("id", 4), ("id", 4)]


def test_steps_move_once(spark):
    assert plan(lifecycle.executed(V.attempts(spark, SMALL))).count("Exchange hashpartitioning") == 1


def test_links_are_dealt_once(spark, monkeypatch):
    seen = dealt(monkeypatch, graph)
    nodes, edges = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([("a", "b")], "from_id string, to_id string")
    assert graph.pagerank(nodes, edges).count() == 2 and [key for key, _ in seen] == ["from_id"]


def test_files_of_one_row_group_are_scanned_by_all_cores(spark):
    files = spark.createDataFrame([(f"p{i}", "go", f"func f{i}() {{\n}}\n") for i in range(20)], "path string, language string, content string").coalesce(1)
    out = extract.symbols(files)
    assert "RoundRobinPartitioning" in plan(out) and out.count() == 20
