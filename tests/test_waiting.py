"""Waits with a deadline, and a dashboard that reads its registry again."""

import time

import pytest
from pyspark.sql import functions as F

from quarry.sources.store import Store
from quarry.streaming import tasks as streams

EVENT = "id long, ts timestamp, status string, timeout long"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before)


def until(holds, seconds=90):
    end = time.time() + seconds
    while not holds():
        assert time.time() < end
        time.sleep(0.3)


def test_a_wait_ends_with_its_task_or_its_time(spark, tmp_path, rocks):
    folder = tmp_path / "events"
    send = lambda *rows: spark.createDataFrame([(i, None, s, t) for i, s, t in rows], EVENT).withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(str(folder))
    # 1 ends while waited for, 2 runs out of time, 3 had ended before, 4 has the default's time, 5 nobody waits for
    send((1, "executing", 600), (2, "executing", 2), (3, "failed", None), (4, "pending", 0), (5, "done", None))
    stream = spark.readStream.schema(EVENT).parquet(str(folder))
    query = streams.waited(stream).writeStream.outputMode("append").format("memory").queryName("waits").trigger(processingTime="500 milliseconds").start()
    got = lambda: {r.id: (r.outcome, r.status) for r in spark.table("waits").collect()}
    try:
        until(lambda: 2 in got())
        send((1, "done", None), (3, None, 60), (2, "done", None))
        until(lambda: {1, 3} <= set(got()))
        assert got() == {1: ("ended", "done"), 2: ("timeout", "executing"), 3: ("ended", "failed")}
        times = {r.id: r.waited_ms for r in spark.table("waits").collect()}
        assert times[2] >= 2000 and times[1] < 600_000 and times[3] >= 0 and spark.table("waits").count() == 3
    finally:
        query.stop()


def test_a_repository_added_while_the_dashboard_runs(spark, tmp_path):
    stores = {n: Store(spark, str(tmp_path / n)) for n in ("one", "two")}
    for n, status in (("one", "executing"), ("two", "pending")):
        stores[n].write("tasks", spark.createDataFrame([(1, status, 5, 1), (2, "done", 0, 2)], "id long, status string, tokens_used long, created_at long"))
    entries = [("one", str(tmp_path / "one")), ("gone", str(tmp_path / "gone"))]
    shown = []
    show = lambda counts, rows: shown.append((counts.first().asDict(), [(r.repo, r.id, r.status) for r in rows.collect()]))
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 2).load()
    watch = streams.watch(ticks, lambda: spark.createDataFrame(entries, "name string, path string"), lambda name, path: Store(spark, path).read("tasks"), show, 0.0)
    query = watch.start()
    try:
        until(lambda: shown)
        assert shown[0][1] == [("one", 1, "executing"), ("one", 2, "done")] and shown[0][0]["executing"] == 1
        entries.append(("two", str(tmp_path / "two")))
        until(lambda: len(shown[-1][1]) == 4)
        assert shown[-1][1] == [("one", 1, "executing"), ("two", 1, "pending"), ("one", 2, "done"), ("two", 2, "done")]
        assert shown[-1][0]["pending"] == 1 and shown[-1][0]["tokens"] == 10
        del entries[0]
        until(lambda: {r[0] for r in shown[-1][1]} == {"two"})
    finally:
        query.stop()
