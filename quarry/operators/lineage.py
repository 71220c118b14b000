"""Cutting lineage at a folder that all executors share, and places in a total order."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the session's checkpoint folder, spark.checkpoint.dir. Where none is named, a local
    master gets a temporary one; a cluster's executors wouldn't share it, so there it is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores. A small table may be one row group, which one task reads
    however much work each row is; a large one has more partitions and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """df with all rows of a key in one partition, so that grouping by it and further columns moves nothing. n: at least
    so many partitions; a number in proportion to the rows bounds what a task holds."""
    return df.repartition(max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def placed(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with each row's place, from 1, in the order given, which should be total. Rows are dealt out by range, so no
    task orders them all; the driver gets one count a range and hands out where each range begins."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = sorted(map(tuple, rows.groupBy(part.alias("part")).count().collect()))
    first, total = [], 1
    for p, n in counts:
        first.append((p, total))
        total += n
    begins = spark.createDataFrame(first, "__part long, __first long")
    within = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("__part", part).join(F.broadcast(begins), "__part").withColumn(name, F.col("__first") + within).drop("__part", "__first", "__at")
