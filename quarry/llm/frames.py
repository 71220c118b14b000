"""Spark helpers: cutting lineage, and positions in a total order."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of more than one in so many rows are broadcast.
HOT_KEYS = 1000


def cut(df: DataFrame) -> DataFrame:
    """df computed once and read back from the shared checkpoint folder, spark.checkpoint.dir. Where none is named, a
    local master gets a temporary one; a cluster's executors wouldn't share it, so there it is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()


def whole_id(df: DataFrame, column: str) -> Column:
    """An identifier column as long. Identifiers are integers; a column of another type is an error at once."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.IntegralType | T.NullType) and not (isinstance(kind, T.DecimalType) and kind.scale == 0):
        raise TypeError(f"{column}: identifiers are integers, not {kind.simpleString()}")
    return F.col(column).cast("long")


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of df, whatever its case, is named like it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def positioned(df: DataFrame, *order: Column, name: str = "position") -> DataFrame:
    """df with each row's place, from 0, in the order given. Rows are dealt out by range, so equal sort keys
    other than whole ties spread; the driver gets one count a partition."""
    placed = cut(df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    counts = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).count().collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    offset = F.element_at(F.lit(before or [0]), part + 1).cast("long")
    return placed.withColumn(name, offset + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__at")


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined to table, which has one row a key and in column n how many rows have that key. how: inner or left.

    A key of more than one in HOT_KEYS of the rows would be one task's work. There are fewer than HOT_KEYS such keys, so
    they are broadcast and their rows stay where they are; all other rows meet their keys in a shuffle. Both sides are
    read more than once and should be cut."""
    hot = rows.count() // HOT_KEYS
    heavy, light = F.broadcast(table.filter(F.col("n") > hot)), table.filter(F.col("n") <= hot)
    return rows.join(heavy, on).unionByName(rows.join(heavy, on, "left_anti").join(light, on, how))


def text_bytes(df: DataFrame, column: str) -> int:
    """UTF-8 bytes of a text column."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)
