"""A repository as a Spark data source: spark.read.format("repository").

A Spark job lists the files with their sizes and deals them to parts of about equal bytes, a folder a part in a shared
place: the manifest. The source's partitions are these parts, so the driver sees their number and no file. Conditions on path
and language are taken over by the source and hold before a file is opened. A file that is gone by then, or can't be
read, is left out; lost() tells which.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from quarry.operators.index import language
from quarry.sources import files

PART_BYTES = 16 << 20
_SCHEMA = "path string, content binary, size_bytes long, last_modified long, language string"


def manifest(spark: SparkSession, root: str, at: str, listing: list[str] | None = None, part_bytes: int = PART_BYTES) -> int:
    """Lists the files of known languages under root, or those of a listing, and writes (path, language, size) to the
    folder at, which all executors see, in parts of about so many bytes; the number of parts. Sizes are added up over
    ranges of paths, so neither the driver nor a task sees them all; a file larger than a part has one alone."""
    from pyspark.sql import window as W

    root = str(Path(root).resolve())
    names = files._known(files._kept(files._listed(spark, root), files.ignore_patterns(root)) if listing is None else spark.createDataFrame([(p,) for p in listing], "rel string"))

    def sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            every = batch.column(0).to_pylist()
            size = []
            for rel in every:
                try:
                    size.append(os.lstat(os.path.join(root, rel)).st_size)
                except OSError:  # gone already: it will be missed when it is to be read
                    size.append(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64())], ["path", "size"])

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = names.mapInArrow(sized, "path string, size long").repartitionByRange(ranges, "path").withColumn("range", F.spark_partition_id())
    within = F.sum("size").over(W.Window.partitionBy("range").orderBy("path").rowsBetween(W.Window.unboundedPreceding, -1))
    dealt = files.cut(rows.withColumn("part", F.floor(F.coalesce(within, F.lit(0)) / part_bytes)))
    # parts of a range follow those of the ranges before it
    many = sorted(map(tuple, dealt.groupBy("range").agg(F.max("part") + 1).collect()))
    first, total = [], 0
    for r, n in many:
        first.append((r, total))
        total += n
    begins = spark.createDataFrame(first, "range int, first long")
    out = dealt.join(F.broadcast(begins), "range").select("path", "size", language(F.col("path")).alias("language"), (F.col("first") + F.col("part")).alias("part"))
    out.repartition("part").write.mode("overwrite").partitionBy("part").parquet(at)
    return total


class _Part(InputPartition):
    def __init__(self, number: int):
        self.number = number


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.at, self.parts = options["path"], options["manifest"], int(options["parts"])
        self.kept: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute in (("path",), ("language",)):
                self.kept.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Part(k) for k in range(max(1, self.parts))]  # none at all would be one without a number

    def _wanted(self, row: dict) -> bool:
        def holds(f: Filter) -> bool:
            v = row[f.attribute[0]]
            if isinstance(f, EqualTo):
                return v == f.value
            if isinstance(f, In):
                return v in f.value
            return v.startswith(f.value) if isinstance(f, StringStartsWith) else v.endswith(f.value)

        return all(map(holds, self.kept))

    def read(self, partition: _Part) -> Iterator[tuple]:
        import os
        import stat

        folder = os.path.join(self.at.removeprefix("file://"), f"part={partition.number}")
        if not os.path.isdir(folder):
            return
        for row in ds.dataset(folder, format="parquet").to_table().to_pylist():
            if not self._wanted(row):
                continue
            full = os.path.join(self.root, row["path"])
            try:
                if not stat.S_ISREG(os.lstat(full).st_mode):
                    continue
                with open(full, "rb") as f:
                    data, seconds = f.read(), int(os.fstat(f.fileno()).st_mtime)
            except OSError:
                continue
            yield row["path"], data, len(data), seconds, row["language"]


class RepositorySource(DataSource):
    """Options: path, the repository's folder; manifest and parts, where manifest() wrote, and what it said."""

    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read(spark: SparkSession, root: str, at: str, listing: list[str] | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(path, content, size_bytes, last_modified, language) of a repository's files; at: a folder for the manifest. Both
    are folders that all executors see."""
    parts = manifest(spark, root, at, listing, part_bytes)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RepositorySource)
    return spark.read.format("repository").option("path", str(Path(root).resolve())).option("manifest", at).option("parts", str(parts)).load()


def lost(spark: SparkSession, at: str, found: DataFrame) -> DataFrame:
    """(path) of the manifest's files that found (path, ...) lacks: gone or unreadable when they were to be read."""
    return spark.read.parquet(at).select("path").join(found.select("path"), "path", "left_anti")
