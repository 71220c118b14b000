"""Tables as Parquet directories: each write goes to a new version, and one small file tells which holds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Versions of a table that stay.
KEPT = 4


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in one step: written beside its place and renamed over what is there, so a reader finds the former
    text or the new one. path is any that Spark reaches."""
    sc = spark.sparkContext
    hadoop, conf = sc._jvm.org.apache.hadoop.fs, sc._jsc.hadoopConfiguration()
    old, new = hadoop.Path(path), hadoop.Path(f"{path}-{uuid.uuid4().hex}")
    fs = old.getFileSystem(conf)
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    how = sc._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(new), fs.makeQualified(old), how)


class Store:
    """Named tables under root. A table's versions lie side by side; a reader sees the one that was current when it
    looked. root is any path that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/current"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, name: str) -> bool:
        fs, p = self._fs(self._pointer(name))
        return fs.exists(p)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{self._current(name)}")

    def _current(self, name: str) -> str:
        line = self.spark.read.text(self._pointer(name)).first()
        return json.loads(line[0])["version"]

    def write(self, name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        version = f"v-{uuid.uuid4().hex}"
        writer = df.write.partitionBy(*partition_by) if partition_by else df.write
        writer.parquet(f"{self.root}/{name}/{version}")
        write_text(self.spark, self._pointer(name), json.dumps({"version": version}))
        self._forget(name)
        return self.read(name)

    def _forget(self, name: str) -> None:
        """Removes versions but for the newest KEPT, which readers that looked a little earlier may still use."""
        fs, folder = self._fs(f"{self.root}/{name}")
        found = sorted((x for x in fs.listStatus(folder) if x.getPath().getName().startswith("v-")), key=lambda x: x.getModificationTime())
        current = self._current(name)
        for old in found[:-KEPT]:
            if old.getPath().getName() != current:
                fs.delete(old.getPath(), True)

    def meta(self, key: str) -> str:
        """A value by key; '' where there is none."""
        if not self.exists("meta"):
            return ""
        row = self.read("meta").filter(F.col("key") == key).first()
        return row["value"] if row else ""

    def put_meta(self, key: str, value: str) -> None:
        row = self.spark.createDataFrame([(key, value)], "key string, value string")
        rest = self.read("meta").filter(F.col("key") != key) if self.exists("meta") else None
        self.write("meta", row if rest is None else rest.unionByName(row))
