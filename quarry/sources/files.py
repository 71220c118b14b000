"""Files of a repository, read by Spark: a listing of one's own, or a directory walk with ignore patterns."""

from __future__ import annotations

import posixpath
import subprocess
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.index import ignored, language, porcelain_paths
from quarry.operators.lineage import cut

#: Directories that a walk never enters; and the engine's own.
IGNORED = (".git", "node_modules", "vendor", "__pycache__", ".next", "dist", "build")
STATE_DIR = ".quarry"


def _git(root: str, *args: str) -> bytes | None:
    """What git prints, or None where it fails or isn't there."""
    try:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, check=True, timeout=60).stdout
    except (OSError, subprocess.SubprocessError):
        return None


def git_listing(root: str) -> list[str] | None:
    """Tracked and untracked files that git doesn't ignore, or None outside a repository."""
    out = _git(root, "ls-files", "--cached", "--others", "--exclude-standard", "-z")
    return None if out is None else sorted({p for p in out.decode(errors="replace").split("\0") if p})


def git_head(root: str) -> str | None:
    """The commit that is checked out; None outside a repository and before the first commit."""
    out = _git(root, "rev-parse", "HEAD")
    return None if out is None else out.decode().strip()


def _paths(spark: SparkSession, text: bytes, column: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in text.decode(errors="replace").split("\0") if x], f"{column} string")


def git_changes(spark: SparkSession, root: str, since: str) -> DataFrame | None:
    """(path) of files that differ between a commit and the one checked out; None if the former isn't known."""
    out = _git(root, "diff", "--name-only", "--no-renames", "-z", since, "HEAD")
    return None if out is None else _paths(spark, out, "path")


def git_dirty(spark: SparkSession, root: str) -> DataFrame:
    """(path) of files that differ from the commit checked out, new ones too."""
    return porcelain_paths(_paths(spark, _git(root, "status", "--porcelain", "--no-renames", "--untracked-files=all", "-z") or b"", "line"))


def ignore_patterns(root: str) -> list[str]:
    found = Path(root) / ".gitignore"
    own = [line.strip() for line in found.read_text(errors="replace").splitlines()] if found.is_file() else []
    return [*IGNORED, STATE_DIR, *[p for p in own if p and not p.startswith("#")]]


#: Files whose contents are read by one task at a time, and read together.
FILES_A_TASK, FILES_A_BATCH = 256, 32
_READ = "rel string, content binary, length long, seconds long, why string"


def walk(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(path, content, size_bytes, last_modified, language, content_hash) of files of known languages under root; time
    in whole seconds. Names are listed first, ignored directories not entered, and symbolic links never followed; any
    name is read, be it hidden or with wildcards in it. Directories that can't be listed are left out."""
    root = str(Path(root).resolve())
    use = ignore_patterns(root) if patterns is None else patterns
    return _shaped(_read(_known(_kept(_listed(spark, root), use)), root))


def from_listing(spark: SparkSession, root: str, listing: list[str] | DataFrame) -> DataFrame:
    """As walk(), of the files listed, names or rows (path); one that is gone by then, is no plain file or can't be read
    is left out."""
    names = listing.select(F.col("path").alias("rel")) if isinstance(listing, DataFrame) else spark.createDataFrame([(p,) for p in listing], "rel string")
    return _shaped(_read(_known(names), str(Path(root).resolve())))


def unread(spark: SparkSession, root: str, listing: list[str]) -> DataFrame:
    """(path, why) of the listed files that from_listing() leaves out though their language is known."""
    rows = _read(_known(spark.createDataFrame([(p,) for p in listing], "rel string")), str(Path(root).resolve()))
    return rows.filter("why is not null").select(F.col("rel").alias("path"), "why")


def _kept(names: DataFrame, patterns: list[str]) -> DataFrame:
    return names.filter(~ignored(F.col("rel"), patterns))


def _listed(spark: SparkSession, root: str, skipped: tuple[str, ...] = (*IGNORED, STATE_DIR)) -> DataFrame:
    """(rel) of the plain files under root, directories of the names skipped aside. One task a directory of the first
    level, so large trees are listed at once."""

    def under(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            found: list[str] = []
            for name in batch.column(0).to_pylist():
                top = os.path.join(root, name)
                if not os.path.isdir(top) or os.path.islink(top):
                    found += [name] * (os.path.isfile(top) and not os.path.islink(top))
                    continue
                for where, directories, files in os.walk(top):
                    directories[:] = [d for d in directories if d not in skipped]
                    found += [os.path.relpath(os.path.join(where, f), root) for f in files if os.path.isfile(os.path.join(where, f)) and not os.path.islink(os.path.join(where, f))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["rel"])

    tops = sorted(p.name for p in Path(root).iterdir() if p.name not in skipped)
    return spark.createDataFrame([(t,) for t in tops], "name string").repartition(max(1, min(len(tops), spark.sparkContext.defaultParallelism))).mapInArrow(under, "rel string")


def _read(names: DataFrame, root: str) -> DataFrame:
    """The files named, read in small runs; why tells what kept one from being read. root is a folder that all
    executors see."""

    def contents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import stat

        for batch in batches:
            every = batch.column(0).to_pylist()
            for at in range(0, len(every), FILES_A_BATCH):
                rows = []
                for rel in every[at : at + FILES_A_BATCH]:
                    full = posixpath.join(root, rel)
                    try:
                        if not stat.S_ISREG(os.lstat(full).st_mode):
                            raise OSError("no plain file")
                        with open(full, "rb") as f:
                            data, seconds = f.read(), int(os.fstat(f.fileno()).st_mtime)
                        rows.append({"rel": rel, "content": data, "length": len(data), "seconds": seconds, "why": None})
                    except OSError as e:
                        rows.append({"rel": rel, "content": None, "length": None, "seconds": None, "why": e.strerror or str(e)})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("rel", pa.string()), ("content", pa.binary()), ("length", pa.int64()), ("seconds", pa.int64()), ("why", pa.string())]))

    parts = max(names.sparkSession.sparkContext.defaultParallelism, -(-names.count() // FILES_A_TASK))
    return names.repartition(parts).mapInArrow(contents, _READ)


def _known(names: DataFrame) -> DataFrame:
    return names.filter(language(F.col("rel")) != "")


def texts(spark: SparkSession, root: str, ending: str, below: bool = True) -> DataFrame:
    """(path, content) of the files under a folder whose names end so, as text; below: in folders under it, too. Spark's
    own readers leave out names that begin with a dot or an underscore; these are read. A root in another store than a
    file system that all executors see (with ://) goes through Spark's reader and has its limits."""
    if "://" in root:
        rows = spark.read.option("pathGlobFilter", f"*{ending}").option("recursiveFileLookup", str(below).lower()).format("binaryFile").load(root)
        sc = spark.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(root)
        whole = at.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(at).toString()
        name = F.substr("path", F.lit(len(whole) + 2))
        return rows.select(name.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
    root = str(Path(root).resolve())
    names = _listed(spark, root, ()).filter(F.endswith("rel", F.lit(ending)))
    names = names if below else names.filter(~F.contains("rel", F.lit("/")))
    return _read(names, root).filter("why is null").select(F.col("rel").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def _shaped(files: DataFrame) -> DataFrame:
    lang = language(F.col("rel"))
    return files.filter("why is null").select(
        F.col("rel").alias("path"), F.col("content"), F.col("length").alias("size_bytes"), F.col("seconds").alias("last_modified"),
        lang.alias("language"), F.unhex(F.sha2("content", 256)).alias("content_hash"),
    )


def scan(spark: SparkSession, root: str) -> DataFrame:
    """git's listing inside a repository, a walk elsewhere."""
    listing = git_listing(root)
    return walk(spark, root) if listing is None else from_listing(spark, root, listing)


def repositories(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of several repositories with the name of each in repo."""
    out = None
    for name, df in tables.items():
        part = df.withColumn("repo", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
