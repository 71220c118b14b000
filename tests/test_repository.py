"""A repository as a data source: parts of bounded bytes, conditions that hold before files are opened, files that go."""

import os

from pyspark.sql import functions as F

from quarry.sources import files, repository


def test_repository_source(spark, tmp_path):
    root, at = tmp_path / "repo", tmp_path / "manifest"
    sizes = {f"src/{i:02}.go": 100 * (i % 7) for i in range(40)} | {"big.py": 5000, "docs/a.md": 10, "k.yaml": 20, "node_modules/x.js": 9, ".github/ci.yml": 3}
    for name, n in sizes.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x" * n)
    found = repository.read(spark, str(root), str(at), part_bytes=1000)
    rows = {r.path: r for r in found.collect()}
    assert rows.keys() == {r.path for r in files.walk(spark, str(root)).collect()} == {n for n in sizes if not n.startswith(("docs", "node"))}
    assert all(bytes(rows[n].content) == b"x" * sizes[n] and rows[n].size_bytes == sizes[n] and rows[n].last_modified == int(os.stat(root / n).st_mtime) for n in rows)
    parts = spark.read.parquet(str(at)).groupBy("part").agg(F.sum("size").alias("bytes"), F.max("size").alias("largest")).collect()
    assert len(parts) > 5 and all(r.bytes - r.largest <= 1000 for r in parts) and found.rdd.getNumPartitions() >= len(parts)
    # conditions are the source's own, before a file is opened; the plan keeps none of those that it takes
    go = found.filter("language = 'go' and path like 'src/0%'")
    assert {r.path for r in go.collect()} == {f"src/{i:02}.go" for i in range(10)}
    assert " = go" not in "".join(line for line in go._jdf.queryExecution().executedPlan().toString().splitlines() if "Filter " in line and "Scan" not in line)
    assert {r.path for r in found.filter(F.col("language").isin("yaml", "none")).collect()} == {"k.yaml", ".github/ci.yml"}
    os.unlink(root / "src/03.go")
    os.unlink(root / "k.yaml")
    os.symlink("/etc/hostname", root / "k.yaml")
    left = repository.read(spark, str(root), str(tmp_path / "again"), sorted(rows), part_bytes=10**6)
    assert {r.path for r in left.collect()} == rows.keys() - {"src/03.go", "k.yaml"}
    assert {r.path for r in repository.lost(spark, str(tmp_path / "again"), left).collect()} == {"src/03.go", "k.yaml"}
    assert repository.read(spark, str(root), str(tmp_path / "none"), [], part_bytes=10).count() == 0
