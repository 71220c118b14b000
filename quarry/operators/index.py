"""The index as tables: upserts, cascades, change detection, snapshot differences, freshness plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import ascii_lower, symbol_id


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old with new's rows in place of those of equal key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def last_per_key(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Of rows of one key the last in the order given, whole."""
    cols = rows.columns
    return rows.groupBy(*key).agg(F.max_by(F.struct(*cols), F.struct(*order)).alias("row")).select(*[F.col(f"row.{c}").alias(c) for c in cols])


def with_symbol_ids(symbols: DataFrame) -> DataFrame:
    """Adds id, and parent_id as the hash of the parent's name with neither kind nor signature."""
    parent = F.when(F.coalesce("parent_name", F.lit("")) != "", symbol_id(F.col("file_path"), F.col("parent_name"), F.lit(""), F.lit(""))).otherwise("")
    return symbols.withColumns({"id": symbol_id(F.col("file_path"), F.col("name"), F.col("kind"), F.col("signature")), "parent_id": parent})


def delete_file(files: DataFrame, symbols: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files in gone (path), their symbols and any edge at those."""
    paths = gone.select(F.col("path").alias("__p")).distinct()
    dead = symbols.join(paths, symbols.file_path == F.col("__p"), "left_semi").select(F.col("id").alias("__id"))
    left = edges.join(dead, edges.from_id == F.col("__id"), "left_anti").join(dead, F.col("to_id") == F.col("__id"), "left_anti")
    return files.join(paths, files.path == F.col("__p"), "left_anti"), symbols.join(paths, symbols.file_path == F.col("__p"), "left_anti"), left


def deleted_files(indexed: DataFrame, walked: DataFrame) -> DataFrame:
    return indexed.join(walked.select("path"), "path", "left_anti")


def change_plan(indexed: DataFrame, walked: DataFrame) -> DataFrame:
    """(path, action) of each walked file: same where the time or else the content is as it was; parse otherwise."""
    old = indexed.select("path", F.col("last_modified").alias("old_time"), F.col("content_hash").alias("old_hash"))
    action = F.when(F.col("old_time").isNull() & F.col("old_hash").isNull(), "parse").when(F.col("old_time") == F.col("last_modified"), "same_time").when(F.col("old_hash") == F.col("content_hash"), "same_content").otherwise("parse")
    return walked.join(old, "path", "left").select("path", action.alias("action"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change): added, removed or changed (signature or kind) of symbols by id."""
    a = before.select("id", F.struct("kind", "signature").alias("was"))
    b = after.select("id", F.struct("kind", "signature").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return a.join(b, "id", "full_outer").select("id", change.alias("change")).filter("change is not null")


def logical_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """As snapshot_diff(), by file and name, so an edited signature shows as changed. Of symbols of one name in a file
    the one of the last id counts."""
    keyed = lambda d: last_per_key(d.withColumns({"own": F.col("id"), "id": F.concat_ws("\0", "file_path", "name")}), ["id"], [F.col("own")]).drop("own")
    return snapshot_diff(keyed(before), keyed(after)).withColumns({"file_path": F.split("id", "\0")[0], "name": F.split("id", "\0")[1]}).drop("id")


def diff_lines(diff: DataFrame) -> DataFrame:
    """The changes as lines: + added, - removed, ~ changed."""
    mark = F.when(F.col("change") == "added", "+").when(F.col("change") == "removed", "-").otherwise("~")
    return diff.select("id", F.concat(mark, F.lit(" "), "id").alias("line"))


def freshness(has_git: bool, empty: bool, head: str | None, last: str | None, diff_known: bool = True) -> str:
    """What brings an index up to date: "full"; "incremental", by times and contents of all files; "dirty", the files
    that differ from the commit that was indexed; or "changed", those that differ between the two commits, and whatever
    is gone. diff_known: whether the former commit is still there to be compared."""
    if not has_git:
        return "full" if empty else "incremental"
    if not last:
        return "full"
    if head == last:
        return "dirty"
    return "changed" if diff_known else "full"


def porcelain_paths(lines: DataFrame) -> DataFrame:
    """Paths of status lines (line): from the fourth character on."""
    return lines.filter(F.length("line") > 3).select(F.substr("line", F.lit(4)).alias("path")).distinct()


#: A tree of more files is told by directories.
TREE_FILES = 200


def directory(path: Column) -> Column:
    """What stands before the last slash; '.' for a file at the root."""
    return F.regexp_replace(F.regexp_extract(path, r"(?s)\A(.+)/[^/]*\z", 1), r"\A\z", ".")


def file_tree(files: DataFrame, most: int = TREE_FILES) -> DataFrame:
    """(line): the paths of files (path) by directory where there are at most so many, else each directory with
    the number of its files, sorted."""
    found = files.select("path", directory(F.col("path")).alias("dir"))
    total = F.broadcast(files.agg(F.count("*").alias("total")))
    whole = found.join(total).filter(F.col("total") <= most).select("dir", F.col("path").alias("line"))
    rolled = found.groupBy("dir").count().join(total).filter(F.col("total") > most).select(F.lit("").alias("dir"), F.concat("dir", F.lit("/ ("), F.col("count").cast("string"), F.lit(" files)")).alias("line"))
    return whole.unionByName(rolled).orderBy("dir", "line").select("line")


def counts(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(files, symbols, edges): how many there are of each, in one row."""
    tables = (("files", files), ("symbols", symbols), ("edges", edges))
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name, _ in tables])


def languages_present(files: DataFrame) -> DataFrame:
    """(language) of files, each once and none empty, sorted."""
    return files.filter(F.coalesce("language", F.lit("")) != "").select("language").distinct().orderBy("language")


#: Languages by extension, and JSON files whose keys are read.
LANGUAGES = {
    "go": "go", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "java": "java", "kt": "kotlin", "kts": "kotlin", "yml": "yaml", "yaml": "yaml", "tf": "terraform", "tfvars": "terraform",
    "rs": "rust", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "proto": "protobuf", "sql": "sql",
}
JSON_CONFIGS = ("package.json", "tsconfig.json", "composer.json", "deno.json", "biome.json", "turbo.json", "nx.json")


def language(path: Column) -> Column:
    base = ascii_lower(F.regexp_extract(path, r"([^/]*)\z", 1))
    by_extension = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    ext = F.regexp_extract(base, r"\.([^.]*)\z", 1)
    return (
        F.when((base == "dockerfile") | base.startswith("dockerfile.") | base.endswith(".dockerfile"), "dockerfile")
        .when(base.isin(*JSON_CONFIGS), "json").otherwise(F.coalesce(F.try_element_at(by_extension, ext), F.lit("")))
    )


def glob_regex(pattern: str) -> str:
    """A shell pattern without separators as a regular expression: * and ? stay within a component."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "^" else body) + "]"
            i = end
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += "\\Q" + pattern[i] + "\\E"
        else:
            out += "\\Q" + c + "\\E"
        i += 1
    return r"\A" + out + r"\z"


def ignored(path: Column, patterns: list[str], is_dir: bool = False) -> Column:
    """Whether any pattern holds: on the path or a component; with a slash at its end on directories only."""
    parts = F.split(path, "/")
    above = parts if is_dir else F.slice(parts, 1, F.size(parts) - 1)
    out = F.lit(False)
    for p in patterns:
        only_dirs, rx = p.endswith("/"), F.lit(glob_regex(p.removesuffix("/")))
        inside = F.exists(above if only_dirs else parts, lambda x: F.rlike(x, rx))
        out = out | (inside if only_dirs and not is_dir else inside | F.rlike(path, rx))
    return out
