"""Line-shaped sources: logs, question files, registries and declarative configuration files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quarry.functions.text import after_colon, is_identifier, one_line, quoted_strings, setting, trimmed
from quarry.sources.files import texts
from quarry.sources.store import write_text

RETENTION_DAYS = 10


def numbered(files: DataFrame) -> DataFrame:
    """(path, line, text) of files (path, content), lines from 1; a line end at the end begins no line."""
    body = F.regexp_replace(F.coalesce("content", F.lit("")), r"\r?\n\z", "")
    rows = files.filter(F.coalesce("content", F.lit("")) != "").select("path", F.posexplode(F.split(body, r"\r?\n")).alias("i", "text"))
    return rows.select("path", (F.col("i") + 1).alias("line"), "text")


def json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as one JSON object; write it as text, or show it. Nulls are left out."""
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))


#: Letters after a backslash that stand for a control character.
ESCAPES = {"a": "\x07", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\x0b"}


def quoted(s: Column) -> Column:
    """s in quotation marks; marks, backslashes and control characters are escaped."""
    shown = {**{c: "\\" + k for k, c in ESCAPES.items()}, '"': '\\"', "\\": "\\\\"}
    parts = F.regexp_extract_all(s, F.lit(r'[\x00-\x1F\x7F"\\]|[^\x00-\x1F\x7F"\\]+'), F.lit(0))
    known = F.create_map(*[F.lit(x) for kv in shown.items() for x in kv])
    control = lambda x: F.when(x.rlike(r"\A[\x00-\x1F\x7F]\z"), F.concat(F.lit("\\x"), F.lower(F.hex(x)))).otherwise(x)
    return F.concat(F.lit('"'), F.array_join(F.transform(parts, lambda x: F.coalesce(F.try_element_at(known, x), control(x))), ""), F.lit('"'))


def unquoted(s: Column) -> Column:
    """What quoted() was given, of what stands between the marks; other escapes by two, four or eight hex digits too."""
    parts = F.regexp_extract_all(s, F.lit(r"\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)|[^\\]+"), F.lit(0))
    known = F.create_map(*[F.lit(x) for k, c in ESCAPES.items() for x in ("\\" + k, c)])
    hexed = lambda x, charset: F.decode(F.unhex(F.substr(x, F.lit(3))), charset)
    by_code = lambda x: F.when(x.rlike(r"\A\\x.{2}"), hexed(x, "ISO-8859-1")).when(x.rlike(r"\A\\u.{4}"), hexed(x, "UTF-16BE")).when(x.rlike(r"\A\\U.{8}"), hexed(x, "UTF-32"))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("\\"), F.coalesce(F.try_element_at(known, x), by_code(x), F.substr(x, F.lit(2)))).otherwise(x)), "")


def dedup_log_line(at: Column, layer: Column, hit: Column, score: Column, ms: Column, cand: Column, err: Column, reason: Column, task: Column) -> Column:
    told = lambda name, c, n: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f" {name}="), quoted(one_line(c, n)))).otherwise("")
    head = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" layer="), layer, F.lit(" hit="), hit.cast("string"), F.format_string(" score=%.3f ms=%d cand=%d", score, ms, cand))
    return F.concat(head, told("err", err, 200), told("reason", reason, 200), told("task", task, 160))


def parsed_dedup_log(lines: DataFrame) -> DataFrame:
    """Fields of dedup log lines (value); lines of another form are left out."""
    between = r'"((?:[^"\\]|\\.)*)"'
    head = r"\A(\S+) layer=(\S+) hit=(true|false) score=([0-9.]+) ms=([0-9]+) cand=([0-9]+)"
    rest = rf"(?: err={between})?(?: reason={between})?(?: task={between})?\s*\z"
    ok = lines.filter(F.col("value").rlike(head))
    of = lambda i: F.regexp_extract("value", head + "(?:" + rest + "|.*)", i)
    told = lambda i: unquoted(of(i))
    return ok.select(
        of(1).alias("at"), of(2).alias("layer"), (of(3) == "true").alias("hit"), of(4).cast("double").alias("score"), of(5).cast("long").alias("ms"), of(6).cast("long").alias("cand"),
        told(7).alias("err"), told(8).alias("reason"), told(9).alias("task"),
    )


def retained(lines: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Log lines (value) younger than so many days; lines without a time stay, lines too short for one go."""
    at = F.try_to_timestamp(F.substring("value", 1, 19), F.lit("yyyy-MM-dd HH:mm:ss"))
    return lines.filter((F.length("value") >= 19) & (at.isNull() | (at > now - F.make_dt_interval(F.lit(days)))))


def clarifications(lines: DataFrame) -> DataFrame:
    """(path, n, question, answer) of question files (path, line, text): a Q line begins a pair, an A line its answer,
    further lines go on with it but for headings and rules."""
    t = trimmed(F.col("text"))
    q, a = t.startswith("Q") & F.contains(t, F.lit(":")), t.startswith("A") & F.contains(t, F.lit(":"))
    kind = F.when(q, "q").when(a, "a").when((t != "") & ~t.startswith("#") & ~t.startswith("---"), "more").otherwise("skip")
    order = W.Window.partitionBy("path").orderBy("line")
    rows = lines.withColumn("kind", kind).withColumn("n", F.sum(F.when(F.col("kind") == "q", 1).otherwise(0)).over(order)).filter("n > 0 and kind <> 'skip'")
    within = W.Window.partitionBy("path", "n").orderBy("line")
    rows = rows.withColumn("answers", F.sum(F.when(F.col("kind") == "a", 1).otherwise(0)).over(within))
    last = F.max("answers").over(W.Window.partitionBy("path", "n"))
    rows = rows.withColumn("last", last).filter("kind = 'q' or (answers > 0 and answers = last)")
    said = F.when(F.col("kind") == "a", after_colon(trimmed(F.col("text")))).when(F.col("kind") == "more", F.col("text"))
    pairs = rows.groupBy("path", "n").agg(
        F.max(F.when(F.col("kind") == "q", after_colon(trimmed(F.col("text"))))).alias("question"),
        F.array_sort(F.collect_list(F.when(F.col("kind") != "q", F.struct("line", said.alias("s"))))).alias("parts"))
    answer = trimmed(F.array_join(F.filter(F.col("parts.s"), lambda s: s != ""), "\n"))
    return pairs.filter("question <> ''").select("path", F.col("n").cast("int").alias("n"), "question", answer.alias("answer"))


def registry(json_text: DataFrame) -> DataFrame:
    """(name, path, llm) of registry texts (value): a map from name to entry; a missing or empty text has none."""
    entries = F.from_json("value", "struct<agents:map<string,struct<path:string,llm:string>>>")
    return json_text.select(F.explode(entries["agents"]).alias("name", "e")).select("name", "e.path", "e.llm")


def registry_text(entries: DataFrame) -> DataFrame:
    """(value): one registry text that registry() reads back, of entries (name, path, llm)."""
    entry = F.struct("name", F.struct("path", "llm").alias("e"))
    return entries.agg(F.to_json(F.struct(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("agents")), {"pretty": "true"}).alias("value"))


def write_registry(spark: SparkSession, path: str, entries: DataFrame) -> None:
    """Put entries (name, path, llm) in place of what a registry file has, in one step."""
    write_text(spark, path, registry_text(entries).first()["value"] or '{"agents": {}}')


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """registry() of a file; none where there is no such file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return registry(spark.createDataFrame([], "value string"))
    return registry(spark.read.text(path, wholetext=True))


#: Models of the sort that runs by default, and layouts, the default first.
PRESETS, LAYOUTS = ("claude",), ("split-h", "split-v", "window", "popup")
_CONFIG = (
    "struct<llm:string,llm_classify:string,llm_dedup:string,model:string,model_classify:string,model_dedup:string,test_cmd:string,auto_execute_small:boolean,tmux_layout:string,"
    "approval_watchdog:boolean,approval_patterns:array<string>,step_model_by_verb:map<string,string>>"
)


def config(json_text: DataFrame) -> DataFrame:
    """One row per configuration text (value): its record, with the default in place of whatever isn't allowed. Models are
    identifiers, presets and layouts those known; the watchdog is on unless turned off. A text that is missing or no
    object has the defaults alone."""
    c = F.from_json(F.coalesce("value", F.lit("")), _CONFIG)
    rows = json_text.select(c.alias("c")).select("c.*")
    model = lambda name: setting(F.col(name))
    preset = lambda name, default="": setting(F.col(name), PRESETS, default)
    plain = lambda name, default: F.coalesce(F.col(name), default)
    return rows.select(
        preset("llm", PRESETS[0]).alias("llm"), preset("llm_classify").alias("llm_classify"), preset("llm_dedup").alias("llm_dedup"), model("model").alias("model"), model("model_classify").alias("model_classify"),
        model("model_dedup").alias("model_dedup"), plain("test_cmd", F.lit("")).alias("test_cmd"), plain("auto_execute_small", F.lit(False)).alias("auto_execute_small"),
        setting(F.col("tmux_layout"), LAYOUTS, LAYOUTS[0]).alias("tmux_layout"), plain("approval_watchdog", F.lit(True)).alias("approval_watchdog"),
        plain("approval_patterns", F.array().cast("array<string>")).alias("approval_patterns"), plain("step_model_by_verb", F.create_map().cast("map<string,string>")).alias("step_model_by_verb"),
    )


def peers(entries: DataFrame, own_path: str | None = None, own_name: str | None = None) -> DataFrame:
    """Entries of a registry but the repository's own, by its path or by the name of its directory."""
    own = F.col("path").eqNullSafe(F.lit(own_path)) if own_path is not None else F.lit(False)
    return entries.filter(~(own | (F.col("name") == own_name if own_name is not None else F.lit(False))))


def clarification_text(task_id: Column, description: Column, questions: Column) -> Column:
    """A question file that clarifications() reads back once answers stand after its A marks."""
    number = lambda i: (i + 1).cast("string")
    asked = F.transform(questions, lambda q, i: F.concat(F.lit("Q"), number(i), F.lit(": "), q, F.lit("\nA"), number(i), F.lit(": \n\n")))
    head = F.concat(F.lit("# Clarification needed for task #"), task_id.cast("string"), F.lit("\n\nTask: "), F.coalesce(description, F.lit("")), F.lit("\n\n---\n\n"))
    return F.concat(head, F.array_join(asked, ""))


def labelled_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, duplicate, category) of a file that holds {"pairs": [...]}."""
    folder, name = path.rstrip("/").rpartition("/")[::2]
    files = texts(spark, folder or ".", name, False).filter(F.col("path") == name)
    pairs = F.from_json("content", "struct<pairs:array<struct<a:string,b:string,duplicate:boolean,category:string>>>")["pairs"]
    return files.select(F.explode(pairs).alias("p")).select("p.*")


def yaml_symbols(lines: DataFrame) -> DataFrame:
    """Keys without indent, and the first name after each kind."""
    bare = F.regexp_replace("text", r"^[ \t]+", "")
    rows = lines.withColumn("bare", bare).filter((F.col("bare") != "") & ~F.col("bare").startswith("#"))
    top = (F.col("bare") == F.col("text")) & F.regexp_replace("bare", r" +\z", "").endswith(":")
    key = F.regexp_replace(trimmed(F.col("bare")), r":\z", "")
    keys = rows.filter(top & is_identifier(key)).select("path", "line", key.alias("name"), F.lit("yaml-key").alias("kind"), F.col("text").alias("signature"))
    order = W.Window.partitionBy("path").orderBy("line").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow)
    inner = rows.filter(~top).withColumn("k", F.when(F.col("bare").startswith("kind:"), trimmed(F.substr("bare", F.lit(6)))))
    inner = inner.withColumn("nth", F.count("k").over(order)).filter("nth > 0").withColumn("kd", F.last("k", True).over(order))
    named = inner.filter(F.col("bare").startswith("name:")).withColumn("nm", trimmed(F.substr("bare", F.lit(6)))).filter("nm <> '' and kd <> ''")
    firsts = named.withColumn("r", F.row_number().over(W.Window.partitionBy("path", "nth").orderBy("line"))).filter("r = 1")
    return keys.unionByName(firsts.select("path", "line", F.col("nm").alias("name"), F.lower("kd").alias("kind"), F.concat("kd", F.lit(": "), "nm").alias("signature")))


#: Words that begin a block, and instructions that are told.
BLOCKS = ("resource", "module", "variable", "output", "data", "provider", "locals", "terraform")


def terraform_symbols(lines: DataFrame) -> DataFrame:
    t = trimmed(F.col("text"))
    kind = F.regexp_extract(t, rf"\A({'|'.join(BLOCKS)})[ {{]", 1)
    names = quoted_strings(t)
    nth = lambda i: F.try_element_at(names, F.lit(i))
    both = F.when(F.size(names) >= 2, F.concat(nth(1), F.lit("."), nth(2)))
    name = F.when(kind.isin("resource", "data"), both).when(kind.isin("module", "variable", "output", "provider"), nth(1)).when(kind != "", kind)
    return lines.select("path", "line", name.alias("name"), kind.alias("kind"), F.col("text").alias("signature")).filter("coalesce(name, '') <> ''")


INSTRUCTIONS = ("FROM", "EXPOSE", "ENV", "CMD", "ENTRYPOINT", "ARG", "WORKDIR", "USER", "LABEL")


def dockerfile_symbols(lines: DataFrame) -> DataFrame:
    t = trimmed(F.col("text"))
    first = F.regexp_extract(t, r"\A(\S+)", 1)
    rows = lines.filter(F.upper(first).isin(*INSTRUCTIONS))
    return rows.select("path", "line", F.upper(first).alias("name"), F.concat(F.lit("dockerfile-"), F.lower(first)).alias("kind"), t.alias("signature"), trimmed(F.regexp_replace(t, r"\A\S+", "")).alias("doc_comment"))


def json_symbols(lines: DataFrame) -> DataFrame:
    """Keys on lines after which one bracket is open, those in strings counted too."""
    many = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    depth = F.sum(many("{[") - many("}]")).over(W.Window.partitionBy("path").orderBy("line").rowsBetween(W.Window.unboundedPreceding, W.Window.currentRow))
    key = F.regexp_extract("text", r'\A[ \t]*"([^"]*)"', 1)
    rows = lines.withColumn("depth", depth).filter("depth = 1").withColumn("key", key)
    return rows.filter(is_identifier(F.col("key"))).select("path", "line", F.col("key").alias("name"), F.lit("json-key").alias("kind"), trimmed(F.col("text")).alias("signature"))


#: Kinds of tags by the names that a tagger gives them.
TAG_KINDS = {
    "function": ("function", "func", "procedure"), "method": ("method",), "class": ("class",), "struct": ("struct",), "interface": ("interface",),
    "type": ("type", "typedef", "alias"), "enum": ("enum",), "module": ("module", "namespace", "package"), "variable": ("variable", "constant", "field", "member", "property"),
}


def tag_kind(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for to, names in TAG_KINDS.items() for n in names for x in (n, to)])
    return F.coalesce(F.try_element_at(known, kind), kind)


def tags(lines: DataFrame) -> DataFrame:
    """Symbols of a tagger's JSON lines (value)."""
    e = F.from_json("value", "struct<_type:string,name:string,path:string,line:int,kind:string,scope:string,pattern:string>")
    rows = lines.select(e.alias("e")).filter("e.name is not null and coalesce(e._type, 'tag') = 'tag'")
    signature = trimmed(F.regexp_replace(F.regexp_replace("e.pattern", r"\A/\^", ""), r"\$/\z", ""))
    return rows.select("e.path", "e.name", tag_kind(F.col("e.kind")).alias("kind"), "e.line", signature.alias("signature"), F.col("e.scope").alias("parent_name"))
