import subprocess

import pytest
from pyspark.sql import functions as F

from quarry.api import Engine
from quarry.operators import search
from quarry.sources import extract, files
from quarry.sources.store import Store
from quarry.streaming import tasks as streams

SERVER_GO = """package main

// Box holds things.
type Box struct {
\tn int
}

// Open makes a box.
func Open(n int) *Box {
\treturn &Box{n: n}
}

func (b *Box) Close() error {
\tlog.Print("func fake() {") // func alsoFake()
\treturn nil
}

type (
\tShape interface{ Area() float64 }
\tName string
)

func main() {
\tb := Open(1)
\tb.Close()
}
"""

APP_TS = """interface User { id: string }
type Role = "a" | "b";
export class Service extends Base {
  private n = 1;
  get(id: string): User { return this.find(id); }
  static async make(): Promise<Service> { return new Service(); }
}
export const load = async (n: number) => { await fetchAll(n); };
function outer(a: number): void { helper(a); }
"""

APP_PY = '''class A(B):
    """def no(): pass"""
    def m(self, x=(1, 2)) -> int:
        def inner(): pass
        return helper(x)


async def top(): ...
'''

APP_KT = """package a
sealed class State {
    object Idle : State()
    data class Done(val token: String, n: Int) : State()
}
interface Listener { fun on(x: Int) }
enum class Role { ADMIN, USER; fun low() = name.lowercase() }
class Main : Base() {
    private val repo by lazy { Repo() }
    companion object { const val TAG = "x" }
    fun run(a: String): Boolean = repo.go(a)
}
typealias Cb = (Int) -> Unit
fun main() { Main().run("fun fake()") }
"""

APP_JAVA = """package a;
public class Foo<T> extends Bar {
  private final int x = 3;
  Foo(int z) { this.x = z; }
  @Override public List<String> get(int a) throws E { return other.call(a); }
  interface In { void m(); }
  enum E { A, B }
}
record P(int a) { int sum() { return a; } }
"""


def kinds(language, src):
    return {(s["name"], s["kind"], s["parent_name"]) for s in extract.scan_file(language, src)}


def test_go():
    assert kinds("go", SERVER_GO) == {("Box", "struct", ""), ("Open", "function", ""), ("Close", "method", "Box"), ("Shape", "interface", ""), ("Name", "type", ""), ("main", "function", "")}
    by = {s["name"]: s for s in extract.scan_file("go", SERVER_GO)}
    assert by["Open"]["signature"] == "func Open(n int) *Box" and by["Open"]["doc_comment"] == "// Open makes a box."
    assert by["Close"]["signature"] == "func (b *Box) Close() error" and set(by["main"]["refs"]) == {"Open", "Close"}
    assert by["Box"]["signature"] == "type Box struct{...}" and (by["Box"]["line"], by["Box"]["end_line"]) == (4, 6)


def test_typescript():
    assert kinds("typescript", APP_TS) == {("User", "interface", ""), ("Role", "type", ""), ("Service", "class", ""), ("get", "method", "Service"), ("make", "method", "Service"), ("load", "function", ""), ("outer", "function", "")}


def test_python():
    assert kinds("python", APP_PY) == {("A", "class", ""), ("m", "method", "A"), ("top", "function", "")}
    assert next(s for s in extract.scan_file("python", APP_PY) if s["name"] == "m")["signature"] == "def m(self, x=(1, 2)) -> int"
    assert extract.scan_file("python", "def broken(") == []


def test_kotlin():
    assert kinds("kotlin", APP_KT) == {
        ("State", "class", ""), ("Idle", "object", ""), ("Done", "class", ""), ("token", "property", "Done"), ("Listener", "interface", ""), ("on", "method", "Listener"), ("Role", "enum", ""), ("ADMIN", "enum_value", "Role"), ("USER", "enum_value", "Role"),
        ("low", "method", "Role"), ("Main", "class", ""), ("repo", "property", "Main"), ("Main.Companion", "object", ""), ("TAG", "property", "Main.Companion"), ("run", "method", "Main"), ("Cb", "type", ""), ("main", "function", ""),
    }


def test_java():
    assert kinds("java", APP_JAVA) == {("Foo", "class", ""), ("x", "field", "Foo"), ("Foo", "constructor", "Foo"), ("get", "method", "Foo"), ("In", "interface", ""), ("m", "method", "In"), ("E", "enum", ""), ("P", "record", ""), ("sum", "method", "P")}


def test_unknown_language_has_no_symbols():
    assert extract.scan_file("xyz", "text") == [] and extract.scan_file(None, None) == []


def test_tags_stand_in_for_a_scanner(spark):
    from quarry.sources import lines as L

    said = ['{"_type":"tag","name":"hull","path":"a.rs","line":3,"kind":"func","pattern":"/^fn hull()$/","scope":"Ship"}', '{"_type":"tag","name":"never","path":"b.py","line":1,"kind":"func"}', '{"_type":"tag","name":"bare","path":"a.rs","kind":"odd"}', "no json"]
    found = spark.createDataFrame([("a.rs", "rust", "fn hull() {}"), ("b.py", "python", "def seen(): pass")], "path string, language string, content string")
    rows = extract.symbols(found, L.tags(spark.createDataFrame([(x,) for x in said], "value string"))).collect()
    assert sorted((r.path, r.language, r.name, r.kind, r.line, r.signature, r.parent_name) for r in rows) == [("a.rs", "rust", "bare", "odd", 0, "", ""), ("a.rs", "rust", "hull", "function", 3, "fn hull()", "Ship"), ("b.py", "python", "seen", "function", 1, "def seen()", "")]
    assert extract.symbols(found).count() == 1


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for name, body in {"server.go": SERVER_GO, "src/app.ts": APP_TS, "a b/app.py": APP_PY, "App.kt": APP_KT, "Foo.java": APP_JAVA, "node_modules/dep.js": "function no() {}", "k.yaml": "top:\n", "README.md": "x", "out/skip.go": "package p"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(body)
    (root / ".gitignore").write_text("# c\nout/\n")
    return root


def test_walk(spark, repository):
    rows = {r.path: r for r in files.walk(spark, str(repository)).collect()}
    assert set(rows) == {"server.go", "src/app.ts", "a b/app.py", "App.kt", "Foo.java", "k.yaml"}
    assert rows["server.go"].language == "go" and rows["server.go"].size_bytes == len(SERVER_GO)
    assert {r.path for r in files.from_listing(spark, str(repository), ["server.go", "README.md"]).collect()} == {"server.go"}
    assert files.from_listing(spark, str(repository), []).count() == 0


def test_files_that_are_gone_or_not_utf8(spark, tmp_path):
    (tmp_path / "good.py").write_text("def good(): pass\n")
    (tmp_path / "latin.py").write_bytes(b"# caf\xe9\ndef latin(): pass\n")
    (tmp_path / "dir.py").mkdir()
    (tmp_path / "link.py").symlink_to("good.py")
    listing = ["good.py", "latin.py", "gone.py", "dir.py", "link.py", "gone.unknown"]
    assert {r.path for r in files.from_listing(spark, str(tmp_path), listing).collect()} == {"good.py", "latin.py"}
    assert {r.path: r.why for r in files.unread(spark, str(tmp_path), listing).collect()} == {"gone.py": "No such file or directory", "dir.py": "no plain file", "link.py": "no plain file"}
    engine = Engine(spark, str(tmp_path / "store"))
    engine.build(str(tmp_path))
    assert {r.name for r in engine.symbols().collect()} == {"good", "latin"}


def test_any_name_is_read(spark, tmp_path):
    names = {"__init__.py", "app/__init__.py", "_int/a.go", ".github/wf/ci.yml", "app/m.py", "pages/[id].tsx", "pages/a*b.go", "a+b %41.go", "é/ü.py"}
    for n in [*names, "node_modules/x/a.js", "app/build/a.py"]:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("x = 1\n")
    (tmp_path / "link.go").symlink_to("/etc/hostname")
    (tmp_path / "app/link.py").symlink_to("/etc/hostname")
    (tmp_path / "away").symlink_to("/etc")
    assert {r.path for r in files.walk(spark, str(tmp_path)).collect()} == names
    read = files.from_listing(spark, str(tmp_path), sorted(names)).collect()
    assert {r.path for r in read} == names and {bytes(r.content) for r in read} == {b"x = 1\n"}
    assert files.walk(spark, str(tmp_path), ["app"]).filter("path like 'app/%'").count() == 0


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.write("t", spark.range(3))
    before = store.read("t")
    store.write("t", spark.range(5))
    assert (before.count(), store.read("t").count()) == (3, 5)
    store.put_meta("o'clock", "a")
    store.put_meta("o'clock", "b")
    store.put_meta("k", "c")
    assert (store.meta("o'clock"), store.meta("k"), store.meta("none")) == ("b", "c", "")


def test_refresh_parses_changed_files_only(spark, repository, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "git_listing", lambda root: None)
    engine = Engine(spark, str(tmp_path / "state"))
    engine.build(str(repository))
    before = {r.id for r in engine.symbols().collect()}
    seen, real = [], extract.symbols
    monkeypatch.setattr(extract, "symbols", lambda found, tags=None: seen.append({r.path for r in found.select("path").collect()}) or real(found, tags))
    (repository / "late.go").write_text("package main\n\nfunc Late() {}\n")
    engine.refresh(str(repository))
    assert seen == [{"late.go"}]
    assert {r.name for r in engine.symbols().collect() if r.id not in before} == {"Late"}
    assert before <= {r.id for r in engine.symbols().collect()}
    (repository / "late.go").unlink()
    engine.refresh(str(repository))
    assert seen[1:] == [set()] and {r.id for r in engine.symbols().collect()} == before


def state(engine):
    """All that an index says, but for times."""
    edges = {tuple(r) for r in engine.edges().collect()}
    ranks = {r.id: r["rank"] for r in engine.symbols().select("id", "rank").collect()}
    found = {q: sorted((r.name, round(r.score, 9)) for r in engine.search_symbols(q, 50).collect()) for q in ("go OR shared", "func*", '"func late"', "name : shared")}
    shown = {tuple(r) for r in engine.symbols().select("id", "name", "file_path", "line", "parent_id").collect()}
    return edges, ranks, found, shown, {(r.path, r.symbol_count) for r in engine.store.read("files").collect()}


def same_as_built(spark, engine, repository, folder):
    fresh = Engine(spark, str(folder))
    fresh.build(str(repository))
    a, b = state(engine), state(fresh)
    assert a[0] == b[0] and a[2:] == b[2:] and {k: pytest.approx(v, abs=1e-6) for k, v in a[1].items()} == b[1]


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(search, "BUCKETS", 2)


def test_refresh_follows_the_repository(spark, tmp_path, monkeypatch):
    root = tmp_path / "repo"
    root.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    code = lambda *calls: "package p\n\n" + "".join(f"func {n}() {{\n\t{c}()\n}}\n\n" for n, c in calls)
    write = lambda name, text: (root / name).write_text(text)
    commit = lambda: (git("add", "-A"), git("commit", "-qm", "x"))
    engine, seen, real = Engine(spark, str(tmp_path / "state")), [], files._read
    monkeypatch.setattr(files, "_read", lambda names, r: seen.append({x.rel for x in names.collect()}) or real(names, r))
    refresh = lambda: {(r.path, r.action) for r in engine.refresh(str(root)).collect()}
    write("a.go", code(("one", "shared"), ("two", "one")))
    write("b.go", code(("shared", "two"), ("late", "none")))
    write("c.go", code(("three", "shared")))
    git("init", "-q")
    assert refresh() == {("a.go", "parse"), ("b.go", "parse"), ("c.go", "parse")}  # nothing is indexed yet: all
    commit()
    assert refresh() == {("a.go", "parse"), ("b.go", "parse"), ("c.go", "parse")} and engine.store.meta("last_indexed_commit")  # no commit was indexed
    assert refresh() == set() and seen.pop() == set()  # the same commit and nothing dirty: no file is read
    write("d.go", code(("shared", "three"), ("four", "late")))  # another winner of a name, not committed
    before = {tuple(r) for r in engine.store.read("edges").collect()}
    assert refresh() == {("d.go", "parse")} and seen.pop() == {"d.go"}
    now = {tuple(r) for r in engine.store.read("edges").collect()}
    assert {r[2] for r in before ^ now} == {"shared", "three", "late"} and {r for r in before if r[2] in ("one", "two")} <= now
    commit()
    write("c.go", code(("three", "two"), ("five", "four")))
    (root / "b.go").unlink()
    commit()
    write("a.go", code(("one", "five")))  # dirty, where the commit moved: left for later
    assert refresh() == {("c.go", "parse"), ("d.go", "same_content"), ("b.go", "delete")}
    assert refresh() == {("a.go", "parse")}
    same_as_built(spark, engine, root, tmp_path / "built")
    engine.store.put_meta("last_indexed_commit", "0" * 40)  # a commit that is gone
    assert {p for p, _ in refresh()} == {"a.go", "c.go", "d.go"} and engine.store.meta("last_indexed_commit") != "0" * 40


def test_engine_over_a_repository(spark, repository, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "git_listing", lambda root: None)
    engine = Engine(spark, str(tmp_path / "state"))
    engine.build(str(repository))
    symbols = {r.name: r for r in engine.symbols().filter("file_path = 'server.go'").collect()}
    assert len(symbols) == 6 and symbols["main"].id and len(symbols["main"].id) == 24
    assert {(r.name, r.direction) for r in engine.call_graph(symbols["main"].id).collect()} == {("Open", "callee"), ("Close", "callee")}
    assert engine.symbols().agg(F.sum("rank")).first()[0] == pytest.approx(1)
    assert "Open" in {r.name for r in engine.search_symbols("Open").collect()}
    assert [r.name for r in engine.file_context("server.go").collect()][:2] == ["Box", "Open"]
    assert engine.overview(3).count() == 3 and engine.counts().first().asDict() == {"files": 6, "symbols": engine.symbols().count(), "edges": engine.edges().count()}
    engine.snapshot("main")
    assert engine.diff("main").count() == 0
    assert engine.refresh(str(repository)).filter("action = 'parse'").count() == 0
    (repository / "new.go").write_text("package main\n\nfunc Added() {}\n")
    assert {(r.path, r.action) for r in engine.refresh(str(repository)).filter("action <> 'same_time'").collect()} == {("new.go", "parse")}
    assert {r.change for r in engine.diff("main").collect()} == {"added"}


def test_engine_tasks(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "state"))
    new = spark.createDataFrame([(1, "add login endpoint to the api"), (2, "Add login endpoint to the API!"), (3, "remove stale cache entries"), (4, "  ")], "new_id long, description string")
    assert {r.new_id: r.accepted for r in engine.create_tasks(new, "peer").collect()} == {1: True, 2: False, 3: True}
    assert [(r.id, r.status, r.created_by) for r in engine.list_tasks().orderBy("id").collect()] == [(1, "created", "peer"), (2, "created", "peer")]
    assert engine.dedup(spark.createDataFrame([(9, "please add login endpoint to the api")], "new_id long, description string")).first().layer == "keyword"
    engine.update_task(1, plan_json='[{"verb":"modify"},{"verb":"test"}]')
    assert engine.approve_task(1).count() == 2 and engine.approve_task(1).count() == 2
    engine.update_task(2, status="pending_clarification")
    for bad in ({"id": 9}, {"status": "gone"}, {"description": "x"}):
        with pytest.raises(ValueError):
            engine.update_task(2, **bad)
    engine.clarify_task(2, [("which?", "all"), ("why?", "")])
    assert engine.show_task(2).first().description.endswith("Clarifications:\n- which?: all\n")
    engine.update_task(1, status="executing")
    with pytest.raises(ValueError):
        engine.delete_task(1)
    engine.sweep()
    assert engine.show_task(1).first().status == "interrupted"
    engine.delete_task(1)
    with pytest.raises(KeyError):
        engine.approve_task(1)
    engine.reject_task(2)
    with pytest.raises(ValueError):
        engine.approve_task(2)
    assert engine.status().first().total == 1
    assert engine.store.meta("head") == ""
    engine.store.put_meta("head", "abc")
    engine.store.put_meta("head", "def")
    assert engine.store.meta("head") == "def"


def run(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return spark.table(name)


@pytest.fixture
def events(spark):
    source = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(source)
    return batch.withColumn("ts", F.col("ts").cast("timestamp")), spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))


def test_streams_agree_with_batches(spark, events):
    batch, stream = events
    key = lambda df: sorted(map(str, df.collect()))
    assert key(run(spark, streams.windowed_counts(stream), "w", "complete").select("event_type", "n")) == key(streams.windowed_counts(batch).select("event_type", "n"))
    status = lambda e: e.select(F.col("user_id").alias("id"), F.element_at(F.lit(["executing", "done", "pending"]), (F.col("event_id") % 3 + 1).cast("int")).alias("status"), "ts", F.lit("r").alias("repo"))
    assert key(run(spark, streams.latest_status(status(stream)), "l", "complete")) == key(streams.latest_status(status(batch)))
    assert key(run(spark, streams.live_rollup(status(stream)), "r", "complete")) == key(streams.live_rollup(status(batch)))
    assert run(spark, streams.terminal(status(stream)), "t").count() == status(batch).filter("status = 'done'").count()
    assert run(spark, streams.distinct_events(stream, ["event_id"]), "d").count() == batch.select("event_id").distinct().count()


def test_input_changes_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:01", "working"), (1, "2024-01-01 00:00:02", "continue? [y/n]"), (1, "2024-01-01 00:00:03", "continue? [y/n]"), (1, "2024-01-01 00:00:04", "ok"), (2, "2024-01-01 00:00:01", "fine")]
    spark.createDataFrame(rows, "id long, ts string, tail string").coalesce(1).write.parquet(str(tmp_path / "p"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("id long, ts string, tail string").parquet(str(tmp_path / "p")).withColumn("ts", F.col("ts").cast("timestamp"))
        got = run(spark, streams.input_changes(stream), "c").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert sorted((r.id, r.ts.second, r.needs_input) for r in got) == [(1, 2, True), (1, 4, False)]
