"""Renderings, settings, sources and sinks, each on rows made by hand."""

import json

from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import dedup, index, lifecycle, usage
from quarry.sources import lines as L


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_renderings(spark):
    strings = lambda *a: F.array(*map(F.lit, a)) if a else F.array().cast("array<string>")
    assert one(spark, text.plan_text(F.lit("small"), F.lit("why"), strings("a.go", "b.go"), strings(), strings("do", "test"))) == "Classification: small\nReason: why\nFiles: a.go, b.go\nPlan:\n  1. do\n  2. test\n"
    step = lambda d, after: F.struct(F.lit("edit").alias("verb"), F.lit("a.go").alias("target_file"), strings().alias("symbols"), F.lit("").alias("acceptance"), after.alias("depends_on"), F.lit(d).alias("description"))
    steps = F.array(step("", F.array().cast("array<int>")), step("then", F.array(F.lit(1), F.lit(2))))
    none = F.lit(None).cast("string")
    got = one(spark, text.pipeline_text(F.lit("large"), F.lit("r"), F.lit(0.5), strings("which?"), F.lit(""), strings(), strings("F"), steps, none, F.lit("late")))
    assert got == "Classification: large\nReason: r\nConfidence: 0.50\nClarifying questions:\n  1. which?\nSymbols: F\nPlan:\n  1. Edit a.go\n  2. then  [after [1 2]]\nPlan error: late\n"
    model = lambda c, m: one(spark, text.with_model(F.lit(c), F.lit(m)))
    assert [model("tool -p", "m"), model("tool --model x -p", "m"), model("tool --model x", "m"), model("tool", "")] == ["tool -p --model m", "tool --model m -p", "tool --model m", "tool"]
    first = lambda *w: one(spark, text.with_model_first(strings(*w), F.lit("m")))
    assert [first("/bin/gemini", "a b"), first("x"), first()] == ['/bin/gemini -m m "a b"', "x --model m", ""]
    assert [one(spark, text.with_model_first(strings("c", "p q"), m)) for m in (F.lit(""), none)] == ['c "p q"'] * 2
    assert [one(spark, text.setting(F.lit(v), a, d)) for v, a, d in (("ok-1", None, ""), ("a b", None, ""), (None, None, "d"), ("q", ("p", "r"), "p"))] == ["ok-1", "", "d", "p"]
    assert one(spark, lifecycle.colour(F.lit("done"))) == "\x1b[32m" and one(spark, lifecycle.colour(F.lit("?"))) == ""
    assert one(spark, lifecycle.next_action(F.lit("x"))).startswith("fetch") and "wait" in one(spark, lifecycle.next_action(F.lit("executing")))
    assert one(spark, dedup.reason("tfidf", F.lit(7), F.lit("executing"), F.lit(0.5))) == "tf-idf duplicate in progress as task #7 (tfidf cos=0.50)"


def test_steps(spark, tmp_path):
    from quarry.api import STEP_SCHEMA

    steps = spark.createDataFrame([(1, 2, "b"), (1, 1, "a")], "task_id long, seq int, verb string")
    steps = spark.createDataFrame([], STEP_SCHEMA).unionByName(steps, allowMissingColumns=True)
    done = lifecycle.with_step(steps, F.col("seq") == 2, status="done", tokens_used=5)
    assert {(r.seq, r.status, r.tokens_used, r.updated_at is None) for r in done.collect()} == {(1, None, None, True), (2, "done", 5, False)}
    for bad in ({"verb": "x"}, {"status": "gone"}):
        try:
            lifecycle.with_step(steps, F.lit(True), **bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert {(r.id, r.has_steps) for r in lifecycle.has_steps(steps, spark.createDataFrame([(1,), (2,)], "id long")).collect()} == {(1, True), (2, False)}


def test_trees(spark):
    files = spark.createDataFrame([("b/x.py", "python"), ("a.go", "go"), ("b/a.py", "python"), ("b/c/n", "")], "path string, language string")
    assert [r.line for r in index.file_tree(files).collect()] == ["a.go", "b/a.py", "b/x.py", "b/c/n"]
    assert [r.line for r in index.file_tree(files, 3).collect()] == ["./ (1 files)", "b/ (2 files)", "b/c/ (1 files)"]
    assert [r.language for r in index.languages_present(files).collect()] == ["go", "python"]


def test_sources_and_sinks(spark, tmp_path):
    entries = spark.createDataFrame([("one", "/a", "x"), ("two", "/b", None)], "name string, path string, llm string")
    assert {tuple(r) for r in L.registry(L.registry_text(entries)).collect()} == {("one", "/a", "x"), ("two", "/b", None)}
    assert [r.name for r in L.peers(entries, "/a").collect()] == ["two"] and [r.name for r in L.peers(entries, own_name="two").collect()] == ["one"]
    body = one(spark, L.clarification_text(F.lit(3), F.lit("d"), F.array(F.lit("why?"), F.lit("how?"))))
    answered = spark.createDataFrame([("p", body.replace("A1: ", "A1: so").replace("A2: ", "A2: thus"))], "path string, content string")
    assert sorted((r.question, r.answer) for r in L.clarifications(L.numbered(answered)).collect()) == [("how?", "thus"), ("why?", "so")]
    log = spark.createDataFrame([('2024 layer=t hit=true score=0.500 ms=1 cand=2 err="no net" reason="r"',)], "value string")
    assert [(r.err, r.reason) for r in L.parsed_dedup_log(log).collect()] == [("no net", "r")]
    (tmp_path / "pairs.json").write_text(json.dumps({"pairs": [{"a": "mend the gate latch", "b": "mend the gate latch", "duplicate": True, "category": "same"}, {"a": "mend the gate latch", "b": "paint a boat", "duplicate": False, "category": "other"}]}))
    table = dedup.confusion(dedup.judged(L.labelled_pairs(spark, str(tmp_path / "pairs.json"))), ["layer"])
    assert {(r.layer, r.tp, r.fp, r.tn, r.fn, r.f1) for r in table.collect()} == {(x, 1, 0, 1, 0, 1.0) for x in ("keyword", "trigram", "tfidf", "minhash", "cascade")}
    timed = dedup.evaluated(L.labelled_pairs(spark, str(tmp_path / "pairs.json")), ("keyword", "cascade")).collect()
    assert [(r.layer, r.f1, r.mean_ms > 0) for r in timed] == [("keyword", 1.0, True), ("cascade", 1.0, True)]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a b.jsonl").write_text('{"k":1}\n\n{"k":2}\n')
    assert sorted(map(tuple, usage.read_sessions(spark, str(tmp_path / "s")).filter("value <> ''").collect())) == [("a b", '{"k":1}'), ("a b", '{"k":2}')]
    for hidden in ("_b", ".c"):
        (tmp_path / f"s/{hidden}.jsonl").write_text('{"k":3}\r\n')
    (tmp_path / "s/below").mkdir()
    (tmp_path / "s/below/x.jsonl").write_text("{}\n")
    assert {r.session_id for r in usage.read_sessions(spark, str(tmp_path / "s")).collect()} == {"a b", "_b", ".c"}
    assert {r.session_id for r in usage.read_sessions(spark, f"file://{tmp_path}/s").collect()} == {"a b"}
    L.write_registry(spark, str(tmp_path / "agents.json"), entries)
    assert {tuple(r) for r in L.read_registry(spark, str(tmp_path / "agents.json")).collect()} == {("one", "/a", "x"), ("two", "/b", None)}
    L.write_registry(spark, str(tmp_path / "agents.json"), entries.filter("name = 'two'"))
    assert [r.name for r in L.read_registry(spark, str(tmp_path / "agents.json")).collect()] == ["two"] and L.read_registry(spark, str(tmp_path / "none.json")).count() == 0
    assert not [p.name for p in tmp_path.iterdir() if p.name.startswith("agents.json-")]
    times = spark.createDataFrame([("p/x.jsonl", 1), ("p/y.jsonl", 3), ("p/z.txt", 9)], "path string, modified long")
    assert usage.latest_session(times).first()[0] == "y"
    (tmp_path / "r/in").mkdir(parents=True)
    for k, (variant, eff) in enumerate((("baseline", 10), ("mcp", 6), ("classify", 0))):
        (tmp_path / f"r/in/{k}.json").write_text(json.dumps({"repo": "R", "task_id": "t", "variant": variant, "wall_clock_sec": 1.5, "usage": {"effective_input_billed": eff, "tool_calls": 2}}))
    (tmp_path / "r/bad.json").write_text("{")
    (tmp_path / "r/in/_3.json").write_text(json.dumps({"repo": "R", "task_id": "u", "variant": "mcp", "usage": {}}))
    assert usage.read_results(spark, str(tmp_path / "r")).filter("task_id = 'u'").count() == 1
    (tmp_path / "r/in/_3.json").unlink()
    report = usage.markdown_report(usage.variant_table(usage.latest_runs(usage.read_results(spark, str(tmp_path / "r")))))
    shown = [r.line for r in report.collect()]
    assert shown[2:] == ["| R | t | 1.5 | 10 | 6 | 0.60 | 2 | 2 |", "**Aggregate over 1 tasks: 40.0% reduction in effective input tokens (ratio 0.60).**"]


def test_log_round_trip(spark):
    said = ['say "x"', "C:\\", 'a\\"b', "tab\there", "bell\x07 \x01", "é 中 \U0001f600", " reason=\"q\" task=", "", "\\n", "x" * 300]
    none = F.lit(None).cast("string")
    rows = spark.createDataFrame(list(enumerate(said)), "i int, s string")
    at = F.lit("2024-01-02 03:04:05").cast("timestamp")
    lines = rows.select("i", L.dedup_log_line(at, F.lit("tfidf"), F.lit(True), F.lit(0.75), F.lit(3), F.col("i"), none, F.col("s"), F.col("s")).alias("value"))
    got = {r.cand: (r.at, r.layer, r.hit, r.score, r.ms, r.err, r.reason, r.task) for r in L.parsed_dedup_log(lines).collect()}
    flat = lambda s, n: (" ".join(s.replace("\t", " ").split(" ")).strip()[:n] + "…" * (len(s) > n))
    assert got == {i: ("2024-01-02T03:04:05Z", "tfidf", True, 0.75, 3, "", flat(s, 200), flat(s, 160)) for i, s in enumerate(said)}
    odd = spark.createDataFrame([(r'T layer=k hit=false score=0.000 ms=1 cand=0 err="a\tb \u00e9\U0001f600\x41" task="t"',), ("no log line",)], "value string")
    assert [(r.err, r.reason, r.task) for r in L.parsed_dedup_log(odd).collect()] == [("a\tb é\U0001f600A", "", "t")]


def test_places_and_slots(spark):
    from quarry.operators.lineage import placed

    rows = [(i, (i * 7) % 5, "approved" if i % 3 else "done") for i in range(60)]
    tasks = spark.createDataFrame(rows, "id long, created_at long, status string").repartition(6)
    want = {i: k for k, (_, i) in enumerate(sorted((a, i) for i, a, _ in rows), 1)}
    got = placed(tasks, F.col("created_at"), F.col("id"))
    assert {r.id: r.place for r in got.collect()} == want and got.columns == ["id", "created_at", "status", "place"]
    queue = [i for i, _, s in sorted(rows, key=lambda r: (r[1], r[0])) if s == "approved"]
    assert {(r.id, r.state, r.queue_place) for r in lifecycle.slots(tasks, 2).collect()} == {(i, "running" if k < 2 else "queued", max(0, k - 1)) for k, i in enumerate(queue)}
    assert placed(tasks.limit(0), F.col("id")).count() == lifecycle.slots(tasks.limit(0)).count() == 0


def test_layers_on_labelled_pairs(spark):
    """All layers against plain Python, a pair at a time."""
    import math
    import random
    import re

    from quarry.functions import minhash

    rng = random.Random(3)
    vocabulary = ["gate", "latch", "oak", "boat", "mend", "mending", "paint", "red", "it", "at", "roof", "roofs"]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    pairs = []
    for _ in range(60):
        a = pick(rng.randint(0, 7))
        b = [w for w in a if rng.random() < 0.8] if rng.random() < 0.6 else pick(rng.randint(0, 7))
        pairs.append((" ".join(a), " ".join(b), rng.random() < 0.5, rng.choice("xy")))

    def layers(a, b):
        ta, tb = re.findall("[a-z]{3,}", a), re.findall("[a-z]{3,}", b)
        ga, gb = ({f" {s} "[i : i + 3] for i in range(len(s))} if s else set() for s in (a, b))
        v = lambda t, o: {w: t.count(w) / len(t) * (1 if w in o else 1 + math.log(1.5)) for w in t}
        va, vb = v(ta, tb), v(tb, ta)
        norm = lambda x: math.sqrt(sum(y * y for y in x.values()))
        sh = lambda t: list(dict.fromkeys(f"{x} {y}" for x, y in zip(t, t[1:])) if len(t) > 1 else t)
        out = {
            "keyword": bool(ta and tb) and sum(w in tb for w in ta) / len(ta) >= 0.8, "trigram": bool(ga and gb) and len(ga & gb) / len(ga | gb) >= 0.55,
            "tfidf": bool(ta and tb) and sum(va[w] * vb.get(w, 0) for w in va) / norm(va) / norm(vb) >= 0.6, "minhash": bool((minhash.signature_of(sh(ta)) == minhash.signature_of(sh(tb))).mean() >= 0.7),
        }
        return out | {"cascade": any(out.values())}

    want = sorted((name, c, d, hit) for a, b, d, c in pairs for name, hit in layers(a, b).items())
    rows = spark.createDataFrame(pairs, "a string, b string, duplicate boolean, category string")
    assert sorted(map(tuple, dedup.judged(rows).collect())) == want
    assert sorted(map(tuple, dedup.judged(rows, ("tfidf",)).collect())) == [w for w in want if w[0] == "tfidf"]


def test_a_judge_gives_advice(spark):
    tasks = spark.createDataFrame([(i, f"mend gate {'abc' * i}", "done" if i == 3 else "pending", i) for i in range(1, 10)], "id long, description string, status string, created_at long")
    new = spark.createDataFrame([(1, "mend gate " + "abc" * 7), (2, "raise"), (3, "far"), (4, "silent"), (5, None), (6, "mend it")], "new_id long, description string")

    def judge(description, candidates):
        assert 0 < len(candidates) <= 5 and all(status == "pending" for _, status, _ in candidates)
        if description == "raise":
            raise RuntimeError("no answer")
        if description == "silent":
            return None
        return dedup.Verdict(99 if description == "far" else candidates[0][0] if "mend" in description else None, " same work " if "abc" in description else "")

    got = {r.new_id: (r.is_duplicate, r.id, r.reason, r.error) for r in dedup.asked(tasks, new, judge).collect()}
    assert got == {
        1: (True, 7, "same work (task #7)", None), 2: (False, None, "", "RuntimeError: no answer"), 3: (False, None, "", "task #99 is no candidate"), 4: (False, None, "", None), 5: (False, None, "", None),
        6: (True, 9, "semantically duplicates task #9", None),
    }
    none = dedup.asked(tasks.filter("status = 'done'"), new, judge)
    assert {(r.is_duplicate, r.reason, r.layer) for r in none.collect()} == {(False, "no active candidates", "llm")}


def test_config_records(spark):
    given = [{"llm": "other", "model": "a b", "model_dedup": "ok-1", "tmux_layout": "popup", "approval_watchdog": False, "step_model_by_verb": {"add": "m"}, "approval_patterns": ["x"]}, {"llm_classify": "claude", "tmux_layout": "round", "model_classify": "x;y", "auto_execute_small": True, "test_cmd": "make t"}]
    rows = spark.createDataFrame([(json.dumps(g),) for g in given] + [("[1]",), ("",), (None,)], "value string")
    got = [r.asDict() for r in L.config(rows).collect()]
    none = {"llm": "claude", "llm_classify": "", "llm_dedup": "", "model": "", "model_classify": "", "model_dedup": "", "test_cmd": "", "auto_execute_small": False, "tmux_layout": "split-h", "approval_watchdog": True, "approval_patterns": [], "step_model_by_verb": {}}
    assert got[2:] == [none] * 3
    assert got[0] == none | {"model_dedup": "ok-1", "tmux_layout": "popup", "approval_watchdog": False, "step_model_by_verb": {"add": "m"}, "approval_patterns": ["x"]}
    assert got[1] == none | {"llm_classify": "claude", "auto_execute_small": True, "test_cmd": "make t"}


def test_json_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "é \"q\"", ["a"], None), (2, "", [], 0.5)], "id long, `odd name` string, items array<string>, score double")
    L.json_lines(rows).coalesce(1).write.text(str(tmp_path / "out"))
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "out")).collect()) == [1, 2]
    assert sorted(map(tuple, spark.read.schema(rows.schema).json(str(tmp_path / "out")).collect()), key=repr) == sorted(map(tuple, rows.collect()), key=repr)
