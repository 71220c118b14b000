import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import minhash, parsing, text
from quarry.operators import dedup, index, lifecycle


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()[0] if values else spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("s,n", [("mend the gate", 3), ("", 0), ("to mend a gate", 2), ("Fix THE é bug, now-ish: x1y2 v2", 6)])
def test_token_counts(spark, s, n):
    assert len(one(spark, text.tokens(F.lit(s)))) == n


def test_kelvin_sign_is_no_k(spark):
    assert one(spark, text.tokens(F.lit("Kelvin abc"))) == ["elvin", "abc"]


def grams(s):
    low = "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in s)
    flat = " ".join(low.split())
    return {f" {flat} "[i : i + 3] for i in range(len(flat))} if flat else set()


def test_similarities(spark):
    pairs = [("mend gate", "then mend the old gate by the barn"), ("sand oak floor", "sand oaken floor"), ("mend gate", "zip fox"), ("", "x"), ("?!", "?!"), ("Wet Paint", "wet paint")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: r for r in rows.select("i", text.token_overlap(text.tokens(F.col("a")), text.tokens(F.col("b"))).alias("k"), text.char_ngrams(F.col("a")).alias("ga"), text.jaccard(text.char_ngrams(F.col("a")), text.char_ngrams(F.col("b"))).alias("t"), minhash.similarity(minhash.signature(text.shingles(text.tokens(F.col("a")))), minhash.signature(text.shingles(text.tokens(F.col("b"))))).alias("m")).collect()}
    for i, (a, b) in enumerate(pairs):
        ga, gb = grams(a), grams(b)
        assert set(got[i].ga) == ga and got[i].t == pytest.approx(len(ga & gb) / len(ga | gb) if ga and gb else 0)
    assert got[0].k == 1 and got[1].t == pytest.approx(12 / 18) and got[2].t <= 0.25
    assert got[3].k == 0 and got[4].m == 1.0 and got[5].m == 1.0


def test_minhash_constants():
    a, b = minhash.permutations()
    assert (int(a[0]), int(b[0])) == (3236661110929538049, 12285948757477592399)
    assert int(minhash.fnv1a(["add login"])[0]) == 16494343498898286753
    assert int(minhash.signature_of(["add login", "login endpoint"])[0]) == 4000091827505230026


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=6))
def test_fnv_wraps_like_integers(strings):
    def plain(s):
        h = minhash.FNV_START
        for b in s.encode():
            h = (h ^ b) * minhash.FNV_PRIME % (1 << 64)
        return h

    assert minhash.fnv1a(strings).tolist() == [plain(s) for s in strings]


def test_bands_are_lossless():
    for size, limit in ((64, 0.7), (64, 0.55), (16, 0.9)):
        need = math.ceil(limit * size - 1e-9)
        bands = size - need + 1
        assert bands > size - need


@pytest.mark.parametrize("value,want", [("0.9", 0.9), ("not-a-number", 0.8), ("2.5", 0.8), ("0", 0.8), (None, 0.8), ("1", 1.0)])
def test_threshold_settings(value, want):
    assert dedup.threshold(value, 0.8) == want


@pytest.mark.parametrize("line,words", [("a 'b c' \"d\\\"e\" f\\ g", ["a", "b c", 'd"e', "f g"]), ("x ''", ["x"]), ("a 'b", None), ("", []), ("x\\", ["x"]), ("a\tb\nc", ["a", "b", "c"])])
def test_shell_words(line, words):
    assert parsing.shell_words(line) == words


@pytest.mark.parametrize("said,want", [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": 1}\n```', '{"a": 1}'), ('x {"a": {"b": 2}} y', '{"a": {"b": 2}}'), ("no", ""), ("", ""), ('{bad} {"c": 3}', '{"c": 3}'), (None, "")])
def test_first_object(said, want):
    assert parsing.first_object(said) == want


def test_scalars(spark):
    assert one(spark, text.task_name(F.lit("Add the new Login-Endpoint to API, please do it now"))) == "loginendpoint-api-please-now"
    assert one(spark, text.task_name(F.lit("add the"))) == "add-the"
    assert one(spark, text.result_summary(F.lit("\n---\n## Done: it\nmore"))) == "Done: it"
    assert one(spark, text.one_line(F.lit(" a\n\tb   c "), 5)) == "a b c"
    assert one(spark, text.one_line(F.lit("abcdefgh"), 5)) == "abcde…"
    assert [one(spark, text.short_tokens(F.lit(n))) for n in (999, 1250, 5550, 12_000, 1_500_000)] == ["999", f"{1.25:.1f}k", f"{5.55:.1f}k", "12k", "1.5M"]
    assert [one(spark, text.short_age(F.lit(n))) for n in (59, 60, 7200, 200_000)] == ["59s", "1m", "2h", "2d"]
    assert one(spark, text.step_line(F.lit(""), F.lit("modify"), F.lit("a.go"), F.array(F.lit("Foo"), F.lit("Bar")), F.lit("works"))) == "Modify a.go (Foo, Bar) — works"
    assert [one(spark, text.task_id(F.lit(s))) for s in ("12", "0x", "", "007")] == [12, None, None, 7]
    assert one(spark, text.is_identifier(F.lit("ab\n"))) is False
    assert one(spark, text.symbol_id(F.lit("main.go"), F.lit("main"), F.lit("function"), F.lit("func main()"))) == "9cd7fe80f4cc303cb39fd16d"
    assert one(spark, text.match_query(text.tokens(F.lit("foo the bar")))) == '"foo" OR "the" OR "bar"'


@pytest.mark.parametrize("path,want", [("main.go", "go"), ("app.ts", "typescript"), ("app.tsx", "typescript"), ("index.js", "javascript"), ("script.py", "python"), ("README.md", ""), ("data.json", ""), ("Makefile", ""), ("main.rs", "rust"), ("App.kt", "kotlin"), ("a/package.json", "json"), ("x/Dockerfile.prod", "dockerfile")])
def test_languages(spark, path, want):
    assert one(spark, index.language(F.lit(path))) == want


def test_ignore_patterns(spark):
    hit = lambda p, pats, d=False: one(spark, index.ignored(F.lit(p), pats, d))
    assert hit("node_modules/dep.js", ["node_modules"]) and not hit("src/app.ts", ["node_modules"])
    assert hit("a/build/x.go", ["build/"]) and not hit("a/build", ["build/"]) and hit("a/build", ["build/"], True)
    assert hit("x/y.log", ["*.log"]) and not hit("x/y.log", ["x*log"]) and hit("x/y.log", ["x/*.log"]) and hit("b.c", ["[a-c].c"]) and not hit("d.c", ["[a-c].c"])


def test_freshness_plans():
    assert index.freshness(False, True, None, None) == "full" and index.freshness(False, False, None, None) == "incremental"
    assert index.freshness(True, False, "a", "a") == "dirty" and index.freshness(True, False, "b", "") == "full"
    assert index.freshness(True, False, "b", "a") == "changed" and index.freshness(True, False, "b", "a", False) == "full"


def test_approval_patterns(spark):
    hit = lambda s, p=None: one(spark, lifecycle.wants_approval(F.lit(s), p))
    assert hit("Do you want to proceed?") and hit("overwrite (y/N): ") and hit("press enter to continue") and not hit("we proceed (y/n) later")
    assert hit("go ahead", ["go", "["]) and not hit("Do you want to proceed?", ["nothing"])
    assert lifecycle.invalid_patterns(["a", "[", "(b"]) == ["[", "(b"]


def test_batches_of_texts_equal_single_values(monkeypatch):
    """Signatures and trigrams of whole texts, in slices of a few bytes, as those of plain sets."""
    import re

    import pyarrow as pa

    from quarry.functions import scan

    monkeypatch.setattr(scan, "SLICE_BYTES", 40)
    rng = random.Random(3)
    words = ["Add", "x", "log-in", "ab", "Énd", "o'clock", "K2K9z", "...", "abcdefghijklmnop", "İstanbul", "42", "0000"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(200)] + [None, "", "?!", "a", "abc", "abc def", " abc ", "tail"]
    texts += ["mend the gate " * 30, "", "x"]
    codes, bounds = scan.trigrams_of(pa.array(texts))
    got = scan.signatures_of(pa.array(texts))
    assert len(got) == len(texts) == len(bounds) - 1
    for k, t in enumerate(texts):
        low = "".join(c.lower() if c.isascii() else c for c in t or "")
        want = {(ord(g[0]) << 16) | (ord(g[1]) << 8) | ord(g[2]) for g in grams(t or "")}
        own = codes[bounds[k] : bounds[k + 1]].tolist()
        assert len(own) == len(set(own)) and set(own) == want
        w = re.findall("[a-z0-9]{3,}", low)
        assert (got[k] == minhash.signature_of(list({f"{a} {b}" for a, b in zip(w, w[1:])} if len(w) > 1 else set(w)))).all()
    assert len(scan.signatures_of(pa.array([], pa.string()))) == 0


def test_tokens_of_letters_beyond_ascii(spark):
    rows = spark.createDataFrame([("K2K9z ABCd İstanbul x-y",), (None,)], "s string")
    assert [r[0] for r in rows.select(text.tokens(F.col("s"))).collect()] == [["abcd", "stanbul"], []]
