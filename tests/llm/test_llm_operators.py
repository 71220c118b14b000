"""Each operator against brute force, over nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import chat_format, decontaminate, exact_dedup, frames, sharding, simhash, substring_dedup, toxicity, url_filter
from quarry.llm.components import components
from quarry.llm.fm_index import FMIndex, WaveletTree, suffix_order

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows_of(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# --- FM-index ---


def test_fm_index_matches_scanning():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 5, 400)
    assert suffix_order(np.append(text, 0)).tolist() == sorted(range(401), key=lambda i: np.append(text, 0)[i:].tolist())
    tree = WaveletTree(text, 6)
    for c in range(7):
        assert tree.rank(np.full(401, c), np.arange(401)).tolist() == [int((text[:i] == c).sum()) for i in range(401)]
    index = FMIndex(text, 6)
    for n in (1, 2, 5):
        asked = rng.integers(1, 7, (60, n))
        which, low, high = index.search(asked)
        found = defaultdict(list)
        for w, a, b in zip(which, low, high):
            found[int(w)] = sorted(index.locate(np.array([a]), np.array([b])).tolist())
        for k, p in enumerate(asked):
            assert found.get(k, []) == [i for i in range(401 - n) if (text[i : i + n] == p).all()]


def brute_contamination(text, items, window=10):
    w = ALNUM.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for name, t in items:
        i = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(i))
        grams = {tuple(i[k : k + n]) for k in range(len(i) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add("null" if name is None else str(name))
    return len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


ITEMS = [(1, "The of foo bar baz qux ni ki the of idiot foo"), (2, "a B C"), (3, None), (4, "..."), (10, "same same same same"), (2, "one"), (None, "é é é é")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 20])
def test_contamination(spark, odd, odd_rows, block_bytes):
    rows = [*odd_rows, (900, "x The of FOO bar baz, qux ni ki the of idiot foo y " * 2), (901, "foo foo foo"), (902, "a b")]
    shared = next(t for _, t in rows if t and t.count(" ") == 59)
    items = [*ITEMS, (77, " ".join(shared.split()[3:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_spans(docs, bench, block_bytes=block_bytes)
    got = Counter((r.doc_id, r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), len(r["items"]), sha(",".join(r["items"])), bool(r["spans"])) for r in found.collect())
    assert got == Counter((i, *brute_contamination(t, items)) for i, t in rows)


def test_contamination_query_columns_and_empty(spark, odd, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination(odd, bench).count() == odd.count()
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not decontaminate.contamination(odd, bench.limit(0)).filter("contaminated").count()


def test_decontaminate_cuts_spans_only(spark):
    item = "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"
    docs = spark.createDataFrame([(1, f"keep, {item.upper()}; this"), (2, item), (3, None), (4, "clean  text")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert out == {1: "keep, ; this", 3: None, 4: "clean  text"}


# --- exact dedup ---


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_duplicates(odd, odd_rows, empty, keep):
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[t or ""].append(i)
    want = Counter()
    for i, t in odd_rows:
        ids = [x for x in groups[t or ""] if x is not None]
        best = (max if keep == "max" else min)(ids) if ids else None
        want[(i, best, len(groups[t or ""]), i == best, sha(t or ""))] += 1
    assert rows_of(exact_dedup.exact_duplicates(odd, keep=keep, bits=1), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_drop_exact_duplicates_leaves_one_of_each_text(odd, odd_rows, empty):
    out = exact_dedup.drop_exact_duplicates(odd)
    assert out.columns == odd.columns
    assert Counter(r.text or "" for r in out.collect()) == Counter({t or "" for _, t in odd_rows})
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0


# --- substring dedup ---


def brute_substrings(rows, window):
    count = Counter()
    words = [WORD.findall(t or "") for _, t in rows]
    for w in words:
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    out = Counter()
    for (i, _), w in zip(rows, words):
        gone = {k + j for k in range(len(w) - window + 1) if count[tuple(w[k : k + window])] > 1 for j in range(window)}
        out[(i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    return out


@pytest.mark.parametrize("window,mer,sizes", [(35, 4, 1 << 20), (5, 2, 3000), (3, 3, 50_000)])
def test_substrings(spark, odd, odd_rows, window, mer, sizes):
    got = substring_dedup.dedup_substrings(odd, window=window, mer=mer, texts=window != 35, group_bytes=sizes, bucket_bytes=sizes)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(odd_rows, window)


def test_substrings_empty(empty):
    assert substring_dedup.dedup_substrings(empty).count() == 0


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    from quarry.llm.words import NON_SPACE, slices, split

    monkeypatch.setattr(substring_dedup, "rolled", lambda v, n: np.zeros(len(v) - n + 1, np.uint64))
    words = next(split(raw, offs, NON_SPACE) for _, _, raw, offs in slices(pa.array(["a b c d", "b c d e", "x y z"])))
    rep = substring_dedup.repeated_windows(words, np.zeros(3, bool), 3)
    assert np.flatnonzero(rep).tolist() == [1, 4]


# --- chat ---


CHATS = [(1, 0, "system", "be"), (1, 1, "user", "hi </turn>\n### user:\n"), (1, 2, "assistant", "\\### a: \\\\</turn>"), (2, 0, "user", None), (2, 1, None, "x"), (3, 1, "assistant", "first"), (3, 0, "user", "q"), (4, 0, "user", "t"), (4, 0, "user", "t"), (4, None, "tool", ":\n"), (None, 0, "we:\nird### ", "")]


def test_chat_round_trip(spark):
    turns = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumns({"segments": F.lit(1), "ts": F.lit(2)})
    convs = defaultdict(list)
    for c, t, r, x in CHATS:
        convs[c].append(((t is not None, t or 0), r or "", x or ""))
    out = {r.conv_id: r for r in chat_format.turn_digests(turns).collect()}
    assert set(out) == set(convs)
    for c, ts in convs.items():
        ts.sort()
        learned = "".join(x for _, r, x in ts if r == "assistant")
        assert out[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, x in ts)) and out[c].n_turns == len(ts)
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(learned), sha(learned))
    shown = {r.conv_id: r for r in chat_format.format_conversations(turns).collect()}
    assert shown[1].valid and shown[3].valid and shown[1].formatted == "".join(s.text for s in shown[1].segments)
    assert (shown[2].valid, shown[2].invalid_at) == (False, 1) and not shown[4].valid
    assert chat_format.turn_digests(turns.limit(0)).count() == 0


# --- sharding ---


def brute_bfd(sizes, capacity):
    room, out = [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, b) for b, r in enumerate(room) if r >= s]
        if fits:
            r, b = min(fits)
            room[b] -= s
        else:
            b = len(room)
            room.append(max(capacity, s) - s)
        out.append((s, b))
    return out


def test_pack_is_best_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(40):
        sizes = rng.integers(1, 60, rng.integers(1, 90)).tolist()
        runs = sharding.pack(list(Counter(sizes).items()), 80)
        assert [(s, b) for s, n, b in runs for _ in range(n)] == brute_bfd(sizes, 80)


def test_pack_evenly_is_near_even():
    rng = np.random.default_rng(2)
    sizes = Counter(rng.integers(1, 500, 4000).tolist())
    load = Counter()
    for s, n, b in sharding.pack_evenly(list(sizes.items()), 24):
        load[b] += s * n
    assert len(load) == 24 and max(load.values()) - min(load.values()) < 500


def test_balanced_tree():
    rng, tree, keys = np.random.default_rng(4), sharding.Remaining(), set()
    for _ in range(3000):
        k = (int(rng.integers(0, 300)), int(rng.integers(0, 40)))
        if k in keys:
            keys.remove(k)
            tree.remove(k)
        else:
            keys.add(k)
            tree.insert(k)
        need = int(rng.integers(0, 320))
        assert tree.tightest(need) == min((x for x in keys if x[0] >= need), default=None)


@pytest.mark.parametrize("options", [{"shards": 24}, {"shards": 3}, {"shards": None, "capacity": 5000}])
def test_shards(odd, odd_rows, empty, options):
    rows = sharding.shard(odd, **options).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    by_text, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        by_text[(r["size"], r.text_crc32)].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = Counter()
    for r in rows:
        groups[(r["size"], r.text_crc32)] += r["size"]
    sizes, packed = list(Counter(groups.values()).items()), Counter()
    for size, n, b in sharding.pack_evenly(sizes, options["shards"]) if options["shards"] else sharding.pack(sizes, options["capacity"]):
        packed[b] += size * n
    assert load == packed and set(load) <= set(range(options["shards"] or len(rows)))
    assert sharding.shard(empty, **options).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_are_broadcast(spark, monkeypatch, how):
    monkeypatch.setattr(frames, "HOT_KEYS", 5)
    rows = spark.createDataFrame([(i, 0 if i % 2 else i % 40) for i in range(400)], "i long, k long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), (F.col("k") * 3).alias("v")).filter("k <> 8")
    want = rows.join(table, ["k"], how)
    assert rows_of(frames.spread_join(rows, table, ["k"], how), "i", "k", "n", "v") == rows_of(want, "i", "k", "n", "v")


@pytest.mark.parametrize("limit", [100_000, 0])
def test_plan_of_many_runs(spark, monkeypatch, limit):
    monkeypatch.setattr(sharding, "PLAN_ROWS", limit)
    monkeypatch.setattr(sharding, "BLOCK_PLACES", 7)
    rows = sharding.shard(spark.createDataFrame([(i, "x" * (i % 9)) if i % 3 else (i, f"t{i}") for i in range(300)], "doc_id long, text string"), 4).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
    assert len(rows) == 300 and max(load.values()) - min(load.values()) < 20


# --- SimHash ---


def brute_fingerprint(text, size=4):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[k : k + size]).encode(), 42) for k in range(max(1, len(w) - size + 1))]
    bits = (np.array(h, np.uint64)[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    return sum(1 << b for b in range(64) if 2 * int(bits[:, b].sum()) > len(h))


def brute_components(values, near):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_near_duplicates(odd, odd_rows, empty):
    fps = [brute_fingerprint(t) for _, t in odd_rows]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {r: min((i for (i, _), q in zip(odd_rows, roots) if q == r and i is not None), default=None) for r in set(roots)}
    want = Counter((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(odd_rows, fps, roots))
    assert rows_of(simhash.near_duplicates(odd), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.drop_near_duplicates(odd, distance=4)
    assert kept.columns == odd.columns
    assert rows_of(kept, "doc_id") == Counter((i,) for (i, _), r in zip(odd_rows, roots) if i is None or least[r] == i)


@pytest.mark.parametrize("distance", [3, 4, 5])
def test_links_lose_none(spark, distance):
    rng = np.random.default_rng(distance)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    values = set(seeds.tolist())
    for s in seeds.tolist():
        for _ in range(40):
            v = s
            for b in rng.choice(64, rng.integers(1, 8), replace=False).tolist():
                v ^= 1 << b
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    got = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance)).collect()}
    roots = brute_components(values, lambda a, b: (a ^ b).bit_count() <= distance)
    assert brute_components(signed, lambda a, b: got.get(a, a) == got.get(b, b)) == brute_components(roots, lambda a, b: a == b)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (None, 3), (301, 300), (300, 301)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 300)}, 300: 300, 301: 300}


# --- URLs ---


URLS = ["https://www.Example.com/en/x?q#f", "http://a.example.com/en/1", "http://example.com/en", "http://b.net/es/", "http://b.net/fr/x", "http://b.org/es/", "nothing", None, "", "x://", "http://notexample.com/en/", "http://com/", "http://é.net/fr/ä?://z", "http://host.net" + "/a" * 5000]


def brute_url(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(LOWER)
    fits = [(len(h + p), k, h + p, v) for k, (h, p, v) in enumerate(url_filter.RULES) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best and best[3]


@pytest.fixture(scope="module")
def url_weights(spark):
    return url_filter.train(url_filter.labelled_urls(spark)).persist()


def test_url_rules(spark, url_weights):
    pages = spark.createDataFrame([*enumerate(URLS), (None, URLS[0])], "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit(2), "bucket": F.lit(3)})
    out = url_filter.with_verdicts(pages, url_weights)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    for r in out.collect():
        host, path, rule, verdict = brute_url(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1
    assert url_filter.with_verdicts(pages.limit(0), url_weights).count() == 0


def test_url_model_beats_chance(spark, url_weights):
    pages = spark.createDataFrame([(f"http://www.{n}.example.org/de/7", k) for k, ns in ((0, ("meadow", "painting", "sailing", "bakery", "cathedral", "thither")), (1, ("spam-farm", "cheap-pills", "casino-win", "free-bets", "poker-loan", "adult-ads"))) for n in ns], "url string, y int")
    got = url_filter.with_verdicts(pages, url_weights).collect()
    assert sum((r.score >= 0.5) == r.y for r in got) >= 10


def test_url_training_is_logistic_regression(spark):
    rows = [("http://a.com/x", 1), ("http://b.com/yy", 0), ("http://b.com/yy", 0), ("http://b.com/yy", 1), (None, 1), ("", 1), ("nothing", 0), ("http://long.net" + "/seg" * 300, 0)]
    table = spark.createDataFrame([*rows, ("http://c.com/", None)], "url string, blocked int")
    got = {r.bucket: r.weight for r in url_filter.train(table, buckets=64, rounds=25).collect()}
    grams = table.filter("blocked is not null").select("blocked", url_filter.ngrams(*url_filter.host_and_path(F.col("url")), buckets=64).alias("g")).collect()
    x, y = np.zeros((len(grams), 65)), np.array([r.blocked for r in grams], float)
    for k, r in enumerate(grams):
        np.add.at(x[k], [0, *(g + 1 for g in r.g)], 1)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = np.zeros(65)
    for _ in range(25):
        w = w + url_filter.RATE * x.T @ (y - 1 / (1 + np.exp(-x @ w)))
    assert np.allclose([got.get(b, 0.0) for b in range(-1, 64)], w)


def test_url_training_without_rows(spark):
    weights = url_filter.train(spark.createDataFrame([], "url string, blocked int"))
    assert weights.count() == 0
    assert url_filter.with_verdicts(spark.createDataFrame([(1, "http://b.org/")], "page_id long, url string"), weights).first().verdict == "block"


# --- toxicity ---


def test_toxicity(spark, odd, odd_rows, empty):
    rng = np.random.default_rng(0)
    plain = "the and of table chair river stone green".split()
    rows = [(i, " ".join(rng.choice(plain, 30)) + (" You IDIOT fool" if i % 4 == 0 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)] + [(None, 1), (3, None), (5, 0)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(docs, labels, max_rows=300).collect()}
    assert all(out[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert all(out[i].predicted == (i % 4 == 0) and 0 <= out[i].score <= 1 for i in out if out[i].held_out)
    kept = toxicity.drop_toxic(docs, labels, max_rows=300)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in range(600) if i % 4}
    few = toxicity.toxicity(odd, labels)
    assert few.count() == len(odd_rows) and few.filter("score is null").count() == 0
    assert {r.score for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(empty, labels).count() == 0


def brute_ftrl(rows, alpha, beta, l1, l2, rounds, bias):
    """Weights by bucket after learning (buckets, label) in order, one coordinate at a time."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        lasso = 0.0 if i == bias else l1
        if abs(z[i]) <= lasso:
            return 0.0
        return -(z[i] - (lasso if z[i] > 0 else -lasso)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(rounds):
        for buckets, label in rows:
            w = {i: weight(i) for i in [*buckets, bias]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for i in w:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


@pytest.mark.parametrize("max_rows", [1000, 20])
def test_training_is_ftrl_over_the_rows_allowed(spark, max_rows):
    rng, bits = np.random.default_rng(1), 10
    rows = [(i, " ".join(rng.choice("The red FOX; ran, over a-hill idiot".split(), int(rng.integers(0, 12))))) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int("idiot" in t)) for i, t in rows], "doc_id long, toxic int")
    options = {"alpha": 0.2, "beta": 1.0, "l1": 0.05, "l2": 0.1, "rounds": 2}
    got = {r.bucket: r.weight for r in toxicity.train(docs, labels, max_rows=max_rows, bits=bits, **options).collect()}

    def buckets(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return sorted(set(toxicity.features(toxicity.split(raw, np.array([0, len(raw)]), toxicity.ALPHANUMERIC, lower=True), bits)[1].tolist()))

    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id")).collect()][:max_rows]
    want = brute_ftrl([(buckets(rows[i][1]), int("idiot" in rows[i][1])) for i in order], **options, bias=1 << bits)
    assert got.keys() == want.keys() and len(want) > 5
    assert np.allclose([got[k] for k in want], list(want.values()))


def test_chat_query_runs_its_machine(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "c"), (3, 0, "user", "d"), (4, 0, "user", "e"), (4, 1, "user", "f"), (4, 2, "assistant", "g")], "conv_id long, turn long, role string, text string")
    out = chat_format.turn_digests(turns)
    assert {(r.conv_id, r.valid, r.invalid_at, r.loss_chars) for r in out.collect()} == {(1, True, None, 1), (2, False, 0, 1), (3, False, 1, 0), (4, False, 1, 1)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "start" in plan and "invalid" in plan


def test_identifiers_are_integers(spark):
    from quarry.llm import exact_dedup

    with pytest.raises(TypeError):
        exact_dedup.exact_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# --- runs of digests ---


def runs_of(rng, rows, keep):
    """(rows by text, a run of them): few texts, so that many meet; some ids are null."""
    texts = [bytes([k % 7]) * 32 if k % 3 else rng.bytes(32) for k in rng.integers(0, 40, rows).tolist()]
    ids = [None if k % 9 == 0 else int(k) for k in rng.integers(-50, 50, rows)]
    checks = [int(t[0]) - 3 + int(k) for t, k in zip(texts, rng.integers(0, 2, rows))]  # digests alike whose texts aren't
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(checks, pa.int64()), pa.array([t[1] for t in texts], pa.int64()), pa.array(ids, pa.int64())], ["digest", "check", "size", "id"])
    return [((t, c, t[1]), i) for t, c, i in zip(texts, checks, ids)], exact_dedup.sorted_run([batch.slice(0, rows // 2), batch.slice(rows // 2)], keep)


@pytest.mark.parametrize("keep", ["max", "min"])
def test_runs_are_merged_and_not_sorted(monkeypatch, keep):
    rng = np.random.default_rng(5)
    for k in (1, 2, 3, 8):
        parts = [runs_of(rng, int(n), keep) for n in rng.integers(0, 60, k)]
        for name in ("sort", "argsort", "lexsort", "unique"):
            monkeypatch.setattr(exact_dedup.np, name, None)
        run = exact_dedup.merged_all([r for _, r in parts], keep)
        monkeypatch.undo()
        want = {}
        for key, i in (x for rows, _ in parts for x in rows):
            want.setdefault(key, []).append(i)
        best = lambda ids: (max if keep == "max" else min)([i for i in ids if i is not None], default=None)
        raw = [bytes(x) for x in run.key.view(np.uint8).reshape(-1, 48)]
        got = {(x[:32], int.from_bytes(x[32:40], "big", signed=True), int.from_bytes(x[40:], "big")): (i if t else None, n) for x, i, t, n in zip(raw, run.id.tolist(), run.there.tolist(), run.many.tolist())}
        assert raw == sorted(raw) and len(set(raw)) == len(raw)
        assert got == {key: (best(ids), len(ids)) for key, ids in want.items()}


def test_rounds_send_each_key_home():
    rng = np.random.default_rng(6)
    nodes, held = 8, {n: [exact_dedup.sorted_run([pa.RecordBatch.from_arrays([pa.array([rng.bytes(32) for _ in range(30)]), *[pa.array(np.arange(30))] * 3], ["digest", "check", "size", "id"])], "max")] for n in range(8)}
    for bit in range(3):
        sent = {n: [] for n in range(nodes)}
        for n, runs in held.items():
            for b in exact_dedup._parted(n, exact_dedup.merged_all(runs, "max"), bit, 1, nodes):
                to = b.column(0)[0].as_py()
                assert to in (n, n ^ 1 << bit)
                sent[to].append(exact_dedup.unpacked(*(b.column(i)[0].as_buffer() for i in range(1, 5))))
        held = sent
    assert all((exact_dedup._home(r.key, nodes) == n).all() for n, runs in held.items() for r in runs) and sum(len(r.key) for runs in held.values() for r in runs) == 240


def test_many_benchmark_blocks_are_one_pass(spark):
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(words[(i * 7 + k) % 60] for k in range(12))) for i in range(50)]
    rows = [(i, " ".join(words[(i * 5 + k) % 60] for k in range(40))) for i in range(20)] + [(99, None)]
    found = decontaminate.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=60)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = Counter((r.doc_id, r["n_words"], sum(s["end"] - s["first"] for s in r["spans"]), len(r["items"]), sha(",".join(r["items"])), bool(r["spans"])) for r in found.collect())
    assert got == Counter((i, *brute_contamination(t, items)) for i, t in rows)


def test_url_model_on_hosts_it_has_not_seen(spark):
    """Hosts of words and additions that the labelled table has not in this form, half of them words it has not at all."""
    plain = "carpenter lagoon museumsworld rivertown bakery-online thstion ngtherble oakandash paintbox sailing-now weaver-24 villagelife thinghe gardeners dictionary".split()
    junk = "casino-royal best-casino24 cheappills4u pokerzone freeads spamfarm-go adults-only jackpotwin xxx-pics replica-bags loan-today paydayloan slots-room escort-city bonusbets".split()
    assert not {n for n in (*plain, *junk)} & {r.url.split("//")[1].split(".example")[0].removeprefix("www.").removeprefix("m.").removeprefix("blog.") for r in url_filter.labelled_urls(spark).collect()}
    rows = [(i, f"http://{front}{name}.{top}/{lang}/{i}", k) for k, names in ((0, plain), (1, junk)) for i, name in enumerate(names) for front in ("", "www.", "m.") for top in ("example.org", "site.org") for lang in ("de", "en")]
    weights = url_filter.train(url_filter.labelled_urls(spark))
    got = url_filter.with_verdicts(spark.createDataFrame(rows, "page_id long, url string, k int"), weights).collect()
    right = Counter((r.k, (r.verdict == "block") == (r.k == 1)) for r in got)
    assert all(r.rule is None for r in got) and min(right[k, True] / (right[k, True] + right[k, False]) for k in (0, 1)) >= 0.9


@pytest.mark.parametrize("bits", [1, 2, 5])
def test_exact_duplicates_over_many_nodes(odd, odd_rows, monkeypatch, bits):
    few = rows_of(exact_dedup.exact_duplicates(odd), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    monkeypatch.setattr(exact_dedup, "NODE_ROWS", 1)
    monkeypatch.setattr(exact_dedup, "RUN_ROWS", 3)
    odd.sparkSession.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert rows_of(exact_dedup.exact_duplicates(odd, bits=bits), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == few
    finally:
        odd.sparkSession.conf.set("spark.sql.shuffle.partitions", "4")
