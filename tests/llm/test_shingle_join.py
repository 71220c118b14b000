"""The pipeline's near-dedup against all pairs by exact Jaccard similarity of five-word shingles."""

import random
from collections import Counter

import corpus_pipeline
from quarry.llm import shingle_join, simhash
from tests.llm.test_llm_operators import LOWER, WORD, brute_components


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def kept(rows):
    roots = brute_components([shingles(t) for _, t in rows], similar)
    least = {r: min((i for (i, _), q in zip(rows, roots) if q == r and i is not None), default=None) for r in set(roots)}
    return Counter((i,) for (i, _), r in zip(rows, roots) if i is None or least[r] == i)


def test_stage_finds_all_pairs(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    line = rng.sample(words, 30)
    rows = []
    for size in (6, 30, 100, 300, 2000):
        for _ in range(4):
            base = rng.sample(words, size)
            rows.append((len(rows), " ".join(base + line)))
            for _ in range(8):
                copy = list(base)
                for at in rng.sample(range(size), rng.randint(1, max(1, size // 30))):
                    copy[at] = rng.choice(words)
                rows.append((len(rows), " ".join(copy + line)))
    sets = [shingles(t) for _, t in rows]
    assert sum(similar(a, b) for k, a in enumerate(sets) for b in sets[:k]) > 100
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter((r.doc_id,) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == kept(rows)


def test_large_group(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(60), rng.randint(1, 3)):
            copy[at] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter((r.doc_id,) for r in shingle_join.drop_near_copies(docs).select("doc_id").collect()) == kept(rows)


def test_odd_rows(odd, odd_rows, empty):
    out = shingle_join.drop_near_copies(odd)
    assert out.columns == odd.columns
    assert Counter((r.doc_id,) for r in out.select("doc_id").collect()) == kept(odd_rows)
    assert shingle_join.drop_near_copies(empty).count() == 0


def test_simhash_links_first(spark, monkeypatch):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(6):
        base = rng.sample(words, 400)
        for _ in range(5):
            copy = list(base)
            copy[rng.randrange(400)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen, verified, real, real_verified = [], [], simhash.links, shingle_join._verified
    monkeypatch.setattr(simhash, "links", lambda *a: seen.append(a[1]) or real(*a))
    monkeypatch.setattr(shingle_join, "_verified", lambda *a: verified.append(real_verified(*a)) or verified[-1])
    assert Counter((r.doc_id,) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == kept(rows)
    assert seen == [shingle_join.DISTANCE]
    assert verified[0].count() >= 12  # of 24 links that connect the copies


def test_components_are_found_once(spark, monkeypatch):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for _ in range(5):
        base = rng.sample(words, 200)
        for _ in range(4):
            copy = list(base)
            copy[rng.randrange(200)] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, real = [], shingle_join.components
    monkeypatch.setattr(shingle_join, "components", lambda links: found.append(links) or real(links))
    assert Counter((r.doc_id,) for r in shingle_join.drop_near_copies(docs).select("doc_id").collect()) == kept(rows)
    assert len(found) == 1  # no group is large, so nothing is linked after


def test_leaders_are_connected(spark):
    rng = random.Random(12)
    pairs = [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(45)]
    got = {r.node: r.root for r in shingle_join._leaders(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got.keys() == {x for p in pairs for x in p}
    near = {a: {a} | {v for u, v in pairs if u == a} | {u for u, v in pairs if v == a} for a in got}
    assert all(root == min(near[node]) for node, root in got.items())


def test_links_of_large_groups_join_components(spark, monkeypatch):
    rng = random.Random(13)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(60), rng.randint(1, 3)):
            copy[at] = f"x{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found, real = [], shingle_join.components
    monkeypatch.setattr(shingle_join, "NEAR", 1)
    monkeypatch.setattr(shingle_join, "components", lambda links: found.append(links) or real(links))
    assert Counter((r.doc_id,) for r in shingle_join.drop_near_copies(docs).select("doc_id").collect()) == kept(rows)
    assert len(found) == 2
