"""Clustering against plain integers; the screening against exact distances."""

import hashlib
import math
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from quarry.llm import centroids


def plain(rows, clusters=16, rounds=3, dimensions=64, seed=1):
    kept = [(i, [math.floor(Fraction(float(x)) * 64) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cs = [v for _, v in order[:clusters]]
    if not cs:
        return Counter()
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda v: min(range(len(cs)), key=lambda k: (far(v, cs[k]), k))
    for _ in range(rounds):
        of = [near(v) for _, v in kept]
        for k in set(of):
            own = [v for (_, v), o in zip(kept, of) if o == k]
            cs[k] = [sum(x) // len(own) for x in zip(*own)]
    of = [near(v) for _, v in kept]
    d = [far(v, cs[k]) for (_, v), k in zip(kept, of)]
    fits = lambda x: x if x < 1 << 63 else None
    lost = lambda xs: None if any(x >= 1 << 63 for x in xs) else fits(sum(xs))
    return Counter((i, k, fits(x), lost([y for y, o in zip(d, of) if o == k]), lost(d), hashlib.sha256(",".join(map(str, cs[k])).encode()).hexdigest()) for (i, _), k, x in zip(kept, of, d))


def odd_vectors(dimensions=64):
    rng = np.random.default_rng(4)
    one = lambda: [float(np.float32(x)) for x in rng.normal(0, 2, dimensions)]
    rows = [(i, one()) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)] + [rows[5], rows[5], (None, one()), (None, None), (300, None), (301, []), (302, one()[:-1]), (303, [*one(), 1.0])]
    rows += [(304, [float("nan"), *one()[1:]]), (305, [float("-inf"), *one()[1:]]), (306, [None, *one()[1:]]), (307, [0.0] * dimensions), (308, [-0.0] * dimensions), (309, [1 / 128] * dimensions), (310, [-1 / 128] * dimensions)]
    return rows


CLASH = "vec_id long, embedding array<float>, cluster string, v string, distance string, place int, inertia long"


def clashing(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", 1, 2) for i, v in rows], CLASH)


@pytest.mark.parametrize("clusters", [1, 3, 16, 500])
def test_clusters(spark, clusters):
    rows = odd_vectors()
    got = centroids.cluster(clashing(spark, rows).repartition(3), clusters=clusters)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(map(tuple, got.collect())) == plain(rows, clusters)


def test_large_components(spark):
    rows = [*odd_vectors(4), (400, [3e38, -3e38, 1e20, 1e-40]), (401, [2.0**20, 2.0**30, -(2.0**40), 7.0]), (402, [1e9, 1e9, 1e9, 1e9]), (403, [1e9, 1e9, 1e9, 1e9 + 64])]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for clusters in (2, 300):
        assert Counter(map(tuple, centroids.cluster(clashing(spark, rows), clusters=clusters, dimensions=4).collect())) == plain(rows, clusters, dimensions=4)
    double = spark.createDataFrame([(1, [1e308, 1.0]), (2, [-1e308, 0.5]), (3, [0.25, 0.25])], "vec_id long, embedding array<double>")
    assert Counter(map(tuple, centroids.cluster(double, clusters=2, dimensions=2).collect())) == plain([(r.vec_id, r.embedding) for r in double.collect()], 2, dimensions=2)


def test_no_rows(spark):
    for rows in ([], [(None, [0.5] * 64)], [(1, None), (2, [1.0])]):
        got = centroids.cluster(clashing(spark, rows))
        assert got.count() == 0 and got.columns[-1] == "centroid_sha256"


def test_tables_and_sql(spark):
    path = "/root/testdata/sf0.001/embeddings.parquet"
    table = spark.read.parquet(path)
    got = Counter(map(tuple, centroids.cluster(table).collect()))
    assert got == plain([(r.vec_id, r.embedding) for r in table.collect()])
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{path}'")
    assert Counter(con.execute(centroids.ORACLE).fetchall()) == got


def test_intervals_hold_and_ties_go_to_the_lowest():
    rng = np.random.default_rng(9)
    for size in (3, 1000, centroids.SMALL):
        v, c = rng.integers(-size, size + 1, (400, 64)), rng.integers(-size, size + 1, (20, 64))
        c[7], c[11] = c[3], v[0]
        scores, width = centroids.intervals(v, c)
        exact = [[sum(b * b - 2 * a * b for a, b in zip(x, y)) for y in c.tolist()] for x in v.tolist()]
        for i in range(400):
            for j in range(20):
                assert abs(Fraction(exact[i][j]) - Fraction(float(scores[i, j]))) <= Fraction(float(width[i, j]))
        best, distance, unsure = centroids.nearest(v, c)
        far = [[sum((a - b) ** 2 for a, b in zip(x, y)) for y in c.tolist()] for x in v.tolist()]
        assert best.tolist() == [min(range(20), key=lambda k: (f[k], k)) for f in far] and distance.tolist() == [min(f) for f in far]
        assert unsure < 400 and 7 not in best


def test_limbs_add_up():
    for n in (0, 5, -5, 1 << 24, -(1 << 100) + 3, (1 << 134) - 1):
        assert sum(v << 24 * k for _, k, v in centroids.limbs([n])) == n
