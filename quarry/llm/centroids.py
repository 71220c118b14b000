"""Centroid clustering of integer vectors: float32 screening, exact where it can't tell.

Each round multiplies vectors and centroids as float32 matrices. A score |c|^2 - 2 v.c so computed lies within a proven
distance of the exact one, so centroids whose interval lies above another's upper end are out; where more than one is
left, their distances are computed anew with exact integers, and of equals the lowest number wins. Sums of a cluster's
components are exact as well: partitions add up integers, split into limbs where they are large, and Spark adds those.
Only centroids, and a count and sums for each, reach the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.frames import cut, whole_id

SCALE = 64
DIMENSIONS = 64
CLUSTERS = 16
ROUNDS = 3
#: Components up to this size are added, multiplied and squared as 64-bit integers, and are float32 numbers.
SMALL = 1 << 24
_LIMB = 24
_LONG = (1 << 63) - 1


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): 64-bit integers, or Python integers where any is over SMALL."""
    with np.errstate(over="ignore"):
        out = np.floor(values.astype(np.float64) * scale)
    if np.abs(out).max(initial=0) <= SMALL:
        return out.astype(np.int64)
    flat = [math.floor(Fraction(x) * scale) for x in values.astype(np.float64).ravel().tolist()]
    whole = np.empty(len(flat), object)
    whole[:] = flat
    return whole.reshape(values.shape)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that are paired."""
    d = a - b
    return (d * d).sum(axis=1)


def _floats(whole: np.ndarray) -> np.ndarray:
    """As float64; what that can't hold becomes infinite."""
    if whole.dtype != object:
        return whole.astype(np.float64)
    return np.array([float(x) if abs(x) < 1 << 1023 else math.inf for x in whole.ravel()]).reshape(whole.shape)


def intervals(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, half widths): the exact |c|^2 - 2 v.c lies within each score's half width.

    A float32 dot product of n terms, summed in any order and from rounded factors, is off by at most
    g * sum |v_i c_i| <= g * |v| |c| with g = (n + 2) u / (1 - (n + 2) u), u = 2^-24. Forming the score adds a rounding
    of |c|^2 and one of the difference. Widths are computed in float64, with a margin over its own rounding. Values that
    float32 can't hold give widths that aren't finite, which excludes nothing."""
    with np.errstate(all="ignore"):
        v, c = _floats(vectors), _floats(centroids)
        u = 2.0**-24
        k = (vectors.shape[1] + 2) * u
        g = k / (1 - k)
        norms = (c * c).sum(axis=1)
        dots = v.astype(np.float32) @ c.astype(np.float32).T
        scores = norms.astype(np.float32) - np.float32(2) * dots
        size = np.sqrt((v * v).sum(axis=1))[:, None] * np.sqrt(norms)
        width = 1.001 * (2 * g * size + 4 * u * (norms + 2 * size)) + 1e-30
    return scores.astype(np.float64), np.where(np.isfinite(width) & np.isfinite(scores), width, np.inf)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, exact squared distance, vectors that needed exact comparisons)."""
    scores, width = intervals(vectors, centroids)
    open_ = ~np.isfinite(width)
    low, high = np.where(open_, -np.inf, scores - width), np.where(open_, np.inf, scores + width)
    left = low <= high.min(axis=1, keepdims=True)
    best = left.argmax(axis=1)
    unsure = np.flatnonzero(left.sum(axis=1) > 1)
    if len(unsure):
        row, which = np.nonzero(left[unsure])
        exact = _squares(vectors[unsure[row]], centroids[which])
        first = np.searchsorted(row, np.arange(len(unsure)))
        least = np.minimum.reduceat(exact, first)
        hit = np.flatnonzero(exact == least[row])
        _, lowest = np.unique(row[hit], return_index=True)
        best[unsure] = which[hit[lowest]]
    return best, _squares(vectors, centroids[best]), len(unsure)


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    """The rows of a list column, which all have so many numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dimensions)


def limbs(sums: list[int]) -> Iterator[tuple[int, int, int]]:
    """(place, limb, value) of integers in signed digits; the digits of one limb may be added up."""
    for place, value in enumerate(sums):
        sign, left, limb = (-1 if value < 0 else 1), abs(value), 0
        while left:
            yield place, limb, sign * (left & ((1 << _LIMB) - 1))
            left >>= _LIMB
            limb += 1


def _add_up(centroids: np.ndarray, dimensions: int, scale: int):
    """Each batch's rows (cluster, place, limb, value): sums of components; place -1 holds the number of vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            if not len(batch):
                continue
            vectors = scaled(_vectors(batch.column(1), dimensions), scale)
            best, _, _ = nearest(vectors, centroids)
            for k in np.unique(best).tolist():
                own = vectors[best == k]
                have = total.setdefault(k, [0] * (dimensions + 1))
                for i, s in enumerate(own.sum(axis=0).tolist()):
                    have[i] += s
                have[dimensions] += len(own)
        rows = [(k, place, limb, value) for k, sums in total.items() for place, limb, value in limbs(sums)]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "place", "limb", "value"])

    return run


def kept(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int) -> DataFrame:
    """(vec_id, v): the rows whose vector has so many components, none null, NaN or infinite."""
    rows = vectors.select(whole_id(vectors, id_col).alias("vec_id"), F.col(vector_col).alias("v")).filter(F.size("v") == dimensions)
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))))
    return rows if vectors.schema[vector_col].dataType.simpleString() in ("array<float>", "array<double>") else rows.withColumn("v", F.col("v").cast("array<double>"))


def _updated(sums: DataFrame, centroids: np.ndarray, dimensions: int) -> np.ndarray:
    """Centroids replaced by floor(sum / count). The driver gets one number a limb of each component of a centroid."""
    found: dict[int, list[int]] = {}
    for k, place, limb, value in sums.groupBy("cluster", "place", "limb").agg(F.sum("value")).collect():
        found.setdefault(k, [0] * (dimensions + 1))[place] += value << _LIMB * limb
    rows = centroids.tolist()
    for k, own in found.items():
        rows[k] = [s // own[dimensions] for s in own[:dimensions]]
    return _matrix(rows)


def _matrix(rows: list[list[int]]) -> np.ndarray:
    out = np.empty((len(rows), len(rows[0]) if rows else 0), object)
    for i, r in enumerate(rows):
        out[i, :] = r
    return out.astype(np.int64) if all(abs(x) <= SMALL for r in rows for x in r) else out


def seeds(rows: DataFrame, clusters: int, seed: int, scale: int) -> np.ndarray:
    """The vectors whose ids' hashes are the smallest, in that order; rows with null ids are none, ties go by components."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = rows.filter("vec_id is not null").orderBy(name, "v").limit(clusters).collect()
    return _matrix([scaled(np.array(r.v, np.float64), scale).tolist() for r in chosen])


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = 1, scale: int = SCALE) -> DataFrame:
    """One row per kept row of vectors: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of so many components, none null, NaN or infinite; each component x becomes floor(scale * x).
    Centroids begin as the vectors of the ids with the smallest SHA-256 of `seed:id`; fewer ids give fewer centroids.
    Each round assigns all vectors to the nearest centroid, of equals the lowest, and replaces each centroid that has
    vectors by their componentwise floor(sum / count); then vectors are assigned once more. Repeated rows are vectors of
    their own. Null ids are clustered but are no first centroids; without any other id there are no rows. A distance or
    inertia beyond a long is null. Other columns are ignored; no rows give no rows.
    """
    rows = kept(vectors, id_col, vector_col, dimensions)
    centroids = seeds(rows, clusters, seed, scale)
    out = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return rows.limit(0).selectExpr("vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    for _ in range(rounds):
        centroids = _updated(rows.mapInArrow(_add_up(centroids, dimensions, scale), "cluster int, place int, limb int, value long"), centroids, dimensions)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                best, distance, _ = nearest(scaled(_vectors(batch.column(1), dimensions), scale), centroids)
                far = pa.array(distance) if distance.dtype != object else pa.array([int(d) if d <= _LONG else None for d in distance], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best.astype(np.int32)), far], ["vec_id", "cluster", "distance"])

    assigned = cut(rows.mapInArrow(assign, out))
    beyond = F.max(F.col("distance").isNull())
    sums = [(k, None if lost else int(s)) for k, s, lost in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")), beyond).collect()]
    whole = sum(s for _, s in sums) if all(s is not None for _, s in sums) else None
    fits = lambda s: s if s is not None and s <= _LONG else None
    digest = lambda k: hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()
    table = vectors.sparkSession.createDataFrame([(k, fits(s), fits(whole), digest(k)) for k, s in sums], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    far = "list_sum(list_transform(range(1, 65), lambda i: (e[i] - c[i]) * (e[i] - c[i])))"
    near = lambda r: f"a{r} as materialized (select vec_id, e, arg_min(k, (d, k)) as k, min(d) as d from (select n, vec_id, e, k, cast({far} as bigint) as d from v, c{r}) group by n, vec_id, e)"
    mean = lambda r: f"""m{r} as (select k, list((s - (((s % n) + n) % n)) // n order by i) as c from
 (select k, i, sum(e[i])::bigint as s, count(*) as n from a{r}, range(1, 65) t(i) group by k, i) group by k),
c{r + 1} as materialized (select c{r}.k, coalesce(m{r}.c, c{r}.c) as c from c{r} left join m{r} using (k))"""  # noqa: E731
    steps = ",\n".join(x for r in range(ROUNDS) for x in (near(r), mean(r)))
    return f"""
with v as materialized (select row_number() over () as n, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
 where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as materialized (select row_number() over (order by sha256('1:' || vec_id)) - 1 as k, e as c from v where vec_id is not null qualify k < 16),
{steps},
{near(ROUNDS)}
select vec_id, cast(a.k as integer) as cluster, d as distance, cast(sum(d) over (partition by a.k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
 sha256(array_to_string(c, ',')) as centroid_sha256
from a{ROUNDS} a join c{ROUNDS} c on a.k = c.k
"""


ORACLE = _sql()
