"""Centroid clustering by Exponion search: exact Lloyd rounds whose vectors look only at the centroids near their own.

A vector keeps an upper bound of the distance to its centroid and a lower bound of the distance to all others. While the
bounds are apart, or the upper one is below half the gap to the nearest other centroid, nothing is computed for it.
Otherwise it scans the centroids inside a ball around its current centroid, of radius twice its distance plus that gap,
along a list of the other centroids in order of their distance; the ball holds its nearest and second nearest centroid.
The radius is inclusive and bounds carry a margin for rounding, so ties go to the smaller number as in a full scan.

Vectors are integers, and all that decides a result is computed exactly. A round is two jobs: one rewrites the table of
vectors with cluster and bounds and no shuffle, the other adds up components by cluster, a row a task and cluster, so the
shuffle has clusters x tasks rows. Only centroids (k x components) come to the driver and go to the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.shared import dropped, written

SCALE = 1024
EXACT = 1 << 20  # below this size of component, squared distances of up to 2,048 components are whole numbers of doubles
MARGIN = 1e-9  # by which bounds are loosened; far above the rounding of a root of a whole number
LONGEST = (1 << 63) - 1
SLICE = 1 << 14  # vectors at a time
LIMB = 40  # bits of a part of a sum; parts are added up as longs by up to eight million tasks

STATE = "vec_id long, v array<double>, cluster int, upper double, lower double, distance long"


def _whole(x: np.ndarray) -> np.ndarray:
    """Whole numbers as Python integers."""
    return np.array([int(y) for y in x.ravel()], dtype=object).reshape(x.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of whole numbers; an object array of Python integers where doubles aren't enough."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) < EXACT and a.shape[-1] <= 2048:
        d = a - b
        return np.einsum("ij,ij->i", d, d)
    d = _whole(a) - _whole(b)
    return (d * d).sum(axis=1)


def _root(d: np.ndarray) -> np.ndarray:
    if d.dtype == object:
        d = np.array([float(x) if int(x).bit_length() < 1000 else np.inf for x in d])
    return np.sqrt(d)


def _matrix(centroids: Sequence[Sequence[int]]) -> np.ndarray:
    """Centroids as doubles, or as Python integers where one is too large for exact work in doubles."""
    c = np.array(centroids, dtype=object)
    return c.astype(float) if np.abs(c).max(initial=0) < EXACT else c


class Ball:
    """Centroids with, for each, the others in order of distance: the lists along which a vector's ball is scanned."""

    def __init__(self, centroids: Sequence[Sequence[int]]):
        self.c = _matrix(centroids)
        k = len(self.c)
        between = np.array([_root(squared(self.c, np.broadcast_to(row, self.c.shape))) for row in self.c]).reshape(k, k)
        np.fill_diagonal(between, -1.0)
        self.order = np.argsort(between, axis=1, kind="stable")[:, 1:]
        self.far = np.take_along_axis(between, self.order, axis=1)
        self.gap = self.far[:, 0] if k > 1 else np.full(1, np.inf)

    def assigned(self, v: np.ndarray, a: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """New (cluster, upper, lower) of vectors, and how many distances to other centroids were computed."""
        a, upper, lower, scanned = a.copy(), upper.copy(), lower.copy(), 0
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.gap[a] / 2) * (1 - MARGIN))
        own = squared(v[open_], self.c[a[open_]])
        upper[open_] = _root(own) * (1 + MARGIN)
        still = upper[open_] >= np.maximum(lower[open_], self.gap[a[open_]] / 2) * (1 - MARGIN)
        open_, own = open_[still], own[still]
        before = a[open_]
        for j in np.unique(before):
            at = np.flatnonzero(before == j)
            rows, best, number = open_[at], own[at], np.full(len(at), j)
            radius = (2 * upper[rows] + self.gap[j]) * (1 + MARGIN)
            reach = np.searchsorted(self.far[j], radius, side="right")
            # No centroid outside the ball is nearer than this.
            with np.errstate(invalid="ignore"):
                second = np.where(reach < len(self.far[j]), radius - upper[rows], np.inf)
            longest_first = np.argsort(-reach, kind="stable")
            for place, other in enumerate(self.order[j]):
                inside = longest_first[: np.searchsorted(-reach[longest_first], -place, side="left")]
                if not len(inside):
                    break
                scanned += len(inside)
                d = squared(v[rows[inside]], np.broadcast_to(self.c[other], (len(inside), v.shape[1])))
                nearer = (d < best[inside]) | ((d == best[inside]) & (other < number[inside]))
                second[inside] = np.minimum(second[inside], _root(np.where(nearer, best[inside], d)))
                best[inside] = np.where(nearer, d, best[inside])
                number[inside] = np.where(nearer, other, number[inside])
            # Radius and bound may both be infinite; nothing is known of the second then.
            a[rows], upper[rows], lower[rows] = number, _root(best) * (1 + MARGIN), np.nan_to_num(second, nan=0.0, posinf=np.inf) * (1 - MARGIN)
        return a, upper, lower, scanned


def drifts(old: Sequence[Sequence[int]], new: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid went, and the farthest that any other one went."""
    own = _root(squared(_matrix(old), _matrix(new))) * (1 + MARGIN)
    others = np.array([np.delete(own, j).max(initial=0.0) for j in range(len(own))])
    return own, others


def integral(col: str, size: int) -> tuple[Column, Column]:
    """(whether a vector is kept, its components as whole numbers): exactly `size` components, none null or not finite."""
    x = F.col(col)
    bad = lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))
    # size() of a null array is -1 or null by a setting, and exists() may be null: neither counts as kept.
    kept = F.coalesce((F.size(x) == size) & ~F.exists(x, bad), F.lit(False))
    # rint keeps a double a double; floor() would make a long of it, which huge values don't fit.
    scaled = lambda e: e.cast("double") * float(SCALE)
    down = lambda e: F.rint(scaled(e)) - F.when(F.rint(scaled(e)) > scaled(e), F.lit(1.0)).otherwise(F.lit(0.0))
    return kept, F.transform(x, lambda e: down(e) + F.lit(0.0))


def _pass(state: DataFrame, centroids: list, moved: tuple | None, last: bool) -> DataFrame:
    """state assigned to centroids; its bounds first give way by what centroids moved since they were taken."""
    names = state.columns

    def run(batches):
        ball = Ball(centroids)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                v = np.asarray(part.column(1).flatten()).reshape(part.num_rows, -1)
                a, upper, lower = (np.asarray(part.column(i)) for i in (2, 3, 4))
                if moved is not None:
                    upper, lower = upper + moved[0][a], np.maximum(np.nan_to_num(lower - moved[1][a], nan=0.0, posinf=np.inf), 0.0)
                a, upper, lower, _ = ball.assigned(v, a.astype(int), upper, lower)
                distance = part.column(5)
                if last:
                    distance = pa.array([min(int(d), LONGEST) for d in squared(v, ball.c[a])], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(a, pa.int32()), pa.array(upper), pa.array(lower), distance], names=names)

    return state.mapInArrow(run, state.schema)


def _limbs(x: int) -> list[int]:
    """Signed parts of a whole number, lowest first, one at least."""
    sign, x, out = (-1 if x < 0 else 1), abs(x), []
    while x or not out:
        out.append(sign * (x & ((1 << LIMB) - 1)))
        x >>= LIMB
    return out


def _sums(state: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, exact sums of their components)."""

    def run(batches):
        totals: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            if batch.num_rows:
                v = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                a = np.asarray(batch.column(1))
                small = np.abs(v).max(initial=0) < EXACT
                for j in np.unique(a):
                    rows = v[a == j]
                    n, held = totals.get(j, (0, 0))
                    totals[j] = (n + len(rows), held + (_whole(rows.sum(axis=0)) if small else _whole(rows).sum(axis=0)))
        for j, (n, held) in totals.items():
            parts = [(j, place, limb, n, x) for place, total in enumerate(held) for limb, x in enumerate(_limbs(total))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*parts)], names=["cluster", "place", "limb", "n", "total"])

    parts = state.select("v", "cluster").mapInArrow(run, "cluster long, place long, limb long, n long, total long")
    out: dict[int, tuple[int, list[int]]] = {}
    # k x components rows, whatever the table: the centroids themselves.
    for r in parts.groupBy("cluster", "place", "limb").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("cluster", "place", "limb").collect():
        n, held = out.setdefault(r["cluster"], (r["n"], []))
        if r["limb"] == 0:
            held.append(0)
        held[-1] += r["total"] << (LIMB * r["limb"])
    return out


def first_centroids(vectors: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The k vectors of least sha256(`salt:vec_id`), in that order; equal ids follow in the order of their components."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return [[int(x) for x in r["v"]] for r in vectors.select(digest.alias("h"), "v").orderBy("h", "v").limit(k).collect()]


def clustered(rows: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, salt: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(table of vec_id, v, cluster, distance; centroids) after `rounds` rounds and a last assignment.

    Vectors with other than `size` components, or with a null or non-finite one, are left out. With fewer vectors than k
    there are as many centroids as vectors. Repeated rows are vectors of their own, null ids are kept and seeded like an
    empty one, other columns are ignored. Of an empty table the result is empty and there are no centroids. Components
    that are too large for exact doubles are worked on as Python integers; a distance beyond a long is the greatest long.
    """
    kept, whole = integral(vector_col, size)
    base = rows.where(kept).select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("v"))
    # Without a bound yet, every vector scans the ball around centroid 0.
    start = base.select("vec_id", "v", F.lit(0).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(None).cast("long").alias("distance"))
    start = start.to(T.StructType.fromDDL(STATE))
    state = written(start, "vectors")
    centroids = first_centroids(state, k, salt)
    if not centroids:
        return state.select("vec_id", "v", "cluster", "distance"), []
    moved = None
    for turn in range(rounds + 1):
        last = turn == rounds
        after = written(_pass(state, centroids, moved, last), "vectors")
        dropped(state)
        state = after
        if not last:
            sums = _sums(state)
            new = [[x // sums[j][0] for x in sums[j][1]] if j in sums else row for j, row in enumerate(centroids)]
            moved, centroids = drifts(centroids, new), new
    return state.select("vec_id", "v", "cluster", "distance"), centroids


def centroid_digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster_report(embeddings: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector, with the registered settings.

    A distance or inertia beyond a long is the greatest long.
    """
    found, centroids = clustered(embeddings)
    spark = embeddings.sparkSession
    # One row a cluster, k at most.
    inertia = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()} if centroids else {}
    total = min(sum(inertia.values()), LONGEST)
    rows = [(j, min(inertia.get(j, 0), LONGEST), total, centroid_digest(c)) for j, c in enumerate(centroids)]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 8, rounds: int = 10) -> str:
    """The report's rows in DuckDB SQL: the rounds are unrolled, every round scans all centroids."""
    steps = [
        f"""kept AS MATERIALIZED (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INT AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {k}))",
    ]
    for t in range(rounds + 1):
        steps.append(
            f"""a{t} AS MATERIALIZED (
    SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS near
    FROM (SELECT r, vec_id, kept.v AS v, c, list_sum(list_transform(list_zip(kept.v, c{t}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{t}) GROUP BY r)"""
        )
        if t < rounds:
            steps.append(
                f"""c{t + 1} AS MATERIALIZED (
    SELECT c, coalesce(list(m ORDER BY i) FILTER (m IS NOT NULL), any_value(v)) AS v
    FROM (SELECT c, c{t}.v AS v, i, m FROM c{t} LEFT JOIN (
        SELECT near.c AS c, i, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
        FROM (SELECT near, unnest(v) AS x, unnest(range(64)) AS i FROM a{t}) GROUP BY 1, 2) AS s USING (c))
    GROUP BY c)"""
            )
    steps.append(f"last AS (SELECT near.c AS c, sum(near.d)::BIGINT AS s FROM a{rounds} GROUP BY 1)")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, near.c AS cluster, near.d AS distance, last.s AS cluster_inertia, (SELECT sum(s) FROM last)::BIGINT AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN last ON near.c = last.c JOIN c{rounds} ON near.c = c{rounds}.c
"""


CLUSTER_SQL = cluster_sql()
