import hashlib
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspan.llm.exponion import CLUSTER_SQL, Ball, cluster_report, clustered, drifts

SCHEMA = "vec_id long, embedding array<double>, cluster string, v int"


def full_scan(v, centroids):
    """(nearest, squared distance): Python integers, all centroids, ties to the smaller number."""
    out = []
    for row in v:
        d = [sum((int(x) - int(y)) ** 2 for x, y in zip(row, c)) for c in centroids]
        out.append((d.index(min(d)), min(d)))
    return out


def lloyd(rows, k=8, rounds=10, size=64):
    """Brute force: every round scans every centroid with Python integers."""
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    seeds = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in seeds[:k]]
    for _ in range(rounds):
        found = full_scan([v for _, v in kept], c)
        for j in range(len(c)):
            mine = [v for (_, v), (a, _) in zip(kept, found) if a == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    return [(i, a, d) for (i, _), (a, d) in zip(kept, full_scan([v for _, v in kept], c))], c


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.sampled_from([3, 40, 10**6, 10**9]))
def test_bounds_find_the_nearest_in_every_round(seed, k, span):
    rng = np.random.default_rng(seed)
    v = rng.integers(-span, span, (120, 3)).astype(float)
    c = rng.integers(-span, span, (k, 3)).tolist()
    a, upper, lower = np.zeros(120, int), np.full(120, np.inf), np.zeros(120)
    for _ in range(4):
        a, upper, lower, _ = Ball(c).assigned(v, a, upper, lower)
        assert a.tolist() == [n for n, _ in full_scan(v, c)]
        new = [[int(x) for x in v[a == j].sum(axis=0)] if (a == j).any() else row for j, row in enumerate(c)]
        new = [[x // int((a == j).sum()) for x in row] if (a == j).any() else row for j, row in enumerate(new)]
        own, others = drifts(c, new)
        upper, lower, c = upper + own[a], np.maximum(lower - others[a], 0), new


def test_far_centroids_are_not_looked_at():
    rng = np.random.default_rng(5)
    c = rng.integers(-(10**5), 10**5, (200, 2)).tolist()
    v = np.array(c, float)[rng.integers(0, 200, 5000)] + rng.integers(-200, 200, (5000, 2))
    a, upper, lower, first = Ball(c).assigned(v, np.zeros(5000, int), np.full(5000, np.inf), np.zeros(5000))
    moved = [[x + 150 for x in row] if j % 7 == 0 else row for j, row in enumerate(c)]
    own, others = drifts(c, moved)
    a, *_, again = Ball(moved).assigned(v, a, upper + own[a], np.maximum(lower - others[a], 0))
    assert a.tolist() == [n for n, _ in full_scan(v, moved)] and again < 0.05 * v.shape[0] * 199 and again < first


def vectors(seed, n, size=64, levels=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 0.15, (n, size)) + rng.integers(0, 6, (n, 1)) * 0.1
    return [(i, (np.round(r * levels) / levels if levels else r).tolist()) for i, r in enumerate(x)]


@pytest.mark.parametrize("levels", [None, 2])
def test_report_equals_brute_force(spark, levels):
    rows = vectors(8, 300, levels=levels)
    rows += [(1000, None), (1001, [1.0] * 63), (1002, [0.5] * 63 + [None]), (1003, [0.5] * 63 + [float("nan")]), (1004, [float("-inf")] * 64), (1005, [])]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1])]
    df = spark.createDataFrame([(i, e, "own", 1) for i, e in rows], SCHEMA).repartition(5)
    want, c = lloyd(rows)
    inertia = [sum(d for _, a, d in want if a == j) for j in range(8)]
    full = [(i, a, d, inertia[a], sum(inertia), hashlib.sha256(",".join(map(str, c[a])).encode()).hexdigest()) for i, a, d in want]
    assert sorted(map(repr, map(tuple, cluster_report(df).collect()))) == sorted(map(repr, full))


def test_report_equals_its_sql(spark):
    df = spark.createDataFrame([(i, e, "own", 1) for i, e in vectors(3, 200)], SCHEMA)
    db = duckdb.connect()
    db.register("embeddings", df.select("vec_id", "embedding").toArrow())
    assert sorted(map(tuple, cluster_report(df).collect())) == sorted(db.sql(CLUSTER_SQL).fetchall())


def test_huge_components_and_few_vectors(spark):
    rows = [(0, [1e200, -3e38]), (1, [1e200, 3e38]), (2, [5.5, -0.0]), (3, [5.5, 1e15])]
    df = spark.createDataFrame([(i, e, "own", 1) for i, e in rows], SCHEMA)
    found, c = clustered(df, k=8, rounds=3, size=2)
    want, brute = lloyd(rows, k=8, rounds=3, size=2)
    assert c == brute
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()) == sorted((i, a, min(d, 2**63 - 1)) for i, a, d in want)
    found, c = clustered(df, k=2, rounds=3, size=2)
    want, brute = lloyd(rows, k=2, rounds=3, size=2)
    assert c == brute and sorted((r["vec_id"], r["cluster"]) for r in found.collect()) == sorted((i, a) for i, a, _ in want)


def test_tables_without_vectors(spark):
    assert cluster_report(spark.createDataFrame([], SCHEMA)).count() == 0
    assert cluster_report(spark.createDataFrame([(1, [0.5], "own", 1), (2, None, None, None)], SCHEMA)).count() == 0
