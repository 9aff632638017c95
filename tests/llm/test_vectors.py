"""Link counts and components against all pairs."""

import math
import random

import numpy as np
from compare import connect, difference

from scriptgauge.llm import queries, vectors


def by_brute_force(rows):
    units = []
    for _, v in rows:
        ok = v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        units.append([x / math.sqrt(sum(y * y for y in v)) for x in v] if ok else None)
    n = len(rows)
    link = [[i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and sum(a * b for a, b in zip(units[i], units[j], strict=True)) >= 0.95 for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(n) if link[k][j]} - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        first = min(ids) if ids else None
        out.append((rows[i][0], sum(link[i]), first, rows[i][0] is not None and rows[i][0] == first))
    return sorted(out, key=str)


def test_clustered_and_odd_vectors(spark, monkeypatch):
    for name, value in (("HOME_ROWS", 20), ("VISITOR_ROWS", 30), ("CHUNK_ROWS", 7)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = rng.normal(size=6)
        rows += [(len(rows) + 1000, (centre + rng.normal(size=6) * 0.22).tolist()) for _ in range(random.Random(c).randrange(1, 25))]
    rows += [(i, [1.0, 0, 0, 0, 0, 0]) for i in range(40)] + [(41, [2.0, 0, 0, 0, 0, 0]), (41, [2.0, 0, 0, 0, 0, 0])]
    rows += [(50, None), (51, []), (52, [0.0] * 6), (53, [1.0, None, 0, 0, 0, 0]), (54, [float("nan")] * 6), (55, [float("inf"), 0, 0, 0, 0, 0]), (56, [1.0, 0.01]), (57, [1.0, 0.0]), (None, [0.0, 1.0, 0, 0, 0, 0]), (58, [1e300, 0, 0, 0, 0, 0]), (59, [-1.0, 0, 0, 0, 0, 0])]
    rows = [(i, v and [None if x is None else float(x) for x in v]) for i, v in rows]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<double>, key string")
    safe = [(i, [1.0, 0, 0, 0, 0, 0] if i == 58 else v) for i, v in rows]
    assert sorted(map(tuple, vectors.near_duplicates(frame).collect()), key=str) == by_brute_force(safe)


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_query_against_sql(spark, small):
    assert difference(queries.op2_vector_near_duplicates(spark, small), connect(small), queries.SQL["op2_vector_near_duplicates"]) == ""


def test_bounds_never_lose_a_partner():
    rng = np.random.default_rng(2)
    units = rng.normal(size=(600, 8)) + 2 * rng.normal(size=(20, 8)).repeat(30, axis=0)
    units /= np.linalg.norm(units, axis=1)[:, None]
    pivots = vectors.choose_pivots(units, 15)
    d = vectors.distances(units, pivots)
    home, radius = d.argmin(axis=1), math.sqrt(0.1)
    widest = np.array([d[home == c, c].max() if (home == c).any() else -1.0 for c in range(15)])
    near = vectors.reach(units, pivots, home, widest, radius)
    a, b = np.nonzero(units @ units.T >= 0.95)
    assert near[a, home[b]].all() and near.mean() < 0.9
