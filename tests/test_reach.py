"""Reach of nodes against brute force, and the error of sketches above their bound."""

import random

from scriptgauge.operators import reach


def brute(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    sizes = {}
    for node in out:
        seen, todo = set(), list(out[node])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(out[n])
        sizes[node] = len(seen)
    return sizes


def found(spark, edges, kind="long", **options):
    return {r.node: (r.reach, r.exact) for r in reach.reach(spark.createDataFrame(sorted(edges), f"src {kind}, dst {kind}"), **options).collect()}


def test_random_graphs_with_cycles(spark):
    rng = random.Random(5)
    for nodes, n in ((15, 14), (60, 70), (60, 200)):
        edges = {(f"t{rng.randrange(nodes)}", f"t{rng.randrange(nodes)}") for _ in range(n)}
        assert found(spark, edges, "string") == {k: (v, True) for k, v in brute(edges).items()}


def test_error_above_the_bound(spark):
    """Sketches of 256 hashes on sets of up to 5,000 names; a hot node leads to a third of them."""
    rng = random.Random(6)
    edges = {(i, rng.randrange(i)) for i in range(1, 5000) for _ in range(3)} | {(5000, i) for i in range(1600)}
    want, got = brute(edges), found(spark, edges, log_k=8)
    assert got.keys() == want.keys()
    assert all(got[n] == (want[n], True) for n in want if want[n] < 256)
    large = [abs(got[n][0] / want[n] - 1) for n in want if want[n] >= 256]
    assert len(large) > 500 and not any(got[n][1] for n in want if want[n] >= 400)
    assert max(large) < 5 / 16 and sum(large) / len(large) < 2 / 16


def test_nulls_loops_and_no_edges(spark):
    edges = [("a", "a"), ("b", "a"), ("b", "a"), (None, "a"), ("b", None)]
    rows = reach.reach(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert {tuple(r) for r in rows} == {("a", 1, True), ("b", 1, True)}
    assert reach.reach(spark.createDataFrame([], "src string, dst string")).collect() == []
