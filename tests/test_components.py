"""Components and depth of graphs against brute force."""

import random

from scriptgauge.operators import components


def brute(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    reach = {}
    for node in out:
        seen, todo = set(), list(out[node])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo.extend(out[n])
        reach[node] = seen
    member = {n: frozenset({n} | {m for m in reach[n] if n in reach[m]}) for n in out}
    deep = {}

    def depth(part):
        if part not in deep:
            deep[part] = 1 + max((depth(member[m]) for n in part for m in out[n] if member[m] != part), default=0)
        return deep[part]

    cyclic = {n for n in out if n in reach[n]}
    return {n: (min(member[n]), len(member[n]), n in cyclic, depth(member[n]), n in cyclic or bool(reach[n] & cyclic)) for n in out}


def found(spark, edges, trace=None):
    rows = components.component_depth(spark.createDataFrame(sorted(edges), "src long, dst long"), trace).collect()
    got = {r.node: (r.component_id, r.component_size, r.on_cycle, r.depth, r.reaches_cycle) for r in rows}
    assert len(got) == len(rows)
    return got


def test_random_graphs(spark):
    rng = random.Random(11)
    for nodes, n in ((12, 10), (40, 44), (40, 75), (60, 200)):
        edges = {(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)}
        assert found(spark, edges) == brute(edges)


def test_graph_without_single_ways(spark):
    """Every node has several ways on and back: colours have to close the components."""
    core = {(a, b) for a in range(6) for b in range(6) if a != b and (a + b) % 4}
    edges = core | {(a + 10, b + 10) for a, b in core} | {(0, 10), (1, 12), (2, 11)}
    assert found(spark, edges) == brute(edges)


def test_long_chain_takes_few_rounds(spark):
    n, trace = 3000, []
    edges = {(i, i + 1) for i in range(n)} | {(n, n + 1), (n + 1, n - 5)}
    got = found(spark, edges, trace)
    assert got[0] == (0, 1, False, n - 5 + 1, True) and got[n + 1] == (n - 5, 7, True, 1, True)
    assert len(trace) < 150


def test_nulls_loops_and_no_edges(spark):
    rows = components.component_depth(spark.createDataFrame([("a", "a"), ("b", "a"), (None, "a"), ("b", None), ("b", "a")], "src string, dst string")).collect()
    assert {tuple(r) for r in rows} == {("a", "a", 1, True, 1, True), ("b", "b", 1, False, 2, True)}
    assert components.component_depth(spark.createDataFrame([], "src string, dst string")).collect() == []
