"""Strongly connected components of a directed graph, and depth over the graph of components.

Both parts contract what has one way on, so a chain of n nodes takes a number of
rounds that grows with the logarithm of n, and never hold more edges than they were
given. Every round's tables are written to the shared folder.

Defined results: edges with a null end are left out, repeated edges count once, an
edge from a node to itself puts the node on a cycle. No edges give no rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .graph import materialize

log = logging.getLogger(__name__)


class _Found:
    """Rows written round by round and read back as one table."""

    def __init__(self, empty: DataFrame):
        self.empty, self.paths = empty, []

    def add(self, rows: DataFrame, label: str) -> DataFrame:
        """Write rows, and return them as written."""
        path = scratch_path(rows.sparkSession, label)
        rows.write.parquet(path)
        self.paths.append(path)
        return rows.sparkSession.read.schema(rows.schema).parquet(path)

    def table(self) -> DataFrame:
        return self.empty.sparkSession.read.schema(self.empty.schema).parquet(*self.paths) if self.paths else self.empty


def _contract(live: DataFrame, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round: ``(record, live, taken)``.

    Takes out nodes with no way on, and of those with one way on (to ``w``) a set in
    which no node's ``w`` is taken out as well: its coin shows one and that of ``w``
    zero, or ``w`` has several ways. What led to a node then leads to its ``w``, so
    all paths among the other nodes stay. The record keeps (v, w, u) for each u that
    led to v: v lies in the component of w just when one of these u does.
    """
    ways = live.select(F.col("src").alias("v"), F.col("dst").alias("w")).unionAll(live.select("dst", F.lit(None).cast(live.schema["dst"].dataType)))
    single = ways.groupBy("v").agg(F.count("w").alias("n"), F.max("w").alias("w")).filter("n <= 1")
    single = materialize(single.withColumn("coin", F.xxhash64("v", F.lit(turn)).bitwiseAND(F.lit(1))), "single")
    following = single.select(F.col("v").alias("w"), F.col("n").alias("w_n"), F.col("coin").alias("w_coin"))
    free = F.col("w_n").isNull() | ((F.col("w_n") == 1) & (F.col("w_coin") == 0))
    taken = single.join(following, "w", "left").filter((F.col("n") == 0) | ((F.col("coin") == 1) & free)).select("v", "w")
    taken = materialize(taken, "taken")
    left = live.join(taken.select(F.col("v").alias("src")), "src", "left_anti")
    left = materialize(left.join(taken.withColumnRenamed("v", "dst").withColumn("hit", F.lit(True)), "dst", "left"), "moved")
    record = left.filter("hit AND w IS NOT NULL").select(F.col("dst").alias("v"), "w", F.col("src").alias("u"))
    moved = left.select("src", F.when(F.col("hit"), F.col("w")).otherwise(F.col("dst")).alias("dst"))
    return record, moved.filter("dst IS NOT NULL AND src <> dst").distinct(), taken


def _close(live: DataFrame, trace: list) -> DataFrame:
    """(v, root) of components closed by colours: the largest name that reaches a node, then back from it inside the colour."""
    colours = materialize(live.select(F.col("src").alias("v")).union(live.select("dst")).distinct().withColumn("c", F.col("v")), "colours")
    while True:
        trace.append("colour")
        sent = live.join(colours, live["src"] == colours["v"]).groupBy(F.col("dst").alias("v")).agg(F.max("c").alias("came"))
        step = materialize(colours.join(sent, "v", "left").select("v", F.greatest("c", "came").alias("c"), (F.col("came") > F.col("c")).alias("moved")), "colours")
        colours = step.select("v", "c")
        if step.filter("moved").isEmpty():
            break
    inside = live.join(colours.select(F.col("v").alias("src"), "c"), "src").join(colours.select(F.col("v").alias("dst"), F.col("c").alias("d")), "dst")
    inside = materialize(inside.filter("c = d").select("src", "dst", "c"), "inside")
    found = _Found(colours.limit(0))
    front = found.add(colours.filter("v = c"), "reached")
    while True:
        trace.append("back")
        back = inside.join(front.select(F.col("v").alias("dst")), "dst").select(F.col("src").alias("v"), "c").distinct()
        front = found.add(back.join(found.table().select("v"), "v", "left_anti"), "reached")
        if front.isEmpty():
            return found.table().withColumnRenamed("c", "root")


def components(edges: DataFrame, trace: list | None = None) -> DataFrame:
    """(node, component_id, component_size, on_cycle) for edges (src, dst).

    ``component_id`` is the smallest name in the component; ``on_cycle`` is true for
    components of several nodes and for nodes with an edge to themselves. ``trace``
    receives one entry per round.
    """
    trace = [] if trace is None else trace
    given = materialize(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    live = materialize(given.filter("src <> dst"), "live")
    found = _Found(given.select(F.col("src").alias("v"), F.col("dst").alias("root")).limit(0))
    records, idle = [], 0
    while not live.isEmpty():
        trace.append("contract")
        record, following, taken = _contract(live, len(trace))
        if taken.isEmpty():
            idle += 1
            if idle == 2:
                closed = _close(live, trace)
                found.add(closed.filter("v <> root"), "closed")
                gone = closed.select("v")
                live = live.join(gone, live["src"] == gone["v"], "left_anti")
                live, idle = materialize(live.join(gone, live["dst"] == gone["v"], "left_anti"), "live"), 0
                continue
        else:
            idle = 0
            records.append(record)
            live = materialize(following, "live")
        live = live.select(F.col("dst").alias("src"), F.col("src").alias("dst"))  # next round from the other side
    for record in reversed(records):
        trace.append("expand")
        known = found.table()
        root = lambda name: known.select(F.col("v").alias(name), F.col("root").alias(f"{name}_root"))
        both = record.join(root("w"), "w", "left").join(root("u"), "u", "left").select("v", F.coalesce("w_root", "w").alias("root"), F.coalesce("u_root", "u").alias("other"))
        found.add(both.filter("root = other").select("v", "root").distinct(), "roots")
    log.info("components: %d rounds", len(trace))
    nodes = given.select(F.col("src").alias("v")).union(given.select("dst")).distinct()
    rooted = nodes.join(found.table(), "v", "left").select(F.col("v").alias("node"), F.coalesce("root", "v").alias("root"))
    named = rooted.groupBy("root").agg(F.min("node").alias("component_id"), F.count("*").alias("component_size"))
    loops = given.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    return rooted.join(named, "root").join(loops, "node", "left").select(
        "node", "component_id", "component_size", ((F.col("component_size") > 1) | F.col("loop").isNotNull()).alias("on_cycle")
    )


def _arrive(jumps: DataFrame, trace: list) -> DataFrame:
    """Doubles (v, t, far, best, flag) until every t has several ways on, or is null: the end of all ways."""
    while True:
        trace.append("double")
        ahead = jumps.select(F.col("v").alias("t"), F.lit(True).alias("goes"), F.col("t").alias("t2"), F.col("far").alias("far2"), F.col("best").alias("best2"), F.col("flag").alias("flag2"))
        goes = F.coalesce("goes", F.lit(False))
        step = jumps.join(ahead, "t", "left").select(
            "v",
            F.when(goes, F.col("t2")).otherwise(F.col("t")).alias("t"),
            (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"),
            F.greatest("best", F.col("far") + F.col("best2")).alias("best"),
            (F.col("flag") | F.coalesce("flag2", F.lit(False))).alias("flag"),
            goes.alias("goes"),
        )
        jumps = materialize(step, "jumps")
        if jumps.filter("goes").isEmpty():
            return jumps.drop("goes")
        jumps = jumps.drop("goes")


def depths(nodes: DataFrame, edges: DataFrame, trace: list | None = None) -> DataFrame:
    """(node, depth, flag) of a graph without cycles: nodes (node, flag), edges (src, dst) among them.

    ``depth`` counts the nodes of the longest walk that starts at the node; ``flag``
    is true where a walk meets a node whose flag is. A phase takes out all nodes
    with at most one way on: their ways are doubled to where they end or branch,
    with the distance to there and the longest walk met before.
    """
    trace = [] if trace is None else trace
    live = materialize(edges.select("src", "dst").distinct().withColumn("far", F.lit(1).cast("bigint")), "live")
    nodes = materialize(nodes.select("node", F.lit(1).cast("bigint").alias("best"), "flag"), "nodes")
    phases = []
    while not nodes.isEmpty():
        ways = live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.max("dst").alias("t"), F.max("far").alias("far"))
        single = nodes.join(ways, "node", "left").filter("n IS NULL OR n = 1")
        jumps = materialize(single.select(F.col("node").alias("v"), "t", F.coalesce("far", F.lit(0)).cast("bigint").alias("far"), "best", "flag"), "jumps")
        jumps = _arrive(jumps, trace)
        phases.append(jumps)
        gone = jumps.select(F.col("v").alias("dst"), F.lit(True).alias("gone"), "t", F.col("far").alias("more"), F.col("best").alias("best2"), F.col("flag").alias("flag2"))
        left = materialize(live.join(jumps.select(F.col("v").alias("src")), "src", "left_anti").join(gone, "dst", "left"), "left")
        gains = left.filter("gone").groupBy(F.col("src").alias("node")).agg(F.max(F.col("far") + F.col("best2")).alias("gain"), F.bool_or("flag2").alias("met"))
        kept = nodes.join(jumps.select(F.col("v").alias("node")), "node", "left_anti").join(gains, "node", "left")
        nodes = materialize(kept.select("node", F.greatest("best", "gain").alias("best"), (F.col("flag") | F.coalesce("met", F.lit(False))).alias("flag")), "nodes")
        moved = left.select("src", F.when(F.col("gone"), F.col("t")).otherwise(F.col("dst")).alias("dst"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"))
        live = materialize(moved.filter("dst IS NOT NULL").groupBy("src", "dst").agg(F.max("far").alias("far")), "live")
    found = _Found(nodes.select("node", F.col("best").alias("depth"), "flag").limit(0))
    for jumps in reversed(phases):
        trace.append("expand")
        known = found.table().select(F.col("node").alias("t"), "depth", F.col("flag").alias("t_flag"))
        found.add(
            jumps.join(known, "t", "left").select(
                F.col("v").alias("node"), F.greatest("best", F.col("far") + F.col("depth")).alias("depth"), (F.col("flag") | F.coalesce("t_flag", F.lit(False))).alias("flag")
            ),
            "depths",
        )
    log.info("depths: %d rounds", len(trace))
    return found.table()


def component_depth(edges: DataFrame, trace: list | None = None) -> DataFrame:
    """(node, component_id, component_size, on_cycle, depth, reaches_cycle) for edges (src, dst).

    ``depth`` counts the components of the longest walk from the node, each once, so
    it is known behind cycles too; without cycles it counts nodes. ``reaches_cycle``
    is true for nodes on a cycle and for those a walk leads from to one.
    """
    given = materialize(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    member = materialize(components(given, trace), "components")
    start = member.select(F.col("node").alias("src"), F.col("component_id").alias("from"))
    end = member.select(F.col("node").alias("dst"), F.col("component_id").alias("to"))
    between = given.join(start, "src").join(end, "dst").filter("from <> to").select(F.col("from").alias("src"), F.col("to").alias("dst"))
    whole = member.groupBy(F.col("component_id").alias("node")).agg(F.bool_or("on_cycle").alias("flag"))
    deep = depths(whole, between, trace).select(F.col("node").alias("component_id"), "depth", F.col("flag").alias("reaches_cycle"))
    return member.join(deep, "component_id").select("node", "component_id", "component_size", "on_cycle", "depth", "reaches_cycle")
