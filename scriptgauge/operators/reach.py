"""How many nodes each node of a directed graph leads to, without pairs of nodes.

Every node carries a sketch of the names it reaches: the smallest K hashes (a theta
sketch). Sketches travel against the edges until none changes; only those that
changed in a round travel in the next. Sets of fewer than K names are held exactly,
larger ones are estimated with a relative standard error of about 1 / sqrt(K). A
node's state is bounded by K hashes, however much it reaches, and sketches are merged
before they are shuffled, so a node with very many edges costs no more than others.

The rounds are as many as the longest shortest way between two nodes has edges; each
round's sketches are written to the shared folder.

Defined results: edges with a null end are left out, repeated edges count once, a node
counts itself only if it lies on a cycle, one without edges on reaches nothing. No
edges give no rows.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import materialize

log = logging.getLogger(__name__)

#: Logarithm of K, the number of names up to which a reach is exact.
LOG_K = 12


def reach(edges: DataFrame, log_k: int = LOG_K, trace: list | None = None) -> DataFrame:
    """(node, reach, exact) for edges (src, dst): the number of other nodes, and itself on a cycle, that ways from the node lead to.

    ``trace`` receives one entry per round.
    """
    trace = [] if trace is None else trace
    edges = materialize(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct(), "edges")
    first = edges.groupBy(F.col("src").alias("node")).agg(F.theta_sketch_agg("dst", log_k).alias("sketch"))
    states = materialize(first.withColumn("moved", F.lit(True)), "reach")
    while True:
        trace.append("carry")
        sent = states.filter("moved").select(F.col("node").alias("dst"), "sketch")
        if sent.isEmpty():
            break
        came = edges.filter("src <> dst").join(sent, "dst").groupBy(F.col("src").alias("node")).agg(F.theta_union_agg("sketch", log_k).alias("came"))
        both = F.coalesce(F.theta_union("sketch", "came", log_k), "sketch")
        step = states.drop("moved").join(came, "node", "left").withColumn("both", both)
        states = materialize(step.select("node", F.col("both").alias("sketch"), (F.col("both") != F.col("sketch")).alias("moved")), "reach")
    log.info("reach: %d rounds", len(trace))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    told = nodes.join(states, "node", "left").select("node", F.coalesce(F.theta_sketch_estimate("sketch"), F.lit(0)).cast("bigint").alias("reach"))
    return told.withColumn("exact", F.col("reach") < 2**log_k)
