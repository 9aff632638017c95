"""Connected components of a link table by alternating star contractions, a few joins per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptgauge.llm.common import settled


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a long, b long)`` to ``(node, component)``: each linked node but the smallest of its component.

    Every round points all larger neighbours of a node at its smallest one, then
    all smaller ones too. Minima are combined before each shuffle, joins split
    skewed nodes, and a round's links are written to the shared folder, so a lost
    executor repeats one round at most. Nulls and self links are ignored.
    """
    now = settled(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        stats = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(stats) == mark or not stats[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(stats)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = settled(large, "links")
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = settled(root.select("a", F.col("m").alias("b")).unionAll(small).distinct(), "links")
