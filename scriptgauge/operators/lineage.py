"""Table lineage: what is written from what."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from .components import component_depth
from .graph import chain_depth
from .reach import reach
from .tables import ddl_target, with_names

WRITING_TYPES = ("INSERT", "MERGE", "CREATE")


def lineage_edges(statements: DataFrame) -> DataFrame:
    """(source, target, n) over INSERT, MERGE and CREATE TABLE AS; every target of a statement, and a table's own rows as its source."""
    created = ddl_target(F.col("sql"), F.lit("CREATE"))
    target = F.when(F.col("parsed_type") == "CREATE", F.array(created)).otherwise(F.col("writes"))
    return (
        with_names(statements.filter(F.col("parsed_type").isin(*WRITING_TYPES)))
        .select("reads", F.explode(target).alias("target"))
        .filter("target IS NOT NULL")
        .select("target", F.explode("reads").alias("source"))
        .groupBy("source", "target")
        .agg(F.count("*").alias("n"))
    )


def lineage_depth(statements: DataFrame) -> DataFrame:
    """For each table the longest chain of writes that ends in it, and whether it depends on itself.

    The full transitive closure is quadratic in the tables; the chain length per
    table keeps the question about depth and cycles linear.
    """
    edges = lineage_edges(statements).select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return chain_depth(edges).withColumnRenamed("node", "table_name")


def lineage_components(statements: DataFrame) -> DataFrame:
    """Tables that feed each other, and for every table the longest chain of writes that ends in it, counted in such groups."""
    edges = lineage_edges(statements).select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return component_depth(edges).withColumnRenamed("node", "table_name")


def lineage_reach(statements: DataFrame) -> DataFrame:
    """For every table how many tables its rows come from, over any number of writes; exact below 4,096, else estimated."""
    edges = lineage_edges(statements).select(F.col("target").alias("src"), F.col("source").alias("dst"))
    return reach(edges).withColumnRenamed("node", "table_name")
