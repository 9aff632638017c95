"""Statement features and statement scores: one wide projection per statement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions import weights as W
from .statements import fail_reason, kept_type, type_of
from .tables import name_columns, named_parts, table_count, table_list, with_names

COMMON = [
    "table", "join", "where_condition", "subquery", "aggregate_function", "case_expression",
    "set_operation", "group_by", "order_by",
]
HIVE_ONLY = list(P.HIVE_EXTRA)
SCORED = COMMON + HIVE_ONLY


def weight_table(spark: SparkSession, rows=None) -> DataFrame:
    """(dialect, factor, weight); pass rows of your own to override the defaults."""
    values = ", ".join(f"('{dialect}', '{factor}', {weight}D)" for dialect, factor, weight in rows or W.rows())
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(dialect, factor, weight)")


def wide_weights(weights: DataFrame) -> DataFrame:
    """One row per known dialect with a ``w`` struct, so that scoring is a projection and not an aggregation.

    The result has at most three rows of fixed width, whatever the input, so it
    is safe to broadcast.
    """
    known = weights.filter(F.col("dialect").isin(*P.DIALECTS))
    wide = known.groupBy("dialect").pivot("factor", W.FACTORS).agg(F.first("weight"))
    return F.broadcast(
        wide.select(
            F.col("dialect").alias("w_dialect"),
            F.struct(*[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in W.FACTORS]).alias("w"),
        )
    )


def where_count(sql: Column, upper: Column, kind: Column, dialect: Column) -> Column:
    has_where = upper.contains("WHERE")
    flag = has_where.cast("bigint")
    select = T.by_dialect(
        dialect,
        {
            P.ORACLE: F.when(has_where, T.count_matches(sql, P.AND_OR) + 1).otherwise(0),
            P.GAUSS: flag,
            P.HIVE: F.when(has_where, T.count_matches(sql, P.WHERE)).otherwise(0),
        },
    )
    return F.when(kind == "SELECT", select).when(kind == "DYNAMIC_SQL", 0).otherwise(flag).cast("bigint")


def feature_columns(sql: Column, upper: Column, kind: Column, dialect: Column) -> dict[str, Column]:
    """Counts of a statement; only SELECT has more than tables and WHERE."""
    is_select = kind == "SELECT"
    is_hive = dialect == P.HIVE
    zero = F.lit(0).cast("bigint")

    def count(pattern: str, *words: str, only: Column = is_select) -> Column:
        return F.when(only & T.has_any(upper, *words), T.count_matches(sql, pattern)).otherwise(zero)

    select_hive, select_other = is_select & is_hive, is_select & ~is_hive
    select_oracle, select_not_oracle = is_select & (dialect == P.ORACLE), is_select & (dialect != P.ORACLE)
    columns = {
        "join": count(P.JOIN, "JOIN"),
        "where_condition": where_count(sql, upper, kind, dialect),
        "subquery": count(P.SUBQUERY, "("),
        "aggregate_function": count(P.HIVE_AGGREGATE, "(", only=select_hive)
        + count(P.AGGREGATE, "(", only=select_other),
        "case_expression": count(P.CASE, "CASE"),
        "set_operation": count(P.ORACLE_SET_OPERATION, "UNION", "INTERSECT", "MINUS", only=select_oracle)
        + count(P.SET_OPERATION, "UNION", "INTERSECT", "MINUS", "EXCEPT", only=select_not_oracle),
        "group_by": count(P.GROUP_BY, "GROUP"),
        "order_by": count(P.ORDER_BY, "ORDER"),
    }
    for name, pattern in P.HIVE_EXTRA.items():
        columns[name] = count(pattern, P.HIVE_EXTRA_WORD[name], only=select_hive)
    columns["line_count"] = T.line_count(sql)
    return columns


def query_depth(subqueries: Column, kind: Column, dialect: Column) -> Column:
    oracle = F.when(subqueries > 0, F.lit(2)).otherwise(F.lit(1))
    depth = F.when(dialect == P.ORACLE, oracle).otherwise(subqueries + 1)
    return F.when(kind == "SELECT", depth).otherwise(0).cast("bigint")


def statement_features(statements: DataFrame) -> DataFrame:
    """Classified statements with all counts, ``query_depth`` and ``table_names``."""
    sql, kind, dialect = F.col("sql"), F.col("type"), F.col("dialect")
    return (
        with_names(statements)
        .withColumns(
            {
                "table_names": table_list(kind, dialect, F.col("reads"), F.col("writes"), F.col("dynamic_refs")),
                "upper_sql": F.upper("sql"),
            }
        )
        .withColumns(feature_columns(sql, F.col("upper_sql"), kind, dialect))
        .withColumns(
            {
                "table": table_count(kind, dialect, F.col("table_names")),
                "query_depth": query_depth(F.col("subquery"), kind, dialect),
            }
        )
        .drop("upper_sql")
    )


def measured(statements: Column, dialect: Column, weights: Column) -> Column:
    """The same measures for an array of statements, inside the row.

    Each step is a ``transform`` that adds fields to the statement's struct, so a
    unit's statements never leave its row.
    """

    def extend(found: Column, more) -> Column:
        return F.transform(found, lambda s: _with_fields(s, more(s)))

    typed = extend(
        statements,
        lambda s: {"upper_sql": F.upper(s["sql"]), "parsed_type": type_of(s["sql"], dialect, s["origin"])},
    )
    checked = extend(
        typed,
        lambda s: {
            "fail_reason": fail_reason(s["sql"], s["parsed_type"], dialect),
            "parts": named_parts(s["sql"], s["parsed_type"], s["upper_sql"]),
        },
    )
    named = extend(checked, lambda s: name_columns(s["sql"], s["parsed_type"], s["parts"]))
    kept = extend(named, lambda s: {"type": kept_type(s["parsed_type"], s["fail_reason"])})

    def counts(s: Column) -> Column:
        """The counts but that of tables; what is no SELECT has none but WHERE, and nothing is tried on it."""
        select = feature_columns(s["sql"], s["upper_sql"], F.lit("SELECT"), dialect)
        other = {name: F.lit(0).cast("bigint") for name in SCORED[1:]} | {"where_condition": where_count(s["sql"], s["upper_sql"], s["type"], dialect)}
        of = [F.struct(*[found[name].alias(name) for name in SCORED[1:]]) for found in (select, other)]
        return F.when(s["type"] == "SELECT", of[0]).otherwise(of[1])

    listed = extend(
        kept,
        lambda s: {
            "table_names": table_list(s["type"], dialect, s["reads"], s["writes"], s["dynamic_refs"]),
            "counts": counts(s),
        },
    )
    counted = F.transform(
        listed,
        lambda s: F.struct(
            table_count(s["type"], dialect, s["table_names"]).alias("table"),
            *[s["counts"][name].alias(name) for name in SCORED[1:]],
            query_depth(s["counts"]["subquery"], s["type"], dialect).alias("query_depth"),
            *[s[name].alias(name) for name in ("table_names", "fail_reason", "sql", "type")],
            F.concat(s["reads"], s["writes"], s["dynamic_refs"]).alias("refs"),
        ),
    )
    return F.transform(
        counted,
        lambda s: F.struct(
            *[s[name].alias(name) for name in [*SCORED, "query_depth", "table_names", "fail_reason", "sql", "refs"]],
            score_of(s["sql"], s["type"], dialect, {f: s[f] for f in SCORED}, weights).alias("score"),
        ),
    )


def _with_fields(struct: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        struct = struct.withField(name, value)
    return struct


def features_long(features: DataFrame, keys: list[str]) -> DataFrame:
    """Unpivot to (statement, feature, n), rows with n = 0 left out."""
    return features.select(*keys, "dialect", *SCORED).unpivot([*keys, "dialect"], SCORED, "feature", "n").filter("n > 0")


def score_of(sql: Column, kind: Column, dialect: Column, counts: dict[str, Column], w: Column) -> Column:
    """Score of a statement from its counts and the weight struct ``w`` of its dialect."""
    # a fold adds in the order of a chain of sums, whose every sum would look up the types of all before it
    weighted = F.aggregate(F.array(*[counts[name] * w[name] for name in SCORED]), F.lit(0.0), lambda total, x: total + x)
    size = F.log10(F.length(sql)) * 5
    factor = F.lit(1.0)
    for name, value in W.STATEMENT_KIND_FACTOR.items():
        factor = F.when(kind == name, F.lit(value)).otherwise(factor)
    return (
        F.when(kind == "SELECT", weighted)
        .when(kind == "DYNAMIC_SQL", size * (1 + counts["table"] * 0.1))
        .when(dialect == P.ORACLE, size * factor)
        .otherwise(counts["table"] * w["table"])
    )


def scored(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Add ``score``."""
    return (
        features.join(wide_weights(weights), F.col("dialect") == F.col("w_dialect"), "left")
        .withColumn(
            "score",
            score_of(F.col("sql"), F.col("type"), F.col("dialect"), {f: F.col(f) for f in SCORED}, F.col("w")),
        )
        .drop("w", "w_dialect")
    )
