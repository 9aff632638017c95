"""Counts taken from a unit's whole text: loops, cursors, dynamic SQL, transactions, Java."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def loop_count(text: Column) -> Column:
    return T.count_matches(text, P.LOOP) - T.count_matches(text, P.END_LOOP)


def loop_nesting(text: Column) -> Column:
    steps = F.transform(
        T.all_matches(text, P.LOOP_TOKEN), lambda token: F.when(F.lower(token) == "loop", 1).otherwise(-1)
    )
    return T.peak_level(steps)


def cursor_count(text: Column, dialect: Column) -> Column:
    return F.when(dialect == P.HIVE, T.count_matches(text, P.HIVE_CURSOR)).otherwise(
        T.count_matches(text, P.CURSOR_DECLARATION)
    )


def cursor_names(text: Column) -> Column:
    return F.array_distinct(F.transform(T.all_matches(text, P.CURSOR_DECLARATION, 1), F.lower))


def cursor_loop_count(text: Column) -> Column:
    """FOR loops over a declared cursor."""
    loops = F.transform(T.all_matches(text, P.FOR_IN, 1), F.lower)
    return T.bind(
        cursor_names(text),
        lambda declared: F.size(F.filter(loops, lambda name: F.array_contains(declared, name))).cast("bigint"),
    )


def cursor_nesting(text: Column) -> Column:
    """Nesting of DECLARE blocks; at least 1 when the text has a cursor."""
    lines = F.transform(F.split(F.upper(text), P.LINE_BREAK), T.trimmed)
    steps = F.transform(
        lines,
        lambda line: F.when(line.startswith("DECLARE") | line.contains(" DECLARE "), 1)
        .when(line.startswith("END;"), -1)
        .otherwise(0),
    )
    has_declare = F.upper(text).contains("DECLARE")
    depth = F.when(has_declare, T.peak_level(F.filter(steps, lambda s: s != 0))).otherwise(0)
    return F.when((depth == 0) & F.upper(text).contains("CURSOR"), 1).otherwise(depth).cast("bigint")


def dynamic_count(text: Column) -> Column:
    return T.count_matches(text, P.EXECUTE_IMMEDIATE) + T.count_matches(text, P.OPEN_FOR)


def binding_count(text: Column) -> Column:
    """Bind variables plus the items of every USING clause."""
    clauses = T.all_matches(text, P.USING_CLAUSE)
    items = F.aggregate(
        clauses, F.lit(0).cast("bigint"), lambda n, clause: n + T.count_matches(clause, ",") + 1
    )
    return T.count_matches(text, P.BIND_VARIABLE) + items


def dynamic_nesting(text: Column) -> Column:
    counts = F.transform(F.split(text, ";"), lambda part: F.regexp_count(part, F.lit(P.EXECUTE_IMMEDIATE)))
    return F.when(text.rlike(P.guarded(P.EXECUTE_IMMEDIATE)), F.array_max(counts)).otherwise(0).cast("bigint")


def transaction_count(text: Column) -> Column:
    return T.count_matches(text, P.TRANSACTION_CONTROL)


def savepoint_pairs(text: Column) -> Column:
    """Savepoints times the rollbacks to the same name, counted per name without pairing rows."""
    names = F.struct(
        F.transform(T.all_matches(text, P.SAVEPOINT_NAME, 1), F.lower).alias("saved"),
        F.transform(T.all_matches(text, P.ROLLBACK_NAME, 1), F.lower).alias("rolled"),
    )

    def occurrences(found: Column, name: Column) -> Column:
        return F.size(F.filter(found, lambda other: other == name)).cast("bigint")

    total = T.bind(
        names,
        lambda n: F.aggregate(
            F.array_intersect(n["saved"], n["rolled"]),
            F.lit(0).cast("bigint"),
            lambda sum_, name: sum_ + occurrences(n["saved"], name) * occurrences(n["rolled"], name),
        ),
    )
    return F.when(text.rlike(P.guarded(P.SAVEPOINT_NAME)), total).otherwise(0).cast("bigint")


def rollback_block_depth(text: Column) -> Column:
    """Most BEGINs of a block that handles an exception with a rollback: one walk over the words that matter."""
    start = F.struct(F.lit(0).alias("phase"), F.lit(0).alias("begins"), F.lit(0).alias("peak"))

    def walk(state: Column, word: Column) -> Column:
        phase, begins = state["phase"], state["begins"] + F.when(word == "BEGIN", 1).otherwise(0)
        closed = (phase == 3) & (word == "END")
        after = (
            F.when((phase == 0) & (word == "BEGIN"), 1)
            .when((phase == 1) & (word == "EXCEPTION"), 2)
            .when((phase == 2) & (word == "ROLLBACK"), 3)
            .when(closed, 0)
            .otherwise(phase)
        )
        return F.struct(
            after.alias("phase"),
            F.when(closed, 0).otherwise(begins).alias("begins"),
            F.when(closed, F.greatest(state["peak"], begins)).otherwise(state["peak"]).alias("peak"),
        )

    words = F.transform(T.all_matches(text, P.BLOCK_TOKEN), F.upper)
    return F.aggregate(words, start, walk, lambda state: state["peak"]).cast("bigint")


def transaction_nesting(text: Column) -> Column:
    in_blocks = rollback_block_depth(text)
    pairs = savepoint_pairs(text)
    return F.greatest(F.lit(1), F.when(pairs > 0, pairs).otherwise(in_blocks)).cast("bigint")


def flag(text: Column, pattern: str) -> Column:
    return text.rlike(pattern).cast("bigint")


def unit_columns(text: Column, upper: Column, dialect: Column) -> dict[str, Column]:
    """Every count of a unit's text that takes part in a score. ``upper`` is the upper-cased text."""
    gauss = dialect == P.GAUSS
    zero = F.lit(0).cast("bigint")

    def where(condition: Column, value: Column) -> Column:
        return F.when(condition, value).otherwise(zero)

    has_loop = upper.contains("LOOP")
    has_cursor = T.has_any(upper, "CURSOR", "DECLARE")
    immediate = upper.contains("IMMEDIATE")
    java = upper.contains("JAVA")
    columns = {
        "unit_lines": T.line_count(text),
        "loop_count": where(has_loop, loop_count(text)),
        "max_loop_nesting": where(has_loop, loop_nesting(text)),
        "cursor_count": where(has_cursor, cursor_count(text, dialect)),
        "cursor_operation_count": T.count_if(upper, text, P.CURSOR_OPERATION, "OPEN", "FETCH", "CLOSE"),
        "max_cursor_nesting": where(has_cursor, cursor_nesting(text)),
        "dynamic_sql_count": where(gauss & (immediate | upper.contains("OPEN")), dynamic_count(text)),
        "binding_count": where(gauss & T.has_any(upper, ":", "USING"), binding_count(text)),
        "max_dynamic_nesting": where(gauss & immediate, dynamic_nesting(text)),
        "transaction_count": where(gauss & T.has_any(upper, "COMMIT", "ROLLBACK", "SAVEPOINT"), transaction_count(text)),
        "transaction_nesting": F.when(gauss & upper.contains("ROLLBACK"), transaction_nesting(text))
        .when(gauss, F.lit(1))
        .otherwise(zero),
        "autonomous": where(gauss & upper.contains("PRAGMA"), flag(text, P.AUTONOMOUS)),
        "java_unit": where(gauss & java, flag(text, P.JAVA_UNIT)),
        "java_types": where(gauss & java & text.rlike(P.guarded(P.JAVA_UNIT)), T.count_matches(text, P.JAVA_TYPE)),
        "mentions_package": where(gauss, upper.contains("PACKAGE").cast("bigint")),
        "package_members": where(gauss & upper.contains("PACKAGE"), T.count_matches(text, P.PACKAGE_MEMBER)),
        "package_variables": where(gauss & upper.contains("PACKAGE"), T.count_matches(text, P.PACKAGE_VARIABLE)),
    }
    for name, pattern in P.HIVE_EXTRA.items():
        hive = (dialect == P.HIVE) & upper.contains(P.HIVE_EXTRA_WORD[name])
        columns["unit_" + name] = where(hive, T.count_matches(text, pattern))
    return columns


def _select(units: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return units.select("unit_id", "dialect", *[value.alias(name) for name, value in columns.items()])


def loop_features(units: DataFrame) -> DataFrame:
    text = F.col("source_code")
    return _select(units, {"loop_count": loop_count(text), "end_loop_count": T.count_matches(text, P.END_LOOP)})


def loop_nesting_table(units: DataFrame) -> DataFrame:
    return _select(units, {"max_loop_nesting": loop_nesting(F.col("source_code"))})


def cursor_features(units: DataFrame) -> DataFrame:
    text = F.col("source_code")
    return _select(
        units,
        {
            "cursor_count": cursor_count(text, F.col("dialect")),
            "parameterised": T.count_matches(text, P.CURSOR_PARAMETERS),
            "cursor_list": T.joined(cursor_names(text)),
            "cursor_loops": cursor_loop_count(text),
            "ref_cursors": T.count_matches(text, P.REF_CURSOR),
            "with_query": T.count_matches(text, P.CURSOR_WITH_QUERY),
            "for_update": T.count_matches(text, P.CURSOR_FOR_UPDATE),
        },
    )


def cursor_operations(units: DataFrame) -> DataFrame:
    """(unit, operation, cursor) counts; the exploded rows of a unit are combined before they are shuffled."""
    found = units.select("unit_id", F.explode(T.all_matches(F.col("source_code"), P.CURSOR_OPERATION)).alias("m"))
    return (
        found.select(
            "unit_id",
            F.upper(F.regexp_extract("m", P.CURSOR_OPERATION_PARTS, 1)).alias("operation"),
            F.lower(F.regexp_extract("m", P.CURSOR_OPERATION_PARTS, 2)).alias("cursor_name"),
        )
        .groupBy("unit_id", "operation", "cursor_name")
        .agg(F.count("*").alias("n"))
    )


def cursor_nesting_table(units: DataFrame) -> DataFrame:
    return _select(units, {"max_cursor_nesting": cursor_nesting(F.col("source_code"))})


def dynamic_features(units: DataFrame) -> DataFrame:
    text = F.col("source_code")
    return _select(
        units,
        {
            "dynamic_sql_count": dynamic_count(text),
            "binding_count": binding_count(text),
            "max_dynamic_nesting": dynamic_nesting(text),
        },
    )


def transaction_features(units: DataFrame) -> DataFrame:
    text = F.col("source_code")
    return _select(
        units,
        {
            "transaction_count": transaction_count(text),
            "savepoint_pairs": savepoint_pairs(text),
            "transaction_nesting": transaction_nesting(text),
            "autonomous": text.rlike(P.guarded(P.AUTONOMOUS)),
        },
    )


def java_units(units: DataFrame) -> DataFrame:
    text = F.col("source_code")
    return _select(units, {"java_types": T.count_matches(text, P.JAVA_TYPE), "is_java": text.rlike(P.guarded(P.JAVA_UNIT))}).filter(
        "is_java OR java_types > 0"
    )
