"""Statements: extraction from unit bodies, classification and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing as L
from ..functions import patterns as P
from ..functions import text as T

SQL, CALL, DYNAMIC = "sql", "call", "dynamic"


def split_text(scripts: DataFrame) -> DataFrame:
    """Split a multi-statement text at each semicolon that ends a line."""
    parts = F.filter(
        F.transform(F.split(T.without_comments(F.col("src")), P.STATEMENT_END), T.trimmed), lambda s: F.length(s) > 0
    )
    return scripts.select("script_id", "dialect", F.posexplode(parts).alias("stmt_no", "sql")).withColumn(
        "stmt_no", F.col("stmt_no").cast("bigint")
    )


def body_statements(safe: Column, dialect: Column) -> Column:
    """SQL statements of a shielded body."""
    found = T.by_dialect(dialect, {name: T.all_matches(safe, P.to_semicolon(pattern)) for name, pattern in P.BODY_STATEMENT.items()})
    return F.transform(found, lambda s: T.bind(L.unshield(s), T.trimmed_value))


def body_calls(safe: Column) -> Column:
    """Calls that are statements of a shielded body: without brackets, a name and one bracket are all that stands there."""

    def of(parts: Column) -> Column:
        ended = T.bind(F.split(F.element_at(parts, -1), ";"), lambda s: F.slice(s, F.lit(1), F.size(s) - 1))
        bracketed = F.filter(ended, lambda s: s.contains(L.CLOSE_MARK))
        flat = F.filter(F.transform(bracketed, lambda s: F.regexp_extract(s, P.FLAT_CALL, 1)), lambda c: c != "")
        return F.transform(flat, lambda c: F.concat(T.trimmed(L.unshield(L.with_brackets(c, parts))), F.lit(";")))

    return T.bind(L.scopes(safe), of)


def dynamic_literals(safe: Column, dialect: Column) -> Column:
    """The literal of EXECUTE IMMEDIATE is a statement of its own, doubled quotes undone."""
    found = F.when((dialect != P.HIVE) & F.upper(safe).contains("IMMEDIATE"), T.all_matches(safe, P.DYNAMIC_LITERAL, 1))

    def plain(literal: Column) -> Column:
        own = literal.startswith("'")
        text = F.when(own, F.substring(literal, F.lit(2), F.length(literal) - 2)).otherwise(F.substring(literal, F.lit(4), F.length(literal) - 5))
        return T.trimmed(F.when(own, F.replace(L.unshield(text), F.lit("''"), F.lit("'"))).otherwise(L.unshield(text)))

    return F.coalesce(F.transform(found, plain), F.array().cast("array<string>"))


def _tagged(texts: Column, origin: str) -> Column:
    return F.transform(texts, lambda s: F.struct(F.lit(origin).alias("origin"), s.alias("sql")))


def statement_structs(safe: Column, dialect: Column) -> Column:
    """All statements of a unit's shielded text: SQL, then each different call, then dynamic literals.

    They are found in the shielded text, so the text of a literal is a statement
    once at most. All happens inside the row: no shuffle is needed and the same
    expression works on a stream.
    """
    return F.concat(
        _tagged(body_statements(safe, dialect), SQL),
        _tagged(F.array_distinct(body_calls(safe)), CALL),
        _tagged(dynamic_literals(safe, dialect), DYNAMIC),
    )


def extract_statements(units: DataFrame) -> DataFrame:
    """One row per statement; the unit's own text is left behind."""
    safe = T.settle(units.select("unit_id", "dialect", "source_code"), {"safe": L.shield(F.col("source_code"))})
    return safe.select(
        "unit_id",
        "dialect",
        F.posexplode(statement_structs(F.col("safe"), F.col("dialect"))).alias("stmt_no", "s"),
    ).select("unit_id", "dialect", F.col("stmt_no").cast("bigint").alias("stmt_no"), "s.origin", "s.sql")


def is_dynamic(sql: Column) -> Column:
    return sql.contains("||") & sql.rlike(P.guarded(P.CONCATENATION))


def main_verb(sql: Column, starts_with: Column) -> Column:
    """The first verb outside all brackets, SELECT if there is none; after FROM only INSERT counts."""

    def of(outside: Column) -> Column:
        return F.when(starts_with == "WITH", T.first_match(outside, P.FIRST_DML)).otherwise(T.first_match(outside, P.MULTI_INSERT))

    return F.coalesce(F.upper(T.bind(F.element_at(L.scopes(L.shield(sql)), -1), of)), F.lit("SELECT"))


def keyword_type(sql: Column, dialect: Column) -> Column:
    return T.bind(
        F.upper(F.regexp_extract(sql, P.FIRST_WORD, 1)),
        lambda word: F.when(word == "SELECT", "SELECT")
        .when((word == "WITH") | ((dialect == P.HIVE) & (word == "FROM")), main_verb(sql, word))
        .when(word.isin(*P.SIMPLE_TYPES), word)
        .when(sql.rlike(P.guarded(P.TRANSACTION_WORD)), F.upper(F.regexp_extract(sql, P.TRANSACTION_WORD, 1)))
        .when(sql.rlike(P.guarded(P.LEADING_CALL)), "CALL")
        .when((dialect == P.HIVE) & word.isin(*P.HIVE_TYPES), word)
        .otherwise("UNKNOWN"),
    )


def fail_reason(sql: Column, kind: Column, dialect: Column) -> Column:
    """Why a statement is rejected, NULL when it is fine."""
    size = F.length(T.trimmed_value(sql))
    is_hive = dialect == P.HIVE
    unchecked = kind.isin(*P.UNCHECKED_TYPES) | (is_hive & kind.isin(*P.HIVE_UNCHECKED_TYPES))
    has_into = F.when(is_hive, sql.rlike(P.guarded(P.HAS_INTO_OR_OVERWRITE))).otherwise(sql.rlike(P.guarded(P.HAS_INTO)))
    return (
        F.when(size == 0, "empty")
        .when(unchecked, None)
        .when(kind == "UNKNOWN", "unrecognised")
        .when(size < 10, F.when(kind.isin("SELECT", "INSERT", "UPDATE", "DELETE"), "too_short"))
        .when((kind == "SELECT") & ~sql.rlike(P.guarded(P.HAS_FROM)), "missing_from")
        .when((kind == "INSERT") & ~has_into, "missing_into")
        .when((kind == "UPDATE") & ~sql.rlike(P.guarded(P.HAS_SET)), "missing_set")
        .when(is_hive & (kind == "LOAD") & ~sql.rlike(P.guarded(P.HAS_INTO_TABLE)), "missing_into_table")
    )


def type_of(sql: Column, dialect: Column, origin: Column | None = None) -> Column:
    """Type by the text; calls found in a body stay CALL."""
    by_text = F.when(is_dynamic(sql), "DYNAMIC_SQL").otherwise(keyword_type(sql, dialect))
    return by_text if origin is None else F.when(origin == CALL, "CALL").otherwise(by_text)


def kept_type(parsed_type: Column, reason: Column) -> Column:
    """A rejected statement keeps its row as UNKNOWN."""
    return F.when(reason.isNull(), parsed_type).otherwise("UNKNOWN")


def classify(statements: DataFrame) -> DataFrame:
    """Add ``parsed_type``, ``fail_reason`` and ``type``.

    ``statements`` has ``dialect``, comment-free ``sql`` and, where statements
    come out of bodies, ``origin``.
    """
    sql, dialect = F.col("sql"), F.col("dialect")
    origin = F.col("origin") if "origin" in statements.columns else None
    typed = T.settle(statements, {"parsed_type": type_of(sql, dialect, origin)})
    checked = T.settle(typed, {"fail_reason": fail_reason(sql, F.col("parsed_type"), dialect)})
    return checked.withColumn("type", kept_type(F.col("parsed_type"), F.col("fail_reason")))


def prepare(statements: DataFrame) -> DataFrame:
    """Single statements as they arrive: strip comments and outer blanks first."""
    return T.settle(statements, {"sql": T.trimmed(T.without_comments(F.col("sql")))})
