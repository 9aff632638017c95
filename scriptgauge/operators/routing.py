"""Route scripts by kind, name them, and set aside what cannot be measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import lexing as L
from ..functions import text as T

DEFAULT_SCHEMA, DEFAULT_DIALECT = "HR", P.ORACLE


def fill_defaults(scripts: DataFrame) -> DataFrame:
    return scripts.withColumn("schema_name", F.coalesce("schema_name", F.lit(DEFAULT_SCHEMA))).withColumn(
        "dialect", F.coalesce("dialect", F.lit(DEFAULT_DIALECT))
    )


def base_name(path):
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), P.SQL_SUFFIX, "")


def route(scripts: DataFrame) -> DataFrame:
    """Add ``kind`` (PACKAGE, PROCEDURE or SQL) by keyword and ``base_name`` from the path."""
    upper = F.upper("src")
    creates = upper.contains("CREATE")
    kind = (
        F.when(creates & upper.contains("PACKAGE") & upper.contains("BODY"), "PACKAGE")
        .when(creates & (upper.contains("PROCEDURE") | upper.contains("FUNCTION")), "PROCEDURE")
        .otherwise("SQL")
    )
    return scripts.withColumn("kind", kind).withColumn("base_name", base_name(F.col("path")))


def package_body(upper, clean):
    return upper.contains("PACKAGE") & clean.rlike(P.guarded(P.PACKAGE_BODY))


def package_flag(dialect, clean):
    """Is the shielded text a package body? Hive has none; Gauss also accepts several units in one text."""
    upper = F.upper(clean)
    body = package_body(upper, clean)
    headers = T.count_if(upper, clean, P.PROCEDURE_HEADER, "PROCEDURE") + T.count_if(upper, clean, P.FUNCTION_HEADER, "FUNCTION")
    named = upper.contains("END ") & (upper.contains("PKG_") | upper.contains("_PKG"))
    gauss = named | (upper.contains("PACKAGE") & clean.rlike(P.guarded(P.PACKAGE_ANY))) | (headers > 1)
    return F.coalesce(T.by_dialect(dialect, {P.ORACLE: body, P.GAUSS: gauss}), F.lit(False))


def package_name(clean, fallback):
    return F.coalesce(L.plain_name(T.first_match(clean, P.PACKAGE_BODY_NAME)), T.first_match(clean, P.PACKAGE_END_NAME), fallback)


def with_package(scripts: DataFrame) -> DataFrame:
    """Add the comment-free text, the same with shielded quotes (``safe``), whether it is a package, and the package's name."""
    clean = T.settle(
        scripts, {"clean": T.without_comments(F.col("src")), "base_name": base_name(F.col("path"))}
    )
    safe = T.settle(clean, {"safe": L.shield(F.col("clean"))})
    flagged = T.settle(safe, {"is_package": package_flag(F.col("dialect"), F.col("safe"))})
    return flagged.withColumn(
        "package_name", F.when(F.col("is_package"), package_name(F.col("safe"), F.col("base_name")))
    )


def failure_reason(dialect, src):
    return (
        F.when(dialect.isNull() | ~dialect.isin(*P.DIALECTS), "unknown_dialect")
        .when(T.is_blank(src), "empty_source")
        .when(T.is_blank(T.without_comments(src)), "only_comments")
    )


def split_failed(scripts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scripts that can be measured and, with a reason, those that cannot. Nothing is dropped silently."""
    marked = T.settle(scripts, {"fail_reason": failure_reason(F.col("dialect"), F.col("src"))})
    return marked.filter("fail_reason IS NULL").drop("fail_reason"), marked.filter("fail_reason IS NOT NULL")
