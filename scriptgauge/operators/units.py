"""Split scripts into units (procedures, functions, plain scripts) without a shuffle.

Headers are found in the text with shielded quotes, so a keyword or semicolon in a
literal starts or ends nothing and a quoted name is a name. Units get their own
characters back when they are cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexing as L
from ..functions import patterns as P
from ..functions import text as T
from .routing import package_body, with_package

SCRIPT_KEYS = ["script_id", "path", "dialect", "schema_name", "ts", "package_name"]


def without_create(part: F.Column) -> F.Column:
    """A part without the CREATE of the next one at its end."""
    return F.when(F.upper(part).contains("CREATE"), F.regexp_replace(part, P.DANGLING_CREATE, "")).otherwise(part)


def _chunks() -> F.Column:
    """Parts of the shielded text that start at a unit header, in text order."""
    parts = F.filter("pieces", lambda part: part.rlike(P.guarded(P.UNIT_START)))
    whole = F.transform(parts, lambda part: T.trimmed(without_create(part)))
    # the package's own END closes the text, it is not part of the last unit
    return T.bind(
        whole,
        lambda all_parts: F.transform(
            all_parts,
            lambda part, i: F.when(
                (i == F.size(all_parts) - 1) & F.col("closes_package"),
                T.trimmed(F.regexp_replace(part, P.CLOSING_END, "")),
            ).otherwise(part),
        ),
    )


def _unit(key: F.Column, pos: F.Column, kind: F.Column, name: F.Column, source: F.Column, arguments: F.Column) -> F.Column:
    return F.struct(
        F.lower(key).alias("key"),
        pos.cast("bigint").alias("pos"),
        kind.alias("unit_kind"),
        name.alias("unit_name"),
        source.alias("source_code"),
        arguments["least"].alias("least_args"),
        arguments["most"].alias("most_args"),
    )


def _unit_structs(parts: F.Column) -> F.Column:
    """One struct per shielded part, with the range of arguments that its header takes."""

    def unit(part: F.Column, i: F.Column) -> F.Column:
        def of(name: F.Column) -> F.Column:
            kind = F.upper(F.regexp_extract(part, P.UNIT_START, 1))
            return T.bind(arguments, lambda taken: _unit(name, i + 1, kind, name, L.unshield(part), taken))

        arguments = L.argument_range(F.regexp_extract(part, P.UNIT_HEADER_TEXT, 1))
        return T.bind(T.last_segment(F.regexp_extract(part, P.UNIT_START, 2)), lambda name: of(L.plain_name(name)))

    return F.transform(parts, unit)


def _of_each_name(structs: F.Column, overloads: F.Column) -> F.Column:
    """In order of (name, position), the first definition of each name; with ``overloads`` all, the later ones numbered in their key."""

    def numbered(ordered: F.Column, keys: F.Column) -> F.Column:
        def with_number(unit: F.Column, i: F.Column) -> F.Column:
            nth = i + 2 - F.array_position(keys, unit["key"])
            return F.when(nth > 1, unit.withField("key", F.concat(unit["key"], F.lit("#"), nth.cast("string")))).otherwise(unit)

        return F.transform(ordered, with_number)

    def chosen(ordered: F.Column) -> F.Column:
        first = F.filter(ordered, lambda unit, i: (i == 0) | (F.get(ordered, i - 1)["key"] != unit["key"]))
        every = T.bind(F.transform(ordered, lambda unit: unit["key"]), lambda keys: numbered(ordered, keys))
        return F.when(overloads, every).otherwise(first)

    return T.bind(F.sort_array(structs), chosen)


def header_chunks(scripts: DataFrame) -> DataFrame:
    """``pieces``: the shielded text cut before each header; ``chunks``: those that start at a header, declarations included."""
    safe, upper = F.col("safe"), F.upper("safe")
    pieces = F.when(T.has_any(upper, "PROCEDURE", "FUNCTION"), F.split(safe, P.UNIT_SPLIT)).otherwise(F.array(safe))
    return T.settle(with_package(scripts), {"closes_package": package_body(upper, safe), "pieces": pieces}).withColumn("chunks", _chunks())


def chunk_rows(scripts: DataFrame) -> DataFrame:
    chunks = F.transform(
        _unit_structs(F.col("chunks")), lambda unit, i: unit.withField("has_body", F.get(F.col("chunks"), i).rlike(P.guarded(P.UNIT_WITH_BODY)))
    )
    return (
        header_chunks(scripts)
        .select("script_id", "dialect", "package_name", F.posexplode(chunks).alias("i", "u"))
        .select("script_id", "dialect", "package_name", "u.*")
    )


def dropped_parts(scripts: DataFrame) -> DataFrame:
    """What splitting leaves out of a script, with the reason: declarations without a body."""
    base = header_chunks(scripts.filter(F.col("dialect").isin(P.ORACLE, P.GAUSS) & ~T.is_blank(F.col("src"))))
    declared = F.transform(
        F.filter("chunks", lambda part: ~part.rlike(P.guarded(P.UNIT_WITH_BODY))),
        lambda part: F.struct(F.lit("declaration without a body").alias("reason"), L.unshield(part).alias("text")),
    )
    parts = base.select("script_id", "dialect", F.explode(declared).alias("p"))
    return parts.select("script_id", "dialect", "p.reason", F.length("p.text").cast("bigint").alias("chars"), F.md5("p.text").alias("text_hash"))


def _text_before_units(arguments: F.Column, nothing: F.Column) -> F.Column:
    """Statements before the first header are a unit too, at position 0; a package's own declarations are not."""
    first = F.get("pieces", F.lit(0))

    def of(text: F.Column) -> F.Column:
        # a file is often named like its procedure, so the key gets a number of its own
        unit = _unit(F.concat("base_name", F.lit("#0")), F.lit(0), F.lit("SCRIPT"), F.col("base_name"), text, arguments)
        return F.when(F.length(text) > 0, F.array(unit)).otherwise(nothing)

    before = T.bind(T.trimmed(L.unshield(without_create(first))), of)
    return F.when(F.col("package_name").isNull() & ~first.rlike(P.guarded(P.UNIT_START)), before).otherwise(nothing)


def split_units(scripts: DataFrame) -> DataFrame:
    """One row per unit of every script with a known dialect.

    Headers start units; declarations without a body are left out. Of equal names
    Oracle keeps every definition (an overload's key ends in ``#`` and its number),
    the others the first. A text without any header is one unit, and so is a Hive
    script, unless it defines functions. All steps run inside the row, so the texts
    are never shuffled. Text before the first header is a unit as well.
    """
    base = header_chunks(scripts.filter(F.col("dialect").isin(*P.DIALECTS)))
    bodies = F.filter("chunks", lambda part: part.rlike(P.guarded(P.UNIT_WITH_BODY)))
    named = _of_each_name(_unit_structs(bodies), F.col("dialect") == P.ORACLE)
    unknown = F.struct(F.lit(None).cast("bigint").alias("least"), F.lit(None).cast("bigint").alias("most"))

    definitions = T.all_matches(F.col("safe"), P.HIVE_UDF)

    def udf(part: F.Column, i: F.Column) -> F.Column:
        name = L.plain_name(F.regexp_extract(part, P.HIVE_UDF_NAME, 1))
        return _unit(name, i + 1, F.lit("UDF"), name, T.trimmed(L.unshield(part)), unknown)

    udfs = F.transform(definitions, udf)
    whole = F.array(_unit(F.col("base_name"), F.lit(1), F.lit("SCRIPT"), F.col("base_name"), T.trimmed(F.col("clean")), unknown))
    nothing = F.filter(whole, lambda unit: F.lit(False))
    is_hive = F.col("dialect") == P.HIVE
    units = (
        F.when(T.is_blank(F.col("clean")), nothing)
        .when(is_hive & F.col("safe").rlike(P.guarded(P.HIVE_UDF)), _of_each_name(udfs, F.lit(False)))
        .when(is_hive | ~F.col("safe").rlike(P.guarded(P.UNIT_HEADER)), whole)
        .otherwise(F.concat(_text_before_units(unknown, nothing), named))
    )
    return (
        base.select(*SCRIPT_KEYS, F.explode(units).alias("u"))
        .select(*SCRIPT_KEYS, "u.*")
        .withColumn("unit_id", F.concat_ws(":", "script_id", "key"))
        .withColumn("qualified_name", F.concat_ws(".", "package_name", "unit_name"))
        .drop("key")
    )


def hive_function_units(scripts: DataFrame) -> DataFrame:
    return split_units(scripts.filter(F.col("dialect") == P.HIVE))
