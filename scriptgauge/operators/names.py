"""Names used in calls, matched against user lists by equality joins.

The lists are plain DataFrames. No join is forced to broadcast: Spark picks a
broadcast only when the list's size is below its threshold and otherwise uses a
shuffle join whose skewed keys are split at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing as L
from ..functions import patterns as P
from ..functions import text as T
from ..functions.names import BUILTINS
from .tables import with_names

EXECUTE_IMMEDIATE = "EXECUTE_IMMEDIATE"


def clean_list(names: DataFrame) -> DataFrame:
    """Trim, drop empty lines, upper-case, keep each name once."""
    name = F.upper(T.trimmed(F.col("name")))
    return names.select(name.alias("name")).filter(F.length("name") > 0).distinct()


def name_flags(functions: DataFrame, tables: DataFrame, procedures: DataFrame) -> DataFrame:
    """The three lists as one table, so that a single join answers for all of them."""
    parts = [
        clean_list(names).select("name", *[F.lit(label == own).alias(label) for label in ("is_function", "is_table", "is_procedure")])
        for own, names in (("is_function", functions), ("is_table", tables), ("is_procedure", procedures))
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.groupBy("name").agg(*[F.bool_or(c).alias(c) for c in ("is_function", "is_table", "is_procedure")])


def called_suffixes(safe: Column) -> Column:
    """Upper-case dotted suffixes of every name in front of a parenthesis of a shielded text, once per call site."""
    called = F.transform(T.all_matches(safe, P.CALLED_NAME, 1), lambda name: F.upper(L.plain_name(name)))
    return F.flatten(F.transform(called, T.suffixes))


def call_sites(safe: Column, dialect: Column, unit_name: Column) -> Column:
    """Calls of procedures as structs (name, args, depth) with upper-case names, without built-ins and self calls.

    ``safe`` is a unit's shielded text. A call counts wherever it stands, also among another call's arguments. Hive
    knows only CALL, whose arguments are not looked at.
    """

    def without_builtins(found: Column, builtins: list[str]) -> Column:
        builtin = f"^(?:{'|'.join(builtins)})(?:[.]|$)"
        return F.filter(found, lambda call: call["name"].rlike(P.VALID_NAME) & ~call["name"].rlike(builtin))

    walked = F.transform(
        L.calls(F.regexp_replace(safe, P.INTO_NAME, " ")), lambda call: call.withField("name", F.upper(L.plain_name(call["name"])))
    )
    unknown = F.lit(None).cast("bigint")
    stated = F.transform(
        T.all_matches(F.upper(safe), P.HIVE_CALL, 1), lambda name: F.struct(name.alias("name"), unknown.alias("args"), unknown.alias("depth"))
    )
    procedural = T.bind(
        F.when(dialect != P.HIVE, walked),
        lambda calls: T.by_dialect(dialect, {d: without_builtins(calls, BUILTINS[d]) for d in (P.ORACLE, P.GAUSS)}),
    )
    found = F.when(dialect == P.HIVE, stated).otherwise(procedural)
    return F.filter(found, lambda call: T.last_segment(call["name"]) != F.upper(unit_name))


def called(safe: Column, source: Column, dialect: Column, unit_name: Column) -> Column:
    """Calls as structs (name, args), and one of unknown arguments per EXECUTE IMMEDIATE."""
    dynamic = F.when(dialect == P.HIVE, 0).otherwise(F.regexp_count(source, F.lit(P.EXECUTE_IMMEDIATE)))
    others = F.transform(call_sites(safe, dialect, unit_name), lambda call: F.struct(call["name"].alias("name"), call["args"].alias("args")))
    return F.concat(others, F.array_repeat(F.struct(F.lit(EXECUTE_IMMEDIATE).alias("name"), F.lit(None).cast("bigint").alias("args")), dynamic))


def called_names(safe: Column, source: Column, dialect: Column, unit_name: Column) -> Column:
    """Upper-case names of called procedures, one entry per call."""
    return F.transform(called(safe, source, dialect, unit_name), lambda call: call["name"])


def _with_safe(units: DataFrame, *columns: str) -> DataFrame:
    return T.settle(units.select(*columns, "source_code"), {"safe": L.shield(F.col("source_code"))})


def table_segments(names: Column) -> Column:
    """Whole upper-case names and each of their dotted parts."""
    upper = F.transform(names, F.upper)
    return F.array_distinct(F.concat(upper, F.flatten(F.transform(upper, lambda name: F.split(name, r"\.")))))


def custom_function_calls(units: DataFrame, functions: DataFrame) -> DataFrame:
    called = _with_safe(units, "unit_id").select("unit_id", F.explode(called_suffixes(F.col("safe"))).alias("name"))
    return called.join(clean_list(functions), "name").groupBy("unit_id", "name").agg(F.count("*").alias("n"))


def high_weight_tables(statements: DataFrame, tables: DataFrame) -> DataFrame:
    """Number of statements per unit that touch a listed table."""
    refs = F.concat("reads", "writes", "dynamic_refs")
    used = with_names(statements).select("unit_id", F.explode(table_segments(refs)).alias("name"))
    return used.join(clean_list(tables), "name").groupBy("unit_id", "name").agg(F.count("*").alias("n"))


def unit_calls(units: DataFrame, *columns: str) -> DataFrame:
    """The calls of each unit as one array ``calls`` beside ``columns``; the text is left behind."""
    calls = called(F.col("safe"), F.col("source_code"), F.col("dialect"), F.col("unit_name"))
    needed = dict.fromkeys([*columns, "dialect", "unit_name"])
    return _with_safe(units, *needed).select(*columns, calls.alias("calls"))


def nested_calls(units: DataFrame, functions: DataFrame) -> DataFrame:
    """(unit_id, callee, n) without custom functions; Hive counts every CALL."""
    return counted_calls(unit_calls(units, "unit_id", "dialect"), functions)


def counted_calls(units: DataFrame, functions: DataFrame, keys: tuple[str, ...] = ("unit_id",), by_args: bool = False) -> DataFrame:
    """Of units with their ``calls``, (unit, callee, n) without custom functions; Hive counts every CALL. ``by_args`` parts the calls by their number of arguments.

    The calls of a unit sit in one row, so the count is complete before the
    shuffle and the join with the list sees each callee once per unit.
    """
    what = ("callee", "args") if by_args else ("callee",)
    found = units.select(*keys, "dialect", F.explode("calls").alias("call"))
    listed = clean_list(functions).select(F.col("name").alias("callee"), F.lit(True).alias("listed"))
    return (
        found.select(*keys, "dialect", F.col("call.name").alias("callee"), F.col("call.args").alias("args"))
        .groupBy(*keys, "dialect", *what)
        .agg(F.count("*").alias("n"))
        .join(listed, "callee", "left")
        .filter((F.col("dialect") == P.HIVE) | F.col("listed").isNull())
        .select(*keys, *what, "n")
    )


def call_table(units: DataFrame) -> DataFrame:
    """(unit_id, callee, args, depth, n): every call with its number of arguments and how many brackets stand around it."""
    calls = call_sites(F.col("safe"), F.col("dialect"), F.col("unit_name"))
    found = _with_safe(units, "unit_id", "dialect", "unit_name").select("unit_id", F.explode(calls).alias("call"))
    return found.groupBy("unit_id", F.col("call.name").alias("callee"), F.col("call.args").alias("args"), F.col("call.depth").alias("depth")).agg(F.count("*").alias("n"))


def high_weight_procedures(calls: DataFrame, procedures: DataFrame) -> DataFrame:
    return calls.join(clean_list(procedures), F.col("callee") == F.col("name")).select("unit_id", "callee", "n")
