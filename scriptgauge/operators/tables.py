"""Table references of statements, as arrays inside the row and as long tables.

A statement is looked at in flat parts: the contents of each bracket, and what
stands outside all of them. A part is one scope. Its FROM clause runs to the next
clause word, and all commas in it part tables; the names that its WITH gives hide
tables of the same name in it and in the brackets inside it, nowhere else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexing as L
from ..functions import patterns as P
from ..functions import text as T
from .statements import statement_structs, type_of

DYNAMIC_TABLE = "DYNAMIC_TABLE"


def _none() -> Column:
    return F.array().cast("array<string>")


def _lowered(names: Column) -> Column:
    return F.array_distinct(F.transform(names, F.lower))


def _names(found: Column) -> Column:
    """Lower-case names without quotes; what stands directly before a bracket is a function, not a table."""
    tables = F.filter(found, lambda name: (name != "") & ~name.endswith(L.OPEN_MARK))
    plain = F.transform(F.transform(tables, T.trimmed), lambda name: F.lower(L.plain_name(name)))
    return F.array_except(plain, F.array(*[F.lit(w) for w in P.NOT_A_TABLE]))


def _outermost_first(parts: Column, body) -> Column:
    """``body(part, index, is_outermost)`` of every part."""
    last = F.size(parts) - 1
    order = F.when(last > 0, F.concat(F.array(last), F.sequence(F.lit(0), last - 1))).otherwise(F.array(F.lit(0)))
    return F.transform(order, lambda i: T.bind(F.get(parts, i), lambda part: body(part, i, i == last)))


def _part_sources(part: Column, outermost: Column, kind: Column) -> Column:
    """Names after FROM, in whole lists, and after JOIN; the outermost part of a MERGE adds USING. Raw: see ``_names``."""

    def of(upper: Column) -> Column:
        joins, is_merge = upper.contains("JOIN"), outermost & (kind == "MERGE")
        text = F.when(T.has_any(upper, "DELETE", "DISTINCT"), F.regexp_replace(part, P.NO_SOURCE, " ")).otherwise(part)
        clauses = F.when(outermost | part.rlike(P.guarded(P.QUERY_PART)), F.array_join(T.all_matches(text, P.FROM_CLAUSE, 1), ",")).when(joins, part)
        items = F.transform(F.split(clauses, P.FROM_ITEM_END), lambda item: F.regexp_extract(item, P.FROM_ITEM, 1))
        joined = F.when(joins, T.all_matches(part, P.JOIN_ITEM, 1))
        using = F.when(is_merge, T.all_matches(part, P.USING_ITEM, 1))
        listed = F.coalesce(items, _none())
        found = F.when(joins | is_merge, F.concat(listed, *[F.coalesce(names, _none()) for names in (joined, using)])).otherwise(listed)
        return F.when(joins | is_merge | upper.contains("FROM"), found).otherwise(_none())

    return T.bind(F.upper(part), of)


def _hidden_names(parts: Column) -> Column:
    """For each part the names that its own WITH and those of all parts around it give."""
    given = F.transform(parts, lambda part: F.when(part.rlike(P.guarded(P.CTE_MARK)), F.transform(T.all_matches(part, P.CTE_NAME, 1), lambda n: F.lower(L.plain_name(n)))).otherwise(_none()))

    def with_inner(inner: Column, part: Column) -> Column:
        children = F.transform(T.all_matches(part, P.CHILD, 1), lambda n: n.cast("int"))
        return F.array_append(inner, F.concat(children, F.flatten(F.transform(children, lambda c: F.get(inner, c)))))

    inner = F.aggregate(parts, F.array().cast("array<array<int>>"), with_inner)

    def around(given: Column, inner: Column) -> Column:
        return F.transform(
            parts,
            lambda _, i: F.flatten(F.transform(inner, lambda inside, k: F.when((k == i) | F.array_contains(inside, i), F.get(given, k)).otherwise(_none()))),
        )

    return T.bind(given, lambda g: T.bind(inner, lambda i: around(g, i)))


def read_names(parts: Column, kind: Column) -> Column:
    """Distinct lower-case names that the parts read, the outermost part's first, without the names that hide them."""

    hides = F.exists(parts, lambda part: part.rlike(P.guarded(P.CTE_MARK)))

    # a statement without brackets is one part
    alone = T.bind(F.get(parts, F.lit(0)), lambda part: _part_sources(part, F.lit(True), kind))
    plain = F.when(F.size(parts) == 1, alone).otherwise(
        F.flatten(_outermost_first(parts, lambda part, i, outermost: _part_sources(part, outermost, kind)))
    )

    def seen(hidden: Column) -> Column:
        def of(part: Column, i: Column, outermost: Column) -> Column:
            return T.bind(
                _part_sources(part, outermost, kind),
                lambda found: F.array_except(_names(found), F.get(hidden, i)),
            )

        return F.flatten(_outermost_first(parts, of))

    return _names(F.when(hides, T.bind(_hidden_names(parts), seen)).otherwise(plain))


def write_names(parts: Column) -> Column:
    """Distinct lower-case targets of INSERT, MERGE, UPDATE and DELETE; INSERT ALL and Hive's INSERT lists have several."""

    def of(part: Column, upper: Column) -> Column:
        text = F.when(upper.contains("DIRECTORY"), F.regexp_replace(part, P.NO_TABLE_TARGET, " ")).otherwise(part)
        many = F.when(text.rlike(P.guarded(P.INSERT_ALL)), T.all_matches(text, P.INTO_TARGET, 1)).otherwise(T.all_matches(text, P.INSERT_TARGET, 1))
        found = [
            F.when(T.has_any(upper, *words), names).otherwise(_none())
            for words, names in (
                (("INTO", "OVERWRITE"), many),
                (("UPDATE",), T.all_matches(text, P.UPDATE_TARGET, 1)),
                (("DELETE",), T.all_matches(text, P.DELETE_TARGET, 1)),
            )
        ]
        return _names(F.concat(*found))

    def targets(part: Column, outermost: Column) -> Column:
        return F.when(outermost | part.rlike(P.guarded(P.DML_PART)), T.bind(F.upper(part), lambda upper: of(part, upper))).otherwise(_none())

    alone = T.bind(F.get(parts, F.lit(0)), lambda part: targets(part, F.lit(True)))
    every = F.flatten(_outermost_first(parts, lambda part, i, outermost: targets(part, outermost)))
    return F.when(F.size(parts) == 1, alone).otherwise(F.array_distinct(every))


def flat_parts(sql: Column) -> Column:
    return L.scopes(L.shield(sql))


def dynamic_names(sql: Column) -> Column:
    """Per piece of a concatenation, the word after FROM and the word after JOIN."""
    pieces = F.transform(F.split(sql, r"\|\|"), lambda piece: T.trimmed(F.regexp_replace(piece, "'", "")))
    found = F.flatten(
        F.transform(
            pieces,
            lambda piece: F.array(
                F.regexp_extract(piece, P.DYNAMIC_FROM, 1), F.regexp_extract(piece, P.DYNAMIC_JOIN, 1)
            ),
        )
    )
    return _lowered(F.filter(found, lambda name: F.length(name) > 0))


def ddl_target(sql: Column, kind: Column) -> Column:
    """Target of CREATE, LOAD, ALTER, ... ; a single chain of literal patterns."""

    def chosen(safe: Column) -> Column:
        result = None
        for name, pattern in P.DDL_TARGET.items():
            value = F.lower(L.plain_name(T.first_match(safe, pattern)))
            result = F.when(kind == name, value) if result is None else result.when(kind == name, value)
        return result

    return F.when(kind.isin(*P.DDL_TARGET), T.bind(L.shield(sql), chosen))


def named_parts(sql: Column, kind: Column, upper: Column | None = None) -> Column:
    """The flat parts of a statement that may name tables, none otherwise."""
    upper = F.upper(sql) if upper is None else upper
    words = T.has_any(upper, "FROM", "JOIN", "USING", "INTO", "OVERWRITE", "UPDATE", "DELETE")
    return F.when(words & (kind != "DYNAMIC_SQL"), flat_parts(sql)).otherwise(_none())


def name_columns(sql: Column, kind: Column, parts: Column) -> dict[str, Column]:
    """``reads``, ``writes`` and ``dynamic_refs`` of a statement by its parsed type."""
    return {
        "reads": F.when(F.size(parts) == 0, _none()).otherwise(read_names(parts, kind)),
        "writes": F.when((F.size(parts) == 0) | (kind == "SELECT"), _none()).otherwise(write_names(parts)),
        "dynamic_refs": F.when(kind == "DYNAMIC_SQL", dynamic_names(sql)).otherwise(_none()),
    }


def with_names(statements: DataFrame) -> DataFrame:
    """Add the name arrays to classified statements."""
    sql, kind = F.col("sql"), F.col("parsed_type")
    cut = T.settle(statements, {"parts": named_parts(sql, kind)})
    return cut.withColumns(name_columns(sql, kind, F.col("parts"))).drop("parts")


def table_list(kind: Column, dialect: Column, reads: Column, writes: Column, dynamic_refs: Column) -> Column:
    """The list a dialect counts: Gauss looks only at the first target of a change."""
    both = F.array_distinct(F.concat(reads, writes))
    first_target = F.slice(writes, 1, 1)
    gauss = (
        F.when(kind.isin("INSERT", "UPDATE", "DELETE"), first_target)
        .when(kind == "MERGE", both)
        .otherwise(F.array().cast("array<string>"))
    )
    return (
        F.when(kind == "SELECT", reads)
        .when(kind == "DYNAMIC_SQL", dynamic_refs)
        .when(dialect == P.GAUSS, gauss)
        .otherwise(both)
    )


def table_count(kind: Column, dialect: Column, names: Column) -> Column:
    """Oracle changes and dynamic statements count at least one table, known or not."""
    at_least_one = (kind == "DYNAMIC_SQL") | ((dialect == P.ORACLE) & (kind != "SELECT"))
    return F.when(at_least_one, F.greatest(F.size(names), F.lit(1))).otherwise(F.size(names)).cast("bigint")


def table_refs(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Long form: one row per statement, table and role (read, write, ddl, dynamic)."""

    def tagged(names: Column, role: str) -> Column:
        return F.transform(names, lambda name: F.struct(name.alias("table_name"), F.lit(role).alias("role")))

    target = ddl_target(F.col("sql"), F.col("parsed_type"))
    ddl = F.when(target.isNotNull(), F.array(target)).otherwise(F.array().cast("array<string>"))
    refs = F.concat(
        tagged(F.col("reads"), "read"),
        tagged(F.col("writes"), "write"),
        tagged(ddl, "ddl"),
        tagged(F.col("dynamic_refs"), "dynamic"),
    )
    return with_names(statements).select(*keys, "dialect", F.explode(refs).alias("r")).select(*keys, "dialect", "r.*")


def write_targets(statements: DataFrame, keys: list[str]) -> DataFrame:
    """First target of each INSERT, UPDATE, DELETE or MERGE, and the source of a MERGE."""
    changes = T.settle(statements.filter(F.col("parsed_type").isin(*P.DML_TYPES)), {"parts": flat_parts(F.col("sql"))})
    outermost = F.element_at("parts", -1)
    source = F.when(F.col("parsed_type") == "MERGE", F.lower(L.plain_name(T.first_match(outermost, P.MERGE_SOURCE))))
    return changes.select(*keys, "dialect", "parsed_type", F.get(write_names(F.col("parts")), F.lit(0)).alias("target"), source.alias("merge_source"))


def ddl_targets(statements: DataFrame, keys: list[str]) -> DataFrame:
    return (
        statements.filter(F.col("parsed_type").isin(*P.DDL_TARGET))
        .select(*keys, "dialect", "parsed_type", ddl_target(F.col("sql"), F.col("parsed_type")).alias("target"))
        .filter("target IS NOT NULL")
    )


def dynamic_table_refs(statements: DataFrame, keys: list[str]) -> DataFrame:
    """Tables inside concatenated SQL; a statement without any keeps a placeholder."""
    names = dynamic_names(F.col("sql"))
    return statements.filter("parsed_type = 'DYNAMIC_SQL'").select(
        *keys,
        "dialect",
        F.explode(F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(DYNAMIC_TABLE)))).alias("table_name"),
    )


def unit_refs(safe: Column, dialect: Column) -> Column:
    """Tables of all statements of a unit, from its shielded text, inside the row."""
    typed = F.transform(
        statement_structs(safe, dialect),
        lambda s: F.struct(s["sql"].alias("sql"), type_of(s["sql"], dialect, s["origin"]).alias("kind")),
    )
    cut = F.transform(typed, lambda s: s.withField("parts", named_parts(s["sql"], s["kind"])))
    return F.array_distinct(F.flatten(F.transform(cut, lambda s: F.concat(*name_columns(s["sql"], s["kind"], s["parts"]).values()))))


def unit_tables(units: DataFrame) -> DataFrame:
    """Distinct tables of a unit, case-insensitive, as one sorted list. No shuffle."""
    safe = T.settle(units.select("unit_id", "dialect", "source_code"), {"safe": L.shield(F.col("source_code"))})
    found = T.settle(safe, {"refs": unit_refs(F.col("safe"), F.col("dialect"))})
    return found.filter(F.size("refs") > 0).select(
        "unit_id", F.size("refs").cast("bigint").alias("table_count"), T.joined(F.col("refs")).alias("table_list")
    )


def type_declaration_tables(units: DataFrame) -> DataFrame:
    """Tables a unit names only in ``table.column%TYPE`` declarations: an anti join inside the row."""
    source = F.col("source_code")
    declaring = units.filter(F.upper(source).contains("%TYPE")).select("unit_id", "dialect", "source_code")
    safe = T.settle(declaring, {"safe": L.shield(source)})
    declared = _lowered(T.all_matches(source, P.TYPE_DECLARATION, 1))
    only = F.array_except(declared, unit_refs(F.col("safe"), F.col("dialect")))
    return safe.select("unit_id", F.explode(only).alias("table_name"))
