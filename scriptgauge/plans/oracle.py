"""SQL counterparts of the registered queries, for an engine with list functions.

Written from the definitions and not from the Spark plans: sets become explicit
groupings, scores become a join with the long weight table, chain depth comes
from a reachability closure. Only patterns and the corpus expression are shared.
"""

from __future__ import annotations

from ..functions import lexing as L
from ..functions import patterns as P
from ..functions import weights as W
from ..functions.names import BUILTINS
from ..sources import corpus


# --- small pieces of SQL ---------------------------------------------------
def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(pattern: str) -> str:
    return lit(P.portable(pattern))


def every(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {rx(pattern)}, {group})"


def count(text: str, pattern: str) -> str:
    return f"CAST(len({every(text, pattern)}) AS BIGINT)"


def one(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {rx(pattern)}, {group}), '')"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {rx(pattern)})"


def sub(text: str, pattern: str, to: str) -> str:
    return f"regexp_replace({text}, {rx(pattern)}, {lit(to)}, 'g')"


def trim(text: str) -> str:
    return f"trim({text}, ' ' || chr(9) || chr(13) || chr(10))"


def strip(text: str) -> str:
    return sub(sub(text, P.BLOCK_COMMENT, ""), P.LINE_COMMENT, "")


def lines(text: str) -> str:
    return f"CASE WHEN {trim(text)} = '' THEN 0 ELSE {count(sub(text, P.TRAILING_BREAKS, ''), P.LINE_BREAK)} + 1 END"


def distinct(names: str) -> str:
    return f"list_filter({names}, lambda x, i: list_position({names}, x) = i)"


def lower_all(names: str) -> str:
    return f"list_transform({names}, lambda x: lower(x))"


def joined(names: str) -> str:
    return f"array_to_string(list_sort({names}), ',')"


def last(name: str) -> str:
    return f"list_extract(str_split({name}, '.'), -1)"


def values(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


def listed(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def shield(text: str) -> str:
    """Stand-ins for all characters inside quotes; the corpus has no dollar quotes."""

    def inner(first: int, last: int) -> str:
        return f"substr(t, 1, {first}) || translate(substr(t, {first + 1}, length(t) - {first + last}), {lit(L.PLAIN)}, {lit(L.STAND_INS)}) || substr(t, length(t) - {last - 1}, {last})"

    return f"""CASE WHEN {has(text, P.ANY_QUOTE)} THEN array_to_string(list_transform({every(text, P.QUOTED_OR_PLAIN)}, lambda t:
      CASE WHEN length(t) > 1 AND starts_with(t, '{"''"}') THEN {inner(1, 1)}
           WHEN length(t) > 1 AND (starts_with(t, '"') OR starts_with(t, '`')) THEN translate(t, {lit(L.PLAIN)}, {lit(L.STAND_INS)})
           WHEN {has('t', P.Q_QUOTE_START)} THEN {inner(2, 1)} ELSE t END), '') ELSE {text} END"""


def unshield(text: str) -> str:
    return f"translate({text}, {lit(L.STAND_INS)}, {lit(L.PLAIN)})"


def named(text: str) -> str:
    return f"regexp_replace({unshield(text)}, {rx(P.NAME_QUOTES)}, '', 'g')"


def flat(text: str) -> str:
    """Brackets replaced by a mark, inner ones first; six levels, more than the corpus has."""
    for _ in range(6):
        text = f"regexp_replace({text}, {rx(P.INNERMOST)}, {lit(L.OPEN_MARK + '0' + L.CLOSE_MARK)}, 'g')"
    return text


def peak(steps: str) -> str:
    """Running sum clamped at zero; level and peak travel in one number."""
    level = "greatest(0, a % 100000 + x)"
    return f"(list_reduce({steps}, lambda a, x: {level} + greatest(a // 100000, {level}) * 100000, CAST(0 AS BIGINT)) // 100000)"


CTE: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, needs: tuple[str, ...], sql: str) -> None:
    CTE[name] = (needs, sql)


def build(final: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for other in CTE[name][0]:
                visit(other)
            order.append(name)

    for name in needs:
        visit(name)
    head = ",\n".join(f"{name} AS ({CTE[name][1]})" for name in order)
    return f"WITH RECURSIVE {head}\n{final}" if head else final


# --- inputs ----------------------------------------------------------------
cte("scripts", (), corpus.CORPUS_SCRIPTS)
cte("procedure_scripts", (), corpus.CORPUS_PROCEDURES)
cte("package_scripts", (), corpus.CORPUS_PACKAGES)
cte("second_scripts", (), corpus.CORPUS_SCRIPTS_V2)
cte("raw_statements", (), corpus.CORPUS_STATEMENTS)
cte("feedback_lines", (), corpus.FEEDBACK)
for _name, _sql in (("functions", corpus.LIST_FUNCTIONS), ("tables", corpus.LIST_TABLES), ("procedures", corpus.LIST_PROCEDURES)):
    cte("l_" + _name, (), f"SELECT DISTINCT upper({trim('name')}) AS name FROM ({_sql}) WHERE {trim('name')} <> ''")
cte(
    "weights",
    (),
    "SELECT * FROM (VALUES " + ", ".join(f"({lit(d)}, {lit(f)}, CAST({w} AS DOUBLE))" for d, f, w in W.rows()) + ") AS t(dialect, factor, weight)",
)

# a bracket behind a word, the word alone, and one flat bracket at the start
WORD_BRACKET, KEEP, FLAT_LIST = r"(\w)\s*\([^()]*\)", r"\1", r"^\s*\(([^()]*)\)"
BASE_NAME = f"regexp_replace(list_extract(str_split(path, '/'), -1), {rx(P.SQL_SUFFIX)}, '')"


# --- scripts to units ------------------------------------------------------
def unit_ctes(tag: str, source: str) -> None:
    """clean<tag>, chunks<tag> and units<tag> from the script table ``source``."""
    procedures, functions = count("safe", P.PROCEDURE_HEADER), count("safe", P.FUNCTION_HEADER)
    cte(
        "clean" + tag,
        (source,),
        f"""
SELECT *, CASE WHEN is_package THEN coalesce({named(one('safe', P.PACKAGE_BODY_NAME))}, {one('safe', P.PACKAGE_END_NAME)}, base_name) END AS package_name
FROM (
  SELECT *, CASE dialect
    WHEN 'Oracle' THEN {has('safe', P.PACKAGE_BODY)}
    WHEN 'Gauss' THEN {has('safe', P.PACKAGE_BODY)} OR {has('safe', P.PACKAGE_ANY)} OR {procedures} > 1 OR {functions} > 1
      OR ({procedures} > 0 AND {functions} > 0)
      OR (contains(upper(safe), 'END ') AND (contains(upper(safe), 'PKG_') OR contains(upper(safe), '_PKG')))
    ELSE FALSE END AS is_package
  FROM (SELECT *, {shield('clean')} AS safe FROM (SELECT *, {strip('src')} AS clean, {BASE_NAME} AS base_name FROM {source}))
)""",
    )
    header = P.UNIT_SPLIT.replace("(?=", "(")
    marked = f"regexp_replace(safe, {rx(header)}, chr(1) || {lit(chr(92) + '1')}, 'g')"
    cte(
        "before_units" + tag,
        ("clean" + tag,),
        f"""
SELECT script_id, dialect, {trim(unshield(f"regexp_replace(part, {rx(P.DANGLING_CREATE)}, '')"))} AS part
FROM (SELECT *, str_split({marked}, chr(1))[1] AS part FROM clean{tag})
WHERE package_name IS NULL AND {has('safe', P.UNIT_HEADER)} AND NOT {has('part', P.UNIT_START)}""",
    )
    # brackets of types inside the parameter list go first, then the list is flat
    listed_args = f"regexp_extract({sub(sub('head', WORD_BRACKET, KEEP), WORD_BRACKET, KEEP)}, {rx(FLAT_LIST)}, 1)"
    cte(
        "chunks" + tag,
        ("clean" + tag,),
        f"""
SELECT * EXCLUDE (head, args), len(args) AS most_args, len(list_filter(args, lambda x: NOT {has('x', P.HAS_DEFAULT)})) AS least_args
FROM (SELECT *, list_filter(str_split({listed_args}, ','), lambda x: {has('x', P.VISIBLE)}) AS args
FROM (
SELECT script_id, dialect, package_name, pos, regexp_extract(shielded, {rx(P.UNIT_START)}, 1) AS kind, regexp_extract(shielded, {rx(P.UNIT_HEADER_TEXT)}, 1) AS head,
       {named(last(f"regexp_extract(shielded, {rx(P.UNIT_START)}, 2)"))} AS unit_name, {unshield('shielded')} AS text, {has('shielded', P.UNIT_WITH_BODY)} AS has_body
FROM (
  SELECT script_id, dialect, package_name, pos,
         CASE WHEN closes AND pos = n THEN {trim(f"regexp_replace(part, {rx(P.CLOSING_END)}, '')")} ELSE part END AS shielded
  FROM (
    SELECT script_id, dialect, package_name, {has('safe', P.PACKAGE_BODY)} AS closes,
           {trim(f"regexp_replace(part, {rx(P.DANGLING_CREATE)}, '')")} AS part,
           row_number() OVER (PARTITION BY script_id ORDER BY i) AS pos, count(*) OVER (PARTITION BY script_id) AS n
    FROM (
      SELECT script_id, dialect, package_name, safe, unnest(parts) AS part, generate_subscripts(parts, 1) AS i
      FROM (SELECT *, str_split({marked}, chr(1)) AS parts FROM clean{tag})
    ) WHERE {has('part', P.UNIT_START)}
  )
)))""",
    )
    known = f"dialect IN {values(P.DIALECTS)} AND {trim('clean')} <> ''"
    cte(
        "units" + tag,
        ("clean" + tag, "chunks" + tag, "before_units" + tag),
        f"""
SELECT u.script_id || ':' || u.key AS unit_id, u.*, c.path, c.schema_name, c.ts, c.package_name,
       concat_ws('.', c.package_name, u.unit_name) AS qualified_name
FROM (
  SELECT * REPLACE (CASE WHEN take > 1 THEN key || '#' || take ELSE key END AS key) FROM (
    SELECT script_id, dialect, lower(unit_name) AS key, upper(kind) AS unit_kind, unit_name, pos, text AS source_code, least_args, most_args,
           row_number() OVER (PARTITION BY script_id, lower(unit_name) ORDER BY pos) AS take
    FROM (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY script_id ORDER BY pos) AS pos
          FROM chunks{tag} WHERE has_body AND dialect IN ('Oracle', 'Gauss'))
    UNION ALL
    SELECT script_id, dialect, lower(base_name) || '#0', 'SCRIPT', base_name, 0, part, NULL, NULL, 1
    FROM before_units{tag} JOIN (SELECT script_id, base_name FROM clean{tag}) USING (script_id) WHERE part <> '' AND dialect IN ('Oracle', 'Gauss')
    UNION ALL
    SELECT script_id, 'Hive', lower(name), 'UDF', name, pos, {trim(unshield('part'))}, NULL, NULL, row_number() OVER (PARTITION BY script_id, lower(name) ORDER BY pos)
    FROM (SELECT script_id, part, pos, {named(one('part', P.HIVE_UDF_NAME))} AS name
          FROM (SELECT script_id, unnest(found) AS part, generate_subscripts(found, 1) AS pos
                FROM (SELECT script_id, {every('safe', P.HIVE_UDF)} AS found FROM clean{tag} WHERE dialect = 'Hive')))
    UNION ALL
    SELECT script_id, dialect, lower(base_name), 'SCRIPT', base_name, 1, {trim('clean')}, NULL, NULL, 1 FROM clean{tag}
    WHERE {known} AND CASE WHEN dialect = 'Hive' THEN NOT {has('safe', P.HIVE_UDF)} ELSE NOT {has('safe', P.UNIT_HEADER)} END
  ) WHERE take = 1 OR dialect = 'Oracle'
) u JOIN clean{tag} c USING (script_id)""",
    )


unit_ctes("", "scripts")
unit_ctes("_pk", "package_scripts")
unit_ctes("_v1", "procedure_scripts")
unit_ctes("_v2", "second_scripts")


# --- statements ------------------------------------------------------------
def statement_ctes(tag: str, source: str, keys: str, origin: bool) -> None:
    """typed<tag>, named<tag> and feat<tag> from a table of (keys, dialect, sql[, origin])."""
    word = f"upper(regexp_extract(sql, {rx(P.FIRST_WORD)}, 1))"
    call = "WHEN origin = 'call' THEN 'CALL'" if origin else ""
    parsed = f"""CASE {call} WHEN {has('sql', P.CONCATENATION)} THEN 'DYNAMIC_SQL'
      WHEN {word} = 'SELECT' THEN 'SELECT' WHEN {word} = 'WITH' THEN coalesce(upper({one('outside', P.FIRST_DML)}), 'SELECT')
      WHEN dialect = 'Hive' AND {word} = 'FROM' THEN coalesce(upper({one('outside', P.MULTI_INSERT)}), 'SELECT') WHEN {word} IN {values(P.SIMPLE_TYPES)} THEN {word}
      WHEN {has('sql', P.TRANSACTION_WORD)} THEN upper(regexp_extract(sql, {rx(P.TRANSACTION_WORD)}, 1))
      WHEN {has('sql', P.LEADING_CALL)} THEN 'CALL'
      WHEN dialect = 'Hive' AND {word} IN {values(P.HIVE_TYPES)} THEN {word} ELSE 'UNKNOWN' END"""
    reason = f"""CASE WHEN {trim('sql')} = '' THEN 'empty'
      WHEN parsed_type IN {values(P.UNCHECKED_TYPES)} OR (dialect = 'Hive' AND parsed_type IN {values(P.HIVE_UNCHECKED_TYPES)}) THEN NULL
      WHEN parsed_type = 'UNKNOWN' THEN 'unrecognised'
      WHEN length({trim('sql')}) < 10 THEN CASE WHEN parsed_type IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE') THEN 'too_short' END
      WHEN parsed_type = 'SELECT' AND NOT {has('sql', P.HAS_FROM)} THEN 'missing_from'
      WHEN parsed_type = 'INSERT' AND dialect <> 'Hive' AND NOT {has('sql', P.HAS_INTO)} THEN 'missing_into'
      WHEN parsed_type = 'INSERT' AND dialect = 'Hive' AND NOT {has('sql', P.HAS_INTO_OR_OVERWRITE)} THEN 'missing_into'
      WHEN parsed_type = 'UPDATE' AND NOT {has('sql', P.HAS_SET)} THEN 'missing_set'
      WHEN dialect = 'Hive' AND parsed_type = 'LOAD' AND NOT {has('sql', P.HAS_INTO_TABLE)} THEN 'missing_into_table' END"""
    cte(
        "peel" + tag,
        (source,),
        f"""
SELECT sql, {shield('sql')} AS text, CAST([] AS VARCHAR[]) AS parts FROM (SELECT DISTINCT sql FROM {source})
UNION ALL
SELECT sql, array_to_string(list_transform(pieces, lambda p, i: p || CASE WHEN i < len(pieces) THEN {lit(L.OPEN_MARK)} || CAST(len(parts) + i - 1 AS VARCHAR) || {lit(L.CLOSE_MARK)} ELSE '' END), ''),
       parts || {every('text', P.INNERMOST, 1)}
FROM (SELECT *, regexp_split_to_array(text, {rx(P.INNERMOST)}) AS pieces FROM peel{tag} WHERE {has('text', P.INNERMOST)})""",
    )
    cte(
        "typed" + tag,
        (source, "peel" + tag),
        f"""
SELECT *, CASE WHEN fail_reason IS NULL THEN parsed_type ELSE 'UNKNOWN' END AS type
FROM (SELECT *, {reason} AS fail_reason FROM (SELECT *, {parsed} AS parsed_type
  FROM {source} JOIN (SELECT sql, text AS outside, [text] || parts AS parts FROM peel{tag} WHERE NOT {has('text', P.INNERMOST)}) USING (sql)))""",
    )
    # the outermost part stands first in ``parts`` here; a name given by WITH hides tables in the whole statement
    tables_of = lambda found: f"list_transform(list_filter({found}, lambda n: n <> '' AND NOT {has('n', P.IS_CALL)}), lambda n: lower({named(trim('n'))}))"
    no_source = sub("p", P.NO_SOURCE, " ")
    clauses = f"CASE WHEN i = 1 OR {has('p', P.QUERY_PART)} THEN {every(no_source, P.FROM_CLAUSE, 1)} WHEN contains(upper(p), 'JOIN') THEN [p] ELSE [] END"
    items = f"flatten(list_transform({clauses}, lambda c: list_transform(regexp_split_to_array(c, {rx(P.FROM_ITEM_END)}), lambda x: regexp_extract(x, {rx(P.FROM_ITEM)}, 1))))"
    using = f"CASE WHEN i = 1 AND parsed_type = 'MERGE' THEN {every('p', P.USING_ITEM, 1)} ELSE [] END"
    sources = f"list_transform(parts, lambda p, i: {tables_of(f'({items}) || {every(chr(112), P.JOIN_ITEM, 1)} || {using}')})"
    ctes = f"flatten(list_transform(parts, lambda p: CASE WHEN {has('p', P.CTE_MARK)} THEN list_transform({every('p', P.CTE_NAME, 1)}, lambda n: lower({named('n')})) ELSE [] END))"
    no_target = sub("p", P.NO_TABLE_TARGET, " ")
    inserts = f"CASE WHEN {has('p', P.INSERT_ALL)} THEN {every(no_target, P.INTO_TARGET, 1)} ELSE {every(no_target, P.INSERT_TARGET, 1)} END"
    targets = f"({inserts}) || {every(no_target, P.UPDATE_TARGET, 1)} || {every(no_target, P.DELETE_TARGET, 1)}"
    writes = f"flatten(list_transform(parts, lambda p, i: CASE WHEN i = 1 OR {has('p', P.DML_PART)} THEN {tables_of(targets)} ELSE [] END))"
    words = " OR ".join(f"contains(upper(sql), '{w}')" for w in ("FROM", "JOIN", "USING", "INTO", "OVERWRITE", "UPDATE", "DELETE"))
    pieces = f"list_transform(str_split(sql, '||'), lambda p: {trim('replace(p, chr(39), ' + lit('') + ')')})"
    dynamic = f"flatten(list_transform({pieces}, lambda p: [regexp_extract(p, {rx(P.DYNAMIC_FROM)}, 1), regexp_extract(p, {rx(P.DYNAMIC_JOIN)}, 1)]))"
    cte(
        "named" + tag,
        ("typed" + tag,),
        f"""
SELECT * EXCLUDE (r0, w0, d0, c0, parts, outside),
       CASE WHEN parsed_type = 'DYNAMIC_SQL' OR NOT ({words}) THEN []
            ELSE list_filter({distinct('r0')}, lambda x: NOT list_contains(c0, x) AND NOT list_contains({listed(P.NOT_A_TABLE)}, x)) END AS reads,
       CASE WHEN parsed_type IN ('DYNAMIC_SQL', 'SELECT') THEN [] ELSE list_filter({distinct('w0')}, lambda x: NOT list_contains({listed(P.NOT_A_TABLE)}, x)) END AS writes,
       CASE WHEN parsed_type = 'DYNAMIC_SQL' THEN {distinct('d0')} ELSE [] END AS dynamic_refs
FROM (
  SELECT *, flatten({sources}) AS r0, {writes} AS w0, {ctes} AS c0,
         list_filter({lower_all(dynamic)}, lambda x: x <> '') AS d0
  FROM typed{tag}
)""",
    )
    sel = "type = 'SELECT'"

    def feature(oracle: str, gauss: str | None = None, hive: str | None = None) -> str:
        by = {"Oracle": oracle, "Gauss": gauss or oracle, "Hive": hive or gauss or oracle}
        return "CASE WHEN type <> 'SELECT' THEN 0 " + " ".join(f"WHEN dialect = {lit(d)} THEN {count('sql', p)}" for d, p in by.items()) + " END"

    hive_extra = ", ".join(
        f"CASE WHEN {sel} AND dialect = 'Hive' THEN {count('sql', p)} ELSE 0 END AS {n}" for n, p in P.HIVE_EXTRA.items()
    )
    where_flag = "CASE WHEN contains(upper(sql), 'WHERE') THEN 1 ELSE 0 END"
    both = distinct("rw")
    cte(
        "feat" + tag,
        ("named" + tag,),
        f"""
SELECT *, CASE WHEN type = 'DYNAMIC_SQL' OR (dialect = 'Oracle' AND type <> 'SELECT') THEN greatest(len(table_names), 1) ELSE len(table_names) END AS "table",
       CASE WHEN type <> 'SELECT' THEN 0 WHEN dialect = 'Oracle' THEN CASE WHEN subquery > 0 THEN 2 ELSE 1 END ELSE subquery + 1 END AS query_depth
FROM (
  SELECT *, {feature(P.JOIN)} AS "join",
    CASE WHEN type = 'DYNAMIC_SQL' THEN 0 WHEN type <> 'SELECT' OR dialect = 'Gauss' THEN {where_flag}
         WHEN dialect = 'Oracle' THEN CASE WHEN contains(upper(sql), 'WHERE') THEN {count('sql', P.AND_OR)} + 1 ELSE 0 END
         ELSE {count('sql', P.WHERE)} END AS where_condition,
    {feature(P.SUBQUERY)} AS subquery, {feature(P.AGGREGATE, P.AGGREGATE, P.HIVE_AGGREGATE)} AS aggregate_function,
    {feature(P.CASE)} AS case_expression, {feature(P.ORACLE_SET_OPERATION, P.SET_OPERATION)} AS set_operation,
    {feature(P.GROUP_BY)} AS group_by, {feature(P.ORDER_BY)} AS order_by, {hive_extra}, {lines('sql')} AS line_count,
    CASE WHEN type = 'SELECT' THEN reads WHEN type = 'DYNAMIC_SQL' THEN dynamic_refs
         WHEN dialect = 'Gauss' THEN CASE WHEN type IN ('INSERT', 'UPDATE', 'DELETE') THEN writes[1:1] WHEN type = 'MERGE' THEN {both} ELSE [] END
         ELSE {both} END AS table_names
  FROM (SELECT *, reads || writes AS rw FROM named{tag})
)""",
    )
    scored = ", ".join(f"({lit(f)}, CAST(\"{f}\" AS BIGINT))" for f in SCORED)
    cte(
        "long" + tag,
        ("feat" + tag,),
        f"""SELECT {keys}, dialect, type, feature, n FROM feat{tag}, LATERAL (VALUES {scored}) AS v(feature, n) WHERE n > 0""",
    )
    cte(
        "score" + tag,
        ("feat" + tag, "long" + tag, "weights"),
        f"""
SELECT {keys}, f.dialect, f.type, CASE
    WHEN f.type = 'SELECT' THEN coalesce(s.total, 0)
    WHEN f.type = 'DYNAMIC_SQL' THEN log10(length(f.sql)) * 5 * (1 + f."table" * 0.1)
    WHEN f.dialect = 'Oracle' THEN log10(length(f.sql)) * 5 * CASE f.type WHEN 'UPDATE' THEN 1.2 WHEN 'DELETE' THEN 1.1 WHEN 'MERGE' THEN 1.5 ELSE 1.0 END
    ELSE f."table" * CASE f.dialect WHEN 'Gauss' THEN 10.0 ELSE 1.0 END END AS score
FROM feat{tag} f LEFT JOIN (
  SELECT {keys}, sum(n * weight) AS total FROM long{tag} l JOIN weights w ON w.dialect = l.dialect AND w.factor = l.feature
  WHERE type = 'SELECT' GROUP BY ALL
) s USING ({keys})""",
    )


SCORED = [
    "table", "join", "where_condition", "subquery", "aggregate_function", "case_expression", "set_operation",
    "group_by", "order_by", *P.HIVE_EXTRA,
]

cte("statements", ("raw_statements",), f"SELECT stmt_id, dialect, {trim(strip('sql'))} AS sql FROM raw_statements")
statement_ctes("", "statements", "stmt_id", False)


def body_ctes(tag: str) -> None:
    """body<tag>: statements of units<tag> in order, then typed_b<tag>, ... on top."""
    found = "CASE dialect " + " ".join(f"WHEN {lit(d)} THEN {every('safe', p)}" for d, p in P.BODY_STATEMENT.items()) + " END"
    tail = P.FLAT_CALL.replace(P.MARK + r"\d+\x{F0101}", r"\([\s\S]*\)")
    pieces = f"list_filter(str_split(safe, ';')[:-2], lambda x: {has(flat('x'), P.FLAT_CALL)})"
    cte(
        "body" + tag,
        ("units" + tag,),
        f"""
SELECT unit_id, dialect, stmt_no - 1 AS stmt_no, sql,
       CASE WHEN stmt_no <= nf THEN 'sql' WHEN stmt_no <= nf + nc THEN 'call' ELSE 'dynamic' END AS origin
FROM (
  SELECT unit_id, dialect, len(f) AS nf, len(c) AS nc, unnest(f || c || d) AS sql, generate_subscripts(f || c || d, 1) AS stmt_no
  FROM (
    SELECT unit_id, dialect, f, d, list_filter(c0, lambda x, i: list_position(c0, x) = i) AS c
    FROM (
      SELECT unit_id, dialect, list_transform({found}, lambda x: {trim(unshield('x'))}) AS f,
             list_transform({pieces}, lambda x: {trim(unshield(f"regexp_extract(x, {rx(tail)}, 1)"))} || ';') AS c0,
             CASE WHEN dialect <> 'Hive' THEN list_transform({every('safe', P.DYNAMIC_LITERAL, 1)},
               lambda x: {trim(f"replace({unshield('substr(x, 2, length(x) - 2)')}, chr(39) || chr(39), chr(39))")}) ELSE [] END AS d
      FROM (SELECT *, {shield('source_code')} AS safe FROM units{tag})
    )
  )
)""",
    )
    statement_ctes("_b" + tag, "body" + tag, "unit_id, stmt_no", True)


for _tag in ("", "_pk", "_v1", "_v2"):
    body_ctes(_tag)


# --- unit features ---------------------------------------------------------
S = "source_code"
LOOPS = f"{count(S, P.LOOP)} - {count(S, P.END_LOOP)}"
LOOP_PEAK = peak(f"list_transform({every(S, P.LOOP_TOKEN)}, lambda t: CAST(CASE WHEN lower(t) = 'loop' THEN 1 ELSE -1 END AS BIGINT))")
CURSORS = f"CASE WHEN dialect = 'Hive' THEN {count(S, P.HIVE_CURSOR)} ELSE {count(S, P.CURSOR_DECLARATION)} END"
_STEPS = f"""list_transform(regexp_split_to_array(upper({S}), {rx(P.LINE_BREAK)}), lambda l: CAST(CASE
  WHEN starts_with({trim('l')}, 'DECLARE') OR contains({trim('l')}, ' DECLARE ') THEN 1 WHEN starts_with({trim('l')}, 'END;') THEN -1 ELSE 0 END AS BIGINT))"""
CURSOR_PEAK = f"CASE WHEN {peak(_STEPS)} = 0 AND contains(upper({S}), 'CURSOR') THEN 1 ELSE {peak(_STEPS)} END"
DYNAMICS = f"{count(S, P.EXECUTE_IMMEDIATE)} + {count(S, P.OPEN_FOR)}"
BINDINGS = f"CAST({count(S, P.BIND_VARIABLE)} + coalesce(list_sum(list_transform({every(S, P.USING_CLAUSE)}, lambda u: length(u) - length(replace(u, ',', '')) + 1)), 0) AS BIGINT)"
DYNAMIC_PEAK = f"CAST(list_max(list_transform(str_split({S}, ';'), lambda p: len({every('p', P.EXECUTE_IMMEDIATE)}))) AS BIGINT)"
_SAVED, _ROLLED = lower_all(every(S, P.SAVEPOINT_NAME, 1)), lower_all(every(S, P.ROLLBACK_NAME, 1))
PAIRS = f"CAST(coalesce(list_sum(list_transform(list_distinct({_SAVED}), lambda n: len(list_filter({_SAVED}, lambda x: x = n)) * len(list_filter({_ROLLED}, lambda x: x = n)))), 0) AS BIGINT)"
_BLOCKS = f"coalesce(list_max(list_transform({every(S, P.ROLLBACK_BLOCK)}, lambda b: len({every('b', P.BEGIN_TEXT)}))), 0)"
TRANSACTION_PEAK = f"CAST(greatest(1, CASE WHEN {PAIRS} > 0 THEN {PAIRS} ELSE {_BLOCKS} END) AS BIGINT)"


def _wanted(dialect: str) -> str:
    words = listed(BUILTINS[dialect])
    return f"{has('callee', P.VALID_NAME)} AND NOT list_contains({words}, callee) AND NOT list_contains({words}, str_split(callee, '.')[1])"


def call_ctes(tag: str) -> None:
    """calls<tag>: one row per call site, custom functions still included.

    Depth is a running sum over brackets, started anew by a semicolon. A comma and the
    closing bracket belong to the last bracket opened on their level before them.
    """
    token = f"unnest({every(sub('safe', P.INTO_NAME, ' '), P.CALL_TOKEN)})"
    opens, closes = "t LIKE '%('", "t = ')'"
    cte(
        "walk" + tag,
        ("units" + tag,),
        f"""
SELECT *, sum(CASE WHEN {opens} THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id, block, level ORDER BY i) AS nth FROM (
  SELECT *, CASE WHEN {closes} THEN inside + 1 ELSE inside END AS level FROM (
    SELECT *, sum(CASE WHEN {opens} THEN 1 WHEN {closes} THEN -1 ELSE 0 END) OVER (PARTITION BY unit_id, block ORDER BY i) AS inside FROM (
      SELECT *, sum(CASE WHEN t = ';' THEN 1 ELSE 0 END) OVER (PARTITION BY unit_id ORDER BY i) AS block FROM (
        SELECT unit_id, t, row_number() OVER (PARTITION BY unit_id ORDER BY i) AS i FROM (
          SELECT unit_id, {token} AS t, generate_subscripts({every(sub('safe', P.INTO_NAME, ' '), P.CALL_TOKEN)}, 1) AS i
          FROM (SELECT unit_id, {shield(S)} AS safe FROM units{tag} WHERE dialect <> 'Hive'))))))""",
    )
    name = f"upper({named(f'regexp_extract(t, {rx(P.CALL_TOKEN_NAME)})')})"
    cte(
        "sites" + tag,
        ("walk" + tag, "units" + tag),
        f"""
SELECT * FROM (
  SELECT unit_id, script_id, package_name, dialect, unit_name, callee, CAST(args AS BIGINT) AS args, CAST(depth AS BIGINT) AS depth FROM (
    SELECT unit_id, max({name}) FILTER ({opens}) AS callee, 1 + count(*) FILTER (t = ',') AS args, level AS depth
    FROM walk{tag} WHERE level > 0 AND t <> ';' AND (t IN (',', ')') OR {opens}) GROUP BY unit_id, block, level, nth HAVING count(*) FILTER ({closes}) > 0
    UNION ALL SELECT unit_id, {name}, 0, inside + 1 FROM walk{tag} WHERE t LIKE '%)' AND t <> ')'
  ) JOIN units{tag} USING (unit_id) WHERE CASE dialect WHEN 'Oracle' THEN {_wanted('Oracle')} ELSE {_wanted('Gauss')} END
  UNION ALL
  SELECT unit_id, script_id, package_name, dialect, unit_name, unnest({every(f'upper({shield(S)})', P.HIVE_CALL, 1)}), NULL, NULL FROM units{tag} WHERE dialect = 'Hive'
) WHERE {last('callee')} <> upper(unit_name)""",
    )
    cte(
        "calls" + tag,
        ("sites" + tag, "units" + tag),
        f"""
SELECT unit_id, script_id, package_name, dialect, callee, args FROM sites{tag}
UNION ALL
SELECT unit_id, script_id, package_name, dialect, 'EXECUTE_IMMEDIATE', NULL FROM (
  SELECT *, unnest({every(S, P.EXECUTE_IMMEDIATE)}) FROM units{tag} WHERE dialect <> 'Hive')""",
    )
    cte(
        "nested" + tag,
        ("calls" + tag, "l_functions"),
        f"""
SELECT unit_id, script_id, package_name, callee, count(*) AS n FROM calls{tag}
WHERE dialect = 'Hive' OR callee NOT IN (SELECT name FROM l_functions) GROUP BY ALL""",
    )
    places = "coalesce(lower(package_name), '') AS to_package, lower(unit_name) AS to_name"
    cte(
        "resolved" + tag,
        ("calls" + tag, "l_functions", "units" + tag),
        f"""
SELECT c.* EXCLUDE (any_id, fit_id), coalesce(fit_id, any_id) AS callee_id, any_id IS NOT NULL AND to_package = own AND own <> '' AS is_internal
FROM (
  SELECT c.*, (SELECT min(unit_id) FROM (SELECT unit_id, {places} FROM units{tag}) u WHERE u.to_package = c.to_package AND u.to_name = c.to_name) AS any_id,
         (SELECT min(unit_id) FROM (SELECT unit_id, least_args, most_args, {places} FROM units{tag}) u
          WHERE u.to_package = c.to_package AND u.to_name = c.to_name AND c.args BETWEEN u.least_args AND u.most_args) AS fit_id
  FROM (
    SELECT *, coalesce(lower(package_name), '') AS own, {last('lower(callee)')} AS to_name,
           CASE WHEN contains(callee, '.') THEN list_extract(str_split(lower(callee), '.'), -2) ELSE coalesce(lower(package_name), '') END AS to_package
    FROM (SELECT unit_id, script_id, package_name, callee, args, count(*) AS n FROM calls{tag}
          WHERE dialect = 'Hive' OR callee NOT IN (SELECT name FROM l_functions) GROUP BY ALL)
  ) c
) c""",
    )


for _tag in ("", "_pk", "_v1", "_v2"):
    call_ctes(_tag)

FUNCTION_SITES = f"""flatten(list_transform(list_transform({every(shield(S), P.CALLED_NAME, 1)}, lambda n: upper({named('n')})),
  lambda c: list_transform(range(1, len(str_split(c, '.')) + 1), lambda i: array_to_string(str_split(c, '.')[i:], '.'))))"""


def segments(names: str) -> str:
    upper = f"list_transform({names}, lambda x: upper(x))"
    return f"list_distinct({upper} || flatten(list_transform({upper}, lambda x: str_split(x, '.'))))"


def score_ctes(tag: str) -> None:
    cte(
        "function_calls" + tag,
        ("units" + tag, "l_functions"),
        f"SELECT unit_id, name, count(*) AS n FROM (SELECT unit_id, unnest({FUNCTION_SITES}) AS name FROM units{tag}) JOIN l_functions USING (name) GROUP BY ALL",
    )
    cte(
        "table_hits" + tag,
        ("named_b" + tag, "l_tables"),
        f"SELECT unit_id, name, count(*) AS n FROM (SELECT unit_id, unnest({segments('reads || writes || dynamic_refs')}) AS name FROM named_b{tag}) JOIN l_tables USING (name) GROUP BY ALL",
    )
    cte(
        "procedure_hits" + tag,
        ("nested" + tag, "l_procedures"),
        f"SELECT unit_id, callee, n FROM nested{tag} JOIN l_procedures ON callee = name",
    )
    sums = ", ".join(f'sum("{f}") AS {f}_count' for f in SCORED)
    cte(
        "rollup" + tag,
        ("feat_b" + tag, "score_b" + tag),
        f"""
SELECT unit_id, count(*) AS statement_count, {sums}, max(query_depth) AS query_depth, sum(score) AS statement_score, count(fail_reason) AS failed_count,
       string_agg(sql, ' | ' ORDER BY stmt_no) FILTER (fail_reason IS NOT NULL) AS failed_list
FROM feat_b{tag} JOIN score_b{tag} USING (unit_id, stmt_no) GROUP BY unit_id""",
    )
    cte(
        "names" + tag,
        ("feat_b" + tag,),
        f"SELECT unit_id, count(*) AS distinct_tables, string_agg(name, ',' ORDER BY name) AS table_list FROM (SELECT DISTINCT unit_id, unnest(table_names) AS name FROM feat_b{tag}) GROUP BY unit_id",
    )
    gauss = lambda value: f"CASE WHEN dialect = 'Gauss' THEN {value} ELSE 0 END"
    flag = lambda pattern: f"CASE WHEN {has(S, pattern)} THEN 1 ELSE 0 END"
    extra = ", ".join(f"CASE WHEN dialect = 'Hive' THEN {count(S, p)} ELSE 0 END AS unit_{n}" for n, p in P.HIVE_EXTRA.items())
    cte(
        "own" + tag,
        ("units" + tag,),
        f"""
SELECT unit_id, {lines(S)} AS unit_lines, {LOOPS} AS loop_count, {LOOP_PEAK} AS max_loop_nesting, {CURSORS} AS cursor_count,
  {count(S, P.CURSOR_OPERATION)} AS cursor_operation_count, {CURSOR_PEAK} AS max_cursor_nesting,
  {gauss(DYNAMICS)} AS dynamic_sql_count, {gauss(BINDINGS)} AS binding_count, {gauss(DYNAMIC_PEAK)} AS max_dynamic_nesting,
  {gauss(count(S, P.TRANSACTION_CONTROL))} AS transaction_count, {gauss(TRANSACTION_PEAK)} AS transaction_nesting,
  {gauss(flag(P.AUTONOMOUS))} AS autonomous, {gauss(flag(P.JAVA_UNIT))} AS java_unit,
  {gauss(f"CASE WHEN {has(S, P.JAVA_UNIT)} THEN {count(S, P.JAVA_TYPE)} ELSE 0 END")} AS java_types,
  {gauss(f"CASE WHEN contains(upper({S}), 'PACKAGE') THEN {count(S, P.PACKAGE_MEMBER)} * 5 + {count(S, P.PACKAGE_VARIABLE)} * 2 + {flag(P.JAVA_UNIT)} * 25 ELSE 0 END")} AS package_part,
  {extra}
FROM units{tag}""",
    )

    def hit(source: str, name: str, label: str) -> str:
        return f"LEFT JOIN (SELECT unit_id, sum(n) AS {label}_count, string_agg({name}, ',' ORDER BY {name}) AS {label}_list FROM {source}{tag} GROUP BY unit_id) USING (unit_id)"

    counts = [f + "_count" for f in SCORED]
    numbers = ", ".join(
        f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}"
        for c in ["statement_count", *counts[1:], "query_depth", "failed_count", "distinct_tables", "custom_function_count",
                  "high_weight_table_count", "nested_call_count", "high_weight_procedure_count"]
    )
    texts = ", ".join(
        f"coalesce({c}, '') AS {c}"
        for c in ["table_list", "failed_list", "custom_function_list", "high_weight_table_list", "nested_call_list", "high_weight_procedure_list"]
    )
    cte(
        "facts" + tag,
        ("units" + tag, "rollup" + tag, "names" + tag, "own" + tag, "function_calls" + tag, "table_hits" + tag, "nested" + tag, "procedure_hits" + tag),
        f"""
SELECT u.unit_id, u.script_id, u.path, u.dialect, u.package_name, u.unit_name, u.ts, {numbers}, {texts}, coalesce(statement_score, 0) AS statement_score,
       CAST(coalesce(table_count, 0) AS BIGINT) AS table_ref_count,
       CAST(CASE WHEN u.dialect = 'Oracle' THEN coalesce(table_count, 0) ELSE coalesce(distinct_tables, 0) END AS BIGINT) AS table_count,
       o.* EXCLUDE (unit_id)
FROM units{tag} u JOIN own{tag} o USING (unit_id) LEFT JOIN rollup{tag} USING (unit_id) LEFT JOIN names{tag} USING (unit_id)
{hit('function_calls', 'name', 'custom_function')} {hit('table_hits', 'name', 'high_weight_table')}
{hit('nested', 'callee', 'nested_call')} {hit('procedure_hits', 'callee', 'high_weight_procedure')}""",
    )

    def weight(dialect: str, factor: str) -> float:
        return W.DEFAULTS[dialect].get(factor, 0.0)

    o = lambda f: f"{weight('Oracle', f)}"
    oracle = f"""(statement_score * (1 + 0.1 * statement_count) + loop_count * {o('loop')} * (1 + greatest(max_loop_nesting - 1, 0) * {o('nested_loop')})
      + custom_function_count * {o('custom_function')}
      + (cursor_count * {o('cursor_declaration')} + cursor_operation_count * {o('cursor_operation')}) * (1 + greatest(max_cursor_nesting - 1, 0) * {o('nested_cursor')}))
      * (1 + high_weight_table_count * 0.1 * 2.0) + nested_call_count * 3.0 + high_weight_procedure_count * 2.5"""
    gauss_score = """distinct_tables * 10 + join_count * 15 + where_condition_count * 5 + subquery_count * 20 + set_operation_count * 15 + loop_count * 15
      + dynamic_sql_count * 15 + binding_count * 5 + max_dynamic_nesting * 25 + transaction_count * 10 + transaction_nesting * 20
      + autonomous * 15 + java_unit * 25 + java_types * 5 + package_part"""
    hive = "statement_score + " + " + ".join(f"unit_{n} * {weight('Hive', n)}" for n in P.HIVE_EXTRA)
    parts = {
        "table_count": "table", **{f + "_count": f for f in SCORED[1:]}, "loop_count": "loop", "custom_function_count": "custom_function",
        "high_weight_table_count": "high_weight_table", "nested_call_count": "nested_procedure", "high_weight_procedure_count": "high_weight_procedure",
        "cursor_count": "cursor_declaration", "cursor_operation_count": "cursor_operation", "dynamic_sql_count": "dynamic_sql",
        "binding_count": "parameter_binding", "max_dynamic_nesting": "nested_dynamic_sql", "transaction_count": "transaction_control",
        "autonomous": "autonomous_transaction", "java_unit": "java_procedure", "java_types": "type_conversion",
        "greatest(max_loop_nesting - 1, 0)": "nested_loop", "greatest(max_cursor_nesting - 1, 0)": "nested_cursor",
        "CASE WHEN transaction_count > 0 THEN transaction_nesting ELSE 0 END": "nested_transaction",
    }
    full = "CASE dialect " + " ".join(
        f"WHEN {lit(d)} THEN " + " + ".join(f"({c}) * {weight(d, f)}" for c, f in parts.items()) for d in P.DIALECTS
    ) + " END"
    cte(
        "scores" + tag,
        ("facts" + tag,),
        f"""SELECT *, round(CAST(CASE WHEN statement_count = 0 THEN 0 WHEN dialect = 'Oracle' THEN {oracle} WHEN dialect = 'Gauss' THEN {gauss_score} ELSE {hive} END AS DOUBLE), 6) AS score,
       round(CAST({full} AS DOUBLE), 6) AS score_full FROM facts{tag}""",
    )


for _tag in ("", "_v1", "_v2"):
    score_ctes(_tag)


# --- registered queries ----------------------------------------------------
def _finals() -> dict[str, str]:
    out: dict[str, str] = {}

    def add(name: str, final: str, *needs: str) -> None:
        out[name] = build(final, *needs)

    md5 = "md5({0}) AS text_hash"
    size = "CAST(length({0}) AS BIGINT) AS chars"

    def text(column: str) -> str:
        return size.format(column) + ", " + md5.format(column)

    add("scan_scripts", f"SELECT script_id, dialect, {text('src')} FROM scripts", "scripts")
    add("scan_files", "SELECT md5(src) AS text_hash, count(*) AS copies FROM scripts GROUP BY 1", "scripts")
    add("default_fill", "SELECT coalesce(schema_name, 'HR') AS schema_name, dialect, count(*) AS scripts FROM scripts GROUP BY 1, 2", "scripts")
    for name in ("scan_zip", "stream_zip"):
        add(name, f"SELECT {BASE_NAME} AS base_name, 'utf-8' AS charset, {text('src')} FROM scripts", "scripts")
    number = "CAST(substr(script_id, 2) AS BIGINT) % 3"
    marked = f"src || CASE {number} WHEN 0 THEN ' -- 表 é' WHEN 1 THEN ' -- 数据' ELSE ' -- é x' END"
    add(
        "charset_audit",
        f"SELECT script_id, charset, {text('t')} FROM (SELECT script_id, {marked} AS t, CASE {number} WHEN 0 THEN 'utf-8' WHEN 1 THEN 'gbk' ELSE 'iso-8859-1' END AS charset FROM procedure_scripts)",
        "procedure_scripts",
    )
    add(
        "name_lists",
        "SELECT 'functions' AS list, name FROM l_functions UNION ALL SELECT 'tables', name FROM l_tables UNION ALL SELECT 'procedures', name FROM l_procedures",
        "l_functions", "l_tables", "l_procedures",
    )
    add(
        "route_scripts",
        f"""SELECT script_id, CASE WHEN contains(upper(src), 'CREATE') AND contains(upper(src), 'PACKAGE') AND contains(upper(src), 'BODY') THEN 'PACKAGE'
            WHEN contains(upper(src), 'CREATE') AND (contains(upper(src), 'PROCEDURE') OR contains(upper(src), 'FUNCTION')) THEN 'PROCEDURE' ELSE 'SQL' END AS kind,
            {BASE_NAME} AS base_name FROM scripts""",
        "scripts",
    )
    add(
        "failed_rows",
        f"""SELECT * FROM (SELECT script_id, dialect, CASE WHEN dialect NOT IN {values(P.DIALECTS)} THEN 'unknown_dialect'
            WHEN {trim('src')} = '' THEN 'empty_source' WHEN {trim(strip('src'))} = '' THEN 'only_comments' END AS fail_reason FROM scripts) WHERE fail_reason IS NOT NULL""",
        "scripts",
    )
    spaced = lambda c: f"replace({c}, ',', ', ')"
    add(
        "report_export",
        f"""SELECT {BASE_NAME} AS package_name, unit_name AS procedure_name, unit_lines AS line_count, score AS overall_score, loop_count,
            max_loop_nesting AS max_loop_nesting_level, custom_function_count, {spaced('custom_function_list')} AS custom_function_list,
            high_weight_table_count, {spaced('high_weight_table_list')} AS high_weight_table_list,
            high_weight_procedure_count, {spaced('high_weight_procedure_list')} AS high_weight_procedure_list,
            subquery_count, table_count, {spaced('table_list')} AS table_list, failed_count > 0 AS has_exceptions, failed_list AS failed_statements
            FROM scores""",
        "scores",
    )
    field = lambda name: f"json_extract_string(line, '$.{name}')"
    good = "FROM feedback_lines WHERE json_valid(line)"
    extension = f"CASE WHEN contains({field('originalFilename')}, '.') THEN '.' || {last(field('originalFilename'))} ELSE '' END"
    add(
        "feedback_scan",
        f"SELECT line_no, {field('feedbackType')} AS feedbackType, {extension} AS extension, strftime(ts, '%Y%m%d%H%M%S') || '_' || CAST(line_no AS VARCHAR) || {extension} AS stored_name {good}",
        "feedback_lines",
    )
    add("feedback_latest", f"SELECT line_no, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, {field('contactPerson')} AS contactPerson {good} ORDER BY ts DESC, line_no", "feedback_lines")
    add(
        "feedback_migrate",
        f"SELECT line_no, coalesce({field('contentDescription')}, {field('content')}) AS contentDescription, {field('dialect')} AS dialect, {field('comments')} AS comments {good}",
        "feedback_lines",
    )
    add("feedback_quarantine", "SELECT line_no, line FROM feedback_lines WHERE NOT json_valid(line)", "feedback_lines")
    add(
        "feedback_join_scripts",
        f"SELECT line_no, script_id, {size.format('src')} FROM (SELECT line_no, {field('filePath')} AS p {good}) JOIN scripts ON path = p WHERE starts_with(p, 'in/')",
        "feedback_lines", "scripts",
    )

    add("strip_comments", f"SELECT script_id, {text('clean')} FROM clean", "clean")
    add("line_count", f"SELECT script_id, {lines('src')} AS lines FROM scripts", "scripts")
    add(
        "split_statements",
        f"""SELECT script_id, stmt_no - 1 AS stmt_no, {text('sql')} FROM (
            SELECT script_id, unnest(p) AS sql, generate_subscripts(p, 1) AS stmt_no FROM (
              SELECT script_id, list_filter(list_transform(regexp_split_to_array(clean, {rx(P.STATEMENT_END)}), lambda x: {trim('x')}), lambda x: x <> '') AS p FROM clean))""",
        "clean",
    )
    for name, origin in (("extract_statements", "sql"), ("extract_calls", "call"), ("extract_dynamic_literals", "dynamic")):
        add(name, f"SELECT unit_id, stmt_no, {text('sql')} FROM body WHERE origin = '{origin}'", "body")
    add("package_detect", "SELECT script_id, dialect, is_package FROM clean", "clean")
    add("package_names", "SELECT script_id, package_name FROM clean WHERE is_package", "clean")
    add("hive_udf_units", f"SELECT script_id, unit_kind, unit_name, {size.format('source_code')} FROM units WHERE dialect = 'Hive'", "units")
    add("split_units", f"SELECT unit_id, unit_kind, qualified_name, pos, {text('source_code')} FROM units", "units")
    add("units_with_body", "SELECT script_id, pos, upper(kind) AS unit_kind, unit_name, has_body FROM chunks", "chunks")
    add(
        "dropped_parts",
        """SELECT script_id, dialect, reason, length(t) AS chars, md5(t) AS text_hash FROM (
             SELECT script_id, dialect, 'declaration without a body' AS reason, text AS t FROM chunks WHERE NOT has_body
           ) WHERE dialect IN ('Oracle', 'Gauss')""",
        "chunks",
    )
    add(
        "dedupe_units",
        "SELECT script_id, lower(unit_name) AS key, count(*) AS definitions, min(pos) AS kept_pos FROM chunks WHERE has_body GROUP BY 1, 2 HAVING count(*) > 1",
        "chunks",
    )

    add("stmt_type_counts", "SELECT dialect, parsed_type, count(*) AS n FROM typed GROUP BY 1, 2", "typed")
    add("validate_statements", "SELECT stmt_id, parsed_type, type, fail_reason FROM typed", "typed")
    add("dynamic_statements", f"SELECT stmt_id, dialect, {size.format('sql')} FROM typed WHERE parsed_type = 'DYNAMIC_SQL'", "typed")
    add(
        "dml_catalogue",
        f"""SELECT unit_id, stmt_no, type, CAST("table" AS BIGINT) AS "table", CAST(where_condition AS BIGINT) AS where_condition, line_count, {joined('table_names')} AS table_list
            FROM feat_b WHERE type IN {values(P.DML_TYPES)}""",
        "feat_b",
    )
    add(
        "failed_statements",
        "SELECT unit_id, count(*) AS failures, string_agg(fail_reason, ',' ORDER BY fail_reason) AS reasons FROM typed_b WHERE fail_reason IS NOT NULL GROUP BY 1",
        "typed_b",
    )

    ddl = "CASE parsed_type " + " ".join(f"WHEN {lit(k)} THEN lower({named(one(shield('sql'), p))})" for k, p in P.DDL_TARGET.items()) + " END"
    refs = f"""SELECT stmt_id, dialect, unnest(reads) AS table_name, 'read' AS role FROM named UNION ALL SELECT stmt_id, dialect, unnest(writes), 'write' FROM named
        UNION ALL SELECT stmt_id, dialect, unnest(dynamic_refs), 'dynamic' FROM named UNION ALL SELECT * FROM (SELECT stmt_id, dialect, {ddl} AS t, 'ddl' FROM named) WHERE t IS NOT NULL"""
    add("table_refs", refs, "named")
    add(
        "write_targets",
        f"""SELECT n.stmt_id, n.dialect, n.parsed_type, n.writes[1] AS target,
            CASE WHEN n.parsed_type = 'MERGE' THEN lower({named(one('t.outside', P.MERGE_SOURCE))}) END AS merge_source
            FROM named n JOIN (SELECT DISTINCT sql, outside FROM typed) t USING (sql) WHERE n.parsed_type IN {values(P.DML_TYPES)}""",
        "named", "typed",
    )
    edges = f"""SELECT source, target, count(*) AS n FROM (
        SELECT target, unnest(reads) AS source FROM (
          SELECT reads, unnest(CASE WHEN parsed_type = 'CREATE' THEN [lower({named(one(shield('sql'), P.CREATE_TABLE))})] ELSE writes END) AS target
          FROM named WHERE parsed_type IN ('INSERT', 'MERGE', 'CREATE'))) WHERE target IS NOT NULL GROUP BY 1, 2"""
    add("lineage_edges", edges, "named")
    add("lineage_depth", *_depth(f"SELECT DISTINCT target AS src, source AS dst FROM ({edges})", "table_name", "named"))
    every_edge = " UNION ".join(
        f"""SELECT target AS src, source AS dst FROM (SELECT target, unnest(reads) AS source FROM (
          SELECT reads, unnest(CASE WHEN parsed_type = 'CREATE' THEN [lower({named(one(shield('sql'), P.CREATE_TABLE))})] ELSE writes END) AS target
          FROM {table} WHERE parsed_type IN ('INSERT', 'MERGE', 'CREATE'))) WHERE target IS NOT NULL"""
        for table in ("named", "named_b")
    )
    add("lineage_components", *_components(every_edge, "table_name", "named", "named_b"))
    add(
        "lineage_reach",
        "SELECT n.node AS table_name, count(r.dst) AS reach, count(r.dst) < 4096 AS exact FROM nodes n LEFT JOIN reach r ON r.src = n.node GROUP BY 1",
        *_graph_ctes(every_edge, ("named", "named_b")),
    )
    baskets = " UNION ALL ".join(f"SELECT list_distinct(reads || writes || dynamic_refs) AS names FROM {table}" for table in ("named", "named_b"))
    cte("baskets", ("named", "named_b"), f"SELECT row_number() OVER () AS basket, names FROM ({baskets})")
    cte("basket_items", ("baskets",), "SELECT basket, unnest(names) AS name FROM baskets")
    add(
        "frequent_table_pairs",
        """SELECT a.name AS first_table, b.name AS second_table, count(*) AS statements FROM basket_items a JOIN basket_items b ON a.basket = b.basket AND a.name < b.name
           GROUP BY 1, 2 HAVING count(*) >= 5""",
        "basket_items",
    )
    add("ddl_targets", f"SELECT * FROM (SELECT stmt_id, dialect, parsed_type, {ddl} AS target FROM typed WHERE parsed_type IN {values(P.DDL_TARGET)}) WHERE target IS NOT NULL", "typed")
    add(
        "dynamic_table_refs",
        "SELECT stmt_id, dialect, unnest(CASE WHEN len(dynamic_refs) > 0 THEN dynamic_refs ELSE ['DYNAMIC_TABLE'] END) AS table_name FROM named WHERE parsed_type = 'DYNAMIC_SQL'",
        "named",
    )
    add(
        "unit_tables",
        "SELECT unit_id, count(*) AS table_count, string_agg(t, ',' ORDER BY t) AS table_list FROM (SELECT DISTINCT unit_id, unnest(reads || writes || dynamic_refs) AS t FROM named_b) GROUP BY 1",
        "named_b",
    )
    add(
        "type_decl_tables",
        f"""SELECT DISTINCT unit_id, table_name FROM (SELECT unit_id, lower(unnest({every(S, P.TYPE_DECLARATION, 1)})) AS table_name FROM units) d
            WHERE NOT EXISTS (SELECT 1 FROM (SELECT unit_id AS uid, unnest(reads || writes || dynamic_refs) AS t FROM named_b) WHERE uid = d.unit_id AND t = d.table_name)""",
        "units", "named_b",
    )

    features = ", ".join(f'CAST("{f}" AS BIGINT) AS "{f}"' for f in [*SCORED, "query_depth", "line_count"])
    add("stmt_features", f"SELECT stmt_id, dialect, type, {features} FROM feat", "feat")
    add("stmt_features_long", "SELECT stmt_id, dialect, feature, n FROM long", "long")
    add("stmt_scores", "SELECT stmt_id, dialect, type, round(score, 6) AS score FROM score JOIN (SELECT stmt_id, fail_reason FROM feat) USING (stmt_id) WHERE fail_reason IS NULL", "score", "feat")

    add("loop_features", f"SELECT unit_id, dialect, {LOOPS} AS loop_count, {count(S, P.END_LOOP)} AS end_loop_count FROM units", "units")
    add("loop_nesting", f"SELECT unit_id, dialect, {LOOP_PEAK} AS max_loop_nesting FROM units", "units")
    names = f"list_sort(list_distinct({lower_all(every(S, P.CURSOR_DECLARATION, 1))}))"
    add(
        "cursor_features",
        f"""SELECT unit_id, dialect, {CURSORS} AS cursor_count, {count(S, P.CURSOR_PARAMETERS)} AS parameterised, array_to_string({names}, ',') AS cursor_list,
            CAST(len(list_filter({lower_all(every(S, P.FOR_IN, 1))}, lambda x: list_contains({names}, x))) AS BIGINT) AS cursor_loops,
            {count(S, P.REF_CURSOR)} AS ref_cursors, {count(S, P.CURSOR_WITH_QUERY)} AS with_query, {count(S, P.CURSOR_FOR_UPDATE)} AS for_update FROM units""",
        "units",
    )
    add(
        "cursor_operations",
        f"""SELECT unit_id, upper(regexp_extract(m, {rx(P.CURSOR_OPERATION_PARTS)}, 1)) AS operation, lower(regexp_extract(m, {rx(P.CURSOR_OPERATION_PARTS)}, 2)) AS cursor_name, count(*) AS n
            FROM (SELECT unit_id, unnest({every(S, P.CURSOR_OPERATION)}) AS m FROM units) GROUP BY 1, 2, 3""",
        "units",
    )
    add("cursor_nesting", f"SELECT unit_id, dialect, CAST({CURSOR_PEAK} AS BIGINT) AS max_cursor_nesting FROM units", "units")
    add("dynamic_sql_features", f"SELECT unit_id, dialect, {DYNAMICS} AS dynamic_sql_count, {BINDINGS} AS binding_count, {DYNAMIC_PEAK} AS max_dynamic_nesting FROM units", "units")
    add(
        "transaction_features",
        f"SELECT unit_id, dialect, {count(S, P.TRANSACTION_CONTROL)} AS transaction_count, {PAIRS} AS savepoint_pairs, {TRANSACTION_PEAK} AS transaction_nesting, {has(S, P.AUTONOMOUS)} AS autonomous FROM units",
        "units",
    )
    add("java_units", f"SELECT * FROM (SELECT unit_id, dialect, {count(S, P.JAVA_TYPE)} AS java_types, {has(S, P.JAVA_UNIT)} AS is_java FROM units) WHERE is_java OR java_types > 0", "units")

    add("custom_function_calls", "SELECT unit_id, name, n FROM function_calls", "function_calls")
    add("high_weight_tables", "SELECT unit_id, name, n FROM table_hits", "table_hits")
    add("call_sites", "SELECT unit_id, callee, args, depth, count(*) AS n FROM sites GROUP BY ALL", "sites")
    add("nested_calls", "SELECT unit_id, callee, n FROM nested", "nested")
    add("high_weight_procedures", "SELECT unit_id, callee, n FROM procedure_hits", "procedure_hits")

    rollup = ", ".join(["statement_count", "table_ref_count", "distinct_tables", "query_depth", "failed_count", *[f + "_count" for f in SCORED[1:]]])
    add("unit_rollup", f"SELECT unit_id, {rollup}, round(statement_score, 6) AS statement_score FROM facts", "facts")
    add(
        "unit_scores",
        """SELECT unit_id, dialect, table_count, table_list, loop_count, max_loop_nesting, cursor_count, cursor_operation_count, CAST(max_cursor_nesting AS BIGINT) AS max_cursor_nesting,
           custom_function_count, custom_function_list, high_weight_table_count, high_weight_table_list, nested_call_count, nested_call_list,
           high_weight_procedure_count, high_weight_procedure_list, score, score_full FROM scores""",
        "scores",
    )
    add(
        "package_rollup",
        """SELECT script_id, package_name, count(*) AS units, CAST(sum(statement_count) AS BIGINT) AS statements, CAST(sum(unit_lines) AS BIGINT) AS lines,
           CAST(sum(CAST(score AS DECIMAL(28, 6))) AS DOUBLE) / count(*) AS avg_score, max(score) AS max_score, arg_max(unit_name, (score, unit_name)) AS most_complex
           FROM scores WHERE package_name IS NOT NULL GROUP BY 1, 2""",
        "scores",
    )
    head = f"str_split(regexp_replace(safe, {rx(P.UNIT_HEADER)}, chr(1), 'g'), chr(1))[1]"
    add(
        "package_features",
        f"""SELECT script_id, package_name, {count('clean', P.PACKAGE_MEMBER)} AS total_procedures, {has('clean', P.JAVA_UNIT)} AS contains_java,
            {has('clean', P.PACKAGE_BODY)} AS has_body, {count(head, P.PACKAGE_VARIABLE)} AS variables, {count(head, P.PACKAGE_CONSTANT)} AS constants,
            {count(head, P.PACKAGE_TYPE)} AS types, {lines('clean')} AS total_lines, {has('clean', P.GLOBAL_TEMPORARY)} AS uses_global_temporary,
            {has('clean', P.DATABASE_OBJECT)} AS touches_objects, {has('clean', P.PRIVILEGE)} AS has_privileges FROM clean WHERE is_package""",
        "clean",
    )
    add(
        "package_call_split",
        """SELECT script_id, package_name, CAST(sum(CASE WHEN is_internal THEN n ELSE 0 END) AS BIGINT) AS internal_calls,
           CAST(sum(CASE WHEN is_internal THEN 0 ELSE n END) AS BIGINT) AS external_calls,
           coalesce(string_agg(DISTINCT pair, ',' ORDER BY pair), '') AS dependencies
           FROM (SELECT *, CASE WHEN is_internal THEN list_extract(str_split(unit_id, ':'), -1) || '>' || to_name END AS pair FROM resolved_pk)
           WHERE package_name IS NOT NULL GROUP BY 1, 2""",
        "resolved_pk",
    )
    call_edges = "SELECT unit_id AS caller, callee_id AS callee, CAST(sum(n) AS BIGINT) AS n FROM resolved{0} WHERE callee_id IS NOT NULL GROUP BY 1, 2"
    add("call_edges", call_edges.format(""), "resolved")
    pairs = "SELECT DISTINCT unit_id AS src, callee_id AS dst FROM resolved_pk WHERE callee_id IS NOT NULL AND unit_id <> callee_id"
    add("call_chain_depth", *_depth(pairs, "unit_id", "resolved_pk"))
    add("call_components", *_components("SELECT DISTINCT unit_id AS src, callee_id AS dst FROM resolved WHERE callee_id IS NOT NULL", "unit_id", "resolved"))
    depth_sql, *needs = _depth(pairs, "unit_id", "resolved_pk")
    add(
        "package_chain_depth",
        f"SELECT u.script_id, u.package_name, max(depth) AS max_depth, bool_or(is_recursive) AS is_recursive FROM units_pk u JOIN ({depth_sql}) d USING (unit_id) WHERE u.package_name IS NOT NULL GROUP BY 1, 2",
        *needs, "units_pk",
    )

    add(
        "top_units",
        "SELECT dialect, rn, unit_id, score FROM (SELECT *, row_number() OVER (PARTITION BY dialect ORDER BY score DESC, unit_id) AS rn FROM scores) WHERE rn <= 10",
        "scores",
    )
    add(
        "score_distribution",
        """SELECT dialect, score, count(*) AS n, min(r) AS score_rank, round(min(p), 6) AS percent_rank, round(max(c), 6) AS cume_dist,
           CAST(least(4, floor(min(p) * 4) + 1) AS BIGINT) AS quartile,
           CAST(CASE WHEN score < 0 THEN 0 WHEN score >= 500 THEN 11 ELSE floor(score / 50) + 1 END AS BIGINT) AS bucket
           FROM (SELECT dialect, score, rank() OVER w AS r, percent_rank() OVER w AS p, cume_dist() OVER w AS c FROM scores WINDOW w AS (PARTITION BY dialect ORDER BY score)) GROUP BY dialect, score""",
        "scores",
    )
    add(
        "score_quantiles",
        """SELECT dialect, count(*) AS units, min(score) AS min_score, quantile_disc(score, 0.25) AS p25, quantile_disc(score, 0.5) AS p50,
           quantile_disc(score, 0.75) AS p75, quantile_disc(score, 0.9) AS p90, max(score) AS max_score FROM scores GROUP BY 1""",
        "scores",
    )
    columns = "dialect, parsed_type, type, sql, fail_reason, reads, writes, dynamic_refs"
    cte(
        "every_named",
        ("named", "named_b"),
        f"SELECT 's' || stmt_id AS key, CAST(NULL AS VARCHAR) AS unit_id, {columns} FROM named UNION ALL SELECT unit_id || ':' || stmt_no, unit_id, {columns} FROM named_b",
    )
    add(
        "corpus_cube",
        f"SELECT dialect, parsed_type, count(*) AS statements, count(fail_reason) AS failures, CAST(sum({lines('sql')}) AS BIGINT) AS lines, CAST(grouping_id(dialect, parsed_type) AS BIGINT) AS level FROM every_named GROUP BY CUBE (dialect, parsed_type)",
        "every_named",
    )
    every_ref = " UNION ALL ".join(
        f"SELECT key, unit_id, dialect, unnest({names}) AS table_name, '{role}' AS role FROM every_named"
        for role, names in (("read", "reads"), ("write", "writes"), ("dynamic", "dynamic_refs"), ("ddl", f"list_filter([{ddl}], lambda x: x IS NOT NULL)"))
    )
    roles = ", ".join(f"count(*) FILTER (role = '{r}') AS n_{r}" for r in ("read", "write", "ddl", "dynamic"))
    add("hot_tables", f"SELECT table_name, {roles}, count(DISTINCT key) AS statements, count(DISTINCT unit_id) AS units FROM ({every_ref}) GROUP BY 1", "every_named")
    add(
        "join_partners",
        "SELECT reads[1] AS leading, partner, count(*) AS n FROM (SELECT reads, unnest(reads[2:]) AS partner FROM every_named WHERE type = 'SELECT') GROUP BY 1, 2",
        "every_named",
    )
    add(
        "list_coverage",
        f"""SELECT coalesce(u.name, l.name) AS name, coalesce(uses, 0) AS uses, CASE WHEN u.name IS NULL THEN 'unused' WHEN l.name IS NULL THEN 'unlisted' ELSE 'both' END AS state
            FROM (SELECT coalesce((SELECT min(name) FROM l_tables WHERE list_contains([used] || str_split(used, '.'), name)), used) AS name, sum(n) AS uses FROM (
              SELECT used, count(*) AS n FROM (SELECT upper(unnest(list_distinct(reads || writes || dynamic_refs))) AS used FROM every_named) GROUP BY 1) GROUP BY 1) u FULL JOIN l_tables l ON u.name = l.name""",
        "every_named", "l_tables",
    )
    add(
        "version_diff",
        """SELECT * FROM (
             SELECT coalesce(a.unit_id, b.unit_id) AS unit_id, a.score AS old_score, a.statement_count AS old_statements, b.score AS new_score, b.statement_count AS new_statements,
                    CASE WHEN a.unit_id IS NULL THEN 'added' WHEN b.unit_id IS NULL THEN 'removed' WHEN a.score <> b.score OR a.statement_count <> b.statement_count THEN 'changed' END AS state,
                    round(coalesce(b.score, 0) - coalesce(a.score, 0), 6) AS delta
             FROM scores a FULL JOIN scores_v2 b ON a.unit_id = b.unit_id) WHERE state IS NOT NULL""",
        "scores", "scores_v2",
    )
    renamed = f"CASE WHEN unit_kind = 'SCRIPT' THEN unit_id ELSE {corpus.RENAMED.format('unit_id')} END"
    add(
        "version_moves",
        f"""SELECT unit_id AS old_unit_id, new_unit_id FROM (
              SELECT unit_id, {corpus.MOVED_SCRIPT} || substr(id, length(script_id) + 1) AS new_unit_id FROM (SELECT *, {renamed} AS id FROM units))
            WHERE unit_id <> new_unit_id""",
        "units",
    )
    normal = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(upper(sql), '''[^'']*''', '?', 'g'), '\b\d+\b', '?', 'g'), '\s+', ' ', 'g'), '[ ;]+$', '', 'g')"
    add("duplicate_statements", f"SELECT md5({normal}) AS text_hash, count(*) AS copies, min(stmt_id) AS first_stmt FROM statements GROUP BY 1 HAVING count(*) > 1", "statements")
    side = lambda d: f"(SELECT DISTINCT table_name FROM ({every_ref}) WHERE dialect = '{d}')"
    add(
        "dialect_table_sets",
        f"""SELECT 'both' AS part, table_name FROM ({side('Oracle')} INTERSECT {side('Gauss')}) UNION ALL SELECT 'either', table_name FROM ({side('Oracle')} UNION {side('Gauss')})
            UNION ALL SELECT 'oracle_only', table_name FROM ({side('Oracle')} EXCEPT {side('Gauss')})""",
        "every_named",
    )
    add(
        "score_over_time",
        """SELECT dialect, strftime(day, '%Y-%m-%d') AS day, units, CAST(sum(units) OVER w AS BIGINT) AS running_units, CAST(total AS DOUBLE) AS total,
           CAST(sum(total) OVER w AS DOUBLE) AS running_total, units - coalesce(lag(units) OVER w, 0) AS change
           FROM (SELECT dialect, CAST(ts AS DATE) AS day, count(*) AS units, sum(CAST(score AS DECIMAL(28, 6))) AS total FROM scores GROUP BY 1, 2)
           WINDOW w AS (PARTITION BY dialect ORDER BY day ROWS UNBOUNDED PRECEDING)""",
        "scores",
    )

    add(
        "score_quantiles_by_month",
        """SELECT dialect, strftime(ts, '%Y-%m') AS month, count(*) AS units, quantile_disc(score, 0.25) AS p25, quantile_disc(score, 0.5) AS p50,
           quantile_disc(score, 0.75) AS p75, quantile_disc(score, 0.9) AS p90 FROM scores GROUP BY 1, 2""",
        "scores",
    )
    add("stream_scripts", "SELECT unit_id, dialect, statement_count, score FROM scores_v1", "scores_v1")
    for name, origin in (("stream_windows", "procedure_scripts"), ("stream_accounted", "scripts")):
        closed = f"(SELECT max(ts) FROM {origin}) - INTERVAL 10 MINUTE"
        add(
            name,
            f"""SELECT strftime(d, '%Y-%m-%d') AS day, dialect, count(*) AS scripts, CAST(sum(length(src)) AS BIGINT) AS chars
                FROM (SELECT date_trunc('day', ts) AS d, dialect, src FROM {origin}) WHERE d + INTERVAL 1 DAY <= {closed} GROUP BY 1, 2""",
            origin,
        )
    add("stream_dedup", "SELECT DISTINCT md5(src) AS text_hash FROM procedure_scripts", "procedure_scripts")
    stamp = "'%Y-%m-%d %H:%M:%S.%f'"
    add(
        "stream_sessions",
        f"""SELECT contactPerson, strftime(min(ts), {stamp}) AS started, strftime(max(ts) + INTERVAL 30 MINUTE, {stamp}) AS ended, count(*) AS entries FROM (
              SELECT *, sum(opens) OVER (PARTITION BY contactPerson ORDER BY ts, line_no) AS session FROM (
                SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY contactPerson ORDER BY ts, line_no) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
                FROM (SELECT line_no, ts, {field('contactPerson')} AS contactPerson {good})))
            GROUP BY contactPerson, session HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) {good}) - INTERVAL 10 MINUTE""",
        "feedback_lines",
    )
    return out


def _depth(edges: str, node: str, *needs: str) -> tuple[str, ...]:
    """Chain depth by reachability: nodes that reach a cycle have none, the rest is a finite recursion."""
    return (
        f"""SELECT n.node AS {node}, max(w.depth) AS depth, n.node IN (SELECT node FROM cyclic) AS is_recursive
        FROM nodes n LEFT JOIN walks w ON w.node = n.node GROUP BY n.node""",
        *needs,
        *_graph_ctes(edges, needs),
    )


def _components(edges: str, node: str, *needs: str) -> tuple[str, ...]:
    """Components by mutual reachability; depth by recursion over the graph of components."""
    cte("edges", needs, edges)
    cte("nodes", ("edges",), "SELECT src AS node FROM edges UNION SELECT dst FROM edges")
    cte("reach", ("edges",), "SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src")
    cte("mutual", ("reach",), "SELECT a.src AS node, a.dst AS other FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src")
    cte(
        "member",
        ("nodes", "mutual"),
        "SELECT n.node, coalesce(min(m.other), n.node) AS component_id, greatest(count(m.other), 1) AS component_size, count(m.other) > 0 AS on_cycle FROM nodes n LEFT JOIN mutual m ON m.node = n.node GROUP BY n.node",
    )
    cte("links", ("edges", "member"), "SELECT DISTINCT a.component_id AS src, b.component_id AS dst FROM edges e JOIN member a ON a.node = e.src JOIN member b ON b.node = e.dst WHERE a.component_id <> b.component_id")
    cte("walks", ("member", "links"), "SELECT DISTINCT component_id, CAST(1 AS BIGINT) AS depth FROM member UNION SELECT e.src, w.depth + 1 FROM walks w JOIN links e ON e.dst = w.component_id")
    return (
        f"""SELECT m.node AS {node}, m.component_id, CAST(m.component_size AS BIGINT) AS component_size, m.on_cycle, d.depth,
        m.on_cycle OR m.node IN (SELECT r.src FROM reach r JOIN member c ON c.node = r.dst WHERE c.on_cycle) AS reaches_cycle
        FROM member m JOIN (SELECT component_id, max(depth) AS depth FROM walks GROUP BY 1) d USING (component_id)""",
        *needs,
        "member", "reach", "walks",
    )


def _graph_ctes(edges: str, needs: tuple[str, ...]) -> tuple[str, ...]:
    """The graph CTEs are rebuilt for each query that uses them."""
    cte("edges", needs, edges)
    cte("nodes", ("edges",), "SELECT src AS node FROM edges UNION SELECT dst FROM edges")
    cte("reach", ("edges",), "SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON r.dst = e.src")
    cte("cyclic", ("reach",), "SELECT src AS node FROM reach WHERE src = dst UNION SELECT src FROM reach WHERE dst IN (SELECT src FROM reach WHERE src = dst)")
    cte(
        "walks",
        ("nodes", "edges", "cyclic"),
        """SELECT node, CAST(1 AS BIGINT) AS depth FROM nodes WHERE node NOT IN (SELECT node FROM cyclic)
           UNION SELECT e.src, w.depth + 1 FROM walks w JOIN edges e ON e.dst = w.node WHERE e.src NOT IN (SELECT node FROM cyclic)""",
    )
    return ("edges", "nodes", "reach", "cyclic", "walks")


def statements() -> dict[str, str]:
    """Key of each registered query to its SQL."""
    return _finals()
