"""Literals, brackets and scopes: hand-derived rows for texts that patterns alone read wrongly."""

import time

import pytest
from pyspark.sql import functions as F

from scriptgauge.functions import lexing
from scriptgauge.operators import features, lineage, names, packages, statements, tables, units
from scriptgauge.plans.unit_scores import score_scripts

SCHEMA = "script_id string, path string, dialect string, schema_name string, ts timestamp, src string"


def scripts(spark, *texts, dialect="Oracle"):
    return spark.createDataFrame([(f"s{i}", f"in/f{i}.sql", dialect, None, None, t) for i, t in enumerate(texts)], SCHEMA)


def unit_rows(spark, text, dialect="Oracle"):
    return units.split_units(scripts(spark, text, dialect=dialect))


def each(spark, texts, make):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r.v for r in frame.select("i", make(F.col("text")).alias("v")).orderBy("i").collect()]


TEXTS = ["", "plain", "a 'b;c' d", "'it''s; (x)'", '"My Proc"(a)', "`t (1)`.x", "q'[it's; (x)]' || q'{a}'", "$$ select ; $$ x", "it's open", 'un"closed', "'日本;' x", None]


def test_shield_keeps_length_and_comes_back(spark):
    safe = each(spark, TEXTS, lexing.shield)
    assert each(spark, TEXTS, lambda t: lexing.unshield(lexing.shield(t))) == TEXTS
    assert [s and len(s) for s in safe] == [t and len(t) for t in TEXTS]
    assert all(";" not in s and "(" not in s for s in (safe[2], safe[3], safe[6], safe[7], safe[10]))
    assert safe[8] == TEXTS[8] and safe[9] == TEXTS[9] and safe[4].endswith("(a)") and '"' not in safe[4]


def test_a_dollar_quoted_body_is_read(spark):
    text = "CREATE FUNCTION f() RETURNS int AS $$ BEGIN DELETE FROM t WHERE s = 'a;b'; END; $$ LANGUAGE plpgsql;"
    found = statements.extract_statements(unit_rows(spark, text, "Gauss")).collect()
    assert [(r.origin, r.sql) for r in found] == [("sql", "DELETE FROM t WHERE s = 'a;b';")]


def test_parts_of_brackets(spark):
    (parts,) = each(spark, ["f(g(x), (y)) + ()"], lexing.scopes)
    marked = lambda n: f"{lexing.OPEN_MARK}{n}{lexing.CLOSE_MARK}"
    assert parts == ["x", "y", "", f"g{marked(0)}, {marked(1)}", f"f{marked(3)} + {marked(2)}"]
    restored = each(spark, ["f(g(x), (y)) + ()"], lambda t: lexing.with_brackets(F.element_at(lexing.scopes(t), -1), lexing.scopes(t)))
    assert restored == ["f(g(x), (y)) + ()"]


CALLS = [
    ("mid_p(inner_f(x))", [("inner_f", 1, 2), ("mid_p", 1, 1)]),
    ("outer_p(f(g(x)))", [("g", 1, 3), ("f", 1, 2), ("outer_p", 1, 1)]),
    ("a(1, (2, 3), b(), 'x,y') ; c()", [("b", 0, 2), ("a", 4, 1), ("c", 0, 1)]),
    ("open(1; done(2, 3)", [("done", 2, 1)]),
    (") x(1", []),
    ('"My P"(1)', [('"My P"', 1, 1)]),
    ("pkg.p (1)", [("pkg.p", 1, 1)]),
]


@pytest.mark.parametrize("text,expected", CALLS)
def test_calls(spark, text, expected):
    (found,) = each(spark, [text], lambda t: F.transform(lexing.calls(lexing.shield(t)), lambda c: F.struct(lexing.unshield(c["name"]).alias("n"), c["args"], c["depth"])))
    assert [tuple(c) for c in found] == expected


def test_ten_thousand_brackets(spark):
    deep, wide = "f(" * 10_000 + "x" + ")" * 10_000, "g(1), " * 10_000
    began = time.time()
    assert each(spark, [deep, wide], lambda t: F.size(lexing.calls(t))) == [10_000, 10_000]
    assert time.time() - began < 60


def test_literals_and_quoted_names_in_units(spark):
    text = """CREATE PROCEDURE "My Proc"(a VARCHAR2(9) DEFAULT ';', b NUMBER) IS
  s VARCHAR2(99) := 'PROCEDURE fake(x) IS; ';
BEGIN
  INSERT INTO "Odd T" VALUES (1, 'x; DELETE FROM u;');
  s := f(1);
END;
/
CREATE FUNCTION plain RETURN NUMBER IS BEGIN RETURN 1; END;"""
    found = unit_rows(spark, text).orderBy("pos").collect()
    assert [(u.unit_kind, u.unit_name, u.least_args, u.most_args) for u in found] == [("PROCEDURE", "My Proc", 1, 2), ("FUNCTION", "plain", 0, 0)]
    assert found[0].source_code.startswith('PROCEDURE "My Proc"(a VARCHAR2(9) DEFAULT \';\', b NUMBER) IS') and "'PROCEDURE fake(x) IS; '" in found[0].source_code
    rows = statements.extract_statements(unit_rows(spark, text)).collect()
    assert [(r.origin, r.sql) for r in rows] == [("sql", "INSERT INTO \"Odd T\" VALUES (1, 'x; DELETE FROM u;');")]
    assert [r.table_name for r in tables.table_refs(statements.classify(statements.extract_statements(unit_rows(spark, text))), ["unit_id"]).collect()] == ["odd t"]


BODIES = [
    ("run(a, f(1)); run(a, f(1));", [("call", "run(a, f(1));")]),
    ("IF f(x) THEN p(g(h(x, (1)))); END IF; v := f(x); v(1) := g(2);", [("call", "p(g(h(x, (1))));")]),
    ("FOR r IN (SELECT 1 FROM t) LOOP p(r.x); END LOOP;", [("sql", "SELECT 1 FROM t) LOOP p(r.x);"), ("call", "p(r.x);")]),
    ("EXECUTE IMMEDIATE 'DELETE FROM u WHERE s = ''a;b''';", [("dynamic", "DELETE FROM u WHERE s = 'a;b'")]),
    ("EXECUTE IMMEDIATE q'[DELETE FROM u WHERE s = 'a']';", [("dynamic", "DELETE FROM u WHERE s = 'a'")]),
]


@pytest.mark.parametrize("dialect", ["Oracle", "Gauss"])
@pytest.mark.parametrize("body,expected", BODIES)
def test_bodies(spark, dialect, body, expected):
    text = f"CREATE PROCEDURE p0(a NUMBER) IS\nBEGIN\n  {body}\nEND;"
    assert [(r.origin, r.sql) for r in statements.extract_statements(unit_rows(spark, text, dialect)).collect()] == expected


# dialect, statement, type, reads, writes
SCOPES = [
    ("Oracle", 'SELECT 1 FROM "My T" a, `b c`.d', "SELECT", ["my t", "b c.d"], []),
    ("Gauss", "SELECT 1 FROM (SELECT x FROM s1) q, t2, (SELECT y FROM s3) r, t4 WHERE a IN (1, 2)", "SELECT", ["t2", "t4", "s1", "s3"], []),
    ("Gauss", "SELECT 1 FROM a JOIN b ON f(a.x, 1) = b.x, c LEFT JOIN d ON 1 = 1 ORDER BY e, g", "SELECT", ["a", "b", "c", "d"], []),
    ("Gauss", "WITH q(c) AS (SELECT 1 FROM t) SELECT * FROM q", "SELECT", ["t"], []),
    ("Gauss", "SELECT * FROM q, (WITH q AS (SELECT 1 FROM t) SELECT * FROM q JOIN u ON 1 = 1) x", "SELECT", ["q", "t", "u"], []),
    ("Gauss", "WITH a AS (SELECT 1 FROM t), b AS (SELECT 1 FROM a) SELECT * FROM b WHERE x IN (SELECT y FROM a)", "SELECT", ["t"], []),
    ("Gauss", "SELECT EXTRACT(YEAR FROM d), TRIM(BOTH ' ' FROM e), SUBSTRING(f FROM 2) FROM t WHERE a IS DISTINCT FROM b", "SELECT", ["t"], []),
    ("Gauss", "SELECT 1 FROM unnest(x) u, t", "SELECT", ["t"], []),
    ("Gauss", "SELECT 1 FROM (a JOIN b ON a.x = b.x)", "SELECT", ["a", "b"], []),
    ("Hive", "WITH q AS (SELECT 1 FROM s) INSERT INTO TABLE t SELECT * FROM q", "INSERT", ["s"], ["t"]),
    ("Oracle", "INSERT ALL INTO a (x) VALUES (x) INTO b VALUES (y) SELECT x, y FROM s", "INSERT", ["s"], ["a", "b"]),
    ("Hive", "FROM s INSERT OVERWRITE TABLE a SELECT x WHERE x > 1 INSERT INTO TABLE b SELECT y", "INSERT", ["s"], ["a", "b"]),
    ("Hive", "INSERT OVERWRITE LOCAL DIRECTORY '/out' SELECT * FROM s", "INSERT", ["s"], []),
    ("Hive", "SELECT 1 FROM s LATERAL VIEW explode(m) e AS k, v JOIN t ON 1 = 1", "SELECT", ["s", "t"], []),
    ("Gauss", "UPDATE ONLY tg AS g SET x = 1 FROM s WHERE g.n = 'from no, where'", "UPDATE", ["s"], ["tg"]),
    ("Gauss", "DELETE FROM ONLY t WHERE x IN (SELECT y FROM s)", "DELETE", ["s"], ["t"]),
    ("Oracle", "MERGE INTO t USING (SELECT 1 FROM s) q ON (t.a = q.a) WHEN MATCHED THEN UPDATE SET t.v = 1", "MERGE", ["s"], ["t"]),
]


@pytest.mark.parametrize("dialect,sql,kind,reads,writes", SCOPES)
def test_tables_of_scopes(spark, dialect, sql, kind, reads, writes):
    frame = spark.createDataFrame([("1", dialect, sql)], "stmt_id string, dialect string, sql string")
    row = tables.with_names(statements.classify(statements.prepare(frame))).collect()[0]
    assert (row.parsed_type, row.reads, row.writes) == (kind, reads, writes)


def test_long_lists_and_lineage_of_several_targets(spark):
    wide = "SELECT 1 FROM " + ", ".join(f"t{i} x{i}" for i in range(5_000))
    multi = "INSERT ALL INTO a VALUES (1) INTO b VALUES (2) SELECT 1 FROM s"
    frame = spark.createDataFrame([("1", "Oracle", wide), ("2", "Oracle", multi)], "stmt_id string, dialect string, sql string")
    typed = statements.classify(statements.prepare(frame))
    assert tables.with_names(typed).filter("stmt_id = '1'").select(F.size("reads")).first()[0] == 5_000
    assert {(r.source, r.target) for r in lineage.lineage_edges(typed).collect()} == {("s", "a"), ("s", "b")}


OVERLOADS = """CREATE OR REPLACE PACKAGE BODY p AS
  PROCEDURE a(x NUMBER) IS BEGIN NULL; END;
  PROCEDURE a(x NUMBER, y VARCHAR2(9) DEFAULT f(1, ','), z NUMBER := 2) IS BEGIN NULL; END;
  PROCEDURE b IS BEGIN a(1, 2); a(1); a(1, 2, 3, 4); p.a(g(1, 2), 'x,y', 3); END;
END p;"""


def test_overloads_are_units_and_calls_find_theirs(spark):
    found = unit_rows(spark, OVERLOADS)
    assert [(r.unit_id, r.least_args, r.most_args) for r in found.orderBy("pos").collect()] == [("s0:a", 1, 1), ("s0:a#2", 1, 3), ("s0:b", 0, 0)]
    none = spark.createDataFrame([], "name string")
    edges = {(r.caller, r.callee): r.n for r in packages.call_edges(found, none).collect()}
    assert edges == {("s0:b", "s0:a"): 2, ("s0:b", "s0:a#2"): 2}  # a(1) fits both and goes to the smaller id, four arguments fit none
    calls = {(r.callee, r.args, r.depth): r.n for r in names.call_table(found).filter("unit_id = 's0:b'").collect()}
    assert calls == {("A", 1, 1): 1, ("A", 2, 1): 1, ("A", 4, 1): 1, ("P.A", 3, 1): 1, ("G", 2, 2): 1}
    assert unit_rows(spark, OVERLOADS, "Gauss").count() == 2


def test_scores_count_inner_calls_once(spark):
    empty = spark.createDataFrame([], "name string")
    text = "CREATE PROCEDURE q(x NUMBER) IS BEGIN mid_p(inner_f(x)); outer_p(deep_f(deeper_f(x))); END;"
    (row,) = score_scripts(scripts(spark, text), features.weight_table(spark), empty, empty, empty).collect()
    assert (row.nested_call_count, row.nested_call_list) == (5, "DEEPER_F,DEEP_F,INNER_F,MID_P,OUTER_P")


def test_unknown_statements_have_a_reason(spark):
    frame = spark.createDataFrame([("1", "Oracle", "frobnicate the table"), ("2", "Hive", "SELECT 1 FROM t")], "stmt_id string, dialect string, sql string")
    found = {r.stmt_id: (r.type, r.fail_reason) for r in statements.classify(statements.prepare(frame)).collect()}
    assert found == {"1": ("UNKNOWN", "unrecognised"), "2": ("SELECT", None)}


def test_text_before_the_first_header_is_a_unit(spark):
    text = "DELETE FROM t WHERE s = 'PROCEDURE x(a) IS;';\nCREATE OR REPLACE PROCEDURE f0(a NUMBER) IS BEGIN NULL; END;"
    found = unit_rows(spark, text).orderBy("pos").collect()
    assert [(u.unit_id, u.unit_kind, u.pos, u.source_code[:13]) for u in found] == [("s0:f0#0", "SCRIPT", 0, "DELETE FROM t"), ("s0:f0", "PROCEDURE", 1, "PROCEDURE f0(")]
    assert [r.sql for r in statements.extract_statements(unit_rows(spark, text)).collect()] == ["DELETE FROM t WHERE s = 'PROCEDURE x(a) IS;';"]
    assert units.dropped_parts(scripts(spark, text)).count() == 0
