"""Units, their features and scores on small texts."""

import re

import pytest

from scriptgauge.functions import patterns as P
from scriptgauge.operators import features, names, packages, statements, tables, unit_features, units
from scriptgauge.plans import unit_scores
from scriptgauge.plans.unit_scores import score_scripts

SCHEMA = "script_id string, path string, dialect string, schema_name string, ts timestamp, src string"


def scripts(spark, *texts, dialect="Gauss"):
    rows = [(f"s{i}", f"in/f{i}.sql", dialect, None, None, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def listed(spark, *words):
    return spark.createDataFrame([(w,) for w in words], "name string")


def scored(spark, text, dialect, functions=(), tables=(), procedures=()):
    frame = score_scripts(
        scripts(spark, text, dialect=dialect),
        features.weight_table(spark),
        listed(spark, *functions),
        listed(spark, *tables),
        listed(spark, *procedures),
    )
    return {r.unit_name: r for r in frame.collect()}


PACKAGE = """CREATE OR REPLACE PACKAGE BODY tools AS
  PROCEDURE first(a NUMBER);
  PROCEDURE first(a NUMBER, b VARCHAR2(10)) IS
  BEGIN
    second(a);
    other.run(a);
  END first;
  FUNCTION second(a NUMBER) RETURN NUMBER IS
  BEGIN
    first(a - 1, 'x');
    RETURN 1;
  END second;
  PROCEDURE FIRST(z NUMBER) IS BEGIN NULL; END;
  PROCEDURE outside AS LANGUAGE JAVA NAME 'a.b';
END tools;
/"""


def test_package_units(spark):
    found = units.split_units(scripts(spark, PACKAGE)).orderBy("pos").collect()
    assert [(u.unit_kind, u.qualified_name) for u in found] == [
        ("PROCEDURE", "tools.first"),
        ("FUNCTION", "tools.second"),
        ("PROCEDURE", "tools.outside"),
    ]
    assert found[0].source_code.endswith("END first;")
    assert not found[-1].source_code.endswith("END tools;")


def test_declarations_only_give_no_units(spark):
    text = "CREATE OR REPLACE PACKAGE p AS\n PROCEDURE a(x NUMBER);\n FUNCTION b(x NUMBER) RETURN NUMBER;\nEND p;"
    assert units.split_units(scripts(spark, text)).count() == 0


def test_plain_and_hive_scripts(spark):
    plain = units.split_units(scripts(spark, "SELECT 1 FROM t WHERE x = 1;")).collect()
    assert [(u.unit_kind, u.unit_name) for u in plain] == [("SCRIPT", "f0")]
    hive = "CREATE TEMPORARY FUNCTION f1 AS 'a.B';\nCREATE FUNCTION f2 AS 'a.C';\nSELECT f1(x) FROM t;"
    found = units.split_units(scripts(spark, hive, dialect="Hive")).orderBy("pos").collect()
    assert [(u.unit_kind, u.unit_name) for u in found] == [("UDF", "f1"), ("UDF", "f2")]


def texts(spark, text, dialect="Gauss"):
    rows = statements.extract_statements(units.split_units(scripts(spark, text, dialect=dialect))).orderBy("stmt_no")
    return [(r.origin, r.sql) for r in rows.collect()]


def test_body_statements(spark):
    text = """CREATE PROCEDURE p(a NUMBER) IS
BEGIN
  INSERT INTO t VALUES (1);
  run(a, f(1));
  run(a, f(1));
  EXECUTE IMMEDIATE 'DELETE FROM u WHERE id = 1';
  COMMIT;
END p;"""
    assert texts(spark, text) == [
        ("sql", "INSERT INTO t VALUES (1);"),
        ("sql", "COMMIT;"),
        ("call", "run(a, f(1));"),
        ("dynamic", "DELETE FROM u WHERE id = 1"),
    ]


def one(spark, columns, text, dialect="Gauss"):
    frame = spark.createDataFrame([("u", dialect, text)], "unit_id string, dialect string, source_code string")
    return columns(frame).collect()[0]


LOOPS = [
    ("FOR i IN 1..2 LOOP x; END LOOP;", 1, 1),
    ("FOR i IN 1..2 LOOP x; END LOOP; WHILE a LOOP y; END LOOP;", 2, 1),
    ("LOOP LOOP x; END LOOP; LOOP LOOP y; END LOOP; END LOOP; END LOOP;", 4, 3),
    ("END LOOP; LOOP x; END LOOP;", 1, 1),  # LOOP occurs three times, END LOOP twice
    ("nothing", 0, 0),
]


@pytest.mark.parametrize("text,count,depth", LOOPS)
def test_loops(spark, text, count, depth):
    assert one(spark, unit_features.loop_features, text).loop_count == count
    assert one(spark, unit_features.loop_nesting_table, text).max_loop_nesting == depth


def test_cursors(spark):
    text = "CURSOR c1(p NUMBER) IS SELECT a FROM t FOR UPDATE; CURSOR c2 IS SELECT b FROM t; OPEN c1(1); FETCH c1 INTO v; CLOSE c1; FOR r IN c2 LOOP x; END LOOP; FOR i IN q LOOP y; END LOOP;"
    row = one(spark, unit_features.cursor_features, text)
    assert (row.cursor_count, row.parameterised, row.cursor_list, row.cursor_loops) == (2, 1, "c1,c2", 1)
    assert (row.with_query, row.for_update) == (2, 1)
    frame = spark.createDataFrame([("u", text)], "unit_id string, source_code string")
    assert {(r.operation, r.cursor_name, r.n) for r in unit_features.cursor_operations(frame).collect()} == {
        ("OPEN", "c1", 1), ("FETCH", "c1", 1), ("CLOSE", "c1", 1),
    }


def test_cursor_nesting(spark):
    text = "DECLARE\n a;\nBEGIN\n DECLARE\n  b;\n BEGIN\n  x;\n END;\nEND;\nDECLARE\n c;"
    assert one(spark, unit_features.cursor_nesting_table, text).max_cursor_nesting == 2
    assert one(spark, unit_features.cursor_nesting_table, "CURSOR c IS SELECT 1 FROM t;").max_cursor_nesting == 1


def test_dynamic_and_transactions(spark):
    text = "EXECUTE IMMEDIATE v USING a, b; OPEN c FOR q; x := :p;"
    row = one(spark, unit_features.dynamic_features, text)
    assert (row.dynamic_sql_count, row.binding_count, row.max_dynamic_nesting) == (2, 3, 1)
    text = "SAVEPOINT a; SAVEPOINT b; ROLLBACK TO a; ROLLBACK TO a; COMMIT;"
    row = one(spark, unit_features.transaction_features, text)
    assert (row.transaction_count, row.savepoint_pairs, row.transaction_nesting) == (5, 2, 2)


def test_calls_are_counted_once_without_builtins_and_self(spark):
    text = """CREATE PROCEDURE p(a NUMBER) IS
BEGIN
  q(a); r.s(a, NVL(a, 1)); x := COUNT(1); p(a - 1); own.p(2); INSERT INTO t (a) VALUES (1); fn(1); EXECUTE IMMEDIATE v;
END p;"""
    found = names.nested_calls(units.split_units(scripts(spark, text, dialect="Oracle")), listed(spark, " fn "))
    assert {(r.callee, r.n) for r in found.collect()} == {("Q", 1), ("R.S", 1), ("EXECUTE_IMMEDIATE", 1)}


def test_very_long_argument_list(spark):
    text = "CREATE PROCEDURE p(a NUMBER) IS BEGIN q(" + "'x', " * 60000 + "1); END p;"
    found = names.nested_calls(units.split_units(scripts(spark, text)), listed(spark, "none"))
    assert [(r.callee, r.n) for r in found.collect()] == [("Q", 1)]


def test_list_names_match_after_a_dot(spark):
    text = "CREATE PROCEDURE p IS BEGIN v := a.b.fn(1) + FN (2) + xfn(3); SELECT 1 FROM s.tab WHERE v = 1; END p;"
    row = scored(spark, text, "Oracle", functions=["Fn"], tables=["TAB", "s", "other"])["p"]
    assert (row.custom_function_count, row.custom_function_list) == (2, "FN")
    assert (row.high_weight_table_count, row.high_weight_table_list) == (2, "S,TAB")


def test_oracle_unit_score(spark):
    text = """CREATE PROCEDURE p IS
BEGIN
  FOR i IN 1..3 LOOP
    LOOP
      hot(i);
    END LOOP;
  END LOOP;
  SELECT id FROM t WHERE id = 1;
END p;"""
    row = scored(spark, text, "Oracle", procedures=["HOT"])["p"]
    # statements: the SELECT scores 1 + 1.5, the call log10(7) * 5
    total = 2.5 + 5 * 0.8450980400142568
    expected = total * 1.2 + 2 * 2.5 * (1 + 1.5) + 3.0 + 2.5
    assert row.score == pytest.approx(expected, abs=1e-6)
    assert (row.nested_call_list, row.high_weight_procedure_count) == ("HOT", 1)


def test_gauss_unit_score(spark):
    text = "CREATE PROCEDURE p IS BEGIN SELECT id FROM t JOIN u ON t.i = u.i WHERE id = 1; COMMIT; END p;"
    row = scored(spark, text, "Gauss")["p"]
    assert row.score == 2 * 10 + 15 + 5 + 10 + 20
    assert row.score_full == 2 * 10 + 15 + 5 + 10 + 20
    idle = scored(spark, "CREATE PROCEDURE p IS BEGIN SELECT id FROM t; END p;", "Gauss")["p"]
    assert idle.score == 30 and idle.score_full == 10


def test_unit_without_statements_scores_zero(spark):
    assert scored(spark, "CREATE PROCEDURE p IS BEGIN NULL; END p;", "Gauss")["p"].score == 0


def test_hive_counts_its_extras_again(spark):
    row = scored(spark, "SELECT a FROM t SORT BY a;", "Hive")["f0"]
    assert row.score == pytest.approx(1.0 + 1.0 + 1.0)


def test_calls_inside_and_outside(spark):
    found = units.split_units(scripts(spark, PACKAGE, dialect="Oracle"))
    row = packages.package_call_split(found, listed(spark, "none")).collect()[0]
    assert (row.internal_calls, row.external_calls, row.dependencies) == (2, 1, "first>second,second>first")
    depth = {r.unit_id: (r.depth, r.is_recursive) for r in packages.call_chain_depth(found, listed(spark, "none")).collect()}
    assert depth == {"s0:first": (None, True), "s0:second": (None, True)}


def test_portable_patterns_have_no_possessive_quantifier():
    assert "++" not in P.portable(P.CALL_TOKEN) and "*+" not in P.portable(P.CALL_TOKEN)


def test_two_scripts_add_up(spark):
    first = "CREATE PROCEDURE a IS BEGIN SELECT 1 FROM t WHERE x = 1; END a;"
    second = "CREATE PROCEDURE b IS BEGIN DELETE FROM t; run(1); END b;"
    count = lambda *t: statements.extract_statements(units.split_units(scripts(spark, *t))).count()
    assert count(first, second) == count(first) + count(second) == count(first + "\n" + second)


def test_plan_never_shuffles_text(spark):
    frame = scripts(spark, PACKAGE)
    empty = listed(spark, "none")
    plan = score_scripts(frame, features.weight_table(spark), empty, empty, empty)._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in plan.splitlines() if "Aggregate [unit_id" in line and "collect_list" in line)
    assert "source_code" not in aggregate and "src" not in aggregate


HEADERS = [
    "FUNCTION d RETURN NUMBER DETERMINISTIC IS BEGIN RETURN 1; END;",
    "PROCEDURE a AUTHID CURRENT_USER IS BEGIN NULL; END;",
    "FUNCTION p RETURN rows_t PIPELINED IS BEGIN RETURN; END;",
    "FUNCTION r(x integer) RETURNS integer AS $$ BEGIN RETURN 1; END; $$",
    "PROCEDURE b(x NUMBER DEFAULT f(g(1))) IS BEGIN NULL; END;",
]


def test_header_clauses_keep_their_units(spark):
    for dialect in ("Oracle", "Gauss"):
        found = units.split_units(scripts(spark, *[f"CREATE OR REPLACE {h}" for h in HEADERS], dialect=dialect)).collect()
        assert sorted(u.unit_name for u in found) == ["a", "b", "d", "p", "r"]


def test_dropped_parts_are_listed(spark):
    texts = ["INSERT INTO before_it SELECT 1 FROM t;\nCREATE PROCEDURE p5 IS BEGIN NULL; END;", PACKAGE, "SELECT 1 FROM t"]
    found = units.dropped_parts(scripts(spark, *texts, dialect="Oracle")).collect()
    assert sorted((r.script_id, r.reason) for r in found) == [("s1", "declaration without a body")]


def test_doubled_quotes_in_dynamic_literals(spark):
    text = "PROCEDURE p IS BEGIN EXECUTE IMMEDIATE 'UPDATE t2 SET a = ''x'' WHERE id = 1'; END;"
    rows = statements.extract_statements(units.split_units(scripts(spark, text))).filter("origin = 'dynamic'").collect()
    assert [r.sql for r in rows] == ["UPDATE t2 SET a = 'x' WHERE id = 1"]


def test_long_texts_take_little_time(spark):
    import time

    from pyspark.sql import functions as F

    body = "BEGIN x := 1; EXCEPTION WHEN OTHERS THEN NULL; END; ROLLBACK;\n" * 16_000
    names_ = ", ".join(f"t{i} AS a{i}" for i in range(10_000))
    frame = spark.createDataFrame([(body, f"SELECT 1 FROM {names_} WHERE 1 = 1")], "unit string, stmt string")
    start = time.monotonic()
    row = frame.select(unit_features.rollback_block_depth(F.col("unit")).alias("depth"), F.size(tables.read_names(tables.flat_parts(F.col("stmt")), F.lit("SELECT"))).alias("n")).first()
    assert row.n == 10_000 and row.depth == 2 and time.monotonic() - start < 30


def test_rollback_blocks_count_their_begins(spark):
    from pyspark.sql import functions as F

    cases = [("BEGIN a; EXCEPTION b; ROLLBACK; END", 1), ("BEGIN BEGIN x; END; EXCEPTION BEGIN ROLLBACK; END; END", 3), ("BEGIN x; END; ROLLBACK", 0), ("", 0)]
    frame = spark.createDataFrame([(t, n) for t, n in cases], "t string, n int")
    assert frame.filter(unit_features.rollback_block_depth(F.col("t")) != F.col("n")).count() == 0


def plan(frame):
    frame.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "1000")
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_counts_are_added_up_in_one_walk(spark):
    text = "CREATE PROCEDURE a(x NUMBER) IS BEGIN SELECT a.c FROM t a JOIN u b ON a.k = b.k WHERE a.c = 1; UPDATE t SET c = 1 WHERE c = 2; END a;"
    unit = units.split_units(scripts(spark, text, dialect="Oracle"))
    measured = unit_scores.measured_units(unit, features.weight_table(spark))
    assert plan(measured).count("aggregate(measured#") == 1
    m = measured.first()["m"]
    assert (m["statement_count"], m["join_count"], m["where_condition_count"], m["table_count"]) == (2, 1, 2, 3)


def test_statements_end_at_the_first_semicolon():
    text = "SELECT 1\n ; x; update t set c = 1 \n; DELETE t"
    for pattern in P.BODY_STATEMENT.values():
        found = [[m.group(0) for m in re.finditer(p, text)] for p in (pattern, P.to_semicolon(pattern))]
        assert found[0] == found[1] and len(found[0]) == 2


def test_calls_are_resolved_from_one_split(spark):
    edges = packages.call_edges(units.split_units(scripts(spark, PACKAGE)), listed(spark))
    assert "PROCEDURE" not in plan(edges)
