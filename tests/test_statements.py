"""Hand-derived values for single statements."""

import pytest
from pyspark.sql import functions as F

from scriptgauge.operators import features, lineage, statements, tables


def frame(spark, *rows):
    data = [(str(i), dialect, sql) for i, (dialect, sql) in enumerate(rows)]
    return statements.classify(statements.prepare(spark.createDataFrame(data, "stmt_id string, dialect string, sql string")))


def measure(spark, dialect, sql):
    found = features.scored(features.statement_features(frame(spark, (dialect, sql))), features.weight_table(spark))
    return found.collect()[0]


def typed(spark, dialect, sql):
    row = frame(spark, (dialect, sql)).collect()[0]
    return row.parsed_type, row.fail_reason


SCORES = [
    ("Oracle", "SELECT id FROM staff WHERE dept = 10", 2.5),
    ("Gauss", "SELECT id FROM staff WHERE dept = 10", 15.0),
    ("Hive", "SELECT id FROM staff WHERE dept = 10 SORT BY id", 3.5),
    # 2 tables, 1 join, WHERE + AND = 2, 1 subquery, COUNT, GROUP BY, ORDER BY
    (
        "Oracle",
        "SELECT d.n, COUNT(*) FROM dept d JOIN staff s ON s.d = d.id WHERE s.v > 1 AND s.k IN (SELECT k FROM dept) GROUP BY d.n ORDER BY 2",
        2 * 1.0 + 2.0 + 2 * 1.5 + 3.0 + 1.0 + 1.5 + 1.0,
    ),
    ("Gauss", "DELETE FROM a WHERE id IN (SELECT id FROM b)", 10.0),
    ("Hive", "INSERT OVERWRITE TABLE a SELECT * FROM b", 2.0),
    ("Oracle", "UPDATE abc SET v = 1", 5 * 1.2 * 1.3010299956639813),  # 20 characters
]


@pytest.mark.parametrize("dialect,sql,score", SCORES)
def test_score(spark, dialect, sql, score):
    assert measure(spark, dialect, sql).score == pytest.approx(score)


TYPES = [
    ("Oracle", "SELECT * FROM", ("SELECT", "missing_from")),
    ("Oracle", "SELECT id\nFROM t WHERE id = 1", ("SELECT", None)),
    ("Oracle", "-- note\nWITH q AS (SELECT 1 FROM a) SELECT * FROM q", ("SELECT", None)),
    ("Oracle", "SELECT 1", ("SELECT", "too_short")),
    ("Gauss", "INSERT tab VALUES (1, 'x')", ("INSERT", "missing_into")),
    ("Hive", "INSERT OVERWRITE TABLE a SELECT * FROM b", ("INSERT", None)),
    ("Hive", "LOAD DATA INPATH 'x' TABLE a", ("LOAD", "missing_into_table")),
    ("Oracle", "LOAD DATA INPATH 'x' TABLE a", ("UNKNOWN", "unrecognised")),
    ("Oracle", "UPDATE t WHERE id = 1", ("UPDATE", "missing_set")),
    ("Oracle", "'SELECT 1 FROM t '||v", ("DYNAMIC_SQL", None)),
    ("Gauss", "pkg.run(1, 'a');", ("CALL", None)),
    ("Gauss", "COMMIT", ("COMMIT", None)),
    ("Hive", "  ", ("UNKNOWN", "empty")),
]


@pytest.mark.parametrize("dialect,sql,expected", TYPES)
def test_type(spark, dialect, sql, expected):
    assert typed(spark, dialect, sql) == expected


READS = [
    ("SELECT 1 FROM a, b x , s.c WHERE a.id = 1", ["a", "b", "s.c"]),
    ("WITH q AS (SELECT 1 FROM t1), r AS (SELECT 2 FROM t2) SELECT * FROM q JOIN r ON 1 = 1", ["t1", "t2"]),
    ("SELECT 1 FROM A JOIN a ON 1 = 1 LEFT JOIN B ON 2 = 2", ["a", "b"]),
]


@pytest.mark.parametrize("sql,names", READS)
def test_reads(spark, sql, names):
    row = tables.with_names(frame(spark, ("Gauss", sql))).collect()[0]
    assert row.reads == names


WRITES = [
    ("DELETE mid_t WHERE code = 'x' AND day = 'y';", "mid_t"),
    ("DELETE FROM s.t WHERE id = 1", "s.t"),
    ("MERGE INTO goal g USING src s ON (g.id = s.id) WHEN MATCHED THEN UPDATE SET g.v = s.v", "goal"),
    ("UPDATE T x SET v = 1", "t"),
]


@pytest.mark.parametrize("sql,target", WRITES)
def test_write_target(spark, sql, target):
    assert tables.write_targets(frame(spark, ("Gauss", sql)), ["stmt_id"]).collect()[0].target == target


def test_dynamic_tables(spark):
    rows = frame(spark, ("Oracle", "'SELECT 1 FROM a JOIN b ON 1 = 1 WHERE id = '||v"), ("Oracle", "'x'||'y' and more"))
    found = {(r.stmt_id, r.table_name) for r in tables.dynamic_table_refs(rows, ["stmt_id"]).collect()}
    assert found == {("0", "a"), ("0", "b"), ("1", "DYNAMIC_TABLE")}


def test_lineage(spark):
    rows = frame(
        spark,
        ("Hive", "INSERT OVERWRITE TABLE b SELECT * FROM a"),
        ("Hive", "CREATE TABLE c AS SELECT * FROM b JOIN a ON a.i = b.i"),
        ("Hive", "INSERT INTO x SELECT * FROM y"),
        ("Hive", "INSERT INTO y SELECT * FROM x"),
    )
    edges = {(r.source, r.target) for r in lineage.lineage_edges(rows).collect()}
    assert edges == {("a", "b"), ("b", "c"), ("a", "c"), ("y", "x"), ("x", "y")}
    depth = {r.table_name: (r.depth, r.is_recursive) for r in lineage.lineage_depth(rows).collect()}
    assert depth == {"a": (1, False), "b": (2, False), "c": (3, False), "x": (None, True), "y": (None, True)}


def test_comment_changes_nothing(spark):
    sql = "SELECT a.x FROM a JOIN b ON a.i = b.i WHERE a.x > 1"
    noisy = "/* JOIN z\n WHERE */ SELECT a.x -- FROM q\nFROM a JOIN b ON a.i = b.i WHERE a.x > 1"
    left, right = measure(spark, "Oracle", sql), measure(spark, "Oracle", noisy)
    assert [left[c] for c in features.SCORED] == [right[c] for c in features.SCORED]


def test_counts_are_not_negative(spark, small):
    from scriptgauge.plans import catalog

    lows = catalog.QUERIES["stmt_features"](spark, small).agg(*[F.min(c).alias(c) for c in features.SCORED]).collect()[0]
    assert min(lows) >= 0
