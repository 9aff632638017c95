"""Costly parts of the text expressions are computed once per text, with the same results."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scriptgauge.functions import patterns as P
from scriptgauge.functions import text as T
from scriptgauge.operators import corpus_ops, features, names, tables, units


def optimised(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def scripts(spark):
    text = "SET x = 1;\nCREATE PROCEDURE s.p(a INT DEFAULT 1, b INT) AS BEGIN q(a); END;\nCREATE FUNCTION f RETURN INT IS BEGIN RETURN 1; END;"
    row = ("a", "in/a.sql", "Oracle", None, None, text)
    return spark.createDataFrame([row], "script_id string, path string, dialect string, schema_name string, ts timestamp, src string")


def test_settled_columns_are_computed_in_a_projection(spark):
    value = F.regexp_replace(F.concat(F.lit("a"), F.col("id").cast("string")), "[0-9]+", "n")
    settled = T.settle(spark.range(3), {"twice": F.concat(value, value)})
    generate = [line for line in optimised(settled).splitlines() if "Generate" in line]
    assert len(generate) == 1 and "regexp_replace" not in generate[0]
    assert [tuple(r) for r in settled.collect()] == [(0, "anan"), (1, "anan"), (2, "anan")]


def test_scripts_are_cut_once_and_headers_read_once(scripts):
    found = units.split_units(scripts)
    plan = optimised(found)
    assert plan.count(P.UNIT_SPLIT) == 1
    assert plan.count(P.UNIT_HEADER_TEXT) == 1
    rows = {r.unit_name: (r.pos, r.unit_kind, r.least_args, r.most_args) for r in found.collect()}
    assert rows == {"a": (0, "SCRIPT", None, None), "p": (1, "PROCEDURE", 1, 2), "f": (2, "FUNCTION", 0, 0)}


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a\t", "\r\na b\n ", "\x0ba\x0c", " ", None])
def test_texts_without_outer_blanks_are_left_alone(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        T.trimmed(F.col("t")).alias("a"), T.trimmed_value(F.col("t")).alias("b"), T.is_blank(F.col("t")).alias("blank"),
        T.line_count(F.col("t")).alias("lines"),
    ).head()
    plain = None if text is None else text.strip(" \t\r\n")
    assert (row.a, row.b, row.blank) == (plain, plain, not plain)
    assert row.lines == (0 if not plain else text.rstrip("\r\n").count("\n") + 1)


@pytest.mark.parametrize(
    ("sql", "kind", "reads", "writes"),
    [
        ("SELECT a FROM s.t x, u JOIN v", "SELECT", ["s.t", "u", "v"], []),
        ("SELECT 1", "SELECT", [], []),
        ("UPDATE t SET a = 1", "UPDATE", [], ["t"]),
        ("INSERT INTO w SELECT DISTINCT a FROM t", "INSERT", ["t"], ["w"]),
        ("MERGE INTO w USING r ON w.a = r.a", "MERGE", ["r"], ["w"]),
        ("INSERT ALL INTO a INTO b SELECT 1 FROM t", "INSERT", ["t"], ["a", "b"]),
        ("INSERT OVERWRITE DIRECTORY 'x' SELECT a FROM t", "INSERT", ["t"], []),
        ('DELETE FROM "Odd T" WHERE a IS DISTINCT FROM b', "DELETE", [], ["odd t"]),
        ("WITH q AS (SELECT a FROM t) SELECT a FROM q, z", "SELECT", ["z", "t"], []),
    ],
)
def test_names_of_flat_and_bracketed_statements(spark, sql, kind, reads, writes):
    row = tables.with_names(spark.createDataFrame([(sql, kind)], "sql string, parsed_type string")).head()
    assert (row.reads, row.writes) == (reads, writes)


def test_suffixes_of_called_names(spark):
    row = spark.createDataFrame([("f(1); a.b.c(2); d()",)], "t string").select(names.called_suffixes(F.col("t")).alias("n")).head()
    assert row.n == ["F", "A.B.C", "B.C", "C", "D"]


def test_list_coverage_reads_the_statements_once(spark):
    texts = ["SELECT a FROM s.t, u", "SELECT a FROM s.t", "DELETE FROM v"]
    rows = spark.range(3).select(F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("id") + 1).cast("int")).alias("sql"))
    statements = rows.withColumn("parsed_type", F.regexp_extract("sql", "^[A-Z]+", 0))
    listed = spark.createDataFrame([(" s ",), ("T",), ("v",), ("w",)], "name string")
    found = corpus_ops.list_coverage(statements, listed)
    assert optimised(found).count("Range (0, 3") == 1
    assert {tuple(r) for r in found.collect()} == {
        ("S", 2, "both"), ("T", 0, "unused"), ("U", 1, "unlisted"), ("V", 1, "both"), ("W", 0, "unused"),
    }


def test_score_distribution_scores_the_units_once(spark):
    scores = spark.range(4).select(F.lit("Oracle").alias("dialect"), (F.col("id") / 2).alias("score"))
    found = corpus_ops.score_distribution(scores)
    assert "Range (0, 4" not in optimised(found)
    assert sorted((r.score, r.n, r.score_rank, r.quartile) for r in found.collect()) == [(0.0, 1, 1, 1), (0.5, 1, 2, 2), (1.0, 1, 3, 3), (1.5, 1, 4, 4)]


def test_guarded_patterns_match_the_same(spark):
    """A look at the first letter before a word boundary leaves every match as it was."""
    plain = {name: p for name, p in vars(P).items() if isinstance(p, str) and name.isupper()}
    plain |= {f"{name}:{key}": p for name, found in vars(P).items() if isinstance(found, dict) and name.isupper() for key, p in found.items()}
    changed = {name: p for name, p in plain.items() if P.guarded(p) != p}
    assert {"LOOP", "FROM_CLAUSE", "AND_OR", "UNIT_SPLIT", "BODY_STATEMENT:Oracle"} <= set(changed) and P.guarded(P.NOT_BLANK) == P.NOT_BLANK
    rng = random.Random(3)
    words = "SELECT from fRoM a.b WHERE wherever AND OR orx LOOP END loop; ( ) , JOIN update ONLY t SET é表 éFROM FROMé _from 1from INTO insert\n create OR replace PROCEDURE p(x) IS begin exception ROLLBACK end; 'x' with q as cursor c IS commit \U000f0041 \U000f0100 1".split(" ")
    texts = [rng.choice(["", " "]).join(rng.choice(words) + rng.choice(["", " ", "\n"]) for _ in range(rng.randrange(40))) for _ in range(200)] + ["", None]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for name in sorted(changed):
        p, g = changed[name], P.guarded(changed[name])
        pairs = [F.split("t", p), F.split("t", g), F.regexp_extract_all("t", F.lit(p), F.lit(0)), F.regexp_extract_all("t", F.lit(g), F.lit(0))]
        assert frame.select(*[x.alias(f"c{i}") for i, x in enumerate(pairs)]).filter("NOT (c0 <=> c1) OR NOT (c2 <=> c3)").isEmpty(), name


def test_line_counts_by_breaks(spark):
    texts = ["", None, " \n", "a", "a\n", "a\r\n\r\n", "a\n\r", "a\n\nb", "\n\na\r\nb\n\n", "a\rb", "é\n表", "a\r\n\r"]
    expected = [0 if not t or not t.strip(" \t\r\n") else len(re.findall(r"\r?\n", re.sub(r"(\r?\n)+\Z", "", t))) + 1 for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.line_count(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == expected


def test_statement_score_is_no_chain_of_sums(spark):
    """A chain of sums inside a row looks up the types of all before it at every sum."""
    counts = {name: F.lit(i + 1).cast("bigint") for i, name in enumerate(features.SCORED)}
    weights = F.struct(*[F.lit(0.1 * (i + 1)).alias(name) for i, name in enumerate(features.SCORED)])
    column = features.score_of(F.lit("x"), F.lit("SELECT"), F.lit("Hive"), counts, weights).alias("s")
    expected = 0.0
    for i in range(len(features.SCORED)):
        expected += (i + 1) * (0.1 * (i + 1))
    frame = spark.range(1).select(column)
    assert frame.first().s == expected
    assert "aggregate(array(" in frame._jdf.queryExecution().analyzed().toString()
