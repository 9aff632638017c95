"""Graphs, distributions, files, feedback and streams."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from scriptgauge.operators import corpus_ops, graph, names
from scriptgauge.plans import catalog
from scriptgauge.session import scratch_path
from scriptgauge.sources import archives, corpus, feedback, readers, sinks


def brute_depth(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())

    def walk(node, seen):
        if node in seen:
            return None
        best = 0
        for nxt in out[node]:
            below = walk(nxt, seen | {node})
            if below is None:
                return None
            best = max(best, below)
        return best + 1

    return {n: walk(n, frozenset()) for n in out}


def test_chain_depth_against_brute_force(spark):
    rng = random.Random(7)
    for cyclic in (False, True):
        pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)}
        if cyclic:
            pairs |= {(3, 1), (20, 18), (18, 20), (1, 3)}
        edges = {(f"n{a}", f"n{b}") for a, b in pairs}
        found = graph.chain_depth(spark.createDataFrame(sorted(edges), "src string, dst string")).collect()
        assert {r.node: r.depth for r in found} == brute_depth(edges)
        assert all(r.is_recursive == (r.depth is None) for r in found)


def test_score_distribution_against_windows(spark):
    rng = random.Random(3)
    rows = [(d, round(rng.choice([0.0, 7.5, rng.random() * 40]), 6), f"u{i}") for i, d in enumerate("ABAAB" * 60)]
    scores = spark.createDataFrame(rows, "dialect string, score double, unit_id string")
    scores.createOrReplaceTempView("scores")
    expected = spark.sql(
        """SELECT DISTINCT dialect, score, rank() OVER w AS r, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c
           FROM scores WINDOW w AS (PARTITION BY dialect ORDER BY score)"""
    ).collect()
    found = corpus_ops.score_distribution(scores).select("dialect", "score", "score_rank", "percent_rank", "cume_dist").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected))


def test_top_units_limits_before_the_shuffle(spark, small):
    plan = catalog.QUERIES["top_units"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_charset_order(spark):
    texts = {"utf-8": "SELECT 'é表' FROM t", "gbk": "SELECT '数据' FROM t", "iso-8859-1": "SELECT 'é x' FROM t"}
    rows = [(charset, text.encode(charset)) for charset, text in texts.items()]
    found = readers.decode_texts(spark.createDataFrame(rows, "script_id string, content binary")).collect()
    assert {r.script_id: (r.charset, r.src) for r in found} == {c: (c, t) for c, t in texts.items()}


def test_archive_members(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("a/", "")
        archive.writestr("a/one.SQL", "SELECT 1 FROM t;")
        archive.writestr("../two.sql", "SELECT 2 FROM t;")
        archive.writestr("a/note.txt", "no")
    (tmp_path / "x.zip").write_bytes(buffer.getvalue())
    found = archives.read_archives(spark, str(tmp_path)).collect()
    assert {(r.member, r.src) for r in found} == {("a/one.SQL", "SELECT 1 FROM t;"), ("../two.sql", "SELECT 2 FROM t;")}


def test_sql_files_and_name_lists(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.sql").write_text("SELECT 1\nFROM t;\n")
    found = readers.read_sql_files(spark, str(tmp_path / "sub")).collect()
    assert found[0].src == "SELECT 1\nFROM t;\n" and found[0].path.endswith("/sub/a.sql")
    (tmp_path / "list.txt").write_text(" fn_a \n\nFN_A\nb\n")
    listed = names.clean_list(readers.read_name_list(spark, str(tmp_path / "list.txt")))
    assert {r.name for r in listed.collect()} == {"FN_A", "B"}


def test_report_and_json_round_trip(spark, small):
    scores = catalog._scores(spark, small).filter("dialect = 'Gauss'")
    path = scratch_path(spark, "report")
    sinks.write_report(scores, path)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    assert back.columns == list(sinks.REPORT_COLUMNS) and back.count() == scores.count()
    folder = scratch_path(spark, "json")
    sinks.write_json(scores.select("unit_id", "score"), folder)
    total = lambda frame: frame.agg(F.count("*"), F.round(F.sum("score"), 3)).collect()[0]
    assert total(spark.read.schema("unit_id string, score double").json(folder)) == total(scores)


def test_feedback(spark):
    rows = [
        (1, None, '{"feedbackType":"bug","content":"old","originalFilename":"a.b.sql","unknown":1}'),
        (2, None, '{"feedbackType":"idea","contentDescription":"new"}'),
        (3, None, "{broken"),
    ]
    lines = spark.createDataFrame(rows, "line_no bigint, ts timestamp, line string")
    assert [r.line for r in feedback.quarantine(lines).collect()] == ["{broken"]
    assert {r.line_no: r.contentDescription for r in feedback.migrate(lines).collect()} == {1: "old", 2: "new"}
    assert {r.line_no: r.extension for r in feedback.scan(lines).collect()}[1] == ".sql"
    path = scratch_path(spark, "feedback")
    feedback.append(feedback.migrate(lines), path)
    feedback.append(feedback.migrate(lines), path)
    assert spark.read.json(path).count() == 4


def test_stream_equals_batch(spark, small):
    batch = catalog.score_units(spark, catalog.units.split_units(catalog.corpus.derive(spark, small, catalog.corpus.CORPUS_PROCEDURES)), small)
    stream = catalog.QUERIES["stream_scripts"](spark, small)
    columns = ["unit_id", "dialect", "statement_count", "score"]
    assert sorted(map(tuple, stream.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))


def test_bad_archives_and_members_are_rows_with_an_error(spark):
    good = io.BytesIO()
    with zipfile.ZipFile(good, "w") as archive:
        archive.writestr("a.sql", "SELECT 1 FROM t")
        archive.writestr("b.sql", "SELECT 2 FROM t")
    broken = bytearray(good.getvalue())
    broken[broken.index(b"SELECT 2")] ^= 1
    frame = spark.createDataFrame([("x.zip", bytearray(b"no zip")), ("y.zip", broken)], "path string, content binary")
    rows = {(r.archive, r.member): (r.src, r.error is not None) for r in readers.expand_archives(frame).collect()}
    assert rows == {("x.zip", None): (None, True), ("y.zip", "a.sql"): ("SELECT 1 FROM t", False), ("y.zip", "b.sql"): (None, True)}


def test_paths_that_climb_out_are_refused(spark):
    import json

    paths = ["in/a.sql", "in/../../etc/passwd", "in/..", "in/a..b.sql", "out/a.sql"]
    lines = spark.createDataFrame([(i, None, json.dumps({"filePath": p})) for i, p in enumerate(paths)], "line_no long, ts timestamp, line string")
    stored = spark.createDataFrame([(p,) for p in paths], "path string")
    found = feedback.with_script(lines, stored, "in/")
    assert sorted(r.filePath for r in found.collect()) == ["in/a..b.sql", "in/a.sql"]


def test_quantiles_are_exact_above_a_million_scores(spark):
    scores = spark.range(3_000_001).select(F.lit("Gauss").alias("dialect"), (F.col("id") / 1000).alias("score"))
    row = corpus_ops.score_quantiles(scores).first()
    assert (row.p25, row.p50, row.p75, row.p90) == (750.0, 1500.0, 2250.0, 2700.0)


def test_a_table_that_feeds_itself_is_recursive(spark):
    edges = spark.createDataFrame([("a", "a"), ("b", "a"), ("c", "d")], "src string, dst string")
    found = {r.node: (r.depth, r.is_recursive) for r in graph.chain_depth(edges).collect()}
    assert found == {"a": (None, True), "b": (None, True), "c": (2, False), "d": (1, False)}


def test_version_diff_covers_packages(spark, small):
    states = {r.state for r in catalog.QUERIES["version_diff"](spark, small).filter("unit_id like 'c%'").select("state").distinct().collect()}
    assert states == {"added", "removed", "changed"}


def test_tasks_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus, "ROWS_PER_TASK", 10, raising=False)
    keys = [None, *range(1, 400)]
    spark.createDataFrame([(k, 1, 1, 1, 1) for k in keys], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_extendedprice int").write.parquet(str(tmp_path / "lineitem.parquet"))
    rows = corpus.statements(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 40 and rows.count() == 400
