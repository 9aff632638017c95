"""Registered queries: each operator over the whole derived corpus.

Every entry takes a session and a table folder and returns a DataFrame with
plain columns. Long texts leave as their md5 and length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import corpus_ops, features, lineage, moves, names, packages, routing, score_sketches, statements, table_pairs, tables, unit_features, units
from ..session import scratch_path
from ..sources import archives, corpus, feedback, readers, sinks
from ..streaming import accounting, jobs
from . import unit_scores as scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def long(value) -> F.Column:
    return value.cast("bigint")


def size_of(text) -> F.Column:
    return long(F.length(text))


# --- inputs ----------------------------------------------------------------
def _statements(spark, sf):
    return statements.classify(statements.prepare(corpus.statements(spark, sf)))


def _units(spark, sf):
    return units.split_units(corpus.scripts(spark, sf))


def _package_units(spark, sf):
    return units.split_units(corpus.packages(spark, sf))


def _unit_statements(spark, sf):
    return statements.classify(statements.extract_statements(_units(spark, sf)))


def _all_statements(spark, sf):
    """Single statements and those inside procedures and packages."""
    wanted = ["unit_id", "dialect", "parsed_type", "type", "fail_reason", "sql"]
    single = _statements(spark, sf).withColumn("unit_id", F.lit(None).cast("string"))
    return single.select(wanted).unionByName(_unit_statements(spark, sf).select(wanted))


def _functions(spark, sf):
    return corpus.derive(spark, sf, corpus.LIST_FUNCTIONS)


def _tables(spark, sf):
    return corpus.derive(spark, sf, corpus.LIST_TABLES)


def _procedures(spark, sf):
    return corpus.derive(spark, sf, corpus.LIST_PROCEDURES)


def _lists(spark, sf):
    return names.name_flags(_functions(spark, sf), _tables(spark, sf), _procedures(spark, sf))


def score_units(spark, unit_rows, sf):
    return scoring.unit_scores(unit_rows, features.weight_table(spark), _lists(spark, sf))


def _scores(spark, sf):
    return score_units(spark, _units(spark, sf), sf)


# --- sources and sinks -----------------------------------------------------
@query
def scan_scripts(spark, sf):
    return corpus.scripts(spark, sf).select("script_id", "dialect", size_of("src").alias("chars"), F.md5("src").alias("text_hash"))


@query
def scan_files(spark, sf):
    path = scratch_path(spark, "packed")
    readers.write_packed_files(corpus.scripts(spark, sf), path)
    return readers.read_packed_files(spark, path).groupBy(F.md5("src").alias("text_hash")).agg(F.count("*").alias("copies"))


@query
def default_fill(spark, sf):
    return routing.fill_defaults(corpus.scripts(spark, sf)).groupBy("schema_name", "dialect").agg(F.count("*").alias("scripts"))


@query
def scan_zip(spark, sf):
    written = archives.write_archives(corpus.scripts(spark, sf), scratch_path(spark, "zip"))
    return _member_columns(archives.read_members(archives.member_index(written)))


@query
def stream_zip(spark, sf):
    folder = scratch_path(spark, "zip")
    archives.write_archives(corpus.scripts(spark, sf), folder)
    # a batch keeps what is asked of its members, not their texts
    read = lambda batch: _member_columns(archives.read_members(archives.member_index(batch)))
    return jobs.run_batches(archives.stream_archives(spark, folder), read, "stream-zip")


def _member_columns(members):
    return members.select(
        routing.base_name(F.col("member")).alias("base_name"), "charset", size_of("src").alias("chars"), F.md5("src").alias("text_hash")
    )


@query
def charset_audit(spark, sf):
    scripts = corpus.derive(spark, sf, corpus.CORPUS_PROCEDURES)
    number = F.substring("script_id", 2, 20).cast("bigint") % 3
    marked = scripts.select(
        "script_id",
        F.when(number == 0, "utf-8").when(number == 1, "gbk").otherwise("iso-8859-1").alias("charset"),
        F.concat("src", F.when(number == 0, " -- 表 é").when(number == 1, " -- 数据").otherwise(" -- é x")).alias("src"),
    )
    decoded = readers.decode_texts(readers.encode_texts(marked))
    return decoded.select("script_id", "charset", size_of("src").alias("chars"), F.md5("src").alias("text_hash"))


@query
def name_lists(spark, sf):
    lists = {"functions": _functions, "tables": _tables, "procedures": _procedures}
    result = None
    for label, source in lists.items():
        part = names.clean_list(source(spark, sf)).select(F.lit(label).alias("list"), "name")
        result = part if result is None else result.unionByName(part)
    return result


@query
def route_scripts(spark, sf):
    return routing.route(corpus.scripts(spark, sf)).select("script_id", "kind", "base_name")


@query
def failed_rows(spark, sf):
    _, failed = routing.split_failed(corpus.scripts(spark, sf))
    return failed.select("script_id", "dialect", "fail_reason")


@query
def report_export(spark, sf):
    return sinks.report(_scores(spark, sf)).toDF(*[name.lower().replace(" ", "_") for name in sinks.REPORT_COLUMNS])


@query
def feedback_scan(spark, sf):
    return feedback.scan(corpus.feedback_lines(spark, sf)).select("line_no", "feedbackType", "extension", "stored_name")


@query
def feedback_latest(spark, sf):
    return feedback.latest(corpus.feedback_lines(spark, sf)).select("line_no", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "contactPerson")


@query
def feedback_migrate(spark, sf):
    return feedback.migrate(corpus.feedback_lines(spark, sf)).select("line_no", "contentDescription", "dialect", "comments")


@query
def feedback_quarantine(spark, sf):
    return feedback.quarantine(corpus.feedback_lines(spark, sf)).select("line_no", "line")


@query
def feedback_join_scripts(spark, sf):
    stored = corpus.scripts(spark, sf).select("path", "script_id", size_of("src").alias("chars"))
    return feedback.with_script(corpus.feedback_lines(spark, sf), stored, "in/").select("line_no", "script_id", "chars")


# --- text preparation ------------------------------------------------------
@query
def strip_comments(spark, sf):
    clean = T.without_comments(F.col("src"))
    return corpus.scripts(spark, sf).select("script_id", size_of(clean).alias("chars"), F.md5(clean).alias("text_hash"))


@query
def line_count(spark, sf):
    return corpus.scripts(spark, sf).select("script_id", T.line_count(F.col("src")).alias("lines"))


@query
def split_statements(spark, sf):
    return statements.split_text(corpus.scripts(spark, sf)).select("script_id", "stmt_no", size_of("sql").alias("chars"), F.md5("sql").alias("text_hash"))


def _extracted(spark, sf, origin):
    rows = statements.extract_statements(_units(spark, sf)).filter(F.col("origin") == origin)
    return rows.select("unit_id", "stmt_no", size_of("sql").alias("chars"), F.md5("sql").alias("text_hash"))


@query
def extract_statements(spark, sf):
    return _extracted(spark, sf, statements.SQL)


@query
def extract_calls(spark, sf):
    return _extracted(spark, sf, statements.CALL)


@query
def extract_dynamic_literals(spark, sf):
    return _extracted(spark, sf, statements.DYNAMIC)


@query
def package_detect(spark, sf):
    return routing.with_package(corpus.scripts(spark, sf)).select("script_id", "dialect", "is_package")


@query
def package_names(spark, sf):
    return routing.with_package(corpus.scripts(spark, sf)).filter("is_package").select("script_id", "package_name")


@query
def hive_udf_units(spark, sf):
    return units.hive_function_units(corpus.scripts(spark, sf)).select("script_id", "unit_kind", "unit_name", size_of("source_code").alias("chars"))


@query
def split_units(spark, sf):
    return _units(spark, sf).select("unit_id", "unit_kind", "qualified_name", "pos", size_of("source_code").alias("chars"), F.md5("source_code").alias("text_hash"))


@query
def units_with_body(spark, sf):
    return units.chunk_rows(corpus.scripts(spark, sf)).select("script_id", "pos", "unit_kind", "unit_name", "has_body")


@query
def dropped_parts(spark, sf):
    return units.dropped_parts(corpus.scripts(spark, sf))


@query
def dedupe_units(spark, sf):
    """Names that a script defines more than once, and how many definitions it has."""
    bodies = units.chunk_rows(corpus.scripts(spark, sf)).filter("has_body")
    return bodies.groupBy("script_id", "key").agg(F.count("*").alias("definitions"), F.min("pos").alias("kept_pos")).filter("definitions > 1")


# --- classification --------------------------------------------------------
@query
def stmt_type_counts(spark, sf):
    return _statements(spark, sf).groupBy("dialect", "parsed_type").agg(F.count("*").alias("n"))


@query
def validate_statements(spark, sf):
    return _statements(spark, sf).select("stmt_id", "parsed_type", "type", "fail_reason")


@query
def dynamic_statements(spark, sf):
    return _statements(spark, sf).filter("parsed_type = 'DYNAMIC_SQL'").select("stmt_id", "dialect", size_of("sql").alias("chars"))


@query
def dml_catalogue(spark, sf):
    rows = features.statement_features(_unit_statements(spark, sf)).filter(F.col("type").isin(*P.DML_TYPES))
    return rows.select("unit_id", "stmt_no", "type", "table", "where_condition", "line_count", T.joined(F.col("table_names")).alias("table_list"))


@query
def failed_statements(spark, sf):
    failed = _unit_statements(spark, sf).filter("fail_reason IS NOT NULL")
    return failed.groupBy("unit_id").agg(
        F.count("*").alias("failures"), F.array_join(F.array_sort(F.collect_list("fail_reason")), ",").alias("reasons")
    )


# --- tables ----------------------------------------------------------------
@query
def table_refs(spark, sf):
    return tables.table_refs(_statements(spark, sf), ["stmt_id"])


@query
def write_targets(spark, sf):
    return tables.write_targets(_statements(spark, sf), ["stmt_id"])


@query
def lineage_edges(spark, sf):
    return lineage.lineage_edges(_statements(spark, sf))


@query
def lineage_depth(spark, sf):
    return lineage.lineage_depth(_statements(spark, sf))


@query
def lineage_components(spark, sf):
    return lineage.lineage_components(_all_statements(spark, sf))


@query
def lineage_reach(spark, sf):
    return lineage.lineage_reach(_all_statements(spark, sf))


@query
def ddl_targets(spark, sf):
    return tables.ddl_targets(_statements(spark, sf), ["stmt_id"])


@query
def dynamic_table_refs(spark, sf):
    return tables.dynamic_table_refs(_statements(spark, sf), ["stmt_id"])


@query
def unit_tables(spark, sf):
    return tables.unit_tables(_units(spark, sf))


@query
def type_decl_tables(spark, sf):
    return tables.type_declaration_tables(_units(spark, sf))


# --- statement features ----------------------------------------------------
@query
def stmt_features(spark, sf):
    return features.statement_features(_statements(spark, sf)).select("stmt_id", "dialect", "type", *features.SCORED, "query_depth", "line_count")


@query
def stmt_features_long(spark, sf):
    return features.features_long(features.statement_features(_statements(spark, sf)), ["stmt_id"])


@query
def stmt_scores(spark, sf):
    valid = features.statement_features(_statements(spark, sf).filter("fail_reason IS NULL"))
    return features.scored(valid, features.weight_table(spark)).select("stmt_id", "dialect", "type", F.round("score", 6).alias("score"))


# --- unit features ---------------------------------------------------------
@query
def loop_features(spark, sf):
    return unit_features.loop_features(_units(spark, sf))


@query
def loop_nesting(spark, sf):
    return unit_features.loop_nesting_table(_units(spark, sf))


@query
def cursor_features(spark, sf):
    return unit_features.cursor_features(_units(spark, sf))


@query
def cursor_operations(spark, sf):
    return unit_features.cursor_operations(_units(spark, sf))


@query
def cursor_nesting(spark, sf):
    return unit_features.cursor_nesting_table(_units(spark, sf))


@query
def dynamic_sql_features(spark, sf):
    return unit_features.dynamic_features(_units(spark, sf))


@query
def transaction_features(spark, sf):
    return unit_features.transaction_features(_units(spark, sf))


@query
def java_units(spark, sf):
    return unit_features.java_units(_units(spark, sf))


# --- names -----------------------------------------------------------------
@query
def custom_function_calls(spark, sf):
    return names.custom_function_calls(_units(spark, sf), _functions(spark, sf))


@query
def high_weight_tables(spark, sf):
    return names.high_weight_tables(_unit_statements(spark, sf), _tables(spark, sf))


@query
def nested_calls(spark, sf):
    return names.nested_calls(_units(spark, sf), _functions(spark, sf))


@query
def call_sites(spark, sf):
    return names.call_table(_units(spark, sf))


@query
def high_weight_procedures(spark, sf):
    calls = names.nested_calls(_units(spark, sf), _functions(spark, sf))
    return names.high_weight_procedures(calls, _procedures(spark, sf))


# --- unit and package scores -----------------------------------------------
ROLLUP = ["statement_count", "table_ref_count", "distinct_tables", "query_depth", "failed_count", *[f + "_count" for f in features.SCORED[1:]]]
SCORE_COLUMNS = [
    "unit_id", "dialect", "table_count", "table_list", "loop_count", "max_loop_nesting", "cursor_count",
    "cursor_operation_count", "max_cursor_nesting", "custom_function_count", "custom_function_list",
    "high_weight_table_count", "high_weight_table_list", "nested_call_count", "nested_call_list",
    "high_weight_procedure_count", "high_weight_procedure_list", "score", "score_full",
]


@query
def unit_rollup(spark, sf):
    return _scores(spark, sf).select("unit_id", *ROLLUP, F.round("statement_score", 6).alias("statement_score"))


@query
def unit_scores(spark, sf):
    return _scores(spark, sf).select(*SCORE_COLUMNS)


@query
def package_rollup(spark, sf):
    return packages.package_rollup(_scores(spark, sf))


@query
def package_features(spark, sf):
    return packages.package_features(corpus.scripts(spark, sf))


@query
def package_call_split(spark, sf):
    return packages.package_call_split(_package_units(spark, sf), _functions(spark, sf))


@query
def call_edges(spark, sf):
    return packages.call_edges(_units(spark, sf), _functions(spark, sf))


@query
def call_chain_depth(spark, sf):
    return packages.call_chain_depth(_package_units(spark, sf), _functions(spark, sf))


@query
def call_components(spark, sf):
    return packages.call_components(_units(spark, sf), _functions(spark, sf))


@query
def package_chain_depth(spark, sf):
    unit_rows = _package_units(spark, sf)
    return packages.package_chain_depth(packages.call_chain_depth(unit_rows, _functions(spark, sf)), unit_rows)


# --- corpus questions ------------------------------------------------------
@query
def top_units(spark, sf):
    return corpus_ops.top_units(_scores(spark, sf)).select("dialect", "rn", "unit_id", "score")


@query
def score_distribution(spark, sf):
    return corpus_ops.score_distribution(_scores(spark, sf))


@query
def score_quantiles(spark, sf):
    return corpus_ops.score_quantiles(_scores(spark, sf))


@query
def score_quantiles_by_month(spark, sf):
    return score_sketches.quantiles_by_month(score_sketches.daily_sketches(_scores(spark, sf)))


@query
def corpus_cube(spark, sf):
    return corpus_ops.corpus_cube(_all_statements(spark, sf))


@query
def hot_tables(spark, sf):
    return corpus_ops.hot_tables(_all_statements(spark, sf))


@query
def join_partners(spark, sf):
    return corpus_ops.join_partners(_all_statements(spark, sf))


#: Fewest statements that a reported pair of tables shares.
PAIR_SUPPORT = 5


@query
def frequent_table_pairs(spark, sf):
    named = tables.with_names(_all_statements(spark, sf)).select(F.concat("reads", "writes", "dynamic_refs").alias("names"))
    return table_pairs.table_pairs(named, PAIR_SUPPORT)


@query
def list_coverage(spark, sf):
    return corpus_ops.list_coverage(_all_statements(spark, sf), _tables(spark, sf))


@query
def version_diff(spark, sf):
    new = score_units(spark, units.split_units(corpus.derive(spark, sf, corpus.CORPUS_SCRIPTS_V2)), sf)
    return corpus_ops.version_diff(_scores(spark, sf), new)


@query
def version_moves(spark, sf):
    new = units.split_units(corpus.derive(spark, sf, corpus.CORPUS_MOVED))
    return moves.version_moves(_units(spark, sf), new).select("old_unit_id", "new_unit_id")


@query
def duplicate_statements(spark, sf):
    return corpus_ops.duplicate_statements(_statements(spark, sf))


@query
def dialect_table_sets(spark, sf):
    return corpus_ops.dialect_table_sets(tables.table_refs(_all_statements(spark, sf), []))


@query
def score_over_time(spark, sf):
    return corpus_ops.score_over_time(_scores(spark, sf))


# --- streams ---------------------------------------------------------------
def _script_stream(spark, sf):
    orders = jobs.read_stream(spark, sf, "orders.parquet")
    return corpus.derive(spark, sf, corpus.CORPUS_PROCEDURES, {"orders": orders})


def _feedback_stream(spark, sf):
    events = jobs.read_stream(spark, sf, "events.parquet")
    return feedback.valid(corpus.derive(spark, sf, corpus.FEEDBACK, {"events": events}))


@query
def stream_scripts(spark, sf):
    def score(batch):
        # the rows of orders are dealt out before they grow into scripts
        scripts = corpus.derive(batch.sparkSession, sf, corpus.CORPUS_PROCEDURES, {"orders": corpus.spread(batch, corpus.KEYS["orders"], batch.count())})
        return score_units(spark, units.split_units(scripts), sf).select("unit_id", "dialect", "statement_count", "score")

    return jobs.run_batches(jobs.read_stream(spark, sf, "orders.parquet"), score, "stream-scores")


@query
def stream_windows(spark, sf):
    rows = jobs.run_to_table(jobs.arrivals(_script_stream(spark, sf)), "stream-windows")
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "dialect", "scripts", long(F.col("chars")).alias("chars"))


#: Batches that the files of scripts arrive in.
ARRIVALS = 4


@query
def stream_accounted(spark, sf):
    """All scripts, arriving as files that are in no order of time: counts of closed windows with the rows that came late."""
    files = ARRIVALS * spark.sparkContext.defaultParallelism
    tables_of = {name: spark.read.parquet(f"{sf}/{name}.parquet").repartition(files, key) for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey"))}
    scripts = corpus.derive(spark, sf, corpus.CORPUS_SCRIPTS, tables_of).select("script_id", "dialect", "ts", "src")
    folder = scratch_path(spark, "arriving")
    scripts.write.parquet(folder)
    stream = spark.readStream.schema(scripts.schema).option("maxFilesPerTrigger", 2 * files // ARRIVALS).parquet(folder)
    rows = accounting.totals(accounting.account(stream, "stream-accounted"))
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "dialect", (F.col("on_time") + F.col("late")).alias("scripts"), "chars")


@query
def stream_dedup(spark, sf):
    return jobs.run_to_table(jobs.distinct_texts(_script_stream(spark, sf)), "stream-dedup")


@query
def stream_sessions(spark, sf):
    rows = jobs.run_to_table(jobs.feedback_sessions(_feedback_stream(spark, sf)), "stream-sessions")
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return rows.select(
        "contactPerson", F.date_format("session_start", stamp).alias("started"), F.date_format("session_end", stamp).alias("ended"), "entries"
    )
