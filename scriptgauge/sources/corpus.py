"""A script corpus derived from the star-schema tables.

The tables hold no SQL text, so every row is turned into a script by one SQL
expression that means the same in Spark and in any engine with ``CASE``, ``||``
and ``chr``. The corpus therefore grows with the tables. About a third of the
statements read one hot table and a third of the calls go to one hot procedure.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import settle


def text_expression(template: str, **values: str) -> str:
    """A SQL string expression for ``template``; ``{name}`` becomes the SQL in ``values``."""
    pieces = []
    for part in re.split(r"(\{\w+\}|\n)", template.strip("\n")):
        if not part:
            continue
        if part == "\n":
            pieces.append("chr(10)")
        elif part.startswith("{") and part.endswith("}"):
            pieces.append(values[part[1:-1]])
        else:
            pieces.append("'" + part.replace("'", "''") + "'")
    return " || ".join(pieces)


def choose(selector: str, templates: list[str], **values: str) -> str:
    """``CASE selector WHEN i THEN <template i>`` with the last template as ELSE."""
    branches = [f"WHEN {i} THEN {text_expression(t, **values)}" for i, t in enumerate(templates[:-1])]
    return f"CASE {selector} {' '.join(branches)} ELSE {text_expression(templates[-1], **values)} END"


def _text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


STATEMENTS = [
    "SELECT a.c1, a.c2 FROM {t1} a WHERE a.c1 > {n} AND a.c2 = 'x' ORDER BY a.c1",
    """
SELECT a.c1, COUNT(*) AS cnt, SUM(b.amount) AS total,
       CASE WHEN SUM(b.amount) > {n} THEN 'big' ELSE 'small' END AS label
FROM {t1} a
JOIN {t2} b ON a.id = b.id
LEFT JOIN dim_region r ON r.id = a.region_id
WHERE a.status = 'A' OR a.kind = {n}
GROUP BY a.c1
ORDER BY total DESC""",
    "SELECT x.c1, y.c2 FROM {t1} x, {t2} y, dim_date WHERE x.id = y.id AND x.d = {n}",
    """
SELECT c1 FROM {t1}
WHERE id IN (SELECT id FROM {t2} WHERE v > (SELECT AVG(v) FROM {t2}))
  AND EXISTS ( SELECT 1 FROM dim_date d WHERE d.k = {n})""",
    """
-- two steps
WITH q AS (SELECT id, MAX(v) AS v FROM {t1} GROUP BY id), r AS (SELECT id FROM {t2})
SELECT q.id, q.v FROM q JOIN r ON q.id = r.id WHERE q.v > {n}""",
    """
SELECT c1 FROM {t1} WHERE c1 = {n}
UNION ALL
SELECT c1 FROM {t2}
MINUS
SELECT c1 FROM dim_region""",
    "INSERT INTO {tgt} (c1, c2) SELECT a.c1, f_conv(b.c2) FROM {t1} a JOIN {src} b ON a.id = b.id WHERE a.c1 = {n}",
    "UPDATE {t1} SET c1 = calc_tax(c2), c3 = {n} WHERE id = {n} AND c2 IS NOT NULL",
    "DELETE FROM {t1} WHERE id = {n}",
    """
MERGE INTO {tgt} d USING {src} s ON (d.id = s.id)
WHEN MATCHED THEN UPDATE SET d.v = s.v
WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v)""",
    "'SELECT c1 FROM {t1} a JOIN {t2} b ON a.id = b.id WHERE a.id = '||v_id||' AND b.k = {n}'",
    """
INSERT OVERWRITE TABLE {tgt}
SELECT u.id, e.tag, SUM(u.v) OVER (PARTITION BY u.id ORDER BY u.d) AS s
FROM {src} u LATERAL VIEW explode(u.tags) e AS tag
WHERE u.d = {n} DISTRIBUTE BY u.id SORT BY u.d""",
    "{ddl}",
    "{call}",
    "{bad}",
    """
/* reads nothing FROM nowhere
   JOIN nobody */
SELECT id, RANK() OVER (PARTITION BY region ORDER BY v DESC) AS rk, -- FROM a_comment
       AVG(v) OVER (PARTITION BY region) AS m
FROM {t1}
WHERE v > {n}
  AND note <> 'none'
CLUSTER BY id""",
    "{shape}",
]
SHAPES = [
    'SELECT a.c1 FROM (SELECT id FROM {t1}) a, {t2} b, "Dim Region" r WHERE a.id = b.id AND r.k = {n}',
    "WITH q(id) AS (SELECT id FROM {t1}) INSERT INTO {tgt} SELECT q.id FROM q JOIN {src} s ON s.id = q.id",
    "INSERT ALL INTO {tgt} (c1) VALUES (c1) INTO log_t (c1) VALUES (c1) SELECT c1 FROM {src} WHERE c1 = {n}",
    "FROM {src} s INSERT OVERWRITE TABLE {tgt} SELECT s.c1 WHERE s.c1 = {n} INSERT OVERWRITE TABLE log_t SELECT s.c2",
    "INSERT OVERWRITE DIRECTORY 'out/{n}' SELECT c1 FROM {src}",
    "SELECT EXTRACT(YEAR FROM a.d), TRIM(BOTH ' ' FROM a.c1) FROM {t1} a WHERE a.c1 IS DISTINCT FROM a.c2",
    "UPDATE ONLY {t1} AS g SET v = {n} FROM {t2} WHERE g.note = 'from x, y; join z'",
    "SELECT `Odd Name`.c1 FROM `Odd Name` JOIN ({t1} x JOIN {t2} y ON x.id = y.id) ON 1 = {n}",
]
DDL = [
    "CREATE TABLE IF NOT EXISTS {tgt} AS SELECT c1, c2 FROM {src} WHERE c1 = {n}",
    "LOAD DATA INPATH 'in/{n}' INTO TABLE {tgt}",
    "ALTER TABLE {t1} ADD COLUMNS (c{n} INT)",
    "TRUNCATE TABLE {tgt}",
    "MSCK REPAIR TABLE {t2}",
    "DROP TABLE IF EXISTS {tgt}",
    "GRANT SELECT ON {t1} TO role_{n}",
    "DELETE {t1};",
]
CALLS = [
    "pkg_{p}.p_{p}_1({n}, 'a')",
    "p_hot({n});",
    "COMMIT",
    "ROLLBACK",
    "SHOW PARTITIONS {t1}",
    "DESCRIBE {t2}",
]
BAD = [
    "SELECT * FROM",
    "UPDATE {t1} WHERE id = {n}",
    "INSERT {tgt} VALUES ({n}, 'x')",
    "SELECT 1",
    "-- nothing but a comment",
    "LOAD DATA INPATH 'in/{n}' TABLE {tgt}",
    "frobnicate the {t1}",
]

_LINE_VALUES = {
    "t1": f"(CASE WHEN l_linenumber <= 2 THEN 'hot_t' ELSE 't_' || {_text('l_partkey % 50')} END)",
    "t2": f"'s.t_' || {_text('l_suppkey % 7')}",
    "n": _text("l_orderkey % 100"),
    "p": _text("l_suppkey % 60"),
    "tgt": f"'dw_' || {_text('l_partkey % 400')}",
    "src": f"'dw_' || {_text('CAST(floor((l_partkey % 400) / 3) AS BIGINT)')}",
}


def _statement_text() -> str:
    inner = {
        "ddl": "(" + choose("l_suppkey % 8", DDL, **_LINE_VALUES) + ")",
        "call": "(" + choose("l_suppkey % 6", CALLS, **_LINE_VALUES) + ")",
        "bad": "(" + choose("l_partkey % 7", BAD, **_LINE_VALUES) + ")",
        "shape": "(" + choose("l_partkey % 8", SHAPES, **_LINE_VALUES) + ")",
    }
    return choose("(l_orderkey * 7 + l_linenumber) % 17", STATEMENTS, **_LINE_VALUES, **inner)


CORPUS_STATEMENTS = f"""
SELECT {_text('l_orderkey')} || '-' || {_text('l_linenumber')} || '-' || {_text('l_partkey')} || '-' || {_text('l_suppkey')}
         || '-' || {_text('CAST(floor(l_extendedprice) AS BIGINT)')} AS stmt_id,
       CASE l_orderkey % 3 WHEN 0 THEN 'Oracle' WHEN 1 THEN 'Gauss' ELSE 'Hive' END AS dialect,
       {_statement_text()} AS sql
FROM lineitem
"""

PROCEDURES = [
    """
CREATE OR REPLACE PROCEDURE {name}(p_id IN NUMBER, p_rate NUMBER) IS
  v_total NUMBER := 0;
BEGIN
  -- one loop, FROM nothing
  FOR r IN (SELECT id, v FROM {t1} WHERE id = p_id) LOOP
    v_total := v_total + fn_{f}(r.v, p_rate);
    {proc}(r.id, v_total);
  END LOOP;
  INSERT INTO log_t (id, msg) VALUES (p_id, 'done');
  COMMIT;
END {name};
/""",
    """
CREATE OR REPLACE PROCEDURE {name}(p_n NUMBER) AS
  i NUMBER;
BEGIN
  FOR i IN 1..10 LOOP
    WHILE i < p_n LOOP
      LOOP
        UPDATE {t1} SET v = v + 1 WHERE id = i;
        EXIT WHEN i > 3;
      END LOOP;
    END LOOP;
  END LOOP;
  FOR j IN 1..3 LOOP
    DELETE FROM {t2} WHERE id = j AND v = fn_{f}(j);
  END LOOP;
END {name};""",
    """
CREATE PROCEDURE {name}(p_dept NUMBER, p_out OUT SYS_REFCURSOR) IS
  CURSOR c_emp(p_d NUMBER) IS
    SELECT id, name FROM {t1} WHERE dept = p_d;
  CURSOR c_all IS SELECT id FROM {t2} FOR UPDATE;
  v_row {t1}.name%TYPE;
  v_log db_log.msg%TYPE;
BEGIN
  OPEN c_emp(p_dept);
  FETCH c_emp INTO v_row;
  CLOSE c_emp;
  FOR x IN c_all LOOP
    {proc}(x.id);
  END LOOP;
  OPEN p_out FOR SELECT id FROM {t1};
END {name};""",
    """
CREATE OR REPLACE PROCEDURE {name}(p_v NUMBER) IS
  v_sql VARCHAR2(200);
BEGIN
  EXECUTE IMMEDIATE 'UPDATE {t1} SET v = 1 WHERE id = 5';
  EXECUTE IMMEDIATE v_sql USING p_v, v_sql;
  SELECT id INTO v_sql FROM {t2} WHERE note = 'k='||p_v||' x' AND id = 'a' || 'b';
  SELECT MAX(v) INTO v_sql FROM {t2} WHERE d = :d AND e = :e;
END {name};""",
    """
CREATE OR REPLACE PROCEDURE {name} IS
  PRAGMA AUTONOMOUS_TRANSACTION;
BEGIN
  SAVEPOINT sp_a;
  INSERT INTO {t1} SELECT id, v FROM {t2} WHERE v > {n};
  SAVEPOINT sp_b;
  ROLLBACK TO SAVEPOINT sp_b;
  ROLLBACK TO sp_a;
  COMMIT;
EXCEPTION
  WHEN OTHERS THEN
    ROLLBACK;
END {name};""",
    """
CREATE OR REPLACE PROCEDURE {name}(p_id NUMBER) IS
BEGIN
  BEGIN
    {proc}(p_id, fn_{f}(p_id));
    pkg_{k}.p_{k}_1(p_id);
    {name}(p_id - 1);
    CALL pkg_{k}.p_{k}_2;
  EXCEPTION
    WHEN OTHERS THEN
      ROLLBACK;
  END;
  util.fn_{f}({n});
END;""",
    """
SELECT a.id, b.v FROM {t1} a JOIN {t2} b ON a.id = b.id WHERE a.id = {n};
INSERT INTO {tgt} SELECT id, v FROM {src};
SET v.mode=fast;
UPDATE {t1} SET v = {n} WHERE id IN (SELECT id FROM {t2});""",
    """
CREATE OR REPLACE PROCEDURE {name}(p_in VARCHAR2) AS LANGUAGE JAVA
NAME 'app.Tool.run(java.lang.String, oracle.sql.CLOB)';
/""",
    """
CREATE OR REPLACE PACKAGE pkg_s{n} AS
  PROCEDURE {name}(p_id NUMBER);
  FUNCTION fn_{f}(p_v NUMBER) RETURN NUMBER;
END pkg_s{n};""",
    """
/* {name} has
   PROCEDURE fake(x NUMBER) IS only in comments
*/
CREATE FUNCTION {name}(p_a NUMBER, p_b VARCHAR2(10)) RETURN NUMBER IS
  -- LOOP END LOOP CURSOR c IS SELECT
  v NUMBER;
BEGIN
  SELECT COUNT(*) INTO v FROM {t1}, {t2} WHERE a = p_a; -- {proc}(1);
  DECLARE
    CURSOR c_in IS SELECT 1 FROM DUAL;
  BEGIN
    DECLARE
      w NUMBER;
    BEGIN
      w := fn_{f}(v);
    END;
  END;
  RETURN v;
END {name};""",
    """
CREATE TEMPORARY FUNCTION fn_{f} AS 'app.udf.Fn{f}';
CREATE FUNCTION {name} AS 'app.udf.Main' USING JAR 'x.jar';
INSERT OVERWRITE TABLE {tgt} SELECT fn_{f}(v), COUNT(*) FROM {src} GROUP BY v;
SELECT k FROM {t2} LATERAL VIEW explode(tags) x AS k SORT BY k;""",
    """
UPDATE {t1} SET v = 0 WHERE note = 'PROCEDURE none(x) IS;';
CREATE OR REPLACE PROCEDURE "Proc {k}"(p_id NUMBER, p_sep VARCHAR2(5) DEFAULT '; ') IS
  v VARCHAR2(50) := 'PROCEDURE fake(x) IS; ';
BEGIN
  {proc}(outer_{k}(inner_{f}(p_id, fn_{f}(1)), 'a, b'), (p_id + 1) * 2);
  v := calc_{f}(p_id);
  IF p_id > 0 THEN
    tidy_{f}(v);
  END IF;
  SELECT "Odd Col" INTO v FROM "Odd Table" WHERE note = 'x; DELETE FROM nowhere;' AND id = p_id;
END;""",
    """{blank}""",
]

_ORDER_VALUES = {
    "name": f"'proc_' || {_text('o_orderkey')}",
    "t1": f"(CASE WHEN o_custkey % 3 = 1 THEN 'hot_t' ELSE 't_' || {_text('o_custkey % 50')} END)",
    "t2": f"'s.t_' || {_text('o_custkey % 7')}",
    "tgt": f"'dw_' || {_text('o_custkey % 400')}",
    "src": f"'dw_' || {_text('CAST(floor((o_custkey % 400) / 3) AS BIGINT)')}",
    "proc": f"(CASE WHEN o_orderkey % 36 < 12 THEN 'p_hot' ELSE 'p_' || {_text('o_custkey % 97')} END)",
    "f": _text("o_custkey % 20"),
    "k": _text("o_custkey % 300"),
    "n": _text("o_orderkey % 100"),
    "blank": "(CASE WHEN o_orderkey % 24 < 12 THEN '' ELSE 'SELECT id FROM t_1 WHERE id = 1;' || chr(10) || chr(10) END)",
}
_ORDER_VALUES_V2 = {
    **_ORDER_VALUES,
    "t2": "(CASE WHEN o_orderkey % 10 = 0 THEN 't_new JOIN t_more ON t_new.id = t_more.id' "
    f"ELSE 's.t_' || {_text('o_custkey % 7')} END)",
}


def _orders_scripts(values: dict[str, str]) -> str:
    return f"""
SELECT 'o' || {_text('o_orderkey')} AS script_id,
       'in/b' || {_text('o_orderkey % 100')} || '/proc_' || {_text('o_orderkey')}
         || (CASE WHEN o_orderkey % 5 = 0 THEN '.SQL' ELSE '.sql' END) AS path,
       CASE WHEN o_orderkey % 97 = 5 THEN 'Sybase' WHEN o_custkey % 3 = 0 THEN 'Oracle'
            WHEN o_custkey % 3 = 1 THEN 'Gauss' ELSE 'Hive' END AS dialect,
       CASE WHEN o_orderkey % 5 = 1 THEN NULL ELSE 'sch_' || {_text('o_custkey % 4')} END AS schema_name,
       CAST(o_orderdate AS TIMESTAMP) AS ts,
       {choose('o_orderkey % 13', PROCEDURES, **values)} AS src
FROM orders
"""


PACKAGE = """
CREATE OR REPLACE PACKAGE BODY pkg_{k} AS
  g_count NUMBER := 0;
  g_name VARCHAR2(30);
  c_max CONSTANT NUMBER := {n};
  TYPE t_list IS TABLE OF NUMBER;

  PROCEDURE p_{k}_0(p_id NUMBER);

  PROCEDURE p_{k}_1(p_id NUMBER, p_name VARCHAR2(20)) IS
  BEGIN
    SELECT COUNT(*) INTO g_count FROM {t1} WHERE id = p_id;
    p_{k}_2(p_id);
    p_{k}_4(p_id);
    {outer}
    ext_audit.write_{n}(p_id);
  END p_{k}_1;

  FUNCTION p_{k}_2(p_id NUMBER) RETURN NUMBER IS
    CURSOR c_x IS SELECT id FROM {t2};
  BEGIN
    FOR r IN c_x LOOP
      UPDATE {t1} SET v = fn_{n}(r.id) WHERE id = r.id;
    END LOOP;
    {next}
    RETURN 1;
  END p_{k}_2;
{third}{fourth}END pkg_{k};
/"""
PACKAGE_THIRD = """
  PROCEDURE p_{k}_3(p_id NUMBER) IS
  BEGIN
    INSERT INTO {tgt} SELECT id, v FROM {src} WHERE id = p_id;
    COMMIT;
    {loop}
  END p_{k}_3;
"""
PACKAGE_FOURTH = """
  PROCEDURE p_{k}_4 IS
  BEGIN
    EXECUTE IMMEDIATE 'TRUNCATE TABLE stage_{n}';
    DELETE FROM {t2};
  END p_{k}_4;

  PROCEDURE P_{k}_4 IS
  BEGIN
    DELETE FROM never_reached;
  END;

  PROCEDURE p_{k}_4(p_id NUMBER, p_sep VARCHAR2(5) DEFAULT ';') IS
  BEGIN
    DELETE FROM s.reached WHERE id = p_id;
  END;
"""


def _packages(second: bool = False) -> str:
    """Packages; in the second version every tenth reads other tables, some got a third procedure and some lost it."""
    values = {
        "k": _text("c_custkey"),
        "n": _text("c_custkey % 20"),
        "t1": f"(CASE WHEN c_custkey % 3 = 0 THEN 'hot_t' ELSE 't_' || {_text('c_custkey % 50')} END)",
        "t2": f"'s.t_' || {_text('c_nationkey % 7')}",
        "tgt": f"'dw_' || {_text('c_custkey % 400')}",
        "src": f"'dw_' || {_text('CAST(floor((c_custkey % 400) / 3) AS BIGINT)')}",
    }
    half = _text("CAST(floor(c_custkey / 2) AS BIGINT)")
    values["outer"] = (
        f"(CASE WHEN c_custkey % 9 = 4 OR c_custkey = 0 THEN 'NULL;' "
        f"ELSE 'pkg_' || {half} || '.p_' || {half} || '_1(p_id, ' || chr(39) || 'x' || chr(39) || ');' END)"
    )
    values["next"] = f"(CASE WHEN c_custkey % 4 = 0 THEN 'NULL;' ELSE 'p_' || {_text('c_custkey')} || '_3(p_id);' END)"
    values["loop"] = (
        f"(CASE WHEN c_custkey % 7 = 3 THEN 'p_' || {_text('c_custkey')} || '_2(p_id - 1);' ELSE 'NULL;' END)"
    )
    without_third = "c_custkey % 4 = 0"
    if second:
        without_third = "c_custkey % 8 = 0 OR c_custkey % 20 = 3"
        values["t2"] = f"(CASE WHEN c_custkey % 10 = 0 THEN 't_new JOIN t_more ON t_new.id = t_more.id' ELSE {values['t2']} END)"
    third = text_expression(PACKAGE_THIRD.strip("\n"), **values)
    fourth = text_expression(PACKAGE_FOURTH.strip("\n"), **values)
    values["third"] = f"(CASE WHEN {without_third} THEN '' ELSE chr(10) || {third} || chr(10) END)"
    values["fourth"] = f"(CASE WHEN c_custkey % 4 < 2 THEN '' ELSE chr(10) || {fourth} || chr(10) END)"
    return f"""
SELECT 'c' || {_text('c_custkey')} AS script_id,
       'in/pkg/pkg_' || {_text('c_custkey')} || '.sql' AS path,
       CASE WHEN c_custkey % 2 = 0 THEN 'Oracle' ELSE 'Gauss' END AS dialect,
       CASE WHEN c_custkey % 6 = 1 THEN NULL ELSE 'sch_' || {_text('c_nationkey')} END AS schema_name,
       CAST('2001-01-01 00:00:00' AS TIMESTAMP) AS ts,
       {text_expression(PACKAGE, **values)} AS src
FROM customer
"""


CORPUS_PROCEDURES = _orders_scripts(_ORDER_VALUES)
CORPUS_PROCEDURES_V2 = _orders_scripts(_ORDER_VALUES_V2)
CORPUS_PACKAGES = _packages()
CORPUS_SCRIPTS = CORPUS_PROCEDURES + " UNION ALL " + CORPUS_PACKAGES
CORPUS_SCRIPTS_V2 = CORPUS_PROCEDURES_V2 + " UNION ALL " + _packages(second=True)

#: The corpus with units that have moved to another script (every 17th order) or got another name (some of packages and orders), texts unchanged.
_NUMBER = "CAST(substr(script_id, 2) AS BIGINT)"
MOVED_SCRIPT = f"(CASE WHEN substr(script_id, 1, 1) = 'o' AND {_NUMBER} % 17 = 3 THEN 'moved_' || script_id ELSE script_id END)"
RENAMED = (
    f"(CASE WHEN substr(script_id, 1, 1) = 'c' AND {_NUMBER} % 5 = 2 THEN replace({{0}}, 'p_' || substr(script_id, 2) || '_3', 'q_' || substr(script_id, 2) || '_3') "
    f"WHEN substr(script_id, 1, 1) = 'o' AND {_NUMBER} % 11 = 2 THEN replace({{0}}, 'proc_' || substr(script_id, 2), 'task_' || substr(script_id, 2)) ELSE {{0}} END)"
)
CORPUS_MOVED = f"SELECT {MOVED_SCRIPT} AS script_id, path, dialect, schema_name, ts, {RENAMED.format('src')} AS src FROM ({CORPUS_SCRIPTS})"

LIST_FUNCTIONS = f"SELECT DISTINCT ' fn_' || {_text('p_size % 15')} AS name FROM part UNION ALL SELECT 'Util.Fn_3' UNION ALL SELECT '  '"
LIST_TABLES = f"SELECT DISTINCT 'T_' || {_text('p_size % 12')} AS name FROM part UNION ALL SELECT 'hot_t' UNION ALL SELECT 's'"
LIST_PROCEDURES = f"SELECT DISTINCT 'p_' || {_text('s_suppkey % 40')} || ' ' AS name FROM supplier UNION ALL SELECT 'P_HOT'"

FEEDBACK = f"""
SELECT event_id AS line_no,
       CASE WHEN event_id % 97 = 0 THEN '{{"feedbackType": broken ' || {_text('event_id')}
       ELSE '{{"feedbackType":"' || event_type || '","'
            || (CASE WHEN event_id % 10 = 0 THEN 'content' ELSE 'contentDescription' END)
            || '":"text ' || {_text('event_id')} || '","dialect":"'
            || (CASE user_id % 3 WHEN 0 THEN 'Oracle' WHEN 1 THEN 'Gauss' ELSE 'Hive' END)
            || '","comments":"v ' || {_text('event_id % 13')}
            || '","filePath":"' || (CASE WHEN event_id % 8 = 0 THEN '/etc/x' ELSE 'in/pkg/pkg_' || {_text('user_id % 150')} || '.sql' END)
            || '","originalFilename":"pkg_' || {_text('user_id')} || '.v1.sql","contactPerson":"u' || {_text('user_id')}
            || '","contactInfo":"u' || {_text('user_id')} || '@x"}}' END AS line,
       CAST(ts AS TIMESTAMP) AS ts
FROM events
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


KEYS = {
    "orders": ["o_orderkey"],
    "lineitem": ["l_orderkey", "l_partkey"],
    "customer": ["c_custkey"],
    "events": ["event_id"],
}


#: Rows that one task turns into scripts and measures: about a minute of work, however large a table is.
ROWS_PER_TASK = 50_000


def spread(rows: DataFrame, keys: list[str] | None, count: int | None = None) -> DataFrame:
    """Use every core, and as many tasks as the rows are worth, when a table comes in fewer splits than that.

    A row is a few bytes in its table and a whole script here, so a split that is small as a
    file may be hours of work. Only the short key rows move, before they grow into scripts.
    ``count`` is the number of rows, if it is known. A table with enough splits is left as it is.
    """
    wanted = rows.sparkSession.sparkContext.defaultParallelism
    if count is not None:
        wanted = max(wanted, -(-count // ROWS_PER_TASK))
    if not keys or rows.rdd.getNumPartitions() >= wanted:
        return rows
    return rows.repartition(wanted, *keys)


def derive(spark: SparkSession, sf_dir: str, sql: str, source: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run one of the corpus expressions on the parquet tables below ``sf_dir`` or on frames given in ``source``."""
    for name in TABLES:
        used = rf"\bFROM {name}\b"
        if re.search(used, sql):
            rows = (source or {}).get(name)
            if rows is None:
                rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
                if name in KEYS:  # counted from the files' footers
                    rows = spread(rows, KEYS[name], rows.count())
            rows.createOrReplaceTempView(f"corpus_{name}")
            sql = re.sub(used, f"FROM corpus_{name}", sql)
    frame = spark.sql(sql)
    texts = [name for name in ("src", "sql", "line") if name in frame.columns]
    return settle(frame, {name: frame[name] for name in texts}) if texts else frame


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CORPUS_STATEMENTS)


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CORPUS_SCRIPTS)


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, CORPUS_PACKAGES)


def feedback_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(spark, sf_dir, FEEDBACK)
