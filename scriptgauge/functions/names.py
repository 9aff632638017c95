"""Names that look like calls but belong to the language."""

SHARED = """
VALUES SELECT INSERT UPDATE DELETE MERGE CREATE ALTER DROP TRUNCATE GRANT REVOKE
DECLARE BEGIN EXCEPTION END IF THEN ELSE ELSIF LOOP WHILE FOR EXIT CONTINUE RETURN GOTO EXCEPTION_INIT PRAGMA WHEN
VARCHAR VARCHAR2 CHAR NUMBER DATE TIMESTAMP BOOLEAN INTEGER FLOAT DOUBLE DECIMAL BINARY BLOB CLOB NCLOB
RAW LONG ROWID UROWID REF CURSOR
NVL SUBSTR TO_CHAR TO_DATE TO_NUMBER SYSDATE TRUNC ROUND LENGTH UPPER LOWER TRIM MONTHS_BETWEEN DECODE REPLACE
LTRIM RTRIM GREATEST LEAST ABS SIGN MOD FLOOR CEIL POWER SQRT EXP LN LOG SIN COS TAN ASIN ACOS ATAN ATAN2
NULL NOT AND OR BETWEEN LIKE IN EXISTS
COUNT SUM AVG MAX MIN
""".split()

ORACLE_ONLY = """
DBMS_OUTPUT DBMS_SQL UTL_FILE INSTR ADD_MONTHS NEXT_DAY LAST_DAY LPAD RPAD SINH COSH TANH
RAISE OTHERS NO_DATA_FOUND TOO_MANY_ROWS VALUE_ERROR ZERO_DIVIDE DUP_VAL_ON_INDEX
DUAL USER_TABLES ALL_TABLES DBA_TABLES USER_OBJECTS ALL_OBJECTS DBA_OBJECTS USER_SEQUENCES ALL_SEQUENCES
DEFAULT CONSTRAINT INDEX PRIMARY FOREIGN KEY UNIQUE CHECK REFERENCES CASCADE SET ALL ANY SOME
""".split()

GAUSS_ONLY = """
CEILING COT SUBSTRING CAST COALESCE NULLIF CURRENT_DATE CURRENT_TIMESTAMP EXTRACT
IS OVER PARTITION BY ORDER ASC DESC ROW_NUMBER RANK DENSE_RANK LEAD LAG FIRST_VALUE LAST_VALUE
WHERE GROUP HAVING UNION INTERSECT MINUS EXCEPT CASE WITH AS ON USING DEL
""".split()

BUILTINS = {"Oracle": SHARED + ORACLE_ONLY, "Gauss": SHARED + GAUSS_ONLY, "Hive": []}
