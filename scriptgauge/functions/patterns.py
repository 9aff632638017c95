"""Patterns that define each feature of a script.

Every pattern is a literal, so Spark compiles it once per task. Patterns are
case-insensitive. Argument lists use possessive quantifiers, which keep the
matcher's stack flat on very long calls; ``portable`` gives the same language
without them for engines that lack them.
"""

from __future__ import annotations

import re
from functools import lru_cache

ORACLE, GAUSS, HIVE = "Oracle", "Gauss", "Hive"
DIALECTS = (ORACLE, GAUSS, HIVE)


def portable(pattern: str) -> str:
    return pattern.replace("++", "+").replace("*+", "*")


def to_semicolon(pattern: str) -> str:
    """The same matches of a pattern that runs to the next semicolon, read in one stride."""
    return pattern.replace(r"[\s\S]*?\s*;", "[^;]*+;")


_WORD_STARTS = re.compile(r"(?<!\\)\\b(?:[A-Za-z](?![?*{])|\((?:\?:)?((?:[A-Za-z](?![?*{])[^()\[\]|]*\|?)+)\)(?![?*{]))")


@lru_cache(maxsize=None)
def guarded(pattern: str) -> str:
    """The same matches, with a look at the first letter before each word boundary that is followed by a word or a list of words.

    A boundary looks at the kinds of the characters on both sides of every place in the text; a letter is ruled out faster.
    """

    def with_letters(found: re.Match) -> str:
        words = found[1].split("|") if found[1] else [found[0][2:]]
        if not all(words):
            return found[0]
        return f"(?=[{''.join(sorted({word[0] for word in words}))}]){found[0]}"

    return _WORD_STARTS.sub(with_letters, pattern)


# --- comments, lines, separators -------------------------------------------
BLOCK_COMMENT = r"/\*[\s\S]*?\*/"
LINE_COMMENT = r"--[^\r\n]*"
LINE_BREAK = r"\r?\n"
TRAILING_BREAKS = r"(\r?\n)+\z"
STATEMENT_END = r"(?m);\s*$"

# --- quoted text and brackets ----------------------------------------------
# a quoted character stands in a private plane, a bracket that was taken out between two marks
NAME_CHAR = r"[\w.\x{F0000}-\x{F007F}]"
STAND_IN = r"[\x{F0000}-\x{F007F}]"
ANY_QUOTE = r"['\"`]|\$\$"
NAME_QUOTES = r"[\"`]"
_Q_QUOTES = r"[qQ]'\[[\s\S]*?\]'|[qQ]'\{[\s\S]*?\}'|[qQ]'\([\s\S]*?\)'|[qQ]'<[\s\S]*?>'|[qQ]'![\s\S]*?!'"
_QUOTES = _Q_QUOTES + r"|'(?:[^']++|'')*+'|\"[^\"\n]++\"|`[^`\n]++`"
_UNQUOTED = r"|(?:[^'\"`$qQ]|[qQ][^'\"`$])++|[\s\S]"
QUOTED_OR_PLAIN = _QUOTES + _UNQUOTED
QUOTED_OR_PLAIN_DOLLAR = _QUOTES + r"|\$\$[\s\S]*?\$\$" + _UNQUOTED
Q_QUOTE_START = r"^[qQ]'"
DOLLAR_BODY = r"(?i)\b(?:AS|IS|DO)\s*\$\$"
INNERMOST = r"\(([^()]*+)\)"
BRACKET = r"[()]"
MARK = r"\x{F0100}"
CHILD = MARK + r"(\d+)"
WHOLE_MARK = MARK + r"\d+\x{F0101}"
FIRST_BRACKET = r"^\s*" + CHILD
VISIBLE = r"\S"
NOT_BLANK = r"[^ \t\r\n]"
HAS_DEFAULT = r"(?i)\bDEFAULT\b|:="
# names are tried at their first character only
_NAME = r"(?:\b[\w.]|" + STAND_IN + ")" + NAME_CHAR + "*+"
CALL_TOKEN = _NAME + r"\s*+\((?:\s*+\))?|\(\s*+\)|[(),;]"
CALL_TOKEN_NAME = "^" + NAME_CHAR + "+"

# --- statements inside a body ----------------------------------------------
BASE_VERBS = "SELECT|INSERT|UPDATE|DELETE|MERGE|COMMIT|ROLLBACK|CREATE|ALTER|DROP|TRUNCATE|GRANT|REVOKE"
HIVE_VERBS = "LOAD|EXPORT|IMPORT|MSCK|ANALYZE|EXPLAIN|SHOW|DESCRIBE|DESC|USE|SET|RESET|ADD"
_BODY = r"(?i)\b({verbs})\b[\s\S]*?\s*;"
BODY_STATEMENT = {
    ORACLE: _BODY.format(verbs=BASE_VERBS),
    GAUSS: _BODY.format(verbs=BASE_VERBS + "|WITH"),
    HIVE: _BODY.format(verbs=BASE_VERBS + "|" + HIVE_VERBS),
}
# a call is a statement of its own: nothing but a block word stands before it
FLAT_CALL = r"(?i)(?:^|\b(?:BEGIN|THEN|ELSE|LOOP|DO|CALL|PERFORM)\b)\s*(" + NAME_CHAR + r"+\s*" + MARK + r"\d+\x{F0101})\s*$"
DYNAMIC_LITERAL = r"(?i)\bEXECUTE\s+IMMEDIATE\s+(q?'[^']+')"

# --- packages and units ----------------------------------------------------
PACKAGE_BODY = r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?PACKAGE\s+BODY\b"
PACKAGE_BODY_NAME = r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?PACKAGE\s+BODY\s+(" + NAME_CHAR + r"+)"
PACKAGE_ANY = r"(?i)\bCREATE\s+(?:OR\s+REPLACE\s+)?PACKAGE\b"
PACKAGE_END_NAME = r"(?i)\bEND\s+(PKG_\w+|\w+_PKG)\b"
PROCEDURE_HEADER = r"(?i)\bPROCEDURE\s+" + NAME_CHAR + r"+\s*[(\s]"
FUNCTION_HEADER = r"(?i)\bFUNCTION\s+" + NAME_CHAR + r"+\s*[(\s]"
UNIT_HEADER = r"(?i)\b(?:PROCEDURE|FUNCTION)\s+" + NAME_CHAR + r"+\s*[(\s]"
UNIT_SPLIT = r"(?i)(?=\b(?:PROCEDURE|FUNCTION)\s+" + NAME_CHAR + r"+\s*[(\s])"
UNIT_HEADER_TEXT = r"(?i)^(?:PROCEDURE|FUNCTION)\s+" + NAME_CHAR + r"+([^;]*?)\b(?:IS|AS|LANGUAGE)\b"
UNIT_START = r"(?i)^(PROCEDURE|FUNCTION)\s+(" + NAME_CHAR + r"+)"
# a declaration ends before any of these words, whatever clauses its header has
UNIT_WITH_BODY = r"(?i)^(?:PROCEDURE|FUNCTION)\s+[^;]*?\b(?:IS|AS|LANGUAGE)\b"
DANGLING_CREATE = r"(?i)\bCREATE(?:\s+OR\s+REPLACE)?\s*\z"
CLOSING_END = r"(?i)\bEND(?:\s+" + NAME_CHAR + r"+)?\s*;[\s/]*\z"
HIVE_UDF = r"(?i)\bCREATE\s+(?:TEMPORARY\s+)?FUNCTION\s+" + NAME_CHAR + r"+\s+AS\s+[\s\S]*?;"
HIVE_UDF_NAME = r"(?i)\bFUNCTION\s+(" + NAME_CHAR + r"+)\s+AS\b"
SQL_SUFFIX = r"(?i)\.sql$"

# --- statement classification ----------------------------------------------
FIRST_WORD = r"^\s*(\w+)\s"
TRANSACTION_WORD = r"(?i)^\s*(COMMIT|ROLLBACK)"
LEADING_CALL = r"^\s*[\w.]+\s*\("
SIMPLE_TYPES = ("INSERT", "UPDATE", "DELETE", "MERGE", "CREATE", "ALTER", "DROP", "TRUNCATE", "GRANT", "REVOKE")
HIVE_TYPES = tuple(HIVE_VERBS.split("|"))
DML_TYPES = ("INSERT", "UPDATE", "DELETE", "MERGE")
UNCHECKED_TYPES = ("CALL", "COMMIT", "ROLLBACK", "DYNAMIC_SQL")
HIVE_UNCHECKED_TYPES = ("SHOW", "DESCRIBE", "DESC", "USE", "SET", "RESET", "EXPLAIN")
CONCATENATION = r"'\s*\|\|\s*'|\|\|'|'\|\|"
HAS_FROM = r"(?i)\bFROM\s+\S"
HAS_INTO = r"(?i)\bINTO\s"
HAS_INTO_OR_OVERWRITE = r"(?i)\b(?:INTO|OVERWRITE)\s"
HAS_SET = r"(?i)\bSET\s"
HAS_INTO_TABLE = r"(?i)\bINTO\s+TABLE\b"

# --- table names -----------------------------------------------------------
# on the flat parts of a statement: brackets are numbers between marks
NAME_OR_CALL = "(" + NAME_CHAR + r"+\s*" + MARK + "?)"
NO_SOURCE = r"(?i)\b(?:DELETE|DISTINCT)\s+FROM\b"
NO_TABLE_TARGET = r"(?i)\bOVERWRITE\s+(?:LOCAL\s+)?DIRECTORY\b"
FROM_CLAUSE = (
    r"(?is)\bFROM\s+(.*?)(?:\b(?:WHERE|GROUP|ORDER|HAVING|UNION|INTERSECT|MINUS|EXCEPT|CONNECT\s+BY|START\s+WITH|LIMIT|FETCH"
    r"|FOR\s+UPDATE|WINDOW|LATERAL\s+VIEW|SELECT|INSERT|SET|CLUSTER\s+BY|DISTRIBUTE\s+BY|SORT\s+BY|RETURNING|LOOP)\b|;|\z)"
)
FROM_ITEM_END = r"(?i),|\bJOIN\b"
FROM_ITEM = r"(?i)^\s*(?:(?:ONLY|LATERAL)\s+)?" + NAME_OR_CALL
JOIN_ITEM = r"(?i)\bJOIN\s+(?:(?:ONLY|LATERAL)\s+)?" + NAME_OR_CALL
USING_ITEM = r"(?i)\bUSING\s+" + NAME_OR_CALL
IS_CALL = MARK + "$"
QUERY_PART = r"(?i)\bSELECT\b|^\s*FROM\b"
DML_PART = r"(?i)^\s*(?:INSERT|UPDATE|DELETE|MERGE|WITH)\b"
FIRST_DML = r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|MERGE)\b"
MULTI_INSERT = r"(?i)\b(INSERT)\b"
MERGE_SOURCE = r"(?i)\bUSING\s+(" + NAME_CHAR + "+)"
INSERT_TARGET = r"(?i)\b(?:INSERT\s+INTO|INSERT\s+OVERWRITE|OVERWRITE\s+INTO|MERGE\s+INTO)\s+(?:TABLE\s+)?(" + NAME_CHAR + "+)"
INSERT_ALL = r"(?i)^\s*INSERT\s+(?:ALL|FIRST)\b"
INTO_TARGET = r"(?i)\bINTO\s+(" + NAME_CHAR + "+)"
UPDATE_TARGET = r"(?i)\bUPDATE\s+(?:ONLY\s+)?(" + NAME_CHAR + r"+)(?:\s+(?:AS\s+)?\w+)?\s+SET\b"
DELETE_TARGET = r"(?i)\bDELETE\s+(?:FROM\s+)?(?:ONLY\s+)?(" + NAME_CHAR + "+)"
NOT_A_TABLE = ("set", "where", "from", "of", "table", "select", "only", "lateral", "values")
CTE_MARK = r"(?i)\bWITH\s+\S"
CTE_NAME = r"(?i)(" + NAME_CHAR + r"+)\s*(?:" + MARK + r"\d+\x{F0101}\s*)?\bAS\s*(?:NOT\s+)?(?:MATERIALIZED\s*)?" + MARK
CREATE_TABLE = r"(?i)\bCREATE\s+(?:EXTERNAL\s+)?TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?(" + NAME_CHAR + "+)"
DDL_TARGET = {
    "CREATE": CREATE_TABLE,
    "LOAD": r"(?i)\bINTO\s+TABLE\s+(" + NAME_CHAR + "+)",
    "EXPORT": r"(?i)\bTABLE\s+(" + NAME_CHAR + "+)",
    "IMPORT": r"(?i)\bTABLE\s+(" + NAME_CHAR + "+)",
    "MSCK": r"(?i)\bREPAIR\s+TABLE\s+(" + NAME_CHAR + "+)",
    "ANALYZE": r"(?i)\bTABLE\s+(" + NAME_CHAR + "+)",
    "ALTER": r"(?i)\bALTER\s+TABLE\s+(" + NAME_CHAR + "+)",
    "DROP": r"(?i)\bDROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?(" + NAME_CHAR + "+)",
    "TRUNCATE": r"(?i)\bTRUNCATE\s+TABLE\s+(" + NAME_CHAR + "+)",
    "DESCRIBE": r"(?i)\bDESCRIBE\s+(" + NAME_CHAR + "+)",
    "DESC": r"(?i)\bDESC\s+(" + NAME_CHAR + "+)",
}
DYNAMIC_FROM = r"(?i) FROM \s*(\S+)"
DYNAMIC_JOIN = r"(?i) JOIN \s*(\S+)"
TYPE_DECLARATION = r"(?i)([\w.]+)\.\w+%TYPE"

# --- statement features ----------------------------------------------------
JOIN = r"(?i)\bJOIN\b"
AND_OR = r"(?i)\bAND\b|\bOR\b"
WHERE = r"(?i)\bWHERE\b"
SUBQUERY = r"(?i)\(\s*SELECT\b"
AGGREGATE = r"(?i)\b(SUM|AVG|COUNT|MAX|MIN)\s*\("
HIVE_AGGREGATE = r"(?i)\b(COUNT|SUM|AVG|MIN|MAX|STDDEV|VARIANCE)\s*\("
CASE = r"(?i)\bCASE\b"
SET_OPERATION = r"(?i)\b(UNION|INTERSECT|MINUS|EXCEPT)\b"
ORACLE_SET_OPERATION = r"(?i)\b(UNION|INTERSECT|MINUS)\b"
GROUP_BY = r"(?i)\bGROUP\s+BY\b"
ORDER_BY = r"(?i)\bORDER\s+BY\b"
HIVE_EXTRA = {
    "lateral_view": r"(?i)\bLATERAL\s+VIEW\b",
    "distribute_by": r"(?i)\bDISTRIBUTE\s+BY\b",
    "cluster_by": r"(?i)\bCLUSTER\s+BY\b",
    "sort_by": r"(?i)\bSORT\s+BY\b",
    "partition_by": r"(?i)\bPARTITION\s+BY\b",
    "window_function": r"(?i)\bOVER\s*\(",
}
HIVE_EXTRA_WORD = {
    "lateral_view": "LATERAL",
    "distribute_by": "DISTRIBUTE",
    "cluster_by": "CLUSTER",
    "sort_by": "SORT",
    "partition_by": "PARTITION",
    "window_function": "OVER",
}

# --- unit features ---------------------------------------------------------
LOOP = r"(?i)\bLOOP\b"
END_LOOP = r"(?i)\bEND\s+LOOP\b"
LOOP_TOKEN = r"(?i)\bEND\s+LOOP\b|\bLOOP\b"
CURSOR_DECLARATION = r"(?i)\bCURSOR\s+(\w+)(?:\s*\([^)]*\))?\s+IS\b"
CURSOR_PARAMETERS = r"(?i)\bCURSOR\s+(\w+)\s*\([^)]*\)\s+IS\b"
FOR_IN = r"(?i)\bFOR\s+\w+\s+IN\s+(\w+)"
REF_CURSOR = r"(?i)\b\w+\s+(?:IN\s+OUT|OUT)\s+(?:NOCOPY\s+)?(?:SYS_)?REFCURSOR\b"
CURSOR_WITH_QUERY = r"(?i)\bCURSOR\s+\w+(?:\s*\([^)]*\))?\s+IS\s+SELECT[^;]*;"
CURSOR_FOR_UPDATE = r"(?i)\bFOR\s+UPDATE\b"
CURSOR_OPERATION = r"(?i)\b(OPEN|FETCH|CLOSE)\s+\w+"
CURSOR_OPERATION_PARTS = r"(?i)^(OPEN|FETCH|CLOSE)\s+(\w+)$"
HIVE_CURSOR = r"(?i)\bCURSOR\b"
EXECUTE_IMMEDIATE = r"(?i)\bEXECUTE\s+IMMEDIATE\b"
OPEN_FOR = r"(?i)\bOPEN\s+\w+\s+FOR\s+\w+"
BIND_VARIABLE = r":\w+"
USING_CLAUSE = r"(?i)\bUSING\s+[^;]+"
TRANSACTION_CONTROL = r"(?i)\b(COMMIT|ROLLBACK|SAVEPOINT)\b"
SAVEPOINT_NAME = r"(?i)\bSAVEPOINT\s+(\w+)"
ROLLBACK_NAME = r"(?i)\bROLLBACK\s+TO\s+(?:SAVEPOINT\s+)?(\w+)"
ROLLBACK_BLOCK = r"(?i)\bBEGIN\b[\s\S]*?\bEXCEPTION\b[\s\S]*?\bROLLBACK\b[\s\S]*?\bEND\b"
BLOCK_TOKEN = r"(?i)\b(?:BEGIN|EXCEPTION|ROLLBACK|END)\b"
BEGIN_TEXT = r"(?i)BEGIN"
AUTONOMOUS = r"(?i)\bPRAGMA\s+AUTONOMOUS_TRANSACTION\b"
JAVA_UNIT = r"(?i)\bLANGUAGE\s+JAVA\b"
JAVA_TYPE = r"(?i)\b(oracle\.sql|java\.lang)\.[A-Za-z]+\b"

# --- names used in calls ---------------------------------------------------
CALLED_NAME = "(" + _NAME + r")\s*+\("
INTO_NAME = r"(?i)\bINTO\s+" + NAME_CHAR + "+"
VALID_NAME = r"^[A-Z][A-Z0-9_]*+(?:\.[A-Z][A-Z0-9_]*+)*+$"
HIVE_CALL = r"(?i)\bCALL\s+([\w.]+)"

# --- packages --------------------------------------------------------------
PACKAGE_MEMBER = r"(?i)\b(PROCEDURE|FUNCTION)\s+\w+"
PACKAGE_VARIABLE = r"(?im)^\s*\w+\s+[\w()%]+\s*(?::=|;)"
PACKAGE_CONSTANT = r"(?im)^\s*\w+\s+CONSTANT\s"
PACKAGE_TYPE = r"(?im)^\s*TYPE\s+\w+\s+IS\b"
GLOBAL_TEMPORARY = r"(?i)\bGLOBAL\s+TEMPORARY\s+TABLE\b"
PRIVILEGE = r"(?i)\b(GRANT|REVOKE)\s"
DATABASE_OBJECT = r"(?i)\b(CREATE|ALTER|DROP|TRUNCATE)\s+(TABLE|VIEW|INDEX|SEQUENCE|SYNONYM|TRIGGER)\b"
