"""Column expressions on script text. Everything stays inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import patterns as P

BLANKS = " \t\r\n"
SETTLED = "_settled"


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(P.guarded(pattern))).cast("bigint")


def has_any(upper_text: Column, *words: str) -> Column:
    """Does the upper-cased text hold one of the words? A byte search that spares most regex scans."""
    found = upper_text.contains(words[0])
    for word in words[1:]:
        found = found | upper_text.contains(word)
    return found


def count_if(upper_text: Column, text: Column, pattern: str, *words: str) -> Column:
    """``count_matches`` for a pattern whose every match holds one of ``words``."""
    return F.when(has_any(upper_text, *words), count_matches(text, pattern)).otherwise(F.lit(0).cast("bigint"))


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(P.guarded(pattern)), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, P.guarded(pattern), group), F.lit(""))


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def trimmed_value(text: Column) -> Column:
    """``trimmed`` for a column or lambda variable: trimming reads the whole text, so one without outer blanks is left alone."""
    edges = text.startswith(BLANKS[0]) | text.endswith(BLANKS[0])
    for blank in BLANKS[1:]:
        edges = edges | text.startswith(blank) | text.endswith(blank)
    return F.when(edges, trimmed(text)).otherwise(text)


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(P.NOT_BLANK)


def without_comments(text: Column) -> Column:
    """Block comments first, then line comments; string literals are not special."""
    blocks = F.when(text.contains("/*"), F.regexp_replace(text, P.BLOCK_COMMENT, "")).otherwise(text)
    return F.when(text.contains("--"), F.regexp_replace(blocks, P.LINE_COMMENT, "")).otherwise(blocks)


def line_count(text: Column) -> Column:
    """Number of lines without trailing empty ones; a blank text has none."""
    kept = F.when(text.endswith("\n"), F.regexp_replace(text, P.TRAILING_BREAKS, "")).otherwise(text)
    lines = F.length(kept) - F.length(F.replace(kept, F.lit("\n"), F.lit(""))) + 1
    return F.when(is_blank(text), F.lit(0)).when(~text.contains("\n"), F.lit(1)).otherwise(lines).cast("bigint")


def by_dialect(dialect: Column, choices: dict[str, Column]) -> Column:
    """One expression per dialect, so that each keeps a literal pattern."""
    result = None
    for name, value in choices.items():
        result = F.when(dialect == name, value) if result is None else result.when(dialect == name, value)
    return result


def last_segment(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` or its lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def suffixes(name: Column) -> Column:
    """``a.b.c`` gives ``a.b.c``, ``b.c`` and ``c``: a list entry matches after any dot."""
    dotted = bind(
        F.split(name, r"\."),
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
        ),
    )
    return F.when(~name.contains("."), F.array(name)).otherwise(dotted)


def peak_level(steps: Column) -> Column:
    """Highest level of a running sum of +1 and -1 that never drops below zero."""
    start = F.struct(F.lit(0).alias("level"), F.lit(0).alias("peak"))

    def walk(state: Column, step: Column) -> Column:
        level = F.greatest(F.lit(0), state["level"] + step)
        return F.struct(level.alias("level"), F.greatest(state["peak"], level).alias("peak"))

    return F.aggregate(steps, start, walk, lambda state: state["peak"]).cast("bigint")


def joined(names: Column) -> Column:
    """A name list as one sorted text."""
    return F.array_join(F.sort_array(names), ",")


def settle(frame: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns``, each computed once per row.

    Filters on a projected column are rewritten onto its definition, which would
    repeat costly text expressions several times over. A one-row generator is a
    place that filters do not pass. The columns are computed in a projection below
    it: a projection shares common parts of its expressions, a generator computes
    every occurrence again.
    """
    kept = [name for name in frame.columns if name not in columns]
    fields = F.struct(*[value.alias(name) for name, value in columns.items()])
    return frame.select(*kept, fields.alias(SETTLED)).select(*kept, F.inline(F.array(SETTLED)))
