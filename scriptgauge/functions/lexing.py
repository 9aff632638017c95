"""Quoted text and brackets: what patterns must not look into.

``shield`` replaces every character inside quotes by a stand-in of its own, so that
the text keeps its length, no pattern finds a keyword, bracket or semicolon in a
literal, and a quoted name is one word. ``unshield`` brings the characters back in
any part that was cut out. ``scopes`` takes a text apart into its bracketed parts,
``calls`` matches the brackets of calls. All of it are expressions inside the row.

A quote without an end is an ordinary character. A dollar quote that opens a body
(after AS, IS or DO) is not read as a literal, and so are all others of that text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import all_matches, bind, peak_level

#: Stand-ins are the same ASCII codes in a private plane of Unicode; brackets that are taken out leave a number between two marks.
PRIVATE, OPEN_MARK, CLOSE_MARK = 0xF0000, chr(0xF0100), chr(0xF0101)
PLAIN = "\t\n\r" + "".join(map(chr, range(32, 127)))
STAND_INS = "".join(chr(PRIVATE + ord(c)) for c in PLAIN)


def _inside(token: Column, first: int, last: int) -> Column:
    """The token with stand-ins between its first and last characters, which stay."""
    size = F.length(token)
    inner = F.translate(F.substring(token, F.lit(first + 1), size - first - last), PLAIN, STAND_INS)
    return F.concat(F.substring(token, F.lit(1), F.lit(first)), inner, F.substring(token, size - last + 1, F.lit(last)))


def _has_stand_in(text: Column) -> Column:
    """Stand-ins take several bytes, so a text of as many bytes as characters has none; no pattern has to be tried."""
    return F.octet_length(text) > F.length(text)


def _shielded(token: Column) -> Column:
    quoted = F.length(token) > 1
    return (
        F.when(quoted & token.startswith("'"), _inside(token, 1, 1))
        .when(quoted & (token.startswith('"') | token.startswith("`")), F.translate(token, PLAIN, STAND_INS))
        .when(token.rlike(P.Q_QUOTE_START), _inside(token, 2, 1))
        .when((F.length(token) > 3) & token.startswith("$$"), _inside(token, 2, 2))
        .otherwise(token)
    )


def shield(text: Column) -> Column:
    return bind(text, _shield)


def _shield(text: Column) -> Column:
    tokens = F.when(text.contains("$$") & ~text.rlike(P.DOLLAR_BODY), all_matches(text, P.QUOTED_OR_PLAIN_DOLLAR)).otherwise(
        all_matches(text, P.QUOTED_OR_PLAIN)
    )
    quotes = text.contains("'") | text.contains('"') | text.contains("`") | text.contains("$$")
    return F.when(quotes, F.array_join(F.transform(tokens, _shielded), "")).otherwise(text)


def unshield(text: Column) -> Column:
    return bind(text, _unshield)


def _unshield(text: Column) -> Column:
    return F.when(_has_stand_in(text), F.translate(text, STAND_INS, PLAIN)).otherwise(text)


def plain_name(name: Column) -> Column:
    """A name as it is meant: stand-ins brought back, its quotes left out."""
    return F.when(_has_stand_in(name), F.regexp_replace(F.translate(name, STAND_INS, PLAIN), P.NAME_QUOTES, "")).otherwise(name)


def scopes(safe: Column) -> Column:
    """The contents of all brackets of a shielded text, inner ones first, and the text without them as the last.

    The innermost brackets are taken out level by level. Each leaves its place in the
    list between two marks, so that every part is flat: its commas and words are its
    own. One step per level, whatever stands beside each other.
    """

    def peel(state: Column, _: Column) -> Column:
        text, parts = state["text"], state["parts"]
        marked = bind(
            F.split(text, P.INNERMOST),
            lambda pieces: F.transform(
                pieces,
                lambda piece, i: F.when(
                    i < F.size(pieces) - 1, F.concat(piece, F.lit(OPEN_MARK), (F.size(parts) + i).cast("string"), F.lit(CLOSE_MARK))
                ).otherwise(piece),
            ),
        )
        return F.struct(F.array_join(marked, "").alias("text"), F.concat(parts, all_matches(text, P.INNERMOST, 1)).alias("parts"))

    def peeled(text: Column) -> Column:
        start = F.struct(text.alias("text"), F.array().cast("array<string>").alias("parts"))
        deepest = peak_level(F.transform(all_matches(text, P.BRACKET), lambda b: F.when(b == "(", 1).otherwise(-1)))

        def taken_out(opened: Column) -> Column:
            levels = F.when(opened > 2, deepest).otherwise(opened)
            return F.aggregate(F.sequence(F.lit(1), levels.cast("int")), start, peel, lambda s: F.array_append(s["parts"], s["text"]))

        opened = F.length(text) - F.length(F.replace(text, F.lit("("), F.lit("")))
        return F.when(text.contains("("), bind(opened, taken_out)).otherwise(F.array(text))

    return bind(safe, peeled)


def with_brackets(text: Column, parts: Column) -> Column:
    """A piece of a flat part with the contents of its brackets, and of theirs, put back."""

    def fill(now: Column, _: Column) -> Column:
        numbers = all_matches(now, P.CHILD, 1)
        filled = F.transform(
            F.split(now, P.WHOLE_MARK),
            lambda piece, i: F.when(
                i < F.size(numbers), F.concat(piece, F.lit("("), F.get(parts, F.get(numbers, i).cast("int")), F.lit(")"))
            ).otherwise(piece),
        )
        return F.when(now.contains(OPEN_MARK), F.array_join(filled, "")).otherwise(now)

    return F.aggregate(parts, text, fill)


def calls(safe: Column) -> Column:
    """Calls in a shielded text as structs (name, args, depth): names before a bracket that is closed again.

    A fold over names with a bracket, brackets, commas and semicolons. It keeps the
    innermost open bracket, its name and the number of its arguments so far, and the
    outer ones as a stack; a semicolon ends all of them. ``depth`` is 1 outside other
    brackets. Stack and result are texts: they grow to thousands of entries without
    a copy of each entry per step.
    """
    stack_mark, field_mark = OPEN_MARK, CLOSE_MARK
    start = F.struct(F.lit("").alias("name"), F.lit(0).alias("args"), F.lit(0).alias("depth"), F.lit("").alias("outer"), F.lit("").alias("found"))

    def state(name: Column, args: Column, depth: Column, outer: Column, found: Column) -> Column:
        return F.struct(name.alias("name"), args.alias("args"), depth.alias("depth"), outer.alias("outer"), found.alias("found"))

    def told(s: Column, name: Column, args: Column, depth: Column) -> Column:
        return F.concat(s["found"], F.lit(stack_mark), name, F.lit(field_mark), args.cast("string"), F.lit(field_mark), depth.cast("string"))

    def opened(s: Column, name: Column) -> Column:
        outer = F.concat(s["outer"], F.lit(stack_mark), s["name"], F.lit(field_mark), s["args"].cast("string"))
        return state(name, F.lit(1), s["depth"] + 1, outer, s["found"])

    def closed(s: Column) -> Column:
        found = F.when(s["name"] == "", s["found"]).otherwise(told(s, s["name"], s["args"], s["depth"]))
        return bind(
            F.substring_index(s["outer"], stack_mark, -1),
            lambda top: state(
                F.substring_index(top, field_mark, 1),
                F.substring_index(top, field_mark, -1).cast("int"),
                s["depth"] - 1,
                F.left(s["outer"], F.length(s["outer"]) - F.length(top) - 1),
                found,
            ),
        )

    def step(s: Column, token: Column) -> Column:
        name = F.regexp_extract(token, P.CALL_TOKEN_NAME, 0)
        inside = s["depth"] > 0
        return (
            F.when(token == ",", F.when(inside, state(s["name"], s["args"] + 1, s["depth"], s["outer"], s["found"])).otherwise(s))
            .when(token == ")", F.when(inside, closed(s)).otherwise(s))
            .when(token == ";", state(F.lit(""), F.lit(0), F.lit(0), F.lit(""), s["found"]))
            .when(token.endswith("("), opened(s, name))
            .when(token.startswith("("), s)
            .otherwise(state(s["name"], s["args"], s["depth"], s["outer"], told(s, name, F.lit(0), s["depth"] + 1)))
        )

    def parsed(found: Column) -> Column:
        entries = F.filter(F.split(found, P.MARK), lambda e: F.length(e) > 0)
        return F.transform(
            entries,
            lambda e: F.struct(
                F.substring_index(e, field_mark, 1).alias("name"),
                F.substring_index(F.substring_index(e, field_mark, 2), field_mark, -1).cast("bigint").alias("args"),
                F.substring_index(e, field_mark, -1).cast("bigint").alias("depth"),
            ),
        )

    return F.aggregate(all_matches(safe, P.CALL_TOKEN), start, step, lambda s: parsed(s["found"]))


def argument_range(header: Column) -> Column:
    """(least, most) arguments of a shielded header, from the brackets after its name; parameters with a default may be left out."""

    def of(parts: Column) -> Column:
        listed = bind(
            F.regexp_extract(F.element_at(parts, -1), P.FIRST_BRACKET, 1),
            lambda place: F.when(F.length(place) > 0, F.get(parts, place.cast("int"))),
        )
        return bind(F.filter(F.split(listed, ","), lambda p: p.rlike(P.VISIBLE)), counted)

    def counted(parameters: Column) -> Column:
        most = F.coalesce(F.size(parameters), F.lit(0))
        optional = F.coalesce(F.size(F.filter(parameters, lambda p: p.rlike(P.HAS_DEFAULT))), F.lit(0))
        return F.struct((most - optional).cast("bigint").alias("least"), most.cast("bigint").alias("most"))

    return bind(scopes(header), of)
