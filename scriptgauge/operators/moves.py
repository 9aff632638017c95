"""Renamed and moved units between two versions of a corpus.

A unit of the old version whose id is gone and one of the new version whose id is new
are the same unit if their texts agree. Texts are compared by winnowed fingerprints:
of the hashes of GRAM tokens in a row, the smallest of each WINDOW neighbours; a unit's
own name is replaced first. Units of equal fingerprints are one class from then on.

* Candidates: two sets with a Jaccard similarity of at least t share one of the rarest
  ``n - ceil(t * n) + 1`` fingerprints of either. Only these prefixes are joined, so
  nothing is lost and fingerprints that all units share join nothing.
* Assignment: units of one file name and unit name first, then those of one file name,
  then all others. Groups of equal class choose each other, the most alike first, and
  their members are paired by number, so copies are never expanded to pairs.

Defined results: a unit is in one pair at most; a null or empty text has one
fingerprint, as all empty texts; units of null id are left out; among equals a hash of
the ids decides, so reruns agree. No units give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph import materialize
from .routing import base_name

GRAM, WINDOW = 5, 4
#: Units with at least so much of their fingerprints in common are taken for one.
SIMILARITY = 0.6
TOKEN = r"[a-z_][a-z0-9_$#]*|[0-9]+|[^\sa-z0-9_]"


def _windows(values: F.Column, width: int, of) -> F.Column:
    """``of`` every stretch of ``width`` values, or of all if they are fewer."""
    count = F.greatest(F.size(values) - width + 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), count), lambda i: of(F.slice(values, i, width)))


def fingerprints(units: DataFrame) -> DataFrame:
    """(unit_id, file, unit_name, prints, class) of units (unit_id, path, unit_name, source_code); computed inside the row."""
    own = F.lower("unit_name")
    tokens = F.transform(T.all_matches(F.lower(F.coalesce("source_code", F.lit(""))), TOKEN), lambda token: F.when(token == own, F.lit("@")).otherwise(token))
    grams = T.bind(tokens, lambda found: _windows(found, GRAM, F.xxhash64))
    prints = F.array_sort(F.array_distinct(T.bind(grams, lambda found: _windows(found, WINDOW, F.array_min))))
    told = units.filter("unit_id IS NOT NULL").select("unit_id", F.lower(base_name(F.col("path"))).alias("file"), own.alias("unit_name"), prints.alias("prints"))
    return told.withColumn("class", F.md5(F.array_join(F.transform("prints", lambda x: x.cast("string")), ",")))


def class_pairs(old: DataFrame, new: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(x, y, similarity): classes of the old and the new units whose fingerprints have at least ``least`` in common."""
    sides = [frame.select("class", "prints").dropDuplicates(["class"]) for frame in (old, new)]
    each = sides[0].unionAll(sides[1]).dropDuplicates(["class"]).select("class", F.size("prints").alias("n"), F.explode("prints").alias("print"))
    counted = each.join(each.groupBy("print").agg(F.count("*").alias("owners")), "print")
    ordered = counted.groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("owners", "print"))).alias("ordered"))
    kept = F.col("n") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1
    prefixes = materialize(ordered.select("class", F.explode(F.slice("ordered", F.lit(1), kept.cast("int"))).alias("p")).select("class", F.col("p.print").alias("print")), "prefixes")
    left, right = (prefixes.join(side.select("class"), "class", "left_semi").withColumnRenamed("class", name) for side, name in zip(sides, "xy"))
    met = left.join(right, "print").select("x", "y").distinct()
    whole = met.join(sides[0].toDF("x", "prints_x"), "x").join(sides[1].toDF("y", "prints_y"), "y")
    shared = F.size(F.array_intersect("prints_x", "prints_y"))
    alike = shared / (F.size("prints_x") + F.size("prints_y") - shared)
    return materialize(whole.select("x", "y", alike.alias("similarity")).filter(F.col("similarity") >= least), "class-pairs")


def _best(pairs: DataFrame) -> DataFrame:
    """Of pairs (x, y, similarity) those that are each other's best; a hash of both decides among equals."""
    order = F.struct("similarity", F.xxhash64("x", "y").alias("h"), "x", "y")
    best_x = pairs.groupBy("x").agg(F.max(order).alias("b")).select("b.x", "b.y", "b.similarity")
    best_y = pairs.groupBy("y").agg(F.max(order).alias("b")).select("b.x", "b.y")
    return best_x.join(best_y, ["x", "y"])


def _grouped(units: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Units with the name of their group, of equal class and keys, and their number in it."""
    by = Window.partitionBy(name).orderBy("unit_name", "unit_id")
    named = units.select("unit_id", "unit_name", F.concat_ws("\x1f", "class", *keys).alias(name))
    return named.select(F.col("unit_id").alias(f"{name}_id"), name, F.row_number().over(by).alias("nth"))


def _assign(old: DataFrame, new: DataFrame, pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(x, y, similarity) of units that agree in ``keys``, each in one pair, and the units left of both versions.

    Groups of equal class and keys choose each other, and members are paired by number
    until one group is used up; then the others choose again.
    """
    found = pairs.limit(0)
    while True:
        groups = [units.select(F.col("class").alias(c), F.concat_ws("\x1f", "class", *keys).alias(g), *keys).dropna(subset=keys).distinct() for units, c, g in ((old, "x", "gx"), (new, "y", "gy"))]
        live = groups[0].join(pairs, "x").join(groups[1], ["y", *keys])
        live = materialize(live.select(F.col("gx").alias("x"), F.col("gy").alias("y"), "similarity"), "moves")
        if live.isEmpty():
            return found, old, new
        taken = _grouped(old, "x", keys).join(_best(live), "x").join(_grouped(new, "y", keys), ["y", "nth"])
        taken = materialize(taken.select(F.col("x_id").alias("x"), F.col("y_id").alias("y"), "similarity"), "moves")
        found = found.unionAll(taken)
        old = materialize(old.join(taken.select(F.col("x").alias("unit_id")), "unit_id", "left_anti"), "units")
        new = materialize(new.join(taken.select(F.col("y").alias("unit_id")), "unit_id", "left_anti"), "units")


def version_moves(old_units: DataFrame, new_units: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(old_unit_id, new_unit_id, similarity) of units that have another id in the new version."""
    before, after = (materialize(fingerprints(units), "units") for units in (old_units, new_units))
    old = materialize(before.join(after.select("unit_id"), "unit_id", "left_anti"), "units")
    new = materialize(after.join(before.select("unit_id"), "unit_id", "left_anti"), "units")
    pairs = class_pairs(old, new, least)
    found = []
    for keys in (["file", "unit_name"], ["file"], []):
        moves, old, new = _assign(old, new, pairs, keys)
        found.append(moves)
    return found[0].unionAll(found[1]).unionAll(found[2]).toDF("old_unit_id", "new_unit_id", "similarity")
