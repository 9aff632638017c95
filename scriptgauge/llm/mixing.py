"""Mixing sources to target weights by pivotal dependent rounding.

Each source's target gives its documents a number of copies, an integer and a
fraction. Two fractions at a time exchange words, in a random direction that keeps
both expectations, until one of them is whole. A group of documents so ends with
one fraction at most; these residuals meet in groups of residuals, level by level,
as a reduction tree below each source, and the last one is drawn. A source's words
then differ from its target by less than one document.

Groups are parts of a source by a hash of the id, so a source with a third of all
rows is many groups. Draws depend on the group and the order of ids in it, nothing
else: reruns agree.

Defined results: null texts have no words; a null source is a source of its own,
last in order; documents without words take nothing. Repeated rows and null ids are
documents like others.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scriptgauge.llm.common import settled

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, SEED = 1.5, 2.0, 17
#: Documents of one group at the lowest level, residuals of one group above it.
GROUP_ROWS, FAN_IN = 500, 64
WORD = r"[^\x20\x09-\x0D]+"
NEAR_WHOLE = 1e-9


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sized(source, size)`` to ``(source, source_size, n_docs, target)``; one row per source.

    Targets share ``share`` of all words by weight; those that would exceed ``cap``
    times their source stop there, and the rest is shared again by weight. With
    sources in the order of the level at which they stop, running sums give the
    final level at once.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    weighed = sums.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn("stop", cap * F.col("source_size") / F.col("weight"))
    lower = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = share * F.sum("source_size").over(everything) - F.coalesce(F.sum(cap * F.col("source_size")).over(lower), F.lit(0.0))
    levels = weighed.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(lower), F.lit(0.0))))
    final = F.min(F.when(F.col("level") < F.col("stop"), F.struct("stop", "level"))).over(everything)["level"]
    return levels.select("source", "source_size", "n_docs", F.coalesce(F.least(cap * F.col("source_size"), F.col("weight") * final), cap * F.col("source_size")).alias("target"))


def pivot_group(part: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds the fractions in order; returns them and the place of the one that is not whole yet, or -1."""
    part = part.copy()
    draws, held = rng.random(len(part)), -1
    for j in range(len(part)):
        if part[j] <= NEAR_WHOLE or part[j] >= 1 - NEAR_WHOLE:
            part[j] = round(part[j])
            continue
        if held < 0:
            held = j
            continue
        i = held
        give, take = min((1 - part[i]) * size[i], part[j] * size[j]), min(part[i] * size[i], (1 - part[j]) * size[j])
        words = give if draws[j] * (give + take) < take else -take
        part[i] += words / size[i]
        part[j] -= words / size[j]
        held = -1
        for k in (i, j):
            if part[k] <= NEAR_WHOLE or part[k] >= 1 - NEAR_WHOLE:
                part[k] = round(part[k])
            else:
                held = k
    return part, held


def copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``(doc_id, mark, size, source, source_size, target, copies)`` for every row; ``mark`` tells rows of one id apart by their text."""
    words = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")
    sized = settled(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("mark"), words.alias("size"), F.col(f"`{source}`").alias("source")), "sizes")
    targets = settled(source_targets(sized, weights, share, cap), "targets")
    groups = F.greatest(F.ceil(F.col("n_docs") / GROUP_ROWS), F.lit(1)).cast("long")
    ready = sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("doc_id", "mark", "size", "d.source", "source_size", "target", groups.alias("groups"))
    ready = ready.withColumn("grp", F.pmod(F.xxhash64("doc_id", "mark"), F.col("groups"))).withColumn("part", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    ready = ready.withColumn("copies", F.floor("part")).withColumn("part", F.col("part") - F.col("copies")).withColumn("open", F.lit(True))
    schema = "doc_id long, mark long, size long, source string, source_size long, target double, groups long, grp long, part double, copies long, open boolean"
    schema = schema.replace("doc_id long", f"doc_id {dict(docs.dtypes)[doc_id]}")
    order = [c.split(" ")[0] for c in schema.split(", ")]

    def level(depth: int, last: bool):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            from xxhash import xxh64_intdigest

            rows = rows.sort_values(["mark", "doc_id", "size"], kind="stable").reset_index(drop=True)
            name = rows["source"].iloc[0]
            rng = np.random.default_rng(xxh64_intdigest(f"{seed}/{depth}/{rows['grp'].iloc[0]}/{'' if pd.isna(name) else 's' + name}".encode("utf-8", "surrogatepass")))
            part, held = pivot_group(rows["part"].to_numpy(), rows["size"].to_numpy(), rng)
            if last and held >= 0:
                part[held], held = float(rng.random() < part[held]), -1
            open_ = np.arange(len(rows)) == held
            return rows.assign(copies=rows["copies"] + np.where(open_, 0, np.round(part)).astype(np.int64), part=np.where(open_, part, 0.0), open=open_)[order]

        return run

    widest = targets.agg(F.max(groups)).first()[0] or 1
    decided, depth, now = [], 0, ready.select(*order)
    while True:
        last = widest <= 1
        now = settled(now.groupBy("source", "grp").applyInPandas(level(depth, last), schema), "rounded")
        decided.append(now.where("not open"))
        if last:
            break
        now, widest, depth = now.where("open").withColumn("grp", F.floor(F.col("grp") / FAN_IN)), -(-widest // FAN_IN), depth + 1
    whole = decided[0]
    for more in decided[1:]:
        whole = whole.unionByName(more)
    return whole.select("doc_id", "mark", "size", "source", "source_size", "target", "copies")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The documents as the mix takes them: each row as often as it has copies, all columns kept."""
    number = Window.partitionBy("doc_id", "mark").orderBy("copies")
    plan = copies(docs, **settings).withColumn("__n", F.row_number().over(number)).where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), "__n", F.col("copies").alias("__copies"))
    marked = docs.withColumn("__mark", F.xxhash64("text"))
    marked = marked.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__mark").orderBy("source")))
    joined = marked.alias("d").join(plan.alias("p"), F.col("d.doc_id").eqNullSafe(F.col("p.__id")) & (F.col("d.__mark") == F.col("p.__mark")) & (F.col("d.__n") == F.col("p.__n")))
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__copy")).drop("__copy")
