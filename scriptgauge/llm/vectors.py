"""Near-duplicate vectors: an exact metric range join over pivot cells.

A bounded sample gives the pivots; they steer the cost, never the result. Every
vector lives in the cell of its nearest pivot. On the unit sphere a cosine bound is
a radius, and the triangle inequality says which other cells can hold a partner:
one no farther than the own pivot plus twice the radius, within reach of the cell's
outermost vector, and with the bisector of the two pivots within the radius. A
vector visits those cells, and every cell joins by itself: all its visitors against
the vectors that live there, in blocks of bounded size. A link count is thus the
sum over cells, each partner counted where it lives.

Equal unit vectors are one node with a multiplicity from the start. No pairs leave
a cell: it gives out counts and a spanning forest of its links.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing and are their own component. Vectors of different
lengths never link. Repeated rows link with each other. A null id keeps its row and
names no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptgauge.llm.common import settled
from scriptgauge.llm.components import connected_components

THRESHOLD = 0.95
#: Bounds: vectors sampled for pivots, pivots, vectors of a cell block, visitors of a cell block.
SAMPLE_ROWS, MOST_PIVOTS, HOME_ROWS, VISITOR_ROWS = 4096, 256, 8192, 16_384
#: Rows of one matrix product.
CHUNK_ROWS = 512
#: Added to distance bounds, far above rounding errors.
SLACK = 1e-7


def unit_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of each list: whether it has a direction, and the place and double-precision unit vector of those that do."""
    values = [None if v is None else np.asarray(v, dtype=np.float64) for v in column.to_pylist()]
    good, units = np.zeros(len(values), dtype=bool), []
    for i, v in enumerate(values):
        if v is not None and v.size and np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
            v = v / top  # neither overflow nor underflow in the norm
            good[i] = True
            units.append(v / math.sqrt(float(v @ v)))
    return good, np.flatnonzero(good), units


def _classes(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``(vec_id, key, unit)``: digest and bytes of the unit vector, null without a direction."""
    source = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            _, places, units = unit_rows(batch.column(1))
            raw = [None] * batch.num_rows
            for i, u in zip(places, units, strict=True):
                raw[i] = (u + 0.0).astype("<f8").tobytes()
            keys = [None if r is None else xxh3_128_digest(r) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "key", "unit"])

    return source.mapInArrow(run, "vec_id long, key binary, unit binary")


def matrix(column: pa.ChunkedArray | pa.Array, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, length)


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first traversal of the sample."""
    chosen, nearest = [0], 2 - 2 * (sample @ sample[0])
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, 2 - 2 * (sample @ sample[chosen[-1]]))
    return sample[chosen]


def distances(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (units @ pivots.T)))


def reach(units: np.ndarray, pivots: np.ndarray, home: np.ndarray, widest: np.ndarray, radius: float) -> np.ndarray:
    """Which cells each vector must visit (its own included)."""
    d, apart = distances(units, pivots), distances(pivots, pivots)
    own = d[np.arange(len(d)), home]
    near = (d <= own[:, None] + 2 * radius + SLACK) & (d <= widest[None, :] + radius + SLACK)
    gap = np.maximum(apart[home], 1e-12)
    near &= (d**2 - own[:, None] ** 2) / (2 * gap) <= radius + SLACK
    near[np.arange(len(d)), home] = True
    return near & (widest >= 0)[None, :]


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (each a smallest member) after joining the groups of a[i] and b[i]."""
    while True:
        left, right = labels[a], labels[b]
        differ = left != right
        if not differ.any():
            return labels
        a, b, left, right = a[differ], b[differ], left[differ], right[differ]
        np.minimum.at(labels, np.maximum(left, right), np.minimum(left, right))
        while (up := labels[labels]).tolist() != labels.tolist():
            labels = up


def join_cell(home: np.ndarray, weight: np.ndarray, visitors: np.ndarray, home_key: np.ndarray, visitor_key: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each visitor, the weight of the other vectors it links with; and a forest over the keys (numbers) as (a, b)."""
    counts, labels = np.zeros(len(visitors), dtype=np.int64), np.arange(max(home_key.max(initial=-1), visitor_key.max(initial=-1)) + 1)
    for start in range(0, len(visitors), CHUNK_ROWS):
        rows = slice(start, start + CHUNK_ROWS)
        linked = visitors[rows] @ home.T >= threshold
        linked &= visitor_key[rows, None] != home_key[None, :]
        counts[rows] = linked @ weight
        v, h = np.nonzero(linked)
        labels = merge_labels(labels, visitor_key[rows][v], home_key[h])
    moved = np.flatnonzero(labels != np.arange(len(labels)))
    return counts, moved, labels[moved]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    spark, radius = vectors.sparkSession, math.sqrt(2 - 2 * threshold)
    rows = settled(_classes(vectors, vec_id, embedding), "units")
    nodes = settled(rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.any_value("unit").alias("unit")).withColumn("length", F.octet_length("unit") / 8), "nodes")
    sizes = {int(r["length"]): r["n"] for r in nodes.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(64).collect()}
    pivots = {}
    for length, n in sizes.items():
        sample = nodes.where(F.col("length") == length).orderBy("key").limit(SAMPLE_ROWS).select("unit").collect()
        pivots[length] = choose_pivots(np.frombuffer(b"".join(bytes(r.unit) for r in sample), dtype="<f8").reshape(-1, length), min(MOST_PIVOTS, -(-n // HOME_ROWS)))
    shared = spark.sparkContext.broadcast(pivots)  # at most 64 lengths and 256 pivots each

    def settle_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array(batch.column(3).to_pylist(), dtype=np.int64)
            cell, out = np.zeros(batch.num_rows, dtype=np.int64), np.zeros(batch.num_rows)
            for length in set(lengths.tolist()) & set(shared.value):
                at = np.flatnonzero(lengths == length)
                d = distances(matrix(batch.column(2).take(pa.array(at)), length), shared.value[length])
                cell[at], out[at] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(out)], names=[*batch.schema.names, "cell", "out"])

    homes = settled(nodes.select("key", "weight", "unit", F.col("length").cast("long").alias("length")).mapInArrow(settle_in, "key binary, weight long, unit binary, length long, cell long, out double"), "homes")
    cells = {(r["length"], r["cell"]): (r["out"], r["n"]) for r in homes.groupBy("length", "cell").agg(F.max("out").alias("out"), F.count("*").alias("n")).where(F.col("length").isin(list(pivots))).collect()}
    total = dict(sizes)
    widest = {k: np.array([cells.get((k, c), (-1.0, 0))[0] for c in range(len(p))]) for k, p in pivots.items()}
    layout = spark.sparkContext.broadcast((widest, {k: -(-n // HOME_ROWS) for k, (_, n) in cells.items()}, {k: -(-n // VISITOR_ROWS) for k, n in total.items()}))

    def travel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widest, blocks, salts = layout.value
        for batch in batches:
            lengths, home = (np.array(batch.column(c).to_pylist(), dtype=np.int64) for c in (3, 4))
            part = np.array([int.from_bytes(k[:4], "little") for k in batch.column(0).to_pylist()], dtype=np.int64)
            for length in sorted(set(lengths.tolist())):
                at = np.flatnonzero(lengths == length)
                n_salts = salts.get(length, 1)
                if length in shared.value:
                    near = reach(matrix(batch.column(2).take(pa.array(at)), length), shared.value[length], home[at], widest[length], radius)
                else:
                    near = np.ones((len(at), 1), dtype=bool)
                for cell in range(near.shape[1]):
                    n_blocks = blocks.get((length, cell), 1)
                    visit, live = at[near[:, cell]], at[home[at] == cell]
                    for rows, block, salt, lives in [*((visit, np.full(len(visit), b), part[visit] // 7919 % n_salts, False) for b in range(n_blocks)), *((live, part[live] % n_blocks, np.full(len(live), s), True) for s in range(n_salts))]:
                        if len(rows):
                            took = batch.select(["key", "weight", "unit", "length"]).take(pa.array(rows))
                            yield pa.RecordBatch.from_arrays([*took.columns, pa.array(np.full(len(rows), cell)), pa.array(block), pa.array(salt), pa.array(np.full(len(rows), lives))], names=[*took.schema.names, "cell", "block", "salt", "lives"])

    def join(group: pa.Table) -> pa.Table:
        lives = group["lives"].to_numpy()
        keys, number = np.unique(np.array(group["key"].to_pylist(), dtype="V16"), return_inverse=True)
        units, weight = matrix(group["unit"], group["length"][0].as_py()), group["weight"].to_numpy()
        counts, a, b = join_cell(units[lives], weight[lives], units[~lives], number[lives], number[~lives], threshold)
        seen = np.flatnonzero(counts)
        key = [keys[i].tobytes() for i in number[~lives][seen]] + [keys[i].tobytes() for i in a]
        other = [None] * len(seen) + [keys[i].tobytes() for i in b]
        return pa.table([pa.array(key, pa.binary()), pa.array(np.append(counts[seen], np.zeros(len(a), dtype=np.int64))), pa.array(other, pa.binary())], names=["key", "n", "other"])

    moved = homes.mapInArrow(travel, "key binary, weight long, unit binary, length long, cell long, block long, salt long, lives boolean")
    found = settled(moved.groupBy("length", "cell", "block", "salt").applyInArrow(join, "key binary, n long, other binary"), "cells")
    links = found.groupBy("key").agg(F.sum("n").alias("n"))
    labels = connected_components(found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b")))
    roots = nodes.select("key", "first_id", "weight").join(links, "key", "left").join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("component", "key"))
    names = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    told = roots.join(names, "root").select("key", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id")
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = rows.where("key is not null").join(told, "key").select("vec_id", "n_links", "component_id").unionAll(alone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
