"""Near-duplicate documents by SimHash and a range join on per-segment bit counts.

The 64 bits of a fingerprint are 32 segments of two bits; its embedding is the
vector of their bit counts. Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints, so all links lie within that radius. A grid
whose cells are the count vectors of one half of the bits is joined over distance
one: of three differing bits at most one lies in one of the halves. Each
fingerprint sits in one cell per half and probes that cell and those one step up.
The join then checks the whole Manhattan distance and the exact Hamming distance
before it gives out a link. Equal fingerprints are one node from the start.

Defined results: null and empty texts and texts without words have fingerprint
zero and link like any other. Repeated rows are kept, each with the same component.
A null id keeps its row and never names a component, unless all its ids are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptgauge.llm.common import slices
from scriptgauge.llm.components import connected_components

WORDS_PER_SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
#: Shingles of one text that are counted at a time.
BLOCK = 65_536


def fingerprint(text: str | None, words_per_shingle: int = WORDS_PER_SHINGLE) -> int:
    """The unsigned 64-bit SimHash over hashed word shingles, repeats included."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters, and exactly the ASCII white space
    if not words:
        return 0
    if len(words) < words_per_shingle:
        return xxh64_intdigest(b" ".join(words), SEED)
    total, n = np.zeros(64, dtype=np.int64), len(words) - words_per_shingle + 1
    for start in range(0, n, BLOCK):
        block = words[start : min(start + BLOCK, n) + words_per_shingle - 1]
        shingles = map(b" ".join, zip(*(block[i:] for i in range(words_per_shingle)), strict=False))
        hashes = np.array([xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), into: str = "fp") -> DataFrame:
    """The kept columns and the fingerprint of each row as a (signed) long."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                values = np.array([fingerprint(t) for t in part.column(part.num_columns - 1).to_pylist()], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(values)], names=[*keep, into])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, f"{schema}, `{into}` bigint")


def _counts(bits: Column) -> Column:
    """Two-bit fields to their bit counts (0, 1 or 2), in place."""
    low, high = F.lit(0x5555555555555555), F.shiftrightunsigned(bits, 1)
    return F.shiftleft(bits.bitwiseAND(high).bitwiseAND(low), 1).bitwiseOR(bits.bitwiseXOR(high).bitwiseAND(low))


def _ladder(counts: Column) -> Column:
    """Counts as 00, 01, 11, so that differing bits add up to the Manhattan distance."""
    return counts.bitwiseOR(F.shiftrightunsigned(counts, 1).bitwiseAND(F.lit(0x5555555555555555)))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """``distinct(fp)`` to ``(a, b)``: pairs of different fingerprints within MAX_DISTANCE bits, each at least once."""
    halves = distinct.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
    bits = F.when(F.col("half") == 0, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    placed = halves.select("fp", "half", _counts(bits).alias("cell"), _ladder(_counts(F.col("fp"))).alias("steps"))
    field = lambda k: F.shiftright(F.col("cell"), k * 2).bitwiseAND(F.lit(3).cast("long"))
    up = F.filter(F.array(*[F.when(field(k) < 2, F.col("cell") + (1 << 2 * k)) for k in range(16)]), lambda c: c.isNotNull())
    probes = placed.select(F.col("fp").alias("a"), F.col("steps").alias("steps_a"), "half", F.explode(F.concat(F.array("cell"), up)).alias("cell"))
    near = (F.bit_count(F.col("steps_a").bitwiseXOR(F.col("steps"))) <= MAX_DISTANCE) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= MAX_DISTANCE)
    sides = probes.alias("p").join(placed.alias("c"), (F.col("p.half") == F.col("c.half")) & (F.col("p.cell") == F.col("c.cell")) & (F.col("a") != F.col("fp")) & near)
    return sides.select(F.greatest("a", "fp").alias("a"), F.least("a", "fp").alias("b")).distinct()


def near_duplicates(marked: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``marked`` with an id and ``fp`` to the same rows, ``component_id``, the smallest id reachable by links, and ``root``.

    The root is a fingerprint and tells components apart; their ids may be null or the same.
    """
    nodes = marked.groupBy("fp").agg(F.min(doc_id).alias("first_id"))
    reach = connected_components(fingerprint_links(nodes.select("fp")))
    roots = nodes.join(reach, nodes.fp == reach.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    names = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return marked.join(roots.join(names, "root").select("fp", "component_id", "root"), "fp")
