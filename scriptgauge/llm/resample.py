"""Importance resampling towards a target corpus over hashed word runs.

A feature is a run of one to ``longest`` consecutive words, joined by one space; its
bucket is the crc32 of its bytes modulo the number of buckets. A first pass counts
words and word pairs in every task and sums the most frequent of each, so that a
bounded head is known: for a head word the state of its crc, from which a longer run
goes on, and for a head pair its bucket. Tasks look the head up and compute the crc
of anything else directly. Both add to one exact count per bucket, 10,000 numbers
from each task, whatever the text. The head only saves work: no result depends on
what is in it.

The gain of a bucket compares its share in the target with its share in the corpus.
A document weighs the sum of its features' gains, gets a Gumbel number from a hash
of its id, and the highest sums are drawn: an exact sample without replacement. The
ranks come from one range sort of narrow rows and the sizes of its partitions.

Defined results: null and empty texts have no features and weigh 0. A row with a null
id has no score and is never drawn, though it counts as a document with enough words.
Equal rows get neighbouring ranks in any order. An empty target gives every feature
the same smoothed share. Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptgauge.llm.common import settled, slices

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Words, and as many word pairs, in the head; what a task counts at once to find them, and hands on.
HEAD, COUNTED = 50_000, 500_000
#: A to Z become lower case; every other ASCII character but 0-9 and a-z parts words.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(LOWER).split()


class Head:
    """Frequent words with their crc state and frequent pairs with their bucket."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int):
        self.buckets = buckets
        self.states = {w: zlib.crc32(w) for w in words}
        self.pair_buckets = {p: zlib.crc32(b" " + p[1], zlib.crc32(p[0])) % buckets for p in pairs}

    def of(self, words: list[bytes], longest: int) -> list[int]:
        """The bucket of every run of one to ``longest`` words."""
        buckets, crc, known = self.buckets, zlib.crc32, self.states.get
        states = [crc(w) if (s := known(w)) is None else s for w in words]
        found = [s % buckets for s in states]
        if longest > 1 and len(words) > 1:
            head = self.pair_buckets.get
            missing = [head(p) for p in pairwise(words)]
            found += [crc(b" " + words[i + 1], states[i]) % buckets if b is None else b for i, b in enumerate(missing)]
        if longest > 2:  # a run of n words goes on from the state of its first n - 1
            states = [crc(b" " + words[i + 1], s) for i, s in enumerate(states[:-1])]
            for n in range(3, longest + 1):
                states = [crc(b" " + words[i + n - 1], s) for i, s in enumerate(states[: max(0, len(words) - n + 1)])]
                found += [s % buckets for s in states]
        return found


def _texts(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.col(f"`{text}`").alias("text"))


def find_head(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, size: int = HEAD) -> Head:
    """The most frequent words and, for longer runs, pairs; ``size`` of each at most come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter(), Counter()]

        def told() -> Iterator[pa.RecordBatch]:
            for kind, own in enumerate(counts):
                top = own.most_common(size)
                names = [w if kind == 0 else b" ".join(w) for w, _ in top]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(top), pa.int32()), pa.array(names, pa.binary()), pa.array([n for _, n in top], pa.int64())], names=["kind", "feature", "n"])
                own.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                for words in map(words_of, part.column(0).to_pylist()):
                    counts[0].update(words)
                    if longest > 1:
                        counts[1].update(pairwise(words))
                if sum(map(len, counts)) > COUNTED:
                    yield from told()
        yield from told()

    counted = _texts(docs, text).mapInArrow(run, "kind int, feature binary, n long").groupBy("kind", "feature").agg(F.sum("n").alias("n"))
    top = [[bytes(r.feature) for r in counted.where(F.col("kind") == kind).orderBy(F.desc("n"), "feature").limit(size).select("feature").collect()] for kind in range(1 + (longest > 1))]
    return Head(top[0], [tuple(p.split(b" ")) for p in top[-1]] if longest > 1 else [], buckets)


def bucket_totals(docs: DataFrame, head: Head, text: str = "text", longest: int = LONGEST) -> np.ndarray:
    """How many features of all texts each bucket holds; a task hands on one row per bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        totals = np.zeros(own.buckets, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                found = chain.from_iterable(own.of(words_of(t), longest) for t in part.column(0).to_pylist())
                totals += np.bincount(np.fromiter(found, dtype=np.int64), minlength=own.buckets)
        used = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(totals[used])], names=["bucket", "n"])

    summed = _texts(docs, text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    totals = np.zeros(head.buckets, dtype=np.int64)
    for row in summed.collect():  # one row per bucket
        totals[row.bucket] = row.n
    return totals


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket, in doubles."""
    buckets, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    ratio = (target + 1.0) * (s_all + buckets) / ((corpus + 1.0) * (t_all + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weights(docs: DataFrame, head: Head, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, gain = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [words_of(t) for t in part.column(1).to_pylist()]
                found = [own.of(w, longest) for w in rows]
                sums = [int(gain[f].sum()) if f else 0 for f in found]
                arrays = [pa.array(x, pa.int64()) for x in ([len(w) for w in rows], [len(f) for f in found], sums)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["doc_id", "n_words", "n_features", "weight"])

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def drawn(weighed: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Appends ``score`` and ``rank``: of the rows with enough words the highest ``percent``, by score, then id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = settled(weighed.withColumn("score", F.col("weight") + gumbel), "scores")
    enough = F.col("n_words") >= least_words
    count = scored.agg(F.count(F.when(enough, 1))).first()[0]
    wanted = percent * count // 100
    # eligible rows first; the row number only parts equal rows, so that no partition has to hold them all
    order = [F.when(enough & F.col("score").isNotNull(), 0).otherwise(1), F.desc("score"), F.col("doc_id"), F.col("row")]
    ranked = settled(scored.withColumn("row", F.monotonically_increasing_id()).orderBy(*order).drop("row").withColumn("place", F.monotonically_increasing_id()), "ranked")
    part, inner = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    sizes = sorted((r.part, r.n) for r in ranked.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row per partition
    starts, done = [], 0
    for p, n in sizes:
        starts.append((p, done))
        done += n
    firsts = ranked.sparkSession.createDataFrame(starts, "part long, before long")
    rank = F.col("before") + inner + 1
    out = ranked.withColumn("part", part).join(F.broadcast(firsts), "part")
    eligible = enough & F.col("score").isNotNull() & (rank <= wanted)
    return out.withColumn("rank", F.when(eligible, rank)).drop("part", "before", "place")


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs``."""
    head = find_head(docs, text, longest, buckets)
    gain = gains(bucket_totals(docs, head, text, longest), bucket_totals(target, head, target_text, longest))
    return drawn(weights(docs, head, gain, doc_id, text, longest))
