"""Targets against repeated sharing, and the promises of the rounding."""

import random
import re
from collections import defaultdict

import numpy as np

from scriptgauge.llm import mixing, queries
from scriptgauge.llm.common import table


def slow_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, stopped = share * sum(sizes.values()), {}
    while True:
        left, open_ = total - sum(stopped.values()), [s for s in names if s not in stopped]
        if not open_:
            return stopped
        level = left / sum(weight[s] for s in open_)
        over = {s: cap * sizes[s] for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return stopped | {s: level * weight[s] for s in open_}
        stopped |= over


def check(rows, docs):
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, s in docs:
        n = len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])
        sizes[s] += n
        largest[s] = max(largest[s], n)
    targets, taken = slow_targets(sizes), defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target)
        assert 0 <= r.copies <= 2 and abs(r.copies - (r.target / r.source_size if r.size else 0)) < 1
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)


def test_whole_tables(spark, small):
    docs = [(r.doc_id, r.text, r.source) for r in table(spark, small, "documents").collect()]
    rows = mixing.copies(table(spark, small, "documents")).collect()
    check(rows, docs)
    again = mixing.copies(table(spark, small, "documents").repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    found = queries.op6_mix_sources(spark, small)
    assert found.columns == ["doc_id", "size", "source_size", "target", "taken"]


def test_hot_and_odd_sources(spark):
    random.seed(3)
    docs = [(i, " ".join(["w"] * random.randrange(40)), random.choice(["big"] * 5 + ["é", "Z", None, "a"])) for i in range(1500)]
    docs += [(None, "a b c", None), (4, None, "void"), (4, "", "void"), (5, "x\x0by", "a"), (5, "x\x0by", "a"), (6, "word " * 50_000, "z")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, copies int")
    check(mixing.copies(frame).collect(), docs)
    mix = mixing.mixed(frame)
    assert mix.columns == frame.columns
    wanted = sum(r.copies for r in mixing.copies(frame).collect())
    assert mix.count() == wanted > 1500
    assert mixing.copies(frame.limit(0)).collect() == []


def test_rounding_keeps_words_and_expectations():
    rng, size = np.random.default_rng(5), np.array([3.0, 10, 7, 1, 25, 4, 9])
    part = np.array([0.2, 0.9, 0.5, 0.4, 0.7, 0.3, 0.6])
    mean = np.zeros(7)
    for _ in range(4000):
        got, held = mixing.pivot_group(part, size, rng)
        assert abs((got * size).sum() - (part * size).sum()) < 1e-6
        assert all(x in (0, 1) for k, x in enumerate(got) if k != held)
        mean += got / 4000
    assert np.abs(mean - part).max() < 0.04
