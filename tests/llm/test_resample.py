"""Importance resampling against brute force in plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from scriptgauge.llm import queries, resample
from scriptgauge.llm.common import table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, longest=1, buckets=10_000, least=20, percent=10, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    told = [(d, *features(t, longest)) for d, t in docs]
    s, t = (Counter(map(bucket, (f for x in side for f in x))) for side in ([x[2] for x in told], [features(x, longest)[1] for x in target]))
    s_all, t_all = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in set(s) | set(t)}
    rows = []
    for d, n, found in told:
        weight = sum(gain[bucket(f)] for f in found)
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, n, len(found), weight, score))
    wanted = percent * sum(n >= least for _, n, *_ in rows) // 100
    order = sorted((r for r in rows if r[1] >= least and r[4] is not None), key=lambda r: (-r[4], r[0]))[:wanted]
    return [(*r, i + 1) for i, r in enumerate(order)], sorted(((d, f, w, s) for d, _, f, w, s in rows), key=str)


def compare(got, docs, target, **how):
    ranked, everything = brute(docs, target, **how)
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=str) == everything
    assert [(r.doc_id, r.score, r.rank) for r in sorted((r for r in got if r.rank), key=lambda r: r.rank)] == [(d, s, k) for d, _, _, _, s, k in ranked]


@pytest.mark.parametrize("longest", [1, 2, 4])
def test_against_brute_force(spark, longest):
    docs = [(i, " ".join(f"W{(i * j) % 37}é_x-{j % 5}" for j in range(i % 45))) for i in range(300)]
    docs += [(None, "null id " * 30), (1000, None), (1001, ""), (1002, "Ünï ÄÖ 日本 ab\x7fcd"), (7, docs[7][1]), (1003, "w " * 30_000)]
    target = [("W3é x w1é " * 5,), (None,), ("tail only here",)]
    frame = spark.createDataFrame([(d, t, "clash", 0) for d, t in docs], "doc_id long, text string, score string, rank int").repartition(5)
    got = resample.resample(frame, spark.createDataFrame(target, "text string"), longest=longest).collect()
    compare(got, docs, [t for t, in target], longest=longest)


def test_the_head_changes_nothing(spark):
    docs = spark.createDataFrame([(i, " ".join(f"a{i * j % 11} b" for j in range(30))) for i in range(40)], "doc_id long, text string")
    whole = resample.find_head(docs, longest=2)
    none = resample.Head([], [], resample.BUCKETS)
    few = resample.find_head(docs, longest=2, size=2)
    totals = [resample.bucket_totals(docs, h, longest=2).tolist() for h in (whole, none, few)]
    assert len(few.states) == 2 == len(few.pair_buckets) and totals[0] == totals[1] == totals[2] and sum(totals[0]) == 40 * (60 + 59)


def test_equal_rows_and_many_partitions(spark):
    frame = spark.createDataFrame([(5, "same words " * 20)] * 500 + [(i, "other text here " * 9) for i in range(500)], "doc_id long, text string").repartition(7)
    rows = resample.resample(frame, spark.createDataFrame([], "text string")).collect()
    assert sorted(r.rank for r in rows if r.rank) == list(range(1, 101)) and len(rows) == 1000
    compare(rows, [(5, "same words " * 20)] * 500 + [(i, "other text here " * 9) for i in range(500)], [])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert resample.resample(empty, empty).collect() == []


def test_query_over_given_texts(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    compare(queries.op12_importance_resampling(spark, small).collect(), docs, [r.text for r in table(spark, small, "benchmark").collect()])
