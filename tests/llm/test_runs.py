"""Periodic runs against brute force over words, and round trips of the grammar."""

import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptgauge.llm import queries, runs
from scriptgauge.llm.common import table


def brute(words):
    """All (start, length, period), by start, then period: every period's stretches, without those of a smaller period."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(12, 2 * q) and not any(all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def crafted(seed):
    rng = random.Random(seed)
    words = [rng.randrange(rng.choice([1, 2, 3, 8, 50])) for _ in range(rng.randrange(90))]
    for _ in range(rng.randrange(4)):
        if len(words) > 4:
            a, p, m = rng.randrange(len(words)), rng.randrange(1, 12), rng.randrange(2, 40)
            words[a : a + m] = [words[min(a + t % p, len(words) - 1)] for t in range(m)]
    return words


def fast(texts):
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    start, end, period = runs.find_runs(np.array([w for t in texts for w in t], dtype=np.int64), sizes)
    owner = np.searchsorted(np.cumsum(sizes), start, "right")
    begin = (np.cumsum(sizes) - sizes)[owner]
    return [[(int(s - b), int(e - s), int(q)) for s, e, q, o, b in zip(start, end, period, owner, begin, strict=True) if o == i] for i in range(len(texts))]


def test_crafted_sequences_together():
    texts = [crafted(i) for i in range(600)]
    for i in range(0, 600, 30):
        assert fast(texts[i : i + 30]) == [brute(t) for t in texts[i : i + 30]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_any_sequence(words):
    assert fast([words]) == [brute(words)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_rules_give_the_sequence_back_and_no_pair_is_left_twice(words):
    rules, rest = runs.re_pair(words, 10)
    out = rest
    for i in reversed(range(len(rules))):
        out = [x for s in out for x in (rules[i] if s == 10 + i else (s,))]
    assert out == words and len(set(rules)) == len(rules)
    pairs = [p for i, p in enumerate(zip(rest, rest[1:], strict=False)) if i == 0 or not (rest[i - 1] == rest[i] == rest[i + 1])]
    assert len(set(pairs)) == len(pairs)


def test_long_periods_and_known_words():
    n = 3000
    assert fast([list(range(n)) * 3]) == [[(0, 3 * n, n)]]
    assert fast([[0] * 50_000]) == [[(0, 50_000, 1)]]
    assert fast([[i % 7 for i in range(20_000)] + [100] + [i % 7 for i in range(11)]]) == [[(0, 20_000, 7)]]
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert fast([b]) == [brute(b)]


def summary(texts):
    """The contract's columns of (doc_id, text) rows, from brute force."""
    told = []
    for d, text in texts:
        words, h = (text or "").encode().split(), 1 if d is None else zlib.crc32(str(d).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        own = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
        told.append((d, len(found), *own, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    return sorted(told, key=str)


def test_odd_rows(spark):
    texts = [(i, " ".join(f"w{x}" for x in crafted(i))) for i in range(150)]
    texts += [(None, "a b " * 30), (None, None), (900, None), (901, ""), (902, " \n\t "), (903, "é 日本 x " * 40), (5, texts[5][1]), (5, "k " * 13)]
    frame = spark.createDataFrame([(d, t, "clash", 1) for d, t in texts], "doc_id long, text string, runs string, k1 int").repartition(3)
    assert sorted(map(tuple, runs.run_summary(runs.text_runs(frame, plant=True)).collect()), key=str) == summary(texts)


def test_very_long_text_and_empty_table(spark):
    text = " ".join(f"w{i % 50_000}" for i in range(300_000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = runs.text_runs(frame).collect()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 50_000)] and row.collapsed == " ".join(f"w{i}" for i in range(50_000))
    assert runs.run_summary(runs.text_runs(frame.limit(0))).collect() == []


def test_query_over_given_texts(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    short = {d for d, t in rows if len((t or "").split()) < 400}  # brute force is cubic
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, small).collect()]
    assert len(got) == len(rows) and len(short) > 80
    assert sorted((r for r in got if r[0] in short), key=str) == summary([r for r in rows if r[0] in short])
