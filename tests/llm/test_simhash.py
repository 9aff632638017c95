"""Fingerprints and their components against brute force."""

import random

import xxhash

from scriptgauge.llm import queries, simhash
from scriptgauge.llm.common import table
from scriptgauge.llm.components import connected_components


def slow_fingerprint(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def slow_components(pairs, nodes):
    at = {n: n for n in nodes}

    def root(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        at[b] = a
    return {n: root(n) for n in nodes}


def by_brute_force(rows):
    marks = [(i, slow_fingerprint(t)) for i, t in rows]
    pairs = [(a, b) for a, x in marks for b, y in marks if a < b and (x ^ y).bit_count() <= 3]
    names = slow_components(pairs, [i for i, _ in marks])
    return sorted((i, f"{f:016x}", names[i]) for i, f in marks)


def test_query_over_given_texts(spark, small):
    rows = [(r.doc_id, r.text) for r in table(spark, small, "documents").collect()]
    assert sorted(map(tuple, queries.op9_simhash_near_duplicates(spark, small).collect())) == by_brute_force(rows)


def test_links_of_planted_fingerprints(spark):
    random.seed(9)
    values = {0, 2**64 - 1, 7, 1 << 63}
    for _ in range(150):
        base = random.getrandbits(64)
        values.add(base)
        for _ in range(3):
            values.add(base ^ sum(1 << b for b in random.sample(range(64), random.randrange(1, 6))))
    signed = [v - 2**64 if v >= 2**63 else v for v in sorted(values)]
    found = {tuple(r) for r in simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    near = {(a, b) for a in signed for b in signed if a > b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert found == near and len(near) > 100


def test_odd_rows(spark):
    rows = [(5, None, "x"), (6, "", "x"), (7, " \t\n", "x"), (8, "One", None), (8, "One", None), (9, "oNE", "y"), (None, "one", "z"), (None, "other words only here", "z")]
    rows += [(20, "very long words of text " * 30_000, "x"), (21, "very long words of text " * 30_000 + "more", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = simhash.near_duplicates(simhash.fingerprints(frame)).select("doc_id", "component_id").collect()
    assert sorted(((r.doc_id, r.component_id) for r in found), key=str) == sorted([(5, 5), (6, 5), (7, 5), (8, 8), (8, 8), (9, 8), (None, 8), (None, None), (20, 20), (21, 20)], key=str)
    assert simhash.near_duplicates(simhash.fingerprints(frame.limit(0))).collect() == []


def test_components_of_chains_and_stars(spark):
    random.seed(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 300)] + [(random.randrange(2000, 2100), random.randrange(2000, 2100)) for _ in range(70)] + [(1, 1), (None, 4)]
    frame = spark.createDataFrame(pairs, "a long, b long")
    nodes = {n for p in pairs if None not in p for n in p}
    expected = {n: r for n, r in slow_components([p for p in pairs if None not in p], nodes).items() if n != r}
    assert {r.node: r.component for r in connected_components(frame).collect()} == expected
