"""Frequent table pairs and quantile sketches against exact counts."""

import bisect
import itertools
import random
from collections import Counter

import pytest

from scriptgauge.operators import score_sketches, table_pairs


@pytest.mark.parametrize("buckets", [(1 << 15, 1 << 15), (table_pairs.TABLE_BUCKETS, table_pairs.PAIR_BUCKETS)])
def test_pairs_against_brute_force(spark, buckets):
    rng = random.Random(5)
    names = [f"t{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    baskets = [rng.sample(names, rng.randrange(0, 7)) for _ in range(2000)] + [None, [None, "t1", "t1"], ["t1"]]
    counts = Counter(p for b in baskets if b for p in itertools.combinations(sorted({n for n in b if n}), 2))
    for support in (1, 4, 60):
        found = table_pairs.table_pairs(spark.createDataFrame([(b,) for b in baskets], "names array<string>"), support, *buckets).collect()
        assert {(r.first_table, r.second_table): r.statements for r in found} == {p: n for p, n in counts.items() if n >= support}
        assert len(found) == len({(r.first_table, r.second_table) for r in found})


def test_no_statements(spark):
    assert table_pairs.table_pairs(spark.createDataFrame([], "names array<string>"), 2).collect() == []


def test_sketches_merge_over_days(spark):
    rng = random.Random(9)
    rows = [(rng.choice("AB"), f"2024-0{1 + i % 3}-{1 + i % 28:02d} 05:00:00", round(rng.expovariate(0.05), 3)) for i in range(30_000)]
    rows += [("A", None, 1.0), ("A", "2024-01-01 00:00:00", None)]
    scores = spark.createDataFrame(rows, "dialect string, t string, score double").selectExpr("dialect", "to_timestamp(t) AS ts", "score")
    sketches = score_sketches.daily_sketches(scores, 400).cache()
    for first, last in (("2024-01-01", "2024-03-31"), ("2024-01-05", "2024-02-20"), ("2024-02-03", "2024-02-03")):
        for r in score_sketches.quantiles(sketches, ["dialect"], first, last, 400).collect():
            exact = sorted(s for d, t, s in rows if d == r.dialect and t and s is not None and first <= t[:10] <= last)
            assert r.units == len(exact)
            for q in score_sketches.WANTED:
                value = r[f"p{q}"]
                low, high = bisect.bisect_left(exact, value) / len(exact), bisect.bisect_right(exact, value) / len(exact)
                assert low - 2.3 / 400**0.9 <= q / 100 <= high + 2.3 / 400**0.9
    sketches.unpersist()


def test_small_sketches_are_exact(spark):
    scores = spark.createDataFrame([("A", float(i % 50)) for i in range(1000)], "dialect string, score double").selectExpr("dialect", "timestamp'2024-01-01 00:00:00' + make_dt_interval(int(score)) AS ts", "score")
    (row,) = score_sketches.quantiles(score_sketches.daily_sketches(scores), ["dialect"]).collect()
    assert tuple(row) == ("A", 1000, 12.0, 24.0, 37.0, 44.0)
