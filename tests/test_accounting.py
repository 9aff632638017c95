"""Windows and late rows of a stream against batch counts."""

import datetime as dt
import os
import random

from scriptgauge.streaming import accounting, jobs

SCHEMA = "script_id string, dialect string, ts timestamp, src string"


def stream_of(spark, folder, batches):
    """Each batch is a file; files are streamed one by one, by age, in this order."""
    for i, rows in enumerate(batches):
        known = set(folder.glob("*.parquet"))
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        for path in set(folder.glob("*.parquet")) - known:
            os.utime(path, (1000 + i, 1000 + i))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_windows_and_late_rows_are_the_batch_counts(spark, tmp_path):
    rng = random.Random(9)
    day = lambda n, h=12: dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=n, hours=h)
    rows = [(f"s{i}", rng.choice(["Oracle", "Gauss", None]), day(rng.choice([0, 0, 1, 2, 3]), rng.randrange(24)), rng.choice([None, "", "SELECT 1"])) for i in range(120)]
    batches = [rows[:40], rows[40:80], rows[80:], [("last", "Hive", day(9), "x"), ("no time", "Hive", None, "abc")]]
    told = accounting.account(stream_of(spark, tmp_path / "in", batches), "accounting")
    want = {}
    for _, dialect, ts, src in rows:
        n, chars = want.get((dialect, ts.day), (0, 0))
        want[dialect, ts.day] = (n + 1, chars + len(src or ""))
    got = accounting.totals(told).collect()
    assert {(r.dialect, r.window_start.day): (r.on_time + r.late, r.chars) for r in got if r.window_start} == want
    late = {r.script_id: (r.dialect, r.ts) for r in accounting.late_scripts(told).collect()}
    assert late.pop("no time") == ("Hive", None)
    assert len(late) > 20 and sum(r.late for r in got if r.window_start) == len(late)
    utc = lambda t: t.replace(tzinfo=None)
    by_id = {r[0]: (r[1], utc(r[2])) for r in rows}
    assert {k: (d, t.isoformat()) for k, (d, t) in late.items()} == {k: (by_id[k][0], by_id[k][1].isoformat()) for k in late}
    # the first file is on time, and so is what comes for days that no file has closed
    assert not set(late) & {r[0] for r in rows[:40]}
    expected = set()
    mark = None
    for batch in batches:
        for i, _, ts, _ in batch:
            if ts is not None and mark is not None and utc(ts).replace(hour=0, minute=0) + dt.timedelta(days=1) <= mark:
                expected.add(i)
        newest = max(utc(r[2]) for r in batch if r[2] is not None) - dt.timedelta(minutes=10)
        mark = newest if mark is None else max(mark, newest)
    assert set(late) == expected


def test_in_order_nothing_is_late_and_as_the_windowed_aggregate(spark, tmp_path):
    start = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)
    rows = [(f"s{i}", "Gauss", start + dt.timedelta(hours=7 * i), "x" * i) for i in range(20)]
    told = accounting.totals(accounting.account(stream_of(spark, tmp_path / "in", [rows[:9], rows[9:]]), "accounting")).collect()
    plain = jobs.run_to_table(jobs.arrivals(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))), "arrivals").collect()
    assert {(r.window_start, r.on_time, r.late, r.chars) for r in told} == {(r.window_start, r.scripts, 0, r.chars) for r in plain}
    assert len(told) > 3
