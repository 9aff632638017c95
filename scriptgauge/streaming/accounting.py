"""Scripts per dialect and tumbling window, with every late row accounted for.

A windowed aggregate of Spark drops rows that come after their window has closed. Here
a processor of its own keeps the counts of open windows as state, gives them out when a
timer says that the watermark has passed the window's end, and gives out each row that
comes later as a row of its own. So closed windows and late rows together are exactly
the scripts of those windows, in whatever order files arrive.

A window's rows are dealt to SALTS states by script, so a day that holds a third of all
rows is no single task; states hold two numbers each, whatever they have counted.

Defined results: a null time belongs to no window and is late at once, with a null
window; a null text has no characters; scripts of a null dialect are counted as a dialect
of their own; windows that the watermark has not passed are not given out yet.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import DELAY, run_to_table

DAY = 86_400_000
SALTS = 8
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "kind string, dialect string, start_ms long, script_id string, ms long, scripts long, chars long"
COLUMNS = [part.split()[0] for part in OUTPUT.split(", ")]


class WindowCounts(StatefulProcessor):
    """Counts of one (dialect, window, salt) until the window closes; what comes later is passed on."""

    def __init__(self, width: int):
        self.width = width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "scripts long, chars long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        dialect, start, _ = key
        open_window = start is not None and start + self.width > timerValues.getCurrentWatermarkInMs()
        scripts = chars = 0
        for part in rows:
            if open_window:
                scripts += len(part)
                chars += int(part["chars"].sum())
            else:
                yield pd.DataFrame({"kind": "late", "dialect": dialect, "start_ms": start, "script_id": part["script_id"], "ms": part["ms"], "scripts": 1, "chars": part["chars"]})[COLUMNS]
        if open_window:
            before = self.counts.get() if self.counts.exists() else (0, 0)
            self.counts.update((before[0] + scripts, before[1] + chars))
            self.handle.registerTimer(start + self.width)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        scripts, chars = self.counts.get()
        self.counts.clear()
        yield pd.DataFrame([("window", key[0], key[1], None, None, scripts, chars)], columns=COLUMNS)

    def close(self) -> None:
        pass


def window_rows(scripts: DataFrame, width: int = DAY, delay: str = DELAY) -> DataFrame:
    """Stream of closed windows' partial counts (``kind`` window) and of late scripts (``kind`` late) of scripts (script_id, dialect, ts, src)."""
    ms = F.unix_millis("ts")
    # plain numbers instead of the time column: the engine drops late rows only where it sees that column
    rows = scripts.withWatermark("ts", delay).select(
        "dialect",
        (F.floor(ms / width) * width).cast("bigint").alias("start_ms"),
        F.pmod(F.xxhash64("script_id"), F.lit(SALTS)).alias("salt"),
        "script_id",
        ms.alias("ms"),
        F.coalesce(F.length("src"), F.lit(0)).cast("bigint").alias("chars"),
    )
    return rows.groupBy("dialect", "start_ms", "salt").transformWithStateInPandas(WindowCounts(width), OUTPUT, "append", "eventTime")


def account(scripts: DataFrame, label: str, width: int = DAY, delay: str = DELAY) -> DataFrame:
    """All that is available of the stream, as a table of ``window_rows``."""
    spark = scripts.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        return run_to_table(window_rows(scripts, width, delay), label)
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def totals(rows: DataFrame) -> DataFrame:
    """(dialect, window_start, on_time, late, chars) per window, from ``account``'s rows."""
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("scripts")).otherwise(0))
    summed = rows.groupBy("dialect", "start_ms").agg(of("window").alias("on_time"), of("late").alias("late"), F.sum("chars").alias("chars"))
    return summed.select("dialect", F.timestamp_millis("start_ms").alias("window_start"), "on_time", "late", "chars")


def late_scripts(rows: DataFrame) -> DataFrame:
    """(script_id, dialect, ts, window_start, chars) of every script that came after its window had closed."""
    late = rows.filter("kind = 'late'")
    return late.select("script_id", "dialect", F.timestamp_millis("ms").alias("ts"), F.timestamp_millis("start_ms").alias("window_start"), "chars")
