"""Time the headline queries and print one JSON line.

Each query writes its whole result to Spark's no-op sink. Session start and one
warm-up query are not counted.
"""

from __future__ import annotations

import json
import os
import time

from scriptgauge.plans.catalog import QUERIES
from scriptgauge.session import local_session

HEADLINE = [
    "stmt_scores",
    "stmt_features_long",
    "table_refs",
    "hot_tables",
    "split_units",
    "nested_calls",
    "unit_scores",
    "top_units",
    "package_rollup",
    "call_chain_depth",
    "lineage_depth",
    "duplicate_statements",
    "corpus_cube",
    "stream_scripts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    spark = local_session(cores, memory=os.environ.get("BENCH_MEMORY", "16g"), name="bench")
    QUERIES["stmt_type_counts"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
