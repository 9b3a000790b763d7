"""Headline queries on one machine; prints one JSON line.

Each query writes to the `noop` sink: one run to warm up, then the median of
`BENCH_RUNS` (3) timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagemill.plans.queries import flagship, queries  # noqa: E402

HEADLINE = [
    "p1_parse_html",
    "f14_extract_page_text",
    "f7_extract_structured_text",
    "f9_extract_feed_text",
    "l1_extract_links",
    "l4_link_stats",
    "l5_crawl",
    "m5_extract_media",
    "s3_write_texts",
    "q6_quality_score",
    "q8_filter_paragraphs",
    "q10_semantic_quality",
    "e4_similar_pairs",
    "j1_run_extract",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = os.environ.get("BENCH_ONLY")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("pagemill-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        # plan building without a stack capture per expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {"flagship": flagship, **{n: queries()[n] for n in HEADLINE}}
    if only:
        todo = {n: q for n, q in todo.items() if n in only.split(",")}
    seconds = {}
    for name, query in todo.items():
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            query(spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
        print(name, [round(t, 2) for t in times], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
