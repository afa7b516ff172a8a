"""Benchmark: prints one JSON line with the seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores.  Results go to a sink that takes every column of every row.
Each query runs once to warm up; the better of the next two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from catalog.queries import QUERIES, order_responses
from reportweave.plans.structure import structure, with_answers
from reportweave.session import scratch_folder, tune

HEADLINE = [
    "q1_category_hist", "q2_av_brand", "q2_other_road_user", "q2_other_vehicle", "q4_environment",
    "q5_damage", "q6_factors", "q7_movement", "hist_multi", "hist_binned", "hist_topk", "hist_color",
    "scatter_ols", "lowess", "box_stats", "kde", "slugify", "keyword_category", "lookup_substring",
    "lookup_table", "page_payload", "resume_antijoin",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))

    def run(make) -> float:
        times = []
        for _ in range(3):
            start = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        return round(min(times[1:]), 3)

    seconds = {name: run(lambda q=QUERIES[name]: q(spark, sf_dir)) for name in HEADLINE}

    # Structuring from stored responses, the reference workload.
    path = scratch_folder(spark, "bench")
    order_responses(spark, sf_dir).write.parquet(path)
    stored = spark.read.parquet(path)
    n = stored.count()
    seconds["answers_from_stored"] = run(lambda: with_answers(stored).drop("response"))
    seconds["structure_from_stored"] = run(lambda: structure(stored))
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": {
            "answers": round(n / seconds["answers_from_stored"]),
            "structure": round(n / seconds["structure_from_stored"]),
        },
        "responses": n,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
