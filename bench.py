"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR picks the tables (default /root/testdata/sf0.1), BENCH_CPUS the local
cores. Each query is built, planned and run to a ``noop`` sink; after one warm-up run
the faster of two runs counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from logspark.operators.parse import parse_lines  # noqa: E402
from logspark.plans import queries  # noqa: E402
from logspark.plans.combine import combine_job  # noqa: E402
from logspark.plans.queries import QUERIES  # noqa: E402
from logspark.plans.sample_lines import sample_lines  # noqa: E402
from logspark.session import tune  # noqa: E402

HEADLINE = (
    "entry_counts",
    "parse_entries",
    "strict_entries",
    "strip_color",
    "composite_filter",
    "file_gate",
    "file_report",
    "unique_entries",
    "time_sorted",
    "combined_report",
    "json_lines",
    "pretty_color",
    "stream_filtered",
)
# Copies of the lines for a rate that is not mostly the fixed cost of a job.
COPIES = 10


def session(cpus: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("logspark-bench")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites of single column expressions; only needed for error messages.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def run(make) -> float:
    start = time.perf_counter()
    df: DataFrame = make()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def timed(make, runs: int = 2) -> float:
    run(make)
    return round(min(run(make) for _ in range(runs)), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = session(cpus)

    # Decoding alone, from lines held in memory.
    lines = sample_lines(spark, sf_dir).select("value").cache()
    count = lines.count()
    for _ in range(3):
        run(lambda: parse_lines(lines))
    seconds = {"decode_cached_lines": timed(lambda: parse_lines(lines))}
    seconds["decode_ten_copies"] = timed(
        lambda: parse_lines(lines.select(F.explode(F.array_repeat("value", COPIES)).alias("value"))), runs=3
    )
    lines.unpersist()

    for name in HEADLINE:
        seconds[name] = timed(lambda: QUERIES[name](spark, sf_dir))
    # Files are written beforehand; only reading them is timed.
    units = queries._unit_files(spark, sf_dir, "none", "gzip")
    tars = queries._written(spark, sf_dir, "tar", "tgz", "nested")

    def combine(folder: str, **how) -> float:
        jobs = []

        def make() -> DataFrame:
            jobs.append(combine_job(spark, folder, **how))
            return jobs[-1].entries

        took = timed(make)
        for job in jobs:
            job.release()
        return took

    seconds["combine_tree"] = combine(units, selection=queries.UNIT_FILES, unique=True)
    seconds["tar_archives"] = combine(tars)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "lines": count,
                "decoded_lines_per_sec": round(COPIES * count / seconds["decode_ten_copies"]),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
