"""Time the headline merges; prints one JSON line.

``BENCH_SF_DIR`` names the input folder, ``BENCH_CPUS`` the local threads. The
history sides are derived and written before the clock starts, as a user's
tables would be there; every timed run merges them anew and computes every
merged row. After warm-up runs the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from histmerge.plans.history import merge_history
from histmerge.plans.oracles import NOW_US
from histmerge.plans.queries import merge_lines, merge_order_months
from histmerge.sources.derived import derived_history
from histmerge.workspace import Workspace

WARM_UP = int(os.environ.get("BENCH_WARM_UP", "3"))
RUNS = int(os.environ.get("BENCH_RUNS", "5"))


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("histmerge-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # Shuffled hash joins where every shuffled part of a side is small.
        .config("spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def compute(*tables: DataFrame) -> None:
    """Compute every row and column, keeping none."""
    for df in tables:
        df.write.format("noop").mode("overwrite").save()


def timed(run: Callable[[], None]) -> float:
    for _ in range(WARM_UP):
        run()
    seconds = []
    for _ in range(RUNS):
        started = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - started)
    return round(statistics.median(seconds), 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    prepared = Workspace(spark)

    def written(side: str):
        read = derived_history(spark, sf_dir, side)
        return read.mapped(lambda name, df: prepared.keep(df, f"{side}-{name}"))

    src, dst = written("src"), written("dst")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")

    def history() -> None:
        merged = merge_history(src, dst, NOW_US, Workspace(spark))
        merged.stats.collect()
        compute(*merged.history.tables().values())

    runs = {
        "merge_history": history,
        "merge_facts_lineitem": lambda: compute(merge_lines(lineitem, Workspace(spark)).table),
        "merge_dimension_orders": lambda: compute(
            merge_order_months(orders, Workspace(spark)).table
        ),
    }
    found = {name: timed(run) for name, run in runs.items()}
    rows = {
        "merge_history": sum(df.count() for side in (src, dst) for df in side.tables().values()),
        "merge_facts_lineitem": 2 * lineitem.count(),
        "merge_dimension_orders": 2 * orders.count(),
    }
    print(
        json.dumps(
            {
                "metric": "median seconds of the headline merges, summed",
                "value": round(sum(found.values()), 3),
                "unit": "sec",
                "queries": found,
                "rows_per_sec": {name: int(rows[name] / found[name]) for name in found},
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
