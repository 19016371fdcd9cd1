"""Time the headline queries: one JSON line.

With a folder of a tenth of the rows beside the one that is timed (sf0.01 beside sf0.1), the
line also says how the times grow: ``growth`` is the power of the rows by which each does
(0: start-up only, 1: in proportion).
"""

import json
import math
import os
import time

from pyspark.sql import SparkSession

from tarn.plans import load

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "pricing_summary", "local_supplier_volume", "forecast_revenue", "shipping_priority", "exists_subquery", "correlated_subquery",
    "asof_left_join", "interval_overlap_join", "band_join", "cube", "distinct_and_filtered_aggregates", "quantiles",
    "ranking_windows", "framed_windows", "qualify", "top_n_with_offset", "except_all", "list_functions", "session_window", "full_text_bm25",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()

    def timed(name: str, folder: str, runs: int) -> float:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return min(took)

    times = {name: round(timed(name, SF_DIR, 2), 4) for name in HEADLINE}  # the first run compiles code
    head, _, scale = SF_DIR.rpartition("sf")
    line = {"metric": "headline_total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": scale}
    small = f"{head}sf{float(scale) / 10:g}" if scale.replace(".", "").isdigit() else ""
    if small and os.path.isdir(small):
        line["growth"] = {name: round(math.log10(took / timed(name, small, 1)), 2) for name, took in times.items()}
    print(json.dumps(line), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
