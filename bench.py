"""Headline interval queries; prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: cores.
Each query is computed in full twice; the faster time counts. ``find_indexed`` is the
repeated query: its index is built before, in the time ``build_index``.
"""

import json
import os
import sys
import time

HEADLINE = [
    "find_any", "find_maxgap", "find_within", "find_indexed", "count", "count_within", "join_inner", "join_semi", "count_by_group", "agg_sum", "self_overlaps",
    "window_count_sliding", "coverage", "tile_coverage", "reduce", "disjoin", "range_intersect", "nearest", "precede", "cluster",
]


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from pyspark.sql import SparkSession

    import rangeloom as rl
    from rangeloom import catalog

    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}

    def timed(make) -> float:
        best = float("inf")
        for _ in range(2):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        return round(best, 3)

    for name in HEADLINE:
        spark.catalog.clearCache()
        if name == "find_indexed":
            began = time.perf_counter()
            index = rl.build_index(catalog.events(spark, sf))
            times["build_index"] = round(time.perf_counter() - began, 3)
            times[name] = timed(lambda: rl.find_overlaps(catalog.events(spark, sf), index, max_gap=120))
            index.unpersist()
        else:
            times[name] = timed(lambda: catalog.QUERIES[name](spark, sf))
    print(json.dumps({"metric": "interval_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
