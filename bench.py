"""Time the headline queries, median of three, beside DuckDB on the same files: one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "q_transit_slice", "q_consecutive_edges", "q_departure_board", "q_ride_pairs", "q_shared_lines", "q_rt_overlay", "q_radius_join", "q_nearest",
    "q_weld_junctions", "q_snap_points", "q_degree", "q_density_heat", "q_slope_grid", "q_doc_diff", "q_delta_encode", "q_hilbert_id",
]


def duckdb_seconds(sf: str, cpus: str, names: list[str]) -> dict[str, float]:
    """The time that DuckDB takes for the same queries' SQL on the same files: the baseline, median of three."""
    import duckdb

    from geoloom.plans.registry import SQL

    c = duckdb.connect()
    c.sql(f"SET threads = {int(cpus)}")
    for f in sorted(Path(sf).glob("*.parquet")):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    out = {}
    for name in names:
        if name in SQL:
            took = []
            for _ in range(3):
                began = time.perf_counter()
                c.sql(SQL[name]).fetchall()
                took.append(time.perf_counter() - began)
            out[name] = round(statistics.median(took), 3)
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    from geoloom.plans.registry import QUERIES

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # starts the session's threads
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        times[name] = round(statistics.median(took), 3)
    spark.stop()
    base = duckdb_seconds(sf, cpus, HEADLINE)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "baseline_duckdb": base, "sf": sf.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
