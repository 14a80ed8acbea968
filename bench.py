"""Times the headline queries, each in its first run and in a second one; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from mnemograph.plans import catalog

HEADLINE = ("projection_fold", "event_dedupe", "idempotency_conflicts", "neighborhood_bfs", "node_relationships", "shortest_path", "temporal_forward", "temporal_near", "temporal_goto", "bundle_stats", "salience_order", "flat_packing", "tiered_truncation", "money_mentions", "derive_difference", "cosine_topk", "task_scorecard", "temporal_leak_check")


def calibrated(spark: SparkSession) -> float:
    """Seconds of a fixed job that reads no table: JSON texts made, parsed and folded; rounds on different machines can be compared by it."""
    start = time.perf_counter()
    made = spark.range(0, 2_000_000, numPartitions=16).selectExpr("id", "to_json(named_struct('k', id % 1000, 'v', concat('text ', id))) as j")
    made.selectExpr("from_json(j, 'k long, v string') as x", "id").groupBy("x.k").agg({"id": "max", "x.v": "max"}).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    calibration = [calibrated(spark) for _ in range(3)]  # the first ones compile code
    seconds, warm = {}, {}
    for taken in (seconds, warm):  # a query's first run compiles its code
        for name in HEADLINE:
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken[name] = round(time.perf_counter() - start, 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({"metric": "headline queries, sum of seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1], "calibration_seconds": calibration[-1], "events_folded_per_second": round(events / seconds["projection_fold"]), "second_run": warm, "second_run_value": round(sum(warm.values()), 3), "second_run_events_folded_per_second": round(events / warm["projection_fold"])}))


if __name__ == "__main__":
    main()
