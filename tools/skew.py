"""Largest share of shuffled rows that one task reads, on tables with one hot camera.

A third of all events belong to one user, as do the documents and turns built from
them. Prints per query the most records any single task read from a shuffle, as a
share of the events.

usage: python tools/skew.py [--rows 600000] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
import time
from collections import defaultdict
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wayline.catalog import QUERIES  # noqa: E402

TABLES = "nation supplier customer part orders documents embeddings conversations labels".split()


def hot_tables(spark, source: str, folder: str, rows: int) -> None:
    """Events with a hot user over 30 days; the other tables as they are."""
    n = F.col("id")
    kinds = F.array(*[F.lit(k) for k in ("view", "click", "purchase", "signup", "error")])
    at = F.timestamp_micros(F.lit(1704067200000000) + F.floor(n * (30 * 86400 * 1000000 / rows)).cast("bigint"))
    spark.range(rows).select(
        n.alias("event_id"), at.cast("timestamp_ntz").alias("ts"),
        F.when(n % 3 == 0, F.lit(1)).otherwise(F.pmod(F.xxhash64(n), F.lit(max(rows // 100, 1)))).cast("bigint").alias("user_id"),
        F.element_at(kinds, (F.pmod(F.xxhash64(n, F.lit(1)), F.lit(5)) + 1).cast("int")).alias("event_type"),
        (F.pmod(F.xxhash64(n, F.lit(2)), F.lit(9000)) / 100).alias("value"), F.lit('{"k": 1}').alias("props"),
    ).repartition(8).write.parquet(f"{folder}/events.parquet")
    for name in TABLES:
        spark.read.parquet(f"{source}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("--rows", type=int, default=600_000)
    parser.add_argument("--source", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    logs = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (
        SparkSession.builder.master("local[8]").appName("skew").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "64").config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", logs)
        .config("spark.eventLog.compress", "false").config("spark.eventLog.rolling.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    hot_tables(spark, args.source, folder, args.rows)
    took = {}
    for name in QUERIES:
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        spark.sparkContext.setJobDescription(name)
        begin = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = time.time() - begin
    spark.stop()
    stage_of: dict[int, str] = {}
    most: dict[str, int] = defaultdict(int)
    for file in Path(logs).iterdir():
        for line in file.open():
            event = json.loads(line)
            if event["Event"] == "SparkListenerJobStart":
                label = event.get("Properties", {}).get("spark.job.description", "")
                for stage in event["Stage IDs"]:
                    stage_of[stage] = label.split("\n")[0]
            elif event["Event"] == "SparkListenerTaskEnd" and event.get("Task Metrics"):
                read = event["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"]
                label = stage_of.get(event["Stage ID"], "")
                most[label] = max(most[label], read)
    for name, seconds in took.items():
        print(f"{name:36s} {most[name]:>9d} rows  {most[name] / args.rows:6.1%}  {seconds:6.1f}s")


if __name__ == "__main__":
    main()
