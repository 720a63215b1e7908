"""Throughput of the array operators on generated arrays of BENCH_ROWS elements; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import sparkarray as sa


def main() -> None:
    n, cpus = int(float(os.environ.get("BENCH_ROWS", "1e8"))), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(max(int(cpus), n // 2_000_000))).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "20g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    array = lambda: spark.range(n).select(F.col("id").alias("idx"), F.pmod(F.xxhash64("id"), F.lit(1_000_003)).alias("v"))
    runs = {
        "reduce_sum": lambda: sa.mapreduce(array(), F.col("v"), "+"),
        "argmax": lambda: sa.argmax(array(), F.col("v")),
        "uniform_f32": lambda: sa.rand(spark.range(n).withColumnRenamed("id", "idx"), 7, kind="float"),
        "matvec_rows": lambda: sa.matvec_rows(spark.range(n // 100).select(F.col("id").alias("i"), F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.pmod(F.col("id") + k, F.lit(97))).alias("row")), F.col("row"), list(range(100))),
        "scan_sum": lambda: sa.scan(array(), F.col("v"), "+"),
        "sort": lambda: sa.sort(array(), [F.asc("v")]),
    }
    took = {}
    for name, run in runs.items():
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 2)
    print(json.dumps({"rows": n, "unit": "sec", "queries": took, "million_rows_per_sec": {k: round(n / 1e6 / s, 1) for k, s in took.items()}}))
    spark.stop()


if __name__ == "__main__":
    main()
