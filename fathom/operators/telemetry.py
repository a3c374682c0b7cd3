"""Aggregates of search telemetry and of latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snapshot(telemetry: DataFrame) -> DataFrame:
    """One row: totals, cache hits and misses (only of searches that looked), mean latency, hit rate, and searches by strategy."""
    looked = F.col("cache_lookup")
    by = telemetry.groupBy("fusion_strategy").agg(F.count("*").alias("n"), F.count(F.when(looked & F.col("cache_hit"), 1)).alias("h"), F.count(F.when(looked & ~F.col("cache_hit"), 1)).alias("m"), F.count("embedding_latency_ms").alias("e"), F.coalesce(F.sum("latency_ms"), F.lit(0)).alias("t"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    one = by.agg(total("n").alias("total_searches"), total("h").alias("cache_hits"), total("m").alias("cache_misses"), total("e").alias("embedding_calls"), total("t").alias("t"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("fusion_strategy", "n")))).alias("strategy_distribution"))
    looks = F.col("cache_hits") + F.col("cache_misses")
    return one.select("total_searches", "cache_hits", "cache_misses", "embedding_calls", F.when(F.col("total_searches") > 0, F.col("t") / F.col("total_searches")).otherwise(0.0).alias("avg_latency_ms"), F.when(looks > 0, F.col("cache_hits") / looks).otherwise(0.0).alias("cache_hit_rate"), "strategy_distribution")


def nearest_rank(n: Column, percent: float) -> Column:
    """Index, from 0, of a percentile among n sorted values; halves are rounded up."""
    return F.floor((n - 1) * percent / 100 + 0.5)


def latency_summary(latencies: DataFrame) -> DataFrame:
    """Nearest-rank percentiles and totals for each benchmark, of (benchmark, latency_us). Equal latencies are counted first, with
    partial sums before the shuffle, so that the window of a benchmark ranks its different latencies only; a null isn't counted."""
    counted = latencies.where(F.col("latency_us").isNotNull()).groupBy("benchmark", "latency_us").agg(F.count("*").alias("_c"))
    by = Window.partitionBy("benchmark")
    ranked = counted.withColumn("_to", F.sum("_c").over(by.orderBy("latency_us"))).withColumn("_n", F.sum("_c").over(by))
    at = lambda i: F.max(F.when((i >= F.col("_to") - F.col("_c")) & (i < F.col("_to")), F.col("latency_us")))
    n, many = F.col("_n"), F.sum("_c")
    total = F.sum(F.col("latency_us") * F.col("_c"))
    return ranked.groupBy("benchmark").agg(
        many.alias("iterations"),
        *[at(nearest_rank(n, p)).alias(f"p{p}_us") for p in (50, 95, 99)],
        F.min("latency_us").alias("min_us"),
        F.max("latency_us").alias("max_us"),
        F.floor(total / many).alias("mean_us"),
        at(F.floor(n / 2)).alias("upper_median_us"),
        F.when(total > 0, many * 1e6 / total).otherwise(0.0).alias("throughput_qps"),
        F.floor(total / 1000).alias("total_duration_ms"),
    )
