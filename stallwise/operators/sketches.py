"""Latency figures of any span of time from stored sketches per minute.

Exact percentiles need all records of a span. Here each minute keeps a quantile sketch
and a distinct-count sketch per endpoint, a few kilobytes at most; a span merges those
of its minutes, whatever the order. Counts and sums are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Size of a quantile sketch, and the rank error that its merges keep with a chance of 99 percent (2.446 / k ** 0.9433
#: for a rank between two bounds, as the sketch's authors measured it). Up to k values a sketch is exact.
K = 800
RANK_ERROR = 2.446 / K ** 0.9433
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def latency_sketches(events: DataFrame, grain: str = "minute", k: int = K) -> DataFrame:
    """``at, endpoint, records, latency_sum, latencies, sessions`` per span of ``grain`` and endpoint.

    Records without a time, an endpoint or a latency are left out. An endpoint with most of the records is no hot key:
    sketches are taken per task and merged. Rows of the same minute from several batches may stand side by side.
    """
    timed = events.where("ts IS NOT NULL AND endpoint IS NOT NULL AND latency IS NOT NULL")
    return timed.groupBy(F.date_trunc(grain, "ts").alias("at"), "endpoint").agg(
        F.count("*").alias("records"), F.sum("latency").alias("latency_sum"),
        F.kll_sketch_agg_double("latency", k).alias("latencies"),
        F.hll_sketch_agg(F.coalesce("session_id", F.lit(""))).alias("sessions"))


def merged(sketches: DataFrame, *keys: Column | str) -> DataFrame:
    """The sketches of each key made one; the result can be merged again."""
    return sketches.groupBy(*keys).agg(
        F.sum("records").alias("records"), F.sum("latency_sum").alias("latency_sum"),
        F.kll_merge_agg_double("latencies").alias("latencies"), F.hll_union_agg("sessions").alias("sessions"))


def latency_figures(sketches: DataFrame, *keys: str) -> DataFrame:
    """Mean, percentiles, record count and distinct sessions of each key and endpoint, and of all endpoints together."""
    ends = merged(sketches, *keys, "endpoint")
    rows = ends.unionByName(merged(ends.withColumn("endpoint", F.lit("all")), *keys, "endpoint"))
    return rows.select(
        *keys, "endpoint", (F.col("latency_sum") / F.col("records")).alias("avg"),
        *[F.kll_sketch_get_quantile_double("latencies", F.lit(q)).alias(name) for name, q in QUANTILES.items()],
        F.col("records").alias("count"), F.hll_sketch_estimate("sessions").alias("sessions"))


def latency_between(sketches: DataFrame, start: Column, end: Column) -> DataFrame:
    """Figures of the minutes from ``start`` up to, not including, ``end``; the filter reaches the stored files."""
    return latency_figures(sketches.where((F.col("at") >= start) & (F.col("at") < end)))


def rank_errors(figures: DataFrame, events: DataFrame, key: Column, name: str) -> DataFrame:
    """How far each percentile of ``latency_figures`` by ``name`` is from its exact rank among the records.

    A value that occurs often has a range of ranks; the error is the distance to it.
    """
    timed = events.where("ts IS NOT NULL AND endpoint IS NOT NULL AND latency IS NOT NULL").select(
        key.alias(name), F.explode(F.array("endpoint", F.lit("all"))).alias("endpoint"), "latency")
    counted = timed.join(figures, [name, "endpoint"]).groupBy(name, "endpoint").agg(*[
        f for q in QUANTILES for f in (
            (F.count_if(F.col("latency") < F.col(q)) / F.count("*")).alias(f"{q}_below"),
            (F.count_if(F.col("latency") <= F.col(q)) / F.count("*")).alias(f"{q}_to"))])
    errors = [F.greatest(F.col(f"{n}_below") - q, F.lit(q) - F.col(f"{n}_to"), F.lit(0.0)).alias(f"{n}_error")
              for n, q in QUANTILES.items()]
    return counted.select(name, "endpoint", *errors)
