"""Metric streams: counters and histogram by minute, drift by micro-batch, scoring."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from stallwise.operators import monitoring as M
from stallwise.operators.model import DiscountModel

WINDOW = "1 minute"


def _edge(value: float) -> str:
    return f"le_{str(value).replace('.', '_')}"


def counts_by_minute(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """Records, latency sum and cumulative latency buckets per minute and kind."""
    edges = [F.count_if(F.col("latency") <= e).alias(_edge(e)) for e in M.LATENCY_EDGES]
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .groupBy(F.window("ts", window), "kind")
        .agg(F.count("*").alias("records"), F.sum("latency").alias("latency_sum"), *edges)
        .select(F.col("window.start").alias("minute"), "kind", "records", "latency_sum",
                *[_edge(e) for e in M.LATENCY_EDGES])
    )


def keep_counts(events: DataFrame, path: str, checkpoint: str, window: str = WINDOW):
    """Counts of every micro-batch, each batch in its own folder.

    Counts and sums add up, so no state is held and no record is ever too late; a batch that is run again replaces its
    folder. ``merged_counts`` adds the batches.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        counts_by_minute(batch, window).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def merged_counts(spark, path: str) -> DataFrame:
    """All batches of ``keep_counts`` together, one row per minute and kind."""
    rows = spark.read.parquet(path)
    added = [c for c in rows.columns if c not in ("minute", "kind", "batch")]
    return rows.groupBy("minute", "kind").agg(*[F.sum(c).alias(c) for c in added])


def watch_drift(events: DataFrame, reference: DataFrame, path: str, checkpoint: str,
                threshold: float = M.DRIFT_THRESHOLD):
    """Drift status after every micro-batch.

    The window of the last 1,000 predictions is kept as one small table per batch;
    a batch merges its own newest 1,000 with the table of the batch before.
    ``reference`` is the one row of ``reference_stats``.
    """
    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = M.last_predictions(batch)
        before = f"{path}/window/batch={batch_id - 1}"
        if batch_id:
            newest = newest.unionByName(spark.read.schema(newest.schema).parquet(before))
        order = [F.desc(c) for c in M.ORDER]
        here = f"{path}/window/batch={batch_id}"
        newest.orderBy(*order).limit(M.DRIFT_WINDOW).write.mode("overwrite").parquet(here)
        window = spark.read.schema(newest.schema).parquet(here)
        status = M.check_drift(window, reference, threshold)
        status.write.mode("overwrite").parquet(f"{path}/status/batch={batch_id}")

    return (
        events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def latest_status(spark, path: str) -> DataFrame:
    rows = spark.read.parquet(os.path.join(path, "status"))
    return rows.orderBy(F.desc("batch")).limit(1).drop("batch")


def score_stream(matrix: DataFrame, model: DiscountModel, path: str, checkpoint: str):
    """Score arriving feature rows; results go to Parquet files."""
    return (
        model.explain(matrix).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
