"""The monitoring report of an event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.operators import monitoring as M
from stallwise.sources.stores import write_json_row


def drift_status(events: DataFrame, reference: DataFrame) -> DataFrame:
    """Drift of the last 1,000 predictions against reference predictions."""
    return M.check_drift(M.last_predictions(events), M.reference_stats(reference))


def report(events: DataFrame, reference: DataFrame, now: Column) -> DataFrame:
    last = last_retrain(events)
    return M.full_report(events, M.reference_stats(reference), last, now)


def last_retrain(events: DataFrame) -> Column:
    return events.agg(F.max(F.when(F.col("kind") == "retrain", F.col("ts"))).alias("t")).scalar()


def export(events: DataFrame, reference: DataFrame, now: Column, path: str) -> None:
    write_json_row(report(events, reference, now), path)
