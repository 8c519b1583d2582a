"""Latency sketches next to exact percentiles."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stallwise.operators import monitoring as M, sketches as K

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, kind string, latency double, session_id string"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(7)
    rows = [(i, START + dt.timedelta(seconds=2 * i), "prediction" if i % 5 else "query", rng.lognormvariate(-1, 1), f"s{i % 700}")
            for i in range(20_000)]
    rows += [(50_000, None, "query", 0.1, "x"), (50_001, START, "query", None, "x"), (50_002, START, "error", 0.2, "x")]
    return M.records(spark.createDataFrame(rows, SCHEMA).repartition(4))


def test_spans_are_within_the_rank_error(events, tmp_path):
    path = str(tmp_path / "s")
    K.latency_sketches(events).write.parquet(path)
    stored = events.sparkSession.read.parquet(path)
    by_hour = K.latency_figures(stored.withColumn("hour", F.date_trunc("hour", "at")), "hour")
    errors = K.rank_errors(by_hour, events, F.date_trunc("hour", "ts"), "hour")
    assert errors.count() == 12 * 3  # hours by endpoints and all
    worst = errors.agg(*[F.max(f"{q}_error").alias(q) for q in K.QUANTILES]).first()
    assert max(worst) <= K.RANK_ERROR
    whole = {r["endpoint"]: r for r in K.latency_figures(stored).collect()}
    exact = {r["endpoint"]: r for r in events.where("latency IS NOT NULL AND ts IS NOT NULL AND endpoint IS NOT NULL").groupBy(
        "endpoint").agg(F.count("*").alias("n"), F.avg("latency").alias("avg")).collect()}
    for endpoint, row in exact.items():
        assert whole[endpoint]["count"] == row["n"] and whole[endpoint]["avg"] == pytest.approx(row["avg"])
    assert whole["all"]["count"] == 20_000 and abs(whole["query"]["sessions"] - 141) <= 4
    part = K.latency_between(stored, F.lit(START + dt.timedelta(hours=1)).cast("timestamp_ntz"),
                             F.lit(START + dt.timedelta(hours=2)).cast("timestamp_ntz"))
    assert {r["endpoint"]: r["count"] for r in part.collect()} == {"all": 1800, "predict": 1440, "query": 360}


def test_merging_in_any_order(events):
    minutes = K.latency_sketches(events)
    one = K.latency_figures(minutes)
    # first by hour, in batches that share minutes, then all: the same counts, every figure within the error
    halves = K.latency_sketches(events.where("event_id % 2 = 0")).unionByName(K.latency_sketches(events.where("event_id % 2 = 1")))
    hours = K.merged(halves, F.date_trunc("hour", "at").alias("at"), "endpoint")
    two = K.latency_figures(hours)
    assert {r["endpoint"]: r["count"] for r in one.collect()} == {r["endpoint"]: r["count"] for r in two.collect()}
    for figures in (one, two):
        errors = K.rank_errors(figures.withColumn("x", F.lit(1)), events, F.lit(1), "x")
        assert max(max(r[2:]) for r in errors.collect()) <= K.RANK_ERROR


def test_few_values_are_exact(events):
    some = events.where("event_id < 500 AND kind = 'prediction'")
    row = {r["endpoint"]: r for r in K.latency_figures(K.latency_sketches(some)).collect()}["all"]
    values = sorted(r["latency"] for r in some.collect())
    assert row["p50"] in values and abs(values.index(row["p50"]) - len(values) / 2) <= 1
    assert K.latency_figures(K.latency_sketches(events.limit(0))).count() == 0
