import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwise.operators import monitoring as M

START = dt.datetime(2024, 1, 1)


def events(spark, predictions=(), queries=(), errors=0):
    rows = [(i, "prediction", START + dt.timedelta(seconds=i), float(p), float(l), None, None, None, None, None)
            for i, (p, l) in enumerate(predictions)]
    rows += [(10**6 + i, "query", START + dt.timedelta(seconds=i), None, float(l), "q" * 150, "high", "s", None, None)
             for i, l in enumerate(queries)]
    rows += [(2 * 10**6 + i, "error", START + dt.timedelta(seconds=i), None, None, None, None, None, "rag_error", f"e{i}")
             for i in range(errors)]
    table = spark.createDataFrame(rows, "event_id long, kind string, ts timestamp_ntz, prediction double, latency double, "
                                  "query string, confidence string, session_id string, error_type string, message string")
    return M.records(table)


def test_latency_of_the_last_hundred(spark):
    rng = np.random.default_rng(1)
    first, second = rng.random(250), rng.random(30)
    table = events(spark, [(1, l) for l in first], second)
    got = {r["endpoint"]: r for r in M.latency_stats(table).collect()}
    for name, values in {"predict": first[-100:], "query": second, "all": np.r_[first[-100:], second]}.items():
        assert got[name]["count"] == len(values)
        for field, want in (("avg", values.mean()), ("p50", np.percentile(values, 50)),
                            ("p95", np.percentile(values, 95)), ("p99", np.percentile(values, 99))):
            assert math.isclose(got[name][field], want)


def test_nothing_recorded(spark):
    rows = M.latency_stats(events(spark, errors=1)).collect()
    assert {tuple(r) for r in rows} == {(n, 0.0, 0.0, 0.0, 0.0, 0) for n in ("predict", "query", "all")}


def test_summary_and_excerpt(spark):
    table = events(spark, [(35.0, 0.05)], [0.1], 7)
    row = M.summary(table).first()
    assert (row["total_predictions"], row["total_queries"], row["total_errors"]) == (1, 1, 7)
    assert [e["message"] for e in row["recent_errors"]] == ["e2", "e3", "e4", "e5", "e6"]
    assert table.filter("kind = 'query'").first()["query"] == "q" * 100


def status(spark, reference, current):
    ref = M.reference_stats(spark.createDataFrame([(float(x),) for x in reference], "prediction double"))
    return M.check_drift(M.last_predictions(events(spark, [(x, 0) for x in current])), ref).first()


def test_drift_status(spark):
    rng = np.random.default_rng(2)
    reference = rng.normal(40, 5, 5000)
    assert status(spark, [], reference[:200])["status"] == "no_reference"
    assert status(spark, reference, reference[:99])["status"] == "insufficient_data"
    same = status(spark, reference, rng.permutation(reference)[:1000])
    assert same["status"] == "ok" and not same["drift_detected"]
    moved = status(spark, reference, reference[:500] + 10)
    assert moved["status"] == "drift_detected" and moved["mean_drift"] > 1.5 and moved["psi"] > 0.2


def test_psi_against_numpy(spark):
    rng = np.random.default_rng(4)
    reference, current = rng.uniform(30, 50, 100), np.r_[rng.uniform(30, 50, 148), 1000.0, -1000.0]
    mean, std = reference.mean(), reference.std()
    edges = np.linspace(mean - 3 * std, mean + 3 * std, 11)
    share = np.clip(np.histogram(current, edges)[0] / len(current), 0.001, 1)
    normal = np.clip(np.array(M.NORMAL_SHARES), 0.001, 1)
    want = max(0.0, float(np.sum((share - normal) * np.log(share / normal))))
    assert abs(status(spark, reference, current)["psi"] - round(want, 4)) < 1e-9


def test_last_bin_is_closed(spark):
    row = spark.range(1).select(
        M.bin_of(F.lit(3.0), F.lit(0.0), F.lit(1.0)).alias("top"), M.bin_of(F.lit(-3.0), F.lit(0.0), F.lit(1.0)).alias("low"),
        M.bin_of(F.lit(3.01), F.lit(0.0), F.lit(1.0)).alias("out"), M.bin_of(F.lit(5.0), F.lit(5.0), F.lit(0.0)).alias("flat")).first()
    assert tuple(row) == (9, 0, None, 9)


@pytest.mark.parametrize("errors,latency,want", [(0, 0.1, "healthy"), (51, 0.1, "degraded"), (101, 0.1, "unhealthy"),
                                                 (0, 2.5, "degraded"), (0, 5.5, "unhealthy")])
def test_health(spark, errors, latency, want):
    table = events(spark, [(40, latency)] * 20, errors=errors)
    drift = M.check_drift(M.last_predictions(table), M.reference_stats(table.limit(0)))
    assert M.health(table, drift).first()["status"] == want


def test_retrain_reasons(spark):
    table = events(spark, [(40, 0.1)] * 30, errors=2)
    drift = M.check_drift(M.last_predictions(table), M.reference_stats(table.limit(0)))
    last, now = F.lit(START).cast("timestamp_ntz"), F.lit(START + dt.timedelta(days=31, hours=1)).cast("timestamp_ntz")
    row = M.retrain_decision(table, drift, last, now).first()
    assert row["should_retrain"] and row["reasons"] == ["High error rate: 6.67%", "Time since last retrain: 31 days"]
    calm = M.retrain_decision(events(spark, [(40, 0.1)] * 100, errors=5), drift, F.lit(None).cast("timestamp_ntz"), now).first()
    assert not calm["should_retrain"] and calm["reasons"] == []


def test_exported_metrics(spark):
    table = events(spark, [(35.0, 0.05), (36.0, 0.3)], [11.0], 2)
    rows = {(r["metric"], r["label"]): r["value"] for r in M.exported_metrics(table).collect()}
    assert rows[("discount_predictions_total", "")] == 2 and rows[("errors_total", "rag_error")] == 2
    assert rows[("request_latency_seconds_bucket", "predict le=0.05")] == 1
    assert rows[("request_latency_seconds_bucket", "query le=10.0")] == 0
    assert rows[("request_latency_seconds_bucket", "query le=+Inf")] == 1
    assert rows[("last_prediction_value", "")] == 36.0 and rows[("drift_score", "")] == 0.0


def test_component_health(spark):
    row = M.component_health({"model": spark.range(1), "rag": None, "data": spark.range(0)}).first()
    assert tuple(row) == ("degraded", "healthy", "unavailable", "unavailable")
