"""Rolling sums and rolling drift next to plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stallwise.operators import monitoring as M
from stallwise.operators.rolling import rolling_sums

START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("n, block", [(5, None), (5, 5), (7, 11), (1, 1), (50, 64)])
def test_sums_of_the_last_rows(spark, n, block):
    rng = random.Random(n)
    rows = [("hot" if i % 3 else f"g{i % 5}", i % 40, i, None if i % 11 == 0 else rng.randrange(100)) for i in range(300)]
    frame = spark.createDataFrame(rows, "g string, t long, id long, x long").repartition(6)
    found = rolling_sums(frame, ["g"], ["t", "id"], {"s": F.col("x"), "c": F.col("x").isNotNull().cast("long")}, n, "roll",
                         block)
    assert sorted(found.columns) == sorted(["g", "t", "id", "x", "s", "c", "rows_in"])
    want = set()
    for group in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == group), key=lambda r: r[1:3])
        for i, row in enumerate(own):
            last = own[max(0, i - n + 1):i + 1]
            there = [r[3] for r in last if r[3] is not None]
            want.add((row[2], sum(there), len(there), len(last)))
    assert {(r["id"], r["s"], r["c"], r["rows_in"]) for r in found.collect()} == want


def test_status_at_every_prediction_is_that_of_its_moment(spark):
    rng = random.Random(3)
    rows = [(i, START + dt.timedelta(seconds=i // 2), "prediction" if i % 4 else "query",
             rng.gauss(40 if i < 500 else 60, 8), 0.1) for i in range(900)]
    events = M.records(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, kind string, prediction double, latency double"))
    reference = M.reference_stats(spark.createDataFrame([(float(30 + i % 21),) for i in range(200)], "prediction double"))
    found = {r["event_id"]: r for r in M.rolling_drift(events, reference, n=150, block=170).collect()}
    assert len(found) == 675
    for at in (50, 101, 399, 599, 601, 899):
        before = events.where(F.col("event_id") <= at)
        want = M.check_drift(M.last_predictions(before, 150), reference).first()
        assert {k: found[at][k] for k in want.asDict()} == want.asDict()
    assert {r["status"] for r in found.values()} >= {"insufficient_data", "drift_detected"}
    plan = M.rolling_drift(events, reference)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "SinglePartition" not in plan.split("Window")[1]
    nothing = M.rolling_drift(events, reference.where("pred_mean < 0"))
    assert {r["status"] for r in nothing.collect()} == {"no_reference"}
