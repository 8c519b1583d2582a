"""Service metrics, latency, drift, retraining and health over metric events.

``events`` has the columns of ``schemas.METRIC_EVENT``; ``kind`` is ``prediction``,
``query``, ``error`` or ``retrain``; time order is ``(ts, event_id)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.functions import scoring as S, text as X
from stallwise.operators.ordered import last_rows
from stallwise.operators.rolling import rolling_sums
from stallwise.session import local_copy

# Windows, limits, histogram edges.
ORDER = ["ts", "event_id"]
LATENCY_RECORDS = 100
DRIFT_WINDOW = 1000
DRIFT_SAMPLES = 100
DRIFT_THRESHOLD = 0.1
PSI_LIMIT = 0.2
ERROR_RATE_LIMIT = 0.05
RETRAIN_DAYS = 30
RECENT_ERRORS = 5
BINS = 10
BIN_RANGE = 3.0
SHARE_FLOOR = 0.001
#: Mass of the standard normal in ten bins of width 0.6 from -3 to 3.
NORMAL_SHARES = [0.006848, 0.027733, 0.079139, 0.159183, 0.225747,
                 0.225747, 0.159183, 0.079139, 0.027733, 0.006848]
#: Default edges of the Prometheus client library.
LATENCY_EDGES = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]
UNHEALTHY_ERRORS, DEGRADED_ERRORS = 100, 50
UNHEALTHY_P95, DEGRADED_P95 = 5, 2
ENDPOINTS = {"prediction": "predict", "query": "query"}


#: Fields that a record of each kind keeps.
FIELDS = {
    "prediction": ["prediction", "latency"],
    "query": ["query", "latency", "confidence", "session_id"],
    "error": ["error_type", "message"],
    "retrain": ["message"],
}


def records(rows: DataFrame) -> DataFrame:
    """Metric events out of rows that carry ``event_id, ts, kind`` and the kind's fields.

    One pass for all kinds; fields that a kind does not keep are NULL.
    """
    types = {"prediction": "double", "latency": "double"}
    fields = ["prediction", "latency", "query", "confidence", "session_id", "error_type", "message"]

    def kept(field: str) -> Column:
        if field not in rows.columns:
            return F.lit(None).cast(types.get(field, "string")).alias(field)
        value = X.query_excerpt(F.col(field)) if field == "query" else F.col(field)
        kinds = [kind for kind, names in FIELDS.items() if field in names]
        return F.when(F.col("kind").isin(kinds), value.cast(types.get(field, "string"))).alias(field)

    endpoint = F.when(F.col("kind") == "prediction", "predict").when(F.col("kind") == "query", "query")
    return rows.select("event_id", "kind", "ts", endpoint.alias("endpoint"), *[kept(f) for f in fields])


def prediction_records(rows: DataFrame) -> DataFrame:
    return records(rows.withColumn("kind", F.lit("prediction")))


def query_records(rows: DataFrame) -> DataFrame:
    return records(rows.withColumn("kind", F.lit("query")))


def error_records(rows: DataFrame) -> DataFrame:
    return records(rows.withColumn("kind", F.lit("error")))


def totals(events: DataFrame) -> DataFrame:
    return events.agg(
        F.count_if(F.col("kind") == "prediction").alias("total_predictions"),
        F.count_if(F.col("kind") == "query").alias("total_queries"),
        F.count_if(F.col("kind") == "error").alias("total_errors"))


def recent_latencies(events: DataFrame, n: int = LATENCY_RECORDS) -> DataFrame:
    """Last ``n`` prediction and last ``n`` query records."""
    timed = events.filter(F.col("kind").isin(*ENDPOINTS)).select("kind", "endpoint", *ORDER, "latency")
    return last_rows(timed, ["kind"], ORDER, n)


def latency_stats(events: DataFrame) -> DataFrame:
    """Mean, percentiles and count for ``predict``, ``query`` and ``all``; zeros when empty.

    The figures come from one aggregate over at most 200 rows, so all three rows
    exist even without any record.
    """
    recent = recent_latencies(events)
    groups = {"predict": F.col("endpoint") == "predict", "query": F.col("endpoint") == "query",
              "all": F.lit(True)}
    figures = []
    for name, member in groups.items():
        latency = F.when(member, F.col("latency"))
        figures += [
            F.avg(latency).alias(f"{name}_avg"),
            F.percentile(latency, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias(f"{name}_p"),
            F.count(latency).alias(f"{name}_count")]

    def zero(value: Column) -> Column:
        return F.coalesce(value, F.lit(0.0))

    rows = F.array(*[
        F.struct(
            F.lit(name).alias("endpoint"), zero(F.col(f"{name}_avg")).alias("avg"),
            zero(F.get(f"{name}_p", F.lit(0))).alias("p50"), zero(F.get(f"{name}_p", F.lit(1))).alias("p95"),
            zero(F.get(f"{name}_p", F.lit(2))).alias("p99"), F.col(f"{name}_count").alias("count"))
        for name in groups])
    return recent.agg(*figures).select(F.inline(rows))


def error_rate(events: DataFrame) -> DataFrame:
    rate = F.try_divide(F.col("total_errors"), F.col("total_predictions"))
    return totals(events).select(
        "total_predictions", "total_errors", rate.alias("error_rate"),
        F.coalesce(rate > ERROR_RATE_LIMIT, F.lit(False)).alias("high_error_rate"))


def recent_errors(events: DataFrame, n: int = RECENT_ERRORS) -> DataFrame:
    errors = events.filter(F.col("kind") == "error")
    return errors.orderBy(*[F.desc(c) for c in ORDER]).limit(n).select(
        "event_id", "ts", "error_type", "message")


def counters(events: DataFrame) -> DataFrame:
    """Counters by kind; errors also by type."""
    names = {"prediction": "discount_predictions_total", "query": "rag_queries_total", "error": "errors_total"}
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return (
        events.filter(F.col("kind").isin(*names))
        .groupBy("kind", F.coalesce("error_type", F.lit("")).alias("type")).agg(F.count("*").alias("value"))
        .select(F.try_element_at(named, "kind").alias("metric"), "type", "value")
    )


def latency_histogram(events: DataFrame) -> DataFrame:
    """(endpoint, le, cumulative_count, latency_sum, latency_count), one row per edge."""
    edges = [(e, str(e)) for e in LATENCY_EDGES]
    timed = events.filter(F.col("endpoint").isNotNull() & F.col("latency").isNotNull())
    counted = timed.groupBy("endpoint").agg(
        *[F.count_if(F.col("latency") <= e).alias(f"le_{i}") for i, (e, _) in enumerate(edges)],
        F.sum("latency").alias("latency_sum"), F.count("*").alias("latency_count"))
    buckets = [F.struct(F.lit(label).alias("le"), F.col(f"le_{i}").alias("cumulative_count"))
               for i, (_, label) in enumerate(edges)]
    buckets.append(F.struct(F.lit("+Inf").alias("le"), F.col("latency_count").alias("cumulative_count")))
    return counted.select("endpoint", "latency_sum", "latency_count", F.inline(F.array(*buckets)))


def gauges(events: DataFrame) -> DataFrame:
    """Last prediction value; the drift gauge is never set and stays 0."""
    last = F.max_by(F.when(F.col("kind") == "prediction", F.col("prediction")),
                    F.when(F.col("kind") == "prediction", F.struct(*ORDER)))
    return events.agg(F.coalesce(last, F.lit(0.0)).alias("v")).select(F.inline(F.array(
        F.struct(F.lit("last_prediction_value").alias("metric"), F.col("v").alias("value")),
        F.struct(F.lit("drift_score").alias("metric"), F.lit(0.0).alias("value")))))


def exported_metrics(events: DataFrame) -> DataFrame:
    """Counters, histogram and gauges in one (metric, label, value) table."""
    count = counters(events).select("metric", F.col("type").alias("label"), F.col("value").cast("double"))
    histogram = latency_histogram(events)
    bucket = histogram.select(
        F.lit("request_latency_seconds_bucket").alias("metric"),
        F.concat_ws(" le=", "endpoint", "le").alias("label"),
        F.col("cumulative_count").cast("double").alias("value"))
    overall = histogram.filter(F.col("le") == "+Inf")
    total = overall.select(
        F.lit("request_latency_seconds_sum").alias("metric"), F.col("endpoint").alias("label"),
        F.col("latency_sum").alias("value"))
    number = overall.select(
        F.lit("request_latency_seconds_count").alias("metric"), F.col("endpoint").alias("label"),
        F.col("latency_count").cast("double").alias("value"))
    gauge = gauges(events).select("metric", F.lit("").alias("label"), "value")
    return count.unionByName(bucket).unionByName(total).unionByName(number).unionByName(gauge)


def last_predictions(events: DataFrame, n: int = DRIFT_WINDOW) -> DataFrame:
    """The drift window: a top-n sort, not a one-partition window."""
    predictions = events.filter(F.col("kind") == "prediction").select(*ORDER, "prediction")
    return predictions.orderBy(*[F.desc(c) for c in ORDER]).limit(n)


def feature_values(features: DataFrame, names: list[str], order: list[str]) -> DataFrame:
    """Long form (feature, value, order columns) of recorded feature values."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names
    ])).alias("p")
    return features.select(*order, pairs).select("p.feature", "p.value", *order)


def feature_windows(features: DataFrame, names: list[str], order: list[str], n: int = DRIFT_WINDOW) -> DataFrame:
    """Last ``n`` recorded values of every feature."""
    recorded = feature_values(features, names, order).filter(F.col("value").isNotNull())
    return last_rows(recorded, ["feature"], order, n)


def reference_stats(predictions: DataFrame, column: str = "prediction") -> DataFrame:
    """One row: mean, population deviation, range and count of the reference."""
    return predictions.agg(
        F.avg(column).alias("pred_mean"), F.stddev_pop(column).alias("pred_std"),
        F.min(column).alias("pred_min"), F.max(column).alias("pred_max"), F.count(column).alias("pred_count"))


def feature_reference_stats(features: DataFrame, names: list[str]) -> DataFrame:
    """(feature, feature_mean, feature_std): one pass, one row per feature."""
    figures = features.agg(*[F.avg(c).alias(f"{c}__m") for c in names],
                           *[F.stddev_pop(c).alias(f"{c}__s") for c in names])
    return figures.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"{c}__m").alias("feature_mean"),
                 F.col(f"{c}__s").alias("feature_std")) for c in names])))


def bin_of(value: Column, mean: Column, std: Column) -> Column:
    """Bin 0..9 over mean ± 3 std; the last bin is closed, values outside get NULL."""
    low, high = mean - BIN_RANGE * std, mean + BIN_RANGE * std
    width = (high - low) / BINS
    return F.when(value == high, BINS - 1).when(
        (value >= low) & (value < high) & (width > 0),
        F.least(F.floor((value - low) / width).cast("int"), F.lit(BINS - 1)))


def window_figures(current: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: mean, std, n, the counts of the ten bins, and the reference row as ``ref``.

    ``current`` is the drift window, ``reference`` the one row of ``reference_stats``,
    read as a scalar subquery. Moments and bin counts share one pass.
    """
    ref = reference.select(F.struct("pred_mean", "pred_std", "pred_count").alias("r")).scalar()
    placed = current.withColumn("ref", ref).withColumn(
        "bin", bin_of(F.col("prediction"), F.col("ref.pred_mean"), F.col("ref.pred_std")))
    return placed.agg(
        F.avg("prediction").alias("mean"), F.stddev_pop("prediction").alias("std"), F.count("*").alias("n"),
        F.array(*[F.count_if(F.col("bin") == i) for i in range(BINS)]).alias("counts"),
    ).withColumn("ref", ref)


def _shares() -> Column:
    """Bins of the reference matched with the window's: an absent bin counts 0.

    Values outside all bins count in the denominator only.
    """
    reference = F.array(*[F.lit(float(s)) for s in NORMAL_SHARES])
    return F.transform(F.col("counts"), lambda count, i: F.struct(
        i.alias("bin_id"),
        S.clip(F.get(reference, i), SHARE_FLOOR, 1.0).alias("reference_share"),
        S.clip(count / (F.col("n") + F.lit(1e-10)), SHARE_FLOOR, 1.0).alias("current_share")))


def drift_histogram(current: DataFrame, reference: DataFrame) -> DataFrame:
    """Ten rows: reference share and current share of every bin."""
    return window_figures(current, reference).select(F.inline(_shares()))


def _index(shares: Column) -> Column:
    parts = F.transform(shares, lambda s: (s["current_share"] - s["reference_share"])
                        * F.log(s["current_share"] / s["reference_share"]))
    return F.greatest(F.aggregate(parts, F.lit(0.0), lambda total, x: total + x), F.lit(0.0))


def psi(current: DataFrame, reference: DataFrame) -> DataFrame:
    """One row: population stability index, never below 0."""
    return window_figures(current, reference).select(_index(_shares()).alias("psi"))


def drift_status(figures: DataFrame, threshold: float = DRIFT_THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """Status of every row of ``figures``: mean, std, n and bin counts of a window, and the reference as ``ref``."""
    deviation = F.col("ref.pred_std") + 1e-10
    figures = figures.withColumns({
        "psi_raw": _index(_shares()),
        "mean_drift": F.abs(F.col("mean") - F.col("ref.pred_mean")) / deviation,
        "std_drift": F.abs(F.col("std") - F.col("ref.pred_std")) / deviation})
    known = F.coalesce(F.col("ref.pred_count"), F.lit(0)) > 0
    ready = known & (F.col("n") >= DRIFT_SAMPLES)
    moved = F.coalesce(ready & (
        (F.col("mean_drift") > threshold) | (F.col("std_drift") > threshold) | (F.col("psi_raw") > PSI_LIMIT)
    ), F.lit(False))

    def shown(value: Column, places: int) -> Column:
        return F.when(ready, F.round(value, places))

    return figures.select(
        *(keep or []), F.when(~known, "no_reference").when(~ready, "insufficient_data")
        .when(moved, "drift_detected").otherwise("ok").alias("status"),
        moved.alias("drift_detected"),
        shown(F.col("mean_drift"), 4).alias("mean_drift"), shown(F.col("std_drift"), 4).alias("std_drift"),
        shown(F.col("psi_raw"), 4).alias("psi"), shown(F.col("mean"), 2).alias("current_mean"),
        shown(F.col("ref.pred_mean"), 2).alias("reference_mean"), F.col("n").alias("samples_analyzed"))


def check_drift(current: DataFrame, reference: DataFrame, threshold: float = DRIFT_THRESHOLD) -> DataFrame:
    """One status row from the drift window and the reference statistics row."""
    return drift_status(window_figures(current, reference), threshold)


def rolling_drift(events: DataFrame, reference: DataFrame, n: int = DRIFT_WINDOW, threshold: float = DRIFT_THRESHOLD,
                  block: int | None = None) -> DataFrame:
    """Drift status at every prediction, over it and the ``n - 1`` before: what ``check_drift`` said at that moment.

    Moments are taken around the reference mean, so that the difference of running sums keeps its digits.
    """
    ref = reference.select(F.struct("pred_mean", "pred_std", "pred_count").alias("r")).scalar()
    predictions = events.filter(F.col("kind") == "prediction").select(*ORDER, "prediction").withColumn("ref", ref)
    middle = F.coalesce(F.col("ref.pred_mean"), F.lit(0.0))
    away = F.col("prediction") - middle
    bin = bin_of(F.col("prediction"), F.col("ref.pred_mean"), F.col("ref.pred_std"))
    sums = {"total": away, "squares": away * away, "there": F.col("prediction").isNotNull().cast("long"),
            **{f"bin_{i}": (bin == i).cast("long") for i in range(BINS)}}
    rows = rolling_sums(predictions.withColumn("all", F.lit(0)), ["all"], ORDER, sums, n, "rolling-drift", block)
    mean = F.try_divide(F.col("total"), F.col("there"))
    spread = F.try_divide(F.col("squares"), F.col("there")) - mean * mean
    figures = rows.select(
        *ORDER, "prediction", "ref", (mean + middle).alias("mean"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("std"), F.col("rows_in").alias("n"),
        F.array(*[F.col(f"bin_{i}") for i in range(BINS)]).alias("counts"))
    return drift_status(figures, threshold, [*ORDER, "prediction"])


def drift_history(status: DataFrame, now: Column) -> DataFrame:
    """Rows to append to the drift history: detected ones only."""
    return status.filter("drift_detected").withColumn("timestamp", now)


def retrain_decision(events: DataFrame, drift: DataFrame, last_retrain: Column, now: Column) -> DataFrame:
    """One row: whether to retrain and why."""
    status = drift.select(F.struct("status", "drift_detected", "mean_drift").alias("d")).scalar()
    row = error_rate(events).withColumns({"drift": status, "last_retrain": last_retrain})
    days = S.days_between(F.col("last_retrain"), now)
    reasons = F.array_compact(F.array(
        F.when(F.col("drift.drift_detected"), F.concat(
            F.lit("Drift detected: mean_drift="),
            S.fixed_decimals(F.coalesce(F.col("drift.mean_drift"), F.lit(0.0)), 4))),
        F.when(F.col("high_error_rate"), F.concat(
            F.lit("High error rate: "), S.fixed_decimals(F.col("error_rate") * 100, 2), F.lit("%"))),
        F.when(days > RETRAIN_DAYS, F.concat(
            F.lit("Time since last retrain: "), days.cast("string"), F.lit(" days")))))
    return row.select(
        (F.size(reasons) > 0).alias("should_retrain"), reasons.alias("reasons"),
        F.col("drift.status").alias("drift_status"), "last_retrain")


def health(events: DataFrame, drift: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """One row: healthy, degraded or unhealthy, with the figures behind it."""
    latencies = latencies if latencies is not None else latency_stats(events)
    p95 = latencies.filter(F.col("endpoint") == "all").select("p95").scalar()
    status = drift.select(F.struct("status", "drift_detected").alias("d")).scalar()
    row = totals(events).withColumns({"latency_p95": p95, "drift": status})
    bad = F.col("drift.drift_detected") | (F.col("total_errors") > UNHEALTHY_ERRORS) | (
        F.col("latency_p95") > UNHEALTHY_P95)
    worn = (F.col("total_errors") > DEGRADED_ERRORS) | (F.col("latency_p95") > DEGRADED_P95)
    return row.select(
        F.when(bad, "unhealthy").when(worn, "degraded").otherwise("healthy").alias("status"),
        F.col("drift.status").alias("drift_status"), F.col("total_errors").alias("error_count"),
        "latency_p95", "total_predictions", "total_queries")


def summary(events: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """One row: totals, latency structs and the last errors, oldest first."""
    latencies = latencies if latencies is not None else latency_stats(events)

    def latency(name: str) -> Column:
        return latencies.filter(F.col("endpoint") == name).select(
            F.struct("avg", "p50", "p95", "p99", "count").alias("s")).scalar()

    errors = recent_errors(events).agg(F.array_sort(
        F.collect_list(F.struct("ts", "event_id", "error_type", "message"))).alias("e")).scalar()
    return totals(events).withColumns({
        "prediction_latency": latency("predict"), "query_latency": latency("query"),
        "recent_errors": errors})


def full_report(events: DataFrame, reference: DataFrame, last_retrain: Column, now: Column) -> DataFrame:
    """One nested row: health, metrics, drift and retrain status.

    The figures shared by the four parts (three latency rows, one reference row,
    one drift row) are computed once, up front.
    """
    latencies = local_copy(latency_stats(events), 3)
    window = local_copy(last_predictions(events), DRIFT_WINDOW)
    drift = local_copy(check_drift(window, local_copy(reference, 1)), 1)

    def nested(part: DataFrame) -> Column:
        return part.select(F.struct(*part.columns).alias("s")).scalar()

    return summary(events, latencies).select(F.struct("*").alias("metrics")).select(
        nested(health(events, drift, latencies)).alias("health"), "metrics", nested(drift).alias("drift"),
        nested(retrain_decision(events, drift, last_retrain, now)).alias("retrain_status"),
        now.alias("exported_at"))


def component_health(tables: dict[str, DataFrame | None]) -> DataFrame:
    """One row: per component healthy or unavailable, and healthy only when all are.

    A component is there when its table has a row; one row is looked at.
    """
    spark = next(t for t in tables.values() if t is not None).sparkSession
    row = spark.range(1)
    for name, table in tables.items():
        there = F.lit(False)
        if table is not None:
            there = table.limit(1).agg((F.count("*") > 0).alias("there")).scalar()
        row = row.withColumn(name, F.when(there, "healthy").otherwise("unavailable"))
    parts = F.array(*[F.col(n) for n in tables])
    good = F.forall(parts, lambda state: state == "healthy")
    return row.select(F.when(good, "healthy").otherwise("degraded").alias("status"), *tables)
