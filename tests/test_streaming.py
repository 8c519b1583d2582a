"""Every stream ends at the same result as the batch form."""

import datetime as dt

from pyspark.sql import functions as F

from stallwise.operators import conversations as C, monitoring as M
from stallwise.schemas import MESSAGE
from stallwise.sources import stores
from stallwise.streaming import metrics as SM, sessions as SS


def files(spark, table, path, column="part"):
    """One file per value of a column, read back one file per micro-batch."""
    for part in sorted(r[0] for r in table.select(column).distinct().collect()):
        table.filter(F.col(column) == part).drop(column).coalesce(1).write.mode("append").parquet(path)
    schema = table.drop(column).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def messages(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if i % 3 else f"s{i % 9}", "user" if i % 2 else "assistant", f"m{i}", start + dt.timedelta(seconds=(i * 37) % 4000))
            for i in range(600)]
    return spark.createDataFrame(rows, MESSAGE)


def test_sessions(spark, tmp_path):
    table = messages(spark)
    stream = files(spark, table.withColumn("part", F.col("id") % 3), str(tmp_path / "in"))
    SS.roll_up(stream, str(tmp_path / "rollup"), str(tmp_path / "c1")).awaitTermination()
    got = SS.latest(spark, str(tmp_path / "rollup"), ["session_id"])
    assert sorted(got.collect()) == sorted(C.sessions(table).collect())

    SS.keep_last_messages(stream, str(tmp_path / "ring"), str(tmp_path / "c2")).awaitTermination()
    ring = SS.current_rings(spark, str(tmp_path / "ring"))
    want = {(r["session_id"], r["id"]) for r in C.retained(table).collect()}
    assert {(r["session_id"], r["id"]) for r in ring.collect()} == want and ring.count() == len(want)
    assert [r["place"] for r in ring.filter("session_id = 'hot'").orderBy("place").collect()] == list(range(1, 21))

    SS.append_log(stream, str(tmp_path / "log"), str(tmp_path / "c3")).awaitTermination()
    assert sorted(stores.read_messages(spark, str(tmp_path / "log")).collect()) == sorted(table.collect())
    # A second run over the same checkpoint adds nothing.
    SS.append_log(stream, str(tmp_path / "log"), str(tmp_path / "c3")).awaitTermination()
    assert stores.read_messages(spark, str(tmp_path / "log")).count() == 600


def test_metrics(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(seconds=i), "prediction" if i % 2 else "query", float(i % 60), (i % 50) / 20) for i in range(3000)]
    table = M.records(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, kind string, prediction double, latency double"))
    stream = files(spark, table.withColumn("part", F.expr("event_id div 1000")), str(tmp_path / "in"))
    mixed = files(spark, table.withColumn("part", F.expr("event_id * 7 % 3")), str(tmp_path / "mixed"))
    SM.keep_counts(mixed, str(tmp_path / "counts"), str(tmp_path / "c1")).awaitTermination()
    SM.keep_counts(mixed, str(tmp_path / "counts"), str(tmp_path / "c1")).awaitTermination()  # nothing is added again
    got = SM.merged_counts(spark, str(tmp_path / "counts"))
    assert got.agg(F.sum("records")).first()[0] == 3000  # whatever the order in which they come
    want = table.groupBy(F.date_trunc("minute", "ts").alias("minute"), "kind").agg(
        F.count("*").alias("records"), F.count_if(F.col("latency") <= 0.5).alias("le"))
    assert sorted((str(r["minute"]), r["kind"], r["records"], r["le_0_5"]) for r in got.collect()) == sorted(
        (str(r["minute"]), r["kind"], r["records"], r["le"]) for r in want.collect())

    reference = M.reference_stats(table)
    SM.watch_drift(stream, reference, str(tmp_path / "drift"), str(tmp_path / "c2")).awaitTermination()
    batch = M.check_drift(M.last_predictions(table), reference)
    assert SM.latest_status(spark, str(tmp_path / "drift")).collect() == batch.collect()
