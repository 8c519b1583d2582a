"""Streams whose state ends: closed windows, late records, expired sessions, compacted changes."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from stallwise.operators import conversations as C, monitoring as M
from stallwise.schemas import MESSAGE
from stallwise.sources.changes import ChangeTable
from stallwise.streaming import live as LS, windows as W
from stallwise.streaming.metrics import counts_by_minute

START = dt.datetime(2024, 1, 1)
EVENT = "event_id long, ts timestamp_ntz, kind string, latency double"


def arrive(spark, path, parts, schema):
    """Each part is a file of its own, read in that order, one per micro-batch."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        newest = max((os.path.join(path, f) for f in os.listdir(path) if f.startswith("part-")), key=os.path.getmtime)
        os.utime(newest, (1_700_000_000 + 10 * i + len(os.listdir(path)),) * 2)
    from pyspark.sql.types import _parse_datatype_string
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)


def test_windows_close_and_late_records_correct_them(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, START + dt.timedelta(seconds=i), "prediction" if i % 3 else "query",
             None if i % 50 == 0 else (i % 40) / 20) for i in range(1500)]
    late = rng.sample(rows[:600], 40)
    order = [r for r in rows if r not in late]
    parts = [order[:500], order[500:1000] + order[100:150],            # repeats of open and of closed windows
             order[1000:], late + late[:10] + order[:30],               # late ones, twice, and repeats of counted ones
             [(None, START, "query", 0.5)] * 2, [(9999, START + dt.timedelta(hours=1), "query", 0.1)]]
    events = arrive(spark, str(tmp_path / "in"), parts, EVENT)
    query = W.close_windows(events, str(tmp_path / "out"), str(tmp_path / "c"), lateness="2 minutes", salts=3)
    query.awaitTermination()
    W.close_windows(events, str(tmp_path / "out"), str(tmp_path / "c"), lateness="2 minutes", salts=3).awaitTermination()
    whole = spark.createDataFrame([*rows, (None, START, "query", 0.5), (None, START, "query", 0.5)], EVENT)
    want = counts_by_minute(whole)
    found = W.counts(spark, str(tmp_path / "out")).select(*want.columns)

    def plain(frame):
        return sorted((str(r["minute"]), r["kind"], r["records"], round(r["latency_sum"] or 0, 6), r["le_0_5"], r["le_1_0"])
                      for r in frame.collect())

    assert plain(found) == plain(want)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) > 20 and held[-1] <= 2  # the window of the last event alone is open
    assert W.late_records(spark, str(tmp_path / "out")).where("event_id IS NOT NULL").count() == 40


def test_state_keys_do_not_grow_with_the_windows(spark, tmp_path):
    rows = [(i if i % 7 else None, START + dt.timedelta(seconds=9 * i), None if i % 5 == 0 else "query",
             None if i % 4 == 0 else i / 1000) for i in range(1, 2001)]    # 300 minutes
    parts = [rows[::2], [r for r in rows[1::2] if r[0]] + rows[:10], [(5000, START + dt.timedelta(days=1), "query", 0.1)]]
    events = arrive(spark, str(tmp_path / "in"), parts, EVENT)
    query = W.close_windows(events, str(tmp_path / "out"), str(tmp_path / "c"), lateness="1 hour", buckets=4)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) <= 4 * 3  # some chunks and a timer for each bucket
    seen, want = set(), {}
    for i, at, kind, latency in (r for part in parts[:2] for r in part):
        if i is None or i not in seen:
            seen.add(i)
            key = (str(at.replace(second=0)), kind or "")
            n, total = want.get(key, (0, 0.0))
            want[key] = n + 1, round(total + (latency or 0), 6)
    found = {(str(r["minute"]), r["kind"]): (r["records"], round(r["latency_sum"] or 0, 6))
             for r in W.counts(spark, str(tmp_path / "out")).collect()}
    assert found == want


def messages(n, sessions, start=START, step=60):
    return [(i, f"s{i % sessions}", "user" if i % 2 else "assistant", f"m{i}", start + dt.timedelta(seconds=i * step))
            for i in range(n)]


def test_sessions_end_and_restart(spark, tmp_path):
    old = messages(60, 5)
    hot = [(1000 + i, "hot", "user", f"h{i}", START + dt.timedelta(days=20, seconds=i)) for i in range(300)]
    new = [(5000 + i, f"n{i % 4}", "user", f"n{i}", START + dt.timedelta(days=40, seconds=i)) for i in range(50)]
    back = [(9000, "s1", "user", "again", START + dt.timedelta(days=41))]
    path, check, source = (str(tmp_path / x) for x in ("t", "c", "in"))
    stream = arrive(spark, source, [old, hot[:200]], MESSAGE)
    LS.keep_sessions(stream, path, check, max_history=3, merge_every=2, buckets=4).awaitTermination()
    table = spark.createDataFrame(old + hot[:200], MESSAGE)
    columns = ["session_id", "created_at", "last_activity", "message_count"]
    assert sorted(LS.session_rows(spark, path).select(*columns).collect()) == sorted(C.sessions(table).select(*columns).collect())
    # again from the checkpoint, with what has come since: late messages, then sessions a month later
    stream = arrive(spark, source, [hot[200:] + [(7000, "s2", "user", "late", START - dt.timedelta(days=1))], new, back], MESSAGE)
    query = LS.keep_sessions(stream, path, check, max_history=3, merge_every=2, buckets=4)
    query.awaitTermination()
    now = START + dt.timedelta(days=41) - dt.timedelta(hours=1)
    log = spark.createDataFrame(old + hot + new, MESSAGE)
    log = log.unionByName(spark.createDataFrame([(7000, "s2", "user", "late", START - dt.timedelta(days=1))], MESSAGE))
    kept = C.apply_retention(log, F.lit(now).cast("timestamp_ntz"))[0].unionByName(spark.createDataFrame(back, MESSAGE))
    assert sorted(LS.session_rows(spark, path).select(*columns).collect()) == sorted(C.sessions(kept).select(*columns).collect())
    rings = {(r["session_id"], r["id"]) for r in LS.session_rings(spark, path).collect()}
    assert rings == {(r["session_id"], r["id"]) for r in C.retained(kept, 3).collect()}
    last = query.recentProgress[-1]["stateOperators"][0]
    alive = C.sessions(kept).count()
    # a value, the list of messages and a timer with its index for each live session, nothing of the others
    assert alive == 6 and last["numRowsTotal"] <= alive * (1 + 6 + 2)


STATES = "key long, value string, n long"


def test_changes_over_many_batches(spark, tmp_path):
    table = ChangeTable(spark, str(tmp_path / "t"), ["key"], STATES, buckets=4)
    assert table.read().count() == 0 and table.merge() == 0
    rng, now, files = random.Random(4), {}, []
    for batch in range(24):
        keys = rng.sample(range(40), 6)
        rows = [(k, f"v{batch}", batch, rng.random() < 0.2) for k in keys]
        table.write(spark.createDataFrame(rows, STATES + ", gone boolean"), batch)
        for k, v, n, gone in rows:
            now.pop(k, None) if gone else now.__setitem__(k, (k, v, n))
        if batch % 6 == 5:
            before = sorted(map(tuple, table.read().collect()))
            assert before == sorted(now.values())
            table.merge()
            assert sorted(map(tuple, table.read().collect())) == before
            files.append(len(table.read().inputFiles()))
        if batch == 13:  # written again after a merge: nothing changes
            table.write(spark.createDataFrame(rows, STATES + ", gone boolean"), batch)
    assert sorted(map(tuple, table.read().collect())) == sorted(now.values())
    assert table.version() == 4 and max(files) <= 4  # a read takes one file a bucket, not all that were written


def test_a_merge_that_stops_leaves_the_table(spark, tmp_path, monkeypatch):
    table = ChangeTable(spark, str(tmp_path / "t"), ["key"], STATES, buckets=4)
    rows = spark.createDataFrame([(k, "a", 1) for k in range(20)], STATES)
    table.write(rows, 0)
    table.merge()
    table.write(spark.createDataFrame([(3, "b", 2)], STATES), 1)
    whole = sorted(map(tuple, table.read().collect()))

    class Stop(Exception):
        pass

    def stop(*_, **__):
        raise Stop

    with monkeypatch.context() as patch:  # the snapshot is written, the manifest is not
        patch.setattr(type(spark), "createDataFrame", lambda self, rows, *a, _f=type(spark).createDataFrame, **k: (
            stop() if rows and len(rows[0]) == 3 and isinstance(rows[0][2], str) and "snapshot" in rows[0][2]
            else _f(self, rows, *a, **k)))
        with pytest.raises(Stop):
            table.merge()
    assert table.version() == 1 and sorted(map(tuple, table.read().collect())) == whole
    table.merge()
    assert table.version() == 2 and sorted(map(tuple, table.read().collect())) == whole
    # three of four buckets are linked, not written again
    folders = {r["folder"] for r in spark.read.json(str(tmp_path / "t" / "manifest" / "version=2")).collect()}
    assert len(folders) == 2
