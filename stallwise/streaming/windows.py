"""Counts by event-time window with a watermark: windows close, late records become corrections.

The state holds the records of open windows only. When the watermark passes the end
of a window its figures go out once and its state is dropped. A record that comes
later is not lost: it goes to a table of late records, and ``counts`` adds those
that are not in the closed window already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stallwise.operators import monitoring as M
from stallwise.streaming.metrics import _edge
from stallwise.streaming.state import start_batches

#: Parts of one (kind, window), so that a kind with most records is no single key.
SALTS = 16
#: State keys that the parts are dealt to: a key costs some calls a batch, so there is no key for each part.
BUCKETS = 256
#: Records of one entry of the state.
CHUNK_ROWS = 10_000
WINDOW = ["kind", "minute_ms", "salt"]
CHANGE = "status string, kind string, minute_ms long, salt int, ids array<long>, latencies array<double>"
CHUNK = ("kind array<string>, minute_ms array<long>, salt array<int>, named array<boolean>, event_id array<long>, "
         "latency array<double>")
RECORD = {"kind": object, "minute_ms": "int64", "salt": "int32", "named": bool, "event_id": "int64", "latency": "float64"}


class _OpenWindows(StatefulProcessor):
    """Records of one bucket's windows, each window until the watermark passes its end.

    One timer a bucket, at the end of the earliest window it holds.
    """

    def __init__(self, length_ms: int):
        self.length_ms = length_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getListState("chunks", CHUNK)

    def _held(self) -> pd.DataFrame:
        chunks = [dict(zip(RECORD, chunk)) for chunk in self.chunks.get()]
        return pd.DataFrame({
            name: pd.Series(np.concatenate([np.array(c[name], kind) for c in chunks]) if chunks else [], dtype=kind)
            for name, kind in RECORD.items()})

    def _append(self, rows: pd.DataFrame) -> None:
        for at in range(0, len(rows), CHUNK_ROWS):
            part = rows.iloc[at:at + CHUNK_ROWS]
            self.chunks.appendValue(tuple(part[name].tolist() for name in RECORD))

    def _changes(self, status: str, rows: pd.DataFrame) -> pd.DataFrame:
        """One row per window of ``rows``."""
        rows = rows.sort_values(WINDOW, kind="stable")
        new = (rows[WINDOW] != rows[WINDOW].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(new)
        spans = list(zip(starts.tolist(), [*starts[1:].tolist(), len(rows)]))
        ids = rows["event_id"].astype(object).where(rows["named"], None).tolist()
        latencies = rows["latency"].astype(object).where(rows["latency"].notna(), None).tolist()
        return pd.DataFrame({
            "status": status, **{name: rows[name].to_numpy()[starts] for name in WINDOW},
            "ids": [ids[a:b] for a, b in spans], "latencies": [latencies[a:b] for a, b in spans]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        new = pd.concat([frame[list(RECORD)] for frame in rows], ignore_index=True).astype(RECORD)
        both = pd.concat([held, new], ignore_index=True)
        again = both["named"] & both.duplicated([*WINDOW, "named", "event_id"])
        new = both[len(held):][~again[len(held):]]
        if new.empty:
            return
        late = new["minute_ms"] + self.length_ms <= timerValues.getCurrentWatermarkInMs()
        if late.any() and len(held):  # a window that is held takes records until its timer
            late &= ~pd.MultiIndex.from_frame(new[WINDOW]).isin(pd.MultiIndex.from_frame(held[WINDOW].drop_duplicates()))
        kept = new[~late]
        if len(kept):
            first, before = int(kept["minute_ms"].min()), int(held["minute_ms"].min()) if len(held) else None
            if before is None or first < before:
                if before is not None:
                    self.handle.deleteTimer(before + self.length_ms)
                self.handle.registerTimer(first + self.length_ms)
            self._append(kept)
        if late.any():
            yield self._changes("late", new[late])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = held["minute_ms"] + self.length_ms <= passed
        rest = held[~over]
        self.chunks.clear()
        if len(rest):
            self._append(rest)
            self.handle.registerTimer(int(rest["minute_ms"].min()) + self.length_ms)
        if over.any():
            yield self._changes("closed", held[over])

    def close(self) -> None:
        pass


def window_changes(events: DataFrame, lateness: str, seconds: int = 60, salts: int = SALTS, buckets: int = BUCKETS
                   ) -> DataFrame:
    """Closed windows and late records of a stream of ``event_id, ts, kind, latency``.

    The time column stays behind at the watermark: Spark drops late rows before a stateful operator that sees it,
    and here the state decides. A record counts once per id while its window is open; records without an id count
    each time, those without a time not at all.
    """
    place = F.floor(F.unix_seconds("ts") / seconds) * (seconds * 1000)
    timed = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "kind", "latency").where(
        "ts IS NOT NULL").withWatermark("ts", lateness)
    keyed = timed.select(
        F.coalesce("kind", F.lit("")).alias("kind"), place.cast("long").alias("minute_ms"),
        F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int").alias("salt"),
        F.col("event_id").isNotNull().alias("named"), F.coalesce("event_id", F.lit(0)).cast("long").alias("event_id"),
        F.col("latency").cast("double").alias("latency"))
    bucket = F.pmod(F.xxhash64("minute_ms", "salt"), F.lit(buckets)).cast("int")
    return keyed.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        _OpenWindows(seconds * 1000), CHANGE, "Update", "EventTime")


def _figures(latencies: Column) -> list[Column]:
    """Number, sum and cumulative buckets of an array of latencies."""
    there = F.filter(latencies, lambda x: x.isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)

    def up_to(edge: float) -> Column:
        return F.size(F.filter(there, lambda x: x <= edge)).cast("long")

    return [F.size(latencies).cast("long").alias("records"), F.when(F.size(there) > 0, total).alias("latency_sum"),
            *[up_to(e).alias(_edge(e)) for e in M.LATENCY_EDGES]]


def close_windows(events: DataFrame, path: str, checkpoint: str, lateness: str = "10 minutes", seconds: int = 60,
                  salts: int = SALTS, buckets: int = BUCKETS):
    """Run the stream; each batch overwrites its own folder, so a repeated batch changes nothing."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select("status", "kind", F.timestamp_millis("minute_ms").alias("minute"), "ids", "latencies",
                     *_figures(F.col("latencies"))).write.mode("overwrite").partitionBy("status").parquet(
            f"{path}/batch={batch_id}")

    return start_batches(window_changes(events, lateness, seconds, salts, buckets), keep, checkpoint)


def _stored(spark, path: str) -> DataFrame:
    edges = ", ".join(f"{_edge(e)} long" for e in M.LATENCY_EDGES)
    return spark.read.schema(
        "kind string, minute timestamp, ids array<long>, latencies array<double>, records long, latency_sum double, "
        f"{edges}, batch int, status string").parquet(path)


def late_records(spark, path: str) -> DataFrame:
    """Records that came after their window had closed and are not in it: one row per record."""
    rows = _stored(spark, path)
    pairs = F.explode(F.arrays_zip("ids", "latencies")).alias("p")
    late = rows.where("status = 'late'").select("kind", "minute", pairs).select(
        "kind", "minute", F.col("p.ids").alias("event_id"), F.col("p.latencies").alias("latency"))
    nameless = late.where("event_id IS NULL")
    once = late.where("event_id IS NOT NULL").groupBy("kind", "minute", "event_id").agg(F.first("latency").alias("latency"))
    # only windows that have late records give their ids
    windows = once.select("kind", "minute").distinct()
    counted = rows.where("status = 'closed'").select("kind", "minute", "ids").join(windows, ["kind", "minute"], "left_semi")
    ids = counted.select("kind", "minute", F.explode("ids").alias("event_id"))
    return once.join(ids, ["kind", "minute", "event_id"], "left_anti").unionByName(nameless)


def counts(spark, path: str) -> DataFrame:
    """Figures of every closed window, late records added: one row per minute and kind."""
    edges = [_edge(e) for e in M.LATENCY_EDGES]
    figures = ["records", "latency_sum", *edges]
    closed = _stored(spark, path).where("status = 'closed'").select("minute", "kind", *figures)
    late = late_records(spark, path).select(
        "minute", "kind", F.lit(1).cast("long").alias("records"), F.col("latency").alias("latency_sum"),
        *[F.coalesce((F.col("latency") <= e).cast("long"), F.lit(0)).alias(_edge(e)) for e in M.LATENCY_EDGES])
    return closed.unionByName(late).groupBy("minute", "kind").agg(*[F.sum(c).alias(c) for c in figures])
