"""Sessions in state until they expire: roll-up and last messages, changed rows in a compacted table.

A session's state ends when the watermark is ``days`` past its last message, as the
retention rule has it. What a batch changed goes to a ``ChangeTable``; expired
sessions leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stallwise.operators import conversations as C
from stallwise.sources.changes import ChangeTable
from stallwise.streaming.state import start_batches

DAY_MS = 24 * 60 * 60 * 1000
MESSAGE = "ts: bigint, id: bigint, role: string, content: string"
STATE = f"session_id string, created_us long, last_us long, message_count long, messages array<struct<{MESSAGE}>>"
#: Columns of the table: times as such, the last messages oldest first.
ROW = ("session_id string, created_at timestamp_ntz, last_activity timestamp_ntz, message_count long, "
       "messages array<struct<ts: timestamp_ntz, id: bigint, role: string, content: string>>")


def _cut(limit: int):
    """One row per session and Arrow batch: count, first and last time, and the last ``limit`` messages.

    A session with most of the messages sends a row per batch to its state, not a row per message.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for session, own in batch.groupby("session_id", sort=False):
                own = own.sort_values(["us", "id"])
                last = own.tail(limit)
                rows.append((session, int(own["us"].iloc[0]), int(own["us"].iloc[-1]), len(own),
                             last["us"].tolist(), last["id"].tolist(), last["role"].tolist(), last["content"].tolist()))
            yield pd.DataFrame(rows, columns=["session_id", "first_us", "last_us", "n", "us", "ids", "roles", "contents"])

    return run


CUT = ("session_id string, first_us long, last_us long, n long, us array<long>, ids array<long>, "
       "roles array<string>, contents array<string>")


class _Session(StatefulProcessor):
    """Roll-up in one value, last messages in a list, a timer for the end."""

    def __init__(self, limit: int, days: int):
        self.limit, self.days = limit, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.figures = handle.getValueState("figures", "created_us long, last_us long, n long, timer_ms long")
        self.ring = handle.getListState("ring", "us long, id long, role string, content string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.figures.exists()
        created, last, n, timer = self.figures.get() if known else (None, None, 0, None)
        messages = [tuple(m) for m in self.ring.get()] if known else []
        if known and timer <= timerValues.getCurrentWatermarkInMs():  # it ends in this batch: these begin another one
            created, last, n, messages = None, None, 0, []
        for frame in rows:
            for row in frame.itertuples(index=False):
                created = int(row.first_us) if created is None else min(created, int(row.first_us))
                last = int(row.last_us) if last is None else max(last, int(row.last_us))
                n += int(row.n)
                messages += [(int(u), int(i), r, c) for u, i, r, c in zip(row.us, row.ids, row.roles, row.contents)]
        messages = sorted(messages, key=lambda m: m[:2])[-self.limit:]
        ends = last // 1000 + self.days * DAY_MS + 1
        if ends != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(ends)
        self.figures.update((created, last, n, ends))
        self.ring.put(messages)
        yield self._row(key[0], created, last, n, messages, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        created, last, n, _ = self.figures.get()
        self.figures.clear()
        self.ring.clear()
        yield self._row(key[0], created, last, n, [], True)

    @staticmethod
    def _row(session, created, last, n, messages, gone) -> pd.DataFrame:
        return pd.DataFrame({
            "session_id": [session], "created_us": [created], "last_us": [last], "message_count": [n],
            "messages": [[{"ts": u, "id": i, "role": r, "content": c} for u, i, r, c in messages]], "gone": [gone]})

    def close(self) -> None:
        pass


def session_changes(messages: DataFrame, max_history: int = C.MAX_HISTORY, days: int = C.RETENTION_DAYS,
                    lateness: str = "1 hour") -> DataFrame:
    """Sessions with new messages, and sessions that ended, per micro-batch.

    A message counts however late it is as long as its session is in state. One that comes after its session has ended
    opens it anew, as it does in a log that the retention rule has been applied to.
    """
    limit = 2 * max_history
    timed = messages.select("session_id", "id", "role", "content", F.col("ts").cast("timestamp").alias("ts")).where(
        "session_id IS NOT NULL AND ts IS NOT NULL").withWatermark("ts", lateness)
    plain = timed.select("session_id", "id", "role", "content", F.unix_micros("ts").alias("us"))
    return plain.mapInPandas(_cut(limit), CUT).groupBy("session_id").transformWithStateInPandas(
        _Session(limit, days), STATE + ", gone boolean", "Update", "EventTime")


def live_table(spark: SparkSession, path: str, buckets: int = 16) -> ChangeTable:
    return ChangeTable(spark, path, ["session_id"], ROW, buckets)


def keep_sessions(messages: DataFrame, path: str, checkpoint: str, max_history: int = C.MAX_HISTORY,
                  days: int = C.RETENTION_DAYS, lateness: str = "1 hour", merge_every: int = 20, buckets: int = 16):
    """Run the stream into a ``ChangeTable``, merged after every ``merge_every`` batches."""
    def time(us) -> F.Column:
        return F.timestamp_micros(us).cast("timestamp_ntz")

    def keep(batch: DataFrame, batch_id: int) -> None:
        table = live_table(batch.sparkSession, path, buckets)
        table.write(latest_of_batch(batch).select(
            "session_id", time(F.col("created_us")).alias("created_at"), time(F.col("last_us")).alias("last_activity"),
            "message_count", F.transform("messages", lambda m: F.struct(
                time(m["ts"]).alias("ts"), m["id"].alias("id"), m["role"].alias("role"), m["content"].alias("content"))
            ).alias("messages"), "gone"), batch_id)
        if (batch_id + 1) % merge_every == 0:
            table.merge()

    return start_batches(session_changes(messages, max_history, days, lateness), keep, checkpoint)


def latest_of_batch(batch: DataFrame) -> DataFrame:
    """One row per session: a session that had messages and ended in the same batch has ended."""
    values = [c for c in batch.columns if c != "session_id"]
    return batch.groupBy("session_id").agg(F.max_by(F.struct(*values), F.col("gone")).alias("s")).select("session_id", "s.*")


def session_rows(spark: SparkSession, path: str) -> DataFrame:
    """Roll-up of all sessions that are live."""
    return live_table(spark, path).read().drop("messages")


def session_rings(spark: SparkSession, path: str) -> DataFrame:
    """Kept messages of all live sessions, ``place`` 1 being the oldest."""
    rows = live_table(spark, path).read().select("session_id", F.posexplode("messages").alias("p", "m"))
    return rows.select("session_id", (F.col("p") + 1).alias("place"), "m.*")
