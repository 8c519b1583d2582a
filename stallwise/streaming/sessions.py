"""Message streams: log, session roll-up, last messages of a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stallwise.operators import conversations as C

RING_COLUMNS = ["ts", "id", "role", "content"]


def append_log(messages: DataFrame, path: str, checkpoint: str):
    """Stream to Parquet files; the checkpoint makes each message land once."""
    return (
        messages.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def roll_up(messages: DataFrame, path: str, checkpoint: str):
    """Session roll-up as changed rows per micro-batch.

    Each batch overwrites its own folder, so a repeated batch changes nothing.
    """
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        C.sessions(messages).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest(spark, path: str, keys: list[str]) -> DataFrame:
    """Newest state of every key out of the folders of ``roll_up`` and its like."""
    rows = spark.read.parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("s")).select(*keys, "s.*")


def last_messages(messages: DataFrame, max_history: int = C.MAX_HISTORY) -> DataFrame:
    """Last ``2 * max_history`` messages of every session with new ones, per micro-batch.

    Rows: session, place (1 = oldest kept) and the message; ``version`` grows with
    every change of the session. Arrow batches are cut to the limit per session
    before the shuffle, so a very busy session sends few rows to its state.
    """
    limit = 2 * max_history

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.sort_values(["ts", "id"]).groupby("session_id", sort=False).tail(limit)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, *columns = state.get if state.exists else (0, [], [], [], [])
        ring = pd.DataFrame(dict(zip(RING_COLUMNS, columns)))
        for batch in batches:
            parts = [p for p in (ring, batch[RING_COLUMNS].assign(ts=batch["ts"].astype("int64"))) if len(p)]
            ring = pd.concat(parts).sort_values(["ts", "id"]).tail(limit)
        version += 1
        state.update((version, *[ring[c].tolist() for c in RING_COLUMNS]))
        yield pd.DataFrame({
            "session_id": key[0], "version": version, "place": range(1, len(ring) + 1),
            "id": ring["id"].to_numpy(), "role": ring["role"].to_numpy(), "content": ring["content"].to_numpy()})

    columns = messages.select("session_id", "id", "role", "content", F.col("ts"))
    micro = columns.withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))
    return (
        micro.mapInPandas(cut, micro.schema).groupBy("session_id").applyInPandasWithState(
            keep, "session_id string, version long, place int, id long, role string, content string",
            "version long, ts array<long>, id array<long>, role array<string>, content array<string>",
            "update", GroupStateTimeout.NoTimeout)
    )


def keep_last_messages(messages: DataFrame, path: str, checkpoint: str, max_history: int = C.MAX_HISTORY):
    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        last_messages(messages, max_history).writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def current_rings(spark, path: str) -> DataFrame:
    """Newest version of every session's kept messages."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("session_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["session_id", "version"]).drop("batch", "version")
