"""Starting streams whose state has timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """State with timers needs this store. A stream keeps the settings of the moment it starts, so others keep theirs."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def start_batches(rows: DataFrame, keep: Callable[[DataFrame, int], None], checkpoint: str):
    """Run a stream of state changes over all there is, ``keep`` for each batch."""
    with rocks_state(rows.sparkSession):
        return (
            rows.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
