"""First row of each key over batches that arrive one after another, in whatever order their rows are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stallwise.operators.ordered import first_rows
from stallwise.session import materialise
from stallwise.sources.changes import ChangeTable


class FirstSeen:
    """Keeps the row of each key that is least by ``order``; a null key is a key.

    Any split of a table into batches gives the rows that the whole table gives. A batch is reduced to one row per key
    before it meets the store, and only rows that come before the stored one are written. Batch numbers grow; a batch
    given again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, schema: str | T.StructType,
                 buckets: int = 16):
        self.keys, self.order = keys, order
        self.table = ChangeTable(spark, path, keys, schema, buckets)

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows of the batch that are first so far, now stored."""
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.table.schema.fields]
        firsts = first_rows(rows.select(*columns), self.keys, [F.col(self.order)], 1, "_place").drop("_place")
        known = self.table.read(through=batch - 1).select(
            *[F.col(k).alias(f"_{i}") for i, k in enumerate(self.keys)], F.col(self.order).alias("_before"),
            F.lit(True).alias("_known"))
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{i}")) for i, k in enumerate(self.keys)])
        news = firsts.join(known, same, "left").where(F.col("_known").isNull() | (F.col(self.order) < F.col("_before")))
        found = materialise(news.select(*self.table.schema.names), "first-seen")
        self.table.write(found, batch)
        return found

    def read(self) -> DataFrame:
        return self.table.read()


def keep_first(rows: DataFrame, store: FirstSeen, checkpoint: str, merge_every: int = 10):
    """Stream into the store; what has been stored is merged after every ``merge_every`` batches."""
    def keep(batch: DataFrame, number: int) -> None:
        store.add(batch, number)
        if (number + 1) % merge_every == 0:
            store.table.merge()

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
