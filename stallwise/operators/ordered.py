"""Row order inside groups that may be far too big for one task.

A plain ``Window.partitionBy(key)`` puts a whole group in one task. Here the rows
are range-partitioned on (key, order) first, which cuts a big group into
consecutive chunks; windows run per chunk, and what a chunk needs from the chunks
before it travels in a carry table of at most one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stallwise.session import materialise

CHUNK = "_chunk"


def last_rows(df: DataFrame, keys: list[str], order: list[str], n: int, rank: str = "recency") -> DataFrame:
    """The ``n`` latest rows of each group, ``rank`` 1 being the latest.

    Spark cuts every map partition to ``n`` rows per group before the shuffle
    (WindowGroupLimit, for ``n`` up to 1000), so group size does not matter.
    """
    window = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def first_rows(df: DataFrame, keys: list[str], order: list, n: int, rank: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n)


def chunk(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Write ``df`` range-partitioned on (keys, order) with its chunk number."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *keys, *order)
    return materialise(ranged.withColumn(CHUNK, F.spark_partition_id()), name)


def previous_rows(
    df: DataFrame, keys: list[str], order: list[str], payload: list[str], n: int, name: str,
    count_into: str | None = None,
) -> DataFrame:
    """Add ``prev_1`` .. ``prev_n``: structs of ``payload`` of the n rows before each row.

    ``count_into`` also adds the number of rows of the group up to each row.
    """
    chunks = chunk(df, keys, order, name)
    item = F.struct(*payload)

    # Last n rows of every (group, chunk). The rows before a chunk are the ones just
    # ahead of its first tail row in this table, which holds at most n rows per chunk.
    tails = last_rows(chunks.select(*dict.fromkeys([*keys, *order, CHUNK, *payload])),
                      [*keys, CHUNK], order, n, "_back")
    before = Window.partitionBy(*keys).orderBy(CHUNK, *order)
    at_start = F.coalesce(F.lag(CHUNK).over(before) != F.col(CHUNK), F.lit(False))
    carry = (
        tails.select(*keys, CHUNK, at_start.alias("_start"),
                     F.array(*[F.lag(item, j).over(before) for j in range(1, n + 1)]).alias("_carry"))
        .filter("_start").drop("_start")
    )

    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    # One row per chunk at most: only the first group of a chunk can have begun before it.
    # Without a hint: the rows are already partitioned by these keys for the windows.
    rows = (
        chunks.withColumn("_n", F.row_number().over(inside).cast("int"))
        .withColumns({f"_lag_{j}": F.lag(item, j).over(inside) for j in range(1, n + 1)})
        .join(carry, [*keys, CHUNK], "left")
    )
    rows = rows.withColumns({
        f"prev_{j}": F.when(F.col("_n") > j, F.col(f"_lag_{j}"))
        .otherwise(F.get("_carry", F.lit(j) - F.col("_n")))
        for j in range(1, n + 1)
    })
    if count_into:
        rows = _with_count(rows, chunks, keys, count_into)
    return rows.drop("_n", "_carry", CHUNK, *[f"_lag_{j}" for j in range(1, n + 1)])


def running_count(df: DataFrame, keys: list[str], order: list[str], into: str, name: str) -> DataFrame:
    """Add the number of rows of the group up to and including each row."""
    chunks = chunk(df, keys, order, name)
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    rows = chunks.withColumn("_n", F.row_number().over(inside))
    return _with_count(rows, chunks, keys, into).drop("_n", CHUNK)


def _with_count(rows: DataFrame, chunks: DataFrame, keys: list[str], into: str) -> DataFrame:
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        chunks.groupBy(*keys, CHUNK).agg(F.count("*").alias("_rows"))
        .select(*keys, CHUNK, F.sum("_rows").over(before).alias("_earlier"))
        .filter(F.col("_earlier").isNotNull())  # again one row per chunk at most
    )
    return (
        rows.join(earlier, [*keys, CHUNK], "left")
        .withColumn(into, F.col("_n").cast("bigint") + F.coalesce("_earlier", F.lit(0)))
        .drop("_earlier")
    )


def label_index(values: DataFrame, group: str, label: str, into: str, name: str) -> DataFrame:
    """Number the distinct labels of each group from 0 in code point order.

    A sort across the cluster with a count per range partition in place of one
    global window.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialise(
        values.select(group, label).distinct()
        .repartitionByRange(parts, group, label).sortWithinPartitions(group, label)
        .withColumns({CHUNK: F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}),
        name,
    )
    before = Window.partitionBy(group).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    # One row per (group, chunk) pair in use: no more than chunks plus groups.
    spans = (
        placed.groupBy(group, CHUNK).agg(F.count("*").alias("_rows"), F.min("_pos").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    )
    return (
        placed.join(F.broadcast(spans), [group, CHUNK])
        .select(group, label, (F.col("_before") + F.col("_pos") - F.col("_first")).alias(into))
    )
