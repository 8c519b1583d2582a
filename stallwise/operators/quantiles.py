"""Exact median of a whole-number column of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stallwise.session import materialise

BINS = 65_536


def exact_median(df: DataFrame, column: str) -> float | None:
    """The middle value, or the mean of the two middle values; None without values.

    The built-in exact percentile keeps every distinct value in one buffer. Here the
    values are counted first; the range that holds the middle is then cut into at
    most 65,536 equal bins again and again. A step hands one or two bins to the
    driver, and a 64-bit range needs four steps.
    """
    counts = materialise(
        df.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("bigint").alias("value")).agg(F.count("*").alias("n")),
        "value-counts",
    )
    whole = counts.agg(F.sum("n").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).first()
    if not whole["n"]:
        return None
    low, high = whole["low"], whole["high"]
    ranks = ((whole["n"] - 1) // 2, whole["n"] // 2)
    while True:
        width = -(-(high - low + 1) // BINS)
        bins = _bins_at(counts, low, high, width, ranks)
        if len(bins) == 2:
            # The ranks are neighbours: one ends its bin, the other begins its own.
            ends = counts.agg(
                F.max(F.when(F.col("value") < low + (bins[0]["bin"] + 1) * width, F.col("value"))).alias("left"),
                F.min(F.when(F.col("value") >= low + bins[1]["bin"] * width, F.col("value"))).alias("right")).first()
            return (ends["left"] + ends["right"]) / 2
        low, high = low + bins[0]["bin"] * width, min(high, low + (bins[0]["bin"] + 1) * width - 1)
        ranks = tuple(rank - bins[0]["before"] for rank in ranks)
        if low == high:
            return float(low)


def _bins_at(counts: DataFrame, low: int, high: int, width: int, ranks: tuple[int, int]) -> list:
    """The one or two bins of ``low``..``high`` that hold the ranks, in order."""
    within = counts.filter(F.col("value").between(low, high))
    bins = within.groupBy(F.expr(f"(value - {low}) div {width}").alias("bin")).agg(F.sum("n").alias("n"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # at most 65,536 rows
    placed = bins.withColumn("upto", F.sum("n").over(upto)).withColumn("before", F.col("upto") - F.col("n"))
    hit = [(F.col("upto") > rank) & (F.col("before") <= rank) for rank in ranks]
    return placed.filter(hit[0] | hit[1]).orderBy("bin").collect()
