"""Source mixing by balanced sampling with the cube method.

Every document is taken a whole number of times plus once more with the fractional
probability its source needs. The flight phase moves those probabilities within the
null space of two constraints, words and documents of the source, until no more than
two of a block are undecided; the undecided meet in the blocks of the next level, and
what one last block leaves lands.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stallwise.llm.common import WORD
from stallwise.session import materialise

#: Units of sizes from large to small kept for the landing, where all their subsets are tried.
SPARE = 10


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: dict[str | None, int], weights: Sequence[float] = (3, 1, 2), share: float = 1.5,
            most: float = 2.0) -> dict[str | None, float]:
    """Words to take from each source: sources by code point, null last, with ``weights`` in turn.

    No target passes ``most`` times its source's size; the excess goes to the others by weight until none is above.
    """
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    full: dict[str | None, float] = {}
    left = share * sum(sizes.values())
    open_ = list(names)
    while open_:
        unit = left / sum(weight[n] for n in open_)
        above = [n for n in open_ if unit * weight[n] > most * sizes[n]]
        if not above:
            return full | {n: unit * weight[n] for n in open_}
        for n in above:
            full[n] = most * sizes[n]
            left -= full[n]
        open_ = [n for n in open_ if n not in full]
    return full


def _direction(work: list[int], size: Sequence[int], count: Sequence[int]) -> list[int] | None:
    """A vector that changes neither the words nor the documents expected of these units."""
    if len(work) == 3:
        (a, b, c), (x, y, z) = [size[k] for k in work], [count[k] for k in work]
        found = [b * z - c * y, c * x - a * z, a * y - b * x]
        return found if any(found) else [b, -a, 0]
    if len(work) == 2:
        (a, b), (x, y) = [size[k] for k in work], [count[k] for k in work]
        return [b, -a] if a * y == b * x else None
    return None


def _move(work: list[int], v: Sequence[float], p: list[float], draw: Callable[[], float]) -> list[int]:
    """One random step along ``v`` that decides at least one unit and keeps every expectation."""
    def room(sign: int) -> tuple[float, int]:
        return min(((1 - p[k]) / (sign * x) if sign * x > 0 else p[k] / (-sign * x), k)
                   for k, x in zip(work, v) if x)

    (up, first), (down, second) = room(1), room(-1)
    sign, step, bound = (1, up, first) if draw() * (up + down) < down else (-1, down, second)
    for k, x in zip(work, v):
        if x:
            p[k] += sign * step * x
            if k == bound:
                p[k] = float(sign * x > 0)
            elif p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
    return [k for k in work if 0 < p[k] < 1]


def flight(p: list[float], size: Sequence[int], count: Sequence[int], draw: Callable[[], float],
           spare: int = 0) -> list[int]:
    """Decides the units in order, in place, but for ``spare`` ones; the units left undecided are returned: the spare
    ones, spread over the order, and at most two others."""
    work: list[int] = []
    open_ = [k for k, x in enumerate(p) if 0 < x < 1]
    kept = sorted({open_[int(x) - 1] for x in np.geomspace(1, len(open_), spare)}) if open_ and spare else []
    queue = iter([k for k in open_ if k not in set(kept)])
    more = True
    while True:
        while more and len(work) < 3:
            if (k := next(queue, None)) is None:
                more = False
            else:
                work.append(k)
        v = _direction(work, size, count)
        if v is None:
            return work + kept
        work = _move(work, v, p, draw)


def land(work: list[int], p: list[float], size: Sequence[int], count: Sequence[int], draw: Callable[[], float]) -> None:
    """Takes the subset whose words, and then documents, come nearest to what is expected of the units."""
    if not work:
        return
    taken = (np.arange(1 << len(work))[:, None] >> np.arange(len(work))) & 1
    off = []
    for of in (size, count):
        own = np.array([of[k] for k in work], float)
        off.append(np.abs(taken @ own - float(own @ np.array([p[k] for k in work]))))
    noise = np.array([draw() for _ in range(len(taken))])
    best = taken[np.lexsort((noise, off[1], off[0]))[0]]
    for k, x in zip(work, best):
        p[k] = float(x)


def _flier(columns: list[str], seed: int, level: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def fly(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # large documents are decided first, so what is left undecided is small
        rows = rows.sort_values(["size", "mark", "id"], ascending=[False, True, True], kind="stable")
        p, size, count = rows["p"].tolist(), rows["size"].tolist(), [1] * len(rows)
        draw = random.Random(f"{seed} {level} {key[0]} {key[1]}").random
        undecided = flight(p, size, count, draw, SPARE if last else 0)
        if last:
            land(undecided, p, size, count, draw)
        return rows.assign(p=p)[columns]

    return fly


def mix(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source",
        weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 4096,
        seed: int = 42) -> DataFrame:
    """One row per input row: ``id, size, source_size, target, taken``; size and taken in words.

    A null text has size 0, null sources are one source that comes last. Of rows that agree in id, source and text size
    as many are taken once more as their probabilities add up to, and one is left to the flight; which of them these
    are can't be told from the columns given. Sources without words have target 0; an empty table gives no rows. The
    choice depends on the seed and the rows only, not on how they are partitioned. The driver sees one row per source.
    """
    spark = docs.sparkSession
    marks = materialise(docs.select(F.col(id).alias("id"), F.col(source).cast("string").alias("source"),
                                    word_count(text).alias("size")), "mix-sizes")
    sums = {r["source"]: r for r in marks.groupBy("source").agg(
        F.sum("size").alias("size"), F.count("*").alias("rows")).collect()}
    goal = targets({n: r["size"] for n, r in sums.items()}, weights, share, most)
    plan, blocks = [], {}
    for no, (name, row) in enumerate(sums.items()):
        ratio = goal[name] / row["size"] if row["size"] else 0.0
        whole = math.floor(ratio + 1e-12)
        part = ratio - whole if ratio - whole > 1e-12 else 0.0
        plan.append((no, name, row["size"], float(goal[name]), whole, part))
        blocks[no] = -(-row["rows"] // block)
    sources = spark.createDataFrame(
        plan, "no int, name string, source_size bigint, target double, whole bigint, part double")
    placed = marks.join(sources, marks["source"].eqNullSafe(sources["name"])).drop("name", "source")
    drawn = (F.col("part") > 0) & (F.col("size") > 0)
    # Rows alike are interchangeable in both constraints: a flight among them alone decides all but one.
    units = placed.where(drawn).groupBy("no", "id", "size").agg(
        F.count("*").alias("copies"), F.first("part").alias("part"))
    expected = F.col("copies") * F.col("part")
    units = units.withColumn("sure", F.floor(expected + 1e-9)).select(
        "no", F.col("id").cast("string").alias("id"), "size", "copies", "sure",  # pandas has no null whole numbers
        F.greatest(expected - F.col("sure"), F.lit(0.0)).alias("p"), F.xxhash64(F.lit(seed), "id", "size").alias("mark"))
    kind = T.StructType([*units.schema.fields])
    decided, level = [], 0
    while True:
        last = all(n <= 1 for n in blocks.values())
        counts = spark.createDataFrame([(no, max(1, n)) for no, n in blocks.items()] or [(0, 1)], "no int, blocks bigint")
        dealt = units.join(counts, "no").withColumn(
            "block", F.pmod(F.xxhash64(F.lit(level), "mark"), F.col("blocks"))).drop("blocks")

        moved = materialise(dealt.groupBy("no", "block").applyInPandas(_flier(kind.names, seed, level, last), kind), "mix-flight")
        decided.append(moved.where("p = 0 or p = 1"))
        if last:
            break
        units, level = moved.where("p > 0 and p < 1"), level + 1
        blocks = {no: -(-2 * n // block) for no, n in blocks.items()}
    chosen = decided[0]
    for part in decided[1:]:
        chosen = chosen.union(part)
    again = F.col("sure") + F.col("p").cast("long")
    chosen = _rows(chosen.withColumn("again", again)).join(sources.drop("name"), "no").withColumn(
        "id", F.col("id").cast(marks.schema["id"].dataType))
    others = placed.where(~drawn).withColumn("more", F.lit(0))
    columns = ["id", "size", "source_size", "target", "whole", "more"]
    return chosen.select(*columns).unionByName(others.select(*columns)).select(
        F.col("id").alias(id), "size", "source_size", "target",
        (F.col("size") * (F.col("whole") + F.col("more"))).cast("long").alias("taken"))


def _rows(units: DataFrame, chunk: int = 4096) -> DataFrame:
    """``copies`` rows of each unit, the first ``again`` of them with ``more`` 1; large units are made by many tasks."""
    one = units.where("copies = 1").select("no", "id", "size", F.col("again").alias("more"))
    cut = units.where("copies > 1").select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / chunk)))
                                           .alias("part_no")).repartition("no", "id", "size", "part_no")
    first = F.col("part_no") * chunk
    last = F.least(first + chunk, F.col("copies")) - 1
    many = cut.select("no", "id", "size", "again", F.explode(F.sequence(first, last)).alias("at"))
    return one.unionByName(many.select("no", "id", "size", (F.col("at") < F.col("again")).cast("long").alias("more")))
