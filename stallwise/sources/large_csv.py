"""Product CSV with line breaks inside quotes, read by many tasks per file.

The file is read as lines, in byte ranges. Whether a line begins a record depends on
the quotes before it being even in number: each range counts its own, and a running sum over
ranges (one row each) tells every range how it begins. Records inside a range are put
together by the task that reads it and nothing is kept of the others; only what crosses the end
of a range is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stallwise.schemas import RAW_PRODUCT_COLUMNS
from stallwise.sources.readers import MISSING_TEXTS

RANGE = ["file", "block"]
_COUNTED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("quotes", pa.int64()), ("turns", pa.bool_()),
                      ("head", pa.binary())])
_PIECES = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int64()), ("at", pa.int64()),
                     ("text", pa.binary())])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("text"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """((file, block), lines of it in order): a range is in one task, its lines one after the other."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, block, text = batch.columns
        cuts = [0, n]
        if file[0] != file[n - 1] or block[0] != block[n - 1]:
            other = pc.or_(*[pc.not_equal(c.slice(1), c.slice(0, n - 1)) for c in (file, block)])
            cuts = [0, *(np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for start, end in zip(cuts, cuts[1:]):
            yield (file[start].as_py(), block[start].as_py()), text.slice(start, end - start)


def _quotes(text: pa.Array) -> np.ndarray:
    return pc.count_substring(text, '"').to_numpy(zero_copy_only=False).astype("int64")


def _joined(text: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Lines from each cut to the next, with the line breaks that were between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), text), b"\n")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each range: its quotes, whether a line of it has an odd number, and the first record of a file, null
    where that goes on in the next range."""
    at, quotes, turns, head, begun = None, 0, False, None, []

    def row():
        return pa.record_batch([pa.array([x], f.type) for x, f in zip((*at, quotes, turns, head), _COUNTED)], schema=_COUNTED)

    for key, text in _runs(batches):
        if key != at:
            if at is not None:
                yield row()
            at, quotes, turns, head, begun = key, 0, False, None, []
        own = _quotes(text)
        if key[1] == 0 and head is None:
            ends = np.flatnonzero((quotes + np.cumsum(own)) % 2 == 0)
            begun.append(_joined(text, [0, ends[0] + 1 if len(ends) else len(text)])[0].as_py())
            if len(ends):
                head, begun = b"\n".join(begun), []
        quotes, turns = quotes + int(own.sum()), turns or bool((own % 2).any())
    if at is not None:
        yield row()


def _pieces(sent, whole: bool):
    """Task body: the records that lie in a range (``at`` is ``block``), or what else is in it.

    A range begins with the end of a record of an earlier range (``place`` 0) if ``sent`` names it, with the block where
    that record began. ``block`` and ``place`` tell where a record began, ``at`` where a part of it is.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owners = sent.value
        at, place, inside, begun = None, 0, False, []

        def rows(owner: int, places: np.ndarray | list[int], texts: pa.Array) -> pa.RecordBatch:
            n = len(texts)
            return pa.record_batch([pa.repeat(at[0], n), pa.repeat(pa.scalar(owner, pa.int64()), n),
                                    pa.array(places, pa.int64()), pa.repeat(pa.scalar(at[1], pa.int64()), n), texts],
                                   schema=_PIECES)

        def left() -> Iterator[pa.RecordBatch]:
            if begun and not whole:
                yield rows(at[1] if place else owners[at], [place], pa.array([b"\n".join(begun)], pa.binary()))

        for key, text in _runs(batches):
            if key != at:
                yield from left()
                at, place, inside, begun = key, 0, key in owners, []
            ends = (inside + np.cumsum(_quotes(text))) % 2 == 0
            stops = np.flatnonzero(ends) + 1
            first = 0
            if inside and len(stops):
                begun.append(_joined(text, [0, stops[0]])[0].as_py())
                if whole == (place > 0):
                    yield rows(at[1] if place else owners[at], [place], pa.array([b"\n".join(begun)], pa.binary()))
                begun, first, stops = [], stops[0], stops[1:]
            if len(stops):
                if whole:
                    yield rows(at[1], place + 1 + np.arange(len(stops)), _joined(text, [first, *stops]))
                place, first = place + len(stops), stops[-1]
            if first < len(text):
                place += not (inside and first == 0)  # else these lines go on with what is open
                begun.append(_joined(text, [first, len(text)])[0].as_py())
            inside = not ends[-1]
        yield from left()

    return run


def _schema(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.binary(): "binary"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _clean(column: str) -> Column:
    """Without a byte order mark before it and a carriage return after it, which lies in the last three signs if any."""
    text = F.col(column).cast("string")
    text = F.when(text.startswith("\ufeff"), F.substring(text, 2, 2**31 - 1)).otherwise(text)
    last = F.substring(text, -3, 3)
    return F.when(last.contains("\r"), F.concat(F.substring(text, F.lit(1), F.length(text) - 3), F.regexp_replace(
        last, "\r$", ""))).otherwise(text)


def _owners(ranges: pa.Table) -> dict[tuple[str, int], int]:
    """For every range that begins inside quotes the block where the record it begins with begins."""
    owners, of, inside, owner = {}, None, False, 0
    for file, block, quotes, turns in sorted(zip(*(ranges.column(c).to_pylist() for c in (*RANGE, "quotes", "turns")))):
        if file != of:
            of, inside = file, False
        if inside:
            owners[file, block] = owner
        if turns:
            owner = block
        inside = (inside + quotes) % 2 == 1
    return owners


def _split(lines: DataFrame, ranges: pa.Table) -> tuple[DataFrame, DataFrame]:
    """The records that lie in a range, and those that cross the end of one."""
    sent = lines.sparkSession.sparkContext.broadcast(_owners(ranges))
    inside, parts = (lines.mapInArrow(_pieces(sent, whole), _schema(_PIECES)) for whole in (True, False))
    pieces = F.array_sort(F.collect_list(F.struct("at", F.col("text").cast("string").alias("text"))))
    crossing = parts.groupBy(*RANGE).agg(  # a record at most begins in a range and goes on after it
        F.max("place").alias("place"), F.array_join(F.transform(pieces, lambda p: p["text"]), "\n").alias("text"))
    return tuple(found.select(*RANGE, "place", _clean("text").alias("record")).where(F.length("record") > 0)
                 for found in (inside, crossing))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, place, record``: the records of the files, quoted line breaks in them, in order of the first three.

    Fields that hold a quote must be quoted, as CSV asks for; a quote that is never closed makes the rest of its file
    one record. Blank lines between records are no records. A record is held by one task. The quotes are counted at once, a
    row for each range comes to the driver; the ranges that begin inside quotes are sent to the tasks.
    """
    lines = _lines(spark, path)
    inside, crossing = _split(lines, lines.mapInArrow(_counted, _schema(_COUNTED)).drop("head").toArrow())
    return inside.unionByName(crossing)


def read_split_products(spark: SparkSession, path: str) -> DataFrame:
    """The rows of ``readers.read_products`` with any number of tasks per file; ``ord`` is (file, block, place).

    The first file's header gives the columns; a file with another header is refused.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    names = reader.csv(path).columns
    options = {"quote": '"', "escape": '"', "multiLine": "true"}

    def row(record: str) -> Column:
        return F.from_csv(record, ", ".join(f"`{n}` string" for n in names), options)

    def differs(record: str) -> Column:
        titles = F.array(*[row(record)[n] for n in names])
        return (F.length(record) > 0) & ~titles.eqNullSafe(F.array(*map(F.lit, names)))

    lines, first = _lines(spark, path), F.col("block") == 0
    ranges = lines.mapInArrow(_counted, _schema(_COUNTED)).withColumn("head", _clean("head")).select(
        *RANGE, "quotes", "turns", (first & F.col("head").isNull()).alias("crosses"),
        (first & F.coalesce(differs("head"), F.lit(False))).alias("other")).toArrow()
    inside, crossing = _split(lines, ranges)
    other = ranges.filter(pc.field("other")).column("file").to_pylist()
    if not other and pc.any(ranges.column("crosses")).as_py():
        other = [r["file"] for r in crossing.where(first & (F.col("place") == 1)).where(differs("record")).select("file").take(1)]
    if other:
        raise ValueError(f"{other[0]} has another header")
    parsed = inside.unionByName(crossing).select(
        F.struct(*RANGE, "place").alias("ord"), (first & (F.col("place") == 1)).alias("header"), row("record").alias("row"))
    known = [F.when(~F.col(f"row.`{c}`").isin(MISSING_TEXTS), F.col(f"row.`{c}`")).alias(c) for c in RAW_PRODUCT_COLUMNS]
    return parsed.where("NOT header").select(*known, "ord")
