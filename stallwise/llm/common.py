"""Small parts that several operators of this folder use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Words as runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold(id: str, parts: int, rest: int) -> Column:
    """True where crc32(id as text) mod ``parts`` is ``rest``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id).cast("string")), F.lit(parts)) == rest, F.lit(False))


def whole_text(text: str) -> Column:
    """The text, empty when null."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8.

    ``bytes`` methods treat ASCII alone, which is the definition wanted here.
    """
    return text.encode("utf-8", "replace").lower().split()


def plain(docs: DataFrame, id: str, text: str, *more: Column) -> DataFrame:
    """Only the columns an operator reads, under names of its own."""
    return docs.select(F.col(id).alias("id"), whole_text(text).alias("body"), *more)


def bounded_sample(rows: DataFrame, keys: DataFrame, by: str, most: int) -> DataFrame:
    """Rows of at most ``most`` ids of each value of ``by`` (neither null), chosen by a hash of the id.

    ``keys`` holds ``id`` and ``by``, and the choice reads it alone; a count sets how much of the hash range is looked
    at. The chosen ids, at most ``most`` a value, are broadcast to the texts, which are not shuffled.
    """
    known = keys.where(F.col(by).isNotNull() & F.col("id").isNotNull()).select("id", by).distinct()
    rate = known.groupBy(F.col(by).alias("_by")).agg((F.lit(1.3 * most + 20) / F.count("*")).alias("_rate"))
    mark = F.xxhash64(F.lit(by), "id")
    near = known.join(rate, F.col(by) == F.col("_by")).where(F.pmod(mark, F.lit(1_000_000)) < F.col("_rate") * 1e6)
    order = Window.partitionBy(by).orderBy(mark, "id")
    chosen = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("id", by)
    return rows.join(F.broadcast(chosen), "id")


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names that are no columns of ``docs`` (in any case), made of the given ones."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out
