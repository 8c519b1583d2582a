"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Every step looks only at rows whose group still has two members. Steps one and two
work on a stored table of a few dozen bytes a row; the content itself is hashed
whole only for rows that share length and prefix with another row. A group that
holds much of the table is never moved to one task (``HOT_SHARE``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stallwise.llm.common import fresh, plain, whole_text
from stallwise.session import materialise


#: A group with more than one in this many of all rows is hot. Fewer than this many groups can be, so the list of them
#: is broadcast and their rows stay where they are; all other groups are merged by key.
HOT_SHARE = 1000


def _without(rows: DataFrame, hot: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(F.broadcast(hot), on, "left_anti")


def _sizes(prefix: int) -> list[Column]:
    return [F.octet_length("body").alias("n_bytes"), F.xxhash64(F.substring("body", 1, prefix)).alias("head")]


def exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = 128,
                     digest_all: bool = False) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when their characters are; a null text counts as empty. Of equal texts the row with the
    largest id stays (a null id only if no row of the group has one). Rows that repeat id and text are alike, so
    all of them carry the same flag. An empty table gives no rows; further columns of ``docs`` are not read.
    ``text_sha256`` is null for rows whose content was never read whole; ``digest_all=True`` gives it for all,
    taken in the first scan, and the refinement then uses it where it needs a full hash.
    """
    rows = plain(docs, id, text)
    full = F.sha2(F.col("body"), 256)
    marks = materialise(rows.select("id", *_sizes(prefix), *([full.alias("sha")] if digest_all else [])), "exact-marks")
    on = ["n_bytes", "head"]
    share = marks.agg(F.count("*") / HOT_SHARE).scalar()
    pairs = marks.groupBy(*on).agg(F.count("*").alias("n"))  # counted first: a large group is one row from here on
    lengths = pairs.groupBy("n_bytes").agg(F.sum("n").alias("all")).where("all > 1").select("n_bytes")
    heads = materialise(pairs.where("n > 1").join(lengths, "n_bytes", "left_semi"), "exact-heads")
    hot, cold = (heads.where(x).select(*on) for x in (F.col("n") > share, F.col("n") <= share))
    alone = _without(marks, hot, on).join(cold, on, "left_anti").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        (F.col("sha") if digest_all else F.lit(None).cast("string")).alias("text_sha256"))
    read = marks if digest_all else rows.select("id", "body", *_sizes(prefix))
    shared = read.join(F.broadcast(hot), on, "left_semi").unionByName(
        _without(read, hot, on).join(cold, on, "left_semi"))
    left = materialise(shared.select("id", "n_bytes", F.col("sha") if digest_all else full.alias("sha")), "exact-left")
    same = ["n_bytes", "sha"]
    groups = materialise(left.groupBy(*same).agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")),
                         "exact-groups")
    hot, cold = (groups.where(x) for x in (F.col("group_size") > share, F.col("group_size") <= share))
    grouped = left.join(F.broadcast(hot), same).unionByName(
        _without(left, hot.select(*same), same).join(cold, same)).select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("sha").alias("text_sha256"))
    return alone.unionByName(grouped).withColumnRenamed("id", id)


def drop_exact_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", prefix: int = 128) -> DataFrame:
    """``docs`` with one row of each text, the one with the largest id; all columns as they were.

    Of rows that repeat id and text one stays. A null text counts as empty, so of null and empty texts one stays.
    """
    found = exact_duplicates(docs, id, text, prefix, digest_all=True)
    key, digest, kept, rows = fresh(docs, "key_id", "key_sha256", "key_kept", "key_rows")
    keys = found.groupBy(F.col(id).alias(key), F.col("text_sha256").alias(digest)).agg(
        F.first("kept").alias(kept), F.count("*").alias(rows))
    keys = materialise(keys.where(~F.col(kept) | (F.col(rows) > 1)), "exact-dropped")
    sha = F.sha2(whole_text(text), 256)
    same = (sha == F.col(digest)) & F.col(id).eqNullSafe(F.col(key))
    # one plan for every size: the keys grow with the data, so they are merged with the texts and never broadcast
    once = docs.join(keys.hint("merge"), same, "left_anti")
    again = docs.join(keys.where(kept), same, "left_semi").withColumn(digest, sha).dropDuplicates([id, digest])
    return once.unionByName(again.drop(digest))
