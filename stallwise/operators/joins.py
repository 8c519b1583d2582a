"""Joins of a big, possibly lopsided table with a one-row-per-key lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SALTS = 16


def lookup_join(
    rows: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    spread: str | list[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join ``rows`` with ``lookup`` (unique on ``on``) without a hot task.

    No broadcast hint: Spark broadcasts the lookup only when its planned or, under
    adaptive execution, its measured size is below the session's threshold. Past
    that the join shuffles on ``(key, salt)``, so a key holding a third of all rows
    is cut into ``salts`` pieces; the salt is a hash of ``spread``, hence the same
    again when a task is retried. The lookup, one row per key, is what is repeated.
    """
    keys = [on] if isinstance(on, str) else list(on)
    spread = [spread] if isinstance(spread, str) else list(spread)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, keys + ["_salt"], how).drop("_salt")


def fetch_by_key(wanted: DataFrame, table: DataFrame, on: str, spread: str | list[str]) -> DataFrame:
    """Add the columns of a big ``table`` (unique on ``on``) to the rows of ``wanted``.

    The table is first cut to the keys that are asked for at all, so a key that
    everybody asks for costs its copies on the small side only.
    """
    keys = wanted.select(on).distinct()
    return lookup_join(wanted, table.join(keys, on, "left_semi"), on, spread, how="inner")
