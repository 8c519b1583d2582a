"""Sums over the last n rows at every row, for groups of any size.

Rows are numbered over cut groups and dealt to blocks of bounded length; a block also
gets the last n rows of the block before. Inside, a sum over the last n rows is a
running sum less the running sum n rows back, so a row costs the same for any n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stallwise.operators.ordered import running_count
from stallwise.session import materialise

#: Rows of a block for every row that is carried over from the block before.
OWN_PER_CARRIED = 16


def rolling_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], n: int, name: str,
                 block: int | None = None) -> DataFrame:
    """Add a column for each of ``sums``: its sum over the row and the ``n - 1`` rows before it in its group.

    Null values add nothing. ``rows_in`` is the number of rows summed. Rows are never collected: a block holds
    ``block + n`` rows of one group, of which the last n are repeated in the next.
    """
    block = max(block or OWN_PER_CARRIED * n, n)
    parts = {f"_{c}": F.coalesce(value, F.lit(0)) for c, value in sums.items()}
    numbered = materialise(running_count(rows.withColumns(parts), keys, order, "_at", f"{name}-order"), name)
    own = numbered.withColumns({"_block": F.expr(f"(_at - 1) div {block}"), "_own": F.lit(True)})
    carried = own.where((F.col("_at") - 1) % block >= block - n).withColumns(
        {"_block": F.col("_block") + 1, "_own": F.lit(False)})
    inside = Window.partitionBy(*keys, "_block").orderBy("_at")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    both = own.unionByName(carried).withColumns({f"_to{c}": F.sum(c).over(so_far) for c in parts})
    both = both.withColumns({f"_back{c}": F.lag(f"_to{c}", n).over(inside) for c in parts}).where("_own")
    out = both.withColumns({c: F.col(f"_to_{c}") - F.coalesce(f"_back_{c}", F.lit(0)) for c in sums})
    dropped = [*parts, *[f"_to{c}" for c in parts], *[f"_back{c}" for c in parts], "_block", "_own", "_at"]
    return out.withColumn("rows_in", F.least("_at", F.lit(n))).drop(*dropped)
