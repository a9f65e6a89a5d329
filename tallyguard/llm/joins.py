"""A join that frequent keys don't slow down."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1_000


def join_counted(rows: DataFrame, table: DataFrame, key: str, copies: str) -> DataFrame:
    """Rows with the columns of their key's row in ``table``, which has one row for each key and in
    ``copies`` the number of rows that have it; rows without a key in the table are left out.

    Keys that hold a thousandth of all matched rows or more number a thousand at most: they are
    broadcast, so their rows stay where they are. All other rows are joined by a shuffle.
    """
    total = table.agg(F.sum(copies)).first()[0] or 0
    hot = table.where(F.col(copies) * HOT_SHARE >= total).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(hot), key, "left")
    found = marked.where("__hot").drop("__hot")
    rest = marked.where("__hot IS NULL").select(rows.columns).join(table.where(F.col(copies) * HOT_SHARE < total), key)
    return found.unionByName(rest)
