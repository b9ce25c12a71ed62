"""Joins of many rows with one row per key, where some keys are hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: a key with more than 1/HOT_KEYS of all rows is joined by broadcast
HOT_KEYS = 1000


def join_by_key(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join with a table whose column ``n`` counts the rows of its key
    (``total`` in all). Fewer than ``HOT_KEYS`` keys can have more than
    ``total / HOT_KEYS`` rows: they are broadcast, and the others take a
    shuffle in which no key is large."""
    hot = F.col(n) * HOT_KEYS > F.lit(total)
    busy = table.where(hot)
    settled = rows.join(F.broadcast(busy), key)
    rest = rows.join(F.broadcast(busy.select(key)), key, "left_anti").join(table.where(~hot), key)
    return settled.unionByName(rest)
