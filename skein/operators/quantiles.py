"""Exact order statistics and quantiles per group, as tables.

``percentile`` keeps every distinct value of a group in one task; here equal
values of a group are one row with their number, and the rows of all groups are
ranged together by (group, value): one range shuffle and running sums tell how
many values come before each row. A wanted rank is the row that covers the
group's first position plus that rank; the ranks of a group travel to its rows
(``hotjoin.py``), so no task holds a hot group. Nothing but one count per range
reaches the driver.

Interpolation matches numpy/Spark/DuckDB: h = (n-1)p, q = x[lo] + (x[hi]-x[lo])*(h-lo).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from skein.operators.hotjoin import join_by_key
from skein.session import cut_lineage


def _running(batches):
    """Adds to each row the sum of ``n`` over the rows before it in its task."""
    before = 0
    for batch in batches:
        n = batch.column(batch.schema.get_field_index("n")).to_numpy()
        upto = before + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - n)], names=[*batch.schema.names, "_before"])
        before = int(upto[-1]) if len(upto) else before


def _weighted_position(rows: DataFrame) -> tuple[DataFrame, int]:
    """``start``: how many values come before a row's ``n`` equal ones, in the
    order of key and value; and the number of rows. One range shuffle."""
    spark = rows.sparkSession
    p = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(p, "key", "value").sortWithinPartitions("key", "value").withColumn("_p", F.spark_partition_id())
    ranged = cut_lineage(ranged.mapInArrow(_running, StructType([*ranged.schema, StructField("_before", LongType())])))
    counts = sorted(tuple(r) for r in ranged.groupBy("_p").agg(F.sum("n"), F.count(F.lit(1))).collect())  # one row per range
    offsets = np.cumsum([0, *[c for _, c, _ in counts]])
    off = spark.createDataFrame([(part, int(o)) for (part, _, _), o in zip(counts, offsets)], "_p int, _off long")
    placed = ranged.join(F.broadcast(off), "_p").select("key", "value", "n", (F.col("_off") + F.col("_before")).alias("start"))
    return placed, sum(c for *_, c in counts)


def quantiles(values: DataFrame, key: str, value: str, probs: list[float], zeros: DataFrame | None = None) -> DataFrame:
    """(key, q): per key the linear quantiles at ``probs``, in their order.

    ``zeros`` (key, zeros) adds so many zeros to a key's values without
    making rows of them; a key that only ``zeros`` names has zeros alone.
    Null values are left out, and a key without any value has no row.
    """
    rows = cut_lineage(values.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("key"), F.col(value).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n")))
    placed, total_rows = _weighted_position(rows)
    own = placed.groupBy("key").agg(F.min("start").alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("value") < 0, F.col("n"))).alias("below"), F.count(F.lit(1)).alias("rows"))
    if zeros is not None:
        own = own.join(zeros.select(F.col(key).alias("key"), "zeros"), "key", "full_outer")
    else:
        own = own.withColumn("zeros", F.lit(0))
    own = own.select("key", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("first", "n", "below", "zeros", "rows")])
    total = F.col("n") + F.col("zeros")
    asked = []
    for i, p in enumerate(probs):
        h = (total.cast("double") - 1) * F.lit(float(p))
        for side in (0, 1):
            rank = F.least(F.floor(h).cast("long") + side, total - 1)
            is_zero = (rank >= F.col("below")) & (rank < F.col("below") + F.col("zeros"))
            stored = F.when(rank < F.col("below"), rank).otherwise(rank - F.col("zeros"))
            asked.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (h - F.floor(h)).alias("frac"),
                                  F.when(~is_zero, F.col("first") + stored).alias("pos")))  # null: an implicit zero
    own = cut_lineage(own.where(total > 0).select("key", "rows", F.array(*asked).alias("asked")))
    hit = F.filter("asked", lambda a: (a["pos"] >= F.col("start")) & (a["pos"] < F.col("start") + F.col("n")))
    stored = join_by_key(placed, own.where("rows > 0"), "key", "rows", total_rows).select("key", "value", F.explode(hit).alias("e"))
    implicit = own.select("key", F.lit(0.0).alias("value"), F.explode(F.filter("asked", lambda a: a["pos"].isNull())).alias("e"))
    found = stored.unionByName(implicit).groupBy("key", F.col("e.i").alias("i")).agg(
        F.max("e.frac").alias("frac"),
        F.max(F.when(F.col("e.side") == 0, F.col("value"))).alias("a"),
        F.max(F.when(F.col("e.side") == 1, F.col("value"))).alias("b"))
    q = F.col("a") + (F.col("b") - F.col("a")) * F.col("frac")
    per = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", q.alias("q")))).alias("q"))
    return per.select(F.col("key").alias(key), F.col("q.q").alias("q"))
