"""Column operators: layout changes, vertical partition, alignment, contracts.

Layouts
  long  cells(row_id BIGINT, feature_id INT, value DOUBLE), zeros not stored,
        feature_id 1-based; labels live in a separate rows(row_id, label).
  wide  (row_id BIGINT, label INT, features ARRAY<DOUBLE>).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: values that are laid out at once
DENSE_VALUES = 1 << 20


def portion_ratio(portion: int) -> float:
    """Portion codes 19/28/37/46/55 -> 0.1..0.5 (fixed values)."""
    codes = {19: 0.1, 28: 0.2, 37: 0.3, 46: 0.4, 55: 0.5}
    if portion not in codes:
        raise ValueError(f"portion code must be one of {sorted(codes)}, got {portion}")
    return codes[portion]


def party_border(n: int, p: float | None = None, portion: int | None = None) -> int:
    """First party's column count: floor(n * p); portion codes map to p."""
    if p is None:
        if portion is None:
            raise ValueError("give p or portion")
        p = portion_ratio(portion)
    return int(math.floor(n * p))


def to_long(wide: DataFrame, features: str = "features") -> DataFrame:
    """Wide -> long; zeros dropped, feature_id 1-based (C4)."""
    return (
        wide.select("row_id", F.posexplode(features).alias("pos", "value"))
        .where(F.col("value") != 0)
        .select("row_id", (F.col("pos") + 1).cast("int").alias("feature_id"), F.col("value").cast("double").alias("value"))
    )


def to_wide(cells: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """Long -> wide with implicit zeros restored (C4).

    One row's cells are gathered in feature order (at most ``width``) and laid
    out once, some rows at a time: each cell brings the zeros before it. Rows
    without cells come back as all zeros; a cell beyond the width fails the job.
    """
    per_row = resize_features(cells, width).groupBy("row_id").agg(
        F.sort_array(F.collect_list(F.struct(F.col("feature_id").cast("int").alias("f"), F.col("value").cast("double").alias("v")))).alias("e"))
    e = F.coalesce(F.col("e"), F.array().cast("array<struct<f:int,v:double>>")).alias("e")
    vec = rows.join(per_row, "row_id", "left").select("row_id", "label", e)
    return vec.mapInArrow(_dense(width), StructType([*vec.schema.fields[:2], StructField("features", ArrayType(DoubleType()))]))


def _dense(width: int):
    """Arrow batches (row_id, label, e) -> (row_id, label, features)."""
    step = max(1, DENSE_VALUES // width)

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                e, sizes = part.column(2).flatten(), pc.list_value_length(part.column(2)).to_numpy()
                f, v = (e.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                row_of = np.repeat(np.arange(len(sizes)), sizes)
                first, last = np.cumsum(sizes) - sizes, np.cumsum(sizes) - 1
                some = sizes > 0
                prev = np.append(0, f)[:-1]
                prev[first[some]] = 0
                # where a cell ends, counted over all rows' cells, and before its row's first one
                ends = np.cumsum(np.maximum(f.astype(np.int64) - prev - 1, 0) + 1)
                upto = np.zeros(len(sizes), np.int64)
                upto[some] = ends[last[some]]
                upto = np.maximum.accumulate(upto)
                tail = np.full(len(sizes), width, np.int64)
                tail[some] = np.maximum(width - f[last[some]].astype(np.int64), 0)
                lengths = np.diff(upto, prepend=0) + tail
                starts = np.cumsum(lengths) - lengths
                at = ends - 1 - (upto - np.diff(upto, prepend=0))[row_of] + starts[row_of]
                flat = np.zeros(int(lengths.sum()))
                flat[at] = v
                mask = None
                if e.field(1).null_count:
                    mask = np.zeros(len(flat), bool)
                    mask[at] = e.field(1).is_null().to_numpy(zero_copy_only=False)
                lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(flat)).astype(np.int32)), pa.array(flat, mask=mask))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists], names=["row_id", "label", "features"])

    return run


def vertical_partition(cells: DataFrame, n1: int) -> DataFrame:
    """Long: tag each cell with its party and party-local feature id."""
    party = F.when(F.col("feature_id") <= n1, F.lit(1)).otherwise(F.lit(2))
    local = F.when(F.col("feature_id") <= n1, F.col("feature_id")).otherwise(F.col("feature_id") - n1)
    return cells.select("row_id", party.alias("party"), local.cast("int").alias("feature_id"), "value")


def vertical_partition_wide(wide: DataFrame, n1: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Wide: two slices of the feature array."""
    left = wide.select("row_id", "label", F.slice("features", 1, n1).alias("features"))
    right = wide.select("row_id", F.slice("features", n1 + 1, width - n1).alias("features"))
    return left, right


def align_parties(party1: DataFrame, party2: DataFrame, n1: int) -> DataFrame:
    """Long: glue the parties side by side; party 2 ids offset by n1."""
    p2 = party2.select("row_id", (F.col("feature_id") + n1).cast("int").alias("feature_id"), "value")
    return party1.select("row_id", "feature_id", "value").unionByName(p2)


def align_parties_wide(left: DataFrame, right: DataFrame) -> DataFrame:
    """Wide: equi-join on row_id and concatenate arrays."""
    r = right.select("row_id", F.col("features").alias("_f2"))
    return left.join(r, "row_id", "inner").select("row_id", "label", F.concat("features", "_f2").alias("features"))


def resize_features(cells: DataFrame, width: int) -> DataFrame:
    """Declare a wider feature space; stored cells unchanged.

    A cell beyond the declared width fails the job instead of being dropped.
    """
    bad = F.col("feature_id") > F.lit(width)
    checked = F.when(bad, F.raise_error(F.lit(f"feature_id exceeds declared width {width}"))).otherwise(F.col("feature_id"))
    return cells.select("row_id", checked.cast("int").alias("feature_id"), "value").withColumn("width", F.lit(width))


def check_contract(samples: DataFrame, k1: int, k2: int, strict: bool = False, sketch: DataFrame | None = None,
                   widths: tuple[int, int] | None = None) -> DataFrame:
    """Violation counts for a samples table, one row per check.

    rows_party1 / rows_party2 : distinct rows per party
    rows_differ               : 1 where the parties don't have the same rows
                                (their number and two order-free hashes)
    bad_hash_count            : (row, party) with a hash count != k_p
    bad_sample_values         : samples that are neither >= 1 nor in {-1, 0}
    bad_sketch_columns        : with ``sketch`` (party, col): columns outside
                                of 0 .. the party's width, ``widths``
    """
    per_row = samples.groupBy("row_id", "party").agg(F.count(F.lit(1)).alias("n"))
    want = F.when(F.col("party") == 1, F.lit(k1)).otherwise(F.lit(k2))
    marks = [F.coalesce(F.bit_xor(F.when(F.col("party") == p, F.xxhash64(F.col("row_id"), F.lit(i)))), F.lit(0)) for i in (0, 1) for p in (1, 2)]
    n1, n2 = F.count_if(F.col("party") == 1), F.count_if(F.col("party") == 2)
    a = per_row.agg(
        n1.alias("rows_party1"), n2.alias("rows_party2"),
        F.when((n1 == n2) & (marks[0] == marks[1]) & (marks[2] == marks[3]), 0).otherwise(1).alias("rows_differ"),
        F.count_if(F.col("n") != want).alias("bad_hash_count"),
    )
    names = ("rows_party1", "rows_party2", "rows_differ", "bad_hash_count")
    out = a.select(
        F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).cast("bigint").alias("value")) for c in names])).alias("x")
    ).select("x.*")
    more = [("bad_sample_values", samples, ~((F.col("sample") >= 1) | F.col("sample").isin(-1, 0)))]
    if sketch is not None:
        limit = F.when(F.col("party") == 1, F.lit(widths[0])).otherwise(F.lit(widths[1]))
        more.append(("bad_sketch_columns", sketch, (F.col("col") < 0) | (F.col("col") >= limit)))
    for name, table, bad in more:
        out = out.unionByName(table.agg(F.count_if(bad).cast("bigint").alias("value")).select(F.lit(name).alias("check"), "value"))
    if strict:
        got = {r["check"]: r["value"] for r in out.collect()}  # a number per check
        if any(v for c, v in got.items() if c not in ("rows_party1", "rows_party2")):
            raise ValueError(f"matrix contract violated: {got}")
    return out
