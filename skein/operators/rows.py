"""Row selection, labels and mini-batches.

Positional ideas from the reference (row order, contiguous batches, "last 20 %")
need exact global ranks. Two distributed building blocks give them without
funnelling rows through one task:

* ``kth_smallest`` narrows a value range with bounded histograms (16 bits per
  round, <= 65,536 buckets collected per round), so selecting a cut value costs
  a few partially-aggregated scans.
* ``global_position`` range-partitions, sorts and numbers the rows of each range
  as it writes them to the shared checkpoint folder, counts rows per range (P
  numbers) and adds the offsets: one shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.hashing import h32
from skein.session import cut_lineage

_BUCKET_BITS = 16


def column_range(df: DataFrame, col: str):
    return df.agg(F.min(col).alias("lo"), F.max(col).alias("hi"), F.count(F.lit(1)).alias("n")).collect()[0]


def kth_smallest(df: DataFrame, col: str, k: int, stats=None) -> tuple[int, int]:
    """Exact k-th smallest (1-based) of an integer column.

    Returns (value, rows_strictly_below_value). ``stats`` may carry a
    precomputed (lo, hi, n) row from ``column_range``.
    """
    stats = stats or column_range(df, col)
    if stats["n"] < k or k < 1:
        raise ValueError(f"k={k} outside 1..{stats['n']}")
    lo, hi = int(stats["lo"]), int(stats["hi"])
    below = 0
    while lo < hi:
        span = hi - lo
        shift = max(0, span.bit_length() - _BUCKET_BITS)
        part = df.where((F.col(col) >= lo) & (F.col(col) <= hi))
        hist = (
            part.groupBy(F.shiftright(F.col(col) - F.lit(lo), shift).alias("b"))
            .agg(F.count(F.lit(1)).alias("c"))
            .orderBy("b")
            .collect()
        )
        acc = 0
        for r in hist:
            if acc + r["c"] >= k:
                b = int(r["b"])
                break
            acc += r["c"]
        k -= acc
        below += acc
        new_lo = lo + (b << shift)
        hi = min(hi, new_lo + (1 << shift) - 1)
        lo = new_lo
    return lo, below


#: monotonically_increasing_id keeps a row's number in its partition in these bits
_IN_PARTITION = 33


def global_position(df: DataFrame, order_col: str | list[str], partitions: int | None = None) -> DataFrame:
    """Add ``pos`` = 0-based rank of each row by unique ``order_col`` value(s).

    One range shuffle: rows are sorted in their ranges, numbered there as they
    are written to the checkpoint, and the ranges' offsets (one row per
    partition) are added.
    """
    spark = df.sparkSession
    cols = [order_col] if isinstance(order_col, str) else list(order_col)
    p = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut_lineage(df.repartitionByRange(p, *[F.col(c) for c in cols]).sortWithinPartitions(*cols).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", _IN_PARTITION).cast("int")
    counts = sorted(tuple(r) for r in ranged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c")).collect())
    offsets, acc = [], 0
    for pid, c in counts:
        offsets.append((pid, acc))
        acc += c
    off = spark.createDataFrame(offsets, "_p int, _off long")  # one row per partition
    return (ranged.withColumn("_p", part).join(F.broadcast(off), "_p")
            .withColumn("pos", F.col("_off") + F.col("_m").bitwiseAND(F.lit((1 << _IN_PARTITION) - 1))).drop("_p", "_off", "_m"))


# ------------------------------------------------------------------ B1
def sample_exact(rows: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Exactly ``n`` rows without replacement, chosen by a seeded hash order.

    Order key: h32(seed:row_id), ties broken by row_id. Returns the selected
    rows (all columns of ``rows``).
    """
    key = h32(F.lit(seed), F.col("row_id"))
    # the selection makes several passes: materialise only (row_id, key) once
    keys = cut_lineage(rows.select("row_id", key.alias("_k")))
    stats = column_range(keys, "_k")
    if n >= stats["n"]:
        return rows
    cut, below = kth_smallest(keys, "_k", n, stats)
    need = n - below
    at_cut = keys.where(F.col("_k") == cut)
    last_id, _ = kth_smallest(at_cut, "row_id", need)
    keep = (key < cut) | ((key == cut) & (F.col("row_id") <= last_id))
    return rows.where(keep)


# ------------------------------------------------------------------ B2
# Per-dataset policy (sample size, declared width).
DATASET_POLICY = {
    "cifar10": {"sample_n": 10000, "width": None},
    "SVHN": {"sample_n": 10000, "width": None},
    "webspam10k_50k": {"sample_n": None, "width": 50000},
    "webspam10k_100k": {"sample_n": None, "width": 100000},
    "webspam10k_500k": {"sample_n": None, "width": 500000},
}


def apply_dataset_policy(name: str, rows: DataFrame, cells: DataFrame | None = None):
    """Sample rows and/or widen the feature space according to the dataset.

    Returns (rows, cells, width_or_None). Cells follow the sampled rows via a
    left-semi join on row_id.
    """
    policy = DATASET_POLICY.get(name, {"sample_n": None, "width": None})
    if policy["sample_n"] is not None:
        rows = sample_exact(rows, policy["sample_n"], seed=1)
        if cells is not None:
            cells = cells.join(rows.select("row_id"), "row_id", "left_semi")
    width = policy["width"]
    if width is not None and cells is not None:
        from skein.operators.columns import resize_features

        cells = resize_features(cells, width).drop("width")
    return rows, cells, width


# ------------------------------------------------------------------ B3
def split_ordered(rows: DataFrame, test_size: float = 0.2) -> DataFrame:
    """Unshuffled split: the last ceil(test_size * m) rows by row_id are test.

    Adds ``split`` = 'train' | 'test'.
    """
    stats = column_range(rows, "row_id")
    m = stats["n"]
    n_test = int(math.ceil(test_size * m))
    n_train = m - n_test
    if n_train <= 0:
        return rows.withColumn("split", F.lit("test"))
    cut, _ = kth_smallest(rows, "row_id", n_train, stats)
    return rows.withColumn("split", F.when(F.col("row_id") <= cut, F.lit("train")).otherwise(F.lit("test")))


# ------------------------------------------------------------------ B4
def normalise_labels(rows: DataFrame, mode: str = "binary") -> DataFrame:
    """Label normalisation.

    mode 'binary': if -1 occurs among train labels, every label != 1 becomes 0
                   (train and test alike); otherwise labels are unchanged.
    mode 'minus':  only -1 becomes 0.
    Expects a ``split`` column for mode 'binary' (all rows count as train
    when it is absent).
    """
    if mode == "minus":
        return rows.withColumn("label", F.when(F.col("label") == -1, F.lit(0)).otherwise(F.col("label")))
    train = rows.where(F.col("split") == "train") if "split" in rows.columns else rows
    has_neg = train.agg(F.coalesce(F.bool_or(F.col("label") == -1), F.lit(False)).alias("b")).collect()[0]["b"]
    if not has_neg:
        return rows
    return rows.withColumn("label", F.when(F.col("label") == 1, F.lit(1)).otherwise(F.lit(0)))


# ------------------------------------------------------------------ B5, B6
def label_domain(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("label").isNotNull()).select("label").distinct().orderBy("label")


def ovr_relabel(rows: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One copy of each row per positive label: y = 1 if label = L else 0.
    ``labels`` (label) are by default those of the rows; they travel to the
    rows as one array, whatever their number."""
    labels = label_domain(rows) if labels is None else labels
    one = F.pmod(F.hash("row_id"), F.lit(1))  # the same for all rows
    table = labels.agg(F.sort_array(F.collect_set(F.col("label").cast("int"))).alias("_labels")).withColumn("_one", F.pmod(F.hash("_labels"), F.lit(1)))
    out = rows.withColumn("_one", one).join(F.broadcast(table), "_one").withColumn("pos_label", F.explode("_labels")).drop("_one", "_labels")
    return out.withColumn("y", F.when(F.col("label") == F.col("pos_label"), F.lit(1)).otherwise(F.lit(0)))


# ------------------------------------------------------------------ B7, B8
def assign_batches(rows: DataFrame, batch_size: int) -> DataFrame:
    """Contiguous batches of ``batch_size`` rows in row_id order; the last
    batch keeps the remainder. Adds ``pos`` and ``batch_id``."""
    pos = global_position(rows, "row_id")
    return pos.withColumn("batch_id", F.floor(F.col("pos") / F.lit(batch_size)).cast("int"))


def batch_sizes(batched: DataFrame) -> DataFrame:
    return batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("batch_rows"))


def shuffle_batches(batch_ids: DataFrame, epochs: int, seed: int = 1) -> DataFrame:
    """Visit order of batches per epoch: epoch 1 in natural order, each later
    epoch in the order of h32(seed:epoch:batch_id), ties by batch_id."""
    ep = batch_ids.select("batch_id", F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("epoch"))
    key = F.when(F.col("epoch") == 1, F.col("batch_id").cast("bigint")).otherwise(h32(F.lit(seed), F.col("epoch"), F.col("batch_id")))
    n_batches = batch_ids.count()
    # every epoch holds all batches, so an epoch starts at (epoch-1)*n_batches
    ranked = global_position(ep.withColumn("_key", key), ["epoch", "_key", "batch_id"])
    visit = F.col("pos") - (F.col("epoch") - 1) * F.lit(n_batches)
    return ranked.select("epoch", "batch_id", visit.cast("int").alias("visit"))
