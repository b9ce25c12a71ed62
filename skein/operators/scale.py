"""Column scalers (D1-D6), public sklearn semantics.

Wide layout: statistics are computed per feature over every row, zeros
included, by one partially-aggregated pass over the exploded rows, and
gathered as one array per split, as long as a row of the matrix; that table
is broadcast back and applied inside codegen. ``fit_on='train'`` fits on train
rows only and applies to every row; ``fit_on='each'`` refits per split (what
the reference does: it calls fit_transform on train and on test).

Long layout: stored cells and the row count give the same statistics with
zeros implicit; scaled cells come back with a table of what an implicit zero
of each feature becomes, so nothing is made dense.

The robust scaler's quartiles come from ``quantiles.py`` (exact order
statistics from one range shuffle), never from a per-feature value map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.hotjoin import join_by_key
from skein.operators.quantiles import quantiles
from skein.session import cut_lineage, write_once

QUARTILES = [0.25, 0.5, 0.75]
#: statistics of the long layout travel to the cells as a broadcast up to so many rows
BROADCAST_FEATURES = 1 << 18
SCALERS = ("mm", "ss", "na", "ma", "rs", "nope", "null")


def _exploded(wide: DataFrame, split_col: str | None) -> DataFrame:
    cols = ["row_id", F.posexplode("features").alias("pos", "value")]
    if split_col:
        cols.insert(1, split_col)
    return wide.select(*cols)


def _fitted(df: DataFrame, fit_on: str) -> DataFrame:
    return df.where(F.col("split") == "train") if fit_on == "train" and "split" in df.columns else df


def _group(fit_on: str) -> Column:
    """What statistics are shared by: the split, or one key for all rows (an
    expression of the row, so that joins on it stay equi-joins)."""
    return F.col("split") if fit_on == "each" else F.pmod(F.hash("row_id"), F.lit(1)).cast("string")


def _stats(wide: DataFrame, aggs: dict[str, Column], fit_on: str) -> DataFrame:
    """(_k, _s): per split (or once) the statistics of every feature in order."""
    per = (_fitted(wide, fit_on).select(_group(fit_on).alias("_k"), F.posexplode("features").alias("pos", "value"))
           .groupBy("_k", "pos").agg(*[c.cast("double").alias(k) for k, c in aggs.items()]))
    return per.groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("pos", *aggs))).alias("_s"))


def _apply(wide: DataFrame, stats: DataFrame, fn, fit_on: str) -> DataFrame:
    """fn(value, statistics of its feature) on every value. The broadcast has
    one row per split, each as long as a row of the matrix."""
    keyed = wide.withColumn("_k", _group(fit_on))
    scaled = F.transform("features", lambda x, i: fn(x, F.get(F.col("_s"), i)))
    return keyed.join(F.broadcast(stats), "_k", "left").withColumn("features", scaled).drop("_k", "_s")


def _or_one(c: Column) -> Column:
    return F.when(c == 0, F.lit(1.0)).otherwise(c)


#: scaler code -> (value, statistics) -> scaled value
_RULES = {
    "mm": lambda x, s: (x - s["lo"]) / _or_one(s["hi"] - s["lo"]),
    "ss": lambda x, s: (x - s["mu"]) / _or_one(s["sd"]),
    "ma": lambda x, s: x / _or_one(s["ma"]),
    "rs": lambda x, s: (x - s["med"]) / _or_one(s["q3"] - s["q1"]),
}


def scale_minmax(wide: DataFrame, fit_on: str = "train") -> DataFrame:
    return _apply(wide, _stats(wide, {"lo": F.min("value"), "hi": F.max("value")}, fit_on), _RULES["mm"], fit_on)


def scale_standard(wide: DataFrame, fit_on: str = "train") -> DataFrame:
    return _apply(wide, _stats(wide, {"mu": F.avg("value"), "sd": F.stddev_pop("value")}, fit_on), _RULES["ss"], fit_on)


def scale_maxabs(wide: DataFrame, fit_on: str = "train") -> DataFrame:
    return _apply(wide, _stats(wide, {"ma": F.max(F.abs("value"))}, fit_on), _RULES["ma"], fit_on)


def scale_robust(wide: DataFrame, fit_on: str = "train") -> DataFrame:
    """(x - median) / (q3 - q1)."""
    values = _fitted(wide, fit_on).select(_group(fit_on).alias("_k"), F.posexplode("features").alias("pos", "value"))
    qs = quantiles(values.select(F.struct("_k", "pos").alias("key"), "value"), "key", "value", QUARTILES)
    s = F.struct(F.col("key.pos").alias("pos"), *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "med", "q3"))])
    stats = qs.groupBy(F.col("key._k").alias("_k")).agg(F.sort_array(F.collect_list(s)).alias("_s"))
    return _apply(wide, stats, _RULES["rs"], fit_on)


def scale_l2_rows(wide: DataFrame) -> DataFrame:
    """Each row divided by its L2 norm; an all-zero row is unchanged."""
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda acc, x: acc + x * x))
    return wide.withColumn("_n", norm).withColumn(
        "features", F.transform("features", lambda x: x / F.when(F.col("_n") == 0, F.lit(1.0)).otherwise(F.col("_n")))
    ).drop("_n")


def scale_l2_rows_long(cells: DataFrame) -> DataFrame:
    """Long layout: zeros stay implicit; norm per row by one grouped pass. A
    row of stored zeros is unchanged."""
    norms = cells.groupBy("row_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_n"))
    return cells.join(norms, "row_id").select("row_id", "feature_id", (F.col("value") / _or_one(F.col("_n"))).alias("value"))


def scale_long(cells: DataFrame, rows: DataFrame, code: str, fit_on: str = "train") -> tuple[DataFrame, DataFrame]:
    """Long-layout ``mm``, ``ss``, ``ma`` or ``rs`` -> (cells, zeros).

    ``rows`` has row_id and, unless all rows fit, split. Features without a
    stored cell are constant zeros and stay so. ``zeros`` (split, feature_id,
    value; split '*' when statistics are shared) tells what an implicit zero
    of a feature becomes; stored zeros are scaled like any cell, and cells of
    a split without statistics of their own (``each``) can't occur. Moments
    are centred: those of the stored cells are merged with the block of
    implicit zeros, so values far from zero keep their digits.
    """
    if code not in _RULES:
        raise ValueError(f"no long form of scaler code {code!r}")
    key = _group(fit_on)
    own = rows.select("row_id", *["split"] * ("split" in rows.columns)).withColumn("_k", key)
    fit = F.col("split") == "train" if fit_on == "train" and "split" in rows.columns else F.lit(True)
    # read twice, for the statistics and to be scaled
    tagged = write_once(cells.select("row_id", "feature_id", "value").join(own.hint("shuffle_hash"), "row_id")
                        .select("_k", "row_id", "feature_id", "value", fit.alias("fit")))
    n = _fitted(own, fit_on).groupBy("_k").agg(F.count(F.lit(1)).alias("n"))  # one row per split
    v, fitted = F.col("value"), F.when(F.col("fit"), F.col("value"))
    per = tagged.groupBy("_k", "feature_id").agg(
        F.min(fitted).alias("lo"), F.max(fitted).alias("hi"), F.avg(fitted).alias("mean"), F.var_pop(fitted).alias("var"), F.max(F.abs(fitted)).alias("ma"),
        F.count_if("fit").alias("c"), F.count(F.lit(1)).alias("cells"))
    some_zero = F.col("c") < F.col("n")
    # moments of c cells and n - c zeros together
    share = F.col("c") / F.col("n")
    var = F.col("var") * share + F.col("mean") * F.col("mean") * share * (F.lit(1.0) - share)
    stats = cut_lineage(per.join(F.broadcast(n), "_k", "left").select(
        "_k", "feature_id", "cells", "c", (F.col("n") - F.col("c")).alias("zeros"),
        F.when(some_zero, F.least("lo", F.lit(0.0))).otherwise(F.col("lo")).alias("lo"),
        F.when(some_zero, F.greatest("hi", F.lit(0.0))).otherwise(F.col("hi")).alias("hi"),
        (F.col("mean") * share).alias("mu"), F.sqrt(var).alias("sd"), "ma"))
    names = ("lo", "hi", "mu", "sd", "ma")
    if code == "rs":
        pair = F.struct("_k", "feature_id").alias("key")
        qs = quantiles(tagged.where("fit").select(pair, "value"), "key", "value", QUARTILES, stats.where("c > 0").select(pair, "zeros"))
        names = ("q1", "med", "q3")
        qs = qs.select("key._k", "key.feature_id", *[F.col("q")[i].alias(x) for i, x in enumerate(names)])
        stats = cut_lineage(stats.select("_k", "feature_id", "cells").join(qs, ["_k", "feature_id"], "left"))
    # a feature that only unfitted rows store: zeros everywhere it was fitted
    stats = stats.select(F.struct("_k", "feature_id").alias("key"), "cells", F.struct(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in names]).alias("s"))
    features, total = stats.agg(F.count(F.lit(1)), F.coalesce(F.sum("cells"), F.lit(0))).first()
    if features <= BROADCAST_FEATURES:
        each = stats.select("key.*", "s")
        found = tagged.join(F.broadcast(each), ["_k", "feature_id"])
    else:
        keyed = tagged.select(F.struct("_k", "feature_id").alias("key"), "row_id", "value")
        found = join_by_key(keyed, stats, "key", "cells", total).select("row_id", "key.feature_id", "value", "s")
    scaled = found.select("row_id", "feature_id", _RULES[code](v, F.col("s")).alias("value"))
    split = F.col("key._k") if fit_on == "each" else F.lit("*")
    zeros = stats.select(split.alias("split"), "key.feature_id", _RULES[code](F.lit(0.0), F.col("s")).alias("value"))
    return scaled, zeros


def scale(wide: DataFrame, code: str | None, fit_on: str = "train") -> DataFrame:
    """Dispatch by the reference's scaler code (mm/ss/na/ma/rs; nope/null = none)."""
    if code in (None, "nope", "null", "none"):
        return wide
    if code == "mm":
        return scale_minmax(wide, fit_on)
    if code == "ss":
        return scale_standard(wide, fit_on)
    if code == "na":
        return scale_l2_rows(wide)
    if code == "ma":
        return scale_maxabs(wide, fit_on)
    if code == "rs":
        return scale_robust(wide, fit_on)
    raise ValueError(f"unknown scaler code {code!r}; expected one of {SCALERS}")
