"""Scoring, accuracy per epoch and leaderboards (H1-H4).

A row is scored as one sparse vector times the matrix of all (model, epoch)
weights, in tiles of rows and keys: a task holds the weights of some keys at a
time (``KEY_BYTES``) and returns what is asked for, which is scores, one arg-max
per row and epoch, or only the number of hits. Where the labels of an epoch are
in several groups of keys, each gives its best and Spark takes the best of
those. Products of cells and weights are
never rows. Where one key's weights alone are too large for a task, cells join
the weights on feature_id instead. Ties go to the lowest label / earliest
epoch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.activation import activation, activation_by_name, activation_np, canonical

BROADCAST_WEIGHT_ROWS = 2_000_000
#: weights that a task holds at once
KEY_BYTES = 64 << 20
#: one key's weights beyond this are joined on feature_id
MAX_KEY_BYTES = 512 << 20


def _keys(weights: DataFrame) -> tuple[list[tuple[int, int]], int]:
    """(model, epoch) pairs in order (M x E of them) and the largest feature."""
    got = weights.groupBy("model_id", "epoch").agg(F.max("feature_id").alias("d")).collect()
    return sorted((r["model_id"], r["epoch"]) for r in got), max((r["d"] for r in got), default=0)


def _groups(keys: list, d: int) -> list[list]:
    """The keys in groups whose weights fit ``KEY_BYTES``."""
    most = max(1, KEY_BYTES // (8 * max(d, 1)))
    return [keys[at:at + most] for at in range(0, len(keys), most)]


def _score_keys(cells: DataFrame, rows: DataFrame, weights: DataFrame, emit, schema: str, by_epoch: bool = False) -> tuple[DataFrame | None, bool]:
    """Union of ``emit(batch, z, keys)`` over groups of keys (None where a key
    is too large), and whether the keys of some epoch are in several groups.
    ``z`` is a rows x keys matrix for a slice of an Arrow batch, ``batch`` that
    slice with row_id and label: a task's arrays depend neither on the rows of
    a batch nor on the number of keys. With ``by_epoch`` keys are in order of
    epochs, otherwise of models."""
    from skein.operators.logistic import _flat, _row_slices, _scores_flat, _ship, vectors_from_cells
    from skein.session import ship_package

    spark = cells.sparkSession
    keys, d = _keys(weights)
    if not keys or d * 8 > MAX_KEY_BYTES:
        return None, False
    if by_epoch:
        keys = sorted(keys, key=lambda k: (k[1], k[0]))
    groups = _groups(keys, d)
    ship_package(spark)
    vec = vectors_from_cells(cells, rows if "label" in rows.columns else rows.withColumn("label", F.lit(None).cast("int")))
    out = None
    for group in groups:
        names = spark.createDataFrame([(m, e, i) for i, (m, e) in enumerate(group)], "model_id long, epoch int, slot int")
        table = weights.join(F.broadcast(names), ["model_id", "epoch"]).select("slot", "feature_id", "w").toArrow()  # KEY_BYTES of weights
        W = np.zeros((d, len(group)))
        W[table.column("feature_id").to_numpy() - 1, table.column("slot").to_numpy()] = table.column("w").to_numpy()
        held = _ship(spark, W, W.nbytes)

        def run(batches, held=held, group=group):
            W = held.value
            for batch in (part for b in batches for part in _row_slices(b, len(group))):
                fi, row_of = _flat(batch, "idx")
                fv, _ = _flat(batch, "val")
                fi, fv = fi.astype(np.int64) - 1, fv.astype(np.float64)
                known = fi < len(W)  # features beyond the weights score nothing
                yield from emit(batch, _scores_flat(batch.num_rows, fi[known], fv[known], row_of[known], W), group)

        part = vec.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out, any(a[-1][1] == b[0][1] for a, b in zip(groups, groups[1:]))


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def scores(cells: DataFrame, rows: DataFrame, weights: DataFrame) -> DataFrame:
    """z(row_id, model_id, epoch) = sum_f x_f * w_f (G1 over snapshots)."""
    import pyarrow as pa

    def emit(batch, z, keys):
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(_column(batch, "row_id").to_numpy(zero_copy_only=False), len(keys))),
            pa.array(np.tile(np.array([k[0] for k in keys], np.int64), n)), pa.array(np.tile(np.array([k[1] for k in keys], np.int32), n)),
            pa.array(z.ravel())], names=["row_id", "model_id", "epoch", "z"])

    out, _ = _score_keys(cells, rows, weights, emit, "row_id long, model_id long, epoch int, z double")
    return _joined_scores(cells, rows, weights) if out is None else out


def _joined_scores(cells: DataFrame, rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores by a join on feature_id; rows without cells through zero markers."""
    keys, _ = _keys(weights)
    pairs = F.array(*[F.struct(F.lit(m).cast("bigint").alias("model_id"), F.lit(e).cast("int").alias("epoch")) for m, e in keys])
    pairs = pairs.cast("array<struct<model_id:bigint,epoch:int>>")
    contrib = cells.join(weights.select("model_id", "epoch", "feature_id", "w"), "feature_id").select(
        "row_id", "model_id", "epoch", (F.col("value") * F.col("w")).alias("z"))
    marks = rows.select("row_id", F.explode(pairs).alias("k")).select("row_id", "k.model_id", "k.epoch", F.lit(0.0).alias("z"))
    return contrib.unionByName(marks).groupBy("row_id", "model_id", "epoch").agg(F.sum("z").alias("z"))


def _hits(batch, good, n_keys, keys, names):
    """One row per key: hits and rows of the batch."""
    import pyarrow as pa

    ids = [pa.array(np.array([k[i] for k in keys], t)) for i, t in ((0, np.int64), (1, np.int32))][2 - len(names):]
    return pa.RecordBatch.from_arrays([*ids, pa.array(good.sum(axis=0).astype(np.int64)), pa.array(np.full(n_keys, batch.num_rows, np.int64))],
                                      names=[*names, "hits", "n"])


def _labels(batch) -> np.ndarray:
    return _column(batch, "label").cast("double").to_numpy(zero_copy_only=False)


def binary_accuracy(cells: DataFrame, rows: DataFrame, weights: DataFrame, act: str | dict[int, str]) -> DataFrame:
    """(model_id, epoch, accuracy, n_rows) of binary models on labelled rows:
    the share with (act(z) >= 0.5) = label. ``act`` may name one activation
    per model. Only hits per Arrow batch, model and epoch are shuffled."""
    acts = {m: canonical(a) for m, a in act.items()} if isinstance(act, dict) else canonical(act)

    def emit(batch, z, keys):
        yhat = np.stack([activation_np(z[:, i].copy(), acts[m] if isinstance(acts, dict) else acts) for i, (m, _) in enumerate(keys)], axis=1)
        yield _hits(batch, (yhat >= 0.5) == _labels(batch)[:, None], len(keys), keys, ["model_id", "epoch"])

    part, _ = _score_keys(cells, rows, weights, emit, "model_id long, epoch int, hits long, n long")
    if part is None:
        z = _joined_scores(cells, rows, weights).join(rows.select("row_id", "label"), "row_id")
        name = F.create_map(*[F.lit(x) for kv in acts.items() for x in kv])[F.col("model_id")] if isinstance(acts, dict) else F.lit(acts)
        good = F.when(activation_by_name(F.col("z"), name) >= 0.5, 1).otherwise(0) == F.col("label")
        part = z.select("model_id", "epoch", F.coalesce(good, F.lit(False)).cast("long").alias("hits"), F.lit(1).cast("long").alias("n"))
    return part.groupBy("model_id", "epoch").agg((F.sum("hits") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n_rows"))


def ovr_predictions(cells: DataFrame, rows: DataFrame, weights: DataFrame, act: str, clip: bool = False) -> DataFrame:
    """(row_id, epoch, pred): arg-max of the activated score over the models
    (model_id = label), ties -> lowest label; ``clip`` maps negative scores to
    0 first (H2)."""
    import pyarrow as pa

    def emit(batch, z, keys):
        epochs, pred, p = _argmax(z, keys, act, clip)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(_column(batch, "row_id").to_numpy(zero_copy_only=False), len(epochs))),
            pa.array(np.tile(np.array(epochs, np.int32), batch.num_rows)), pa.array(pred.ravel()), pa.array(p.ravel())], names=["row_id", "epoch", "pred", "p"])

    out, cut = _score_keys(cells, rows, weights, emit, "row_id long, epoch int, pred long, p double", by_epoch=True)
    if out is None:
        return predict_ovr(_joined_scores(cells, rows, weights), act, clip)
    if cut:  # the best of an epoch's groups of labels
        out = out.groupBy("row_id", "epoch").agg(F.max_by("pred", F.struct("p", -F.col("pred"))).alias("pred"))
    return out.select("row_id", "epoch", "pred")


def _argmax(z, keys, act, clip):
    """Epochs, and per row and epoch the best label of the keys and its score."""
    p = activation_np(z, canonical(act))
    if clip:
        p = np.maximum(p, 0.0)
    epochs = sorted({e for _, e in keys})
    pred, best = np.empty((len(z), len(epochs)), np.int64), np.empty((len(z), len(epochs)))
    for i, e in enumerate(epochs):
        cols = [j for j, k in enumerate(keys) if k[1] == e]  # labels ascend
        top = np.argmax(p[:, cols], axis=1)
        pred[:, i] = np.array([keys[j][0] for j in cols])[top]
        best[:, i] = p[:, cols][np.arange(len(z)), top]
    return epochs, pred, best


def ovr_epoch_accuracy(cells: DataFrame, rows: DataFrame, weights: DataFrame, act: str, clip: bool = False) -> DataFrame:
    """(epoch, accuracy) of one-vs-rest models; only hits are shuffled, unless
    the labels of an epoch are too many for one task."""

    def emit(batch, z, keys):
        epochs, pred, _ = _argmax(z, keys, act, clip)
        yield _hits(batch, pred == _labels(batch)[:, None], len(epochs), [(0, e) for e in epochs], ["epoch"])

    part, cut = _score_keys(cells, rows, weights, emit, "epoch int, hits long, n long", by_epoch=True)
    if part is None or cut:
        return ovr_accuracy(ovr_predictions(cells, rows, weights, act, clip), rows)
    return part.groupBy("epoch").agg((F.sum("hits") / F.sum("n")).alias("accuracy"))


def mark_best(acc: DataFrame) -> DataFrame:
    """``acc`` (a row per epoch) with ``is_best`` 1 on the first best epoch."""
    order = Window.orderBy(F.col("accuracy").desc(), "epoch")
    return acc.withColumn("is_best", F.when(F.row_number().over(order) == 1, 1).otherwise(0))


def predict_binary(z: DataFrame, rows: DataFrame, act: str) -> DataFrame:
    """Per row: yhat = act(z), pred = 1 if yhat >= 0.5 else 0 (H1)."""
    yhat = activation(F.col("z"), act)
    return z.join(rows.select("row_id", "label"), "row_id").select(
        "row_id", "model_id", "epoch", "z", yhat.alias("yhat"),
        F.when(yhat >= 0.5, F.lit(1)).otherwise(F.lit(0)).alias("pred"), "label")


def accuracy(pred: DataFrame) -> DataFrame:
    return pred.groupBy("model_id", "epoch").agg(
        F.avg(F.when(F.col("pred") == F.col("label"), F.lit(1.0)).otherwise(F.lit(0.0))).alias("accuracy"),
        F.count(F.lit(1)).alias("n_rows"))


def predict_ovr(z: DataFrame, act: str | None = None, clip: bool = False, act_col: str | None = None) -> DataFrame:
    """Arg-max of the activated score over positive labels (model_id = label),
    ties -> lowest label; ``clip`` maps negative scores to 0 first (H2)."""
    p = activation(F.col("z"), act) if act_col is None else activation_by_name(F.col("z"), F.col(act_col))
    if clip:
        p = F.greatest(p, F.lit(0.0))
    return z.withColumn("p", p).groupBy("row_id", "epoch").agg(
        F.max_by("model_id", F.struct(F.col("p"), -F.col("model_id"))).alias("pred"))


def ovr_accuracy(pred: DataFrame, rows: DataFrame) -> DataFrame:
    j = pred.join(rows.select("row_id", "label"), "row_id")
    return j.groupBy("epoch").agg(
        F.avg(F.when(F.col("pred") == F.col("label"), F.lit(1.0)).otherwise(F.lit(0.0))).alias("accuracy"))


def best_epoch(acc: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Best accuracy and the first epoch reaching it (H3)."""
    by = by or []
    return acc.groupBy(*by).agg(
        F.max("accuracy").alias("best_acc"),
        F.max_by("epoch", F.struct(F.col("accuracy"), -F.col("epoch"))).alias("best_epoch"))


def leaderboard(runs: DataFrame) -> DataFrame:
    """Rank runs by best accuracy, ties kept with the same rank (H4); runs
    without an accuracy share the rank after all others.

    The dense rank is the range-partitioned position of each distinct
    accuracy value (descending), joined back to the runs, so neither the runs
    nor the distinct values are funnelled into one window partition.
    """
    from skein.operators.rows import global_position

    accs = runs.select("best_acc").where(F.col("best_acc").isNotNull()).distinct()
    n = accs.count()
    # dense rank of a distinct value = its position in descending order
    ranked = global_position(accs.withColumn("_neg", -F.col("best_acc")), "_neg").select(
        "best_acc", (F.col("pos") + 1).cast("int").alias("rank"))
    if n <= BROADCAST_WEIGHT_ROWS:
        # broadcast the ranked values: a hot accuracy shared by many runs
        # then costs nothing extra (no skewed shuffle partition)
        ranked = F.broadcast(ranked)
    without = runs.where(F.col("best_acc").isNull()).withColumn("rank", F.lit(n + 1))
    return runs.where(F.col("best_acc").isNotNull()).join(ranked, "best_acc").unionByName(without)
