"""Logistic models trained by mini-batch SGD, many models per pass.

Row vectors are stored sparse-by-row: ``vec(row_id, label, idx ARRAY<INT>,
val ARRAY<DOUBLE>)`` (dense rows simply list every index); the numpy kernels
read them straight from Arrow list buffers (``mapInArrow``).

* Mini-batch: one range shuffle writes the rows, in order, as files in the
  shared folder; a chunk is a range of positions. It streams through one task per group of
  models, which applies the exact update rule batch after batch; a batch that
  the chunk's end cuts is carried over as its partial gradient. Models are
  independent, so their groups read the same chunk side by side. Jobs =
  epochs x chunks; a task holds one Arrow batch and its models' weights.
* Shuffled order of batches: the rows are written once, in order, and an
  epoch is a list of row ranges that its tasks read; nothing is shuffled again.
* Linear models: a batch maps the weights affinely, so every task returns one
  map for its run of chunks, all side by side, and following the maps gives
  every run the weights it starts from; only that follows the order. Two jobs
  an epoch, up to ``MAX_WAVE`` tasks of ``ROWS_PER_CHUNK`` rows.
* Full batch, or batches larger than a chunk: every partition returns one
  partial X^T E and loss sum for all M models, summed by a ``groupBy``; the
  driver applies W <- W - C*alpha*g/B - lambda*alpha*W/B.

Weights up to 1 MB ride in the task closure, larger ones as a Spark
broadcast; beyond ``MAX_BROADCAST_BYTES`` the relational path
(``train_relational``) keeps them as a table joined on feature_id. All paths
return the same ``TrainResult``, whose weights, snapshots, history and steps
are tables with equal columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.activation import activation_np, canonical
from skein.functions.hashing import h32
from skein.operators.hotjoin import join_by_key
from skein.session import cut_lineage, scratch_path, ship_package
from skein.sources.rowranges import RowRanges, write_ranges

# Fixed values (must equal the reference's training rule):
#   Taylor loss per row   (-1/2 z + y z - 1/8 z^2) * (-1/B) - ln(1/2)
#   update                w <- w - C alpha g / B - lambda alpha w / B
#   learning-rate decay   alpha * 0.95 before each batch of an epoch e > 1 with e % 10 == 0
#   convergence           |previous epoch loss - loss| < eps, previous starts at 0
DECAY_FACTOR = 0.95
DECAY_EVERY = 10

MAX_BROADCAST_BYTES = 512 * 1024 * 1024
BROADCAST_WEIGHT_ROWS = 2_000_000
DIRECT_COLLECT_VALUES = 2_000_000   # partitions x d x M partial sums read by the driver
#: rows of a chunk, about; a larger batch is spread over tasks
ROWS_PER_CHUNK = 1 << 18
#: models that one task trains
MODELS_PER_TASK = 16
#: values of the temporary arrays of a task: cells or rows x models
TILE_VALUES = 1 << 20
#: weights of the models that one full-batch task holds
GROUP_BYTES = 64 << 20
#: numbers in the maps of a chunk of linear models: models x width x width
AFFINE_VALUES = 1 << 16
#: tasks whose maps are made at the same time, at most
MAX_WAVE = 256
#: rows of a record in the files of rows in order, and of the Arrow batches that a task takes them in
RECORD_ROWS = 1 << 12
READ_ROWS, READ_BYTES = 1 << 14, 1 << 24
INLINE_WEIGHT_BYTES = 1 << 20
LN_HALF = math.log(0.5)


@dataclass
class Model:
    model_id: int
    activation: str = "linear"
    alpha: float = 0.01
    lambda_para: float = 0.0
    c: float = 1.0
    penalty: str = "always"          # always (lambda term always applied) | l2 | l1 | none
    pos_label: int | None = None     # None: binary label as given (0/1)


#: snapshots of one training that the driver keeps; later ones are written as tables
SNAPSHOT_BYTES = 64 << 20
#: step records that the driver keeps before it writes them as a table
STEP_RECORDS = 1 << 19

_STEPS = "model_id long, epoch int, batch_id long, batch_loss double, alpha double"


class TrainResult:
    """Weights, snapshots, history and steps of one training.

    ``weights`` (model_id, feature_id, w) and ``snapshots_frame`` (with epoch)
    are DataFrames whatever the size of the model, and have a row for every
    model and feature; ``history`` has one record per (epoch, model), and
    ``steps_frame`` one row per (epoch, batch, model).
    """

    def __init__(self, spark, models: list[Model], width: int):
        self.spark, self.models, self.width = spark, models, width
        self.history: list[dict] = []
        self.epochs: list[int] = []
        self._arrays: dict[int, tuple[list[int], np.ndarray]] = {}  # models (by place) and their weights
        self._tables: dict[int, DataFrame] = {}
        self._final = None
        self._steps: list[pd.DataFrame] = []
        self._written_steps: str | None = None

    # -- weights
    def _melt(self, arrays: dict[int, tuple[list[int], np.ndarray]]) -> DataFrame:
        parts = [pd.DataFrame({
            "model_id": np.repeat([self.models[i].model_id for i in own], self.width).astype(np.int64), "epoch": np.full(W.size, e, np.int32),
            "feature_id": np.tile(np.arange(1, self.width + 1), len(own)).astype(np.int32), "w": W.T.reshape(-1)}) for e, (own, W) in arrays.items()]
        return self.spark.createDataFrame(pd.concat(parts, ignore_index=True), "model_id long, epoch int, feature_id int, w double")

    def _dense(self, table: DataFrame, epoch: int, own: list[int]) -> DataFrame:
        """A row for every feature, also those that no step has touched."""
        ids = F.array(*[F.lit(self.models[i].model_id).cast("bigint") for i in own])
        grid = self.spark.range(1, self.width + 1).select(F.explode(ids).alias("model_id"), F.col("id").cast("int").alias("feature_id"))
        return grid.join(table, ["model_id", "feature_id"], "left").select(
            "model_id", F.lit(epoch).cast("int").alias("epoch"), "feature_id", F.coalesce("w", F.lit(0.0)).alias("w"))

    def keep(self, epoch: int, W, last: bool, snapshot: bool, live: list[int]) -> None:
        """Weights after an epoch; the snapshot has the models (by place) that
        were trained in it, the final weights all of them."""
        if snapshot:
            self.epochs.append(epoch)
            if isinstance(W, DataFrame):
                own = W.where(F.col("model_id").isin([self.models[i].model_id for i in live]))
                self._tables[epoch] = self._dense(own, epoch, live)
            elif (len(self._arrays) + 1) * W.nbytes <= SNAPSHOT_BYTES:
                self._arrays[epoch] = (live, W[:, live])
            else:
                path = scratch_path(self.spark, "weights")
                self._melt({epoch: (live, W[:, live])}).write.parquet(path)
                self._tables[epoch] = self.spark.read.parquet(path)
        if last:
            every = list(range(len(self.models)))
            self._final = self._dense(W, epoch, every) if isinstance(W, DataFrame) else W.copy()

    @property
    def weights(self) -> DataFrame:
        """Final weights (model_id, feature_id, w)."""
        final = self._final if isinstance(self._final, DataFrame) else self._melt({0: (list(range(len(self.models))), self._final)})
        return final.select("model_id", "feature_id", "w")

    def snapshots_frame(self, epochs: list[int] | None = None) -> DataFrame:
        """(model_id, epoch, feature_id, w) of the kept epochs, or some of them."""
        epochs = self.epochs if epochs is None else list(epochs)
        inline = {e: self._arrays[e] for e in epochs if e in self._arrays}
        parts = ([self._melt(inline)] if inline else []) + [self._tables[e] for e in epochs if e in self._tables]
        if not parts or len(inline) + len(parts) - bool(inline) != len(epochs):
            raise KeyError(f"no snapshot of some epoch of {epochs}")
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x)
        return out

    def matrix(self, epoch: int | None = None) -> np.ndarray:
        """Weights as a width x models array on the driver, for small models;
        zeros where a model had stopped before the epoch."""
        table = self.weights if epoch is None else self.snapshots_frame([epoch])
        if self.width * len(self.models) * 8 > SNAPSHOT_BYTES:
            raise ValueError("too large for the driver: use the weights table")
        at = {m.model_id: i for i, m in enumerate(self.models)}
        out = np.zeros((self.width, len(self.models)))
        for r in table.collect():
            out[r["feature_id"] - 1, at[r["model_id"]]] = r["w"]
        return out

    # -- steps
    def add_steps(self, model_id, epoch, batch_id, loss, alpha) -> None:
        self._steps.append(pd.DataFrame({"model_id": np.asarray(model_id, np.int64), "epoch": np.full(len(model_id), epoch, np.int32),
                                         "batch_id": np.asarray(batch_id, np.int64), "batch_loss": np.asarray(loss, float), "alpha": np.asarray(alpha, float)}))
        if sum(map(len, self._steps)) > STEP_RECORDS:
            self._written_steps = self._written_steps or scratch_path(self.spark, "steps")
            self._step_table().write.mode("append").parquet(self._written_steps)
            self._steps = []

    def _step_table(self) -> DataFrame:
        import pyarrow as pa

        held = pd.concat(self._steps)  # a loss that is no number stays so, it is not null
        return self.spark.createDataFrame(pa.table({c: pa.array(held[c].to_numpy(), from_pandas=False) for c in held}), _STEPS)

    def steps_frame(self) -> DataFrame:
        local = self._step_table() if self._steps else None
        written = self.spark.read.parquet(self._written_steps) if self._written_steps else None
        if local is None and written is None:
            return self.spark.createDataFrame([], _STEPS)
        return written if local is None else local if written is None else written.unionByName(local)


# ------------------------------------------------------------------ layout
def vectors_from_wide(wide: DataFrame) -> DataFrame:
    """Dense rows -> (row_id, label, idx 1..d, val)."""
    return wide.select(
        "row_id", "label",
        F.transform("features", lambda x, i: (i + 1).cast("int")).alias("idx"),
        F.col("features").cast("array<double>").alias("val"),
    )


def vectors_from_cells(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """Long cells -> one sparse vector per row (bounded by the row's nnz);
    rows without cells keep empty arrays."""
    per_row = cells.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("feature_id", "value"))).alias("e"))
    j = rows.join(per_row, "row_id", "left")
    e = F.coalesce(F.col("e"), F.array().cast("array<struct<feature_id:int,value:double>>"))
    return j.select("row_id", "label", e.getField("feature_id").cast("array<int>").alias("idx"),
                    e.getField("value").cast("array<double>").alias("val"))


def vectors_from_sketch(sketch: DataFrame, rows: DataFrame, party_width: dict[int, int] | None = None) -> DataFrame:
    """Sketch ones (row_id, party, col) -> vectors over both parties' columns
    (party 2 columns follow party 1's width), value 1.0."""
    off = 0 if not party_width else party_width.get(1, 0)
    cells = sketch.select(
        "row_id",
        (F.col("col") + 1 + F.when(F.col("party") == 2, F.lit(off)).otherwise(F.lit(0))).cast("int").alias("feature_id"),
        F.lit(1.0).alias("value"),
    )
    return vectors_from_cells(cells, rows)


# ------------------------------------------------------------------ numpy kernels
def _targets(labels: np.ndarray, models: list[Model]) -> np.ndarray:
    y = np.empty((len(labels), len(models)))
    for m, mod in enumerate(models):
        y[:, m] = labels if mod.pos_label is None else (labels == mod.pos_label).astype(float)
    return y


def _flat(batch, name: str):
    """(flat values, row index of each value) of a list column, zero-copy."""
    import pyarrow as pa

    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offsets = col.offsets.to_numpy()
    lens = np.diff(offsets)
    return col.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(col)), lens)


def _tiles(n_cells: int, n_models: int):
    """Slices of the cells whose products with all models fit ``TILE_VALUES``."""
    step = max(1, TILE_VALUES // max(n_models, 1))
    return (slice(a, a + step) for a in range(0, n_cells, step))


def _scores_flat(n: int, fi: np.ndarray, fv: np.ndarray, row_of: np.ndarray, W: np.ndarray) -> np.ndarray:
    z = np.zeros((n, W.shape[1]))
    for t in _tiles(len(fi), W.shape[1]):
        np.add.at(z, row_of[t], W[fi[t]] * fv[t][:, None])
    return z


def _add_gradient(g: np.ndarray, fi: np.ndarray, fv: np.ndarray, row_of: np.ndarray, err: np.ndarray) -> None:
    for t in _tiles(len(fi), err.shape[1]):
        np.add.at(g, fi[t], err[row_of[t]] * fv[t][:, None])


def _dense_rows(n: int, width: int, fi: np.ndarray, fv: np.ndarray) -> np.ndarray | None:
    """The values as rows x width, if every row lists all features in order."""
    if len(fi) != n * width or not (fi.reshape(n, width) == np.arange(width)).all():
        return None
    return fv.reshape(n, width)


def _row_slices(batch, n_models: int):
    """Slices of an Arrow batch whose rows x models values fit ``TILE_VALUES``."""
    step = max(1, TILE_VALUES // max(n_models, 1))
    return (batch.slice(a, step) for a in range(0, batch.num_rows, step))


def _activate(z: np.ndarray, models: list[Model]) -> np.ndarray:
    out = np.empty_like(z)
    for m, mod in enumerate(models):
        out[:, m] = activation_np(z[:, m].copy(), mod.activation)
    return out


def _batch_of(batch, W, models):
    """(scores, targets, errors, feature index, values, row of each) of an Arrow batch."""
    fi, row_of = _flat(batch, "idx")
    fv, _ = _flat(batch, "val")
    fi, fv = fi.astype(np.int64) - 1, fv.astype(np.float64)
    labels = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
    z = _scores_flat(batch.num_rows, fi, fv, row_of, W)
    y = _targets(labels, models)
    return z, y, _activate(z, models) - y, fi, fv, row_of


def _losses(z, y, B, gone=None) -> np.ndarray:
    terms = (-0.5 * z + y * z - 0.125 * z * z) * (-1.0 / B) - LN_HALF
    return (terms if gone is None else np.where(gone, 0.0, terms)).sum(axis=0)


class _Keyed:
    """What joins by row_id make of a batch: rows with the same id share their
    scores and gradients, a null id meets no cells, a null label no error."""

    def __init__(self, batch, models: list[Model]):
        ids, label = (batch.column(batch.schema.get_field_index(c)) for c in ("row_id", "label"))
        coded = ids.dictionary_encode()
        self.n, self.code = len(coded.dictionary), coded.indices.fill_null(0).to_numpy(zero_copy_only=False)
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        as_given = np.array([m.pos_label is None for m in models])
        self.gone = label.is_null().to_numpy(zero_copy_only=False)[:, None] & as_given
        self.unique = self.n + self.no_id.sum() == len(ids)

    def total(self, x: np.ndarray) -> np.ndarray:
        x = np.where(self.no_id[:, None], 0.0, x)
        if self.unique:
            return x
        sums = np.zeros((self.n, x.shape[1]))
        np.add.at(sums, self.code, x)
        return np.where(self.no_id[:, None], 0.0, sums[self.code])


def _step_fn(models: list[Model], w_bc, B: int, first: int = 0):
    """mapInArrow body: gradient and loss of one batch, once per partition.

    Reads the sparse rows straight from Arrow list buffers (flat values and
    offsets), so the work is vectorised numpy with no per-row loop.
    """
    import pyarrow as pa

    def run(batches):
        W = w_bc.value
        g, loss, rows = np.zeros(W.shape), np.zeros(len(models)), 0
        for batch in batches:
            for part in _row_slices(batch, len(models)):
                z, y, err, fi, fv, row_of = _batch_of(part, W, models)
                _add_gradient(g, fi, fv, row_of, err)
                loss += _losses(z, y, B)
                rows += part.num_rows
        if rows:
            nz_f, nz_m = np.nonzero(g)
            yield pa.RecordBatch.from_arrays([
                pa.array((first + np.concatenate([nz_m, np.arange(len(models))])).astype(np.int32)),
                pa.array(np.concatenate([nz_f + 1, np.zeros(len(models), dtype=np.int64)]).astype(np.int32)),
                pa.array(np.concatenate([g[nz_f, nz_m], loss]).astype(np.float64)),
            ], names=["model", "feature_id", "g"])

    return run


# kinds of rows that a streaming task returns
_LOSS, _WEIGHT, _ALPHA, _GRADIENT, _PARTIAL, _ROWS = range(6)
_STREAM = "kind int, model int, batch_id long, feature_id int, v double, alpha double"


def _stream_fn(models: list[Model], first: int, state, epoch: int, decay: bool, batch_size: int, n_rows: int, ids: bool, keyed: bool = False):
    """mapInArrow body: the rows of one chunk, in order, for models ``first``
    on. Applies the update whenever a batch is complete, and returns the
    batches' losses, the weights and what belongs to an unfinished batch. With
    ``keyed`` every Arrow batch is one whole batch, scored as joins on row_id do."""
    import pyarrow as pa

    def run(batches):
        s = state.value
        W, alphas, g, loss = (np.array(s[k], copy=True) for k in ("W", "alphas", "g", "loss"))
        seen, pos, M = s["seen"], s["pos"], len(models)
        out = []

        def emit(kind, model, batch, feature, v, a):
            n = len(model)
            out.append((np.full(n, kind), model + first, np.full(n, batch), feature, v, a))

        every, none = np.arange(M), np.zeros(M)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fi_all, row_all = _flat(batch, "idx")
            fv_all, _ = _flat(batch, "val")
            fi_all, fv_all = fi_all.astype(np.int64) - 1, fv_all.astype(np.float64)
            dense = _dense_rows(n, W.shape[0], fi_all, fv_all)
            cut = np.searchsorted(row_all, np.arange(n + 1)) if dense is None else None
            y_all = _targets(batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float), models)
            own = batch.column(batch.schema.get_field_index("batch_id")).to_numpy(zero_copy_only=False) if ids else None
            keys = _Keyed(batch, models) if keyed else None
            i = 0
            while i < n:
                b = int(own[i]) if ids else pos // batch_size
                B = min(batch_size, n_rows - b * batch_size)
                j = min(n, i + B - seen)
                y = y_all[i:j]
                if dense is not None:
                    z = dense[i:j] @ W
                else:
                    fi, fv, row_of = fi_all[cut[i]:cut[j]], fv_all[cut[i]:cut[j]], row_all[cut[i]:cut[j]] - i
                    z = _scores_flat(j - i, fi, fv, row_of, W)
                if keys is not None:
                    z = keys.total(z)
                err = _activate(z, models) - y
                if keys is not None:
                    err = keys.total(np.where(keys.gone, 0.0, err))
                if dense is not None:
                    g += dense[i:j].T @ err
                else:
                    _add_gradient(g, fi, fv, row_of, err)
                loss += _losses(z, y, B, None if keys is None else keys.gone)
                seen, pos, i = seen + j - i, pos + j - i, j
                if seen == B:
                    if decay and epoch > 1 and epoch % DECAY_EVERY == 0:
                        alphas = alphas * DECAY_FACTOR
                    W = _update(W, g, B, models, alphas)
                    emit(_LOSS, every, b, none, loss, alphas)
                    g, loss, seen = np.zeros(W.shape), np.zeros(M), 0
        for kind, x in ((_WEIGHT, W), (_GRADIENT, g)):
            f, m = np.nonzero(x)
            emit(kind, m, 0, f + 1, x[f, m], np.zeros(len(m)))
        emit(_ALPHA, every, 0, none, alphas, none)
        emit(_PARTIAL, every, 0, none, loss, none)
        emit(_ROWS, every, 0, none, np.full(M, float(pos)), np.full(M, float(seen)))
        cols = [np.concatenate(c) for c in zip(*out)]
        kinds = (np.int32, np.int32, np.int64, np.int32, np.float64, np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(cols, kinds)],
                                         names=["kind", "model", "batch_id", "feature_id", "v", "alpha"])

    return run


class _Inline:
    """Small values travel inside the task closure; large ones as a broadcast."""

    def __init__(self, value):
        self.value = value

    def unpersist(self):
        pass


def _ship(spark, value, nbytes: int):
    return _Inline(value) if nbytes <= INLINE_WEIGHT_BYTES else spark.sparkContext.broadcast(value)


@dataclass
class Prepared:
    """Rows laid out for training: ``mode`` full (one batch), stream (chunks
    in row order), ranges (batches in any order) or steps (a folder per batch)."""

    mode: str
    data: DataFrame | RowRanges
    n_rows: int
    batch_size: int
    chunks: int = 0
    chunk_rows: int = 0

    @property
    def n_batches(self) -> int:
        return max(1, -(-self.n_rows // self.batch_size))

    def size(self, batch: int) -> int:
        """Rows of a batch: all have ``batch_size`` but the last."""
        return min(self.batch_size, self.n_rows - batch * self.batch_size)


def _files(spark, n: int, rows_per_chunk: int) -> int:
    """Files for ``n`` rows in order: small tasks, but not one per small chunk."""
    chunks = max(1, -(-n // rows_per_chunk))
    return max(-(-n // ROWS_PER_CHUNK), min(chunks, spark.sparkContext.defaultParallelism))


def _in_chunks(vec: DataFrame, n: int, rows_per_chunk: int) -> tuple[RowRanges, int]:
    """The rows in row order as files in the shared folder, by one shuffle; a
    chunk is a range of positions."""
    data = write_ranges(vec.select("row_id", "label", "idx", "val"), "row_id", _files(vec.sparkSession, n, rows_per_chunk), min(RECORD_ROWS, rows_per_chunk))
    return data, max(1, -(-n // rows_per_chunk))


def prepare(vec: DataFrame, batch_size: int, rows_per_chunk: int | None = None, shuffled: bool = False) -> Prepared:
    """Lay the rows out for batches of ``batch_size`` in row_id order (B7),
    visited in that order or, if ``shuffled``, in any.

    Batches are contiguous in row order, so every batch has ``batch_size``
    rows except the last (the remainder); sizes follow from the row count.
    """
    from skein.operators.rows import assign_batches

    spark = vec.sparkSession
    n = vec.count()
    if batch_size >= n:
        want = max(1, -(-n // ROWS_PER_CHUNK))
        spread = vec if vec.rdd.getNumPartitions() >= want else vec.repartition(want)
        return Prepared("full", spread.persist(StorageLevel.MEMORY_AND_DISK), n, max(batch_size, 1))
    if batch_size <= ROWS_PER_CHUNK and shuffled:
        # records of a quarter of a batch: of five that a batch may touch, four are its own
        data = write_ranges(vec.select("row_id", "label", "idx", "val"), "row_id", _files(spark, n, rows_per_chunk or ROWS_PER_CHUNK), max(1, min(RECORD_ROWS, batch_size // 4)))
        return Prepared("ranges", data, n, batch_size)
    if batch_size <= ROWS_PER_CHUNK:
        size = rows_per_chunk or ROWS_PER_CHUNK
        data, chunks = _in_chunks(vec, n, size)
        return Prepared("stream", data, n, batch_size, chunks, size)
    path = scratch_path(spark, "batches")
    assign_batches(vec, batch_size).drop("pos").write.partitionBy("batch_id").parquet(path)
    return Prepared("steps", spark.read.parquet(path), n, batch_size)


def _update(W: np.ndarray, g: np.ndarray, B: int, models: list[Model], alphas: np.ndarray) -> np.ndarray:
    new = W.copy()
    for m, mod in enumerate(models):
        a = alphas[m]
        step = W[:, m] - mod.c * a * g[:, m] / B
        if mod.penalty in ("always", "l2"):
            step = step - mod.lambda_para * a * W[:, m] / B
        elif mod.penalty == "l1":
            step = step - mod.lambda_para * a * np.sign(W[:, m]) / B
        elif mod.penalty != "none":
            raise ValueError(f"unknown penalty {mod.penalty!r}")
        new[:, m] = step
    return new


def _joined(parts):
    """Record batches of about ``READ_ROWS`` rows from small ones."""
    import pyarrow as pa

    held, rows, size = [], 0, 0
    for part in parts:
        held, rows, size = held + [part], rows + part.num_rows, size + part.nbytes
        if rows >= READ_ROWS or size >= READ_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, rows, size = [], 0, 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _visited(ranges: RowRanges, visits: list[int], batch_size: int):
    """The rows of some batches, in the order of ``visits``, with their batch_id."""
    import pyarrow as pa

    for b in visits:
        for part in ranges.read(b * batch_size, min((b + 1) * batch_size, ranges.n_rows)):
            yield part.append_column("batch_id", pa.array(np.full(part.num_rows, b)))


def _in_order(ranges: RowRanges, visits: list[int], batch_size: int, stream):
    """mapInArrow body: ``stream`` over the rows of the batches visited."""
    return lambda _: stream(_joined(_visited(ranges, visits, batch_size)))


def _between(ranges: RowRanges, start: int, stop: int, stream):
    """mapInArrow body: ``stream`` over the rows at positions start to stop - 1."""
    return lambda _: stream(_joined(ranges.read(start, stop)))


def _epoch_stream(spark, plan: Prepared, visits, rows_per_chunk: int, models, W, alphas, epoch, decay, res):
    """One epoch over chunks in order: one job per chunk, one task per group
    of models in it. A chunk is a range of positions or, in mode ranges, a
    stretch of the batches in the order of ``visits``."""
    width, M = W.shape
    groups = [(i, models[i:i + MODELS_PER_TASK]) for i in range(0, M, MODELS_PER_TASK)]
    g, loss, losses, seen, pos = np.zeros(W.shape), np.zeros(M), np.zeros(M), 0, 0
    ids = plan.mode == "ranges"
    size = max(1, rows_per_chunk // plan.batch_size)  # batches
    visits = iter(visits)
    for c in range(-(-plan.n_batches // size) if ids else plan.chunks):
        own = list(islice(visits, size)) if ids else None
        start, stop = c * plan.chunk_rows, min((c + 1) * plan.chunk_rows, plan.data.n_rows)
        shipped, job = [], None
        for i, part in groups:
            cols = slice(i, i + len(part))
            state = {"W": W[:, cols], "alphas": alphas[cols], "g": g[:, cols], "loss": loss[cols], "seen": seen, "pos": pos}
            shipped.append(_ship(spark, state, 2 * W[:, cols].nbytes))
            stream = _stream_fn(part, i, shipped[-1], epoch, decay, plan.batch_size, plan.n_rows, ids)
            body = _in_order(plan.data, own, plan.batch_size, stream) if ids else _between(plan.data, start, stop, stream)
            one = spark.range(0, 1, 1, 1).mapInArrow(body, _STREAM)
            job = one if job is None else job.unionByName(one)
        got = job.toArrow()  # per model: its weights, a loss per batch
        for x in shipped:
            x.unpersist()
        kind, model, batch, feature, v, a = (got.column(k).to_numpy() for k in ("kind", "model", "batch_id", "feature_id", "v", "alpha"))
        at = {k: kind == k for k in range(6)}
        W, g, alphas, loss = np.zeros(W.shape), np.zeros(W.shape), alphas.copy(), np.zeros(M)
        W[feature[at[_WEIGHT]] - 1, model[at[_WEIGHT]]] = v[at[_WEIGHT]]
        g[feature[at[_GRADIENT]] - 1, model[at[_GRADIENT]]] = v[at[_GRADIENT]]
        alphas[model[at[_ALPHA]]] = v[at[_ALPHA]]
        loss[model[at[_PARTIAL]]] = v[at[_PARTIAL]]
        pos, seen = int(v[at[_ROWS]][0]), int(a[at[_ROWS]][0])
        done = at[_LOSS]
        np.add.at(losses, model[done], v[done])
        ids_of = np.array([m.model_id for m in models])
        res.add_steps(ids_of[model[done]], epoch, batch[done], v[done], a[done])
    if pos != plan.n_rows or seen:
        raise RuntimeError(f"an epoch of {plan.n_rows} rows read {pos}")
    return W, alphas, losses


# ------------------------------------------------------------------ linear models: affine maps
def _affine(models: list[Model], width: int) -> bool:
    """Whether a batch maps the weights affinely, and the maps are small."""
    return width * width * len(models) <= AFFINE_VALUES and all(m.activation == "linear" and m.penalty != "l1" for m in models)


class _Sums:
    """What a batch's update and loss need of its rows: their number, X'X,
    the sum of x, and X'y per model."""

    def __init__(self, width: int, n_models: int):
        self.n, self.gram, self.x, self.xy = 0, np.zeros((width, width)), np.zeros(width), np.zeros((width, n_models))

    def add(self, other: "_Sums") -> None:
        self.n, self.gram, self.x, self.xy = self.n + other.n, self.gram + other.gram, self.x + other.x, self.xy + other.xy

    def gradient(self, W: np.ndarray) -> np.ndarray:
        return 0.25 * self.gram @ W + 0.5 * self.x[:, None] - self.xy

    def loss(self, W: np.ndarray, B: int) -> np.ndarray:
        zz = (W * (self.gram @ W)).sum(axis=0)
        return (-0.5 * self.x @ W + (self.xy * W).sum(axis=0) - 0.125 * zz) * (-1.0 / B) - self.n * LN_HALF

    def pack(self) -> list[np.ndarray]:
        return [np.array([float(self.n)]), self.gram.ravel(), self.x, self.xy.ravel()]

    @classmethod
    def unpack(cls, flat: np.ndarray, width: int, n_models: int) -> "_Sums":
        out = cls(width, n_models)
        cuts = np.cumsum([1, width * width, width])
        n, gram, x, xy = np.split(flat, cuts)
        out.n, out.gram, out.x, out.xy = int(n[0]), gram.reshape(width, width), x, xy.reshape(width, n_models)
        return out


def _rates(models: list[Model], alphas: np.ndarray, steps: int, B: int) -> tuple[np.ndarray, np.ndarray]:
    """Step per gradient and shrinkage of the weights, after ``steps`` decays."""
    a = alphas * DECAY_FACTOR ** steps
    lam = np.array([m.lambda_para if m.penalty in ("always", "l2") else 0.0 for m in models])
    return np.array([m.c for m in models]) * a / B, 1.0 - lam * a / B


def _affine_fn(models: list[Model], width: int, run_id: int, start: int, alphas: np.ndarray, decaying: bool, batch_size: int, n_rows: int):
    """mapInArrow body: a run of rows, from row ``start`` on, as one map of
    the weights (matrix and offset per model) over its whole batches, with the
    sums of the rows before and behind them."""
    import pyarrow as pa

    def run(batches):
        M = len(models)
        mats, offset = np.repeat(np.eye(width)[None], M, axis=0), np.zeros((width, M))
        head, sums, pos, closed = _Sums(width, M), _Sums(width, M), start, start % batch_size == 0
        for batch in batches:
            for part in _row_slices(batch, max(width, M)):
                n = part.num_rows
                fi, row_of = _flat(part, "idx")
                fv, _ = _flat(part, "val")
                fi, fv = fi.astype(np.int64) - 1, fv.astype(np.float64)
                X = _dense_rows(n, width, fi, fv)
                if X is None:
                    X = np.zeros((n, width))
                    np.add.at(X, (row_of, fi), fv)
                y = _targets(part.column(part.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float), models)
                i = 0
                while i < n:
                    b = pos // batch_size
                    B = min(batch_size, n_rows - b * batch_size)
                    j = min(n, i + b * batch_size + B - pos)
                    x = X[i:j]
                    sums.n, sums.gram, sums.x, sums.xy = sums.n + j - i, sums.gram + x.T @ x, sums.x + x.sum(axis=0), sums.xy + x.T @ y[i:j]
                    pos, i = pos + j - i, j
                    if pos == b * batch_size + B:
                        if closed:
                            rate, keep = _rates(models, alphas, (b + 1) * decaying, B)
                            mats = keep[:, None, None] * mats - (0.25 * rate)[:, None, None] * (sums.gram @ mats)
                            offset = keep * offset - rate * sums.gradient(offset)
                        else:
                            head, closed = sums, True
                        sums = _Sums(width, M)
        if not closed:  # all rows belong to a batch that began before
            head, sums = sums, _Sums(width, M)
        flat = np.concatenate([np.array([float(closed)]), mats.ravel(), offset.ravel(), *head.pack(), *sums.pack()])
        yield pa.RecordBatch.from_arrays([pa.array([run_id], pa.int32()), pa.array([flat.astype("<f8").tobytes()], pa.binary())], names=["run", "map"])

    return run


def _runs(spark, plan: Prepared) -> list[tuple[int, int]]:
    """Positions of the runs of chunks that tasks take: as many as there are
    cores, or more where a run would pass ``ROWS_PER_CHUNK`` rows."""
    tasks = max(spark.sparkContext.defaultParallelism, -(-plan.n_rows // ROWS_PER_CHUNK))
    size = plan.chunk_rows * max(1, plan.chunks // tasks)
    return [(a, min(a + size, plan.n_rows)) for a in range(0, plan.n_rows, size)]


def _per_run(ranges: RowRanges, runs: list[tuple[int, int]], body):
    """mapInArrow body over run numbers: ``body(i)`` over the rows of each."""

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield from body(i)(_joined(ranges.read(*runs[i])))

    return run


def _epoch_affine(spark, plan: Prepared, models, W, alphas, epoch, decay, res):
    """One epoch of linear models over chunks, all tasks side by side.

    A batch maps the weights affinely, so the batches of a run of chunks are
    one map, made without knowing the weights. One job returns the maps of up
    to ``MAX_WAVE`` runs; following the maps gives the weights at the start of
    every run, and from there a second job streams the runs through the exact
    rule, also side by side, for the losses of their batches."""
    width, M = W.shape
    decaying = bool(decay and epoch > 1 and epoch % DECAY_EVERY == 0)
    pending, losses = _Sums(width, M), np.zeros(M)
    every = _runs(spark, plan)
    W = W.copy()
    ids_of = np.array([m.model_id for m in models])
    batch_size, n_rows = plan.batch_size, plan.n_rows
    for first in range(0, len(every), MAX_WAVE):
        own = every[first:first + MAX_WAVE]
        tasks = spark.range(0, len(own), 1, len(own))

        def mapped(i):
            return _affine_fn(models, width, i, own[i][0], alphas, decaying, batch_size, n_rows)

        maps = tasks.mapInArrow(_per_run(plan.data, own, mapped), "run int, map binary")
        got = {r["run"]: np.frombuffer(r["map"], "<f8") for r in maps.collect()}  # MAX_WAVE x AFFINE_VALUES numbers, about
        states = []
        for i, (start, _) in enumerate(own):
            done = start // batch_size
            B = plan.size(min(done, plan.n_batches - 1))
            states.append({"W": W, "alphas": alphas * DECAY_FACTOR ** (done * decaying), "g": pending.gradient(W) if pending.n else np.zeros(W.shape),
                           "loss": pending.loss(W, B), "seen": pending.n, "pos": start})
            closed, mats, offset, head, tail = np.split(got[i], np.cumsum([1, M * width * width, width * M, 1 + width * width + width + width * M]))
            pending.add(_Sums.unpack(head, width, M))
            if closed[0]:
                if pending.n:
                    rate, keep = _rates(models, alphas, (done + 1) * decaying, B)
                    W = keep * W - rate * pending.gradient(W)
                W = np.einsum("mij,jm->im", mats.reshape(M, width, width), W) + offset.reshape(width, M)
                pending = _Sums.unpack(tail, width, M)
        shipped = _ship(spark, states, 2 * W.nbytes * len(states))

        def streamed(i):
            return _stream_fn(models, 0, _Inline(shipped.value[i]), epoch, decay, batch_size, n_rows, False)

        steps = tasks.mapInArrow(_per_run(plan.data, own, streamed), _STREAM).where(F.col("kind") == _LOSS).toArrow()  # a row per batch and model
        shipped.unpersist()
        model, batch, v, a = (steps.column(k).to_numpy() for k in ("model", "batch_id", "v", "alpha"))
        np.add.at(losses, model, v)
        res.add_steps(ids_of[model], epoch, batch, v, a)
    if pending.n:
        raise RuntimeError(f"an epoch of {plan.n_rows} rows ended inside a batch")
    return W, alphas * DECAY_FACTOR ** (plan.n_batches * decaying), losses


def _epoch_steps(spark, plan: Prepared, models, W, alphas, epoch, decay, res, order=None):
    """One epoch as one distributed job per batch, in ``order`` (of batches)."""
    width, M = W.shape
    losses = np.zeros(M)
    for b in order if order is not None else range(plan.n_batches):
        rows = plan.data if plan.mode == "full" else plan.data.where(F.col("batch_id") == b)
        size = max(1, GROUP_BYTES // (8 * max(width, 1)))
        shipped, part = [], None
        for i in range(0, M, size):
            own = np.ascontiguousarray(W[:, i:i + size])
            shipped.append(_ship(spark, own, own.nbytes))
            one = rows.select("label", "idx", "val").mapInArrow(_step_fn(models[i:i + size], shipped[-1], plan.size(b), i), "model int, feature_id int, g double")
            part = one if part is None else part.unionByName(one)
        if part.rdd.getNumPartitions() * (width + 1) * M > DIRECT_COLLECT_VALUES:
            part = part.groupBy("model", "feature_id").agg(F.sum("g").alias("g"))
        got = part.toArrow()
        for x in shipped:
            x.unpersist()
        model, feature, v = (got.column(k).to_numpy() for k in ("model", "feature_id", "g"))
        g, bl = np.zeros((width, M)), np.zeros(M)
        is_loss = feature == 0
        np.add.at(bl, model[is_loss], v[is_loss])
        np.add.at(g, (feature[~is_loss] - 1, model[~is_loss]), v[~is_loss])
        if decay and epoch > 1 and epoch % DECAY_EVERY == 0:
            alphas = alphas * DECAY_FACTOR
        W = _update(W, g, plan.size(b), models, alphas)
        losses += bl
        res.add_steps([m.model_id for m in models], epoch, np.full(M, b), bl, alphas)
    return W, alphas, losses


def _monitor(res: TrainResult, epoch: int, models: list[Model], loss, prev, eps: float) -> np.ndarray:
    """Records the epoch; which of the models have converged."""
    conv = np.abs(prev - loss) < eps
    for mod, x, c in zip(models, loss.tolist(), conv.tolist()):
        res.history.append({"model_id": mod.model_id, "epoch": epoch, "loss": x, "converged": c, "overflow": math.isnan(x) or math.isinf(x)})
    return conv


def train(vec: DataFrame, width: int, models: list[Model], batch_size: int, max_iter: int,
          snapshot_epochs: int | None = None, eps: float = 1e-6, stop_on_converge: bool = False,
          decay: bool = False, shuffle_seed: int | None = None, prepared: Prepared | None = None,
          rows_per_chunk: int | None = None) -> TrainResult:
    """Train every model in ``models`` together.

    Each model starts from zero weights (one-vs-rest models included). The
    epoch loss is the sum of batch losses over all rows; ``converged`` is
    |previous - loss| < eps with previous starting at 0. With
    ``stop_on_converge`` a model stops after the epoch in which it converges
    itself and takes no part in later passes, so training together equals
    training alone. ``decay`` applies alpha *= 0.95 before every batch update
    of an epoch e > 1 with e % 10 == 0.
    With ``shuffle_seed`` the batches of every epoch but the first are visited
    in the order of ``rows.shuffle_batches``: the rows are written once and
    every epoch reads their ranges; batches above ``ROWS_PER_CHUNK`` rows are
    tables of their own, read in that order. Linear models with few
    enough features take an epoch's chunks side by side (``_epoch_affine``);
    others follow the chunks one by one.
    """
    models = [Model(**{**vars(m), "activation": canonical(m.activation)}) for m in models]
    spark = vec.sparkSession
    ship_package(spark)
    M = len(models)
    if width * M * 8 > MAX_BROADCAST_BYTES:
        return train_relational(vec, width, models, batch_size, max_iter, snapshot_epochs, eps, stop_on_converge, decay, shuffle_seed)
    shuffled = shuffle_seed is not None
    plan = prepared if prepared and not (shuffled and prepared.mode == "stream") else prepare(vec, batch_size, rows_per_chunk, shuffled)
    W, alphas = np.zeros((width, M)), np.array([m.alpha for m in models], dtype=float)
    res, prev, live = TrainResult(spark, models, width), np.zeros(M), list(range(M))
    for epoch in range(1, max_iter + 1):
        own = [models[i] for i in live]
        visits = None if plan.mode == "stream" else _visits(spark, plan.n_batches, epoch, shuffle_seed)
        if plan.mode in ("full", "steps"):
            W[:, live], alphas[live], losses = _epoch_steps(spark, plan, own, W[:, live], alphas[live], epoch, decay, res, visits)
        elif plan.mode == "stream" and plan.chunks > 1 and _affine(own, width):
            W[:, live], alphas[live], losses = _epoch_affine(spark, plan, own, W[:, live], alphas[live], epoch, decay, res)
        else:
            W[:, live], alphas[live], losses = _epoch_stream(spark, plan, visits or (), rows_per_chunk or ROWS_PER_CHUNK, own, W[:, live], alphas[live], epoch, decay, res)
        loss = losses / max(plan.n_rows, 1)
        converged = _monitor(res, epoch, own, loss, prev[live], eps)
        prev[live] = loss
        going = [i for i, c in zip(live, converged) if not (stop_on_converge and c)]
        last = epoch == max_iter or not going
        res.keep(epoch, W, last, epoch <= (max_iter if snapshot_epochs is None else snapshot_epochs), live)
        live = going
        if last:
            break
    if prepared is None and plan.mode == "full":
        plan.data.unpersist()
    return res


# ------------------------------------------------------------------ relational weights
CHECKPOINT_EVERY = 4
#: steps between two passes over the whole table of weights, where a step is a job
BLOCK_STEPS = 16
#: the same where a block streams through one task per group of models, and the weights that such a task may hold
STREAM_STEPS = 256
STREAM_VALUES = 1 << 22
#: a feature with more than 1/HOT_FEATURES of all cells meets its weights by broadcast
HOT_FEATURES = 1000


def train_relational(vec: DataFrame, width: int, models: list[Model], batch_size: int, max_iter: int,
                     snapshot_epochs: int | None = None, eps: float = 1e-6, stop_on_converge: bool = False,
                     decay: bool = False, shuffle_seed: int | None = None) -> TrainResult:
    """Same rule as ``train`` with the weights kept as a table (G9, §4.3 #3).

    Used when d x M is too large to broadcast. The weights that the next
    ``BLOCK_STEPS`` batches can touch, those of features with cells in them,
    are taken out of the table. Where they fit one task per group of models
    (``STREAM_VALUES``), the block's rows, at most ``ROWS_PER_CHUNK``, stream
    through it as in ``train``, up to ``STREAM_STEPS`` batches a job. Else a
    step is a job of its own: it joins the batch's cells with the weights on
    feature_id, sums z per (row, model), forms errors, joins them back on
    row_id and sums gradients per (model, feature). All other weights only
    shrink by the penalty meanwhile; one pass over the table at the block's
    end applies the block's shrinking steps to them in order and puts the
    touched ones back. The rows are written once, in order; a block reads its
    own only. Features with more than a thousandth
    of all cells (a constant column; fewer than a thousand) meet their weights
    by broadcast, so no join key is hot. Only the M loss sums reach the driver;
    lineage is cut every ``CHECKPOINT_EVERY`` steps and with each block.
    """
    from skein.functions.activation import activation_by_name

    spark = vec.sparkSession
    ship_package(spark)
    models = [Model(**{**vars(m), "activation": canonical(m.activation)}) for m in models]
    some = F.filter(F.arrays_zip("idx", "val"), lambda e: e["val"] != 0)  # neither null nor zero
    some = F.coalesce(some, F.array().cast("array<struct<idx:int,val:double>>"))
    vec = vec.select("row_id", "label", some.getField("idx").alias("idx"), some.getField("val").alias("val"))
    n = vec.count()
    data = write_ranges(vec, "row_id", max(1, _files(spark, n, ROWS_PER_CHUNK)), max(1, min(RECORD_ROWS, batch_size // 4)))
    plan = Prepared("ranges", data, n, batch_size)
    every = _cells(_rows_between(spark, plan, [(0, n)], vec.schema))
    n_cells = every.count()
    busy = [r["feature_id"] for r in every.groupBy("feature_id").agg(F.count("*").alias("n")).where(
        F.col("n") * HOT_FEATURES > F.lit(n_cells)).select("feature_id").collect()]  # fewer than HOT_FEATURES
    is_busy = F.array_contains(F.array(*[F.lit(f) for f in busy]).cast("array<int>"), F.col("feature_id"))
    most = every.groupBy("batch_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1  # cells of a batch
    per_task = min(len(models), MODELS_PER_TASK)
    fit = STREAM_VALUES // (per_task * most) if width * per_task > STREAM_VALUES else STREAM_STEPS
    streamed = min(STREAM_STEPS, ROWS_PER_CHUNK // batch_size, fit)  # batches of a block that streams; 0: steps are jobs
    params = spark.createDataFrame(
        [(m.model_id, m.activation, m.alpha, m.lambda_para, m.c, m.penalty, m.pos_label) for m in models],
        "model_id long, act string, alpha double, lam double, c double, penalty string, pos_label int")
    params = F.broadcast(params)  # one row per model
    W = stopped = spark.createDataFrame([], "model_id long, feature_id int, w double")
    res, prev, live = TrainResult(spark, models, width), np.zeros(len(models)), list(range(len(models)))
    slot = {m.model_id: i for i, m in enumerate(models)}
    factor, step_no = 1.0, 0
    for epoch in range(1, max_iter + 1):
        own = [models[i] for i in live]
        mids = F.array(*[F.lit(m.model_id).cast("bigint") for m in own])
        losses = np.zeros(len(models))
        decaying = decay and epoch > 1 and epoch % DECAY_EVERY == 0
        for block in _blocks(_visits(spark, plan.n_batches, epoch, shuffle_seed), streamed or BLOCK_STEPS):
            if streamed:
                touched = cut_lineage(spark.range(0, 1, 1, 1).mapInArrow(_touched_fn(data, block, batch_size), "feature_id int"))
                out = _stream_block(spark, plan, W.join(touched, "feature_id", "left_semi"), own, block, factor, epoch, decay)
                got = out.where(F.col("kind") == _LOSS).select("model", "batch_id", "v", "alpha").toArrow()  # a row per batch and model
                model, batch, v, a = (got.column(k).to_numpy() for k in ("model", "batch_id", "v", "alpha"))
                np.add.at(losses, np.array(live)[model], v)
                res.add_steps(np.array([m.model_id for m in own])[model], epoch, batch, v, a)
                shrink = []
                for b in block:
                    factor *= DECAY_FACTOR if decaying else 1.0
                    shrink.append(factor / plan.size(b))
                near = out.where(F.col("kind") == _WEIGHT).select(mids[F.col("model")].alias("model_id"), "feature_id", F.col("v").alias("w"))
                W = cut_lineage(_far(W, touched, params, shrink).unionByName(near))
                continue
            block_rows = _rows_between(spark, plan, [(b * batch_size, min(n, (b + 1) * batch_size)) for b in block], vec.schema).persist(StorageLevel.MEMORY_AND_DISK)
            rows = block_rows.select("row_id", "batch_id", "label")
            in_block = _cells(block_rows).withColumn("busy", is_busy).persist(StorageLevel.MEMORY_AND_DISK)
            touched = in_block.select("feature_id").distinct()
            near = cut_lineage(W.join(touched, "feature_id", "left_semi"))
            shrink = []  # step size and batch size of each step, for the weights that it doesn't touch
            for b in block:
                B = float(plan.size(b))
                if decaying:
                    factor *= DECAY_FACTOR
                shrink.append(factor / B)
                bc = in_block.where(F.col("batch_id") == b)
                hot = bc.where("busy").join(F.broadcast(near.where(is_busy)), "feature_id")  # HOT_FEATURES x models weights at most
                cold = bc.where("NOT busy").join(near.where(~is_busy), "feature_id")
                z = hot.unionByName(cold).groupBy("row_id", "model_id").agg(F.sum(F.col("value") * F.col("w")).alias("z"))
                grid = rows.where(F.col("batch_id") == b).select("row_id", "label", F.explode(mids).alias("model_id"))
                e = grid.join(z, ["row_id", "model_id"], "left").join(params, "model_id")
                zc = F.coalesce(F.col("z"), F.lit(0.0))
                y = F.when(F.col("pos_label").isNull(), F.col("label").cast("double")).otherwise(
                    F.when(F.col("label") == F.col("pos_label"), F.lit(1.0)).otherwise(F.lit(0.0)))
                e = e.select("row_id", "model_id", (activation_by_name(zc, F.col("act")) - y).alias("err"),
                             ((F.lit(-0.5) * zc + y * zc - F.lit(0.125) * zc * zc) * F.lit(-1.0 / B) - F.lit(LN_HALF)).alias("lr"))
                e = e.persist(StorageLevel.MEMORY_AND_DISK)
                step_loss = np.zeros(len(models))
                for r in e.groupBy("model_id").agg(F.sum("lr").alias("l")).collect():  # M numbers
                    step_loss[slot[r["model_id"]]] = r["l"]
                losses += step_loss
                g = bc.join(e.select("row_id", "model_id", "err"), "row_id").groupBy("model_id", "feature_id").agg(
                    F.sum(F.col("err") * F.col("value")).alias("g"))
                both = near.join(g, ["model_id", "feature_id"], "full_outer").join(params, "model_id")
                w = F.coalesce(F.col("w"), F.lit(0.0))
                move = F.col("c") * F.col("alpha") * F.lit(factor) * F.coalesce(F.col("g"), F.lit(0.0)) / F.lit(B)
                near = both.select("model_id", "feature_id", (_shrunk(w, F.lit(factor / B)) - move).alias("w"))
                step_no += 1
                if step_no % CHECKPOINT_EVERY == 0 or b == block[-1]:
                    near = cut_lineage(near)
                e.unpersist()
                res.add_steps([m.model_id for m in own], epoch, np.full(len(own), b), step_loss[live], [m.alpha * factor for m in own])
            W = cut_lineage(_far(W, touched, params, shrink).unionByName(near))
            in_block.unpersist()
            block_rows.unpersist()
        loss = losses[live] / max(n, 1)
        converged = _monitor(res, epoch, own, loss, prev[live], eps)
        prev[live] = loss
        going = [i for i, c in zip(live, converged) if not (stop_on_converge and c)]
        last = epoch == max_iter or not going
        res.keep(epoch, W.unionByName(stopped), last, epoch <= (max_iter if snapshot_epochs is None else snapshot_epochs), live)
        if len(going) < len(live):
            done = F.col("model_id").isin([models[i].model_id for i in set(live) - set(going)])
            stopped, W = stopped.unionByName(W.where(done)), W.where(~done)
        live = going
        if last:
            break
    return res


def _rows_between(spark, plan: Prepared, spans: list[tuple[int, int]], schema) -> DataFrame:
    """The rows at some spans of positions, with their batch_id, in tasks of
    at most ``ROWS_PER_CHUNK`` rows."""
    import pyarrow as pa

    data, batch_size = plan.data, plan.batch_size
    pieces = [(a, min(a + ROWS_PER_CHUNK, hi)) for lo, hi in spans for a in range(lo, hi, ROWS_PER_CHUNK)]
    names = schema.names

    def run(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                at = pieces[i][0]
                for part in data.read(*pieces[i]):
                    own = np.arange(at, at + part.num_rows, dtype=np.int64) // batch_size
                    at += part.num_rows
                    yield part.select(names).append_column("batch_id", pa.array(own))

    return spark.range(0, len(pieces), 1, max(1, len(pieces))).mapInArrow(run, T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())]))


def _cells(rows: DataFrame) -> DataFrame:
    """A row for every listed value of some rows."""
    return rows.select("row_id", "batch_id", F.posexplode(F.arrays_zip("idx", "val")).alias("_p", "e")).select(
        "row_id", "batch_id", F.col("e.idx").alias("feature_id"), F.col("e.val").alias("value")).where(F.col("value") != 0)


def _whole(data: RowRanges, block: list[int], batch_size: int):
    """One record batch per batch, of ``ROWS_PER_CHUNK`` rows at most."""
    import pyarrow as pa

    for b in block:
        yield from pa.Table.from_batches(list(_visited(data, [b], batch_size))).combine_chunks().to_batches()


def _features(data: RowRanges, block: list[int], batch_size: int) -> np.ndarray:
    """Features that the rows of some batches list, ascending."""
    found = np.zeros(0, np.int64)
    for part in _joined(_visited(data, block, batch_size)):
        found = np.union1d(found, _flat(part, "idx")[0].astype(np.int64))
    return found


def _touched_fn(data: RowRanges, block: list[int], batch_size: int):
    """mapInArrow body: the features of a block."""
    import pyarrow as pa

    return lambda _: iter([pa.RecordBatch.from_pydict({"feature_id": pa.array(_features(data, block, batch_size).astype(np.int32))})])


def _stream_block(spark, plan: Prepared, near: DataFrame, models: list[Model], block: list[int], factor: float, epoch: int, decay: bool) -> DataFrame:
    """The batches of a block in order, one task per group of models: the
    weights of the block's features (``near``) travel to the task as rows.
    Returns losses and new weights as rows of ``_STREAM``."""
    import pyarrow as pa

    data, batch_size, n_rows = plan.data, plan.batch_size, plan.n_rows
    none = spark.range(1).selectExpr("-1L AS model_id", "0 AS feature_id", "0.0D AS w")  # the task runs even if no weight is stored

    def body(first, group):
        ids = np.array([m.model_id for m in group])
        order = np.argsort(ids)

        def run(batches):
            feats = _features(data, block, batch_size)
            W = np.zeros((len(feats), len(group)))
            for batch in batches:
                model, feature, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                real = feature > 0
                W[np.searchsorted(feats, feature[real]), order[np.searchsorted(ids[order], model[real])]] = w[real]

            def rows():
                for part in _whole(data, block, batch_size):
                    at = part.schema.get_field_index("idx")
                    flat, row_of = _flat(part, "idx")
                    offsets = np.concatenate(([0], np.cumsum(np.bincount(row_of, minlength=part.num_rows)))).astype(np.int32)
                    own = pa.ListArray.from_arrays(pa.array(offsets), pa.array((np.searchsorted(feats, flat) + 1).astype(np.int32)))
                    yield part.set_column(at, "idx", own)

            state = {"W": W, "alphas": np.array([m.alpha * factor for m in group]), "g": np.zeros(W.shape), "loss": np.zeros(len(group)), "seen": 0, "pos": 0}
            for out in _stream_fn(group, first, _Inline(state), epoch, decay, batch_size, n_rows, True, True)(rows()):
                kind, feature = (out.column(k).to_numpy() for k in ("kind", "feature_id"))
                feature = np.where(kind == _WEIGHT, feats[np.maximum(feature - 1, 0)] if len(feats) else feature, feature).astype(np.int32)
                yield out.set_column(out.schema.get_field_index("feature_id"), "feature_id", pa.array(feature))

        return run

    job = None
    for i in range(0, len(models), MODELS_PER_TASK):
        group = models[i:i + MODELS_PER_TASK]
        held = near.where(F.col("model_id").isin([m.model_id for m in group])).select("model_id", "feature_id", "w").unionByName(none).coalesce(1)
        one = held.mapInArrow(body(i, group), _STREAM)
        job = one if job is None else job.unionByName(one)
    return cut_lineage(job)


def _far(W: DataFrame, touched: DataFrame, params: DataFrame, shrink: list[float]) -> DataFrame:
    """Weights that a block doesn't touch, after its shrinking steps."""
    return W.join(touched, "feature_id", "left_anti").join(params, "model_id").select(
        "model_id", "feature_id", F.aggregate(F.array(*map(F.lit, shrink)), F.col("w"), _shrunk).alias("w"))


def _blocks(visits, size: int):
    """The batch ids of an epoch in lists of at most ``size``."""
    it = iter(visits)
    while block := list(islice(it, size)):
        yield block


def _shrunk(w, a):
    """A weight after the penalty of one step; ``a`` is the step's decay over
    its batch size, the rest are columns of the model's parameters."""
    pen = F.when(F.col("penalty").isin("always", "l2"), w).when(F.col("penalty") == "l1", F.signum(w)).otherwise(F.lit(0.0))
    return w - F.col("lam") * F.col("alpha") * a * pen


def _visits(spark, n_batches: int, epoch: int, seed: int | None):
    """Batch ids of an epoch, in the order of ``rows.shuffle_batches``."""
    if seed is None or epoch == 1:
        return range(n_batches)
    ids = spark.range(n_batches).select(F.col("id").alias("b"))
    ordered = ids.orderBy(h32(F.lit(seed), F.lit(epoch), F.col("b")), "b")
    return [r["b"] for r in ordered.toLocalIterator()]


# ------------------------------------------------------------------ result tables
def weights_frame(res: TrainResult, epochs: list[int] | None = None) -> DataFrame:
    """snapshots(model_id, epoch, feature_id, w) for the requested epochs."""
    return res.snapshots_frame(epochs)


def history_frame(res: TrainResult) -> DataFrame:
    return res.spark.createDataFrame(pd.DataFrame(res.history),
                                     "model_id long, epoch int, loss double, converged boolean, overflow boolean")


def steps_frame(res: TrainResult) -> DataFrame:
    """(model_id, epoch, batch_id, batch_loss, alpha), one row per step and model."""
    return res.steps_frame()


# ------------------------------------------------------------------ relational forms
def _weighted(cells: DataFrame, weights: DataFrame) -> DataFrame:
    """Cells with the weights of their feature, one row per model. Tables of
    up to ``BROADCAST_WEIGHT_ROWS`` are broadcast; of larger ones, those of
    features with more than a thousandth of all cells (fewer than a thousand
    features), so that no key of the shuffle join is hot."""
    w = weights.select("model_id", "feature_id", "w")
    if w.count() <= BROADCAST_WEIGHT_ROWS:
        return cells.join(F.broadcast(w), "feature_id")
    own = w.groupBy("feature_id").agg(F.collect_list(F.struct("model_id", "w")).alias("ws"))  # a row per feature, as wide as the models
    used = cells.groupBy("feature_id").agg(F.count(F.lit(1)).alias("cells"))
    joined = join_by_key(cells, cut_lineage(used.join(own, "feature_id")), "feature_id", "cells", cells.count()).drop("cells")
    return joined.withColumn("m", F.explode("ws")).select(*cells.columns, "m.model_id", "m.w")


def linear_score(cells: DataFrame, weights: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """z per (row, model) = sum_f x_f * w_f (G1). ``weights(model_id,
    feature_id, w)`` is joined on feature_id (broadcast when small); rows
    without cells get z = 0 when ``rows`` is given."""
    z = _weighted(cells, weights).groupBy("row_id", "model_id").agg(F.sum(F.col("value") * F.col("w")).alias("z"))
    if rows is None:
        return z
    mids = [r["model_id"] for r in weights.select("model_id").distinct().collect()]  # model count, small
    grid = rows.select("row_id", F.explode(F.array(*[F.lit(m).cast("bigint") for m in mids])).alias("model_id"))
    return grid.join(z, ["row_id", "model_id"], "left").select("row_id", "model_id", F.coalesce("z", F.lit(0.0)).alias("z"))


def linear_score_parties(cells: DataFrame, weights: DataFrame, n1: int) -> DataFrame:
    """Two-party form of G1: each party scores its own columns (features
    1..n1 and n1+1..), the partial sums are then added per (row, model)."""
    party = F.when(F.col("feature_id") <= n1, F.lit(1)).otherwise(F.lit(2))
    partial = _weighted(cells.withColumn("party", party), weights).groupBy("row_id", "model_id", "party").agg(
        F.sum(F.col("value") * F.col("w")).alias("zp"))
    return partial.groupBy("row_id", "model_id").agg(F.sum("zp").alias("z"))


def batch_gradient(vec_batched: DataFrame, width: int, models: list[Model], W: np.ndarray | None = None) -> DataFrame:
    """Gradient of every batch at fixed weights, all batches in one job.

    Output (model_id, batch_id, feature_id, grad) with grad = sum (yhat-y) x / B.
    """
    for mod in models:
        mod.activation = canonical(mod.activation)
    spark = vec_batched.sparkSession
    W = np.zeros((width, len(models))) if W is None else W
    if W.nbytes > MAX_BROADCAST_BYTES:
        raise ValueError("weights this large stay a table: use train_relational")

    def task(own, held):
        mids = [m.model_id for m in own]

        def run(batches):
            import pyarrow as pa

            Wv = held.value
            for batch in (part for b in batches for part in _row_slices(b, len(own))):
                _, _, err, fi, fv, row_of = _batch_of(batch, Wv, own)
                bids = batch.column(batch.schema.get_field_index("batch_id")).to_numpy(zero_copy_only=False).astype(np.int64)
                keep = fv != 0  # stored zeros carry no gradient cell
                fi, fv, row_of = fi[keep], fv[keep], row_of[keep]
                if not len(fi):
                    continue
                uniq, inv = np.unique(bids[row_of] * (width + 1) + (fi + 1), return_inverse=True)
                for i in range(len(own)):  # one model's sums at a time
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(uniq), mids[i], dtype=np.int64)),
                        pa.array((uniq // (width + 1)).astype(np.int32)),
                        pa.array((uniq % (width + 1)).astype(np.int32)),
                        pa.array(np.bincount(inv, err[row_of, i] * fv, len(uniq))),
                    ], names=["model_id", "batch_id", "feature_id", "g"])

        return run

    sizes = vec_batched.groupBy("batch_id").agg(F.count(F.lit(1)).alias("B"))
    size, partial = max(1, GROUP_BYTES // (8 * max(width, 1))), None
    for i in range(0, len(models), size):
        own = np.ascontiguousarray(W[:, i:i + size])
        one = vec_batched.select("label", "batch_id", "idx", "val").mapInArrow(
            task(models[i:i + size], _ship(spark, own, own.nbytes)), "model_id long, batch_id int, feature_id int, g double")
        partial = one if partial is None else partial.unionByName(one)
    return partial.groupBy("model_id", "batch_id", "feature_id").agg(F.sum("g").alias("g")).join(
        sizes, "batch_id").select("model_id", "batch_id", "feature_id", (F.col("g") / F.col("B")).alias("grad"))
