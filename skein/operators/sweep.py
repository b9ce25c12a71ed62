"""Hyper-parameter sweep (G12): every grid point is one model; models that
share a batch size train together in the same passes, then all are scored on
the test rows in one join + aggregate."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import evaluate as H
from skein.operators import logistic as L


def grid_models(sigmoids, alphas, lambdas, cs, penalty: str = "always", start: int = 0) -> list[L.Model]:
    """Cartesian product sigmoid x alpha x lambda x C, ids in product order."""
    out = []
    for i, (sig, a, lam, c) in enumerate(itertools.product(sigmoids, alphas, lambdas, cs)):
        out.append(L.Model(start + i, sig, float(a), float(lam), float(c), penalty))
    return out


def sweep(train_vec: DataFrame, width: int, models: list[L.Model], batch_size: int, epochs: int,
          test_cells: DataFrame, test_rows: DataFrame) -> DataFrame:
    """Train all models in shared passes and return test accuracy per run."""
    spark = train_vec.sparkSession
    res = L.train(train_vec, width, models, batch_size, epochs)
    w = L.weights_frame(res, [epochs])
    params = spark.createDataFrame(
        [(m.model_id, m.activation, m.alpha, m.lambda_para, m.c) for m in models],
        "model_id long, sigmoid_func string, alpha double, lambda_para double, c double")
    acc = H.binary_accuracy(test_cells, test_rows, w, {m.model_id: m.activation for m in models})
    return acc.join(F.broadcast(params), "model_id").select(
        F.col("model_id").alias("run_id"), "sigmoid_func", "alpha", "lambda_para", "c", "accuracy")


def sweep_grid(train_vec: DataFrame, width: int, grid: dict, epochs: int, test_cells: DataFrame,
               test_rows: DataFrame) -> DataFrame:
    """Full grid incl. batch sizes: one shared training pass per batch size."""
    out = None
    start = 0
    for bs in grid["batch_size"]:
        models = grid_models(grid["sigmoid_func"], grid["alpha"], grid["lambda_para"], grid["c"], start=start)
        start += len(models)
        part = sweep(train_vec, width, models, bs, epochs, test_cells, test_rows).withColumn("batch_size", F.lit(bs))
        out = part if out is None else out.unionByName(part)
    return out
