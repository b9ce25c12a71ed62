"""Training work that must not grow faster than the rows: jobs, files, reads."""

import numpy as np
import pytest

from skein.operators import logistic as L


def _vec(spark, n, d, seed, classes=2, density=1.0):
    rng = np.random.RandomState(seed)
    X, y = rng.rand(n, d) * (rng.rand(n, d) < density), rng.randint(0, classes, n)
    wide = spark.createDataFrame([(i, int(y[i]), [float(v) for v in X[i]]) for i in range(n)], "row_id long, label int, features array<double>")
    return L.vectors_from_wide(wide), X, y


def _jobs(spark, name, run):
    """How many jobs ``run`` starts, and what it returns."""
    sc = spark.sparkContext
    sc.setJobGroup(name, name)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    return len(sc.statusTracker().getJobIdsForGroup(name)), out


def test_linear_chunks_take_two_jobs_an_epoch(spark):
    """120 chunks of five rows cost as many jobs as 12, and give the loop's weights."""
    vec, X, y = _vec(spark, 600, 3, 1)
    models = [L.Model(0, "linear", 0.3, 0.5, 0.7), L.Model(1, "linear", 0.05, 1.0, 1.0, "none")]
    many, res = _jobs(spark, "many-chunks", lambda: L.train(vec, 3, models, 4, 2, rows_per_chunk=5))
    few, _ = _jobs(spark, "few-chunks", lambda: L.train(vec, 3, models, 4, 2, rows_per_chunk=50))
    assert many == few
    W, alphas = np.zeros((3, 2)), np.array([m.alpha for m in models])
    for _ in range(2):
        for s in range(0, 600, 4):
            err = L._activate(X[s:s + 4] @ W, models) - y[s:s + 4, None]
            W = L._update(W, X[s:s + 4].T @ err, 4, models, alphas)
    assert np.allclose(res.matrix(), W, rtol=0, atol=1e-12)


def test_small_chunks_share_files(spark):
    plan = L.prepare(_vec(spark, 600, 3, 1)[0], 4, rows_per_chunk=5)
    assert plan.chunks == 120 and len(plan.data.files) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("density", [1.0, 0.6])
def test_dense_and_sparse_rows_follow_the_rule(spark, density):
    """Rows that list every feature take the matrix form, others the listed one."""
    vec, X, y = _vec(spark, 50, 4, 2, density=density)
    if density < 1:
        vec = vec.selectExpr("row_id", "label", "transform(filter(arrays_zip(idx, val), e -> e.val != 0), e -> e.idx) idx", "filter(val, v -> v != 0) val")
    models = [L.Model(0, "cube", 0.3, 0.5, 0.7, "l1"), L.Model(1, "origin", 0.1)]
    res = L.train(vec, 4, models, 7, 2, rows_per_chunk=9)
    W, alphas = np.zeros((4, 2)), np.array([m.alpha for m in models])
    for _ in range(2):
        for s in range(0, 50, 7):
            own = slice(s, min(50, s + 7))
            err = L._activate(X[own] @ W, models) - y[own, None]
            W = L._update(W, X[own].T @ err, len(y[own]), models, alphas)
    assert np.allclose(res.matrix(), W, rtol=0, atol=1e-12)


def _rule(X, y, models, batch, epochs):
    W, alphas = np.zeros((X.shape[1], len(models))), np.array([m.alpha for m in models])
    for _ in range(epochs):
        for s in range(0, len(y), batch):
            own = slice(s, min(len(y), s + batch))
            err = L._activate(X[own] @ W, models) - y[own, None]
            W = L._update(W, X[own].T @ err, len(y[own]), models, alphas)
    return W


def test_relational_batches_share_jobs(spark):
    """Twenty batches cost as many jobs as two while their weights fit a task."""
    vec, X, y = _vec(spark, 100, 3, 3)
    models = [L.Model(4, "linear", 0.3, 0.5, 0.7), L.Model(2, "cube", 0.2, 0.5, 1.0, "l1")]
    many, res = _jobs(spark, "relational-many", lambda: L.train_relational(vec, 3, models, 5, 1))
    few, _ = _jobs(spark, "relational-few", lambda: L.train_relational(vec, 3, models, 50, 1))
    assert many == few
    assert np.allclose(res.matrix(), _rule(X, y, models, 5, 1), rtol=0, atol=1e-12)


@pytest.mark.parametrize("settings", [{"STREAM_STEPS": 2, "MODELS_PER_TASK": 2}, {"STREAM_VALUES": 0, "BLOCK_STEPS": 2}])
def test_relational_blocks_leave_other_weights_to_shrink(spark, monkeypatch, settings):
    """Batch b has features b and 5 only, so every block leaves weights out."""
    for k, v in settings.items():
        monkeypatch.setattr(L, k, v)
    rng = np.random.RandomState(11)
    X = np.zeros((10, 6))
    for i in range(10):
        X[i, i // 2], X[i, 5] = 1 + rng.rand(), rng.rand()
    y = rng.randint(0, 2, 10)
    rows = [(i, int(y[i]), [int(f) + 1 for f in np.flatnonzero(X[i])], [float(v) for v in X[i][X[i] != 0]]) for i in range(10)]
    vec = spark.createDataFrame(rows, "row_id long, label int, idx array<int>, val array<double>")
    models = [L.Model(9 - i, a, 0.3, 0.7, 1.5, p) for i, (a, p) in enumerate([("linear", "always"), ("cube", "l1"), ("origin", "none")])]
    res = L.train_relational(vec, 6, models, 2, 2)
    assert np.allclose(res.matrix(), _rule(X, y, models, 2, 2), rtol=0, atol=1e-12)
    assert res.steps_frame().count() == 2 * 5 * 3


def test_relational_blocks_keep_the_joins_by_row(spark, monkeypatch):
    """Repeated and null ids, null labels and values: as in the steps by joins."""
    rows = [(1, 1, [1, 2], [0.5, 2.0]), (1, 0, [1, 3], [1.0, 1.5]), (2, None, [2], [1.0]), (3, 1, [1, 2], [None, 3.0]), (None, 1, [3], [2.0]),
            (4, 0, [], []), (5, 1, [2, 3], [1.0, 0.0]), (5, 1, [1], [0.7])]
    vec = spark.createDataFrame(rows, "row_id long, label int, idx array<int>, val array<double>")
    models = [L.Model(0, "linear", 0.3, 0.7, 1.5), L.Model(1, "cube", 0.2, 0.0, 1.0, pos_label=1)]
    block = L.train_relational(vec, 3, models, 8, 2)
    monkeypatch.setattr(L, "STREAM_VALUES", 0)
    steps = L.train_relational(vec, 3, models, 8, 2)
    assert np.allclose(block.matrix(), steps.matrix(), rtol=0, atol=1e-12) and not np.isnan(block.matrix()).any()
    loss = lambda r: [x["batch_loss"] for x in r.steps_frame().orderBy("epoch", "model_id").collect()]
    assert np.allclose(loss(block), loss(steps), rtol=0, atol=1e-12)


def test_losses_that_are_no_number_are_not_null(spark):
    res = L.TrainResult(spark, [L.Model(0)], 1)
    res.add_steps([0], 1, [0], [float("nan")], [0.1])
    assert np.isnan(res.steps_frame().first()["batch_loss"])
