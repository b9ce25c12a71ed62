"""Multi-model SGD equals a plain numpy loop of the sequential definition."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from skein.functions.activation import activation_np
from skein.operators import logistic as L
from skein.operators import rows as R

X = np.array([[1.0, 0.0, 2.0], [0.5, 1.0, 0.0], [0.0, 0.0, 0.0], [2.0, 1.0, 1.0],
              [1.0, 1.0, 1.0], [0.0, 3.0, 0.5], [1.5, 0.0, 0.5]])
Y = np.array([1, 0, 0, 1, 1, 0, 1])


def numpy_train(model, batch, epochs, decay=False):
    w = np.zeros(X.shape[1])
    alpha = model.alpha
    losses = []
    for e in range(1, epochs + 1):
        tot = 0.0
        for s in range(0, len(Y), batch):
            xb, yb = X[s:s + batch], Y[s:s + batch]
            B = len(yb)
            y = yb.astype(float) if model.pos_label is None else (yb == model.pos_label).astype(float)
            z = xb @ w
            err = activation_np(z.copy(), model.activation) - y
            g = xb.T @ err
            tot += np.sum((-0.5 * z + y * z - 0.125 * z * z) * (-1.0 / B) - math.log(0.5))
            if decay and e > 1 and e % 10 == 0:
                alpha *= 0.95
            pen = {"always": w, "l2": w, "l1": np.sign(w), "none": 0 * w}[model.penalty]
            w = w - model.c * alpha * g / B - model.lambda_para * alpha * pen / B
        losses.append(tot / len(Y))
    return w, losses


@pytest.fixture(scope="module")
def vec(spark):
    rows = [(i, int(Y[i]), [float(v) for v in X[i]]) for i in range(len(Y))]
    wide = spark.createDataFrame(rows, "row_id long, label int, features array<double>")
    return L.vectors_from_wide(wide)


MODELS = [
    L.Model(0, "linear", 0.1, 0.5, 1.0),
    L.Model(1, "cube", 0.2, 0.0, 2.0),
    L.Model(2, "origin", 0.3, 1.0, 1.0, "l1"),
    L.Model(3, "segmentation", 0.1, 1.0, 1.0, "none"),
    L.Model(4, "linear", 0.1, 0.0, 1.0, pos_label=0),
]


def test_remainder_batch_and_all_activations(vec):
    res = L.train(vec, 3, [L.Model(**vars(m)) for m in MODELS], batch_size=3, max_iter=4)
    for m, mod in enumerate(MODELS):
        w, losses = numpy_train(mod, 3, 4)
        np.testing.assert_allclose(res.matrix()[:, m], w, rtol=1e-9, atol=1e-12)
        got = [h["loss"] for h in res.history if h["model_id"] == mod.model_id]
        np.testing.assert_allclose(got, losses, rtol=1e-9)
    # batches: 3 + 3 + remainder 1
    steps = L.steps_frame(res).collect()
    assert len(steps) == 4 * 3 * len(MODELS) and {s["batch_id"] for s in steps} == {0, 1, 2}


def test_multi_model_equals_alone(vec):
    together = L.train(vec, 3, [L.Model(**vars(m)) for m in MODELS[:3]], batch_size=2, max_iter=3)
    for m, mod in enumerate(MODELS[:3]):
        alone = L.train(vec, 3, [L.Model(**vars(mod))], batch_size=2, max_iter=3)
        np.testing.assert_allclose(together.matrix()[:, m], alone.matrix()[:, 0], rtol=1e-12)


def test_learning_rate_decay(vec):
    mod = L.Model(0, "linear", 0.05, 0.0, 1.0)
    res = L.train(vec, 3, [L.Model(**vars(mod))], batch_size=7, max_iter=11, decay=True)
    w, _ = numpy_train(mod, 7, 11, decay=True)
    np.testing.assert_allclose(res.matrix()[:, 0], w, rtol=1e-9)


def test_snapshots_and_convergence_flag(vec):
    res = L.train(vec, 3, [L.Model(0, "linear", 0.0)], batch_size=7, max_iter=3, snapshot_epochs=2)
    assert sorted(res.epochs) == [1, 2]
    conv = [h["converged"] for h in res.history]
    # alpha 0 keeps the loss constant: epoch 1 compares with 0, later ones converge
    assert conv == [False, True, True]


def _tables(res):
    weights = sorted(tuple(r) for r in L.weights_frame(res).collect())
    steps = sorted(tuple(r) for r in L.steps_frame(res).collect())
    history = [(h["model_id"], h["epoch"], h["loss"], h["converged"], h["overflow"]) for h in res.history]
    return weights, steps, history


@pytest.mark.parametrize("batch,shuffle", [(3, None), (2, 5)])
def test_every_path_gives_the_same_tables(vec, monkeypatch, batch, shuffle):
    """Broadcast, chunked, per-step and relational training, and training
    whose snapshots and steps are written as tables: equal columns and rows."""
    def run():
        return _tables(L.train(vec, 4, [L.Model(**vars(m)) for m in MODELS], batch, 2, decay=True, shuffle_seed=shuffle))

    want = run()
    assert len(want[0]) == 2 * 4 * len(MODELS) and len(want[1]) == 2 * -(-7 // batch) * len(MODELS)
    settings = [{"MAX_BROADCAST_BYTES": 1}, {"SNAPSHOT_BYTES": 1, "STEP_RECORDS": 4}, {"MODELS_PER_TASK": 2, "ROWS_PER_CHUNK": 3}, {"DIRECT_COLLECT_VALUES": 1, "INLINE_WEIGHT_BYTES": 1}]
    if shuffle is None:
        settings.append({"ROWS_PER_CHUNK": 1})  # every batch is larger than a chunk
    else:
        settings = [{"MAX_BROADCAST_BYTES": 1}, {"MODELS_PER_TASK": 2, "ROWS_PER_CHUNK": 3}]
    for s in settings:
        with monkeypatch.context() as m:
            for k, v in s.items():
                m.setattr(L, k, v)
            got = run()
        for a, b in zip(got, want):
            assert len(a) == len(b)
            for x, y in zip(a, b):
                np.testing.assert_allclose(np.array(x, float), np.array(y, float), rtol=1e-9, atol=1e-12, err_msg=str(s))


def test_sweeps_and_scores_work_past_the_weight_bound(spark, vec, monkeypatch):
    from skein.operators.sweep import grid_models, sweep

    cells = spark.createDataFrame([(i, f + 1, float(X[i, f])) for i in range(7) for f in range(3) if X[i, f]], "row_id long, feature_id int, value double")
    rows = spark.createDataFrame([(i, int(Y[i])) for i in range(7)], "row_id long, label int")

    def run():
        return sorted(map(tuple, sweep(vec, 3, grid_models(["linear", "cube"], [0.1, 0.5], [0.0], [1.0]), 3, 2, cells, rows).collect()))

    want = run()
    monkeypatch.setattr(L, "MAX_BROADCAST_BYTES", 1)
    assert run() == want and len(want) == 4


def test_shuffled_epochs_follow_the_visit_order(spark, vec):
    from skein.operators import rows as R

    mod = L.Model(0, "cube", 0.3, 0.5, 1.5)
    res = L.train(vec, 3, [mod], batch_size=2, max_iter=3, shuffle_seed=5)
    order = {}
    for r in R.shuffle_batches(spark.range(4).selectExpr("cast(id AS int) AS batch_id"), 3, seed=5).orderBy("epoch", "visit").collect():
        order.setdefault(r["epoch"], []).append(r["batch_id"])
    assert order[2] != order[1] or order[3] != order[1]
    w = np.zeros(3)
    for e in (1, 2, 3):
        for b in order[e]:
            xb, yb = X[2 * b:2 * b + 2], Y[2 * b:2 * b + 2]
            err = activation_np(xb @ w, "cube") - yb
            w = w - mod.c * mod.alpha * (xb.T @ err) / len(yb) - mod.lambda_para * mod.alpha * w / len(yb)
    np.testing.assert_allclose(res.matrix()[:, 0], w, rtol=1e-9)


def test_a_step_returns_one_partial_per_partition(spark, monkeypatch):
    """What a step sends to the driver doesn't grow with the rows."""
    wide = spark.range(0, 40_000, 1, 4).selectExpr("id AS row_id", "cast(id % 3 = 0 AS int) AS label", "array(double(id % 7), 1.0D) AS features")
    part = L.vectors_from_wide(wide).select("label", "idx", "val").mapInArrow(
        L._step_fn([L.Model(0)], L._Inline(np.zeros((2, 1))), 40_000), "model int, feature_id int, g double")
    assert part.count() == 4 * (2 + 1)


def test_small_batch_query_equals_numpy_loop(spark):
    """Registered query (no SQL oracle) against brute force on sf0.001."""
    from pyspark.sql import functions as F

    import __spark_entry__ as E
    from conftest import SF_SMALL
    from skein.plans import model_queries as MQ

    got = {r["feature_id"]: r["w"] for r in E.queries()["train_binary_small_batch"](spark, SF_SMALL).collect()}
    rows = MQ.li_model_data(spark, SF_SMALL).where(F.col("split") == "train").orderBy("row_id").collect()
    X = np.array([r["features"] for r in rows])
    Y = np.array([r["label"] for r in rows], dtype=float)
    mod = MQ.SMALL_BATCH_MODELS[0]
    w = np.zeros(X.shape[1])
    for s in range(0, len(Y), MQ.SMALL_BATCH):
        xb, yb = X[s:s + MQ.SMALL_BATCH], Y[s:s + MQ.SMALL_BATCH]
        err = activation_np(xb @ w, mod.activation) - yb
        w = w - mod.c * mod.alpha * (xb.T @ err) / len(yb) - mod.lambda_para * mod.alpha * w / len(yb)
    assert len(Y) // MQ.SMALL_BATCH > 50
    for f in range(X.shape[1]):
        assert abs(got.get(f + 1, 0.0) - round(w[f], 6)) < 2e-6


@pytest.mark.parametrize("rows", [1, 2, 3, 5])
def test_chunks_may_cut_batches(vec, monkeypatch, rows):
    """Weights, step sizes and unfinished batches carry across chunks."""
    monkeypatch.setattr(L, "ROWS_PER_CHUNK", rows)
    for batch in (b for b in (1, 2, 3) if b <= rows):
        mod = L.Model(0, "cube", 0.3, 0.5, 1.5, "l1")
        plan = L.prepare(vec, batch)
        assert plan.mode == "stream" and plan.chunks == -(-7 // rows)
        res = L.train(vec, 3, [L.Model(**vars(mod))], batch_size=batch, max_iter=11, decay=True, prepared=plan)
        w, losses = numpy_train(mod, batch, 11, decay=True)
        np.testing.assert_allclose(res.matrix()[:, 0], w, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose([h["loss"] for h in res.history], losses, rtol=1e-9)


def test_preparation_is_one_shuffle(vec, spark):
    """Positions need a range shuffle only, no second exchange or window."""
    from skein.operators import rows as R

    plan = R.assign_batches(vec, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Window" not in plan


@pytest.mark.parametrize("batch", [30, 7])
@pytest.mark.parametrize("train", ["train", "train_relational"])
def test_models_stop_by_themselves(spark, train, batch):
    """Models that stop at different epochs equal those trained alone."""
    if train == "train_relational" and batch == 7:
        pytest.skip("the same rule, many more jobs")
    rng = np.random.RandomState(3)
    X = rng.rand(30, 2)
    vec = L.vectors_from_wide(spark.createDataFrame([(i, int(x.sum() > 1), [float(v) for v in x]) for i, x in enumerate(X)], "row_id long, label int, features array<double>"))
    models = [L.Model(7, "linear", 0.5), L.Model(8, "linear", 1e-5), L.Model(9, "linear", 0.05, 1.0)]
    run = getattr(L, train)
    how = dict(width=2, batch_size=batch, max_iter=4, eps={30: 2.1e-5, 7: 1.5e-3}[batch], stop_on_converge=True)
    both = run(vec, models=models, **how)
    stops = {m.model_id: [h["epoch"] for h in both.history if h["model_id"] == m.model_id] for m in models}
    assert len({len(s) for s in stops.values()}) > 1
    snapshots = {(r["model_id"], r["epoch"], r["feature_id"]): r["w"] for r in both.snapshots_frame().collect()}
    final = {(r["model_id"], r["feature_id"]): r["w"] for r in both.weights.collect()}
    steps = both.steps_frame().collect()
    for m in models:
        alone = run(vec, models=[m], **how)
        assert [h["epoch"] for h in alone.history] == stops[m.model_id]
        for r in alone.snapshots_frame().collect():
            assert abs(snapshots.pop((m.model_id, r["epoch"], r["feature_id"])) - r["w"]) < 1e-12
        for r in alone.weights.collect():
            assert abs(final[m.model_id, r["feature_id"]] - r["w"]) < 1e-12
        assert alone.steps_frame().count() == sum(s["model_id"] == m.model_id for s in steps)
    assert not snapshots


def test_groups_of_models_and_tiles(spark, monkeypatch):
    """Small groups and tiles give the same gradients and weights."""
    rng = np.random.RandomState(4)
    X = rng.rand(40, 5) * (rng.rand(40, 5) < 0.6)
    wide = spark.createDataFrame([(i, int(x.sum() > 1), [float(v) for v in x]) for i, x in enumerate(X)], "row_id long, label int, features array<double>")
    vec = L.vectors_from_wide(wide)
    models = [L.Model(i, a, 0.1 * (i + 1)) for i, a in enumerate(["linear", "cube", "origin", "segmentation", "linear"])]
    batched = vec.withColumn("batch_id", (F.col("row_id") % 3).cast("int"))
    W = rng.rand(5, 5)
    want = L.train(vec, 5, models, 40, 2).matrix()
    grads = {tuple(r)[:3]: r["grad"] for r in L.batch_gradient(batched, 5, models, W).collect()}
    monkeypatch.setattr(L, "TILE_VALUES", 12)
    monkeypatch.setattr(L, "GROUP_BYTES", 5 * 8 * 2)
    assert np.allclose(L.train(vec, 5, models, 40, 2).matrix(), want, rtol=0, atol=1e-12)
    got = {tuple(r)[:3]: r["grad"] for r in L.batch_gradient(batched, 5, models, W).collect()}
    assert set(got) == set(grads) and all(abs(got[k] - v) < 1e-12 for k, v in grads.items())


def test_temporaries_depend_on_the_tile_only():
    """1,000 rows x 200 cells x 252 models: products are made a tile at a time."""
    import tracemalloc

    n, cells, models, d = 1000, 200, 252, 500
    rng = np.random.RandomState(5)
    fi, fv, row_of = rng.randint(0, d, n * cells), rng.rand(n * cells), np.repeat(np.arange(n), cells)
    W, g = rng.rand(d, models), np.zeros((d, models))
    tracemalloc.start()
    z = L._scores_flat(n, fi, fv, row_of, W)
    L._add_gradient(g, fi, fv, row_of, z)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * (4 * L.TILE_VALUES + 2 * n * models)
    assert np.allclose(z[3], (W[fi[600:800]] * fv[600:800, None]).sum(0))


def test_linear_score_beyond_the_broadcast(spark, monkeypatch):
    """Hot features meet their weights without a shuffle of their cells."""
    cells = spark.createDataFrame([(r, f, float(r + f)) for r in range(50) for f in (1, *range(2 + r % 9, 12))], "row_id long, feature_id int, value double")
    weights = spark.createDataFrame([(m, f, m + 0.5 * f) for m in (0, 1) for f in range(1, 12)], "model_id long, feature_id int, w double")
    want = {tuple(r)[:2]: r["z"] for r in L.linear_score(cells, weights).collect()}
    monkeypatch.setattr(L, "BROADCAST_WEIGHT_ROWS", 3)
    got = {tuple(r)[:2]: r["z"] for r in L.linear_score(cells, weights).collect()}
    assert set(got) == set(want) and all(abs(got[k] - v) < 1e-9 for k, v in want.items())


@pytest.mark.parametrize("n,batch,rows,epochs,decay", [(53, 5, 8, 2, False), (40, 10, 10, 2, False), (41, 17, 4, 2, False), (30, 7, 11, 11, True)])
def test_linear_chunks_side_by_side_equal_the_loop(spark, monkeypatch, n, batch, rows, epochs, decay):
    """Chunks as affine maps: borders inside of batches, batches over several chunks."""
    rng = np.random.RandomState(n)
    X = rng.rand(n, 4) * (rng.rand(n, 4) < 0.7)
    y = rng.randint(0, 3, n)
    vec = L.vectors_from_wide(spark.createDataFrame([(i, int(y[i]), [float(v) for v in X[i]]) for i in range(n)], "row_id long, label int, features array<double>"))
    models = [L.Model(0, "linear", 0.3, 0.5, 0.7, pos_label=1), L.Model(1, "linear", 0.05, 1.0, 1.0, "none", pos_label=0), L.Model(2, "linear", 0.2, 2.0, 1.0, "l2", pos_label=2)]
    side = L.train(vec, 4, models, batch, epochs, decay=decay, rows_per_chunk=rows)
    monkeypatch.setattr(L, "AFFINE_VALUES", 0)
    loop = L.train(vec, 4, models, batch, epochs, decay=decay)
    assert np.allclose(side.matrix(), loop.matrix(), rtol=0, atol=1e-9)
    key = lambda r: (r["model_id"], r["epoch"], r["batch_id"])
    a, b = ({key(r): (r["batch_loss"], r["alpha"]) for r in t.steps_frame().collect()} for t in (side, loop))
    assert set(a) == set(b) and all(np.allclose(a[k], b[k], rtol=0, atol=1e-9) for k in b)
    assert np.allclose([h["loss"] for h in side.history], [h["loss"] for h in loop.history], rtol=0, atol=1e-9)


def test_shuffled_order_of_batches_above_a_chunk(spark, monkeypatch):
    rng = np.random.RandomState(8)
    X = rng.rand(24, 3)
    vec = L.vectors_from_wide(spark.createDataFrame([(i, int(x.sum() > 1.5), [float(v) for v in x]) for i, x in enumerate(X)], "row_id long, label int, features array<double>"))
    want = L.train(vec, 3, [L.Model(0, "cube", 0.4)], 5, 3, shuffle_seed=4).matrix()
    monkeypatch.setattr(L, "ROWS_PER_CHUNK", 2)
    assert np.allclose(L.train(vec, 3, [L.Model(0, "cube", 0.4)], 5, 3, shuffle_seed=4).matrix(), want, rtol=0, atol=1e-12)


@pytest.mark.parametrize("block", [2, 16])
def test_relational_weights_out_of_the_block(spark, monkeypatch, block):
    """Features without cells in a block of steps only shrink, under every
    penalty, and the weights of a block's features are all that its steps read."""
    monkeypatch.setattr(L, "BLOCK_STEPS", block)
    rng = np.random.RandomState(11)
    n, d, batch = 10, 6, 2
    Z = np.zeros((n, d))
    for i in range(n):  # batch b has features b and 5 only
        Z[i, i // batch], Z[i, 5] = 1 + rng.rand(), rng.rand()
    y = rng.randint(0, 2, n)
    rows = [(i, int(y[i]), [int(f) + 1 for f in np.flatnonzero(Z[i])], [float(v) for v in Z[i][Z[i] != 0]]) for i in range(n)]
    vec = spark.createDataFrame(rows, "row_id long, label int, idx array<int>, val array<double>")
    models = [L.Model(i, a, 0.3, 0.7, 1.5, p) for i, (a, p) in enumerate([("linear", "always"), ("cube", "l1"), ("origin", "none"), ("linear", "l2")])]
    want = np.zeros((d, len(models)))
    for _ in range(2):
        for s in range(0, n, batch):
            for m, mod in enumerate(models):
                w = want[:, m]
                err = activation_np(Z[s:s + batch] @ w, mod.activation) - y[s:s + batch]
                pen = {"always": w, "l2": w, "l1": np.sign(w), "none": 0 * w}[mod.penalty]
                want[:, m] = w - mod.c * mod.alpha * (Z[s:s + batch].T @ err) / batch - mod.lambda_para * mod.alpha * pen / batch
    got = L.train_relational(vec, d, models, batch, 2).matrix()
    assert np.allclose(got, want, rtol=0, atol=1e-12)


@pytest.mark.parametrize("batch, chunk", [(4, 8), (7, 16), (1, 5), (10, 10)])
def test_shuffled_epochs_write_the_rows_once(spark, monkeypatch, batch, chunk):
    """Batches cut by files and records, visited in the hashed order, against
    the update rule on that order; one layout serves all epochs."""
    from skein.sources import rowranges as RR

    n, epochs, rng = 43, 5, np.random.RandomState(11)
    X, y = rng.rand(n, 3) * (rng.rand(n, 3) < 0.8), rng.randint(0, 2, n)
    vec = L.vectors_from_wide(spark.createDataFrame([(3 * int(i) + 1, int(y[i]), [float(v) for v in X[i]]) for i in rng.permutation(n)], "row_id long, label int, features array<double>"))
    written, write = [], L.write_ranges
    monkeypatch.setattr(L, "write_ranges", lambda *a: written.append(write(*a)) or written[-1])
    monkeypatch.setattr(L, "_in_chunks", None)
    monkeypatch.setattr(RR, "OPEN_FILES", 2)
    models = [L.Model(0, "linear", 0.2, 0.5, 0.7), L.Model(1, "linear", 0.05, 1.0, 1.0, "l2")]
    res = L.train(vec, 3, models, batch, epochs, shuffle_seed=9, rows_per_chunk=chunk)
    assert len(written) == 1 and written[0].n_rows == n and len(written[0].files) > 1
    order = {(r.epoch, r.visit): r.batch_id for r in R.shuffle_batches(spark.range(-(-n // batch)).selectExpr("int(id) batch_id"), epochs, 9).collect()}
    W, alphas = np.zeros((3, 2)), np.array([m.alpha for m in res.models])
    for (_, _), b in sorted(order.items()):
        own = slice(b * batch, min(n, (b + 1) * batch))
        err = L._activate(X[own] @ W, res.models) - y[own, None]
        W = L._update(W, X[own].T @ err, len(y[own]), res.models, alphas)
    assert np.allclose(res.matrix(), W, rtol=0, atol=1e-12)
