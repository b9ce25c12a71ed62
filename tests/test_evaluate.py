import pytest
from pyspark.sql import functions as F

from skein.operators import evaluate as H


def test_ovr_tie_goes_to_lowest_label(spark):
    z = spark.createDataFrame([(0, 2, 1, 0.3), (0, 0, 1, 0.3), (0, 1, 1, 0.1), (1, 0, 1, -5.0), (1, 1, 1, -5.0)],
                              "row_id long, model_id long, epoch int, z double")
    got = {r["row_id"]: r["pred"] for r in H.predict_ovr(z, "linear").collect()}
    assert got == {0: 0, 1: 0}
    clipped = {r["row_id"]: r["pred"] for r in H.predict_ovr(z, "segmentation", clip=True).collect()}
    assert clipped[0] == 0


def test_best_epoch_is_first_maximum(spark):
    acc = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, 0.7)], "epoch int, accuracy double")
    r = H.best_epoch(acc).collect()[0]
    assert (r["best_acc"], r["best_epoch"]) == (0.9, 2)


def test_leaderboard_keeps_ties(spark):
    runs = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.5), ("d", None)], "run_name string, best_acc double")
    got = {r["run_name"]: r["rank"] for r in H.leaderboard(runs).collect()}
    assert got == {"a": 1, "b": 1, "c": 2, "d": 3}


def test_scores_keep_empty_rows(spark):
    cells = spark.createDataFrame([(1, 1, 2.0)], "row_id long, feature_id int, value double")
    rows = spark.createDataFrame([(1, 1), (2, 0)], "row_id long, label int")
    w = spark.createDataFrame([(0, 1, 1, 0.5)], "model_id long, epoch int, feature_id int, w double")
    got = {r["row_id"]: r["z"] for r in H.scores(cells, rows, w).collect()}
    assert got == {1: 1.0, 2: 0.0}
    pred = H.predict_binary(H.scores(cells, rows, w), rows, "linear").where(F.col("row_id") == 2).collect()[0]
    assert pred["pred"] == 1  # z = 0 -> 0.5 -> class 1


def test_two_party_score_equals_one_party(spark):
    from skein.operators import logistic as L

    cells = spark.createDataFrame([(r, f, float(r * 10 + f)) for r in range(5) for f in range(1, 8) if (r + f) % 3],
                                  "row_id long, feature_id int, value double")
    w = spark.createDataFrame([(m, f, (f - 3.5) / (m + 1)) for m in range(2) for f in range(1, 8)],
                              "model_id long, feature_id int, w double")
    one = {(r["row_id"], r["model_id"]): r["z"] for r in L.linear_score(cells, w).collect()}
    two = {(r["row_id"], r["model_id"]): r["z"] for r in L.linear_score_parties(cells, w, 3).collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert abs(one[k] - two[k]) < 1e-9


def test_half_linear_parts_add_up():
    import numpy as np

    from skein.functions.activation import activation_np

    za, zb = np.array([0.3, -1.2]), np.array([0.9, 0.4])
    # party A adds the constant, party B contributes 0.25 z only
    assert np.allclose(activation_np(za.copy(), "linear") + 0.25 * zb, activation_np(za + zb, "linear"))


def test_every_scoring_plan_agrees(spark, monkeypatch):
    """One pass, a pass per key, and the join on feature_id."""
    import random

    rng = random.Random(1)
    cells = spark.createDataFrame([(r, f, rng.choice([-1.0, 0.5, 2.0])) for r in range(30) for f in range(1, 9) if rng.random() < 0.5],
                                  "row_id long, feature_id int, value double")
    rows = spark.createDataFrame([(r, r % 3 if r % 5 else None) for r in range(32)], "row_id long, label int")
    w = spark.createDataFrame([(m, e, f, rng.uniform(-1, 1)) for m in range(3) for e in (1, 2) for f in range(1, 9)],
                              "model_id long, epoch int, feature_id int, w double")

    def run():
        z = {tuple(r)[:3]: r["z"] for r in H.scores(cells, rows, w).collect()}
        key = lambda df: sorted(map(tuple, df.collect()))
        return z, [key(H.ovr_predictions(cells, rows, w, "cube", clip)) for clip in (False, True)] + [
            key(H.ovr_epoch_accuracy(cells, rows, w, "linear")), key(H.binary_accuracy(cells, rows, w, {0: "linear", 1: "cube", 2: "origin"}))]

    z, want = run()
    assert len(z) == 32 * 6 and len(want[0]) == 64
    old = H.predict_ovr(H.scores(cells, rows, w), "cube")
    assert sorted((r["row_id"], r["epoch"], r["pred"]) for r in old.collect()) == want[0]
    for name, value in (("KEY_BYTES", 64), ("MAX_KEY_BYTES", 1)):
        with monkeypatch.context() as m:
            m.setattr(H, name, value)
            z2, got = run()
        assert got == want and z2.keys() == z.keys() and all(abs(z[k] - z2[k]) < 1e-12 for k in z)


@pytest.mark.parametrize("clip", [False, True])
def test_labels_of_an_epoch_in_several_groups(spark, monkeypatch, clip):
    """Arg-max over groups of labels and tiles of rows, ties to the lowest label."""
    import numpy as np

    from skein.operators import logistic as L

    rng = np.random.RandomState(6)
    cells = spark.createDataFrame([(r, f, float(rng.randint(-2, 3))) for r in range(30) for f in range(1, 5)], "row_id long, feature_id int, value double")
    rows = spark.createDataFrame([(r, r % 7) for r in range(31)], "row_id long, label int")
    weights = spark.createDataFrame([(m, e, f, float(rng.randint(-1, 2))) for m in range(7) for e in (1, 2) for f in range(1, 5)],
                                    "model_id long, epoch int, feature_id int, w double")
    want = sorted(map(tuple, H.ovr_predictions(cells, rows, weights, "linear", clip).collect()))
    acc = sorted(map(tuple, H.ovr_epoch_accuracy(cells, rows, weights, "linear", clip).collect()))
    monkeypatch.setattr(H, "KEY_BYTES", 3 * 8 * 4)
    monkeypatch.setattr(L, "TILE_VALUES", 10)
    assert sorted(map(tuple, H.ovr_predictions(cells, rows, weights, "linear", clip).collect())) == want
    assert np.allclose(sorted(map(tuple, H.ovr_epoch_accuracy(cells, rows, weights, "linear", clip).collect())), acc)
