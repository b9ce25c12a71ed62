"""Scaler properties on generated matrices (numpy definitions as the oracle)."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.operators import scale as D

CELL = st.floats(min_value=-50, max_value=50, allow_nan=False, allow_infinity=False, width=32)
MATRIX = st.integers(min_value=3, max_value=9).flatmap(
    lambda n: st.lists(st.lists(CELL, min_size=3, max_size=3), min_size=n, max_size=n))


def _wide(spark, rows):
    data = [(i, 0, [float(v) for v in r] + [1.0], "train" if i % 3 else "test") for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "row_id long, label int, features array<double>, split string")


def _np_scaled(X, code):
    if code == "mm":
        lo, hi = X.min(0), X.max(0)
        rng = np.where(hi - lo == 0, 1.0, hi - lo)
        return (X - lo) / rng
    if code == "ss":
        sd = X.std(0)
        return (X - X.mean(0)) / np.where(sd == 0, 1.0, sd)
    if code == "ma":
        m = np.abs(X).max(0)
        return X / np.where(m == 0, 1.0, m)
    q1, med, q3 = np.quantile(X, [0.25, 0.5, 0.75], axis=0)
    iqr = np.where(q3 - q1 == 0, 1.0, q3 - q1)
    return (X - med) / iqr


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=MATRIX)
def test_scalers_match_numpy_definitions(spark, rows):
    wide = _wide(spark, rows)
    X = np.array([[float(v) for v in r] + [1.0] for r in rows])
    for code in ("mm", "ss", "ma", "rs"):
        got = {r["row_id"]: r["features"] for r in D.scale(wide, code, fit_on="each").collect()}
        for split in ("train", "test"):
            idx = [i for i in range(len(rows)) if (i % 3 != 0) == (split == "train")]
            want = _np_scaled(X[idx], code)
            have = np.array([got[i] for i in idx])
            np.testing.assert_allclose(have, want, rtol=1e-9, atol=1e-9)
        if code == "mm":
            vals = np.array(list(got.values()))
            assert vals.min() >= -1e-12 and vals.max() <= 1 + 1e-12
            assert np.all(vals[:, -1] == 0.0)  # constant column -> 0


def test_fit_on_train_applies_train_statistics(spark):
    rows = [[1.0, 2.0, 3.0], [3.0, 2.0, 1.0], [5.0, 0.0, 2.0], [100.0, 1.0, 1.0]]
    wide = _wide(spark, rows)
    got = {r["row_id"]: r["features"] for r in D.scale(wide, "mm", fit_on="train").collect()}
    X = np.array([r + [1.0] for r in rows])
    train = X[[1, 2]]
    lo, hi = train.min(0), train.max(0)
    want = (X - lo) / np.where(hi - lo == 0, 1.0, hi - lo)
    np.testing.assert_allclose(np.array([got[i] for i in range(4)]), want, rtol=1e-12)


def test_long_scaling_equals_wide_scaling(spark):
    """Stored zeros, features without a train cell, empty rows, both policies."""
    from skein.operators import columns as C

    vals = [(r, f, float((r * 7 + f * 3) % 5 - (2 if f == 2 else 0))) for r in range(9) for f in range(1, 5) if (r + f) % 2 and not (f == 4 and r < 7)]
    vals.append((8, 2, 0.0))
    cells = spark.createDataFrame(vals, "row_id long, feature_id int, value double")
    rows = spark.createDataFrame([(r, 0, "train" if r < 7 else "test") for r in range(10)], "row_id long, label int, split string")
    wide = C.to_wide(cells, rows, 4).join(rows.select("row_id", "split"), "row_id")
    for code in ("mm", "ss", "ma"):
        for fit_on in ("train", "each"):
            want = {(r["row_id"], i + 1): v for r in D.scale(wide, code, fit_on).collect() for i, v in enumerate(r["features"])}
            out, zeros = D.scale_long(cells, rows, code, fit_on)
            split = {r["row_id"]: r["split"] for r in rows.collect()}
            zero = {(r["split"], r["feature_id"]): r["value"] for r in zeros.collect()}
            got = {(r["row_id"], r["feature_id"]): r["value"] for r in out.collect()}
            assert len(got) == len(vals)
            for (row, f), v in want.items():
                mine = got.get((row, f), zero.get((split[row] if fit_on == "each" else "*", f), 0.0))
                assert abs(mine - v) < 1e-9, (code, fit_on, row, f)
    l2 = D.scale_l2_rows_long(spark.createDataFrame([(1, 1, 0.0), (2, 1, 3.0), (2, 2, 4.0)], "row_id long, feature_id int, value double"))
    assert sorted(map(tuple, l2.collect())) == [(1, 1, 0.0), (2, 1, 0.6), (2, 2, 0.8)]


def test_long_scaling_reads_its_cells_once(spark, monkeypatch):
    """The cells are worked out once, and both ways to their statistics agree."""
    seen = spark.sparkContext.accumulator(0)
    rows = spark.createDataFrame([(r, "train" if r < 40 else "test") for r in range(50)], "row_id long, split string")
    vals = spark.createDataFrame([(r, 1 + f, float((r * f) % 7)) for r in range(50) for f in range(5)], "row_id long, feature_id int, value double")

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    cells = vals.mapInArrow(count, vals.schema)
    for code in ("mm", "ss", "ma", "rs"):
        before, got = seen.value, []
        for most in (D.BROADCAST_FEATURES, 0):
            monkeypatch.setattr(D, "BROADCAST_FEATURES", most)
            out, zeros = D.scale_long(cells, rows, code)
            got.append((sorted(map(tuple, out.collect())), sorted(map(tuple, zeros.collect()))))
            monkeypatch.undo()
        assert got[0] == got[1] and len(got[0][0]) == 250 and len(got[0][1]) == 5
        assert seen.value - before == 2 * 250, code


def test_equal_values_of_a_key_take_one_place(spark):
    from skein.operators import quantiles as Q

    rows = spark.createDataFrame([(k, float(v), 10 * k + v + 1) for k in range(3) for v in range(4)], "key int, value double, n long")
    placed, total = Q._weighted_position(rows)
    want, upto = [], 0
    for k in range(3):
        for v in range(4):
            want.append((k, float(v), 10 * k + v + 1, upto))
            upto += 10 * k + v + 1
    assert total == 12 and sorted(map(tuple, placed.collect())) == want
    hot = spark.range(30000).select(F.lit("a").alias("g"), (F.col("id") % 3 - 1).cast("double").alias("value"))
    zeros = spark.createDataFrame([("a", 10000), ("b", 5)], "g string, zeros long")
    values = np.array([(i % 3) - 1.0 for i in range(30000)] + [0.0] * 10000)
    got = {r.g: r.q for r in Q.quantiles(hot, "g", "value", [0.1, 0.25, 0.5, 0.9], zeros).collect()}
    assert got == {"a": np.quantile(values, [0.1, 0.25, 0.5, 0.9]).tolist(), "b": [0.0] * 4}
