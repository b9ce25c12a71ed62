from pyspark.sql import functions as F

from skein.operators import rows as R


def test_kth_smallest_matches_sort(spark):
    vals = [(int(v),) for v in [5, -3, 17, 17, 2**40, 0, 9, -2**35, 11]]
    df = spark.createDataFrame(vals, "x long")
    ordered = sorted(v for (v,) in vals)
    for k in range(1, len(vals) + 1):
        got, below = R.kth_smallest(df, "x", k)
        assert got == ordered[k - 1]
        assert below == sum(1 for v in ordered if v < got)


def test_sample_exact_is_exact_and_stable(spark):
    rows = spark.range(0, 500).select(F.col("id").alias("row_id"), F.lit(0).alias("label"))
    a = sorted(r["row_id"] for r in R.sample_exact(rows, 123, seed=1).collect())
    b = sorted(r["row_id"] for r in R.sample_exact(rows, 123, seed=1).collect())
    assert len(a) == 123 and a == b
    c = sorted(r["row_id"] for r in R.sample_exact(rows, 123, seed=2).collect())
    assert a != c


def test_split_ordered_last_twenty_percent(spark):
    rows = spark.range(0, 11).select((F.col("id") * 3).alias("row_id"), F.lit(1).alias("label"))
    test = sorted(r["row_id"] for r in R.split_ordered(rows).where(F.col("split") == "test").collect())
    assert test == [24, 27, 30]  # ceil(0.2 * 11) = 3


def test_batches_contiguous_with_remainder(spark):
    rows = spark.range(0, 10).select((F.col("id") * 7).alias("row_id"))
    b = R.assign_batches(rows, 4)
    got = sorted((r["pos"], r["batch_id"]) for r in b.collect())
    assert [x[1] for x in got] == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2]
    sizes = {r["batch_id"]: r["batch_rows"] for r in R.batch_sizes(b).collect()}
    assert sizes == {0: 4, 1: 4, 2: 2}


def test_normalise_labels_binary(spark):
    rows = spark.createDataFrame([(1, -1, "train"), (2, 1, "train"), (3, 2, "test")], "row_id long, label int, split string")
    got = {r["row_id"]: r["label"] for r in R.normalise_labels(rows).collect()}
    assert got == {1: 0, 2: 1, 3: 0}


def test_shuffle_batches_is_permutation(spark):
    b = spark.range(0, 9).select(F.col("id").cast("int").alias("batch_id"))
    v = R.shuffle_batches(b, 3).collect()
    for e in (1, 2, 3):
        order = [r["batch_id"] for r in sorted((r for r in v if r["epoch"] == e), key=lambda r: r["visit"])]
        assert sorted(order) == list(range(9))
        if e == 1:
            assert order == list(range(9))


def test_exact_quantiles_match_numpy(spark):
    import numpy as np

    from skein.operators import quantiles as Qn

    rng = np.random.RandomState(2)
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    groups = {"even": rng.rand(1001), "clumped": np.r_[np.zeros(500), np.full(499, 3.0), [1e12]], "one": np.array([4.5]), "two": np.array([-1.0, 2.0]),
              "negative": -rng.rand(60), "third": np.full(3000, 7.25)}
    zeros = {"even": 400, "two": 1, "negative": 61, "nothing": 3, "none": 0}
    df = spark.createDataFrame([(g, float(v)) for g, xs in groups.items() for v in xs] + [("void", None)], "g string, value double").repartition(4)
    extra = spark.createDataFrame(list(zeros.items()), "g string, zeros long")
    plain = {r.g: r.q for r in Qn.quantiles(df, "g", "value", probs).collect()}
    assert set(plain) == set(groups)
    for g, xs in groups.items():
        assert np.allclose(plain[g], np.quantile(xs, probs), rtol=0, atol=1e-12 * max(1.0, abs(xs).max()))
    padded = {r.g: r.q for r in Qn.quantiles(df, "g", "value", probs, extra).collect()}
    assert set(padded) == set(groups) | {"nothing"}
    for g in padded:
        xs = np.r_[groups.get(g, []), np.zeros(zeros.get(g, 0))]
        assert np.allclose(padded[g], np.quantile(xs, probs), rtol=0, atol=1e-12 * max(1.0, abs(xs).max()))


def test_long_standard_scaler_far_from_zero(spark):
    from skein.operators import scale as D

    cells = spark.createDataFrame([(i, 1, 1e8 + i % 2) for i in range(1000)] + [(i, 2, 1e8) for i in range(500)], "row_id long, feature_id int, value double")
    out, zeros = D.scale_long(cells, spark.range(1000).withColumnRenamed("id", "row_id"), "ss")
    got = {(r.row_id, r.feature_id): r.value for r in out.collect()}
    assert all(abs(got[i, 1] - (1 if i % 2 else -1)) < 1e-6 for i in range(1000))
    assert all(abs(got[i, 2] - 1) < 1e-9 for i in range(500))
    assert {r.feature_id: round(r.value, 6) for r in zeros.collect()}[2] == -1

def test_normalise_labels_minus_mode(spark):
    rows = spark.createDataFrame([(1, -1), (2, 1), (3, 2)], "row_id long, label int")
    got = {r["row_id"]: r["label"] for r in R.normalise_labels(rows, mode="minus").collect()}
    assert got == {1: 0, 2: 1, 3: 2}
