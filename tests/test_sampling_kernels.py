"""Statistical checks with fixed seeds: P-MinHash collisions ~ probability
Jaccard; RFF inner products ~ RBF kernel; tensor sketch ~ (gamma x.y + 1)^2."""

import math

import numpy as np
from pyspark.sql import functions as F

from skein.operators import kernels as K
from skein.operators import sampling as SM


def _cells(spark, rows):
    data = [(r, f, float(v)) for r, vec in rows.items() for f, v in enumerate(vec, start=1) if v != 0]
    return spark.createDataFrame(data, "row_id long, feature_id int, value double")


def _rows(spark, ids):
    return spark.createDataFrame([(i, 0) for i in ids], "row_id long, label int")


def prob_jaccard(x, y):
    tot = 0.0
    for i in range(len(x)):
        if x[i] > 0 and y[i] > 0:
            tot += 1.0 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(len(x)))
    return tot


def test_pminhash_collision_rate(spark):
    rng = np.random.RandomState(3)
    x = rng.randint(0, 4, size=40).astype(float)
    y = x.copy()
    y[:15] = rng.randint(0, 4, size=15)
    k = 400
    s = SM.pminhash_samples(_cells(spark, {0: x, 1: y}), _rows(spark, [0, 1, 2]), 40, k).collect()
    by = {}
    for r in s:
        by.setdefault(r["row_id"], {})[r["hash_id"]] = r["sample"]
    assert set(by[2].values()) == {-1}                     # empty row
    rate = sum(by[0][j] == by[1][j] for j in range(k)) / k
    assert abs(rate - prob_jaccard(x, y)) < 0.08


def test_cws_collision_rate_tracks_similarity(spark):
    rng = np.random.RandomState(5)
    x = rng.rand(30) + 0.1
    near = x * (1 + 0.05 * rng.rand(30))
    far = rng.rand(30) + 0.1
    s = SM.cws_samples(_cells(spark, {0: x, 1: near, 2: far}), _rows(spark, [0, 1, 2]), 30, 300).collect()
    by = {}
    for r in s:
        by.setdefault(r["row_id"], {})[r["hash_id"]] = r["sample"]
    c_near = np.mean([by[0][j] == by[1][j] for j in range(300)])
    c_far = np.mean([by[0][j] == by[2][j] for j in range(300)])
    assert c_near > c_far + 0.2


def test_two_party_samples_are_local(spark):
    x = {0: [1, 0, 2, 0, 3, 1, 0, 0, 1, 2]}
    s = SM.pminhash_samples(_cells(spark, x), _rows(spark, [0]), 10, 10, p=0.3).collect()
    for r in s:
        limit = 3 if r["party"] == 1 else 7
        assert 1 <= r["sample"] <= limit
    assert sum(r["party"] == 1 for r in s) == 3 and sum(r["party"] == 2 for r in s) == 7


def test_rff_approximates_rbf(spark):
    rng = np.random.RandomState(0)
    a = rng.rand(8)
    b = a + 0.3 * rng.rand(8)
    gamma = 0.5
    out = K.rff_features(_cells(spark, {0: a, 1: b}), _rows(spark, [0, 1]), 8, 2000, gamma).collect()
    v = {0: np.zeros(2000), 1: np.zeros(2000)}
    for r in out:
        v[r["row_id"]][r["comp"]] = r["value"]
    want = math.exp(-gamma * np.sum((a - b) ** 2))
    assert abs(float(v[0] @ v[1]) - want) < 0.08


def test_tensor_sketch_approximates_poly(spark):
    rng = np.random.RandomState(1)
    a = rng.rand(10)
    b = rng.rand(10)
    gamma = 0.3
    k = 512
    out = K.tensor_sketch_features(_cells(spark, {0: a, 1: b}), _rows(spark, [0, 1]), 10, k, gamma).collect()
    v = {0: np.zeros(k), 1: np.zeros(k)}
    for r in out:
        v[r["row_id"]][r["comp"]] = r["value"]
    want = (gamma * float(a @ b) + 1.0) ** 2
    assert abs(float(v[0] @ v[1]) - want) / want < 0.25


def test_rff_empty_row_gets_all_components(spark):
    out = K.rff_features(_cells(spark, {0: [1.0, 2.0]}), _rows(spark, [0, 5]), 2, 6, 1.0, p=0.5)
    assert out.where(F.col("row_id") == 5).count() == 6


def test_samples_equal_a_plain_loop(spark):
    """The hashed numbers and the arg-min rule, cell by cell."""
    from skein.functions import hashing as HS

    def mixed(x):
        for c in HS.MULTIPLIERS:
            x ^= x >> 16
            x = x * c % 2**32
        return x ^ x >> 16

    def u(tag, g, f):
        return (mixed((mixed((f + HS.stream(1, tag)) % 2**32) + g * HS.STEP) % 2**32) + 0.5) / 2**32

    x = {0: [1, 0, 2, 0, 3, 1, 0, 0, 1, 2], 1: [0] * 10, 2: [0, 0, 0, 4, 0, 0, 0, 0, 0, 1]}
    got = {(r["row_id"], r["party"], r["hash_id"]): r["sample"] for r in SM.pminhash_samples(_cells(spark, x), _rows(spark, [0, 1, 2]), 10, 10, p=0.3).collect()}
    cws = {(r["row_id"], r["party"], r["hash_id"]): r["sample"] for r in SM.cws_samples(_cells(spark, x), _rows(spark, [0, 1, 2]), 10, 10, p=0.3).collect()}
    for row, vec in x.items():
        for party, features, g0, kp in ((1, range(1, 4), 0, 3), (2, range(4, 11), 3, 7)):
            for h in range(kp):
                g, keys, ckeys = g0 + h, [], []
                for f in features:
                    if vec[f - 1] > 0:
                        local = f - (0 if party == 1 else 3)
                        keys.append((-math.log(u("u", g, f)) / vec[f - 1], local))
                        v = {t: u(t, g, f) for t in ("r1", "r2", "c1", "c2", "b")}
                        r = -math.log(v["r1"]) - math.log(v["r2"])
                        t = math.floor(math.log(vec[f - 1]) / r + v["b"])
                        ckeys.append((math.log(-math.log(v["c1"]) - math.log(v["c2"])) - r * (t - v["b"]) - r, local))
                assert got[row, party, h] == (min(keys)[1] if keys else -1)
                assert cws[row, party, h] == (min(ckeys)[1] if ckeys else -1)


def test_draws_are_even_and_unrelated():
    from skein.functions import hashing as HS

    x = HS.draws(HS.stream(1, "u"), np.arange(1, 401), 0, 2500)
    assert 0 < x.min() and x.max() < 1
    n = x.size
    counts = np.histogram(x, 64, (0, 1))[0]
    assert ((counts - n / 64) ** 2 / (n / 64)).sum() < 63 + 5 * math.sqrt(126)
    assert np.array_equal(x[:, 700:900], HS.draws(HS.stream(1, "u"), np.arange(1, 401), 700, 900))
    c = x - 0.5
    for a, b in ((c[:-1], c[1:]), (c[:, :-1], c[:, 1:]), (c, HS.draws(HS.stream(1, "v"), np.arange(1, 401), 0, 2500) - 0.5)):
        assert abs((a * b).mean() * 12) < 5 / math.sqrt(a.size)
    assert np.abs(np.corrcoef(c) - np.eye(400)).max() < 0.12 and len(np.unique(x)) > n * 0.999


def test_packed_rows_and_kept_numbers(spark, monkeypatch):
    """Counts packed by row, parts of one row in any order, columns that travel
    with their row, and numbers kept for a task or made tile by tile."""
    from skein.operators import rowtiles as T

    x = {0: [1, 0, 2, 0, 3, 1, 0, 0, 1, 2], 1: [0] * 10, 2: [0, 0, 0, 4, 0, 0, 0, 0, 0, 1], 3: list(range(1, 11))}
    packed = spark.createDataFrame([(0, [9, 1, 3, 5, 10, 6, 3], [1, 1, 1, 3, 2, 1, 1]), (2, [4, 10, 4], [3, 1, 1]), (3, list(range(1, 11)), list(range(1, 11)))],
                                   "row_id long, features array<int>, counts array<bigint>")
    rows = spark.createDataFrame([(i, f"s{i}") for i in (*x, 3)], "row_id long, split string")
    plain = _rows(spark, [*x, 3])
    vectors = T.row_vectors(packed, rows, ("split",))
    for draw in (SM.pminhash_samples, SM.cws_samples):
        want = sorted(map(tuple, draw(_cells(spark, x), plain, 10, 10, p=0.3).collect()))
        for kept, long_rows in ((T.TABLE_VALUES, 1), (0, 1), (T.TABLE_VALUES, 1000)):
            monkeypatch.setattr(T, "TABLE_VALUES", kept)
            monkeypatch.setattr(SM, "LONG_ROWS", long_rows)
            assert sorted(map(tuple, draw(packed, plain, 10, 10, p=0.3).collect())) == want
            got = draw(vectors, None, 10, 10, p=0.3, carry=("split",)).collect()
            assert sorted(tuple(r)[:4] for r in got) == want and all(r["split"] == f"s{r['row_id']}" for r in got)
    rff = lambda cells: sorted((r[0], r[1], r[2], round(r[3], 9)) for r in K.rff_features(cells, plain, 10, 6, 0.2, p=0.5).collect())
    assert rff(packed) == rff(_cells(spark, x))


def test_tokens_of_any_text():
    import pyarrow as pa

    from skein.plans import fixtures as X

    texts = ["Ab é ab-Ab\x00z", None, "", "ÀÉ 12", "z", "a b\U0001f600c", "q"]
    ids = [7, 8, 9, 10, 11, 12, 7]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], names=["doc_id", "text"])
    want = {}
    for i, t in zip(ids, texts):
        word = ""
        for c in (t or "") + " ":
            if c.isascii() and c.isalpha():
                word += c
            elif word:
                f = 1 + int.from_bytes(X.md5(word.encode()).digest()[:4], "big") % 50
                want[i, f], word = want.get((i, f), 0) + 1, ""
    for part in ([batch], [batch.slice(0, 3), batch.slice(3)]):
        got = {}
        for b in X._token_counts(50)(iter(part)):
            for i, fs, ns in zip(*(c.to_pylist() for c in b.columns)):
                for f, n in zip(fs, ns):
                    got[i, f] = got.get((i, f), 0) + n
        assert got == want
