"""Encoders on a hand-written samples matrix (tiny_samples)."""

import pytest

from skein.operators import squeeze as Q

# tiny_samples: 4 rows x k = 3, n = 5; row 3 is empty (-1), row 2 has a 0.
TINY = [
    (0, [1, 5, 3]),
    (1, [2, 2, 4]),
    (2, [0, 5, 1]),
    (3, [-1, -1, -1]),
]


def samples_df(spark, rows, party=1):
    data = [(r, party, j, s) for r, ss in rows for j, s in enumerate(ss)]
    return spark.createDataFrame(data, "row_id long, party int, hash_id int, sample int")


def cols(df):
    return sorted((r["row_id"], r["col"]) for r in df.collect())


def test_onehot_by_hand(spark):
    got = cols(Q.sketch_table(samples_df(spark, TINY), n=5, k=3))
    # col = n*j + n - s
    want = sorted([(0, 4), (0, 5), (0, 12), (1, 3), (1, 8), (1, 11), (2, 5), (2, 14)])
    assert got == want


def test_hash_c2_all_a_equal_one(spark):
    a, b = Q.hash_params(2, 3)
    assert a == [1, 1, 1]
    got = cols(Q.sketch_table(samples_df(spark, TINY), n=5, k=3, c=2))
    want = []
    for r, ss in TINY:
        for j, s in enumerate(ss):
            if s >= 1:
                h = (a[j] * s + b[j]) % 2 + 1
                want.append((r, 2 * j + 2 - h))
    assert got == sorted(want)


def test_bbit(spark):
    got = cols(Q.sketch_table(samples_df(spark, TINY), n=5, k=3, b=1))
    want = sorted((r, 2 * j + 2 - (s % 2 + 1)) for r, ss in TINY for j, s in enumerate(ss) if s >= 1)
    assert got == want


def test_one_per_row_hash_and_empty_row(spark):
    got = Q.sketch_table(samples_df(spark, TINY), n=5, k=3).collect()
    assert 3 not in {r["row_id"] for r in got}          # empty row emits nothing
    per = {}
    for r in got:
        per.setdefault(r["row_id"], []).append(r["col"] // 5)
    for blocks in per.values():
        assert len(blocks) == len(set(blocks))          # at most one 1 per hash block


def test_bad_mode(spark):
    with pytest.raises(ValueError):
        Q.sketch_table(samples_df(spark, TINY), n=5, k=3, b=1, c=2)


def test_joint_equals_onehot_of_concatenation(spark):
    # party 1: features 1..2, party 2: features 3..5 (local 1..3); k1 = 1, k2 = 2
    p1 = [(0, [2]), (1, [1])]
    p2 = [(0, [3, 1]), (1, [-1, 2])]
    s = samples_df(spark, p1, 1).unionByName(samples_df(spark, p2, 2))
    joint = cols(Q.sketch_joint(s, n=5, n1=2, k1=1, k2=2))
    concat = [(0, [2, 3 + 2, 1 + 2]), (1, [1, -1, 2 + 2])]
    one = cols(Q.sketch_table(samples_df(spark, concat), n=5, k=3))
    assert joint == one


def test_indep_hash_small_party_stays_onehot(spark):
    # n1 = 2 <= c = 3 keeps one-hot of width 2; n2 = 6 > c is hashed to 3
    p1 = [(0, [2]), (1, [1])]
    p2 = [(0, [6, 1]), (1, [4, -1])]
    s = samples_df(spark, p1, 1).unionByName(samples_df(spark, p2, 2))
    got = cols(Q.sketch_independent(s, n1=2, n2=6, k1=1, k2=2, c=3))
    a, b = Q.hash_params(3, 3)
    want = [(0, 2 * 0 + 2 - 2), (1, 2 * 0 + 2 - 1)]
    for r, ss in p2:
        for t, v in enumerate(ss):
            if v >= 1:
                h = (a[1 + t] * v + b[1 + t]) % 3 + 1
                want.append((r, 3 * t + 3 - h + 2 * 1))
    assert got == sorted(want)
    assert Q.independent_width(2, 6, 1, 2, c=3) == (2, 6)


def test_encode_two_party_cut(spark):
    p1 = [(0, [2])]
    p2 = [(0, [3, 1])]
    s = samples_df(spark, p1, 1).unionByName(samples_df(spark, p2, 2))
    got = sorted((r["party"], r["col"]) for r in Q.encode_two_party(s, n=5, k1=1).collect())
    # glued samples [2, 3, 1], one-hot n = 5: cols 3, 7, 14; cut at 5
    assert got == [(1, 3), (2, 2), (2, 9)]


def test_recut_border_vs_ratio():
    # reference defect: floor(c*k*p) differs from the party border c*floor(k*p)
    assert int(4 * 2048 * 0.3) != 4 * int(2048 * 0.3)


def test_encode_two_party_test_form_keeps_whole_row(spark):
    p1 = [(0, [2])]
    p2 = [(0, [3, -1])]
    s = samples_df(spark, p1, 1).unionByName(samples_df(spark, p2, 2))
    got = sorted(r["col"] for r in Q.encode_two_party(s, n=5, k1=1, cut=False).collect())
    assert got == [3, 7]


def test_hash_params_follow_the_seeded_legacy_stream():
    import numpy as np

    np.random.seed(1)
    a = np.random.randint(low=1, high=7, size=5)
    b = np.random.randint(low=0, high=7, size=5)
    assert Q.hash_params(7, 5) == ([int(x) for x in a], [int(x) for x in b])
    with pytest.raises(ValueError):
        Q.hash_params(1, 3)


def test_lists_equal_single_jobs(spark):
    """Every (method, k, size) of the job over lists equals the job for it alone."""
    n, p = 12, 0.3
    samples = {}
    for method in ("pminhash", "0bitcws"):
        for k in (4, 10):
            k1 = int(k * p)
            rows = [("train" if r % 3 else "test", r, 1 if j < k1 else 2, j if j < k1 else j - k1, -1 if (r + j) % 5 == 0 else 1 + (7 * r + j) % (3 if j < k1 else 9))
                    for r in range(20) for j in range(k)]
            samples[method, k] = spark.createDataFrame(rows, "split string, row_id long, party int, hash_id int, sample int")
    sizes = {"pminhash": [2, 4, 40], "0bitcws": [1, 3]}
    for cut in ("border", "ratio"):
        got = {}
        for r in Q.squeeze_lists(samples, sizes, n, p, cut).collect():
            got.setdefault((r.method, r.k, r["size"]), []).append((r.split, r.party, r.row_id, r.col, r.squeeze))
        for (method, k), table in samples.items():
            for size in sizes[method]:
                want = [(r.split, r.party, r.row_id, r.col, r.squeeze) for r in Q.squeeze_job({method: table}, [(method, size)], n, p, k, cut).collect()]
                assert sorted(got.pop((method, k, size))) == sorted(want)
        assert not got
