"""What is held at once stays bounded, and results don't depend on sizes."""

import pytest
from pyspark.errors import PythonException

from skein.operators import kernels as K
from skein.operators import rowtiles as T
from skein.operators import sampling as SM


def _tables(spark):
    cells = [(r, f, float(1 + (r * f) % 3)) for r in range(12) for f in range(1 + r % 3, 60, 1 + r)]
    rows = spark.createDataFrame([(r,) for r in range(13)], "row_id long")
    return spark.createDataFrame(cells, "row_id long, feature_id int, value double"), rows


@pytest.mark.parametrize("make", [
    lambda c, r, **kw: SM.pminhash_samples(c, r, 60, 20, **kw),
    lambda c, r, **kw: SM.cws_samples(c, r, 60, 20, **kw),
    lambda c, r, **kw: K.rff_features(c, r, 60, 20, 0.1, **kw),
])
@pytest.mark.parametrize("p", [None, 0.3])
def test_tiles_don_t_change_results(spark, monkeypatch, make, p):
    cells, rows = _tables(spark)
    key = lambda df: sorted(map(tuple, df.collect()))
    want = key(make(cells, rows, p=p))
    assert len(want) == 13 * 20
    got = []
    for values, positions in ((7, 3), (64, 1)):
        monkeypatch.setattr(T, "TILE_VALUES", values)
        monkeypatch.setattr(T, "TILE_POSITIONS", positions)
        got.append(key(make(cells, rows, p=p)))
    for g in got:
        assert [x[:3] for x in g] == [x[:3] for x in want]
        assert all(abs(a[3] - b[3]) < 1e-12 for a, b in zip(g, want))


@pytest.mark.parametrize("width,k", [(10, 4), (10, 64), (131_072, 64)])
def test_a_cell_beyond_the_width_fails_at_any_size(spark, width, k):
    cells = spark.createDataFrame([(0, 1, 1.0), (1, width + 1, 1.0)], "row_id long, feature_id int, value double")
    rows = spark.createDataFrame([(0,), (1,)], "row_id long")
    for out in (SM.pminhash_samples(cells, rows, width, k), SM.cws_samples(cells, rows, width, k), K.rff_features(cells, rows, width, k, 1.0)):
        with pytest.raises(PythonException, match="beyond the width"):
            out.collect()
