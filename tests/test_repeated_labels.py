"""Documents and labels that repeat: a row for each match, as the SQL joins them."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from skein.plans import registry
from tools.oracle_check import compare, connect


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    docs = [(1, "a b, a"), (2, None), (3, "..."), (4, "one two two"), (4, "one more"), (None, "x"), (5, "no label")]
    labels = [(1, 0, 0), (1, 1, 0), (1, 1, 0), (2, 1, 1), (2, None, 0), (4, 1, 0), (4, 0, 1), (None, 1, 0), (9, 1, 0)]
    for name, rows, types in (("documents", docs, {"doc_id": pa.int64(), "text": pa.string()}),
                              ("labels", labels, {"doc_id": pa.int64(), "quality": pa.int32(), "toxic": pa.int32()})):
        pq.write_table(pa.table({c: pa.array(v, t) for (c, t), v in zip(types.items(), zip(*rows))}), f"{root}/{name}.parquet")
    return str(root)


@pytest.mark.parametrize("name", ["pminhash_samples", "rff_features_wide", "sketch_onehot"])
def test_a_row_for_each_label(spark, root, name):
    ok, msg = compare(spark, connect(root), root, name, registry.queries()[name], registry.oracle_sql()[name])
    assert ok, msg
