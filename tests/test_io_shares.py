import os
import re

import pytest
from pyspark.sql import functions as F

from skein.operators import columns as C
from skein.operators import shares as I
from skein.session import scratch_path
from skein.sources import matrixio as M
from skein.sources import runlog as RL


def _write(path, lines):
    path = path[len("file:"):] if path.startswith("file:") else path
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_svmlight_one_and_zero_based(spark):
    base = scratch_path(spark, "svm")
    _write(f"{base}/one.txt", ["1 1:0.5 3:2", "-1 2:1", "1 4:1.5 5:1", "0 1:1"])
    rows, cells = M.read_svmlight(spark, f"{base}/one.txt")
    assert [r["label"] for r in rows.orderBy("row_id").collect()] == [1, -1, 1, 0]
    assert sorted((r["row_id"], r["feature_id"], r["value"]) for r in cells.collect())[:2] == [(0, 1, 0.5), (0, 3, 2.0)]
    _write(f"{base}/zero.txt", ["1 0:0.5 2:2", "-1 1:1"])
    _, z = M.read_svmlight(spark, f"{base}/zero.txt")
    assert sorted(r["feature_id"] for r in z.collect()) == [1, 2, 3]


def test_matrix_round_trip_keeps_order(spark):
    rows = [(i, 0, [float(i), i * 0.25, -1.0 / (i + 1)]) for i in range(50)]
    wide = spark.createDataFrame(rows, "row_id long, label int, features array<double>").repartition(7)
    path = scratch_path(spark, "mat")
    M.write_matrix(wide, path, fmt="repr")
    back = {r["row_id"]: r["features"] for r in M.read_matrix(spark, path).collect()}
    assert back == {i: f for i, _, f in rows}


def test_to_wide_restores_zeros(spark):
    cells = spark.createDataFrame([(1, 2, 3.0)], "row_id long, feature_id int, value double")
    rows = spark.createDataFrame([(1, 0), (2, 1)], "row_id long, label int")
    got = {r["row_id"]: r["features"] for r in C.to_wide(cells, rows, 3).collect()}
    assert got == {1: [0.0, 3.0, 0.0], 2: [0.0, 0.0, 0.0]}


def test_run_logs_last_line_wins(spark):
    base = scratch_path(spark, "logs")
    name = "alpha=0.01_batch_size=20_max_iter=200_lambda_para=1_C=2_sigmoid_func=cube.txt"
    _write(f"{base}/{name}", ["best_acc=0", "best_acc=0.91", "best_epoch=7"])
    _write(f"{base}/alpha=0.1_batch_size=64_max_iter=10_lambda_para=0_C=1_sigmoid_func=linear.txt", ["nothing"])
    _write(f"{base}/other/{name}", ["  best_acc=0.5 ", "best_acc=", "best_epoch=x"])  # the same name in another folder
    rows = RL.read_run_logs(spark, base).collect()
    other = [r for r in rows if r["folder"] == "other"]
    assert len(rows) == 3 and (other[0]["best_acc"], other[0]["best_epoch"]) == (0.5, None)
    got = {r["sigmoid_func"]: r for r in rows if r["folder"] != "other"}
    assert (got["cube"]["best_acc"], got["cube"]["best_epoch"], got["cube"]["batch_size"]) == (0.91, 7, 20)
    assert got["linear"]["best_acc"] is None and got["linear"]["alpha"] == 0.1


def test_run_logs_are_dealt_out_evenly(spark):
    """Tasks don't grow with the number of files; empty and hidden files are no logs."""
    root = scratch_path(spark, "logs")
    logs = spark.createDataFrame([(f"f{i % 2}", f"run={i // 2}_alpha=0.5_batch_size=20_.txt", f"best_acc=0.{i:03d}\nbest_epoch={i}\n") for i in range(200)],
                                 "folder string, run_name string, text string")
    RL.write_run_logs(logs, root)
    local = root[len("file:"):] if root.startswith("file:") else root
    for name in ("empty.txt", "_SUCCESS", ".hidden"):
        with open(f"{local}/f0/{name}", "w") as f:
            f.write("" if name == "empty.txt" else "best_acc=1")
    lines = RL.read_log_lines(spark, root)
    assert lines.rdd.getNumPartitions() <= int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = {(r["folder"], r["run_name"]): (r["best_acc"], r["best_epoch"]) for r in RL.parse_run_logs(lines).collect()}
    assert got == {(f"f{i % 2}", f"run={i // 2}_alpha=0.5_batch_size=20_.txt"): (i / 1000, i) for i in range(200)}


def test_document_cells_are_dealt_out_once(spark):
    """Ids that repeat or are null, texts without tokens; grouping by row needs no shuffle of its own."""
    from collections import Counter
    from hashlib import md5

    from skein.plans import fixtures as X

    docs = [(1, "a b, a"), (2, None), (3, "..."), (1, "A b1b"), (None, "x"), (4, ""), (5, "naïve ab")] + [(i, f"w{i} x") for i in range(10, 30)]
    root = scratch_path(spark, "docs")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    want = Counter()
    for i, text in docs:
        for t in re.findall("[A-Za-z]+", text or ""):
            want[i, 1 + int(md5(t.encode()).hexdigest()[:8], 16) % X.DOC_WIDTH] += 1
    cells = X.doc_cells(spark, root)
    assert {(r["row_id"], r["feature_id"]): r["value"] for r in cells.collect()} == want and cells.count() == len(want)
    plan = cells.groupBy("row_id").count()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_to_wide_is_laid_out_in_parts(spark, monkeypatch):
    """Rows between parts, empty rows, rows that come twice, null values; a cell beyond the width fails."""
    monkeypatch.setattr(C, "DENSE_VALUES", 7)
    vals = [(r, f, float(10 * r + f)) for r in range(1, 20) for f in range(1, 4) if (r * f) % 3] + [(50, 2, None)]
    cells = spark.createDataFrame(vals, "row_id long, feature_id int, value double")
    rows = spark.createDataFrame([(r, r) for r in [*range(25), 5, 50]], "row_id long, label int").coalesce(1)
    by = {(r, f): v for r, f, v in vals}
    got = C.to_wide(cells, rows, 3)
    assert "flatten(" not in got._jdf.queryExecution().executedPlan().toString()  # no list per cell
    assert sorted((r["row_id"], r["label"], str(r["features"])) for r in got.collect()) == sorted(
        (r, r, str([by.get((r, f), 0.0) for f in range(1, 4)])) for r in [*range(25), 5, 50])
    with pytest.raises(Exception, match="exceeds declared width"):
        C.to_wide(cells, rows, 1).collect()


def test_shares_reconstruct_exactly(spark):
    vals = [(i, 1, v) for i, v in enumerate([0.0, 1.5, -2.25, 123456.75, -0.000015258789, 7.0])]
    cells = spark.createDataFrame(vals, "row_id long, feature_id int, value double")
    kept, given = I.split_shares(cells, ["row_id", "feature_id"], seed=11)
    back = {r["row_id"]: r["value"] for r in I.reconstruct_shares(kept, given, ["row_id", "feature_id"]).collect()}
    for i, _, v in vals:
        assert back[i] == round(v * 65536) / 65536
    # a share alone reveals nothing obvious: kept shares differ from the encoded values
    assert kept.where(F.col("share") == F.lit(0)).count() <= 1


def test_read_lines_order_across_splits(spark):
    base = scratch_path(spark, "lines")
    lines = [f"{i},{i * 2}" for i in range(20000)]
    _write(f"{base}/part-00000.txt", lines[:12000])
    _write(f"{base}/part-00001.txt", lines[12000:])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")  # many splits per file
    try:
        got = [r["line"] for r in M.read_lines(spark, base).orderBy("row_id").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == lines


def test_read_lines_skips_empty_files_and_keeps_order(spark):
    base = scratch_path(spark, "lines-empty")
    _write(f"{base}/part-00000.txt", ["a", "b", "c"])
    local = base[len("file:"):] if base.startswith("file:") else base
    open(f"{local}/part-00001.txt", "w").close()
    _write(f"{base}/part-00002.txt", ["d", "e"])
    got = [(r["row_id"], r["line"]) for r in M.read_lines(spark, base).orderBy("row_id").collect()]
    assert got == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")]


def test_svmlight_width_comments_and_qid(spark):
    import pytest

    base = scratch_path(spark, "svm")
    _write(f"{base}/one.txt", ["1 qid:3 1:0.5 3:2 # 9:9", "-1 2:1"])
    _, cells = M.read_svmlight(spark, f"{base}/one.txt", zero_based=False, width=3)
    assert sorted(map(tuple, cells.collect())) == [(0, 1, 0.5), (0, 3, 2.0), (1, 2, 1.0)]
    with pytest.raises(Exception, match="exceeds declared width"):
        M.read_svmlight(spark, f"{base}/one.txt", zero_based=False, width=2)[1].collect()


def test_a_catalog_keeps_data_sets_and_portions_apart(spark):
    root = scratch_path(spark, "cat")
    one = spark.createDataFrame([("m", 4, "s", 2, "train", 1, 7, 3)], "method string, k int, squeeze string, size int, split string, party int, row_id long, col long")
    for dataset, portion, col in (("a", 37, 1), ("a", 46, 2), ("b", 37, 3), ("a", 37, 4)):  # the last replaces the first
        M.write_sketch(one.withColumn("col", F.lit(col).cast("long")), root, dataset, portion)
    got = lambda **k: sorted(r["col"] for r in M.read_sketch(spark, root, **k).collect())
    assert got() == [2, 3, 4] and got(dataset="a", portion=37) == [4] and got(dataset="a") == [2, 4]


def test_runs_are_kept_once(spark, tmp_path):
    from skein.sources import runlog as RL

    root = str(tmp_path / "runs")
    first = spark.createDataFrame([(1, 0.5, [0.1, 0.2]), (2, None, None), (2, None, None)], "run_id int, best_acc double, accuracies array<double>")
    more = spark.createDataFrame([(3, 0.7, [0.7])], first.schema)
    for _ in range(3):
        RL.append_runs(first.repartition(2), root, "a")
    RL.append_runs(first, root, "b")
    RL.append_runs(more, root, "a")
    RL.append_runs(more, root, "c", batch="sweep")
    RL.append_runs(first, root, "c", batch="sweep")  # replaces the batch of that name
    for dataset, ids in (("a", [1, 2, 2, 3]), ("b", [1, 2, 2]), ("c", [1, 2, 2])):
        got = RL.read_runs(spark, root, dataset)
        assert sorted(r.run_id for r in got.collect()) == ids and got.columns == [*first.columns, "dataset"]
    RL.append_runs(first.limit(0), root, "d")
    assert RL.read_runs(spark, root, "d").count() == 0


def test_contract_tells_rows_and_widths(spark):
    import pytest

    from skein.operators import columns as C

    def samples(second):
        return spark.createDataFrame([(r, 1, j, 1) for r in (1, 2, 3) for j in (0, 1)] + [(r, 2, 0, 0) for r in second], "row_id long, party int, hash_id int, sample int")

    def report(*a, **b):
        return {r.check: r.value for r in C.check_contract(*a, **b).collect()}

    assert report(samples((3, 1, 2)), 2, 1) == {"rows_party1": 3, "rows_party2": 3, "rows_differ": 0, "bad_hash_count": 0, "bad_sample_values": 0}
    assert report(samples((1, 2, 4)), 2, 1)["rows_differ"] == 1 and report(samples((1, 2)), 2, 1)["rows_differ"] == 1
    sketch = spark.createDataFrame([(1, 0), (1, 3), (1, 4), (2, 2), (2, -1)], "party int, col long")
    assert report(samples((1, 2, 3)), 2, 1, sketch=sketch, widths=(4, 3))["bad_sketch_columns"] == 2
    C.check_contract(samples((1, 2, 3)), 2, 1, strict=True)
    with pytest.raises(ValueError):
        C.check_contract(samples((1, 2, 4)), 2, 1, strict=True)
    assert report(samples(()).limit(0), 2, 1)["rows_differ"] == 0


def test_labels_of_any_number(spark):
    from skein.operators import rows as R

    rows = spark.createDataFrame([(i, i % 4 if i else None) for i in range(9)], "row_id long, label int")
    got = {(r.row_id, r.pos_label): r.y for r in R.ovr_relabel(rows).collect()}
    assert got == {(i, k): int(i > 0 and i % 4 == k) for i in range(9) for k in range(4)}
    assert R.ovr_relabel(rows.limit(0)).count() == 0
