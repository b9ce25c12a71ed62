"""Registered queries for sources, sinks, run records and shares (A, I).

Round-trip queries write below the shared checkpoint folder (a fresh
sub-folder per call) and read back, so the scan is what gets checked.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skein.functions.hashing import r6
from skein.operators import columns as C
from skein.operators import shares as I
from skein.operators import squeeze as Q
from skein.plans import fixtures as X
from skein.plans.sketch_queries import (B_BITS, DOC_BASE, K1, K2, KH, N, N1, N2, P, SQUEEZE_COMBOS, _doc_split_sql,
                                        _squeeze_sql, doc_samples, sql_samples, squeeze_inputs)
from skein.plans.sqltext import key, with_
from skein.plans.sqltext import r6 as s6
from skein.session import scratch_path, write_once
from skein.sources import matrixio as M
from skein.sources import runlog as RL

QUERIES: dict = {}
ORACLE: dict = {}

SHARE_SEED = 7
LI_N1 = int(math.floor(6 * P))


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ------------------------------------------------------------ A1
@q("scan_svmlight", with_(*DOC_BASE, ("lab", """SELECT row_id, label, row_number() OVER (ORDER BY row_id) - 1 AS line
    FROM doc_rows WHERE label IS NOT NULL""")) + """
SELECT l.line AS row_id, l.label, c.feature_id, c.value FROM lab l JOIN doc_cells c ON l.row_id = c.row_id""")
def _scan_svmlight(spark, sf):
    path = scratch_path(spark, "svmlight")
    rows = X.doc_rows(spark, sf).where(F.col("label").isNotNull())
    M.write_svmlight(rows, X.doc_cells(spark, sf), path)
    r, c = M.read_svmlight(spark, path)
    return c.join(r, "row_id").select("row_id", F.col("label").cast("int"), "feature_id", "value")


# ------------------------------------------------------------ A2
@q("scan_dense_matrix", with_(("emb_cells", X.SQL_EMB_CELLS)) + """
SELECT l.line AS row_id, c.feature_id, c.value FROM emb_cells c
JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS line FROM embeddings) l ON c.row_id = l.vec_id""")
def _scan_dense_matrix(spark, sf):
    path = scratch_path(spark, "matrix")
    M.write_matrix(X.emb_wide(spark, sf), path, fmt="repr")
    return C.to_long(M.read_matrix(spark, path, "double"))


# ------------------------------------------------------------ A3
def _bbit_indep_sql():
    w = 2**B_BITS
    return (f"SELECT row_id, CAST({w} * hash_id + {w} - ((sample % {w}) + 1) + CASE WHEN party = 2 THEN {w * K1} ELSE 0 END AS BIGINT) AS col "
            "FROM s_samples WHERE sample NOT IN (-1, 0)")


@q("write_dense_matrix", with_(*DOC_BASE, *sql_samples("pminhash"), ("sk", _bbit_indep_sql()),
                               ("ln", "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS line FROM doc_rows")) + """
SELECT l.line AS row_id, CAST(s.col + 1 AS INTEGER) AS feature_id, CAST(1 AS BIGINT) AS value
FROM sk s JOIN ln l ON s.row_id = l.row_id""")
def _write_dense_matrix(spark, sf):
    sk = Q.sketch_independent(doc_samples(spark, sf), N1, N2, K1, K2, b=B_BITS)
    width = sum(Q.independent_width(N1, N2, K1, K2, b=B_BITS))
    cells = sk.select("row_id", (F.col("col") + 1).cast("int").alias("feature_id"), F.lit(1.0).alias("value"))
    wide = C.to_wide(cells, X.doc_rows(spark, sf), width)
    path = scratch_path(spark, "onehot")
    M.write_matrix(wide, path, fmt="%d")
    back = M.read_matrix(spark, path, "bigint")
    return back.select("row_id", F.posexplode("features").alias("pos", "value")).where(F.col("value") != 0).select(
        "row_id", (F.col("pos") + 1).cast("int").alias("feature_id"), "value")


# ------------------------------------------------------------ A4
@q("catalog_read", with_(*DOC_BASE, *sql_samples("pminhash"), *sql_samples("0bitcws", prefix="w"), _doc_split_sql(),
                         ("sq", _squeeze_sql())) + """
SELECT party, row_id, col FROM sq WHERE method = 'pminhash' AND size = 4 AND split = 'test'""")
def _catalog_read(spark, sf):
    root = scratch_path(spark, "catalog")
    job = write_once(Q.squeeze_job(squeeze_inputs(spark, sf), SQUEEZE_COMBOS, N, P, KH))
    for dataset, portion in (("doc", X.PORTION), ("doc", X.PORTION), ("other", X.PORTION), ("doc", 46)):  # one of them written twice
        M.write_sketch(job, root, dataset, portion)
    got = M.read_sketch(spark, root, dataset="doc", portion=X.PORTION, method="pminhash", size=4, split="test")
    return got.select(F.col("party").cast("int"), "row_id", "col")


# ------------------------------------------------------------ A5, A6
@q("append_runs", with_(("runs", X.SQL_RUNS)) + "SELECT * FROM runs")
def _append_runs(spark, sf):
    root = scratch_path(spark, "runs")
    runs = X.runs(spark, sf)
    RL.append_runs(runs, root, "a")
    for _ in range(2):  # as a rerun does
        RL.append_runs(runs, root, "b")
    return RL.read_runs(spark, root, "b").drop("dataset")


def _parse_sql():
    ext = lambda pat: f"regexp_extract(run_name, '{pat}', 1)"
    return f"""SELECT folder, run_name,
        CAST({ext('alpha=(.*?)_batch_size=')} AS DOUBLE) AS alpha,
        CAST({ext('batch_size=(.*?)_max_iter=')} AS INTEGER) AS batch_size,
        CAST({ext('max_iter=(.*?)_lambda_para=')} AS INTEGER) AS max_iter,
        CAST({ext('lambda_para=(.*?)_C=')} AS DOUBLE) AS lambda_para,
        CAST({ext('C=(.*?)_sigmoid_func=')} AS DOUBLE) AS c,
        {ext('sigmoid_func=(.*?)(\\.txt)?$')} AS sigmoid_func,
        arg_max(CASE WHEN regexp_extract(line, 'best_acc=(.*)$', 1) <> ''
                     THEN CAST(regexp_extract(line, 'best_acc=(.*)$', 1) AS DOUBLE) END,
                CASE WHEN regexp_extract(line, 'best_acc=(.*)$', 1) <> '' THEN line_no END) AS best_acc,
        coalesce(arg_max(CASE WHEN regexp_extract(line, 'best_epoch=(.*)$', 1) <> ''
                     THEN CAST(regexp_extract(line, 'best_epoch=(.*)$', 1) AS INTEGER) END,
                CASE WHEN regexp_extract(line, 'best_epoch=(.*)$', 1) <> '' THEN line_no END), -1) AS best_epoch
      FROM log_lines GROUP BY folder, run_name"""


@q("scan_run_logs", with_(("log_lines", X.SQL_LOG_LINES)) + _parse_sql())
def _scan_run_logs(spark, sf):
    """Logs of two folders whose files share their names, written as files."""
    root = scratch_path(spark, "logs")
    RL.write_run_logs(X.log_files(spark, sf), root)
    return RL.read_run_logs(spark, root).withColumn("best_epoch", F.coalesce("best_epoch", F.lit(-1)))


# ------------------------------------------------------------ I1-I3
#: seed of the kept share; a secret of the holder in real use
LI_CELLS = ("lc", """SELECT row_id, feature_id, value FROM (
    SELECT row_id, CAST(unnest(generate_series(1, len(features))) AS INTEGER) AS feature_id, unnest(features) AS value FROM li) t
    UNION ALL SELECT row_id, 0, CAST(label AS DOUBLE) FROM li""")
MOD = "9223372036854775808"


def _share_sql():
    h = f"CAST(CAST(('0x' || substr(md5({key(str(SHARE_SEED), 'row_id', 'feature_id')}), 1, 16)) AS UBIGINT) AS HUGEINT)"
    r = f"({h} % {MOD})"
    x = f"((CAST(round(value * 65536.0) AS HUGEINT) % {MOD} + {MOD}) % {MOD})"
    return ("sh", f"SELECT row_id, feature_id, value, {r} AS s1, ((({x} - {r}) % {MOD}) + {MOD}) % {MOD} AS s2 FROM lc")


@q("split_shares", with_(("li", X.sql_li_wide()), LI_CELLS, _share_sql()) + """
SELECT 1 AS holder, row_id, feature_id, CAST(s1 AS VARCHAR) AS share FROM sh
UNION ALL SELECT 2, row_id, feature_id, CAST(s2 AS VARCHAR) FROM sh""")
def _split_shares(spark, sf):
    cells = C.to_long(X.li_wide(spark, sf).select("row_id", "features")).unionByName(
        _li_zero_cells(spark, sf))
    kept, given = I.split_shares(cells, ["row_id", "feature_id"], seed=SHARE_SEED)
    return kept.select(F.lit(1).alias("holder"), "row_id", "feature_id", F.col("share").cast("string")).unionByName(
        given.select(F.lit(2).alias("holder"), "row_id", "feature_id", F.col("share").cast("string")))


def _li_zero_cells(spark, sf):
    """Zero-valued cells of the LI matrix (to_long drops them; shares keep
    every cell) plus the label (+1/-1) as feature 0, so the label is shared
    too and negative values take the signed path."""
    w = X.li_wide(spark, sf)
    zeros = w.select("row_id", F.posexplode("features").alias("pos", "value")).where(F.col("value") == 0).select(
        "row_id", (F.col("pos") + 1).cast("int").alias("feature_id"), F.col("value").cast("double"))
    return zeros.unionByName(w.select("row_id", F.lit(0).alias("feature_id"), F.col("label").cast("double").alias("value")))


@q("reconstruct_shares", with_(("li", X.sql_li_wide()), LI_CELLS) + f"""
SELECT row_id, feature_id, CAST(round(value * 65536.0) AS DOUBLE) / 65536.0 AS value FROM lc""")
def _reconstruct_shares(spark, sf):
    cells = C.to_long(X.li_wide(spark, sf).select("row_id", "features")).unionByName(_li_zero_cells(spark, sf))
    kept, given = I.split_shares(cells, ["row_id", "feature_id"], seed=SHARE_SEED)
    return I.reconstruct_shares(kept, given, ["row_id", "feature_id"])


@q("transfer_cost", with_(("li", X.sql_li_wide()), LI_CELLS, _share_sql(), ("t", f"""
SELECT CASE WHEN feature_id = 0 THEN 'Y' WHEN feature_id <= {LI_N1} THEN 'X1' ELSE 'X2' END AS table_name, s2 FROM sh""")) + """
SELECT table_name, count(*) AS cells, CAST(8 * count(*) AS BIGINT) AS bytes, CAST(sum(length(CAST(s2 AS VARCHAR))) AS BIGINT) AS text_bytes
FROM t GROUP BY table_name""")
def _transfer_cost(spark, sf):
    cells = C.to_long(X.li_wide(spark, sf).select("row_id", "features")).unionByName(_li_zero_cells(spark, sf))
    _, given = I.split_shares(cells, ["row_id", "feature_id"], seed=SHARE_SEED)
    name = F.when(F.col("feature_id") == 0, "Y").when(F.col("feature_id") <= LI_N1, "X1").otherwise("X2")
    return I.transfer_size(given.withColumn("table_name", name), "table_name")
