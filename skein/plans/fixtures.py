"""Test fixtures derived from the given tables (EMB, DOC, LI, RUN).

Each builder has a Spark form (DataFrame) and a DuckDB form (a CTE body used
by the oracle SQL); both compute the same rows from the same parquet files.
Nothing here is random: hashed "randomness" comes from md5 of a key.
"""

from __future__ import annotations

from hashlib import md5
from string import ascii_letters

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.hashing import sql_h32

# Fixed fixture parameters.
DOC_WIDTH = 4096          # hashed token space of the DOC fixture
DOC_HASHES = 16           # k for sampling queries
PORTION = 37              # party split 0.3 / 0.7
EMB_WIDTH = 64
TOKEN_RE = "[A-Za-z]+"

# Parameter lists for the RUN fixture, picked by o_orderkey % len(list).
RUN_SIGMOIDS = ["linear", "cube", "segmentation", "origin"]
RUN_BATCH_SIZES = [20, 64, 4096]
RUN_ALPHAS = ["0.0001", "0.0005", "0.001", "0.005", "0.01"]
RUN_LAMBDAS = ["0", "1"]
RUN_CS = ["0.5", "1", "2"]
RUN_MAX_ITER = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- EMB
def emb_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )


def emb_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skein.operators.columns import to_long

    return to_long(emb_wide(spark, sf_dir))


SQL_EMB_WIDE = """
  SELECT vec_id AS row_id, CAST(label AS INTEGER) AS label,
         CAST(embedding AS DOUBLE[]) AS features
  FROM embeddings"""

SQL_EMB_CELLS = """
  SELECT row_id, feature_id, value FROM (
    SELECT vec_id AS row_id,
           CAST(unnest(generate_series(1, len(embedding))) AS INTEGER) AS feature_id,
           CAST(unnest(embedding) AS DOUBLE) AS value
    FROM embeddings) t
  WHERE value <> 0"""


# ---------------------------------------------------------------- DOC
def doc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    base = d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), F.col("quality").cast("int").alias("label")
    )
    # Two rows with no cells exercise the empty-row rule.
    spark_empty = spark.range(1, 3).select(
        (-F.col("id")).alias("row_id"), F.lit(None).cast("int").alias("label")
    )
    return base.unionByName(spark_empty)


def doc_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row ids of DOC (documents plus the two empty rows), without labels."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"))
    return d.unionByName(spark.range(1, 3).select((-F.col("id")).alias("row_id")))


def _token_counts(width: int):
    """Arrow batches (row_id, text) -> (row_id, features, counts), one row per
    id of a batch that has a token. A batch's distinct tokens are hashed once."""
    spaced = bytes(c if chr(c) in ascii_letters else 32 for c in range(256))

    def run(batches):
        for batch in batches:
            ids = batch.column(0).dictionary_encode("encode")
            texts = batch.column(1).fill_null("")
            valid, ends, data = texts.buffers()
            texts = pa.Array.from_buffers(texts.type, len(texts), [valid, ends, pa.py_buffer(data.to_pybytes().translate(spaced) if data else b"")], offset=texts.offset)
            words = pc.ascii_split_whitespace(texts)
            tokens = words.flatten().dictionary_encode()
            feature = np.array([1 + int.from_bytes(md5(t.encode()).digest()[:4], "big") % width if t else 0 for t in tokens.dictionary.to_pylist()], np.int64)
            of = feature[tokens.indices.to_numpy()] if len(feature) else np.zeros(0, np.int64)
            row = np.repeat(ids.indices.to_numpy().astype(np.int64), pc.list_value_length(words).to_numpy())
            keys, counts = np.unique((row * (width + 1) + of)[of > 0], return_counts=True)  # 0: what is before the first token or after the last
            starts = np.searchsorted(keys, np.arange(len(ids.dictionary) + 1) * (width + 1)).astype(np.int32)
            some = np.flatnonzero(np.diff(starts))
            offsets = pa.array(np.append(starts[some], len(keys)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((keys % (width + 1)).astype(np.int32), counts.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([ids.dictionary.take(pa.array(some)), *lists], names=["row_id", "features", "counts"])

    return run


def _counted_docs(spark: SparkSession, sf_dir: str, width: int, only: DataFrame | None) -> DataFrame:
    """(row_id, features, counts), dealt out by row_id; several rows may have one id."""
    from skein.session import spread

    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    if only is not None:
        d = d.join(only.select(F.col("row_id").alias("doc_id")), "doc_id", "left_semi")
    counted = spread(d).mapInArrow(_token_counts(width), f"row_id {d.schema['doc_id'].dataType.simpleString()}, features array<int>, counts array<bigint>")
    return counted.repartition("row_id")


def doc_vectors(spark: SparkSession, sf_dir: str, width: int = DOC_WIDTH, only: DataFrame | None = None) -> DataFrame:
    """The cells of ``doc_cells`` as one row per document that has any:
    (row_id, features, counts). A feature may come twice where documents share
    an id; its counts then add up (``rowtiles.row_vectors``)."""
    parts = _counted_docs(spark, sf_dir, width, only).groupBy("row_id").agg(F.collect_list(F.struct("features", "counts")).alias("e"))
    return parts.select("row_id", F.flatten("e.features").alias("features"), F.flatten("e.counts").alias("counts"))


def doc_cells(spark: SparkSession, sf_dir: str, width: int = DOC_WIDTH, only: DataFrame | None = None) -> DataFrame:
    """Token counts of documents; of those in ``only`` (row_id), if given.

    Tokens are the maximal runs of [A-Za-z]. They are counted where the text
    is, and what is dealt out by row_id is one pair of arrays per document, so
    that whatever groups or joins the cells by row_id shuffles nothing more.
    """
    cells = _counted_docs(spark, sf_dir, width, only).select("row_id", F.inline(F.arrays_zip("features", "counts")).alias("feature_id", "n"))
    return cells.groupBy("row_id", "feature_id").agg(F.sum("n").cast("double").alias("value"))  # several rows may have one id


SQL_DOC_ROWS = """
  SELECT d.doc_id AS row_id, CAST(l.quality AS INTEGER) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL SELECT CAST(-1 AS BIGINT), CAST(NULL AS INTEGER)
  UNION ALL SELECT CAST(-2 AS BIGINT), CAST(NULL AS INTEGER)"""


def sql_doc_cells(width: int = DOC_WIDTH) -> str:
    return f"""
  SELECT row_id, feature_id, CAST(count(*) AS DOUBLE) AS value FROM (
    SELECT doc_id AS row_id,
           CAST(1 + {sql_h32('tok')} % {width} AS INTEGER) AS feature_id
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN_RE}')) AS tok FROM documents) x
  ) y GROUP BY row_id, feature_id"""


# ---------------------------------------------------------------- LI
def li_wide(spark: SparkSession, sf_dir: str, classes: int = 2) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    agg = li.groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("f1"),
        F.count(F.lit(1)).cast("double").alias("f2"),
        F.max("l_extendedprice").alias("f3"),
        F.max("l_discount").alias("f4"),
        F.max("l_tax").alias("f5"),
    )
    j = agg.join(o, agg.l_orderkey == o.o_orderkey, "inner")
    if classes == 2:
        label = F.when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(-1))
    else:
        label = (
            F.when(F.col("o_orderstatus") == "F", F.lit(0))
            .when(F.col("o_orderstatus") == "O", F.lit(1))
            .otherwise(F.lit(2))
        )
    return j.select(
        F.col("l_orderkey").alias("row_id"),
        label.cast("int").alias("label"),
        F.array("f1", "f2", "f3", "f4", "f5", F.lit(1.0)).alias("features"),
    )


def sql_li_wide(classes: int = 2) -> str:
    if classes == 2:
        label = "CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE -1 END"
    else:
        label = "CASE WHEN o.o_orderstatus = 'F' THEN 0 WHEN o.o_orderstatus = 'O' THEN 1 ELSE 2 END"
    return f"""
  SELECT a.l_orderkey AS row_id, CAST({label} AS INTEGER) AS label,
         [a.f1, a.f2, a.f3, a.f4, a.f5, 1.0::DOUBLE] AS features
  FROM (SELECT l_orderkey, sum(l_quantity) AS f1, CAST(count(*) AS DOUBLE) AS f2,
               max(l_extendedprice) AS f3, max(l_discount) AS f4, max(l_tax) AS f5
        FROM lineitem GROUP BY l_orderkey) a
  JOIN orders o ON a.l_orderkey = o.o_orderkey"""


# ---------------------------------------------------------------- RUN
def _pick(values: list, key):
    expr = None
    n = len(values)
    for i, v in enumerate(values):
        expr = (F.when(key % n == i, F.lit(v)) if expr is None else expr.when(key % n == i, F.lit(v)))
    return expr


def _sql_pick(values: list, key: str, quote: bool = True) -> str:
    n = len(values)
    parts = " ".join(
        f"WHEN {key} % {n} = {i} THEN {repr(v) if quote else v}" for i, v in enumerate(values)
    )
    return f"(CASE {parts} END)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("run_id"),
        _pick(RUN_SIGMOIDS, k).alias("sigmoid_func"),
        _pick(RUN_BATCH_SIZES, k).cast("int").alias("batch_size"),
        _pick(RUN_ALPHAS, k).cast("double").alias("alpha"),
        _pick(RUN_LAMBDAS, k).cast("double").alias("lambda_para"),
        _pick(RUN_CS, k).cast("double").alias("c"),
        ((k * 7919) % 1000 / F.lit(1000.0)).alias("best_acc"),
        (F.lit(1) + F.col("o_custkey") % 200).cast("int").alias("best_epoch"),
    )


SQL_RUNS = f"""
  SELECT o_orderkey AS run_id,
         {_sql_pick(RUN_SIGMOIDS, 'o_orderkey')} AS sigmoid_func,
         CAST({_sql_pick(RUN_BATCH_SIZES, 'o_orderkey', False)} AS INTEGER) AS batch_size,
         CAST({_sql_pick(RUN_ALPHAS, 'o_orderkey')} AS DOUBLE) AS alpha,
         CAST({_sql_pick(RUN_LAMBDAS, 'o_orderkey')} AS DOUBLE) AS lambda_para,
         CAST({_sql_pick(RUN_CS, 'o_orderkey')} AS DOUBLE) AS c,
         ((o_orderkey * 7919) % 1000) / 1000.0 AS best_acc,
         CAST(1 + o_custkey % 200 AS INTEGER) AS best_epoch
  FROM orders"""


def _run_name(k, cols: dict):
    return F.concat(
        F.lit("run="), k.cast("string"),
        F.lit("_alpha="), cols["alpha"],
        F.lit("_batch_size="), cols["batch_size"],
        F.lit(f"_max_iter={RUN_MAX_ITER}_lambda_para="), cols["lambda_para"],
        F.lit("_C="), cols["c"],
        F.lit("_sigmoid_func="), cols["sigmoid_func"],
        F.lit(".txt"),
    )


def run_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text form of the run logs: (run_name, line_no, line).

    Line 1 is an early ``best_acc=0``; the real ``best_acc=`` / ``best_epoch=``
    lines follow, so the parser must keep the last occurrence.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    cols = {
        "alpha": _pick(RUN_ALPHAS, k),
        "batch_size": _pick([str(b) for b in RUN_BATCH_SIZES], k),
        "lambda_para": _pick(RUN_LAMBDAS, k),
        "c": _pick(RUN_CS, k),
        "sigmoid_func": _pick(RUN_SIGMOIDS, k),
    }
    acc = F.concat(F.lit("best_acc=0."), F.lpad(((k * 7919) % 1000).cast("string"), 3, "0"))
    ep = F.concat(F.lit("best_epoch="), (F.lit(1) + F.col("o_custkey") % 200).cast("string"))
    lines = F.array(
        F.struct(F.lit(1).alias("line_no"), F.lit("best_acc=0").alias("line")),
        F.struct(F.lit(2).alias("line_no"), F.lit("accuracy_lst=[]").alias("line")),
        F.struct(F.lit(3).alias("line_no"), acc.alias("line")),
        F.struct(F.lit(4).alias("line_no"), ep.alias("line")),
    )
    return o.select(_run_name(k, cols).alias("run_name"), F.explode(lines).alias("l")).select(
        "run_name", F.col("l.line_no").cast("int").alias("line_no"), F.col("l.line").alias("line")
    )


def _sql_run_name() -> str:
    k = "o_orderkey"
    return (
        f"'run=' || CAST({k} AS VARCHAR) || '_alpha=' || {_sql_pick(RUN_ALPHAS, k)}"
        f" || '_batch_size=' || {_sql_pick([str(b) for b in RUN_BATCH_SIZES], k)}"
        f" || '_max_iter={RUN_MAX_ITER}_lambda_para=' || {_sql_pick(RUN_LAMBDAS, k)}"
        f" || '_C=' || {_sql_pick(RUN_CS, k)}"
        f" || '_sigmoid_func=' || {_sql_pick(RUN_SIGMOIDS, k)} || '.txt'"
    )


SQL_RUN_LINES = f"""
  SELECT {_sql_run_name()} AS run_name, 1 AS line_no, 'best_acc=0' AS line FROM orders
  UNION ALL
  SELECT {_sql_run_name()}, 2, 'accuracy_lst=[]' FROM orders
  UNION ALL
  SELECT {_sql_run_name()}, 3,
         'best_acc=0.' || lpad(CAST((o_orderkey * 7919) % 1000 AS VARCHAR), 3, '0') FROM orders
  UNION ALL
  SELECT {_sql_run_name()}, 4, 'best_epoch=' || CAST(1 + o_custkey % 200 AS VARCHAR) FROM orders"""


# ---------------------------------------------------------------- run log files
LOG_FOLDERS = ["doc_37_pminhash64", "doc_37_0bitcws64"]


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(folder, run_name, text): a log per customer, alternating between two
    folders that hold the same file names. Some logs lack best_epoch; the key
    may stand after blanks."""
    k = F.floor(F.col("c_custkey") / 2)
    cols = {"alpha": _pick(RUN_ALPHAS, k), "batch_size": _pick([str(b) for b in RUN_BATCH_SIZES], k), "lambda_para": _pick(RUN_LAMBDAS, k),
            "c": _pick(RUN_CS, k), "sigmoid_func": _pick(RUN_SIGMOIDS, k)}
    acc = F.concat(F.lit("  best_acc=0."), F.lpad(((F.col("c_custkey") * 7919) % 1000).cast("string"), 3, "0"))
    epoch = F.when(F.col("c_custkey") % 7 != 0, F.concat(F.lit("\nbest_epoch="), (F.lit(1) + F.col("c_custkey") % 200).cast("string"))).otherwise("")
    return table(spark, sf_dir, "customer").select("c_custkey").select(
        _pick(LOG_FOLDERS, F.col("c_custkey")).alias("folder"), _run_name(k, cols).alias("run_name"),
        F.concat(F.lit("best_acc=0\naccuracy_lst=[]\n"), acc, epoch, F.lit("\n")).alias("text"))


def _sql_log(line_no: int, line: str, where: str = "true") -> str:
    name = _sql_run_name().replace("o_orderkey", "k")
    return (f"SELECT {_sql_pick(LOG_FOLDERS, 'c_custkey')} AS folder, {name} AS run_name, {line_no} AS line_no, {line} AS line "
            f"FROM (SELECT c_custkey, c_custkey // 2 AS k FROM customer) t WHERE {where}")


SQL_LOG_LINES = "\n  UNION ALL\n  ".join([
    _sql_log(1, "'best_acc=0'"), _sql_log(2, "'accuracy_lst=[]'"),
    _sql_log(3, "'  best_acc=0.' || lpad(CAST((c_custkey * 7919) % 1000 AS VARCHAR), 3, '0')"),
    _sql_log(4, "'best_epoch=' || CAST(1 + c_custkey % 200 AS VARCHAR)", "c_custkey % 7 <> 0")])
