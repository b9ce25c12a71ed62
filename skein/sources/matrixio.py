"""Matrix text sources and sinks, and the sketch artifact catalog (A1-A4).

Headerless text matrices identify rows by line number, so a scan assigns
``row_id`` once from (file path, split start, position in split) on the JVM
(files taken in name order, lines in file order); everything downstream
joins on row_id.
Writers sort by row_id, so part files in name order hold rows in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _text_files(spark: SparkSession, path: str) -> list[str]:
    """Data files below ``path`` in name order (a file path is returned as is)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(conf)
    if fs.getFileStatus(p).isFile():
        return [path]
    names = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isFile() and not name.startswith(("_", ".")):
            names.append(st.getPath().toString())
    return sorted(names)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_id BIGINT, line STRING), row_id = 0-based line number over the
    files in name order.

    Inside one file split the lines keep their order and get consecutive
    ``monotonically_increasing_id`` values, so a line's number is the
    split's offset plus (id - first id of the split). Offsets come from one
    aggregate per (file, split start) - a table bounded by the number of
    splits, summed in order and broadcast back. The text is read twice and
    never sorted, shuffled or checkpointed.
    """
    from pyspark.sql import Window

    files = _text_files(spark, path)
    df = spark.read.text(files).select(
        F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"), F.col("value").alias("line"))
    splits = df.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = splits.select("_f", "_b", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return df.join(F.broadcast(offs), ["_f", "_b"]).select(
        (F.col("_off") + F.col("_m") - F.col("_m0")).alias("row_id"), "line")


# ------------------------------------------------------------------ A1
def read_svmlight(spark: SparkSession, path: str, zero_based: str | bool = "auto", width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``label idx:val ...`` lines -> (rows(row_id, label), cells(row_id, feature_id, value)).

    Labels are cast to int. feature_id is 1-based: with zero-based input
    (``True``, or ``"auto"`` and some index is 0) indices are shifted by one;
    name the base where train and test files must agree. A ``#`` starts a
    comment, ``qid:`` tokens are skipped. With a declared ``width`` a cell
    beyond it fails the job.
    """
    lines = read_lines(spark, path).select("row_id", F.split(F.trim(F.substring_index("line", "#", 1)), r"\s+").alias("t"))
    rows = lines.select("row_id", F.element_at("t", 1).cast("double").cast("int").alias("label"))
    pairs = lines.select("row_id", F.explode(F.slice("t", 2, 1 << 30)).alias("p")).where((F.col("p") != "") & ~F.col("p").startswith("qid:"))
    cells = pairs.select(
        "row_id",
        F.substring_index("p", ":", 1).cast("int").alias("idx"),
        F.substring_index("p", ":", -1).cast("double").alias("value"),
    )
    if zero_based == "auto":
        zero_based = bool(cells.where(F.col("idx") == 0).limit(1).count())
    shift = 1 if zero_based else 0
    cells = cells.select("row_id", (F.col("idx") + shift).cast("int").alias("feature_id"), "value").where(F.col("value") != 0)
    if width is not None:
        from skein.operators.columns import resize_features

        cells = resize_features(cells, width).drop("width")
    return rows, cells


def write_svmlight(rows: DataFrame, cells: DataFrame, path: str) -> None:
    """Lines ``label idx:val ...`` with 1-based ascending indices, row_id order."""
    per_row = cells.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("feature_id", "value"))).alias("e"))
    items = F.transform(F.coalesce("e", F.array().cast("array<struct<feature_id:int,value:double>>")),
                        lambda e: F.concat(e["feature_id"].cast("string"), F.lit(":"), e["value"].cast("string")))
    line = F.concat_ws(" ", F.col("label").cast("string"), F.array_join(items, " "))
    (rows.join(per_row, "row_id", "left").select("row_id", F.trim(line).alias("value"))
     .orderBy("row_id").select("value").write.mode("overwrite").text(path))


# ------------------------------------------------------------------ A2, A3
def read_matrix(spark: SparkSession, path: str, dtype: str = "double") -> DataFrame:
    """Comma-separated numbers, one row per line -> (row_id, features ARRAY<dtype>)."""
    lines = read_lines(spark, path)
    return lines.select("row_id", F.transform(F.split(F.trim("line"), ","), lambda x: F.trim(x).cast(dtype)).alias("features"))


def write_matrix(wide: DataFrame, path: str, fmt: str = "%d") -> None:
    """Comma-separated text in row_id order; ``fmt`` is applied per value
    ('%d' casts to integer first, '%.6f' style keeps decimals)."""
    if fmt == "%d":
        cell = lambda x: x.cast("bigint").cast("string")
    elif fmt == "repr":  # shortest text that reads back to the same double
        cell = lambda x: x.cast("string")
    else:
        cell = lambda x: F.format_string(fmt, x)
    text = F.array_join(F.transform("features", cell), ",")
    wide.select("row_id", text.alias("value")).orderBy("row_id").select("value").write.mode("overwrite").text(path)


# ------------------------------------------------------------------ A4
_OPEN_FILES_KEY = "spark.sql.maxConcurrentOutputFileWriters"
#: files that a task of a catalog write has open at once
OPEN_FILES = 32
CATALOG_KEYS = ["dataset", "portion", "method", "k", "squeeze", "size", "split", "party"]


def write_sketch(sketch: DataFrame, root: str, dataset: str, portion: int) -> None:
    """Partitioned Parquet, one folder level per catalog key. What was stored
    under the same keys is replaced, so a rerun leaves one copy.

    A task keeps the files of its first ``OPEN_FILES`` combinations open, so
    its rows need no sort by eight keys; Spark sorts what goes beyond."""
    keyed = sketch.withColumn("dataset", F.lit(dataset)).withColumn("portion", F.lit(portion))
    conf = sketch.sparkSession.conf
    before = conf.get(_OPEN_FILES_KEY)
    conf.set(_OPEN_FILES_KEY, str(OPEN_FILES))
    try:
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*CATALOG_KEYS).parquet(root)
    finally:
        conf.set(_OPEN_FILES_KEY, before)


def read_sketch(spark: SparkSession, root: str, **key) -> DataFrame:
    """Read some combination; filters on partition columns prune folders."""
    df = spark.read.parquet(root)
    for k, v in key.items():
        if k not in CATALOG_KEYS:
            raise ValueError(f"unknown catalog key {k!r}")
        df = df.where(F.col(k) == F.lit(v))
    return df
