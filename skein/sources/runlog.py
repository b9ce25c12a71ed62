"""Run records and run logs.

A run log is a small text file whose name carries the parameters
(``alpha=..._batch_size=..._max_iter=..._lambda_para=..._C=..._sigmoid_func=...``)
and whose lines carry ``best_acc=`` / ``best_epoch=``, anywhere in a line; the
last occurrence in a file wins. There is one folder per data set and method,
and files of different folders may share their names, so a log is known by
folder and name. Logs are read whole per file, split into
numbered lines, and reduced with ``max_by(value, line_no)`` per file.
"""

from __future__ import annotations

import os
from itertools import islice

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import cut_lineage, spread
from skein.sources.rowranges import opened

# Parameter keys of the log file name, in file-name order.
NAME_KEYS = ["alpha", "batch_size", "max_iter", "lambda_para", "C", "sigmoid_func"]


def append_runs(runs: DataFrame, root: str, dataset: str, batch: str | None = None) -> None:
    """Append run records, with all their columns, under ``dataset=<name>`` (A5).

    Records are written as one batch, a folder of its own that replaces the
    batch of the same name: a rerun, or a retry after a loss, leaves each
    record once. Without a name the batch is known by its records (their
    number and an order-free hash of all columns).
    """
    if batch is None:
        row = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(runs.columns)])
        n, h = runs.agg(F.count(F.lit(1)), F.coalesce(F.sum((row % (1 << 30)).cast("decimal(38,0)")), F.lit(0))).first()
        batch = f"{n}-{int(h)}"
    (runs.withColumn("dataset", F.lit(dataset)).withColumn("batch", F.lit(batch)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("dataset", "batch").parquet(root))


def read_runs(spark: SparkSession, root: str, dataset: str | None = None) -> DataFrame:
    df = spark.read.option("basePath", root).parquet(root).drop("batch")
    return df if dataset is None else df.where(F.col("dataset") == dataset)


def run_records(accuracies: DataFrame, params: DataFrame, max_iter: int, batch_size: int | None = None) -> DataFrame:
    """Records of trained runs: per model its parameters, ``max_iter``, the
    accuracy of every epoch in order, the best one and its first epoch.

    ``accuracies`` has (model_id, epoch, accuracy); ``params`` one row per
    model_id.
    """
    from skein.operators.evaluate import best_epoch

    per = accuracies.groupBy("model_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("epoch", "accuracy"))), lambda x: x["accuracy"]).alias("accuracy_lst"))
    out = params.join(per, "model_id", "left").join(best_epoch(accuracies, ["model_id"]), "model_id", "left").withColumn("max_iter", F.lit(max_iter))
    return out if batch_size is None else out.withColumn("batch_size", F.lit(batch_size))


def write_run_logs(logs: DataFrame, root: str) -> None:
    """Write (folder, run_name, text) as ``root/folder/run_name`` files, each
    by the task that holds its row."""
    files = logs.select(F.concat_ws("/", F.lit(root.rstrip("/")), "folder", "run_name").alias("path"), "text")

    def run(batches):
        made = {}
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                folder, name = path.rsplit("/", 1)
                if folder not in made:
                    made[folder] = opened(folder)
                    made[folder][0].create_dir(made[folder][1], recursive=True)
                files, local = made[folder][0], f"{made[folder][1]}/{name}"
                with files.open_output_stream(local, compression=None) as out:  # a retry writes the same file
                    out.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    spread(files).mapInArrow(run, "n long").agg(F.sum("n")).collect()


#: files, and bytes of text, that a task hands on at once
FILES, BYTES = 4096, 1 << 23


def _listed(batches):
    """Folders -> what is in each: (path, is_folder). Hidden files are no logs."""
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            files, local = opened(folder)
            if files.get_file_info(local).type == pafs.FileType.File:
                found = iter([(None, False)])
            elif isinstance(files, pafs.LocalFileSystem):  # without a call per file
                found = ((x.name, x.is_dir()) for x in os.scandir(local))
            else:
                found = ((x.base_name, x.type == pafs.FileType.Directory) for x in files.get_file_info(pafs.FileSelector(local)))
            named = ((f"{folder}/{name}" if name else folder, is_folder) for name, is_folder in found if not (name or "").startswith(("_", ".")))
            while some := list(islice(named, FILES)):
                yield pa.RecordBatch.from_pydict({"path": [p for p, _ in some], "is_folder": pa.array([f for _, f in some], pa.bool_())})


def _texts(batches):
    """Paths -> (path, value), the whole text of each file; empty files have no row."""
    known = {}
    for batch in batches:
        paths, texts, size = [], [], 0
        for path in batch.column(0).to_pylist():
            folder, name = path.rsplit("/", 1)
            if folder not in known:
                known[folder] = opened(folder)
            files, local = known[folder]
            with files.open_input_stream(f"{local}/{name}") as source:
                text = source.read().decode(errors="replace")
            if text:
                paths.append(path)
                texts.append(text)
                size += len(text)
            if size > BYTES:
                yield pa.RecordBatch.from_pydict({"path": paths, "value": texts})
                paths, texts, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "value"])


def log_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files below ``path``. A level of folders is listed by one
    job, a task per folder; only the names of folders reach the driver."""
    folders, out = [path.rstrip("/")], None
    while folders:
        level = spark.createDataFrame([(f,) for f in folders], "path string").repartition(len(folders), "path")
        level = cut_lineage(level.mapInArrow(_listed, "path string, is_folder boolean"))
        folders = [r["path"] for r in level.where("is_folder").select("path").collect()]
        files = level.where("NOT is_folder").select("path")
        out = files if out is None else out.unionByName(files)
    return out


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(folder, run_name, line_no 1-based, line) of the log files below ``path``.

    Their names are dealt out evenly, and each task opens its files by itself:
    nothing is kept per file on the driver, and there is no task per few files.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = log_paths(spark, path).repartition(parts).mapInArrow(_texts, "path string, value string").select(
        F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("folder"), F.substring_index("path", "/", -1).alias("run_name"), "value")
    return whole.select("folder", "run_name", F.posexplode(F.split("value", "\n")).alias("pos", "line")).select(
        "folder", "run_name", (F.col("pos") + 1).cast("int").alias("line_no"), "line")


def parse_run_logs(lines: DataFrame) -> DataFrame:
    """Last best_acc / best_epoch per log, parameters from the name.

    Missing keys give null (never the previous file's values), also values
    that are no number. Logs are kept apart by ``folder`` where there is one.
    """
    acc = F.regexp_extract("line", r"best_acc=(.*)$", 1)
    ep = F.regexp_extract("line", r"best_epoch=(.*)$", 1)
    key = [c for c in ("folder", "run_name") if c in lines.columns]
    per = lines.groupBy(*key).agg(
        F.max_by(F.when(acc != "", F.trim(acc).try_cast("double")), F.when(acc != "", F.col("line_no"))).alias("best_acc"),
        F.max_by(F.when(ep != "", F.trim(ep).try_cast("int")), F.when(ep != "", F.col("line_no"))).alias("best_epoch"),
    )
    name = F.col("run_name")
    fld = lambda key, nxt: F.nullif(F.regexp_extract(name, f"{key}=(.*?)_{nxt}=", 1), F.lit(""))
    return per.select(
        *key,
        fld("alpha", "batch_size").try_cast("double").alias("alpha"),
        fld("batch_size", "max_iter").try_cast("int").alias("batch_size"),
        fld("max_iter", "lambda_para").try_cast("int").alias("max_iter"),
        fld("lambda_para", "C").try_cast("double").alias("lambda_para"),
        fld("C", "sigmoid_func").try_cast("double").alias("c"),
        F.regexp_extract(name, r"sigmoid_func=(.*?)(\.txt)?$", 1).alias("sigmoid_func"),
        "best_acc", "best_epoch",
    )


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_logs(read_log_lines(spark, path))
