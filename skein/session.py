"""Spark session and shared-folder helpers.

Every job here is a DataFrame plan; the session only carries settings.
Lineage is cut with ``checkpoint()`` or with tables written below the shared
folder named by ``spark.checkpoint.dir``; a default folder is set only where
the session has none (tests, local runs).
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def get_session(master: str | None = None, app: str = "skein", shuffle_partitions: int = 8) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "Etc/UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only when unset.

    The folder named by ``spark.checkpoint.dir`` wins. Only a local session
    that names none (tests, local runs) gets a fresh local folder, set through
    ``SparkContext.setCheckpointDir`` (the core config itself cannot be
    changed at run time). On a cluster a folder that all executors share must
    be named: a local one is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get(_CHECKPOINT_KEY, None)
    if not conf:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="skein-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "tables", f"{name}-{uuid.uuid4().hex[:12]}")


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def write_once(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder as a table, for several passes:
    its columns are packed, and each pass reads only those it needs."""
    path = scratch_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin repartition only when the input has fewer partitions than
    the cluster has cores (e.g. one large row group); otherwise unchanged."""
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def ship_package(spark: SparkSession) -> None:
    """Make ``skein`` importable on executors (once per SparkContext).

    Arrow-batched Python steps (``mapInArrow``/``mapInPandas``) refer to
    functions of this package by module, so the package is zipped in memory,
    written into the shared checkpoint folder (through the Hadoop FileSystem
    API, so any cluster file system works) and added with ``addPyFile``.
    """
    import io
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_skein_shipped", False):
        return
    import skein

    pkg_dir = os.path.dirname(os.path.abspath(skein.__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    root = ensure_checkpoint_dir(spark)
    path = root.rstrip("/") + f"/skein-{uuid.uuid4().hex[:8]}.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(hpath, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(path)
    sc._skein_shipped = True
