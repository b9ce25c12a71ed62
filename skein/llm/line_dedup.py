"""Line dedup: explode normalised lines, hash, count documents per hash, drop,
reassemble by position.

Lines travel as 128-bit hashes, once per document and key. The count is a
min / max of document ids per hash, aggregated before its shuffle, so a line
that a third of all documents share costs one row per task. Keys that own more
than ``1 / HOT`` of the repeated lines (fewer than ``HOT`` of them) go to the
reassembling tasks as a small table; all others are joined by hash. Rows are
numbered and written once, and dropped keys find their row by its number, so
rows that share an id, or have none, are as light as others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import pieces
from skein.session import cut_lineage, scratch_path

#: shortest key that is judged, in code points
MIN_CHARS = 10
#: a key with more than 1/HOT of the repeated lines is not shuffled
HOT = 1000

_digest = xxhash.xxh3_128_digest


def keys_of(text: bytes) -> list[bytes]:
    """The key of every line: white space stripped, A-Z lower-cased (methods
    of bytes treat exactly the ASCII characters so)."""
    return [x.strip() for x in text.lower().split(b"\n")]


def judged(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def document_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(row, doc, h1, h2): one row per document row and distinct key."""
    out = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc", docs.schema[id_col].dataType), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 2):
                rows, hashes = [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    if text:
                        keys = {k for k in keys_of(text) if judged(k, min_chars)}
                        rows += [i] * len(keys)
                        hashes += map(_digest, keys)
                h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
                row, doc = (part.column(i).take(pa.array(rows, pa.int64())) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([row, doc, pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=out.fieldNames())

    return docs.select("__row", docs[id_col].alias("doc"), docs[text_col].alias("text")).mapInArrow(run, out)


def dropped_keys(keys: DataFrame, busy: DataFrame, repeated: DataFrame) -> DataFrame:
    """(row, __gone): the keys of ``repeated`` (h1, h2, first), without the busy
    ones, that a row loses; at most as many as it has lines."""
    return (
        keys.join(F.broadcast(busy.select("h1", "h2")), ["h1", "h2"], "left_anti")
        .join(repeated.hint("shuffle_hash"), ["h1", "h2"])
        .where(F.col("doc").isNull() | (F.col("doc") != F.col("first")))
        .groupBy("row").agg(F.collect_list(F.struct("h1", "h2")).alias("__gone"))
    )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs``, the text without dropped lines, and
    n_lines (before) and n_dropped.

    A key of at least ``min_chars`` code points that is in two or more
    documents loses its lines everywhere but in the smallest id that holds it.
    A null or empty text is one empty line and comes back empty. Rows that
    share an id are one document, so none of its own lines is dropped for the
    other; rows with a null id are one document that comes after all others.
    Other white space and shorter lines stay as they are. Input columns named
    n_lines or n_dropped give way.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("n_lines", "n_dropped")]
    # row numbers hold only for rows that are written down
    path = scratch_path(docs.sparkSession, "line-dedup")
    columns = [docs[f"`{f.name}`"].cast("string").cast("binary").alias(f.name) if f.name == text_col else docs[f"`{f.name}`"] for f in kept]
    docs.select(*columns, F.monotonically_increasing_id().alias("__row")).write.parquet(path)
    src = docs.sparkSession.read.parquet(path)
    keys = document_keys(src, id_col, text_col, min_chars)
    repeated = cut_lineage(
        keys.groupBy("h1", "h2")
        .agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.max(F.col("doc").isNull()).alias("null_too"), F.count("*").alias("n"))
        .where((F.col("first") != F.col("last")) | (F.col("null_too") & F.col("first").isNotNull()))
        .select("h1", "h2", "first", "n")
    )
    total = repeated.agg(F.sum("n")).first()[0] or 0
    is_hot = F.col("n") * HOT > F.lit(total)
    busy = repeated.where(is_hot)  # fewer than HOT rows
    hot = {np.array([r.h1, r.h2], "<i8").tobytes(): r.first for r in busy.collect()}
    drops = dropped_keys(keys, busy, repeated.where(~is_hot).drop("n"))

    out = T.StructType([T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in kept]
                       + [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    at_text, at_id = [f.name for f in kept].index(text_col), [f.name for f in kept].index(id_col)

    def run(batches):
        for batch in batches:
            for part in pieces(batch, at_text):
                gone = part.column(len(kept))
                lists = gone.flatten()
                h = np.stack([np.asarray(pc.fill_null(lists.field(i), 0)) for i in (0, 1)], 1).astype("<i8").tobytes() if len(lists) else b""
                ends = np.cumsum(pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False))
                texts, n_lines, n_dropped, start = [], [], [], 0
                for doc, text, end in zip(part.column(at_id).to_pylist(), part.column(at_text).to_pylist(), ends):
                    own = {h[16 * i: 16 * i + 16] for i in range(start, end)}
                    start = end
                    if not text:
                        texts.append(b"")
                        n_lines.append(1)
                        n_dropped.append(0)
                        continue
                    lines = text.split(b"\n")
                    if own or hot:
                        stay = [x for x, k in zip(lines, keys_of(text)) if not (judged(k, min_chars) and dropped(_digest(k), doc, own))]
                    else:
                        stay = lines
                    texts.append(text if len(stay) == len(lines) else b"\n".join(stay))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                cols = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at_text else part.column(i)
                        for i in range(len(kept))] + [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=out.fieldNames())

    def dropped(key, doc, own):
        return key in own or key in hot and (doc is None or doc != hot[key])

    joined = src.join(drops.hint("shuffle_hash"), src["__row"] == drops["row"], "left").drop("__row", "row")
    return joined.mapInArrow(run, out)
