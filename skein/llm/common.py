"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: white space of the word and line rules: [\x20\x09-\x0D]
SPACE = " \t\n\x0b\x0c\r"
SPACE_BYTES = SPACE.encode()
SPACE_CLASS = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: text handled at once by a Python kernel; a longer text is a piece of its own
CHUNK_BYTES = 2 << 20


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    ascii_only = F.octet_length(c) == F.length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def n_words(c: Column) -> Column:
    """Number of maximal runs of non-white-space characters; 0 for null."""
    t = F.btrim(F.coalesce(c, F.lit("")), F.lit(SPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"[{SPACE_CLASS}]+"))).cast("long")


def pieces(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in ``column``, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def map_texts(df: DataFrame, text: str, kernel: Callable[[list], list], added: list[tuple[str, T.DataType]],
              keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` (default: all) and the kernel's columns.

    ``kernel`` gets the texts of a slice of a partition as Python strings (null
    as None) and returns one Arrow array or list per added column. An input
    column with the name of an added one (in any case) gives way to it.
    """
    clash = {n.lower() for n, _ in added}
    kept = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in clash]
    fields = [T.StructField(f.name, f.dataType, True) for f in kept] + [T.StructField(n, t, True) for n, t in added]
    out = T.StructType(fields)
    types = [to_arrow_type(t) for _, t in added]
    names = [f.name for f in fields]
    n_kept = len(kept)
    # the text travels once, as the last column
    src = df.select(*[df[_quoted(f.name)] for f in kept], df[_quoted(text)].cast("string").alias("__llm_text"))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, n_kept):
                made = kernel(part.column(n_kept).to_pylist())
                cols = [part.column(i) for i in range(n_kept)]
                cols += [a if isinstance(a, pa.Array) else pa.array(a, t) for a, t in zip(made, types)]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return src.mapInArrow(run, out)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


#: a key with more than 1/HOT_KEYS of the counted rows is settled by broadcast
HOT_KEYS = 1000


def lookup(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with a table of one row per ``key``, without hot tasks.

    Column ``n`` of the table counts the rows of a key, ``total`` all of them:
    fewer than ``HOT_KEYS`` keys can have more than ``total / HOT_KEYS`` rows.
    Those are broadcast; the others take a shuffle in which no key is large.
    """
    hot = F.col(n) * HOT_KEYS > F.lit(total)
    busy = table.where(hot)
    settled = rows.join(F.broadcast(busy), key)
    rest = rows.join(F.broadcast(busy.select(key)), key, "left_anti").join(table.where(~hot), key)
    return settled.unionByName(rest)
