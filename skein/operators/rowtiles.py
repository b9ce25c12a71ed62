"""Rows x hash positions, a tile at a time.

Samplers and projections need one random number per (feature, position). A
task holds some rows' cells as flat arrays and walks the positions in tiles,
so its memory depends neither on the number of positions nor on the width.
Numbers are made when they are first needed (``functions.hashing.draws``), and
kept for the task where all of them fit a table of bounded size (``Numbers``).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: values of one tile: cells of a slice of rows x positions
TILE_VALUES = 1 << 20
#: positions of a tile at most
TILE_POSITIONS = 64

#: numbers that a task may keep (64 MB)
TABLE_VALUES = 1 << 23


def split_positions(k: int, p: float | None) -> tuple[int, int]:
    """Positions of party 1 and party 2."""
    if p is None:
        return k, 0
    k1 = int(math.floor(k * p))
    return k1, k - k1


def parties(width: int, k: int, p: float | None) -> list[tuple[int, int, int, int, int]]:
    """(party, features before it, its last feature, positions before it, positions)."""
    n1 = width if p is None else int(math.floor(width * p))
    k1, k2 = split_positions(k, p)
    return [x for x in ((1, 0, n1, 0, k1), (2, n1, width, k1, k2)) if x[4] > 0]


class Numbers:
    """Arrays of numbers by (feature, position) for the cells of a tile.

    ``make(features, lo, hi)`` returns a tuple of ``uses`` features x positions
    arrays. Where those of all features and positions are at most
    ``TABLE_VALUES``, a feature's numbers are made when its first cell comes
    and kept (the driver's object is empty, so each task has its own); else
    those of a tile's distinct features are made tile by tile.
    """

    def __init__(self, make: Callable, uses: int, layout: list[tuple[int, int, int, int, int]]):
        self.make, self.uses = make, uses
        self.layout = {party: (before, last, g0, kp) for party, before, last, g0, kp in layout}
        self.kept = uses * sum((last - before) * kp for before, last, _, kp in self.layout.values()) <= TABLE_VALUES
        self.tables: dict[int, tuple] = {}

    def of(self, party: int, features: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
        """The numbers of the cells' features at the party's positions lo to hi."""
        before, last, g0, kp = self.layout[party]
        if not self.kept:
            distinct, at = np.unique(features, return_inverse=True)
            return [x.take(at, axis=0) for x in self.make(distinct, g0 + lo, g0 + hi)]
        if party not in self.tables:
            self.tables[party] = (np.zeros(last - before, bool), [np.empty((last - before, kp)) for _ in range(self.uses)])
        known, tables = self.tables[party]
        local = features - before - 1
        new = np.unique(local[~known[local]])
        per = max(1, TILE_VALUES // kp)
        for i in range(0, len(new), per):
            for x, made in zip(tables, self.make(new[i:i + per] + before + 1, g0, g0 + kp)):
                x[new[i:i + per]] = made
        known[new] = True
        return [x.take(local, axis=0) if hi - lo == kp else x[local, lo:hi] for x in tables]


def row_vectors(cells: DataFrame, rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row_id, ``carry``, features, values): a row's cells as two arrays, for
    every row of ``rows``. ``cells`` has (row_id, feature_id, value), or
    (row_id, features, counts) with one row per row_id, whose equal features
    add up when they are read."""
    if "features" in cells.columns:
        per_row = cells.select("row_id", "features", F.col("counts").alias("values"))
    else:
        entries = F.sort_array(F.collect_list(F.struct(F.col("feature_id").cast("int").alias("feature_id"), F.col("value").cast("double").alias("value"))))
        per_row = cells.groupBy("row_id").agg(entries.alias("e")).select("row_id", F.col("e.feature_id").alias("features"), F.col("e.value").alias("values"))
    return rows.select("row_id", *carry).join(per_row, "row_id", "left").select("row_id", *carry, "features", "values")


def _summed(row_of: np.ndarray, features: np.ndarray, counts: np.ndarray, width: int):
    """The cells by row and feature, equal ones added up."""
    key = row_of * (width + 1) + features
    if not len(key) or (key[1:] > key[:-1]).all():
        return row_of, features, counts
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first] // (width + 1), key[first] % (width + 1), np.add.reduceat(counts[order], first)


def per_row_tiles(cells: DataFrame, rows: DataFrame | None, width: int, k: int, p: float | None, tile: Callable, schema: str, name: str,
                  carry: tuple[str, ...] = ()) -> DataFrame:
    """One output row per (row, party, position) of ``rows``, with the columns
    ``carry`` of ``rows`` behind the others. Without ``rows``, ``cells`` is what
    ``row_vectors`` made of them.

    ``tile(party, features, values, starts, g0, lo, hi)`` gets the cells of
    consecutive rows of one party, sorted by row and feature (``features`` are
    global ids, row i's cells begin at ``starts[i]`` and end at the next) and
    the party's positions lo to hi (global: g0 + lo to g0 + hi); it returns a
    rows x (hi - lo) array. A cell beyond the width is an error at any size.
    """
    layout = parties(width, k, p)
    vec = cells if rows is None else row_vectors(cells, rows, carry)
    vec = vec.select("row_id", "features", "values", *carry)
    added = vec.schema["values"].dataType.elementType.typeName() == "long"  # counts, whose equal features add up
    schema = ", ".join([schema, *(f"{c} {vec.schema[c].dataType.simpleString()}" for c in carry)])

    def run(batches):
        for batch in batches:
            ids, features, values = batch.column(0), batch.column(1), batch.column(2)
            sizes = pc.fill_null(pc.list_value_length(features), 0).to_numpy().astype(np.int64)
            rows_of = np.repeat(np.arange(len(ids)), sizes)
            fid = features.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            val = values.flatten().to_numpy(zero_copy_only=False)
            if added:
                rows_of, fid, val = _summed(rows_of, fid, val, width)
            val = val.astype(np.float64)
            ends = np.searchsorted(rows_of, np.arange(len(ids) + 1))
            if len(fid) and (fid.min() < 1 or fid.max() > width):
                raise ValueError(f"a cell has feature {fid.min() if fid.min() < 1 else fid.max()}, beyond the width {width}")
            per_slice = max(1, TILE_VALUES // TILE_POSITIONS)
            a = 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(ends, ends[a] + per_slice, "right")) - 1)
                b = min(b, a + per_slice, len(ids))
                row_of = rows_of[ends[a]:ends[b]] - a
                f, v = fid[ends[a]:ends[b]], val[ends[a]:ends[b]]
                for party, before, last, g0, kp in layout:
                    own = (f > before) & (f <= last)
                    starts = np.searchsorted(row_of[own], np.arange(b - a + 1))
                    step = max(1, min(TILE_POSITIONS, TILE_VALUES // max(1, int(own.sum()))))
                    for lo in range(0, kp, step):
                        hi = min(kp, lo + step)
                        made = tile(party, f[own], v[own], starts, g0, lo, hi)
                        each = pa.array(np.repeat(np.arange(a, b), hi - lo))
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(each), pa.array(np.full((b - a) * (hi - lo), party, np.int32)),
                             pa.array(np.tile(np.arange(lo, hi, dtype=np.int32), b - a)), pa.array(made.ravel()),
                             *(batch.column(3 + i).take(each) for i in range(len(carry)))],
                            names=["row_id", "party", name, "sample" if name == "hash_id" else "value", *carry])
                a = b

    return vec.mapInArrow(run, schema)
