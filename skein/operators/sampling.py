"""Weighted min-hash samples (F16 P-MinHash, F17 0-bit CWS).

For every row, party and hash position the chosen (party-local, 1-based)
feature is kept; a row without cells in a party gets -1 at every position.
One plan for every size: a row's cells (at most the width) are grouped by one
shuffle and scored against tiles of hash positions as flat arrays, with a
minimum per row; nothing is emitted per (cell, position). Ties go to the
smallest feature. Cells come as (row_id, feature_id, value), as counts packed
by row, or with their rows as ``rowtiles.row_vectors`` made them.

Hash randomness: one stream of numbers per seed and use, by feature and global
hash position (party 2 positions follow party 1).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.hashing import draws, stream
from skein.operators.rowtiles import Numbers, parties, per_row_tiles, split_positions

SCHEMA = "row_id long, party int, hash_id int, sample int"


#: cells of a row, on average, from where rows are searched one by one
LONG_ROWS = 32


def _argmin(score, numbers, before_of):
    """Tile function: local feature of the smallest score per row and position."""

    def tile(party, features, values, starts, g0, lo, hi):
        out = np.full((len(starts) - 1, hi - lo), -1, np.int32)
        full = np.flatnonzero(np.diff(starts))
        if not len(full):
            return out
        keys = score(*numbers.of(party, features, lo, hi), values[:, None])
        first = starts[full]
        if len(features) >= LONG_ROWS * len(full):
            local = features - before_of[party]
            for row in full:
                a, b = starts[row], starts[row + 1]
                out[row] = local[a:b].take(keys[a:b].argmin(axis=0))
            return out
        least = np.minimum.reduceat(keys, first, axis=0)
        sizes = np.diff(np.append(first, len(features)))
        place = np.where(keys == np.repeat(least, sizes, axis=0), np.arange(len(features))[:, None], len(features))
        out[full] = features[np.minimum.reduceat(place, first, axis=0)] - before_of[party]
        return out

    return tile


def _before(width: int, p: float | None) -> dict[int, int]:
    return {1: 0, 2: 0 if p is None else int(np.floor(width * p))}


def _positive(cells: DataFrame) -> DataFrame:
    """Cells above 0; those that come packed are counts, at least 1."""
    return cells if "features" in cells.columns else cells.where(F.col("value") > 0)


def pminhash_samples(cells: DataFrame, rows: DataFrame | None, width: int, k: int, p: float | None = None, seed: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """P-MinHash: argmin over x_f > 0 of -ln(u(g, f)) / x_f (F16).

    ``p`` None: one table, k hashes over all features. Otherwise party 1 owns
    features 1..floor(width*p) with floor(k*p) hashes, party 2 the rest.
    Output: samples(row_id, party, hash_id, sample) and the columns ``carry``
    of the rows. A cell beyond the width is an error.
    """
    start = stream(seed, "u")

    def make(features, lo, hi):
        return (-np.log(draws(start, features, lo, hi)),)

    def score(e, values):
        e /= values
        return e

    numbers = Numbers(make, 1, parties(width, k, p))
    return per_row_tiles(_positive(cells), rows, width, k, p, _argmin(score, numbers, _before(width, p)), SCHEMA, "hash_id", carry)


def cws_samples(cells: DataFrame, rows: DataFrame | None, width: int, k: int, p: float | None = None, seed: int = 1, carry: tuple[str, ...] = ()) -> DataFrame:
    """0-bit consistent weighted sampling (Ioffe 2010; Li 2015).

    r, c ~ Gamma(2, 1) and beta ~ U(0, 1) per (feature, hash);
    t = floor(ln x / r + beta); ln a = ln c - r * (t - beta) - r;
    the sample is the feature with the smallest ln a (only the index is kept).
    """
    starts = {t: stream(seed, t) for t in ("r1", "r2", "c1", "c2", "b")}

    def make(features, lo, hi):
        u = {t: draws(x, features, lo, hi) for t, x in starts.items()}
        return -np.log(u["r1"]) - np.log(u["r2"]), np.log(-np.log(u["c1"]) - np.log(u["c2"])), u["b"]

    def score(r, ln_c, beta, values):
        t = np.log(values) / r
        t += beta
        np.floor(t, out=t)
        t -= beta
        t *= r
        ln_c -= t
        ln_c -= r
        return ln_c

    numbers = Numbers(make, 3, parties(width, k, p))
    return per_row_tiles(_positive(cells), rows, width, k, p, _argmin(score, numbers, _before(width, p)), SCHEMA, "hash_id", carry)


__all__ = ["cws_samples", "pminhash_samples", "split_positions"]
