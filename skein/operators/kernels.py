"""Kernel feature maps per party (F14 random Fourier, F15 tensor sketch).

Components per party: k1 = floor(k * p), k2 = k - k1 (one table: k1 = k).
Random numbers come from hashes of (seed, party, component, feature), so every executor derives the same numbers without shipping a
matrix.

F14 groups a row's cells by one shuffle and projects them on tiles of
components as flat arrays (segmented sums), one plan for every size. F15
builds two signed count sketches with one grouped sum, gathers each row's two
sketches as arrays of length k_p (bounded by k), and convolves them with an
FFT inside ``mapInArrow``; pairs of buckets are never emitted as rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.hashing import draws, h32, stream
from skein.operators.rowtiles import per_row_tiles
from skein.operators.rowtiles import split_positions as split_components


def _party_cells(cells: DataFrame, n1: int | None) -> DataFrame:
    if n1 is None:
        return cells.select("row_id", F.lit(1).alias("party"), F.col("feature_id").alias("fid"), "value")
    party = F.when(F.col("feature_id") <= n1, F.lit(1)).otherwise(F.lit(2))
    local = F.when(F.col("feature_id") <= n1, F.col("feature_id")).otherwise(F.col("feature_id") - n1)
    return cells.select("row_id", party.alias("party"), local.alias("fid"), "value")


def _row_party_markers(rows: DataFrame, two_party: bool) -> DataFrame:
    parties = [1, 2] if two_party else [1]
    return rows.select("row_id", F.explode(F.array(*[F.lit(p) for p in parties])).alias("party"))


def rff_features(cells: DataFrame, rows: DataFrame, width: int, k: int, gamma: float, p: float | None = None,
                 seed: int = 1) -> DataFrame:
    """sqrt(2/k_p) * cos(x.W + o), W ~ N(0, 2*gamma), o ~ U[0, 2*pi).

    Output (row_id, party, comp, value); every row gets every component. A
    cell beyond the width is an error.
    """
    n1 = width if p is None else int(math.floor(width * p))
    k1, k2 = split_components(k, p)
    named = {(party, t): stream(seed, party, t) for party in (1, 2) for t in ("n1", "n2", "o")}

    def tile(party, features, values, starts, g0, lo, hi):
        xw = np.zeros((len(starts) - 1, hi - lo))
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            distinct, at = np.unique(features, return_inverse=True)
            own = distinct - (n1 if party == 2 else 0)  # party-local ids
            normal = np.sqrt(-2.0 * np.log(draws(named[party, "n1"], own, lo, hi))) * np.cos(2.0 * math.pi * draws(named[party, "n2"], own, lo, hi))
            xw[full] = np.add.reduceat(values[:, None] * (math.sqrt(2.0 * gamma) * normal)[at], starts[full], axis=0)
        offset = 2.0 * math.pi * draws(named[party, "o"], np.zeros(1, np.int64), lo, hi)
        return math.sqrt(2.0 / (k1 if party == 1 else k2)) * np.cos(xw + offset)

    return per_row_tiles(cells, rows, width, k, p, tile, "row_id long, party int, comp int, value double", "comp")


def _ts_bucket(seed: int, k1: int, k2: int) -> tuple[Column, Column]:
    kp = F.when(F.col("party") == 1, F.lit(k1)).otherwise(F.lit(k2))
    key = (F.lit(seed), F.col("party"), F.col("copy"), F.col("fid"))
    bucket = F.pmod(h32(*key, "b"), kp.cast("bigint")).cast("int")
    sign = F.when(F.pmod(h32(*key, "s"), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return bucket, sign


def tensor_sketch_features(cells: DataFrame, rows: DataFrame, width: int, k: int, gamma: float,
                           p: float | None = None, coef0: float = 1.0, seed: int = 1) -> DataFrame:
    """Degree-2 tensor sketch of (sqrt(gamma) * x, sqrt(coef0)).

    Two signed count sketches of size k_p, circular convolution of the two.
    The appended constant is feature n_p + 1 of its party.
    Output (row_id, party, comp, value).
    """
    n1 = None if p is None else int(math.floor(width * p))
    n2 = width - (n1 or 0)
    k1, k2 = split_components(k, p)
    pc = _party_cells(cells, n1).select("row_id", "party", "fid", (F.col("value") * F.lit(math.sqrt(gamma))).alias("value"))
    const = _row_party_markers(rows, p is not None).select(
        "row_id", "party",
        F.when(F.col("party") == 1, F.lit((n1 if n1 is not None else width) + 1)).otherwise(F.lit(n2 + 1)).alias("fid"),
        F.lit(math.sqrt(coef0)).alias("value"))
    allc = pc.unionByName(const)
    # both copies of a cell come from one scan of it
    bucket, sign = _ts_bucket(seed, k1, k2)
    sk = (allc.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
          .select("row_id", "party", "copy", bucket.alias("bucket"), (sign * F.col("value")).alias("v"))
          .groupBy("row_id", "party", "copy", "bucket").agg(F.sum("v").alias("v")))
    per_row = sk.groupBy("row_id", "party").agg(
        F.collect_list(F.struct("copy", "bucket", "v")).alias("cells"))  # <= 2 * k_p entries per row

    def convolve(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows == 0:
                continue
            cl = batch.column(batch.schema.get_field_index("cells"))
            offsets = cl.offsets.to_numpy()
            row_of = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            flat = cl.flatten()
            cp = flat.field("copy").to_numpy(zero_copy_only=False).astype(np.int64)
            bk = flat.field("bucket").to_numpy(zero_copy_only=False).astype(np.int64)
            vv = flat.field("v").to_numpy(zero_copy_only=False).astype(np.float64)
            rid = batch.column(batch.schema.get_field_index("row_id")).to_numpy(zero_copy_only=False)
            par = batch.column(batch.schema.get_field_index("party")).to_numpy(zero_copy_only=False)
            for party, kp in ((1, k1), (2, k2)):
                rows_p = np.nonzero(par == party)[0]
                if kp == 0 or not len(rows_p):
                    continue
                local = np.full(batch.num_rows, -1)
                local[rows_p] = np.arange(len(rows_p))
                sel = local[row_of] >= 0
                c = np.zeros((len(rows_p), 2, kp))
                np.add.at(c, (local[row_of][sel], cp[sel], bk[sel]), vv[sel])
                conv = np.real(np.fft.ifft(np.fft.fft(c[:, 0, :], axis=1) * np.fft.fft(c[:, 1, :], axis=1), axis=1))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(rid[rows_p].astype(np.int64), kp)),
                    pa.array(np.full(len(rows_p) * kp, party, dtype=np.int32)),
                    pa.array(np.tile(np.arange(kp, dtype=np.int32), len(rows_p))),
                    pa.array(conv.reshape(-1)),
                ], names=["row_id", "party", "comp", "value"])

    return per_row.mapInArrow(convolve, "row_id long, party int, comp int, value double")
