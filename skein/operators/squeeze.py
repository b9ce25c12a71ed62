"""Sample -> one-hot sketch encoders.

Input ``samples(row_id, party, hash_id, sample)``; output stores only the
ones: ``sketch(row_id, party, col)`` with 0-based ``col``. Each encoder is a
projection over the samples (no shuffle, no dense matrix); the hash
parameters of the count-sketch style squeeze are literal arrays inside the
expression. Empty samples (-1 or 0) emit nothing, so an empty row has no
sketch records and must be kept through the row table.

Column rules (j = hash position inside its block, s = sample):
  one-hot   col = n*j + n - s
  hash      h = (a_j*s + b_j) mod c + 1 ;  col = c*j + c - h
  b-bit     h = s mod 2^b + 1           ;  col = 2^b*j + 2^b - h
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SQUEEZE_METHODS = {"pminhash": "hash", "0bitcws": "bbit"}


def hash_params(c: int, count: int, seed: int = 1) -> tuple[list[int], list[int]]:
    """legacy numpy stream seeded with ``seed``: first ``count`` draws
    of a in [1, c), then ``count`` draws of b in [0, c)."""
    if c < 2:
        raise ValueError("hash squeeze needs c >= 2")
    rs = np.random.RandomState(seed)
    a = rs.randint(low=1, high=c, size=count)
    b = rs.randint(low=0, high=c, size=count)
    return [int(x) for x in a], [int(x) for x in b]


def _lit_array(values: list[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values])


def _nonempty(samples: DataFrame, allow_zero_empty: bool = True) -> DataFrame:
    empty = F.col("sample").isin(-1, 0) if allow_zero_empty else (F.col("sample") == -1)
    bad = ~empty & (F.col("sample") < 1)
    checked = samples.withColumn(
        "sample", F.when(bad, F.raise_error(F.lit("sample must be >= 1, -1 or 0"))).otherwise(F.col("sample"))
    )
    return checked.where(~empty)


def _mode(b: int, c: int) -> str:
    if b == 0 and c == 0:
        return "onehot"
    if b == 0 and c != 0:
        return "hash"
    if b != 0 and c == 0:
        return "bbit"
    raise ValueError("b and c cannot both be non-zero")


def _onehot(n, j, s) -> Column:
    return F.lit(n) * j + F.lit(n) - s


def _hashed(c: int, a_arr: Column, b_arr: Column, g: Column, j: Column, s: Column) -> Column:
    a = F.element_at(a_arr, g + 1)
    b = F.element_at(b_arr, g + 1)
    h = F.pmod(a * s + b, F.lit(c)) + 1
    return F.lit(c) * j + F.lit(c) - h


def _bbit(b: int, j: Column, s: Column) -> Column:
    w = 2**b
    h = F.pmod(s, F.lit(w)) + 1
    return F.lit(w) * j + F.lit(w) - h


_CARRY = ("split",)


def _out(df: DataFrame, col: Column, party: Column | None = None) -> DataFrame:
    party = F.col("party") if party is None else party
    extra = [c for c in _CARRY if c in df.columns]
    return df.select(*extra, "row_id", party.cast("int").alias("party"), col.cast("bigint").alias("col"))


# ----------------------------------------------------------- one table
def sketch_table(samples: DataFrame, n: int, k: int, b: int = 0, c: int = 0, seed: int = 1) -> DataFrame:
    """F1 / F2 / F3 on a one-party samples table (hash_id = j)."""
    mode = _mode(b, c)
    s = _nonempty(samples)
    j, v = F.col("hash_id").cast("bigint"), F.col("sample").cast("bigint")
    if mode == "onehot":
        col = _onehot(n, j, v)
    elif mode == "hash":
        a_l, b_l = hash_params(c, k, seed)
        col = _hashed(c, _lit_array(a_l), _lit_array(b_l), F.col("hash_id"), j, v)
    else:
        col = _bbit(b, j, v)
    return _out(s, col)


# ----------------------------------------------------------- joint space
def sketch_joint(samples: DataFrame, n: int, n1: int, k1: int, k2: int, b: int = 0, c: int = 0,
                 seed: int = 1) -> DataFrame:
    """Both parties in one feature space. Party 2's sample is
    shifted by n1 and its block index is k1 + j."""
    mode = _mode(b, c)
    s = _nonempty(samples)
    p2 = F.col("party") == 2
    v = F.when(p2, F.col("sample") + F.lit(n1)).otherwise(F.col("sample")).cast("bigint")
    t = F.when(p2, F.col("hash_id") + F.lit(k1)).otherwise(F.col("hash_id")).cast("bigint")
    if mode == "onehot":
        col = _onehot(n, t, v)
    elif mode == "hash":
        a_l, b_l = hash_params(c, k1 + k2, seed)
        col = _hashed(c, _lit_array(a_l), _lit_array(b_l), t.cast("int"), t, v)
    else:
        col = _bbit(b, t, v)
    return _out(s, col)


# ----------------------------------------------------------- independent
def party_block_width(n_p: int, b: int, c: int) -> int:
    mode = _mode(b, c)
    if mode == "onehot":
        return n_p
    if mode == "hash":
        return n_p if n_p <= c else c
    return 2**b


def _independent_col(n1: int, n2: int, k1: int, k2: int, b: int, c: int, seed: int) -> Column:
    mode = _mode(b, c)
    j, v = F.col("hash_id").cast("bigint"), F.col("sample").cast("bigint")
    offset = party_block_width(n1, b, c) * k1
    if mode == "onehot":
        c1, c2 = _onehot(n1, j, v), _onehot(n2, j, v)
    elif mode == "hash":
        a_l, b_l = hash_params(c, k1 + k2, seed)
        a_arr, b_arr = _lit_array(a_l), _lit_array(b_l)
        c1 = _onehot(n1, j, v) if n1 <= c else _hashed(c, a_arr, b_arr, F.col("hash_id"), j, v)
        c2 = _onehot(n2, j, v) if n2 <= c else _hashed(c, a_arr, b_arr, F.col("hash_id") + F.lit(k1), j, v)
    else:
        c1, c2 = _bbit(b, j, v), _bbit(b, j, v)
    return F.when(F.col("party") == 1, c1).otherwise(c2 + F.lit(offset))


def sketch_independent(samples: DataFrame, n1: int, n2: int, k1: int, k2: int, b: int = 0, c: int = 0,
                       seed: int = 1) -> DataFrame:
    """Each party encodes in its own space; party 2's columns
    follow party 1's (offset = block width of party 1 times k1).

    Hash mode keeps plain one-hot for a party whose n_p <= c; party 2 uses
    hash parameters a[k1 + j], b[k1 + j].
    """
    return _out(_nonempty(samples), _independent_col(n1, n2, k1, k2, b, c, seed))


def independent_width(n1: int, n2: int, k1: int, k2: int, b: int = 0, c: int = 0) -> tuple[int, int]:
    return party_block_width(n1, b, c) * k1, party_block_width(n2, b, c) * k2


# ----------------------------------------------------------- F11
def encode_two_party(samples: DataFrame, n: int, k1: int, cut: bool = True) -> DataFrame:
    """Glue both parties' samples (party 2 hash ids follow k1, samples NOT
    shifted), one-hot with width n, then cut at n*k1 (train form) or keep the
    whole row (``cut=False``, test form). Only -1 counts as empty."""
    s = _nonempty(samples, allow_zero_empty=False)
    t = F.when(F.col("party") == 2, F.col("hash_id") + F.lit(k1)).otherwise(F.col("hash_id")).cast("bigint")
    col = _onehot(n, t, F.col("sample").cast("bigint"))
    border = n * k1
    if not cut:
        return _out(s, col, F.lit(0))
    party = F.when(col < F.lit(border), F.lit(1)).otherwise(F.lit(2))
    local = F.when(col < F.lit(border), col).otherwise(col - F.lit(border))
    return _out(s, local, party)


# ----------------------------------------------------------- F12, F13
def recut(sketch: DataFrame, border: int) -> DataFrame:
    """Re-assign parties by a column border (global col -> party-local col)."""
    party = F.when(F.col("col") < F.lit(border), F.lit(1)).otherwise(F.lit(2))
    local = F.when(F.col("col") < F.lit(border), F.col("col")).otherwise(F.col("col") - F.lit(border))
    extra = [c for c in _CARRY if c in sketch.columns]
    return sketch.select(*extra, "row_id", party.cast("int").alias("party"), local.cast("bigint").alias("col"))


def squeeze(samples: DataFrame, method: str, size: int, n: int, p: float, k: int, cut: str = "border",
            width_from: str = "features", seed: int = 1) -> DataFrame:
    """One squeeze combination (F12): pminhash -> hash squeeze to c = size,
    0bitcws -> b-bit squeeze with b = size; then re-cut into two parties.

    cut='border' cuts at the true party border (w1 * k1); cut='ratio'
    reproduces floor(total_width * p). ``width_from='hashes'`` is the legacy
    job (F13): joint hash encoding with n := k and n1 := k1, c only.
    """
    if method not in SQUEEZE_METHODS:
        raise ValueError(f"method must be one of {sorted(SQUEEZE_METHODS)}")
    k1 = int(math.floor(k * p))
    k2 = k - k1
    if width_from == "hashes":
        if method != "pminhash":
            raise ValueError("legacy squeeze supports the hash mode only")
        enc = sketch_joint(samples, n=k, n1=k1, k1=k1, k2=k2, c=size, seed=seed)
        total = size * k
        border = int(math.floor(total * p))
        return recut(enc, border)
    n1 = int(math.floor(n * p))
    n2 = n - n1
    b, c = (0, size) if method == "pminhash" else (size, 0)
    enc = sketch_independent(samples, n1, n2, k1, k2, b=b, c=c, seed=seed)
    w1, w2 = independent_width(n1, n2, k1, k2, b=b, c=c)
    border = w1 if cut == "border" else int(math.floor((w1 + w2) * p))
    return recut(enc.drop("party"), border)


def squeeze_job(samples_by_method: dict[str, DataFrame], combos: list[tuple[str, int]], n: int, p: float,
                k: int, cut: str = "border", width_from: str = "features", seed: int = 1) -> DataFrame:
    """All combinations in one plan, tagged with the catalog partition
    columns (method, k, squeeze, size, split); one projection per combination
    over samples that carry a ``split`` column."""
    out = None
    for method, size in combos:
        enc = squeeze(samples_by_method[method], method, size, n, p, k, cut, width_from, seed)
        tagged = enc.select(
            F.lit(method).alias("method"), F.lit(k).alias("k"),
            F.lit("countsketch" if method == "pminhash" else "bbitmwhash").alias("squeeze"),
            F.lit(size).alias("size"), "split", "party", "row_id", "col")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def squeeze_lists(samples: dict[tuple[str, int], DataFrame], sizes: dict[str, list[int]], n: int, p: float,
                  cut: str = "border", seed: int = 1) -> DataFrame:
    """The job over lists: every method's samples at every k, squeezed to every
    size of the method. ``samples`` maps (method, k) to a table with ``split``;
    each is read once, and a sample gives all its columns in one projection.
    Same columns as ``squeeze_job``; write them with ``matrixio.write_sketch``.
    """
    n1 = int(math.floor(n * p))
    n2 = n - n1
    out = None
    for (method, k), table in samples.items():
        if method not in SQUEEZE_METHODS:
            raise ValueError(f"method must be one of {sorted(SQUEEZE_METHODS)}")
        k1 = int(math.floor(k * p))
        cols, entries = [], []
        for i, size in enumerate(sizes[method]):
            b, c = (0, size) if method == "pminhash" else (size, 0)
            w1, w2 = independent_width(n1, n2, k1, k - k1, b=b, c=c)
            border = F.lit(w1 if cut == "border" else int(math.floor((w1 + w2) * p)))
            cols.append(_independent_col(n1, n2, k1, k - k1, b, c, seed).cast("bigint").alias(f"c{i}"))
            col = F.col(f"c{i}")
            entries.append(F.struct(F.lit(size).alias("size"), F.when(col < border, 1).otherwise(2).alias("party"), F.when(col < border, col).otherwise(col - border).alias("col")))
        # columns are worked out before the explode, once each and in a method that the JVM compiles
        made = _nonempty(table).select("split", "row_id", *cols).select("split", "row_id", F.explode(F.array(*entries)).alias("e")).select(
            F.lit(method).alias("method"), F.lit(k).alias("k"), F.lit("countsketch" if method == "pminhash" else "bbitmwhash").alias("squeeze"),
            "e.size", "split", "e.party", "row_id", "e.col")
        out = made if out is None else out.unionByName(made)
    return out
