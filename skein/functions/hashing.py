"""Deterministic hashed randomness.

Randomness must be identical across executors, retries and engines, so it is
derived from keys instead of ``rand()``:

* ``h32(key)``   first 8 hex digits of the md5 of a ``:``-joined key as a
  BIGINT in [0, 2^32), a column expression (orders, buckets, signs)
* ``draws(stream, features, lo, hi)``   a uniform number inside (0, 1) for
  every (feature, position): two rounds of 32-bit multiply and xor-shift of a
  counter, so whole tiles are made by numpy; the multipliers are under 2^31,
  so the same numbers come from BIGINT arithmetic in SQL (``sql_draw``)
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = float(2**32)


def _key(*parts) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    if len(cols) == 1:  # concat_ws of one part is the part itself
        return cols[0].cast("string")
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def h32(*parts) -> Column:
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 8), 16, 10).cast("bigint")


#: multipliers of the two rounds, and the step from one position to the next
MULTIPLIERS = (0x7FEB352D, 0x5BD1E995)
STEP = 0x3C6EF363
MASK = (1 << 32) - 1


def stream(*parts) -> int:
    """The start of a stream of numbers, named by its parts."""
    return int.from_bytes(md5(":".join(map(str, parts)).encode()).digest()[:4], "big")


def _mixed(x: np.ndarray) -> np.ndarray:
    """In place; products of uint32 are taken modulo 2^32."""
    for c in MULTIPLIERS:
        x ^= x >> np.uint32(16)
        x *= np.uint32(c)
    x ^= x >> np.uint32(16)
    return x


def draws(start: int, features: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """features x positions matrix of uniform numbers."""
    own = _mixed(features.astype(np.uint32) + np.uint32(start))
    place = np.arange(lo, hi, dtype=np.uint64) * np.uint64(STEP)
    x = _mixed(own[:, None] + place.astype(np.uint32))
    return (x + 0.5) / TWO_32


def r6(c: Column) -> Column:
    """Round to 6 decimals and fold -0.0 into 0.0 (engine-neutral output)."""
    return F.round(c, 6) + F.lit(0.0)


# SQL (DuckDB) spellings of the same expressions, for oracle text.
def sql_h32(key_sql: str) -> str:
    return f"CAST('0x' || substr(md5({key_sql}), 1, 8) AS BIGINT)"


def _sql_mixed(x: str) -> str:
    steps = ", ".join(map(str, (*MULTIPLIERS, 1)))
    return f"list_reduce([{x}, {steps}]::BIGINT[], lambda a, c: (xor(a, a >> 16) * c) & {MASK})"


def sql_draw(start: int, feature: str, position: str) -> str:
    """``draws`` of one feature and position."""
    x = _sql_mixed(f"(({feature})::BIGINT + {start}) & {MASK}")
    return f"((CAST({_sql_mixed(f'({x} + ({position})::BIGINT * {STEP}) & {MASK}')} AS DOUBLE) + 0.5) / 4294967296.0)"


def sql_r6(expr: str) -> str:
    return f"(round(CAST({expr} AS DOUBLE), 6) + 0.0)"
