"""Additive sharing of numeric table columns.

A value x is encoded in fixed point, X = round(x * 2^16), and split into two
shares modulo 2^63: the kept share r comes from md5 of (seed, key), the other
is (X - r) mod 2^63. Arithmetic runs in DECIMAL(38,0) so nothing overflows
under ANSI mode and reconstruction of X is exact. Each share table is a
projection; reconstruction is one equi-join on the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRAC_BITS = 16
MOD = 2**63

#: a share is below 2^63: 8 bytes
VALUE_BYTES = 8
_DEC = "decimal(38,0)"


def _mod() -> Column:
    return F.lit(str(MOD)).cast(_DEC)


def _h64(*parts) -> Column:
    key = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 16), 16, 10).cast(_DEC)


def encode(x: Column) -> Column:
    return F.round(x * F.lit(float(2**FRAC_BITS))).cast(_DEC)


def split_shares(cells: DataFrame, keys: list[str], value: str = "value", *, seed) -> tuple[DataFrame, DataFrame]:
    """Return (kept, given) share tables with columns keys + share DECIMAL(38,0).

    ``seed`` is the secret of the kept share's holder: who knows it can
    rebuild every value from the other share, so there is no default.
    """
    r = F.pmod(_h64(F.lit(seed), *[F.col(k) for k in keys]), _mod())
    x = F.pmod(encode(F.col(value)), _mod())
    kept = cells.select(*keys, r.cast(_DEC).alias("share"))
    given = cells.select(*keys, F.pmod(x - r, _mod()).cast(_DEC).alias("share"))
    return kept, given


def reconstruct_shares(kept: DataFrame, given: DataFrame, keys: list[str]) -> DataFrame:
    """Join by key, add modulo 2^63, map the upper half to negatives, decode."""
    j = kept.withColumnRenamed("share", "s1").join(given.withColumnRenamed("share", "s2"), keys)
    tot = F.pmod(F.col("s1") + F.col("s2"), _mod())
    signed = F.when(tot >= F.lit(str(MOD // 2)).cast(_DEC), tot - _mod()).otherwise(tot)
    return j.select(*keys, (signed.cast("double") / F.lit(float(2**FRAC_BITS))).alias("value"))


def transfer_size(shares: DataFrame, by: str) -> DataFrame:
    """What handing over share tables moves: per ``by`` the cells, their bytes
    as 8-byte integers and as decimal text."""
    return shares.groupBy(by).agg(
        F.count(F.lit(1)).alias("cells"), (F.lit(VALUE_BYTES) * F.count(F.lit(1))).cast("bigint").alias("bytes"),
        F.sum(F.length(F.col("share").cast("string"))).cast("bigint").alias("text_bytes"))
