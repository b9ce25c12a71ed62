"""Matrix statistics (E1-E4); each is one partially-aggregated pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def matrix_variance(cells: DataFrame, n_rows: int, width: int) -> DataFrame:
    """Variance over all rows x width cells, implicit zeros included (E1):
    mean(x^2) - mean(x)^2 with the mean over n_rows * width, from the centred
    moments of the stored cells merged with the zeros as one block."""
    share = F.col("n") / F.lit(float(n_rows) * float(width))
    return cells.agg(F.count("value").alias("n"), F.coalesce(F.avg("value"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("value"), F.lit(0.0)).alias("var")).select(
        (F.col("var") * share + F.col("mean") * F.col("mean") * share * (F.lit(1.0) - share)).alias("variance"))


def gamma_scale(cells: DataFrame, n_rows: int, width: int) -> DataFrame:
    """1 / (width * variance) over train cells of both parties."""
    v = matrix_variance(cells, n_rows, width)
    return v.select("variance", (F.lit(1.0) / (F.lit(float(width)) * F.col("variance"))).alias("gamma"))


def gamma_value(cells: DataFrame, n_rows: int, width: int) -> float:
    return float(gamma_scale(cells, n_rows, width).collect()[0]["gamma"])


def zero_sample_report(samples: DataFrame) -> DataFrame:
    """Per party: empty samples (-1 or 0) and rows whose first sample is empty."""
    empty = F.col("sample").isin(-1, 0)
    return samples.groupBy("party").agg(
        F.count_if(empty).cast("bigint").alias("empty_samples"),
        F.count_if(empty & (F.col("hash_id") == 0)).cast("bigint").alias("empty_rows"),
    )


def matrix_shape(cells: DataFrame, rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, width (max feature_id) and nnz, optionally per split/party.

    ``rows`` supplies the row count (rows without cells still count).
    """
    by = by or []
    cell_part = cells.groupBy(*by).agg(
        F.max("feature_id").cast("int").alias("width"), F.count(F.lit(1)).cast("bigint").alias("nnz")
    )
    row_keys = [b for b in by if b in rows.columns]
    if row_keys:
        row_part = rows.groupBy(*row_keys).agg(F.count(F.lit(1)).cast("bigint").alias("n_rows"))
        return cell_part.join(row_part, row_keys, "left")
    return cell_part.withColumn("n_rows", F.lit(rows.count()).cast("bigint"))
