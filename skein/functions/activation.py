"""Sigmoid replacements used by the logistic trainer, as column expressions.

Fixed values (must equal the reference's definitions):
  linear        0.25*z + 0.5
  cube          -0.004*z^3 + 0.197*z + 0.5
  segmentation  z when -0.5 < z < 0.5, else 0
  origin        1 / (1 + exp(-z))      (also accepted as "original")
The "half" form of linear, 0.25*z, is what the party that must not add the
constant contributes; adding both halves plus 0.5 gives the linear value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ACTIVATIONS = ("linear", "cube", "segmentation", "origin")
_ALIASES = {"original": "origin"}


def canonical(name: str) -> str:
    name = _ALIASES.get(name, name)
    if name not in ACTIVATIONS:
        raise ValueError(f"unknown activation {name!r}; expected one of {ACTIVATIONS}")
    return name


def activation(z: Column, name: str) -> Column:
    name = canonical(name)
    if name == "linear":
        return z * F.lit(0.25) + F.lit(0.5)
    if name == "cube":
        return F.lit(-0.004) * z * z * z + F.lit(0.197) * z + F.lit(0.5)
    if name == "segmentation":
        return F.when((z > F.lit(-0.5)) & (z < F.lit(0.5)), z).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def activation_by_name(z: Column, name_col: Column) -> Column:
    """Activation chosen per row from a string column (grid sweeps)."""
    return (
        F.when(name_col == "linear", activation(z, "linear"))
        .when(name_col == "cube", activation(z, "cube"))
        .when(name_col == "segmentation", activation(z, "segmentation"))
        .when(name_col.isin("origin", "original"), activation(z, "origin"))
        .otherwise(F.raise_error(F.concat(F.lit("unknown activation "), name_col)))
    )


def half_linear(z: Column) -> Column:
    return z * F.lit(0.25)


def activation_np(z: np.ndarray, name: str) -> np.ndarray:
    name = canonical(name)
    if name == "linear":
        return z * 0.25 + 0.5
    if name == "cube":
        return -0.004 * z * z * z + 0.197 * z + 0.5
    if name == "segmentation":
        return np.where((z > -0.5) & (z < 0.5), z, 0.0)
    return 1.0 / (1.0 + np.exp(-z))


def sql_activation(z: str, name: str) -> str:
    name = canonical(name)
    if name == "linear":
        return f"(({z}) * 0.25 + 0.5)"
    if name == "cube":
        return f"(-0.004 * ({z}) * ({z}) * ({z}) + 0.197 * ({z}) + 0.5)"
    if name == "segmentation":
        return f"(CASE WHEN ({z}) > -0.5 AND ({z}) < 0.5 THEN ({z}) ELSE 0.0 END)"
    return f"(1.0 / (1.0 + exp(-({z}))))"
