"""Scalar expressions: every one is a Column of built-in functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width of the bend of the smooth cap on log conductance, and its default limits.
CAP_WIDTH = 0.1
MIN_CONDUCTANCE, MAX_CONDUCTANCE = 0.01, 1000.0


def softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def inverse_softplus(y: Column) -> Column:
    return y + F.log(-F.expm1(-y))


def pixel_id(row: Column, col: Column, n_cols: Column) -> Column:
    """Row-major number of a raster cell."""
    return (row * n_cols + col).cast("int")


def patch_of(index: Column, patch_size: int) -> Column:
    """Index of the patch that a row or column index falls in."""
    return F.floor(index / F.lit(patch_size)).cast("int")


def pixel_vertex(pixel: Column, n_cols: Column, patch_size: int) -> Column:
    """Graph vertex of a cell: the row-major number of its patch."""
    row, col = F.floor(pixel / n_cols), pixel % n_cols
    return (F.floor(row / patch_size) * F.floor(n_cols / patch_size) + F.floor(col / patch_size)).cast("int")


def dot(left: Column, right: Column, start: Column | float = 0.0) -> Column:
    """start + sum of products of two arrays, in their order."""
    first = start if isinstance(start, Column) else F.lit(float(start))
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), first, lambda s, v: s + v)


def squared_distance(left: Column, right: Column) -> Column:
    """Sum of squared differences of two arrays."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def _ceiling(lowest: float, highest: float) -> float:
    return math.log(highest - lowest)


def capped(predictor: Column, lowest: float = MIN_CONDUCTANCE, highest: float = MAX_CONDUCTANCE) -> Column:
    """Predictor bent below log(highest - lowest), written from the ceiling down."""
    top = _ceiling(lowest, highest)
    return F.lit(top) - CAP_WIDTH * softplus((F.lit(top) - predictor) / CAP_WIDTH)


def uncapped(value: Column, lowest: float = MIN_CONDUCTANCE, highest: float = MAX_CONDUCTANCE) -> Column:
    """The predictor that capped() takes to value."""
    top = _ceiling(lowest, highest)
    return value - CAP_WIDTH * F.log(-F.expm1((value - F.lit(top)) / CAP_WIDTH))


def loglinear_conductance(predictor: Column, lowest: float = MIN_CONDUCTANCE, highest: float = MAX_CONDUCTANCE) -> Column:
    grown = F.exp(capped(predictor, lowest, highest)) + lowest
    return F.greatest(F.lit(lowest), F.least(F.lit(highest), grown))


def saturated(predictor: Column, lowest: float = MIN_CONDUCTANCE, highest: float = MAX_CONDUCTANCE) -> Column:
    """Whether the predictor has left the range in which it moves the conductance."""
    return (F.exp(predictor) < lowest) | (predictor >= _ceiling(lowest, highest))


def softplus_conductance(latent: Column, lowest: float = 1e-6) -> Column:
    """Conductance of a network's latent value."""
    return softplus(latent) + lowest


def straight_distance(d_row: Column, d_col: Column, slope: float, intercept: float) -> Column:
    """slope * straight-line distance + intercept, in vertex spacings."""
    return F.lit(slope) * F.sqrt(d_row * d_row + d_col * d_col) + F.lit(intercept)


def relative_log10(conductance: Column, reference: Column) -> Column:
    """log10 of resistance relative to a reference class."""
    return F.log10(reference / conductance)


def canonical_pair(left: Column, right: Column) -> Column:
    """One identity for a pair, whichever way round it is named."""
    return F.struct(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
