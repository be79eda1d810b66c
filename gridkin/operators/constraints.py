"""Contracts of the landscape tables: each rule gives a row for each violation, and check() raises on any.

Rules read tables once each and send back a few violations, never the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.functions.columns import canonical_pair

#: Violations of a rule that are shown.
SHOWN = 10


class ContractError(ValueError):
    """Tables that break a rule."""


def _say(df: DataFrame, rule: str, *columns: str) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.concat_ws(", ", *(F.col(c).cast("string") for c in columns)).alias("detail"))


def cell_rules(cells: DataFrame, regions: DataFrame, n_features: int) -> list[DataFrame]:
    """cells: every cell of every region once, with n_features finite values. regions: region, n_rows, n_cols."""
    bad = F.col("features").isNull() | (F.size("features") != n_features) | F.exists("features", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    counted = cells.groupBy("region").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("row", "col").alias("places"), F.min(F.least("row", "col")).alias("low"), F.max("row").alias("rows"), F.max("col").alias("cols"))
    joined = regions.join(counted, "region", "full_outer")
    wrong = joined.where(
        F.col("cells").isNull() | F.col("n_rows").isNull() | (F.col("cells") != F.col("n_rows") * F.col("n_cols")) | (F.col("places") != F.col("cells"))
        | (F.col("low") < 0) | (F.col("rows") >= F.col("n_rows")) | (F.col("cols") >= F.col("n_cols"))
    )
    return [_say(cells.where(bad), "features are finite and complete", "region", "row", "col"), _say(wrong, "rasters are complete", "region")]


def unit_rules(units: DataFrame, regions: DataFrame) -> list[DataFrame]:
    """units: two of a region at least, with names that are unique in their species, inside the raster."""
    many = units.groupBy("region", "species", "unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    few = units.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n < 2")
    empty = units.where("unit is null or trim(unit) = '' or species = ''")
    out = units.join(regions, "region", "left").where("n_rows is null or row < 0 or col < 0 or row >= n_rows or col >= n_cols")
    return [
        _say(many, "unit names are unique in a species", "region", "species", "unit"), _say(few, "a region has two units", "region"),
        _say(empty, "names are not empty", "region", "unit"), _say(out, "units lie in the raster", "region", "unit"),
    ]


def observation_rules(observations: DataFrame, units: DataFrame) -> list[DataFrame]:
    """observations: finite values of two different known units, each pair once either way round."""
    from gridkin.operators.alignment import unknown_units

    pair = observations.withColumn("p", canonical_pair(F.col("left"), F.col("right")))
    twice = pair.groupBy("region", "species", "p").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"), F.first("right").alias("right")).where("n > 1")
    return [
        _say(observations.where("value is null or isnan(value) or abs(value) = double('infinity')"), "values are finite", "region", "left", "right"),
        _say(observations.where("left = right or left is null or right is null"), "a pair has two units", "region", "left"),
        _say(twice, "a pair is observed once", "region", "left", "right"),
        _say(unknown_units(observations, units), "observed units exist in their species", "region", "unit"),
    ]


def matrix_rules(matrix: DataFrame) -> list[DataFrame]:
    """matrix: region, species, left, right, value in both orders: symmetric, 0 on the diagonal, no infinities."""
    both = matrix.select("region", "species", F.col("right").alias("left"), F.col("left").alias("right"), F.col("value").alias("turned"))
    from gridkin.operators.alignment import join_groups

    j = join_groups(matrix, both.withColumnsRenamed({"left": "l2", "right": "r2"}).withColumnsRenamed({"l2": "left", "r2": "right"}), ("left", "right"))
    close = F.abs(F.col("value") - F.col("turned")) <= 1e-8 + 1e-5 * F.abs("turned")
    same = close | (F.isnan("value") & F.isnan("turned"))
    return [
        _say(j.where(~same), "the matrix is symmetric", "region", "left", "right"),
        _say(matrix.where("left = right and abs(value) > 1e-8"), "the diagonal is 0", "region", "left"),
        _say(matrix.where("abs(value) = double('infinity')"), "values are not infinite", "region", "left", "right"),
    ]


def calibration_rules(calibrations: DataFrame, floor: float = 1e-10) -> list[DataFrame]:
    """calibrations: one for a region and species, variances at their floor or above, effects aligned."""
    twice = calibrations.groupBy("region", "species").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    low = floor * (1 - 8 * 2.220446049250313e-16)
    bad = (F.col("distance_scale") <= 0) | (F.col("unit_variance") < low) | (F.col("residual_variance") < low)
    uneven = (F.size("population_ids") != F.size("effect_mean")) | (F.size("effect_covariance") != F.size("effect_mean")) | (F.size(F.array_distinct("population_ids")) != F.size("population_ids"))
    return [
        _say(twice, "one calibration a group", "region", "species"), _say(calibrations.where(bad), "scales and variances are positive", "region", "species"),
        _say(calibrations.where(uneven), "effects are aligned with units", "region", "species"),
    ]


def violations(rules: list[DataFrame]) -> DataFrame:
    """rule, detail of every violation."""
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def check(rules: list[DataFrame], also: Callable[[str], None] | None = None) -> None:
    """Raise ContractError with the first violations, if there are any."""
    found = violations(rules).limit(SHOWN).collect()
    if found:
        text = "; ".join(f"{r.rule}: {r.detail}" for r in found)
        if also:
            also(text)
        raise ContractError(text)
