"""Observations that arrive over time: the batch rules as a stream, and running group moments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridkin.functions.columns import canonical_pair
from gridkin.functions.targets import TRANSFORMS, TargetSpec


def accepted(arrivals: DataFrame, target: TargetSpec, *, time_col: str = "ts", delay: str = "1 day") -> DataFrame:
    """Arrivals (region, species, left, right, value, time) that can be observations, each pair once while its
    first arrival is within delay; rejects are those of rejected()."""
    good = arrivals.where((F.col("left") != F.col("right")) & TRANSFORMS[target.transform].domain(F.col("value")))
    keyed = good.withColumn("pair", canonical_pair(F.col("left"), F.col("right"))).withWatermark(time_col, delay)
    return keyed.dropDuplicatesWithinWatermark(["region", "species", "pair"]).drop("pair")


def rejected(arrivals: DataFrame, target: TargetSpec) -> DataFrame:
    """Arrivals that name one unit twice, or whose value is null or outside the target's domain."""
    fine = (F.col("left") != F.col("right")) & TRANSFORMS[target.transform].domain(F.col("value"))
    return arrivals.where(~F.coalesce(fine, F.lit(False)))


def running_moments(arrivals: DataFrame) -> DataFrame:
    """region, species, pairs, mean and sample deviation of the values so far."""
    return arrivals.groupBy("region", "species").agg(F.count(F.lit(1)).alias("pairs"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("deviation"))
