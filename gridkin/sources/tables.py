"""Landscape tables from what studies have: rasters, points, matrices, lists of pairs, CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridkin.operators.alignment import endpoints, snap_points


def matrix_observations(wide: DataFrame, unit_col: str, *, region: str, species: str | None = None) -> DataFrame:
    """region, species, left, right, left_ord, right_ord, value from a matrix with a column for each unit, named
    like the rows' units; the rows' order is the columns'. Nulls count as not observed (NaN)."""
    names = [c for c in wide.columns if c != unit_col]
    place = F.coalesce(*(F.when(F.col(unit_col) == n, F.lit(i)) for i, n in enumerate(names)))
    long = wide.select(F.col(unit_col).alias("left"), place.alias("left_ord"), F.posexplode(F.array(*(F.col(f"`{n}`").cast("double") for n in names))).alias("right_ord", "value"))
    right = F.element_at(F.array(*map(F.lit, names)), F.col("right_ord") + 1)
    return long.select(F.lit(region).alias("region"), F.lit(species).cast("string").alias("species"), "left", right.alias("right"), "left_ord", "right_ord", F.coalesce("value", F.lit(float("nan"))).alias("value"))


def units_of_pairs(pairs: DataFrame) -> DataFrame:
    """region, species, unit, unit_ord: the sorted names of the pairs' units."""
    by = Window.partitionBy("region", "species").orderBy("unit")
    return endpoints(pairs).withColumn("unit_ord", F.row_number().over(by) - 1)


def located_units(points: DataFrame, ticks: DataFrame) -> DataFrame:
    """units from projected coordinates: points with row and col of their cell. Points outside fail the job by name.

    points: region, species, unit, unit_ord, x, y.
    """
    at = snap_points(points, ticks)
    out = F.raise_error(F.concat(F.lit("unit outside the raster: "), "region", F.lit(" "), "unit")).cast("int")
    inside = F.col("row").isNotNull() & F.col("col").isNotNull()
    return at.withColumn("row", F.when(inside, F.col("row")).otherwise(out)).select("region", "species", "unit", "unit_ord", "row", "col")


def class_shares(pixels: DataFrame, classes: dict[str, list[int]], factor: int, patch_size: int) -> DataFrame:
    """cells from a raster of class codes: the share of each class's codes in factor x factor pixels, rows and
    columns that fill no cell or patch left out. pixels: region, row, col, value."""
    size = pixels.groupBy("region").agg((F.max("row") + 1).alias("h"), (F.max("col") + 1).alias("w"))

    def whole(n: Column) -> Column:
        return F.floor(F.floor(n / factor) / patch_size) * patch_size

    row, col = F.floor(F.col("row") / factor), F.floor(F.col("col") / factor)
    kept = pixels.join(size, "region").where((row < whole(F.col("h"))) & (col < whole(F.col("w"))))
    shares = [F.avg(F.col("value").isin(list(codes)).cast("double")).alias(f"_{i}") for i, codes in enumerate(classes.values())]
    out = kept.groupBy("region", row.cast("int").alias("row_"), col.cast("int").alias("col_")).agg(*shares)
    return out.select("region", F.col("row_").alias("row"), F.col("col_").alias("col"), F.array(*(F.col(f"_{i}") for i in range(len(classes)))).alias("features"))


def read_sites(spark: SparkSession, path: str, region: str) -> DataFrame:
    """points from a CSV file with columns site, x, y, in file order of names."""
    raw = spark.read.csv(path, header=True, schema="site string, x double, y double")
    by = Window.partitionBy("region").orderBy("unit")
    named = raw.select(F.lit(region).alias("region"), F.lit(None).cast("string").alias("species"), F.col("site").alias("unit"), "x", "y")
    return named.withColumn("unit_ord", F.row_number().over(by) - 1)


def read_matrix(spark: SparkSession, path: str, region: str, index: str = "site") -> DataFrame:
    """observations from a CSV matrix whose first column names the rows."""
    return matrix_observations(spark.read.csv(path, header=True), index, region=region)


def write_surface(surface: DataFrame, path: str) -> None:
    """A conductance surface as Parquet, a folder for each region."""
    surface.write.mode("overwrite").partitionBy("region").parquet(path)
