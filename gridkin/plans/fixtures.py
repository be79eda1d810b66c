"""Landscape tables derived from the driver's tables, and the same as SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridkin.operators.alignment import unit_pairs

CELLS = """cells AS (SELECT CAST(l_partkey % 16 AS INTEGER) AS r, CAST(l_orderkey % 16 AS INTEGER) AS c, avg(l_discount) AS f0,
    avg(l_tax) AS f1, avg(l_quantity) / 50 AS f2 FROM lineitem GROUP BY 1, 2)"""
UNITS = """units AS (SELECT r_name AS region, n_name AS unit, n_nationkey AS ord,
    CAST(3 * (((n_nationkey % 5) + CAST(floor(n_nationkey / 5) AS INTEGER)) % 5) AS INTEGER) AS r,
    CAST(3 * (((n_nationkey % 5) + 2 * CAST(floor(n_nationkey / 5) AS INTEGER)) % 5) AS INTEGER) AS c, bal
    FROM nation JOIN region ON n_regionkey = r_regionkey
    JOIN (SELECT c_nationkey, avg(c_acctbal) AS bal FROM customer GROUP BY 1) ON c_nationkey = n_nationkey)"""
OBS = f"""{UNITS}, obs AS (SELECT a.region, a.unit AS lft, b.unit AS rgt, abs(a.bal - b.bal) / (abs(a.bal) + abs(b.bal) + 1) AS value,
    a.r AS lr, a.c AS lc, b.r AS rr, b.c AS rc FROM units a JOIN units b ON a.region = b.region AND a.ord < b.ord)"""
VERTS = f"""{CELLS}, verts AS (SELECT CAST(floor(r / 2) AS INTEGER) AS vr, CAST(floor(c / 2) AS INTEGER) AS vc,
    0.01::DOUBLE + exp(2 * avg(f0) - avg(f1) + 0.5::DOUBLE * avg(f2)) AS g FROM cells GROUP BY 1, 2)"""
IBD = f"""{OBS}, ibd AS (SELECT region, lft, rgt, value,
    0.1::DOUBLE * sqrt(power(floor(lr / 2) - floor(rr / 2), 2) + power(floor(lc / 2) - floor(rc / 2), 2)) + 0.03::DOUBLE AS s FROM obs)"""


@contextmanager
def shared_folder(spark: SparkSession, name: str) -> Iterator[str]:
    """A folder that driver and executors share, and that goes at the end: in spark.checkpoint.dir, or a temporary
    one in local sessions without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.gettempdir()
    path = f"{base.rstrip('/')}/gridkin-{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        yield path
    finally:
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def tidy(c: Column | str, digits: int = 6) -> Column:
    """Rounded, and never -0.0."""
    return F.round(c if isinstance(c, Column) else F.col(c), digits) + F.lit(0.0)


def cells(spark: SparkSession, d: str) -> DataFrame:
    """One 16 x 16 raster of three features, region study."""
    row, col = (F.col("l_partkey") % 16).cast("int"), (F.col("l_orderkey") % 16).cast("int")
    means = table(spark, d, "lineitem").groupBy(row.alias("row"), col.alias("col")).agg(
        F.avg("l_discount").alias("f0"), F.avg("l_tax").alias("f1"), (F.avg("l_quantity") / 50).alias("f2")
    )
    return means.select(F.lit("study").alias("region"), "row", "col", F.array("f0", "f1", "f2").alias("features"))


def units(spark: SparkSession, d: str) -> DataFrame:
    """25 sampling units at cells of their own, in five regions, with a measured value."""
    bal = table(spark, d, "customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("bal"))
    k, five = F.col("n_nationkey"), F.floor(F.col("n_nationkey") / 5).cast("int")
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(bal, k == F.col("c_nationkey"))
    return joined.select(
        F.col("r_name").alias("region"), F.lit(None).cast("string").alias("species"), F.col("n_name").alias("unit"), k.alias("unit_ord"),
        (3 * ((k % 5 + five) % 5)).cast("int").alias("row"), (3 * ((k % 5 + 2 * five) % 5)).cast("int").alias("col"), "bal",
    )


def observations(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of a region's units with a dissimilarity in [0, 1), aligned."""
    u = units(spark, d)
    out = unit_pairs(u)
    for side in ("left", "right"):
        own = u.select(F.col("region").alias("_r"), F.col("unit").alias("_u"), F.col("bal").alias(f"_{side}"))
        out = out.join(own, (out["region"] == own["_r"]) & (out[side] == own["_u"])).drop("_r", "_u")
    value = F.abs(F.col("_left") - F.col("_right")) / (F.abs("_left") + F.abs("_right") + 1)
    return out.withColumn("value", value).drop("_left", "_right")


def vertices(spark: SparkSession, d: str) -> DataFrame:
    """An 8 x 8 conductance surface, region study."""
    from gridkin.operators.models import patch_means

    f = lambda i: F.get("features", F.lit(i))
    g = F.lit(0.01) + F.exp(2 * f(0) - f(1) + F.lit(0.5) * f(2))
    return patch_means(cells(spark, d), 2, 3).select("region", F.lit(None).cast("string").alias("species"), "row", "col", g.alias("conductance"))


def study_units(spark: SparkSession, d: str) -> DataFrame:
    """The 25 units in one region, study."""
    return units(spark, d).withColumn("region", F.lit("study"))
