"""The registered queries and their SQL equivalents: one or more for each operator."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridkin.functions import columns as C
from gridkin.functions.targets import TargetSpec
from gridkin.operators import alignment as A
from gridkin.operators import calibration as K
from gridkin.operators import mlpe as M
from gridkin.operators import models as D
from gridkin.operators import training as T
from gridkin.operators.resistance import chain_resistances, resistances, unit_resistances
from gridkin.plans import fixtures as X
from gridkin.plans.fixtures import CELLS, IBD, OBS, UNITS, VERTS, tidy
from gridkin.sources import store
from gridkin.sources import tables as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

ODDS = TargetSpec("odds of dissimilarity", transform="odds")
PLAIN = TargetSpec("dissimilarity")
LINE = D.StraightLine(patch_size=2, slope=(0.1,), intercept=(0.03,))
#: Coefficients, intercept and limits of the log-linear surface in the queries.
BETA, BIAS, LOW, HIGH = (2.0, -1.0, 0.5), 0.3, 0.25, 5.0
LOGLINEAR = D.LogLinear(patch_size=2, beta=(BETA,), bias=(BIAS,), lowest=LOW, highest=HIGH)
#: Unit variance and noise of the likelihood queries.
U, E = 0.2, 0.05


@dataclass(frozen=True)
class _TableEmbedding(D.EmbeddingModel):
    """A model of a user's own: the vectors stand in the table of units."""

    def embedding(self, cells: DataFrame, units: DataFrame) -> DataFrame:
        return units.select("region", "species", "unit", "vector")


@dataclass(frozen=True)
class _Blocks(D.DistanceModel):
    """Another: the sum of the steps along rows and columns, times a factor for each species."""

    factor: tuple[float, ...] = (1.0,)

    def pair_distances(self, cells: DataFrame, units: DataFrame, pairs: DataFrame) -> DataFrame:
        steps = F.abs(F.col("left_row") - F.col("right_row")) + F.abs(F.col("left_col") - F.col("right_col"))
        by = F.coalesce(*(F.when(F.col("species").eqNullSafe(F.lit(n)), F.lit(x)) for n, x in zip(self.species, self.factor, strict=True)))
        return pairs.select("region", "species", "left", "right", (steps * by).alias("distance"))


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _distances(spark: SparkSession, d: str) -> DataFrame:
    """Observed pairs with straight-line distances and targets."""
    o = X.observations(spark, d)
    line = LINE.distances(X.cells(spark, d), X.units(spark, d), o)
    return line.join(o.select("region", "left", "right", "value"), ["region", "left", "right"])


def _mlpe_pairs(spark: SparkSession, d: str) -> DataFrame:
    # read many times in the closed forms: kept, so that plans stay short
    return _distances(spark, d).withColumn("target", F.log1p("value")).persist()


# --- sources and targets


@query(f"WITH {UNITS} SELECT region, unit, ord AS unit_ord, r AS row, c AS col, round(bal, 6) + 0.0 AS bal FROM units")
def q_units(spark, d):
    return X.units(spark, d).select("region", "unit", "unit_ord", "row", "col", tidy("bal").alias("bal"))


@query(f"WITH {OBS} SELECT region, lft AS \"left\", rgt AS \"right\", round(value, 9) + 0.0 AS value FROM obs")
def q_observations(spark, d):
    return X.observations(spark, d).select("region", "left", "right", tidy("value", 9).alias("value"))


@query(f"""WITH {CELLS} SELECT r AS row, c AS col, r * 16 + c AS pixel,
    CAST(floor(r / 2) * 8 + floor(c / 2) AS INTEGER) AS vertex, round(f0, 9) + 0.0 AS f0, round(f1, 9) + 0.0 AS f1, round(f2, 9) + 0.0 AS f2 FROM cells""")  # fmt: skip
def q_cells(spark, d):
    f = [tidy(F.get("features", F.lit(i)), 9).alias(f"f{i}") for i in range(3)]
    pixel = C.pixel_id(F.col("row"), F.col("col"), F.lit(16))
    return X.cells(spark, d).select("row", "col", pixel.alias("pixel"), C.pixel_vertex(pixel, F.lit(16), 2).alias("vertex"), *f)


def _target_query(transform: str, sql: str) -> None:
    spec = TargetSpec("value", transform=transform)

    def run(spark: SparkSession, d: str) -> DataFrame:
        o = X.observations(spark, d).select("region", "left", "right", spec.forward(F.col("value")).alias("t"))
        return o.select("region", "left", "right", tidy("t", 8).alias("forward"), tidy(spec.inverse(F.col("t")), 8).alias("back"))

    query(f"WITH {OBS} SELECT region, lft AS \"left\", rgt AS \"right\", round({sql}, 8) + 0.0 AS forward, round(value, 8) + 0.0 AS back FROM obs", f"q_target_{transform}")(run)


for _name, _sql in (("identity", "value"), ("log1p", "ln(1 + value)"), ("sqrt", "sqrt(value)"), ("odds", "value / (1 - value)")):
    _target_query(_name, _sql)


@query(f"""WITH {OBS} SELECT region, count(*) AS pairs, round(sum(exp(value) - 1), 6) + 0.0 AS expm1, round(sum(value * value), 6) + 0.0 AS square,
    round(sum(value / (1 + value)), 6) + 0.0 AS share FROM obs GROUP BY region""")  # fmt: skip
def q_target_inverse(spark, d):
    inverse = lambda t: tidy(F.sum(TargetSpec("v", transform=t).inverse(F.col("value"))))
    return X.observations(spark, d).groupBy("region").agg(
        F.count(F.lit(1)).alias("pairs"), inverse("log1p").alias("expm1"), inverse("sqrt").alias("square"), inverse("odds").alias("share")
    )


# --- filters and set operations


def _long_matrix(spark, d):
    """Both orientations of each pair, a diagonal of zeros, and NaN where the sum of the orders is a multiple of 7."""
    o = X.observations(spark, d).select("region", "species", "left", "right", "left_ord", "right_ord", "value")
    turned = o.select("region", "species", F.col("right").alias("left"), F.col("left").alias("right"), F.col("right_ord").alias("left_ord"), F.col("left_ord").alias("right_ord"), "value")
    gap = (F.col("left_ord") + F.col("right_ord")) % 7 == 0
    return o.union(turned).withColumn("value", F.when(gap, F.lit(float("nan"))).otherwise(F.col("value")))


@query(f"""WITH {UNITS} SELECT a.region, a.unit AS "left", b.unit AS "right", round(abs(a.bal - b.bal) / (abs(a.bal) + abs(b.bal) + 1), 9) + 0.0 AS value
    FROM units a JOIN units b ON a.region = b.region AND a.ord < b.ord WHERE (a.ord + b.ord) % 7 <> 0""")  # fmt: skip
def q_observed_pairs(spark, d):
    return A.observed_pairs(_long_matrix(spark, d)).select("region", "left", "right", tidy("value", 9).alias("value"))


@query(f"WITH {OBS} SELECT region, lft AS \"left\", rgt AS \"right\", round(value, 9) + 0.0 AS value FROM obs WHERE lr = rr OR lc < rc")
def q_select_pairs(spark, d):
    o = X.observations(spark, d)
    wanted = o.where("left_row = right_row or left_col < right_col").select("region", "species", F.col("right").alias("left"), F.col("left").alias("right"))
    return A.select_pairs(o, wanted).select("region", "left", "right", tidy("value", 9).alias("value"))


@query("""SELECT CAST(label AS VARCHAR) AS species, count(*) AS units, min(vec_id) AS first, max(vec_id) AS last FROM embeddings WHERE label = 3 GROUP BY 1""")
def q_species_filter(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("label").cast("string").alias("species"), "vec_id")
    return A.of_species(e, "3").groupBy("species").agg(F.count(F.lit(1)).alias("units"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


@query(f"WITH {OBS} SELECT region, unit, CAST(row_number() OVER (PARTITION BY region ORDER BY unit) AS INTEGER) AS unit_ord FROM (SELECT region, lft AS unit FROM obs UNION SELECT region, rgt FROM obs)")
def q_endpoint_units(spark, d):
    u = S.units_of_pairs(X.observations(spark, d))
    return u.select("region", "unit", (F.col("unit_ord") + 1).alias("unit_ord"))


@query(f"WITH {OBS} SELECT region, least(lft, rgt) AS a, greatest(lft, rgt) AS b FROM obs WHERE value < 0.5 INTERSECT SELECT region, least(lft, rgt), greatest(lft, rgt) FROM obs WHERE lr < rr")
def q_shared_pairs(spark, d):
    o = X.observations(spark, d)
    turned = o.where("left_row < right_row").select("region", "species", F.col("right").alias("left"), F.col("left").alias("right"))
    return A.shared_pairs(o.where("value < 0.5"), turned).select("region", "pair.a", "pair.b")


@query(f"WITH {OBS} SELECT DISTINCT o.region, o.unit FROM (SELECT region, lft AS unit FROM obs UNION SELECT region, rgt FROM obs) o ANTI JOIN (SELECT * FROM units WHERE ord % 3 = 0) u ON o.region = u.region AND o.unit = u.unit")
def q_unknown_units(spark, d):
    return A.unknown_units(X.observations(spark, d), X.units(spark, d).where("unit_ord % 3 = 0")).select("region", "unit")


@query(f"""WITH {UNITS} SELECT CAST(floor(r / 8) AS INTEGER) AS vr, CAST(floor(c / 8) AS INTEGER) AS vc, string_agg(unit, ',' ORDER BY unit) AS units
    FROM units GROUP BY 1, 2 HAVING count(*) > 1""")  # fmt: skip
def q_shared_vertices(spark, d):
    return D.shared_vertices(X.study_units(spark, d), 8).select("vr", "vc", F.array_join("units", ",").alias("units"))


@query("""SELECT n_name AS region, n_nationkey % 5 AS drop_rows, (n_nationkey * 3) % 5 AS drop_cols FROM nation WHERE n_nationkey % 5 > 0 OR (n_nationkey * 3) % 5 > 0""")
def q_patch_divisible(spark, d):
    r = X.table(spark, d, "nation").select(F.col("n_name").alias("region"), (10 + F.col("n_nationkey")).alias("n_rows"), (20 + 3 * F.col("n_nationkey")).alias("n_cols"))
    return D.indivisible(r, 5).select("region", "drop_rows", "drop_cols")


# --- points


def _ticks(spark, kind):
    c = {"regular": "10.0D * id + 5", "descending": "10.0D * (15 - id) + 5", "irregular": "cast(id * id as double)"}[kind]
    t = spark.range(16).select(F.lit("study").alias("region"), F.col("id").cast("int").alias("idx"), F.expr(c).alias("center"))
    return t.withColumn("dim", F.lit("row")).unionByName(t.withColumn("dim", F.lit("column")))


def _snap(kind: str, center: str) -> None:
    span = 230 if kind == "irregular" else 161

    def run(spark: SparkSession, d: str) -> DataFrame:
        k = F.col("c_custkey")
        points = X.table(spark, d, "customer").select(
            F.lit("study").alias("region"), k.cast("string").alias("unit"), ((k * 5) % span).cast("double").alias("x"), ((k * 37) % span).cast("double").alias("y")
        )
        return A.snap_points(points, _ticks(spark, kind)).select("unit", "x", "y", "row", "col")

    sql = f"""WITH t AS (SELECT CAST(range AS INTEGER) AS idx, {center} AS center FROM range(16)), s AS (SELECT sign(b.center - a.center) AS d FROM t a, t b WHERE a.idx = 0 AND b.idx = 1),
        k AS (SELECT idx, d, d * center AS c FROM t, s), l AS (SELECT idx, d, c, lag(c) OVER (ORDER BY idx) AS p, lead(c) OVER (ORDER BY idx) AS n FROM k),
        e AS (SELECT idx, d, coalesce((p + c) / 2, 1.5 * c - 0.5 * n) AS lo, coalesce((c + n) / 2, 1.5 * c - 0.5 * p) AS hi, 1e-6 * min(n - c) OVER () AS tol FROM l),
        q AS (SELECT CAST(c_custkey AS VARCHAR) AS unit, CAST((c_custkey * 5) % {span} AS DOUBLE) AS x, CAST((c_custkey * 37) % {span} AS DOUBLE) AS y FROM customer)
        SELECT unit, x, y, a.idx AS row, b.idx AS col FROM q
        LEFT JOIN e a ON a.d * y >= a.lo - CASE WHEN a.idx = 0 THEN a.tol ELSE 0 END AND (a.d * y < a.hi OR (a.idx = 15 AND a.d * y <= a.hi + a.tol))
        LEFT JOIN e b ON b.d * x >= b.lo - CASE WHEN b.idx = 0 THEN b.tol ELSE 0 END AND (b.d * x < b.hi OR (b.idx = 15 AND b.d * x <= b.hi + b.tol))"""
    query(sql, f"q_snap_points_{kind}")(run)


_snap("regular", "10.0::DOUBLE * range + 5")
_snap("descending", "10.0::DOUBLE * (15 - range) + 5")
_snap("irregular", "CAST(range * range AS DOUBLE)")


# --- patches and surfaces


@query(f"""WITH {CELLS} SELECT CAST(floor(r / 4) AS INTEGER) AS row, CAST(floor(c / 4) AS INTEGER) AS col, round(avg(f0), 9) + 0.0 AS f0,
    round(avg(f1), 9) + 0.0 AS f1, round(avg(f2), 9) + 0.0 AS f2 FROM cells GROUP BY 1, 2""")  # fmt: skip
def q_patch_mean(spark, d):
    f = [tidy(F.get("features", F.lit(i)), 9).alias(f"f{i}") for i in range(3)]
    return D.patch_means(X.cells(spark, d), 4, 3).select("row", "col", *f)


@query("SELECT CAST(floor(range / 4) AS INTEGER) AS idx, avg(10.0 * (15 - range) + 5) AS center FROM range(16) GROUP BY 1")
def q_patch_axis(spark, d):
    return D.patch_centers(_ticks(spark, "descending").where("dim = 'row'"), 4).select("idx", "center")


_PRED = f"""{CELLS}, pred AS (SELECT CAST(floor(r / 2) AS INTEGER) AS row, CAST(floor(c / 2) AS INTEGER) AS col,
    {BIAS} + avg(f0) * {BETA[0]} + avg(f1) * {BETA[1]} + avg(f2) * {BETA[2]} AS eta FROM cells GROUP BY 1, 2), cond AS (SELECT row, col, eta, greatest({LOW}, least({HIGH},
    exp(ln({HIGH - LOW}) - 0.1 * (greatest((ln({HIGH - LOW}) - eta) / 0.1, 0) + ln(1 + exp(-abs((ln({HIGH - LOW}) - eta) / 0.1))))) + {LOW})) AS g FROM pred)"""


@query(f"WITH {_PRED} SELECT row, col, round(eta, 8) + 0.0 AS predictor, round(g, 8) + 0.0 AS conductance FROM pred JOIN cond USING (row, col, eta)")
def q_loglinear_conductance(spark, d):
    c = X.cells(spark, d)
    both = LOGLINEAR.predictor(c).join(LOGLINEAR.conductance(c).drop("species"), ["region", "row", "col"])
    return both.select("row", "col", tidy("predictor", 8).alias("predictor"), tidy("conductance", 8).alias("conductance"))


@query(f"WITH {_PRED} SELECT row, col, exp(eta - 1.6) < {LOW} OR eta - 1.6 >= ln({HIGH - LOW}) AS saturated FROM pred")
def q_saturation(spark, d):
    m = D.LogLinear(patch_size=2, beta=(BETA,), bias=(BIAS - 1.6,), lowest=LOW, highest=HIGH)
    return m.saturation(X.cells(spark, d)).select("row", "col", "saturated")


@query(f"WITH {_PRED} SELECT row, col, round(eta, 6) + 0.0 AS back FROM pred")
def q_uncapped(spark, d):
    p = LOGLINEAR.predictor(X.cells(spark, d))
    return p.select("row", "col", tidy(C.uncapped(C.capped(F.col("predictor"), LOW, HIGH), LOW, HIGH)).alias("back"))


@query(f"""WITH {CELLS} SELECT 'f0' AS feature, round(avg(f0) * {BETA[0]}, 8) + 0.0 AS part FROM cells UNION ALL SELECT 'f1', round(avg(f1) * {BETA[1]}, 8) + 0.0 FROM cells
    UNION ALL SELECT 'f2', round(avg(f2) * {BETA[2]}, 8) + 0.0 FROM cells""")  # fmt: skip
def q_feature_effects(spark, d):
    """What each feature adds to the mean predictor, by the model's effects."""
    effects = LOGLINEAR.effects(["f0", "f1", "f2"])
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), (F.get("features", F.lit(i)) * effects[f][None]).alias("part")) for i, f in enumerate(effects))))
    return X.cells(spark, d).select(each.alias("e")).groupBy("e.feature").agg(tidy(F.avg("e.part"), 8).alias("part"))


@query(f"WITH {_PRED} SELECT row, col, round(log10((SELECT g FROM cond WHERE row = 0 AND col = 0) / g), 8) + 0.0 AS relative, round(1 / g, 8) + 0.0 AS resistance FROM cond")
def q_relative_resistance(spark, d):
    c = LOGLINEAR.conductance(X.cells(spark, d))
    ref = c.where("row = 0 and col = 0").select("region", F.col("conductance").alias("ref"))  # one row a region
    return c.join(ref, "region").select("row", "col", tidy(C.relative_log10(F.col("conductance"), F.col("ref")), 8).alias("relative"), tidy(1 / F.col("conductance"), 8).alias("resistance"))


@query(f"WITH {CELLS} SELECT CAST(floor(r / 2) AS INTEGER) AS row, CAST(floor(c / 2) AS INTEGER) AS col, round(ln(1 + exp(avg(f0) * 3 - avg(f2) * 2 + 0.1)) + 1e-6, 8) + 0.0 AS conductance FROM cells GROUP BY 1, 2")
def q_softplus_conductance(spark, d):
    m = D.patch_means(X.cells(spark, d), 2, 3)
    latent = C.dot(F.col("features"), F.array(F.lit(3.0), F.lit(0.0), F.lit(-2.0)), 0.1)
    return m.select("row", "col", tidy(C.softplus_conductance(latent), 8).alias("conductance"))


@query(f"WITH {_PRED} SELECT row, col, 10.0 * (15 - (2 * row + 0.5)) + 5 AS y, 10.0 * (15 - (2 * col + 0.5)) + 5 AS x, round(ln(g), 8) + 0.0 AS log_g FROM cond")
def q_surface_coordinates(spark, d):
    out = LOGLINEAR.surface(X.cells(spark, d), _ticks(spark, "descending"))
    return out.select("row", "col", "y", "x", tidy(F.log("conductance"), 8).alias("log_g"))


_EDGES = f"""{VERTS}, edges AS (SELECT a.vr AS row, a.vc AS col, b.vr AS row2, b.vc AS col2, (a.g + b.g) / 2 AS g FROM verts a JOIN verts b
    ON (a.vr = b.vr AND a.vc + 1 = b.vc) OR (a.vr + 1 = b.vr AND a.vc = b.vc))"""


@query(f"WITH {_EDGES} SELECT row, col, CAST(row2 AS INTEGER) AS row2, CAST(col2 AS INTEGER) AS col2, round(g, 8) + 0.0 AS conductance FROM edges")
def q_edge_conductance(spark, d):
    return A.adjacency(X.vertices(spark, d), "conductance").select("row", "col", "row2", "col2", tidy("conductance", 8).alias("conductance"))


# --- distances


_CHAIN = """WITH v AS (SELECT CAST(l_partkey % 200 AS INTEGER) AS k, 0.01 + avg(l_discount) AS c FROM lineitem GROUP BY 1),
    s AS (SELECT k, coalesce(2.0 / (lag(c) OVER (ORDER BY k) + c), 0) AS step FROM v), p AS (SELECT k, sum(step) OVER (ORDER BY k) AS at FROM s)
    SELECT a.k AS a, b.k AS b, round(b.at - a.at, 4) + 0.0 AS resistance FROM p a JOIN p b ON a.k < b.k"""


def _chain(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("l_partkey") % 200).cast("int")
    v = X.table(spark, d, "lineitem").groupBy(k.alias("col")).agg((F.lit(0.01) + F.avg("l_discount")).alias("conductance"))
    return v.select(F.lit("row").alias("region"), F.lit(0).alias("row"), "col", "conductance")


@query(_CHAIN)
def q_resistance_chain(spark, d):
    """A raster of one row, by running sums: every pair of vertices."""
    ends = chain_resistances(_chain(spark, d))
    a, b = ends.select("region", F.col("col").alias("a"), F.col("at").alias("p")), ends.select("region", F.col("col").alias("b"), F.col("at").alias("q"))
    return a.join(b, "region").where("a < b").select("a", "b", tidy(F.col("q") - F.col("p"), 4).alias("resistance"))


@query(_CHAIN)
def q_resistance_kernel_chain(spark, d):
    """The same raster by the kernel."""
    v = _chain(spark, d)
    r = resistances(v, v.select("region", F.col("row").alias("vr"), F.col("col").alias("vc")))
    return r.select(F.col("c1").alias("a"), F.col("c2").alias("b"), tidy("resistance", 4).alias("resistance"))


@query(f"WITH {VERTS} SELECT CAST(count(*) - 1 AS DOUBLE) AS total FROM verts")
def q_resistance_foster(spark, d):
    """Edge conductances times resistances add up to the number of vertices less one."""
    v = X.vertices(spark, d)
    r = resistances(v, v.select("region", F.col("row").alias("vr"), F.col("col").alias("vc")))
    e = A.adjacency(v, "conductance").withColumnsRenamed({"row": "r1", "col": "c1", "row2": "r2", "col2": "c2"})
    return e.join(r, ["region", "r1", "c1", "r2", "c2"]).agg(tidy(F.sum(F.col("conductance") * F.col("resistance"))).alias("total"))


@query(f"WITH {UNITS} SELECT count(*) AS pairs, true AS equal FROM units a JOIN units b ON a.ord < b.ord")
def q_resistance_scale(spark, d):
    """Four times the conductance, a quarter of the resistance."""
    v = X.vertices(spark, d)
    at = A.terminals(X.study_units(spark, d), 2)
    a = resistances(v, at)
    b = resistances(v.withColumn("conductance", 4 * F.col("conductance")), at).withColumnRenamed("resistance", "quarter")
    j = a.join(b, ["region", "r1", "c1", "r2", "c2"])
    return j.agg(F.count(F.lit(1)).alias("pairs"), F.every(F.abs(F.col("resistance") - 4 * F.col("quarter")) < 1e-9).alias("equal"))


@query(f"WITH {UNITS} SELECT a.unit AS \"left\", b.unit AS \"right\", true AS bounded FROM units a JOIN units b ON a.ord < b.ord")
def q_resistance_pairs(spark, d):
    """Resistances of all pairs of units, each at most that of a straight way between them."""
    u, m = X.study_units(spark, d), D.LogLinear(patch_size=2, beta=(BETA,), bias=(BIAS,), lowest=LOW, highest=HIGH)
    r = m.distances(X.cells(spark, d), u)
    far = D.StraightLine(patch_size=2, slope=(2.0 / LOW,), intercept=(0.0,)).distances(X.cells(spark, d), u).withColumnRenamed("distance", "far")
    return r.join(far.drop("species"), ["region", "left", "right"]).select("left", "right", ((F.col("distance") > 0) & (F.col("distance") <= F.col("far"))).alias("bounded"))


@query("""SELECT CAST(a.label AS VARCHAR) AS species, a.vec_id AS "left", b.vec_id AS "right",
    round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), 5) + 0.0 AS distance
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id""")  # fmt: skip
def q_embedding_distance(spark, d):
    e = X.table(spark, d, "embeddings")
    units = e.select(
        F.lit("all").alias("region"), F.col("label").cast("string").alias("species"), F.col("vec_id").cast("string").alias("unit"), F.col("vec_id").alias("unit_ord"),
        F.lit(0).alias("row"), F.lit(0).alias("col"), F.col("embedding").cast("array<double>").alias("vector"),
    )
    m = _TableEmbedding(species=tuple(str(i) for i in range(10)))
    return m.distances(units, units).select("species", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"), tidy("distance", 5).alias("distance"))


@query(f"WITH {IBD} SELECT region, lft AS \"left\", rgt AS \"right\", round(s, 9) + 0.0 AS distance FROM ibd")
def q_ibd_distance(spark, d):
    return LINE.distances(X.cells(spark, d), X.units(spark, d)).select("region", "left", "right", tidy("distance", 9).alias("distance"))


@query("SELECT round(ln(1 + exp(c_acctbal / 1000)), 8) + 0.0 AS slope, round(c_acctbal / 1000, 5) + 0.0 AS back, c_custkey AS id FROM customer")
def q_softplus(spark, d):
    x = F.col("c_acctbal") / 1000
    return X.table(spark, d, "customer").select(tidy(C.softplus(x), 8).alias("slope"), tidy(C.inverse_softplus(C.softplus(x)), 5).alias("back"), F.col("c_custkey").alias("id"))


# --- losses and aggregates


def _log1p_rows(spark, d):
    off = F.log1p("distance") - F.log1p(ODDS.forward(F.col("value")))
    return _distances(spark, d).withColumn("sq", off * off)


@query(f"WITH {IBD} SELECT region, count(*) AS pairs, round(avg(power(ln(1 + s) - ln(1 + value / (1 - value)), 2)), 8) + 0.0 AS loss FROM ibd GROUP BY region")
def q_log1p_loss_by_region(spark, d):
    return T.group_losses(_distances(spark, d), ODDS).select("region", "pairs", tidy("loss", 8).alias("loss"))


@query(f"WITH {IBD}, l AS (SELECT region, avg(power(ln(1 + s) - ln(1 + value / (1 - value)), 2)) AS loss FROM ibd GROUP BY region) SELECT round(sum(loss / 5), 8) + 0.0 AS loss FROM l")
def q_log1p_loss_total(spark, d):
    losses = T.group_losses(_distances(spark, d), ODDS)
    w = T.loss_weights(losses.select("region", "species"))
    return A.join_groups(losses, w).agg(tidy(F.sum(F.col("weight") * F.col("loss")), 8).alias("loss"))


@query(f"WITH {IBD} SELECT lr % 2 AS species, round(avg(loss), 8) + 0.0 AS loss FROM (SELECT region, lr % 2 AS lr, avg(power(ln(1 + s) - ln(1 + value / (1 - value)), 2)) AS loss FROM (SELECT i.*, o.lr FROM ibd i JOIN obs o USING (region, lft, rgt)) GROUP BY 1, 2) GROUP BY 1")
def q_log1p_loss_by_species(spark, d):
    o = X.observations(spark, d).select("region", "left", "right", (F.col("left_row") % 2).alias("s"))
    return _log1p_rows(spark, d).join(o, ["region", "left", "right"]).groupBy("region", F.col("s").alias("species")).agg(F.avg("sq").alias("l")).groupBy("species").agg(tidy(F.avg("l"), 8).alias("loss"))


@query("""WITH g AS (SELECT DISTINCT r_name AS region, CAST(s_suppkey % 3 AS VARCHAR) AS species FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT region, species, 1.0 / ((SELECT count(DISTINCT species) FROM g) * count(*) OVER (PARTITION BY species))::DOUBLE AS weight FROM g""")  # fmt: skip
def q_loss_weights(spark, d):
    s = X.table(spark, d, "supplier").join(X.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return T.loss_weights(s.select(F.col("r_name").alias("region"), (F.col("s_suppkey") % 3).cast("string").alias("species")).distinct())


@query(f"WITH {IBD} SELECT region, round(sum(power(ln(1 + s) - ln(1 + value / (1 - value)), 2)), 8) + 0.0 AS total FROM ibd GROUP BY region")
def q_sum_over_pairs(spark, d):
    return _log1p_rows(spark, d).groupBy("region").agg(tidy(F.sum("sq"), 8).alias("total"))


@query(f"WITH {IBD} SELECT region, round(avg(s), 9) + 0.0 AS center, round(stddev_samp(s), 9) + 0.0 AS scale, count(*) AS pairs FROM ibd GROUP BY region")
def q_distance_moments(spark, d):
    return M.moments(_distances(spark, d)).select("region", tidy("center", 9).alias("center"), tidy("scale", 9).alias("scale"), "pairs")


@query(f"WITH {IBD} SELECT region, unit, round(sum(v), 8) + 0.0 AS total, count(*) AS degree FROM (SELECT region, lft AS unit, value AS v FROM ibd UNION ALL SELECT region, rgt, value FROM ibd) GROUP BY 1, 2")
def q_endpoint_sums(spark, d):
    return M.endpoint_table(X.observations(spark, d), ["value"]).select("region", "unit", tidy("value", 8).alias("total"), "degree")


@query(f"WITH {OBS} SELECT region, max(n) > 1 AS identifiable, max(n) AS degree, round(max(ln((0.01 / 2.220446049250313e-16 - 1) / (2 * n)) - 1024 * 2.220446049250313e-16), 6) + 0.0 AS ratio_limit FROM (SELECT region, unit, count(*) AS n FROM (SELECT region, lft AS unit FROM obs UNION ALL SELECT region, rgt FROM obs) GROUP BY 1, 2) GROUP BY 1")
def q_degree(spark, d):
    n = M.endpoint_table(X.observations(spark, d), []).groupBy("region").agg(F.max("degree").alias("degree"))
    limit = F.log((M.ROUNDOFF / M.EPS - 1) / (2 * F.col("degree"))) - 1024 * M.EPS
    return n.select("region", (F.col("degree") > 1).alias("identifiable"), "degree", tidy(limit).alias("ratio_limit"))


@query(f"WITH {OBS} SELECT region, round(greatest(var_samp(ln(1 + value)) * 0.25, 1e-9), 9) + 0.0 AS unit, round(greatest(var_samp(ln(1 + value)) * 0.5, 1e-9), 9) + 0.0 AS residual FROM obs GROUP BY region")
def q_variance_init(spark, d):
    return T.group_starts(X.observations(spark, d), _LOG1P).select("region", tidy("unit", 9).alias("unit"), tidy("residual", 9).alias("residual"))


@query(f"""WITH {IBD}, f AS (SELECT region, regr_slope(ln(1 + value), s) AS b, regr_intercept(ln(1 + value), s) AS a FROM ibd GROUP BY region)
    SELECT region, round(b, 8) + 0.0 AS slope, round(a, 8) + 0.0 AS intercept, round(var_samp(ln(1 + value) - a - b * s), 8) + 0.0 AS residual FROM ibd JOIN f USING (region) GROUP BY region, a, b""")  # fmt: skip
def q_ols_residual(spark, d):
    p = _mlpe_pairs(spark, d)
    f = p.groupBy("region").agg(F.regr_slope("target", "distance").alias("b"), F.regr_intercept("target", "distance").alias("a"))
    rest = F.var_samp(F.col("target") - F.col("a") - F.col("b") * F.col("distance"))
    return p.join(f, "region").groupBy("region", "a", "b").agg(rest.alias("v")).select("region", tidy("b", 8).alias("slope"), tidy("a", 8).alias("intercept"), tidy("v", 8).alias("residual"))


# --- likelihood in closed form


_Q = U / E


def _mlpe_sql(b0: str, b1: str, tail: str) -> str:
    cols = ("one", "x", "t")
    prod = [(p, q) for i, p in enumerate(cols) for q in cols[i:]]
    eff = ", ".join(f"{_Q} * (({c} - m{c}) / (1 + {_Q} * (n - 2)) + m{c} / (1 + {_Q} * (2 * n - 2))) AS {c}" for c in cols)
    inner = lambda by: ", ".join(f"sum({p} * {q}) / {by} AS {p}_{q}" for p, q in prod)
    both = ", ".join(f"a.{p}_{q} + b.{p}_{q} AS {p}_{q}" for p, q in prod)
    return f"""WITH {IBD}, mom AS (SELECT region, avg(s) AS center, stddev_samp(s) AS scale FROM ibd GROUP BY region),
        p AS (SELECT region, lft, rgt, 1.0::DOUBLE AS one, (s - center) / scale AS x, ln(1 + value) AS t FROM ibd JOIN mom USING (region)),
        ends AS (SELECT region, unit, sum(one) AS one, sum(x) AS x, sum(t) AS t FROM (SELECT region, lft AS unit, one, x, t FROM p UNION ALL SELECT region, rgt, one, x, t FROM p) GROUP BY 1, 2),
        k AS (SELECT *, count(*) OVER w AS n, avg(one) OVER w AS mone, avg(x) OVER w AS mx, avg(t) OVER w AS mt FROM ends WINDOW w AS (PARTITION BY region)),
        eff AS (SELECT region, unit, n, {eff} FROM k),
        rest AS (SELECT p.region, p.lft, p.rgt, p.one - a.one - b.one AS one, p.x - a.x - b.x AS x, p.t - a.t - b.t AS t FROM p
            JOIN eff a ON a.region = p.region AND a.unit = p.lft JOIN eff b ON b.region = p.region AND b.unit = p.rgt),
        ra AS (SELECT region, count(*) AS m, {inner(E)} FROM rest GROUP BY region), ea AS (SELECT region, count(*) AS n, {inner(U)} FROM eff GROUP BY region),
        s AS (SELECT a.region, m, n, {both} FROM ra a JOIN ea b USING (region)),
        beta AS (SELECT *, {b0} AS b0, {b1} AS b1 FROM s),
        fit AS (SELECT region, m, b0, b1, 0.5 * (m * {M.LOG_2PI} + m * {math.log(E)} + (n - 1) * ln(1 + {_Q} * (n - 2)) + ln(1 + {_Q} * (2 * n - 2))
            + t_t - 2 * (b0 * one_t + b1 * x_t) + b0 * b0 * one_one + 2 * b0 * b1 * one_x + b1 * b1 * x_x) AS nll FROM beta) {tail}"""


_DET = "(one_one * x_x - one_x * one_x)"
_BEST = (f"(one_t * x_x - x_t * one_x) / {_DET}", f"(x_t * one_one - one_t * one_x) / {_DET}")


@query(_mlpe_sql(*_BEST, "SELECT region, m AS pairs, round(nll, 6) + 0.0 AS nll, round(nll / m, 6) + 0.0 AS loss FROM fit"))
def q_mlpe_nll(spark, d):
    fit = M.nll_complete(_mlpe_pairs(spark, d), U, E)
    return fit.select("region", "pairs", tidy("nll").alias("nll"), tidy(F.col("nll") / F.col("pairs")).alias("loss"))


@query(_mlpe_sql(*_BEST, "SELECT region, round(nll, 6) + 0.0 AS nll, round(b0, 6) + 0.0 AS intercept, round(b1, 6) + 0.0 AS slope FROM fit"))
def q_mlpe_nll_kernel(spark, d):
    """The same likelihood by the general kernel."""
    return M.nll_at(_mlpe_pairs(spark, d), U, E).select("region", tidy("nll").alias("nll"), tidy("intercept").alias("intercept"), tidy("slope").alias("slope"))


@query(_mlpe_sql(*_BEST, "SELECT region, round(b0, 7) + 0.0 AS intercept, round(b1, 7) + 0.0 AS slope FROM fit"))
def q_mlpe_gls(spark, d):
    return M.nll_complete(_mlpe_pairs(spark, d), U, E).select("region", tidy("intercept", 7).alias("intercept"), tidy("slope", 7).alias("slope"))


@query(_mlpe_sql(*_BEST, "SELECT region, unit, round(t - b0 * one - b1 * x, 7) + 0.0 AS effect FROM eff JOIN fit USING (region)"))
def q_mlpe_effects(spark, d):
    return M.effects_complete(_mlpe_pairs(spark, d), U, E).select("region", "unit", tidy("mean", 7).alias("effect"))


@query(_mlpe_sql("0.3", "-0.1", "SELECT region, round(nll, 6) + 0.0 AS nll FROM fit"))
def q_mlpe_fixed_nll(spark, d):
    return M.nll_complete(_mlpe_pairs(spark, d), U, E, (0.3, -0.1)).select("region", tidy("nll").alias("nll"))


@query(f"WITH {OBS} SELECT DISTINCT region, 0.0::DOUBLE AS sum_w, 0.0::DOUBLE AS sum_wx FROM obs")
def q_mlpe_incomplete_orthogonality(spark, d):
    """Without one pair a region, the weighted residuals stay orthogonal to the design."""
    p = _mlpe_pairs(spark, d)
    first = p.groupBy("region").agg(F.min(F.struct("left", "right")).alias("gone"))
    some = p.join(first, "region").where(F.struct("left", "right") != F.col("gone"))
    return M.nll_at(some, U, E).select("region", tidy("sum_w").alias("sum_w"), tidy("sum_wx").alias("sum_wx"))


# --- heads and predictions


@query(f"WITH {IBD} SELECT region, lft AS \"left\", rgt AS \"right\", round(s / (1 + s), 8) + 0.0 AS value FROM ibd")
def q_direct_head(spark, d):
    p = K.direct(LINE.distances(X.cells(spark, d), X.units(spark, d)), ODDS)
    return p.select("region", "left", "right", tidy("value", 8).alias("value"))


def _calibrations(spark, d):
    """Calibrations at U and E, one a region, from closed forms and DataFrame operations."""
    p = _mlpe_pairs(spark, d)
    fit, mom = M.nll_complete(p, U, E), M.moments(p)
    eff = M.effects_complete(p, U, E).groupBy("region").agg(F.sort_array(F.collect_list(F.struct("unit", "mean"))).alias("e"), F.count(F.lit(1)).alias("n"))
    ratio = U / E
    a, b = 1 + ratio * (F.col("n") - 2), 1 + ratio * (2 * F.col("n") - 2)
    same = F.lit(U) * ((1 - 1 / F.col("n")) / a + 1 / F.col("n") / b)
    other = F.lit(U) * (-1 / F.col("n") / a + 1 / F.col("n") / b)
    ids = F.sequence(F.lit(1), F.col("n").cast("int"))
    cov = F.transform(ids, lambda i: F.transform(ids, lambda j: F.when(i == j, same).otherwise(other)))
    j = fit.join(mom.select("region", "center", "scale"), "region").join(eff, "region")
    return j.select(
        "region", F.lit(None).cast("string").alias("species"), F.col("center").alias("distance_center"), F.col("scale").alias("distance_scale"), "intercept", "slope",
        F.lit(U).alias("unit_variance"), F.lit(E).alias("residual_variance"), F.lit(0.0).alias("jitter"), F.col("e.unit").alias("population_ids"),
        F.col("e.mean").alias("effect_mean"), cov.alias("effect_covariance"),
    ).persist()


_LOG1P = TargetSpec("dissimilarity", transform="log1p")


@query(_mlpe_sql(*_BEST, "SELECT p.region, p.lft AS \"left\", p.rgt AS \"right\", round(exp(b0 + b1 * p.x) - 1, 7) + 0.0 AS value FROM p JOIN fit USING (region)"))
def q_marginal_prediction(spark, d):
    dist = LINE.distances(X.cells(spark, d), X.units(spark, d))
    return K.marginal(dist, _calibrations(spark, d), _LOG1P).select("region", "left", "right", tidy("value", 7).alias("value"))


@query(_mlpe_sql(*_BEST, f"""SELECT p.region, p.lft AS "left", p.rgt AS "right", round(exp(b0 + b1 * p.x + a.t - b0 * a.one - b1 * a.x + b.t - b0 * b.one - b1 * b.x) - 1, 7) + 0.0 AS value,
    round(2 * {U} * ((1 - 1.0 / a.n) / (1 + {_Q} * (a.n - 2)) + 1.0 / a.n / (1 + {_Q} * (2 * a.n - 2)) - 1.0 / a.n / (1 + {_Q} * (a.n - 2)) + 1.0 / a.n / (1 + {_Q} * (2 * a.n - 2))), 7) + 0.0 AS effect_variance
    FROM p JOIN fit USING (region) JOIN eff a ON a.region = p.region AND a.unit = p.lft JOIN eff b ON b.region = p.region AND b.unit = p.rgt"""))  # fmt: skip
def q_saved_effects(spark, d):
    dist = LINE.distances(X.cells(spark, d), X.units(spark, d))
    return K.with_effects(dist, _calibrations(spark, d), _LOG1P).select("region", "left", "right", tidy("value", 7).alias("value"), tidy("effect_variance", 7).alias("effect_variance"))


@query(_mlpe_sql(*_BEST, f"""SELECT e.region, e.unit AS "left", 'newcomer' AS "right", round(exp(b0 + b1 * (1.5 - center) / scale + e.t - b0 * e.one - b1 * e.x) - 1, 7) + 0.0 AS value,
    round({U} + {U} * ((1 - 1.0 / e.n) / (1 + {_Q} * (e.n - 2)) + 1.0 / e.n / (1 + {_Q} * (2 * e.n - 2))), 7) + 0.0 AS effect_variance
    FROM eff e JOIN fit USING (region) JOIN mom USING (region)"""))  # fmt: skip
def q_new_unit_effects(spark, d):
    """Every unit with one that no calibration knows: its effect is 0, with the unit variance."""
    u = X.units(spark, d)
    pairs = u.select("region", "species", F.col("unit").alias("left"), F.lit("newcomer").alias("right"), F.lit(1.5).alias("distance"))
    return K.with_effects(pairs, _calibrations(spark, d), _LOG1P).select("region", "left", "right", tidy("value", 7).alias("value"), tidy("effect_variance", 7).alias("effect_variance"))


@query(f"""WITH {OBS} SELECT a.region, a.unit AS "left", b.unit AS "right", round(o.value, 8) + 0.0 AS value, o.value IS NULL AS missing
    FROM units a JOIN units b ON a.region = b.region LEFT JOIN obs o ON o.region = a.region AND o.value < 0.5 AND ((o.lft = a.unit AND o.rgt = b.unit) OR (o.rgt = a.unit AND o.lft = b.unit))""")  # fmt: skip
def q_as_matrix(spark, d):
    m = K.as_matrix(X.observations(spark, d).where("value < 0.5"), X.units(spark, d))
    return m.select("region", "left", "right", F.when(~F.isnan("value"), tidy("value", 8)).alias("value"), F.isnan("value").alias("missing"))


@query()
def q_support_conditioning(spark, d):
    """The last two units of each region predicted after pairs with the others were seen; no SQL."""
    o = X.observations(spark, d)
    last = o.groupBy("region").agg(F.max("right_ord").alias("top"))
    o = o.join(last, "region")
    ask = o.where("right_ord = top").drop("top")
    seen = o.where("right_ord < top and left_row < right_row").drop("top")
    d_ask, d_seen = (LINE.distances(X.cells(spark, d), X.units(spark, d), p) for p in (ask, seen))
    given = d_seen.join(seen.select("region", "left", "right", "value"), ["region", "left", "right"])
    return K.given_support(d_ask, given, _calibrations(spark, d), _LOG1P).select("region", "left", "right", tidy("value").alias("value"), tidy("effect_variance").alias("effect_variance"))


@query(f"WITH {OBS} SELECT DISTINCT region, true AS stationary, CAST(10 AS BIGINT) AS pairs FROM obs")
def q_fit_calibration_stationary(spark, d):
    """Every region's fit beats the likelihood at fixed variances and says it is stationary."""
    p = _mlpe_pairs(spark, d)
    fit = M.fit_mlpe(p).select("region", "ml_log_likelihood", "converged", "pairs")
    at = M.nll_complete(p, U, E).select("region", "nll")
    return fit.join(at, "region").select("region", (F.col("converged") & (F.col("ml_log_likelihood") >= -F.col("nll"))).alias("stationary"), "pairs")


# --- training


@query(f"""WITH {IBD}, g AS (SELECT range + 1 AS g, exp(ln(0.01) + (range + 1) * (ln(1000) - ln(0.01)) / 257) AS c FROM range(256))
    SELECT CAST(g AS INTEGER) AS g, round(min(c), 6) + 0.0 AS conductance, round(sum(0.02 * power(ln(1 + s / c) - ln(1 + value), 2)), 8) + 0.0 AS loss FROM ibd, g GROUP BY g""")  # fmt: skip
def q_uniform_grid_search(spark, d):
    u = _distances(spark, d).select(F.col("distance").alias("resistance"), F.col("value").alias("target"), F.lit(0.02).alias("weight"))
    return T.uniform_grid(u, 0.01, 1000.0).select("g", tidy("conductance").alias("conductance"), tidy("loss", 8).alias("loss"))


@query(f"""WITH {IBD}, g AS (SELECT range + 1 AS g, exp(ln(0.01) + (range + 1) * (ln(1000) - ln(0.01)) / 257) AS c FROM range(256)),
    l AS (SELECT g, min(c) AS conductance, sum(0.02 * power(ln(1 + s / c) - ln(1 + value), 2)) AS loss FROM ibd, g GROUP BY g)
    SELECT CAST(g AS INTEGER) AS g, round(conductance, 6) + 0.0 AS conductance, round(loss, 8) + 0.0 AS loss FROM l ORDER BY l.loss, g LIMIT 1""")  # fmt: skip
def q_uniform_best(spark, d):
    u = _distances(spark, d).select(F.col("distance").alias("resistance"), F.col("value").alias("target"), F.lit(0.02).alias("weight"))
    return T.grid_minimum(T.uniform_grid(u, 0.01, 1000.0)).select("g", tidy("conductance").alias("conductance"), tidy("loss", 8).alias("loss"))


@query(f"WITH {_PRED} SELECT round(sum(power(eta - 0.5, 2) / (2 * 0.3 * 0.3)), 6) + 0.0 AS penalty FROM pred")
def q_ridge_penalty(spark, d):
    """The penalty on the predictors of the 64 vertices, taken as parameters, and its gradient's sum."""
    p = np.array([r.predictor for r in LOGLINEAR.predictor(X.cells(spark, d)).collect()])  # 64 rows
    value, _ = T.ridge({"eta": 0.5}, 0.3, where="eta")({"eta": p, "other": np.ones(3)})
    return spark.createDataFrame([(round(value, 6),)], "penalty double")


@query("""WITH h AS (SELECT CAST(event_id % 50 AS INTEGER) AS step, user_id % 7 AS run, round(avg(value), 2) AS loss FROM events GROUP BY 1, 2)
    SELECT run, min(step) AS step, loss FROM h WHERE (run, loss) IN (SELECT (run, min(loss)) FROM h GROUP BY run) GROUP BY run, loss""")  # fmt: skip
def q_model_selection(spark, d):
    """The first step with the lowest loss of each run."""
    h = X.table(spark, d, "events").groupBy((F.col("event_id") % 50).cast("int").alias("step"), (F.col("user_id") % 7).alias("run")).agg(F.round(F.avg("value"), 2).alias("loss"))
    return T.selected_steps(h)


@query(f"""WITH {IBD}, l AS (SELECT region, avg(power(ln(1 + s) - ln(1 + value), 2)) AS loss FROM ibd GROUP BY region)
    SELECT 'all' AS scope, NULL AS key, round(avg(loss), 8) + 0.0 AS loss FROM l UNION ALL SELECT 'region', region, round(loss, 8) + 0.0 FROM l""")  # fmt: skip
def q_history_rollup(spark, d):
    losses = T.group_losses(_distances(spark, d), PLAIN).select("region", "species", "loss")
    return T.history_rows(losses).select("scope", "key", tidy("loss", 8).alias("loss"))


@query("SELECT 'study' AS region, true AS improved, CAST(4 AS INTEGER) AS evaluations")
def q_train_improves(spark, d):
    """Six updates of a log-linear model over all units lower its loss."""
    u = X.study_units(spark, d)
    o = A.unit_pairs(u)
    for side in ("left", "right"):
        own = u.select(F.col("unit").alias("_u"), F.col("bal").alias(f"_{side}"))
        o = o.join(own, o[side] == own["_u"]).drop("_u")
    o = o.withColumn("value", F.abs(F.col("_left") - F.col("_right")) / (F.abs("_left") + F.abs("_right") + 1)).drop("_left", "_right")
    config = T.TrainingConfig(steps=6, eval_every=2, optimizer=T.Adam(0.05))
    _, state = T.train(X.cells(spark, d), o, LOGLINEAR, PLAIN, config)
    losses = [v for _, split, scope, _, v in state.history if split == "train" and scope == "all"]
    return spark.createDataFrame([("study", losses[-1] < losses[0], len(losses))], "region string, improved boolean, evaluations int")


# --- ensembles, metrics, hold-outs


_MEMBERS = f"""{IBD}, pred AS (SELECT region, lft, rgt, value AS observed, CAST(k AS INTEGER) AS member, s * (1 + 0.25 * k) AS v FROM ibd, (SELECT unnest([0, 1, 2]) AS k))"""


def _members(spark, d):
    return _distances(spark, d).withColumn("member", F.explode(F.array(*map(F.lit, range(3))))).withColumn("v", F.col("distance") * (1 + 0.25 * F.col("member")))


@query(f"WITH {_MEMBERS} SELECT region, lft AS \"left\", rgt AS \"right\", round(sum(v / 3), 8) + 0.0 AS value, round(stddev_pop(v), 8) + 0.0 AS spread FROM pred GROUP BY 1, 2, 3")
def q_ensemble_mean(spark, d):
    p = _members(spark, d).select("region", "species", "left", "right", F.col("v").alias("value"))
    return K.member_mean(p, 3).select("region", "left", "right", tidy("value", 8).alias("value"), tidy("spread", 8).alias("spread"))


@query(f"WITH {VERTS} SELECT CAST(vr AS INTEGER) AS row, round(quantile_cont(g, 0.5), 8) + 0.0 AS median, round(quantile_cont(g, 0.75) - quantile_cont(g, 0.25), 8) + 0.0 AS iqr FROM verts GROUP BY 1")
def q_surface_median_iqr(spark, d):
    return K.member_quantiles(X.vertices(spark, d), ["row"]).select("row", tidy("median", 8).alias("median"), tidy("iqr", 8).alias("iqr"))


@query(f"""WITH {_MEMBERS} SELECT member, round(corr(observed, v), 7) + 0.0 AS pearson_r, round(1 - sum(power(observed - v, 2)) / (var_pop(observed) * count(*)), 6) + 0.0 AS r2,
    round(sqrt(avg(power(observed - v, 2))), 8) + 0.0 AS rmse FROM pred GROUP BY member""")  # fmt: skip
def q_metrics(spark, d):
    p = _members(spark, d).select("member", F.col("value").alias("observed"), F.col("v").alias("predicted"))
    return K.scores(p, ["member"]).select("member", tidy("pearson_r", 7).alias("pearson_r"), tidy("r2").alias("r2"), tidy("rmse", 8).alias("rmse"))


@query(f"""WITH {OBS} SELECT o.region, o.lft AS "left", o.rgt AS "right", CASE WHEN a.ord % 4 = 0 OR b.ord % 4 = 0 THEN 'test' ELSE 'train' END AS split
    FROM obs o JOIN units a ON a.region = o.region AND a.unit = o.lft JOIN units b ON b.region = o.region AND b.unit = o.rgt""")  # fmt: skip
def q_holdout_split(spark, d):
    held = X.units(spark, d).where("unit_ord % 4 = 0").select("region", "unit")
    return K.split_by_units(X.observations(spark, d), held).select("region", "left", "right", "split")


# --- persistence, networks, diagnostics


def _again(spark: SparkSession, model: K.GeneticsModel, template: D.DistanceModel, name: str) -> K.GeneticsModel:
    """The model after a way through the shared folder, of which nothing stays."""
    with X.shared_folder(spark, name) as path:
        store.save_model(spark, f"{path}/model", model)
        back = store.load_model(spark, f"{path}/model", template)
        held = None if back.calibrations is None else spark.createDataFrame(back.calibrations.collect(), back.calibrations.schema)  # a row a region
    return K.GeneticsModel(back.distance, back.target, back.features, held)


@query(f"WITH {IBD} SELECT region, lft AS \"left\", rgt AS \"right\", round(s / (1 + s), 8) + 0.0 AS value FROM ibd")
def q_save_load_straight_line(spark, d):
    m = _again(spark, K.GeneticsModel(LINE, ODDS), D.StraightLine(), "line")
    p = m.predict(X.cells(spark, d), X.units(spark, d))
    return p.select("region", "left", "right", tidy("value", 8).alias("value"))


@query(f"WITH {_PRED} SELECT row, col, round(g, 8) + 0.0 AS conductance FROM cond")
def q_save_load_loglinear(spark, d):
    blank = D.LogLinear(patch_size=2, beta=((0.0, 0.0, 0.0),), bias=(0.0,), lowest=LOW, highest=HIGH)
    m = _again(spark, K.GeneticsModel(LOGLINEAR, _LOG1P, ("f0", "f1", "f2")), blank, "loglinear")
    return m.distance.conductance(X.cells(spark, d)).select("row", "col", tidy("conductance", 8).alias("conductance"))


@query(_mlpe_sql(*_BEST, "SELECT p.region, p.lft AS \"left\", p.rgt AS \"right\", round(exp(b0 + b1 * p.x) - 1, 7) + 0.0 AS value FROM p JOIN fit USING (region)"))
def q_save_load_calibrated(spark, d):
    m = _again(spark, K.GeneticsModel(LINE, _LOG1P, (), _calibrations(spark, d)), D.StraightLine(), "calibrated")
    return m.predict(X.cells(spark, d), X.units(spark, d)).select("region", "left", "right", tidy("value", 7).alias("value"))


@query(f"WITH {CELLS} SELECT CAST(floor(r / 4) AS INTEGER) AS row, CAST(floor(c / 4) AS INTEGER) AS col, true AS positive FROM cells GROUP BY 1, 2")
def q_resnet_surface(spark, d):
    from gridkin.operators.networks import ResNet9

    net = ResNet9.random(3, (8, 16, 32), seed=1)
    m = D.NetworkConductance(patch_size=4, encoder=net, head=(tuple([0.1] * 32),), bias=(0.2,))
    return m.conductance(X.cells(spark, d)).select("row", "col", (F.col("conductance") > 0).alias("positive"))


@query(f"WITH {UNITS} SELECT unit, CAST(6 AS INTEGER) AS width FROM units")
def q_unet_embedding(spark, d):
    from gridkin.operators.networks import UNet, UNetEmbedding

    m = UNetEmbedding(patch_size=2, network=UNet.random(3, 2, 8, 6, seed=2))
    return m.embedding(X.cells(spark, d), X.study_units(spark, d)).select("unit", F.size("vector").alias("width"))


@query("""WITH a AS (SELECT CAST(n_nationkey AS INTEGER) AS i, ln(2 + n_nationkey) AS v FROM nation), d AS (SELECT x.i, y.i AS j, power(x.v - y.v, 2) AS d FROM a x, a y),
    m AS (SELECT i, avg(d) AS r FROM d GROUP BY i) SELECT d.i, d.j, round(-0.5 * (d - p.r - q.r + (SELECT avg(d) FROM d)), 8) + 0.0 AS scatter FROM d JOIN m p ON p.i = d.i JOIN m q ON q.i = d.j""")  # fmt: skip
def q_wishart_scatter(spark, d):
    """The centered scatter of all nations' squared distances, from the contrasts."""
    from gridkin.operators.wishart import centered_scatter

    a = X.table(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("i"), F.log(2.0 + F.col("n_nationkey")).alias("v"))
    b = a.select(F.col("i").alias("j"), F.col("v").alias("w"))
    pairs = a.join(F.broadcast(b)).select(F.lit("study").alias("region"), "i", "j", F.pow(F.col("v") - F.col("w"), 2).alias("d"))  # 625 rows
    return centered_scatter(pairs).select("i", "j", tidy("scatter", 8).alias("scatter"))


@query()
def q_wishart_density(spark, d):
    """Log density of the scatter of the labels' mean vectors under equal variances; no SQL."""
    from gridkin.operators.wishart import log_likelihoods

    e = X.table(spark, d, "embeddings").select(F.col("label").alias("i"), F.posexplode("embedding").alias("k", "x")).groupBy("i", "k").agg(F.avg("x").alias("x"))
    f = e.select(F.col("i").alias("j"), "k", F.col("x").alias("y"))
    p = e.join(f, "k").where("i < j").groupBy("i", "j").agg(F.sum(F.pow(F.col("x") - F.col("y"), 2)).alias("d")).select(F.lit("all").alias("region"), "i", "j", "d")
    return log_likelihoods(p, markers=64, variance=0.001).select("region", "units", tidy("log_likelihood").alias("log_likelihood"))


# --- sources


@query(f"""WITH {UNITS} SELECT a.region, a.unit AS "left", b.unit AS "right", round(abs(a.bal - b.bal) / (abs(a.bal) + abs(b.bal) + 1), 9) + 0.0 AS value
    FROM units a JOIN units b ON a.region = b.region AND a.unit < b.unit""")  # fmt: skip
def q_matrix_observations(spark, d):
    """Each region's dissimilarities as a matrix with a column for each unit, and back."""
    o, out = X.observations(spark, d).select("region", "left", "right", "value"), None
    both = o.union(o.select("region", F.col("right").alias("left"), F.col("left").alias("right"), "value"))
    for region in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"):
        wide = both.where(F.col("region") == region).groupBy("left").pivot("right").agg(F.first("value"))
        part = A.observed_pairs(S.matrix_observations(wide, "left", region=region))
        out = part if out is None else out.unionByName(part)
    return out.select("region", "left", "right", tidy("value", 9).alias("value"))


@query("""WITH p AS (SELECT l_partkey % 30 AS r, l_orderkey % 30 AS c, max(l_linenumber) AS v FROM lineitem GROUP BY 1, 2)
    SELECT CAST(floor(r / 3) AS INTEGER) AS row, CAST(floor(c / 3) AS INTEGER) AS col, round(avg(CASE WHEN v IN (1, 2, 3) THEN 1 ELSE 0 END), 8) + 0.0 AS few,
        round(avg(CASE WHEN v IN (4, 7) THEN 1 ELSE 0 END), 8) + 0.0 AS some FROM p WHERE r < 24 AND c < 24 GROUP BY 1, 2""")  # fmt: skip
def q_class_shares(spark, d):
    """Classes of a 30 x 30 raster of codes, 3 x 3 to a cell, 4 x 4 cells to a patch: two rows and columns of cells fill none."""
    row, col = (F.col("l_partkey") % 30).cast("int"), (F.col("l_orderkey") % 30).cast("int")
    codes = X.table(spark, d, "lineitem").groupBy(row.alias("row"), col.alias("col")).agg(F.max("l_linenumber").alias("value"))
    full = spark.range(900).select(F.lit("study").alias("region"), (F.col("id") % 30).cast("int").alias("row"), F.floor(F.col("id") / 30).cast("int").alias("col"))
    out = S.class_shares(full.join(codes, ["row", "col"]), {"few": [1, 2, 3], "some": [4, 7]}, 3, 4)
    return out.select("row", "col", tidy(F.get("features", F.lit(0)), 8).alias("few"), tidy(F.get("features", F.lit(1)), 8).alias("some"))


@query("""SELECT n_name AS unit, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INTEGER) AS unit_ord, CAST(n_nationkey * 6 AS DOUBLE) AS x, CAST((n_nationkey * 37) % 150 AS DOUBLE) AS y FROM nation""")
def q_read_sites(spark, d):
    sites = X.table(spark, d, "nation").select(F.col("n_name").alias("site"), (F.col("n_nationkey") * 6.0).alias("x"), ((F.col("n_nationkey") * 37) % 150).cast("double").alias("y"))
    with X.shared_folder(spark, "sites") as path:
        sites.write.csv(f"{path}/csv", header=True)
        rows = S.read_sites(spark, f"{path}/csv", "study").collect()  # a study's sites
    return spark.createDataFrame(rows, "region string, species string, unit string, x double, y double, unit_ord int").select("unit", "unit_ord", "x", "y")


@query(f"""WITH {UNITS} SELECT a.unit AS "left", b.unit AS "right", round(abs(a.bal - b.bal) / (abs(a.bal) + abs(b.bal) + 1), 6) + 0.0 AS value FROM units a JOIN units b ON a.unit < b.unit""")
def q_read_matrix(spark, d):
    """All units' dissimilarities, through a CSV matrix."""
    u = X.study_units(spark, d).select("region", "unit", "bal")
    both = u.join(u.select("region", F.col("unit").alias("other"), F.col("bal").alias("b")), "region")
    value = F.abs(F.col("bal") - F.col("b")) / (F.abs("bal") + F.abs("b") + 1)
    wide = both.withColumn("v", value).groupBy(F.col("unit").alias("site")).pivot("other").agg(F.first("v"))
    with X.shared_folder(spark, "matrix") as path:
        wide.coalesce(1).write.csv(f"{path}/csv", header=True)
        rows = A.observed_pairs(S.read_matrix(spark, f"{path}/csv", "study")).select("left", "right", tidy("value").alias("value")).collect()  # 300 pairs
    return spark.createDataFrame(rows, "left string, right string, value double")


@query(f"WITH {_PRED} SELECT 'study' AS region, row, col, round(g, 8) + 0.0 AS conductance FROM cond")
def q_surface_export(spark, d):
    with X.shared_folder(spark, "surface") as path:
        S.write_surface(LOGLINEAR.conductance(X.cells(spark, d)), f"{path}/surface")
        rows = spark.read.parquet(f"{path}/surface").select("region", "row", "col", tidy("conductance", 8).alias("conductance")).collect()  # 64 vertices
    return spark.createDataFrame(rows, "region string, row int, col int, conductance double")


@query("""SELECT n_name AS unit, n_nationkey AS unit_ord, CAST(floor(((n_nationkey * 37) % 150) / 10) AS INTEGER) AS row, CAST(floor(n_nationkey * 6 / 10) AS INTEGER) AS col FROM nation""")
def q_located_units(spark, d):
    k = F.col("n_nationkey")
    points = X.table(spark, d, "nation").select(
        F.lit("study").alias("region"), F.lit(None).cast("string").alias("species"), F.col("n_name").alias("unit"), k.alias("unit_ord"), (k * 6.0).alias("x"), ((k * 37) % 150).cast("double").alias("y")
    )
    return S.located_units(points, _ticks(spark, "regular")).select("unit", "unit_ord", "row", "col")


@query(f"""WITH {OBS} SELECT o.region, o.lft AS "left", o.rgt AS "right", a.ord AS left_ord, b.ord AS right_ord, lr AS left_row, rc AS right_col, round(value, 9) + 0.0 AS value
    FROM obs o JOIN units a ON a.region = o.region AND a.unit = o.lft JOIN units b ON b.region = o.region AND b.unit = o.rgt""")  # fmt: skip
def q_align_observations(spark, d):
    """Pairs given the wrong way round, aligned with their units."""
    turned = X.observations(spark, d).select("region", "species", F.col("right").alias("left"), F.col("left").alias("right"), "value")
    out = A.align_observations(turned, X.units(spark, d))
    return out.select("region", "left", "right", "left_ord", "right_ord", "left_row", "right_col", tidy("value", 9).alias("value"))


@query("""WITH a AS (SELECT DISTINCT c_mktsegment AS k FROM customer UNION SELECT r_name FROM region), b AS (SELECT r_name AS k FROM region UNION SELECT DISTINCT o_orderpriority FROM orders)
    SELECT coalesce(a.k, b.k) AS region, a.k IS NOT NULL AS has_raster, b.k IS NOT NULL AS has_pairs FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")  # fmt: skip
def q_unmatched_regions(spark, d):
    name = lambda t, c: X.table(spark, d, t).select(F.col(c).alias("region"))
    out = A.unmatched_regions(name("customer", "c_mktsegment").union(name("region", "r_name")), name("region", "r_name").union(name("orders", "o_orderpriority")))
    return out.select("region", F.coalesce("has_raster", F.lit(False)).alias("has_raster"), F.coalesce("has_pairs", F.lit(False)).alias("has_pairs"))


@query("SELECT c_mktsegment AS label, min(c_custkey) AS ord FROM customer GROUP BY 1")
def q_first_seen(spark, d):
    return A.first_seen(X.table(spark, d, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("ord")))


@query("SELECT n_name AS label, CAST(ntile(3) OVER (ORDER BY md5('7|' || n_name), n_name) - 1 AS INTEGER) AS fold FROM nation")
def q_folds(spark, d):
    return A.folds(X.table(spark, d, "nation").select(F.col("n_name").alias("label")), 3, seed=7)


@query(f"""WITH {UNITS}, bad AS (SELECT region, unit, r, c FROM units UNION ALL SELECT region, unit, r, c FROM units WHERE bal > 4500)
    SELECT 'unit names are unique in a species' AS rule, region || ', ' || unit AS detail FROM bad GROUP BY region, unit HAVING count(*) > 1
    UNION ALL SELECT 'units lie in the raster', region || ', ' || unit FROM bad WHERE r >= 10 OR c >= 12""")  # fmt: skip
def q_unit_rules(spark, d):
    """Violations of units some of which stand twice, in a raster of 10 x 12 cells."""
    from gridkin.operators.constraints import unit_rules, violations

    u = X.units(spark, d)
    regions = u.select("region", F.lit(10).alias("n_rows"), F.lit(12).alias("n_cols")).distinct()
    return violations(unit_rules(u.union(u.where("bal > 4500")), regions))


# --- models of several species, of a user's own, and what they refuse


def _species_units(spark, d):
    """The study's units, of two species by their order."""
    return X.study_units(spark, d).withColumn("species", F.when(F.col("unit_ord") % 2 == 0, "even").otherwise("odd"))


@query(f"""WITH {UNITS} SELECT CASE WHEN a.ord % 2 = 0 THEN 'even' ELSE 'odd' END AS species, a.unit AS "left", b.unit AS "right",
    round(CASE WHEN a.ord % 2 = 0 THEN 0.1 ELSE 0.4 END * sqrt(power(floor(a.r / 2) - floor(b.r / 2), 2) + power(floor(a.c / 2) - floor(b.c / 2), 2)) + CASE WHEN a.ord % 2 = 0 THEN 0.03 ELSE 0.0 END, 8) + 0.0 AS value
    FROM units a JOIN units b ON a.ord < b.ord AND a.ord % 2 = b.ord % 2 WHERE a.ord % 2 = 0 OR (a.r < b.r)""")  # fmt: skip
def q_species_query(spark, d):
    """All pairs of one species, and those of the other that are named."""
    u = _species_units(spark, d)
    m = K.GeneticsModel(D.StraightLine(species=("even", "odd"), patch_size=2, slope=(0.1, 0.4), intercept=(0.03, 0.0)), PLAIN)
    named = A.unit_pairs(u.where("species = 'odd'")).where("left_row < right_row").select("region", "left", "right")
    p = m.predict(X.cells(spark, d), u, {"even": None, "odd": named})
    return p.select("species", "left", "right", tidy("value", 8).alias("value"))


@query(f"""WITH {UNITS} SELECT CASE WHEN a.ord % 2 = 0 THEN 'even' ELSE 'odd' END AS species, a.unit AS "left", b.unit AS "right",
    CAST((abs(a.r - b.r) + abs(a.c - b.c)) * CASE WHEN a.ord % 2 = 0 THEN 1 ELSE 3 END AS DOUBLE) AS distance FROM units a JOIN units b ON a.ord < b.ord AND a.ord % 2 = b.ord % 2""")  # fmt: skip
def q_custom_model(spark, d):
    m = _Blocks(species=("even", "odd"), factor=(1.0, 3.0))
    return m.distances(X.cells(spark, d), _species_units(spark, d)).select("species", "left", "right", "distance")


@query(f"""WITH {UNITS}, t AS (SELECT DISTINCT floor(r / 2) AS r, floor(c / 2) AS c FROM units)
    SELECT a.unit AS "left", b.unit AS "right", abs(floor(a.r / 2) - floor(b.r / 2)) * 10 + abs(floor(a.c / 2) - floor(b.c / 2)) AS distance FROM units a JOIN units b ON a.ord < b.ord""")
def q_custom_solver(spark, d):
    """A solver of a user's own in a log-linear model."""

    def steps(surface, nodes):
        return np.abs(nodes[:, None, 0] - nodes[None, :, 0]) * 10.0 + np.abs(nodes[:, None, 1] - nodes[None, :, 1])

    m = D.LogLinear(patch_size=2, beta=(BETA,), bias=(BIAS,), lowest=LOW, highest=HIGH, solver=steps)
    return m.distances(X.cells(spark, d), X.study_units(spark, d)).select("left", "right", "distance")


@query(f"WITH {CELLS} SELECT CAST(floor(r / 2) AS INTEGER) AS row, CAST(floor(c / 2) AS INTEGER) AS col, CAST((r % 2) * 2 + c % 2 AS INTEGER) AS place, round(f0, 9) + 0.0 AS f0, round(f2, 9) + 0.0 AS f2 FROM cells")
def q_patchify(spark, d):
    """The cells of each patch in row-major order."""
    each = D.patches(X.cells(spark, d), 2).select("row", "col", F.posexplode("cells").alias("place", "cell"))
    f = lambda i: tidy(F.get("cell.features", F.lit(i)), 9)
    return each.select("row", "col", "place", f(0).alias("f0"), f(2).alias("f2"))


def _mean_encoder(x):
    """(patches, features, size, size) -> the mean of each feature."""
    return np.asarray(x, float).mean((2, 3))


@query(f"""WITH {CELLS}, m AS (SELECT CAST(floor(r / 2) AS INTEGER) AS row, CAST(floor(c / 2) AS INTEGER) AS col, avg(f0::FLOAT::DOUBLE) AS a, avg(f2::FLOAT::DOUBLE) AS b FROM cells GROUP BY 1, 2)
    SELECT 'x' AS species, row, col, round(ln(1 + exp(a * 3 - b * 2 + 0.1)) + 1e-6, 6) + 0.0 AS conductance FROM m UNION ALL SELECT 'y', row, col, round(ln(1 + exp(b * 4 - 0.2)) + 1e-6, 6) + 0.0 FROM m""")  # fmt: skip
def q_patch_encoding(spark, d):
    """An encoder over Arrow batches of patches, and a head for each of two species."""
    m = D.NetworkConductance(species=("x", "y"), patch_size=2, encoder=_mean_encoder, head=((3.0, 0.0, -2.0), (0.0, 0.0, 4.0)), bias=(0.1, -0.2))
    return m.conductance(X.cells(spark, d)).select("species", "row", "col", tidy("conductance").alias("conductance"))


@query(f"WITH {_MEMBERS} SELECT region, lft AS \"left\", rgt AS \"right\", round(sum(v / 3), 8) + 0.0 AS value FROM pred GROUP BY 1, 2, 3")
def q_ensemble_predict(spark, d):
    """Three straight-line models, asked together."""
    members = tuple(K.GeneticsModel(D.StraightLine(patch_size=2, slope=(0.1 * k,), intercept=(0.03 * k,)), PLAIN) for k in (1.0, 1.25, 1.5))
    p = K.Ensemble(members).predict(X.cells(spark, d), X.units(spark, d))
    return p.select("region", "left", "right", tidy("value", 8).alias("value"))


@query(f"""WITH {_MEMBERS}, f AS (SELECT member, corr(observed, v) AS p, 1 - sum(power(observed - v, 2)) / (var_pop(observed) * count(*)) AS q, sqrt(avg(power(observed - v, 2))) AS e FROM pred GROUP BY member)
    SELECT 'pearson_r' AS score, round(avg(p), 6) + 0.0 AS mean, round(stddev_samp(p), 6) + 0.0 AS deviation FROM f
    UNION ALL SELECT 'r2', round(avg(q), 6) + 0.0, round(stddev_samp(q), 6) + 0.0 FROM f UNION ALL SELECT 'rmse', round(avg(e), 6) + 0.0, round(stddev_samp(e), 6) + 0.0 FROM f""")  # fmt: skip
def q_score_summary(spark, d):
    p = _members(spark, d).select("member", F.col("value").alias("observed"), F.col("v").alias("predicted"))
    return K.score_summary(K.scores(p, ["member"])).select("score", tidy("mean").alias("mean"), tidy("deviation").alias("deviation"))


# --- solvers


@query(_CHAIN)
def q_resistance_cg_chain(spark, d):
    """The raster of one row by conjugate gradients."""
    v = _chain(spark, d)
    r = resistances(v, v.select("region", F.col("row").alias("vr"), F.col("col").alias("vc")), solver="cg")
    return r.select(F.col("c1").alias("a"), F.col("c2").alias("b"), tidy("resistance", 4).alias("resistance"))


@query(_CHAIN)
def q_resistance_dense_chain(spark, d):
    """And by the pseudo-inverse."""
    v = _chain(spark, d)
    r = resistances(v, v.select("region", F.col("row").alias("vr"), F.col("col").alias("vc")), solver="dense")
    return r.select(F.col("c1").alias("a"), F.col("c2").alias("b"), tidy("resistance", 4).alias("resistance"))


@query("""WITH s AS (SELECT r_name AS region, 6 + 3 * r_regionkey AS n FROM region), c AS (SELECT region, CAST(unnest(range(n)) AS INTEGER) AS k FROM s)
    SELECT a.region, a.k AS a, b.k AS b, CAST(b.k - a.k AS DOUBLE) AS resistance FROM c a JOIN c b ON a.region = b.region AND a.k < b.k""")  # fmt: skip
def q_unit_resistances(spark, d):
    """Rasters of one row, of a length for each region, at a conductance of 1."""
    shapes = X.table(spark, d, "region").select(F.col("r_name").alias("region"), F.lit(1).alias("n_rows"), (6 + 3 * F.col("r_regionkey")).cast("int").alias("n_cols"))
    ends = shapes.select("region", F.lit(0).alias("vr"), F.explode(F.sequence(F.lit(0), F.col("n_cols") - 1)).alias("vc"))
    return unit_resistances(shapes, ends).select("region", F.col("c1").alias("a"), F.col("c2").alias("b"), tidy("resistance").alias("resistance"))


# --- training, one step at a time


_STEP = """l AS (SELECT region, value AS v, sqrt(power(floor(lr / 2) - floor(rr / 2), 2) + power(floor(lc / 2) - floor(rc / 2), 2)) AS x FROM obs),
    p AS (SELECT region, x, v, 0.1::DOUBLE * x + 0.03::DOUBLE AS s FROM l), e AS (SELECT region, x, 2 * (ln(1 + s) - ln(1 + v)) / (1 + s) AS g FROM p),
    r AS (SELECT region, avg(g * x) AS a, avg(g) AS b FROM e GROUP BY region), t AS (SELECT sum(a) / count(*) AS a, sum(b) / count(*) AS b FROM r)"""


def _raster_for_all(spark, d):
    """The raster under each region's name."""
    regions = F.explode(F.array(*map(F.lit, ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"))))
    return X.cells(spark, d).select(regions.alias("region"), "row", "col", "features")


def _line_step(spark, d, optimizer, **more):
    config = T.TrainingConfig(steps=1, eval_every=1, optimizer=optimizer, **more)
    m, _ = T.train(_raster_for_all(spark, d), X.observations(spark, d), LINE, PLAIN, config)
    return spark.createDataFrame([(round(m.slope[0], 7), round(m.intercept[0], 7))], "slope double, intercept double")


@query(f"WITH {OBS}, {_STEP} SELECT round(0.1 - 0.005 * a, 7) + 0.0 AS slope, round(0.03 - 0.005 * b, 7) + 0.0 AS intercept FROM t")
def q_train_line_descent(spark, d):
    """One update of a straight-line model by gradient descent."""
    return _line_step(spark, d, T.Descent(0.005))


@query(f"WITH {OBS}, {_STEP} SELECT round(0.1 - 0.05 * (a / (abs(a) + 1e-8) + 0.01 * 0.1), 7) + 0.0 AS slope, round(0.03 - 0.05 * (b / (abs(b) + 1e-8) + 0.01 * 0.03), 7) + 0.0 AS intercept FROM t")
def q_train_line_adam(spark, d):
    """One update by Adam with decay: the first moves each parameter by the rate."""
    return _line_step(spark, d, T.Adam(0.05, decay=0.01))


@query(f"""WITH {OBS}, {_STEP} SELECT round(0.1 - 0.005 * (a + (0.1 - 0.5) / 0.09 / n), 7) + 0.0 AS slope, round(0.03 - 0.005 * b, 7) + 0.0 AS intercept FROM t, (SELECT count(*) AS n FROM obs)""")
def q_train_line_penalty(spark, d):
    """One update with a penalty on the slope, divided by the training pairs."""
    return _line_step(spark, d, T.Descent(0.005), penalty=T.ridge({"slope": 0.5}, 0.3, where="slope"))


@query(f"""WITH {IBD} SELECT region, round(avg(s), 8) + 0.0 AS center, round(stddev_samp(s), 8) + 0.0 AS scale, round(0.25 * var_samp(ln(1 + value)), 8) + 0.0 AS unit_variance,
    round(0.5 * var_samp(ln(1 + value)), 8) + 0.0 AS residual_variance, count(*) AS pairs, false AS converged, CAST(5 AS INTEGER) AS units FROM ibd GROUP BY region""")  # fmt: skip
def q_training_calibration(spark, d):
    """The calibrations that training with population effects leaves at its start."""
    o, u = X.observations(spark, d), X.units(spark, d)
    m, state = T.train(_raster_for_all(spark, d), o, LINE, _LOG1P, T.TrainingConfig(loss="mlpe", steps=0), units=u)
    c = T.trained(spark, m, state, _LOG1P, pairs=o).calibrations
    return c.select(
        "region", tidy("distance_center", 8).alias("center"), tidy("distance_scale", 8).alias("scale"), tidy("unit_variance", 8).alias("unit_variance"),
        tidy("residual_variance", 8).alias("residual_variance"), "pairs", "converged", F.size("population_ids").alias("units"),
    )


@query("""WITH v AS (SELECT avg(l_discount) * 10 AS t FROM lineitem) SELECT round(7 / t, 4) + 0.0 AS conductance FROM v""")
def q_uniform_start(spark, d):
    """Two units seven vertices apart: the best uniform conductance gives the measured value itself."""
    cells = spark.range(8).select(F.lit("row").alias("region"), F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.array(F.lit(0.5)).alias("features"))
    unit = lambda n, k: F.struct(F.lit("row").alias("region"), F.lit(None).cast("string").alias("species"), F.lit(n).alias("unit"), F.lit(k).alias("unit_ord"), F.lit(0).alias("row"), F.lit(7 * k).alias("col"))
    units = spark.range(1).select(F.inline(F.array(unit("a", 0), unit("b", 1))))
    value = X.table(spark, d, "lineitem").agg((F.avg("l_discount") * 10).alias("value")).withColumn("region", F.lit("row"))
    pair = A.unit_pairs(units).join(value, "region")
    start = T.initialize_uniform_conductance(D.LogLinear(beta=((1.0,),), bias=(9.0,), lowest=0.01, highest=1000.0), cells, units, pair, PLAIN)
    return start.conductance(cells).select(tidy("conductance", 4).alias("conductance")).distinct()


def _network(spark, d, model, steps):
    """Whether a few updates lower a network's loss, and by what it was trained."""
    u = X.study_units(spark, d)
    o = A.unit_pairs(u)
    for side in ("left", "right"):
        own = u.select(F.col("unit").alias("_u"), F.col("bal").alias(f"_{side}"))
        o = o.join(own, o[side] == own["_u"]).drop("_u")
    o = o.withColumn("value", F.abs(F.col("_left") - F.col("_right")) / (F.abs("_left") + F.abs("_right") + 1)).drop("_left", "_right")
    _, state = T.train(X.cells(spark, d), o, model, PLAIN, T.TrainingConfig(steps=steps, eval_every=steps, optimizer=T.Adam(0.01)))
    losses = [v for _, split, scope, _, v in state.history if split == "train" and scope == "all"]
    return spark.createDataFrame([(type(model).__name__, losses[-1] < losses[0])], "model string, improved boolean")


@query("SELECT 'NetworkConductance' AS model, true AS improved")
def q_train_resnet(spark, d):
    from gridkin.operators.networks import ResNet9

    return _network(spark, d, D.NetworkConductance(patch_size=4, encoder=ResNet9.random(3, (8, 8, 8), seed=1), head=(tuple([0.1] * 8),), bias=(0.2,)), 6)


@query("SELECT 'UNetEmbedding' AS model, true AS improved")
def q_train_unet(spark, d):
    from gridkin.operators.networks import UNet, UNetEmbedding

    return _network(spark, d, UNetEmbedding(patch_size=2, network=UNet.random(3, 2, 8, 6, seed=2)), 6)


def _stepped(n: int, slope: str, intercept: str) -> str:
    """SQL of the n-th update by gradient descent from these columns of the table before it."""
    at = "l" if n == 1 else f"l, u{n - 1}"
    return f"""g{n} AS (SELECT region, avg(2 * (ln(1 + {slope} * x + {intercept}) - ln(1 + v)) / (1 + {slope} * x + {intercept}) * x) AS a,
        avg(2 * (ln(1 + {slope} * x + {intercept}) - ln(1 + v)) / (1 + {slope} * x + {intercept})) AS b, any_value({slope}) AS s, any_value({intercept}) AS i FROM {at} GROUP BY region),
        u{n} AS (SELECT any_value(s) - 0.005 * avg(a) AS slope{n}, any_value(i) - 0.005 * avg(b) AS intercept{n} FROM g{n})"""


@query(f"""WITH {OBS}, l AS (SELECT region, value AS v, sqrt(power(floor(lr / 2) - floor(rr / 2), 2) + power(floor(lc / 2) - floor(rc / 2), 2)) AS x FROM obs),
    {_stepped(1, "0.1::DOUBLE", "0.03::DOUBLE")}, {_stepped(2, "slope1", "intercept1")} SELECT round(slope2, 7) + 0.0 AS slope, round(intercept2, 7) + 0.0 AS intercept FROM u2""")  # fmt: skip
def q_train_continued(spark, d):
    """An update, and another from where it ended."""
    how = lambda steps: T.TrainingConfig(steps=steps, eval_every=1, optimizer=_DESCENT)
    cells, o = _raster_for_all(spark, d), X.observations(spark, d)
    _, half = T.train(cells, o, LINE, PLAIN, how(1))
    m, _ = T.train(cells, o, LINE, PLAIN, how(2), state=half)
    return spark.createDataFrame([(round(m.slope[0], 7), round(m.intercept[0], 7))], "slope double, intercept double")


_DESCENT = T.Descent(0.005)


def _history_table(spark, rows):
    return spark.createDataFrame([(split, scope, key, round(v, 8)) for _, split, scope, key, v in rows], "split string, scope string, key string, loss double")


@query(f"""WITH {IBD}, s AS (SELECT i.*, o.rc % 2 = 0 AS held FROM ibd i JOIN obs o USING (region, lft, rgt)),
    l AS (SELECT CASE WHEN held THEN 'validation' ELSE 'train' END AS split, region, avg(power(ln(1 + s) - ln(1 + s.value), 2)) AS loss FROM s GROUP BY 1, 2)
    SELECT split, 'all' AS scope, NULL AS key, round(avg(loss), 8) + 0.0 AS loss FROM l GROUP BY 1 UNION ALL SELECT split, 'region', region, round(loss, 8) + 0.0 FROM l""")  # fmt: skip
def q_train_history(spark, d):
    """What training notes before its first update, of training and validation pairs."""
    o = X.observations(spark, d)
    _, state = T.train(_raster_for_all(spark, d), o.where("right_col % 2 = 1"), LINE, PLAIN, T.TrainingConfig(steps=0), validation=o.where("right_col % 2 = 0"))
    return _history_table(spark, state.history)


@query(f"""WITH {UNITS}, l AS (SELECT a.ord % 2 AS s, abs(a.bal - b.bal) / (abs(a.bal) + abs(b.bal) + 1) AS v, sqrt(power(floor(a.r / 2) - floor(b.r / 2), 2) + power(floor(a.c / 2) - floor(b.c / 2), 2)) AS x
    FROM units a JOIN units b ON a.ord < b.ord AND a.ord % 2 = b.ord % 2), p AS (SELECT *, CASE WHEN s = 0 THEN 0.1 ELSE 0.4 END::DOUBLE AS m, CASE WHEN s = 0 THEN 0.03 ELSE 0.0 END::DOUBLE AS k FROM l),
    g AS (SELECT s, any_value(m) AS m, any_value(k) AS k, avg(2 * (ln(1 + m * x + k) - ln(1 + v)) / (1 + m * x + k) * x) AS a, avg(2 * (ln(1 + m * x + k) - ln(1 + v)) / (1 + m * x + k)) AS b FROM p GROUP BY s)
    SELECT CASE WHEN s = 0 THEN 'even' ELSE 'odd' END AS species, round(m - 0.005 * 0.5 * a, 7) + 0.0 AS slope, round(k - 0.005 * 0.5 * b, 7) + 0.0 AS intercept FROM g""")  # fmt: skip
def q_train_species(spark, d):
    """One update of a model of two species in one region, each with half of the weight."""
    u = _species_units(spark, d)
    o = A.unit_pairs(u)
    for side in ("left", "right"):
        o = o.join(u.select(F.col("unit").alias(side), F.col("bal").alias(f"_{side}")), side)
    o = o.withColumn("value", F.abs(F.col("_left") - F.col("_right")) / (F.abs("_left") + F.abs("_right") + 1)).drop("_left", "_right")
    line = D.StraightLine(species=("even", "odd"), patch_size=2, slope=(0.1, 0.4), intercept=(0.03, 0.0))
    m, _ = T.train(X.cells(spark, d), o, line, PLAIN, T.TrainingConfig(steps=1, eval_every=1, optimizer=_DESCENT))
    return spark.createDataFrame([(n, round(a, 7), round(b, 7)) for n, a, b in zip(m.species, m.slope, m.intercept, strict=True)], "species string, slope double, intercept double")
