"""Alignment of units, pairs, cells and vertices: joins on keys that hold for one region.

Tables (see README): cells(region, row, col, features), units(region, species, unit, unit_ord, row, col),
observations(region, species, left, right, value). A species that has no name is null, and joins on
species are null-safe. Pairs have no direction but keep the one they are given in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridkin.functions.columns import canonical_pair, patch_of


def group_match(left: DataFrame, right: DataFrame) -> Column:
    """One region and one species, the unnamed species included."""
    return (left["region"] == right["region"]) & left["species"].eqNullSafe(right["species"])


def join_groups(left: DataFrame, right: DataFrame, more: tuple[str, ...] = (), how: str = "inner") -> DataFrame:
    """left with the columns of right for its region and species (and columns named in more), null-safe in species."""
    names = {"region": "_r", "species": "_s", **{k: f"_k{k}" for k in more}}
    own = right.withColumnsRenamed(names)
    on = (left["region"] == own["_r"]) & left["species"].eqNullSafe(own["_s"])
    for k in more:
        on &= left[k] == own[f"_k{k}"]
    return left.join(own, on, how).drop(*names.values())


def unit_pairs(units: DataFrame) -> DataFrame:
    """Every pair of different units of a region and species, in unit order: region, species, left, right,
    left_ord, right_ord, and cells (left_row, left_col, right_row, right_col). The equi keys keep it a hash join."""
    a, b = units.alias("a"), units.alias("b")
    same = (F.col("a.region") == F.col("b.region")) & F.col("a.species").eqNullSafe(F.col("b.species"))
    joined = a.join(b, same & (F.col("a.unit_ord") < F.col("b.unit_ord")))
    return joined.select(
        F.col("a.region").alias("region"), F.col("a.species").alias("species"),
        F.col("a.unit").alias("left"), F.col("b.unit").alias("right"),
        F.col("a.unit_ord").alias("left_ord"), F.col("b.unit_ord").alias("right_ord"),
        F.col("a.row").alias("left_row"), F.col("a.col").alias("left_col"),
        F.col("b.row").alias("right_row"), F.col("b.col").alias("right_col"),
    )


def with_endpoints(pairs: DataFrame, units: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """pairs with left_c and right_c for each c of columns, looked up by (region, species, unit)."""
    out = pairs
    for side in ("left", "right"):
        own = units.select(F.col("region").alias("_r"), F.col("species").alias("_s"), F.col("unit").alias("_u"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        on = (out["region"] == own["_r"]) & out["species"].eqNullSafe(own["_s"]) & (out[side] == own["_u"])
        out = out.join(own, on, how).drop("_r", "_s", "_u")
    return out


def unknown_units(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """region, species, unit: endpoints of pairs that no unit has."""
    ends = endpoints(pairs)
    return ends.join(units, group_match(ends, units) & (ends["unit"] == units["unit"]), "left_anti")


def endpoints(pairs: DataFrame) -> DataFrame:
    """region, species, unit: the distinct endpoints of pairs."""
    side = lambda c: pairs.select("region", "species", F.col(c).alias("unit"))
    return side("left").union(side("right")).distinct()


def observed_pairs(values: DataFrame) -> DataFrame:
    """Rows of a long matrix that are observations: above the diagonal, neither null nor NaN.

    values: region, species, left, right, left_ord, right_ord, value.
    """
    return values.where((F.col("left_ord") < F.col("right_ord")) & F.col("value").isNotNull() & ~F.isnan("value"))


def align_observations(observations: DataFrame, units: DataFrame) -> DataFrame:
    """observations with the order, row and col of both units in their region, the earlier unit on the left."""
    both = with_endpoints(observations, units, ["unit_ord", "row", "col"])
    turned = F.col("left_unit_ord") > F.col("right_unit_ord")
    pick = lambda a, b: F.when(turned, F.col(b)).otherwise(F.col(a))
    return both.select(
        "region", "species", pick("left", "right").alias("left"), pick("right", "left").alias("right"), "value",
        *(pick(f"left_{c}", f"right_{c}").alias(f"left_{n}") for c, n in (("unit_ord", "ord"), ("row", "row"), ("col", "col"))),
        *(pick(f"right_{c}", f"left_{c}").alias(f"right_{n}") for c, n in (("unit_ord", "ord"), ("row", "row"), ("col", "col"))),
    )


def select_pairs(observations: DataFrame, wanted: DataFrame) -> DataFrame:
    """The observations whose pair wanted names, either way round; ValueError for a pair that was not observed.
    wanted: region, species, left, right."""
    lost = missing_pairs(observations, wanted).limit(5).collect()
    if lost:
        raise ValueError("not observed: " + ", ".join(f"{r.region} {r.left}-{r.right}" for r in lost))
    a = observations.withColumn("_p", canonical_pair(F.col("left"), F.col("right")))
    b = wanted.select("region", "species", canonical_pair(F.col("left"), F.col("right")).alias("_q"))
    return a.join(b, group_match(a, b) & (a["_p"] == b["_q"]), "left_semi").drop("_p")


def missing_pairs(observations: DataFrame, wanted: DataFrame) -> DataFrame:
    """The pairs of wanted that were not observed."""
    a = wanted.withColumn("_p", canonical_pair(F.col("left"), F.col("right")))
    b = observations.select("region", "species", canonical_pair(F.col("left"), F.col("right")).alias("_q"))
    return a.join(b, group_match(a, b) & (a["_p"] == b["_q"]), "left_anti").drop("_p")


def shared_pairs(first: DataFrame, second: DataFrame) -> DataFrame:
    """region, species, pair: pairs that both tables name, either way round."""
    side = lambda t: t.select("region", "species", canonical_pair(F.col("left"), F.col("right")).alias("pair"))
    return side(first).intersect(side(second))


def of_species(units: DataFrame, species: str | None) -> DataFrame:
    """The units of one species."""
    return units.where(F.col("species").eqNullSafe(F.lit(species)))


def species_units(units: DataFrame, species: str | None) -> DataFrame:
    """The units of one species; ValueError if a region has fewer than two of them."""
    own = of_species(units, species)
    few = own.groupBy("region").agg(F.count(F.lit(1)).alias("n")).where("n < 2").limit(5).collect()
    if few or own.isEmpty():
        raise ValueError(f"species {species!r} has fewer than two units" + "".join(f" in region {r.region!r}" for r in few))
    return own


def cell_edges(ticks: DataFrame) -> DataFrame:
    """Intervals in which points belong to cells: region, dim, idx, d, lo, hi, last (index), tol.

    ticks: region, dim, idx, center. Edges lie half way between centers, outer ones half a cell out;
    d turns an axis whose centers fall into one whose centers rise.
    """
    of = Window.partitionBy("region", "dim")
    by = of.orderBy("idx")
    first, second = F.first("center").over(by), F.nth_value("center", 2).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    turned = ticks.withColumn("d", F.when(second < first, F.lit(-1.0)).otherwise(F.lit(1.0))).withColumn("c", F.col("center") * F.col("d"))
    before, after = F.lag("c").over(by), F.lead("c").over(by)
    edged = turned.select(
        "region", "dim", "idx", "d", F.max("idx").over(of).alias("last"),
        F.coalesce((before + F.col("c")) / 2, 1.5 * F.col("c") - 0.5 * after).alias("lo"),
        F.coalesce((F.col("c") + after) / 2, 1.5 * F.col("c") - 0.5 * before).alias("hi"),
        (after - F.col("c")).alias("step"),
    )
    return edged.withColumn("tol", 1e-6 * F.min("step").over(of)).drop("step")


def snap_points(points: DataFrame, ticks: DataFrame) -> DataFrame:
    """points with row and col of the raster cell that they lie in, null outside the raster.

    points: region, unit, x (along columns), y (along rows). On a shared edge the larger index wins;
    the outer edges have a tolerance of a millionth of the smallest cell. An axis comes to its region's
    points as one sorted array, in which each point looks its cell up by halving.
    """
    edges = cell_edges(ticks)
    axis = edges.groupBy("region", "dim").agg(
        F.sort_array(F.collect_list(F.struct("lo", "idx"))).alias("los"), F.max("hi").alias("end"), F.first("tol").alias("tol"), F.first("d").alias("d")
    )  # an array of one raster side
    out = points
    for dim, value, name in (("row", "y", "row"), ("column", "x", "col")):
        own = axis.where(F.col("dim") == dim).select(F.col("region").alias("_r"), *(F.col(c).alias(f"_{c}") for c in ("los", "end", "tol", "d")))
        out = out.join(own, out["region"] == own["_r"], "left")
        v = F.col(value) * F.col("_d")
        inside = (v >= F.get("_los", F.lit(0))["lo"] - F.col("_tol")) & (v <= F.col("_end") + F.col("_tol"))
        place = F.greatest(F.lit(0), _places_at_most(F.col("_los"), v) - 1)
        out = out.withColumn(name, F.when(inside, F.get("_los", place)["idx"])).drop("_r", "_los", "_end", "_tol", "_d")
    return out


def _places_at_most(los: Column, v: Column) -> Column:
    """How many of a sorted array's structs have lo at or below v: a binary search."""

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["low"] + a["high"], 1)
        above = F.struct((mid + 1).alias("low"), a["high"].alias("high"))
        below = F.struct(a["low"].alias("low"), mid.alias("high"))
        return F.when(a["low"] >= a["high"], a).when(F.get(los, mid)["lo"] <= v, above).otherwise(below)

    start = F.struct(F.lit(0).alias("low"), F.size(los).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, halve, lambda a: a["low"])


def adjacency(vertices: DataFrame, value: str = "g") -> DataFrame:
    """Edges of the four-neighbour grid: each vertex with the one to its right and the one below, and the
    mean conductance of the two. vertices: region, row, col, and value."""
    a = vertices.select("region", "row", "col", F.col(value).alias("_v"))
    step = F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc"))))
    near = a.withColumn("_s", step).select("region", "row", "col", "_v", (F.col("row") + F.col("_s.dr")).alias("row2"), (F.col("col") + F.col("_s.dc")).alias("col2"))
    b = vertices.select("region", F.col("row").alias("row2"), F.col("col").alias("col2"), F.col(value).alias("_w"))
    return near.join(b, ["region", "row2", "col2"]).select("region", "row", "col", "row2", "col2", ((F.col("_v") + F.col("_w")) / 2).alias("conductance"))


def unit_vertices(units: DataFrame, patch_size: int) -> DataFrame:
    """units with the row and column of their patch."""
    return units.withColumn("vr", patch_of(F.col("row"), patch_size)).withColumn("vc", patch_of(F.col("col"), patch_size))


def terminals(units: DataFrame, patch_size: int) -> DataFrame:
    """region, vr, vc: the distinct vertices that hold a unit of any species."""
    return unit_vertices(units, patch_size).select("region", "vr", "vc").distinct()


def unmatched_regions(regions: DataFrame, observations: DataFrame) -> DataFrame:
    """Regions that only one of the two tables names, and which."""
    a = regions.select("region").distinct().withColumn("has_raster", F.lit(True))
    b = observations.select("region").distinct().withColumn("has_pairs", F.lit(True))
    return a.join(b, "region", "full_outer").where("has_raster is null or has_pairs is null")


def calibrated(pairs: DataFrame, calibrations: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with columns of the calibration of their region and species; a group without one fails the job by name."""
    own = calibrations.select(F.col("region").alias("_r"), F.col("species").alias("_s"), *columns)
    joined = pairs.join(own, (pairs["region"] == own["_r"]) & pairs["species"].eqNullSafe(own["_s"]), "left")
    say = F.concat(F.lit("no calibration for region "), F.col("region"), F.lit(", species "), F.coalesce("species", F.lit("without a name")))
    checked = F.when(F.col("_r").isNotNull(), F.col(columns[0])).otherwise(F.raise_error(say).cast(own.schema[columns[0]].dataType))
    return joined.withColumn(columns[0], checked).drop("_r", "_s")


def pair_effects(pairs: DataFrame, effects: DataFrame, unit_variance: str | float = 0.0) -> DataFrame:
    """pairs with effect: the sum of their units' effects, 0 for a unit without one.

    effects: region, species, unit, mean.
    """
    both = with_endpoints(pairs, effects.select("region", "species", "unit", "mean"), ["mean"], "left")
    return both.withColumn("effect", F.coalesce("left_mean", F.lit(0.0)) + F.coalesce("right_mean", F.lit(0.0))).drop("left_mean", "right_mean")


def first_seen(labels: DataFrame, order: str = "ord", label: str = "label") -> DataFrame:
    """The distinct labels with the first place at which each stands."""
    return labels.groupBy(label).agg(F.min(order).alias(order))


def folds(labels: DataFrame, k: int, seed: int = 0, label: str = "label") -> DataFrame:
    """labels with fold, from 0 to k - 1: near equal parts of the distinct labels in an order drawn by the seed."""
    if k < 2:
        raise ValueError("two folds are needed")
    drawn = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(label).cast("string")))
    by = Window.orderBy(drawn, label)  # the labels of a study: the units of one region or all
    return labels.select(label).distinct().withColumn("fold", F.ntile(k).over(by) - 1)
