"""From model distances to measured values: calibration heads, predictions, ensembles."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridkin.functions.targets import TargetSpec
from gridkin.operators.alignment import calibrated, join_groups, pair_effects, shared_pairs, with_endpoints
from gridkin.operators.mlpe import Settings, calibration_pairs, condition, fit_mlpe, with_pairs
from gridkin.operators.models import DistanceModel, ModelError


class PredictionError(ValueError):
    """A query that cannot be answered."""


def refuse_individuals(units: DataFrame) -> None:
    """Raise PredictionError where a region's units are individuals (column individual_based): population effects
    are of populations."""
    if "individual_based" in units.columns:
        found = units.where("individual_based").select("region").distinct().limit(5).collect()
        if found:
            raise PredictionError("population effects need populations; individuals in " + ", ".join(str(r.region) for r in found))


def direct(distances: DataFrame, target: TargetSpec) -> DataFrame:
    """Distances read as values on the model scale: region, species, left, right, value."""
    return distances.select("region", "species", "left", "right", target.inverse(F.col("distance")).alias("value"))


def _mean() -> Column:
    return F.col("intercept") + F.col("slope") * (F.col("distance") - F.col("distance_center")) / F.col("distance_scale")


def marginal(distances: DataFrame, calibrations: DataFrame, target: TargetSpec) -> DataFrame:
    """Predictions that leave unit effects out: region, species, left, right, value, model_value."""
    own = calibrated(distances, calibrations, ["intercept", "slope", "distance_center", "distance_scale"])
    return own.withColumn("model_value", _mean()).select("region", "species", "left", "right", target.inverse(F.col("model_value")).alias("value"), "model_value")


def effect_table(calibrations: DataFrame) -> DataFrame:
    """region, species, unit, mean, at (place of the unit in its calibration)."""
    each = F.posexplode(F.arrays_zip(F.col("population_ids").alias("u"), F.col("effect_mean").alias("m"))).alias("at", "e")
    return calibrations.select("region", "species", each).select("region", "species", F.col("e.u").alias("unit"), F.col("e.m").alias("mean"), "at")


def with_effects(distances: DataFrame, calibrations: DataFrame, target: TargetSpec) -> DataFrame:
    """Predictions with the saved unit effects, 0 with variance unit_variance for a unit without one:
    region, species, left, right, value, model_value, effect_variance, model_variance."""
    columns = ["intercept", "slope", "distance_center", "distance_scale", "unit_variance", "residual_variance", "jitter", "effect_covariance"]
    own = pair_effects(calibrated(distances, calibrations, columns), effect_table(calibrations))
    placed = with_endpoints(own, effect_table(calibrations), ["at"], "left")

    def cov(a: str, b: str) -> Column:
        return F.get(F.get("effect_covariance", F.col(a)), F.col(b))

    u = F.col("unit_variance")
    both = F.coalesce(cov("left_at", "left_at"), u) + F.coalesce(cov("right_at", "right_at"), u) + 2 * F.coalesce(cov("left_at", "right_at"), F.lit(0.0))
    out = placed.withColumn("model_value", _mean() + F.col("effect")).withColumn("effect_variance", both)
    return out.select(
        "region", "species", "left", "right", target.inverse(F.col("model_value")).alias("value"), "model_value", "effect_variance",
        (F.col("effect_variance") + F.col("residual_variance") + F.col("jitter")).alias("model_variance"),
    )


def given_support(
    distances: DataFrame, support: DataFrame, calibrations: DataFrame, target: TargetSpec, calibration_pairs: DataFrame | None = None
) -> DataFrame:
    """Predictions after the unit effects have seen further pairs, with_effects()'s columns.

    support: region, species, left, right, distance, value (measured). Its pairs may be neither asked
    for nor calibrated on, either way round.
    """
    if not shared_pairs(support, distances).isEmpty():
        raise PredictionError("support holds pairs that are asked for")
    if calibration_pairs is not None and not shared_pairs(support, calibration_pairs).isEmpty():
        raise PredictionError("support holds pairs of the calibration")
    asked = distances.select("region", "species", "left", "right", "distance", F.lit(None).cast("double").alias("t"))
    given = support.select("region", "species", "left", "right", "distance", target.forward(F.col("value")).alias("t"))
    columns = ["intercept", "slope", "distance_center", "distance_scale", "unit_variance", "residual_variance", "jitter", "population_ids", "effect_mean", "effect_covariance"]
    names = ["region", "species", "left", "right", "model_value", "effect_variance", "model_variance"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        c = rows.iloc[0]
        ids = list(c["population_ids"])
        more = [x for x in dict.fromkeys([*rows["left"], *rows["right"]]) if x not in set(ids)]
        mean = np.concatenate([np.asarray(c["effect_mean"], float), np.zeros(len(more))])
        cov = np.eye(len(mean)) * c["unit_variance"]
        cov[: len(ids), : len(ids)] = np.stack([np.asarray(r, float) for r in c["effect_covariance"]])
        at = {x: i for i, x in enumerate([*ids, *more])}
        left, right = (rows[k].map(at).to_numpy(np.int64) for k in ("left", "right"))
        point = c["intercept"] + c["slope"] * (rows["distance"].to_numpy(float) - c["distance_center"]) / c["distance_scale"]
        noise = c["residual_variance"] + c["jitter"]
        has = rows["t"].notna().to_numpy()
        if has.any():
            mean, cov = condition(mean, cov, left[has], right[has], rows["t"].to_numpy(float)[has] - point[has], noise)
        i, j = left[~has], right[~has]
        spread = np.maximum(cov[i, i] + cov[j, j] + 2 * cov[i, j], 0.0)
        out = rows.loc[~has, ["region", "species", "left", "right"]]
        return out.assign(model_value=point[~has] + mean[i] + mean[j], effect_variance=spread, model_variance=spread + noise)[names]

    own = calibrated(asked.unionByName(given), calibrations, columns)
    types = "region string, species string, left string, right string, model_value double, effect_variance double, model_variance double"
    done = own.groupBy("region", "species").applyInPandas(run, types)
    return done.select("region", "species", "left", "right", target.inverse(F.col("model_value")).alias("value"), *names[4:])


def as_matrix(predictions: DataFrame, units: DataFrame, value: str = "value") -> DataFrame:
    """Both orientations of every two units of a region and species: value, NaN on the diagonal and for pairs
    that were not predicted."""
    a = units.select("region", "species", F.col("unit").alias("left"))
    b = units.select(F.col("region").alias("_r"), F.col("species").alias("_s"), F.col("unit").alias("right"))
    grid = a.join(b, (a["region"] == b["_r"]) & a["species"].eqNullSafe(b["_s"])).drop("_r", "_s")
    turned = predictions.select("region", "species", F.col("right").alias("left"), F.col("left").alias("right"), value)
    both = predictions.select("region", "species", "left", "right", value).union(turned)
    both = both.select(F.col("region").alias("_r"), F.col("species").alias("_s"), F.col("left").alias("_a"), F.col("right").alias("_b"), F.col(value).alias("_v"))
    on = (grid["region"] == both["_r"]) & grid["species"].eqNullSafe(both["_s"]) & (grid["left"] == both["_a"]) & (grid["right"] == both["_b"])
    return grid.join(both, on, "left").select("region", "species", "left", "right", F.coalesce("_v", F.lit(float("nan"))).alias(value))


class Head(ABC):
    """What turns a model's distances into values. predict() gets distances (region, species, left, right, distance)
    and, where effects() is true, may be asked for known effects or given support (distances with value)."""

    name: str

    @abstractmethod
    def check(self, target: TargetSpec) -> None:
        """Raise PredictionError for targets that the head is not for."""

    def check_units(self, units: DataFrame) -> None:
        """Raise PredictionError for units that the head is not for."""

    @abstractmethod
    def predict(self, distances: DataFrame, target: TargetSpec, *, known_effects: bool = False, support: DataFrame | None = None) -> DataFrame:
        """region, species, left, right, value and what else the head knows."""


@dataclass(frozen=True)
class DirectHead(Head):
    name: str = "direct"

    def check(self, target: TargetSpec) -> None:
        return None

    def predict(self, distances: DataFrame, target: TargetSpec, *, known_effects: bool = False, support: DataFrame | None = None) -> DataFrame:
        if known_effects or support is not None:
            raise PredictionError("the direct head has no unit effects")
        return direct(distances, target)


@dataclass(frozen=True)
class MLPEHead(Head):
    """calibrations: see mlpe.CALIBRATION; with pair_names, support may not repeat the pairs named there."""

    calibrations: DataFrame
    name: str = "mlpe"

    def check(self, target: TargetSpec) -> None:
        if target.kind != "dissimilarity":
            raise PredictionError("population effects are for dissimilarities")

    def check_units(self, units: DataFrame) -> None:
        refuse_individuals(units)

    def predict(self, distances: DataFrame, target: TargetSpec, *, known_effects: bool = False, support: DataFrame | None = None) -> DataFrame:
        if support is not None:
            return given_support(distances, support, self.calibrations, target, calibration_pairs(self.calibrations))
        return (with_effects if known_effects else marginal)(distances, self.calibrations, target)


@dataclass(frozen=True)
class GeneticsModel:
    """A distance model and what turns its distances into measured values.

    calibrations: None for the direct head.
    """

    distance: DistanceModel
    target: TargetSpec
    features: tuple[str, ...] = ()
    calibrations: DataFrame | None = field(default=None, compare=False)

    def __post_init__(self) -> None:
        self.head.check(self.target)

    @property
    def head(self) -> Head:
        return DirectHead() if self.calibrations is None else MLPEHead(self.calibrations)

    def check_features(self, names: list[str] | tuple[str, ...]) -> None:
        if self.features and tuple(names) != self.features:
            raise PredictionError(f"the raster's features are {list(names)}; the model was made for {list(self.features)}")

    def predict(
        self, cells: DataFrame, units: DataFrame, query: DataFrame | dict | list | tuple | None = None, *, known_effects: bool = False,
        support: DataFrame | None = None, features: list[str] | tuple[str, ...] | None = None,
    ) -> DataFrame:
        """Values for the pairs of query (see DistanceModel.resolved()), or for all pairs.

        support: aligned observations (see align_observations()) that update the unit effects first; of the species
        that are asked for, no more and no fewer. features: names of the raster's features, held against the
        model's. Patches must fill the rasters; unknown units and species are refused.
        """
        if support is not None and query is None:
            raise PredictionError("support needs an explicit query")
        if features is not None:
            self.check_features(features)
        self.head.check_units(units)
        self.distance.check_patches(cells)
        asked = self.distance.resolved(units, query)
        d = self.distance.distances(cells, units, asked)
        if support is None:
            return self.head.predict(d, self.target, known_effects=known_effects)
        given = self.distance.resolved(units, support.select("region", "species", "left", "right"))
        some = lambda pairs: {r.species for r in pairs.select("species").distinct().collect()}  # noqa: E731  a model's species
        if some(given) != some(asked):
            raise PredictionError("support and query name different species")
        s = self.distance.distances(cells, units, given)
        named = support if self.distance.species == (None,) else support.withColumn("species", F.coalesce("species", F.lit(self.distance.species[0] if len(self.distance.species) == 1 else None)))
        valued = join_groups(s, named.select("region", "species", "left", "right", "value"), ("left", "right"))
        return self.head.predict(d, self.target, known_effects=known_effects, support=valued)


def fit_head(
    cells: DataFrame, units: DataFrame, observations: DataFrame, distance: DistanceModel, target: TargetSpec,
    *, loss: str = "mlpe", settings: Settings | None = None, max_iterations: int = 500, features: tuple[str, ...] = (),
) -> GeneticsModel:
    """The model with its head fitted to aligned observations, the distances held as they are."""
    if loss == "log1p":
        return GeneticsModel(distance, target, features)
    if loss != "mlpe":
        raise ValueError("loss must be log1p or mlpe")
    refuse_individuals(units)
    d = distance.distances(cells, units, observations)
    valued = join_groups(d, observations.select("region", "species", "left", "right", "value"), ("left", "right"))
    pairs = valued.select("region", "species", "left", "right", "distance", target.forward(F.col("value")).alias("target"))
    return GeneticsModel(distance, target, features, with_pairs(fit_mlpe(pairs, settings, max_iterations), pairs))


@dataclass(frozen=True)
class Ensemble:
    """Models of one target, one set of features and one list of species."""

    members: tuple[GeneticsModel, ...]

    def __post_init__(self) -> None:
        if not self.members:
            raise PredictionError("an ensemble needs a member")
        if len({(m.target, m.features, m.distance.species) for m in self.members}) > 1:
            raise PredictionError("members differ in target, features or species")

    def member_predictions(self, cells: DataFrame, units: DataFrame, query: DataFrame | None = None, **how) -> DataFrame:
        """Predictions of each member, with its number; what a member refuses is said with its number."""
        out = None
        for i, m in enumerate(self.members):
            try:
                part = m.predict(cells, units, query, **how).withColumn("member", F.lit(i))
            except (PredictionError, ModelError) as e:
                e.add_note(f"in member {i}")
                raise
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def predict(self, cells: DataFrame, units: DataFrame, query: DataFrame | None = None, **how) -> DataFrame:
        """The members' mean on the measured scale."""
        return member_mean(self.member_predictions(cells, units, query, **how), len(self.members))


def member_mean(predictions: DataFrame, members: int) -> DataFrame:
    """region, species, left, right, value, spread: mean (each value divided first) and population deviation."""
    keys = ["region", "species", "left", "right"]
    return predictions.groupBy(*keys).agg(F.sum(F.col("value") / F.lit(members)).alias("value"), F.stddev_pop("value").alias("spread"))


def member_quantiles(values: DataFrame, by: list[str], value: str = "conductance") -> DataFrame:
    """by, median, iqr (third less first quartile) of the members' values, by linear interpolation."""
    p = lambda q: F.percentile(value, F.lit(q))
    return values.groupBy(*by).agg(p(0.5).alias("median"), (p(0.75) - p(0.25)).alias("iqr"))


def score_summary(scored: DataFrame) -> DataFrame:
    """score, mean, deviation (of the sample) of scores()' columns over folds."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("score"), F.col(n).alias("v")) for n in ("pearson_r", "r2", "rmse"))))
    return scored.select(each.alias("e")).groupBy(F.col("e.score").alias("score")).agg(F.avg("e.v").alias("mean"), F.stddev_samp("e.v").alias("deviation"))


def scores(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Pearson r, predictive R squared and root mean squared error. predictions: by, observed, predicted."""
    base = predictions.groupBy(*by).agg(F.avg("observed").alias("_mean"))
    joined = predictions.join(base, by)
    sse, sst = F.sum(F.pow(F.col("observed") - F.col("predicted"), 2)), F.sum(F.pow(F.col("observed") - F.col("_mean"), 2))
    return joined.groupBy(*by).agg(
        F.corr("observed", "predicted").alias("pearson_r"), (1 - sse / sst).alias("r2"),
        F.sqrt(F.avg(F.pow(F.col("observed") - F.col("predicted"), 2))).alias("rmse"),
    )


def split_by_units(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """pairs with split: train where neither unit is held out, test otherwise. held: region, unit."""
    names = held.select(F.col("region").alias("_r"), F.col("unit").alias("_u")).distinct()
    out = pairs
    for side in ("left", "right"):
        own = names.withColumn(f"_{side}", F.lit(True))
        out = out.join(own, (out["region"] == own["_r"]) & (out[side] == own["_u"]), "left").drop("_r", "_u")
    return out.withColumn("split", F.when(F.col("_left").isNull() & F.col("_right").isNull(), "train").otherwise("test")).drop("_left", "_right")
