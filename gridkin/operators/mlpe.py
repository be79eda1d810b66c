"""Maximum-likelihood population effects: t = a + b x + effect(left) + effect(right) + noise.

x is a distance, standardized in its group; effects are N(0, u), noise N(0, d). With Z the pairs'
unit indicators, V = d I + u Z Z' is never formed: everything comes from the Cholesky factor of
K = I + (u / d) Z'Z, which has one row for each unit. A group (region, species) is one task's; where
all pairs of a group are observed, nll_complete() needs no kernel at all.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridkin.operators.alignment import join_groups

#: Shares of the response variance that start as unit variance. Fixed values.
STARTS = (0.01, 0.1, 0.25, 0.5, 0.8, 0.998, 0.9998)
#: Part by which rounding may move the factor.
ROUNDOFF = 0.01
EPS = float(np.finfo(float).eps)
LOG_2PI = math.log(2 * math.pi)

CALIBRATION = (
    "region string, species string, distance_center double, distance_scale double, intercept double, slope double, "
    "unit_variance double, residual_variance double, jitter double, population_ids array<string>, effect_mean array<double>, "
    "effect_covariance array<array<double>>, ml_log_likelihood double, pairs bigint, iterations int, message string, converged boolean"
)


class MLPEError(ValueError):
    """A group whose likelihood has no usable optimum."""


@dataclass(frozen=True)
class Settings:
    """floor: least variance. min_scale: least standard deviation of distances. jitter: added to the noise."""

    floor: float = 1e-10
    min_scale: float = 1e-12
    jitter: float = 1e-10

    def __post_init__(self) -> None:
        if not self.floor > 0 or not self.min_scale > 0 or not 0 <= self.jitter <= 1e-6:
            raise ValueError("floor and min_scale must be above 0 and jitter between 0 and 1e-6")


def gram(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Z'Z: degrees on the diagonal, pair counts beside it."""
    g = np.zeros((n, n))
    np.add.at(g, (left, right), 1.0)
    np.add.at(g, (right, left), 1.0)
    np.fill_diagonal(g, np.bincount(left, minlength=n) + np.bincount(right, minlength=n))
    return g


def endpoint_sums(left: np.ndarray, right: np.ndarray, n: int, v: np.ndarray) -> np.ndarray:
    """Z'v for the columns of v."""
    out = np.zeros((n, v.shape[1]))
    np.add.at(out, left, v)
    np.add.at(out, right, v)
    return out


def ratio_limit(max_degree: float) -> float:
    """Largest log of u / d that keeps rounding within ROUNDOFF."""
    return math.log((ROUNDOFF / EPS - 1) / (2 * max_degree)) - 1024 * EPS


@dataclass(frozen=True)
class Group:
    """distances and targets of pairs (left, right) of n units."""

    distance: np.ndarray
    target: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n: int

    def moments(self) -> tuple[float, float]:
        return float(self.distance.mean()), float(self.distance.std(ddof=1))


@dataclass(frozen=True)
class Likelihood:
    nll: float
    beta: np.ndarray
    weights: np.ndarray  # inverse V times residual
    effects: np.ndarray  # posterior mean
    inverse: np.ndarray  # of K
    by_unit: float
    by_noise: float


def likelihood(g: Group, x: np.ndarray, u: float, d: float, beta: np.ndarray | None = None, zz: np.ndarray | None = None) -> Likelihood:
    """Negative log likelihood at variances u and d; beta is profiled out unless it is given."""
    zz = gram(g.left, g.right, g.n) if zz is None else zz
    ratio = u / d
    if not EPS * (1 + 2 * ratio * zz.diagonal().max()) <= ROUNDOFF:
        raise MLPEError("the unit variance is too large against the noise")
    low = np.linalg.cholesky(np.eye(g.n) + ratio * zz)
    m = len(x)
    b = np.stack([np.ones(m), x, g.target], 1)
    half = np.linalg.solve(low, endpoint_sums(g.left, g.right, g.n, b))
    a = ratio * np.linalg.solve(low.T, half)
    rest = b - a[g.left] - a[g.right]
    inner = rest.T @ rest / d + a.T @ a / u
    if beta is None:
        beta = np.linalg.solve(inner[:2, :2], inner[:2, 2])
    c = np.array([-beta[0], -beta[1], 1.0])
    logdet = m * math.log(d) + 2 * np.log(low.diagonal()).sum()
    w = (rest @ c) / d
    inverse = np.linalg.inv(low).T @ np.linalg.inv(low)
    zw = endpoint_sums(g.left, g.right, g.n, w[:, None])[:, 0]
    by_unit = 0.5 * (np.trace(inverse @ zz) / d - zw @ zw)
    by_noise = 0.5 * ((m - g.n + np.trace(inverse)) / d - w @ w)
    return Likelihood(0.5 * (m * LOG_2PI + logdet + c @ inner @ c), beta, w, a @ c, inverse, by_unit, by_noise)


def distance_gradient(g: Group, x: np.ndarray, scale: float, fit: Likelihood) -> np.ndarray:
    """Gradient of the profiled likelihood by each distance, through the standardization."""
    by_x = -fit.beta[1] * fit.weights
    return (by_x - by_x.mean() - x * (x @ by_x) / (len(x) - 1)) / scale


def check_group(g: Group, settings: Settings) -> None:
    if len(g.distance) < 3:
        raise MLPEError("a group needs 3 pairs")
    if (np.bincount(g.left, minlength=g.n) + np.bincount(g.right, minlength=g.n)).max() < 2:
        raise MLPEError("no unit is in two pairs")
    if not (np.isfinite(g.distance).all() and np.isfinite(g.target).all()):
        raise MLPEError("distances and targets must be finite")
    if g.moments()[1] <= settings.min_scale:
        raise MLPEError("distances do not vary")


def fit_group(g: Group, settings: Settings | None = None, max_iterations: int = 500) -> dict:
    """Variances, coefficients and effects at the maximum of the likelihood.

    From each start a quasi-Newton search runs over (log u, log z); the noise d is a smooth maximum
    of z and of u over the largest usable ratio, so that every point can be factored.
    """
    settings = settings or Settings()
    check_group(g, settings)
    center, scale = g.moments()
    x, zz = (g.distance - center) / scale, gram(g.left, g.right, g.n)
    line = np.polyfit(x, g.target, 1)
    spread = float((g.target - np.polyval(line, x)).var(ddof=1))
    limit = ratio_limit(zz.diagonal().max())
    low = np.log(np.array([settings.floor, settings.floor]))
    high = np.array([np.inf, math.log(max(spread * 1e6, 1e4))])

    def noise(p: np.ndarray) -> tuple[float, float, float]:
        """d, and its derivatives by log u and log z."""
        z, bound = math.exp(p[1]) + settings.jitter, math.exp(p[0] - limit)
        top = max(z, bound)
        parts = (z / top) ** 8, (bound / top) ** 8
        d = top * sum(parts) ** 0.125
        return d, d * parts[1] / sum(parts), d * parts[0] / sum(parts) * (z - settings.jitter) / z

    def value(p: np.ndarray) -> tuple[float, np.ndarray, Likelihood | None]:
        try:
            d, by_u, by_z = noise(p)
            fit = likelihood(g, x, math.exp(p[0]), d, zz=zz)
        except (MLPEError, np.linalg.LinAlgError, OverflowError):
            return math.inf, np.zeros(2), None
        return fit.nll, np.array([fit.by_unit * math.exp(p[0]) + fit.by_noise * by_u, fit.by_noise * by_z]), fit

    best = None
    for share in STARTS:
        p = np.log(np.maximum([spread * share, spread * (1 - share)], 10 * settings.floor))
        f, grad, fit = value(p)
        hess, steps = np.eye(2), 0
        while fit is not None and steps < max_iterations:
            free = ~(((p <= low) & (grad > 0)) | ((p >= high) & (grad < 0)))
            if np.abs(grad[free]).max(initial=0.0) < 1e-9 * max(1, len(x)):
                break
            move = np.where(free, -hess @ np.where(free, grad, 0.0), 0.0)
            if move @ grad >= 0:
                hess, move = np.eye(2), np.where(free, -grad, 0.0)
            move *= min(1.0, 3.0 / np.abs(move).max())
            size = 1.0
            while size > 1e-12:
                q = np.clip(p + size * move, low, high)
                fq, gq, fitq = value(q)
                if fq <= f + 1e-4 * grad @ (q - p):
                    break
                size /= 2
            else:
                break
            dp, dg = q - p, gq - grad
            if dp @ dg > 1e-14:
                rho = 1.0 / (dp @ dg)
                left = np.eye(2) - rho * np.outer(dp, dg)
                hess = left @ hess @ left.T + rho * np.outer(dp, dp)
            done = abs(f - fq) <= 1e-13 * (1 + abs(f)) and np.abs(dp).max() < 1e-9
            p, f, grad, fit, steps = q, fq, gq, fitq, steps + 1
            if done:
                break
        if fit is None:
            continue
        free = ~(((p <= low) & (grad > 0)) | ((p >= high) & (grad < 0)))
        still = np.abs(grad[free]).max(initial=0.0) <= 1e-2 + 1e-5 * len(x)
        key = (not still, f)
        if best is None or key < best[0]:
            best = (key, p, fit, steps, still)
    if best is None:
        raise MLPEError("the likelihood is finite at no start")
    _, p, fit, steps, still = best
    u, (d, _, _) = math.exp(p[0]), noise(p)
    if not still:
        raise MLPEError("no start came to a stationary point")
    if p[0] - math.log(d) >= limit - 1e-6:
        raise MLPEError("the variance ratio is at its limit")
    return record(g, fit, u, d - settings.jitter, settings.jitter, steps, True)


def record(g: Group, fit: Likelihood, u: float, e: float, jitter: float, steps: int, converged: bool) -> dict:
    center, scale = g.moments()
    cov = u * fit.inverse
    return {
        "distance_center": center, "distance_scale": scale, "intercept": float(fit.beta[0]), "slope": float(fit.beta[1]),
        "unit_variance": float(u), "residual_variance": float(e), "jitter": jitter, "effect_mean": fit.effects.tolist(),
        "effect_covariance": ((cov + cov.T) / 2).tolist(), "ml_log_likelihood": -float(fit.nll), "pairs": len(g.distance),
        "iterations": steps, "message": "stationary" if converged else "not searched", "converged": converged,
    }


def group_of(rows: pd.DataFrame, units: list[str] | None = None) -> tuple[Group, list[str]]:
    """The group of rows (left, right, distance, target), and its units: those given, or the observed
    ones in order of first appearance."""
    rows = rows.sort_values(["left", "right"], kind="stable")
    names = units or list(dict.fromkeys(x for pair in zip(rows["left"], rows["right"], strict=True) for x in pair))
    at = {x: i for i, x in enumerate(names)}
    left, right = (rows[c].map(at).to_numpy(np.int64) for c in ("left", "right"))
    return Group(rows["distance"].to_numpy(float), rows["target"].to_numpy(float), left, right, len(names)), names


def fit_mlpe(pairs: DataFrame, settings: Settings | None = None, max_iterations: int = 500) -> DataFrame:
    """A calibration for each region and species. pairs: region, species, left, right, distance, target (on the
    model scale). A group that cannot be fitted fails the job with its name."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        region, species = rows["region"].iloc[0], rows["species"].iloc[0]
        g, names = group_of(rows)
        try:
            found = fit_group(g, settings, max_iterations)
        except MLPEError as e:
            raise MLPEError(f"region {region!r}, species {species!r}: {e}") from e
        return pd.DataFrame([{"region": region, "species": species, "population_ids": names, **found}])[[c.split()[0] for c in CALIBRATION.split(", ")]]

    own = pairs.select("region", "species", "left", "right", F.col("distance").cast("double"), F.col("target").cast("double"))
    return own.groupBy("region", "species").applyInPandas(run, CALIBRATION)


def with_pairs(calibrations: DataFrame, pairs: DataFrame) -> DataFrame:
    """calibrations with pair_names: the pairs (left, right) of the group that they were fitted to."""
    names = pairs.groupBy("region", "species").agg(F.sort_array(F.collect_list(F.struct("left", "right"))).alias("pair_names"))  # of one group
    return join_groups(calibrations, names, how="left")


def calibration_pairs(calibrations: DataFrame) -> DataFrame | None:
    """region, species, left, right of the pairs that calibrations were fitted to; None where they do not say."""
    if "pair_names" not in calibrations.columns:
        return None
    return calibrations.select("region", "species", F.inline("pair_names"))


def nll_at(pairs: DataFrame, unit_variance: float, noise: float) -> DataFrame:
    """region, species, nll, intercept, slope, sum_w, sum_wx at given variances, for any set of pairs. The
    weights w are orthogonal to the design."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        g, _ = group_of(rows)
        center, scale = g.moments()
        x = (g.distance - center) / scale
        f = likelihood(g, x, unit_variance, noise)
        out = rows["region"].iloc[0], rows["species"].iloc[0], f.nll, f.beta[0], f.beta[1], f.weights.sum(), f.weights @ x
        return pd.DataFrame([out], columns=["region", "species", "nll", "intercept", "slope", "sum_w", "sum_wx"])

    own = pairs.select("region", "species", "left", "right", F.col("distance").cast("double"), F.col("target").cast("double"))
    return own.groupBy("region", "species").applyInPandas(run, "region string, species string, nll double, intercept double, slope double, sum_w double, sum_wx double")


def endpoint_table(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """region, species, unit, and the sum of each column over the pairs of the unit: Z'v."""
    ends = pairs.select("region", "species", F.explode(F.array("left", "right")).alias("unit"), *columns)
    return ends.groupBy("region", "species", "unit").agg(*(F.sum(c).alias(c) for c in columns), F.count(F.lit(1)).alias("degree"))


def moments(pairs: DataFrame) -> DataFrame:
    """region, species, center, scale (sample standard deviation), pairs."""
    return pairs.groupBy("region", "species").agg(F.avg("distance").alias("center"), F.stddev_samp("distance").alias("scale"), F.count(F.lit(1)).alias("pairs"))


def complete_parts(pairs: DataFrame, unit_variance: float, noise: float) -> tuple[DataFrame, DataFrame]:
    """For groups in which every pair of units is observed, in closed form: (endpoint effects, pair residuals)
    of the columns 1, x and t. Z'Z = (n - 2) I + 11' makes K's inverse a mean and a remainder."""
    ratio, of = unit_variance / noise, Window.partitionBy("region", "species")  # a group is one task's everywhere here
    x = (F.col("distance") - F.avg("distance").over(of)) / F.stddev_samp("distance").over(of)
    std = pairs.select("region", "species", "left", "right", F.lit(1.0).alias("one"), x.alias("x"), F.col("target").alias("t"))
    cols = ["one", "x", "t"]
    ends = endpoint_table(std, cols)
    n = F.count(F.lit(1)).over(of)
    a, b = 1 + F.lit(ratio) * (n - 2), 1 + F.lit(ratio) * (2 * n - 2)
    mean = lambda c: F.avg(c).over(of)
    effects = ends.select("region", "species", "unit", n.alias("n"), *((ratio * ((F.col(c) - mean(c)) / a + mean(c) / b)).alias(c) for c in cols))
    rest = std
    for side in ("left", "right"):
        own = effects.select(F.col("region").alias("_r"), F.col("species").alias("_s"), F.col("unit").alias("_u"), *(F.col(c).alias(f"_{c}") for c in cols))
        on = (rest["region"] == own["_r"]) & rest["species"].eqNullSafe(own["_s"]) & (rest[side] == own["_u"])
        rest = rest.join(own, on).select("region", "species", "left", "right", *((F.col(c) - F.col(f"_{c}")).alias(c) for c in cols))
    return effects, rest


def nll_complete(pairs: DataFrame, unit_variance: float, noise: float, coefficients: tuple[float, float] | None = None) -> DataFrame:
    """region, species, pairs, nll, intercept, slope for groups with every pair observed: DataFrame operations only.
    coefficients: intercept and slope to use instead of the best ones."""
    effects, rest = complete_parts(pairs, unit_variance, noise)
    cols, ratio = ["one", "x", "t"], unit_variance / noise
    products = [(p, q) for i, p in enumerate(cols) for q in cols[i:]]
    inner = lambda df, by: df.groupBy("region", "species").agg(
        *(F.sum(F.col(p) * F.col(q) / by).alias(f"{p}_{q}") for p, q in products), F.count(F.lit(1)).alias("k")
    )
    names = [f"{p}_{q}" for p, q in products]
    of_units = inner(effects, unit_variance).withColumnsRenamed({"k": "n", **{c: f"u_{c}" for c in names}})
    s = join_groups(inner(rest, noise), of_units).select("region", "species", F.col("k").alias("m"), "n", *((F.col(c) + F.col(f"u_{c}")).alias(c) for c in names))
    det = F.col("one_one") * F.col("x_x") - F.col("one_x") * F.col("one_x")
    if coefficients is None:
        b0 = (F.col("one_t") * F.col("x_x") - F.col("x_t") * F.col("one_x")) / det
        b1 = (F.col("x_t") * F.col("one_one") - F.col("one_t") * F.col("one_x")) / det
    else:
        b0, b1 = (F.lit(float(c)) for c in coefficients)
    s = s.withColumn("intercept", b0).withColumn("slope", b1)
    i, k = F.col("intercept"), F.col("slope")
    quad = F.col("t_t") - 2 * (i * F.col("one_t") + k * F.col("x_t")) + i * i * F.col("one_one") + 2 * i * k * F.col("one_x") + k * k * F.col("x_x")
    logdet = F.col("m") * math.log(noise) + (F.col("n") - 1) * F.log(1 + ratio * (F.col("n") - 2)) + F.log(1 + ratio * (2 * F.col("n") - 2))
    return s.select("region", "species", F.col("m").alias("pairs"), (0.5 * (F.col("m") * LOG_2PI + logdet + quad)).alias("nll"), "intercept", "slope")


def effects_complete(pairs: DataFrame, unit_variance: float, noise: float) -> DataFrame:
    """region, species, unit, mean: posterior unit effects of groups with every pair observed."""
    effects, _ = complete_parts(pairs, unit_variance, noise)
    fit = nll_complete(pairs, unit_variance, noise).select("region", "species", "intercept", "slope")
    return join_groups(effects, fit).select("region", "species", "unit", (F.col("t") - F.col("intercept") * F.col("one") - F.col("slope") * F.col("x")).alias("mean"))


def condition(mean: np.ndarray, cov: np.ndarray, left: np.ndarray, right: np.ndarray, residual: np.ndarray, noise: float) -> tuple[np.ndarray, np.ndarray]:
    """Effects after further pairs: their mean and covariance, symmetric and positive semidefinite."""
    z = np.zeros((len(residual), len(mean)))
    np.add.at(z, (np.arange(len(residual)), left), 1.0)
    np.add.at(z, (np.arange(len(residual)), right), 1.0)
    gain = np.linalg.solve(z @ cov @ z.T + noise * np.eye(len(residual)), z @ cov).T
    rest = np.eye(len(mean)) - gain @ z
    new = rest @ cov @ rest.T + noise * gain @ gain.T
    return mean + gain @ (residual - z @ mean), (new + new.T) / 2
