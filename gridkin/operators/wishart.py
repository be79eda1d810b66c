"""Wishart diagnostic: squared Gaussian distances between populations as centered scatter matrices."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class WishartError(ValueError):
    """Distances that are no scatter of independent markers."""


def centered_scatter(distances: DataFrame) -> DataFrame:
    """region, i, j, scatter: -1/2 of the squared distances d, centered by rows and columns. distances: region, i,
    j, d, complete."""
    rows = distances.groupBy("region", "i").agg(F.avg("d").alias("mi"))
    cols = distances.groupBy("region", "j").agg(F.avg("d").alias("mj"))
    all_ = distances.groupBy("region").agg(F.avg("d").alias("m"))
    out = distances.join(rows, ["region", "i"]).join(cols, ["region", "j"]).join(all_, "region")
    return out.select("region", "i", "j", (-0.5 * (F.col("d") - F.col("mi") - F.col("mj") + F.col("m"))).alias("scatter"))


def helmert(n: int) -> np.ndarray:
    """n - 1 orthonormal contrasts of n populations."""
    h = np.zeros((n - 1, n))
    for k in range(1, n):
        h[k - 1, :k], h[k - 1, k] = 1.0, -k
    return h / np.sqrt((h**2).sum(1, keepdims=True))


def scatter_matrix(d: np.ndarray, markers: int, averaged: bool = False) -> np.ndarray:
    """Contrast scatter of a complete squared-distance matrix; averaged distances count for all markers."""
    d = np.asarray(d, float)
    n = len(d)
    if d.shape != (n, n) or n < 2 or not np.isfinite(d).all() or not np.allclose(d, d.T) or (d < 0).any() or np.abs(np.diag(d)).max() > 1e-12:
        raise WishartError("squared distances must be complete, symmetric, 0 or more, and 0 on the diagonal")
    if markers < n - 1:
        raise WishartError("there must be as many markers as contrasts")
    h = helmert(n)
    s = -0.5 * h @ d @ h.T
    return s * (markers if averaged else 1)


def cholesky(a: np.ndarray) -> np.ndarray:
    try:
        return np.linalg.cholesky((a + a.T) / 2)
    except np.linalg.LinAlgError as e:
        raise WishartError("a covariance is not positive definite") from e


def log_density(s: np.ndarray, sigma: np.ndarray, df: int) -> float:
    """Log density of a Wishart matrix with df degrees of freedom."""
    p = len(s)
    ls, lg = cholesky(s), cholesky(sigma)
    logdet = lambda c: 2 * float(np.log(np.diag(c)).sum())
    half = np.linalg.solve(lg, ls)
    gamma = p * (p - 1) / 4 * math.log(math.pi) + sum(math.lgamma((df - i) / 2) for i in range(p))
    return (df - p - 1) / 2 * logdet(ls) - float((half**2).sum()) / 2 - df * p / 2 * math.log(2) - df / 2 * logdet(lg) - gamma


def log_likelihood(d: np.ndarray, covariance: np.ndarray, markers: int, averaged: bool = False) -> float:
    """Log density of distances d under a covariance of the populations; averaged distances carry the
    Jacobian of their scaling."""
    h = helmert(len(d))
    p = len(d) - 1
    jacobian = p * (p + 1) / 2 * math.log(markers) if averaged else 0.0
    return log_density(scatter_matrix(d, markers, averaged), h @ covariance @ h.T, markers) + jacobian


def held_out(d: np.ndarray, covariance: np.ndarray, markers: int, train: list[int]) -> float:
    """Log density of all distances given those among the training populations."""
    at = np.ix_(train, train)
    return log_likelihood(d, covariance, markers) - log_likelihood(d[at], covariance[at], markers)


def held_out_record(d: np.ndarray, covariance: np.ndarray, markers: int, train: list[int], anchor: int) -> dict:
    """What held_out() says, with its parts: contrasts are taken against one training population, the anchor, so that
    those of the training populations are the same in both densities."""
    held = [i for i in range(len(d)) if i not in set(train)]
    if anchor not in train or len(set(train)) < 2 or not held:
        raise WishartError("the anchor is one of two or more training populations, and one population at least is held out")

    def density(of: list[int]) -> float:
        h = np.zeros((len(of) - 1, len(of)))
        others = [k for k, i in enumerate(of) if i != anchor]
        h[np.arange(len(others)), others], h[:, of.index(anchor)] = 1.0, -1.0
        at = np.ix_(of, of)
        return log_density(-0.5 * h @ d[at] @ h.T, h @ covariance[at] @ h.T, markers)

    joint, training = density([*train, *held]), density(list(train))
    return {"anchor": anchor, "train": list(train), "held": held, "joint": joint, "training": training, "conditional": joint - training}


def graph_diagnostic(d: np.ndarray, resistance: np.ndarray, markers: int, scale: float, nugget: float) -> dict:
    """Log likelihood under scale * (centered resistance) + nugget, and rank and condition of the two parts.
    The gate never opens: the diagnostic is an experiment."""
    h = helmert(len(d))
    part = -0.5 * h @ resistance @ h.T
    sigma = scale * part + nugget * np.eye(len(part))
    design = np.stack([part.ravel(), np.eye(len(part)).ravel()], 1)
    values = np.linalg.svd(design, compute_uv=False)
    return {
        "log_likelihood": log_density(scatter_matrix(d, markers), sigma, markers), "rank": int(np.linalg.matrix_rank(design)),
        "condition": float(values[0] / values[-1]) if values[-1] > 0 else math.inf, "decision": "no_go",
    }


def log_likelihoods(distances: DataFrame, markers: int, variance: float = 1.0) -> DataFrame:
    """region, units, log_likelihood of each region's squared distances (i < j from 0) under equal variances.
    Distances whose scatter is singular have no density: WishartError."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["j"].max()) + 1
        d = np.zeros((n, n))
        d[rows["i"], rows["j"]] = d[rows["j"], rows["i"]] = rows["d"]
        return pd.DataFrame([(rows["region"].iloc[0], n, log_likelihood(d, variance * np.eye(n), markers))], columns=["region", "units", "log_likelihood"])

    return distances.groupBy("region").applyInPandas(run, "region string, units int, log_likelihood double")
