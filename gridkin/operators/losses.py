"""Training losses behind one protocol: what a group starts with, its value and gradient, and what it leaves.

A loss sees a group as an mlpe.Group: distances and model-scale targets of pairs of n units. Its own
parameters (none, or two variances) have one name for each group. The set of losses is closed:
LOSSES names them.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod

import numpy as np

from gridkin.functions.targets import TargetSpec
from gridkin.operators import mlpe

Params = dict[str, np.ndarray]


def softplus(x: float) -> float:
    return max(x, 0.0) + math.log1p(math.exp(-abs(x)))


def inverse_softplus(y: np.ndarray) -> np.ndarray:
    return y + np.log(-np.expm1(-y))


class Loss(ABC):
    """name: as in settings. head: what turns distances of a model trained with it into values.
    scale_free: whether the loss stays as it is when all distances grow alike."""

    name: str
    head: str
    scale_free: bool

    @abstractmethod
    def check(self, target: TargetSpec) -> None:
        """Raise ValueError for targets that the loss is not for."""

    def start(self, target: np.ndarray) -> np.ndarray | None:
        """Starting values of a group's own parameters; None if it has none."""
        return None

    @abstractmethod
    def value(self, g: mlpe.Group, own: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray | None]:
        """Loss of a group, its gradient by each distance, and by the group's own parameters."""

    def fixed(self, g: mlpe.Group, own: np.ndarray | None) -> tuple | None:
        """What a training group hands to its validation group."""
        return None

    def held_out(self, g: mlpe.Group, fixed: tuple | None) -> float:
        """Loss of a validation group."""
        return self.value(g, None)[0]

    def record(self, g: mlpe.Group, own: np.ndarray | None) -> dict | None:
        """The group's calibration, as training leaves it; None where the head needs none."""
        return None


class Log1pLoss(Loss):
    """Mean squared difference of log(1 + distance) and log(1 + target)."""

    name, head, scale_free = "log1p", "direct", False

    def check(self, target: TargetSpec) -> None:
        if target.kind != "dissimilarity":
            raise ValueError("the log1p loss is for dissimilarities")

    def value(self, g: mlpe.Group, own: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray | None]:
        off = np.log1p(g.distance) - np.log1p(g.target)
        return float(np.mean(off**2)), 2 * off / (1 + g.distance) / len(off), None


class MLPELoss(Loss):
    """Negative log likelihood of the population-effect model, divided by the pairs; variances are softplus values
    above a floor, coefficients are profiled out."""

    name, head, scale_free = "mlpe", "mlpe", True

    def __init__(self, settings: mlpe.Settings | None = None):
        self.settings = settings or mlpe.Settings()

    def check(self, target: TargetSpec) -> None:
        if target.kind != "dissimilarity":
            raise ValueError("population effects are for dissimilarities")

    def start(self, target: np.ndarray) -> np.ndarray:
        return inverse_softplus(start_variances(float(np.var(target, ddof=1))))

    def variances(self, own: np.ndarray) -> tuple[float, float]:
        return softplus(own[0]) + self.settings.floor, softplus(own[1]) + self.settings.floor

    def _fit(self, g: mlpe.Group, own: np.ndarray) -> tuple[float, float, float, float, np.ndarray, mlpe.Likelihood]:
        center, scale = g.moments()
        if not scale > self.settings.min_scale:
            raise mlpe.MLPEError("the distances do not vary")
        u, e = self.variances(own)
        z = (g.distance - center) / scale
        return center, scale, u, e, z, mlpe.likelihood(g, z, u, e + self.settings.jitter)

    def value(self, g: mlpe.Group, own: np.ndarray | None) -> tuple[float, np.ndarray, np.ndarray | None]:
        _, scale, _, _, z, fit = self._fit(g, own)
        m = len(g.target)
        by_own = np.array([fit.by_unit / (1 + math.exp(-own[0])), fit.by_noise / (1 + math.exp(-own[1]))]) / m
        return fit.nll / m, mlpe.distance_gradient(g, z, scale, fit) / m, by_own

    def fixed(self, g: mlpe.Group, own: np.ndarray | None) -> tuple:
        center, scale, u, e, _, fit = self._fit(g, own)
        return center, scale, float(fit.beta[0]), float(fit.beta[1]), u, e + self.settings.jitter

    def held_out(self, g: mlpe.Group, fixed: tuple | None) -> float:
        center, scale, b0, b1, u, noise = fixed
        return mlpe.likelihood(g, (g.distance - center) / scale, u, noise, beta=np.array([b0, b1])).nll / len(g.target)

    def record(self, g: mlpe.Group, own: np.ndarray | None) -> dict:
        _, _, u, e, _, fit = self._fit(g, own)
        return mlpe.record(g, fit, u, e, self.settings.jitter, 0, False)


def start_variances(variance: float) -> np.ndarray:
    """Unit and residual variance at the start, from the variance of a group's targets."""
    return np.maximum(variance * np.array([0.25, 0.5]), 1e-9)


LOSSES: dict[str, type[Loss]] = {"log1p": Log1pLoss, "mlpe": MLPELoss}


def loss_of(name: str) -> Loss:
    if name not in LOSSES:
        raise ValueError(f"loss must be one of {', '.join(LOSSES)}")
    return LOSSES[name]()
