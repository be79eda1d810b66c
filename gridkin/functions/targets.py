"""Target contracts: what a pairwise measurement is, and its scale for models."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("dissimilarity", "relatedness", "similarity")


@dataclass(frozen=True)
class Transform:
    """forward and inverse: column builders. domain: whether a measured value may be transformed.
    nonnegative: whether only model values of 0 and more come back."""

    forward: Callable[[Column], Column]
    inverse: Callable[[Column], Column]
    domain: Callable[[Column], Column]
    nonnegative: bool


def _finite(x: Column) -> Column:
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


TRANSFORMS = {
    "identity": Transform(lambda x: x, lambda y: y, _finite, False),
    "log1p": Transform(F.log1p, F.expm1, lambda x: _finite(x) & (x >= 0), False),
    "sqrt": Transform(F.sqrt, lambda y: y * y, lambda x: _finite(x) & (x >= 0), True),
    "odds": Transform(lambda x: x / (1.0 - x), lambda y: y / (1.0 + y), lambda x: _finite(x) & (x >= 0) & (x < 1), True),
}


@dataclass(frozen=True)
class TargetSpec:
    """name, units, kind and transform of the measured quantity."""

    name: str
    kind: str = "dissimilarity"
    transform: str = "identity"
    units: str = "unspecified"

    def __post_init__(self) -> None:
        for field in ("name", "units"):
            value = getattr(self, field)
            if not isinstance(value, str) or not value.strip():
                raise ValueError(f"target {field} must be a nonempty string")
        if self.kind not in KINDS:
            raise ValueError(f"unknown target kind {self.kind!r}; one of {', '.join(KINDS)}")
        if self.transform not in TRANSFORMS:
            raise ValueError(f"unknown transform {self.transform!r}; one of {', '.join(TRANSFORMS)}")

    def forward(self, value: Column) -> Column:
        """Measured value on the model scale; a value outside the domain fails the job, null stays null."""
        t = TRANSFORMS[self.transform]
        wrong = F.raise_error(F.lit(f"{self.name}: a value is outside the domain of {self.transform}")).cast("double")
        return F.when(value.isNull(), F.lit(None).cast("double")).when(t.domain(value), t.forward(value)).otherwise(wrong)

    def inverse(self, value: Column) -> Column:
        """Model value on the measured scale; a value without a finite counterpart fails the job."""
        t = TRANSFORMS[self.transform]
        wrong = F.raise_error(F.lit(f"{self.name}: a model value has no {self.transform} inverse")).cast("double")
        good = _finite(value) & (value >= 0) if t.nonnegative else _finite(value)
        back = F.when(good, t.inverse(value)).otherwise(wrong)
        return F.when(value.isNull(), F.lit(None).cast("double")).otherwise(F.when(_finite(back), back).otherwise(wrong))
