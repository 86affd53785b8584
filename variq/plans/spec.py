"""Requests, inputs and errors."""

from __future__ import annotations

from dataclasses import dataclass

CHARTS = ("Xbar", "S", "X", "mR", "Histogram")
RESIDUALS = ("R1", "R2", "R3", "R4", "R5", "R6")


class VariqError(Exception):
    """Base of all errors of this library."""


class ValidationError(VariqError, ValueError):
    """A request or an input that can't be right."""


class ColumnNotFoundError(ValidationError):
    def __init__(self, column: str, available: list[str]):
        super().__init__(f"no column {column!r}; there are {', '.join(available)}")
        self.column, self.available = column, available


class FactorNotFoundError(ValidationError):
    def __init__(self, factor: str, factors: list[str]):
        super().__init__(f"{factor!r} is not a factor of the study; its factors are {', '.join(factors) or 'none'}")
        self.factor, self.factors = factor, factors


class ChartNotAvailableError(ValidationError):
    def __init__(self, chart: str, reason: str):
        super().__init__(f"{chart} is not available: {reason}")
        self.chart, self.reason = chart, reason


class CalibrationNotSupportedError(ValidationError):
    def __init__(self, reason: str):
        super().__init__(f"calibrated limits can't be used: {reason}")
        self.reason = reason


class VariqWarning(UserWarning):
    """Something that was left out or can't be computed."""


@dataclass(frozen=True)
class FormulationSpec:
    response: str
    factors: tuple[str, ...] = ()
    time: str | None = None
    obs_id: str | None = None
    round_to: int = 3
    delimiter: str | None = "_"  # None: labels are JSON lists
    precision: float | None = None
    unit_of_analysis: str | None = None


@dataclass(frozen=True)
class ChartRequest:
    chart: str
    by: tuple[str, ...] | None = None
    value: str | None = None
    recentered: bool = False
    bins: int | None = None
    companion: bool = False
    phased: bool = False
    n_sigma: float = 3.0
    n_mode: str = "actual"
    calibration: Calibration | None = None


@dataclass(frozen=True)
class SpecLimits:
    lsl: float | None = None
    usl: float | None = None
    target: float | None = None

    def __post_init__(self):
        if self.lsl is None and self.usl is None:
            raise ValidationError("a lower or an upper specification limit is needed")
        if self.lsl is not None and self.usl is not None and self.lsl >= self.usl:
            raise ValidationError("the lower specification limit must be below the upper one")
        if self.target is not None and ((self.lsl is not None and self.target < self.lsl) or (self.usl is not None and self.target > self.usl)):
            raise ValidationError("the target must lie within the specification limits")

    @property
    def is_two_sided(self) -> bool:
        return self.lsl is not None and self.usl is not None


@dataclass(frozen=True)
class Calibration:
    mean: float
    sigma: float
    label: str = "calibration"

    def __post_init__(self):
        if not self.sigma > 0 or self.sigma == float("inf") or self.mean != self.mean:
            raise ValidationError("a calibration needs a finite mean and a positive, finite sigma")
