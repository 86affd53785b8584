"""The eight run rules as window expressions over one sort, and their violations.

Each flag stands on the last point of its pattern, and a pattern needs its full width. The widest rule looks back 14
rows, which is the halo of a bucket; buckets of one long chart are evaluated apart from each other. Trends and turns are
comparisons of lags, so all rules share one window.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from variq.operators.ordered import over_stream
from variq.plans.spec import ValidationError

LOOK_BACK = 15
#: Rule number -> (name, points needed, description). Fixed values.
RULES = {
    1: ("beyond_limits", 1, "a point beyond the limits"),
    2: ("zone_a_2_of_3", 3, "two of three points beyond two sigma on one side"),
    3: ("zone_b_4_of_5", 5, "four of five points beyond one sigma on one side"),
    4: ("run", 8, "eight points in a row on one side of the center"),
    5: ("trend", 6, "six points in a row rising or falling"),
    6: ("oscillation", 14, "fourteen points in a row alternating up and down"),
    7: ("reduced_variation", 15, "fifteen points in a row within one sigma"),
    8: ("avoiding_center", 8, "eight points in a row outside one sigma"),
}
PRESETS = {"standard": (1, 2, 3, 4), "extended": tuple(RULES), "all": tuple(RULES)}
DEFAULTS = {"X": tuple(RULES), "Xbar": (1,), "S": (1,), "mR": (1,)}


@dataclass(frozen=True)
class Parameters:
    """Counts, widths and zones (in sigma) of the rules."""

    zone_a: tuple[int, int] = (2, 3)
    zone_b: tuple[int, int] = (4, 5)
    run: int = 8
    trend: int = 6
    oscillation: int = 14
    reduced_variation: int = 15
    avoiding_center: int = 8
    a_from: float = 2.0
    b_from: float = 1.0

    @property
    def look_back(self) -> int:
        return max(self.zone_a[1], self.zone_b[1], self.run, self.trend, self.oscillation, self.reduced_variation, self.avoiding_center)


Custom = Callable[[Column, Column, Column, Column, WindowSpec], Column]


@dataclass
class RuleSet:
    """A fluent choice of rules; its parameters are used. custom(name, f): f(v, center, lpl, upl, window) -> boolean Column."""

    rules: list[int] = field(default_factory=list)
    parameters: dict = field(default_factory=dict)
    customs: dict[str, Custom] = field(default_factory=dict)

    def _add(self, rule: int, **parameters) -> RuleSet:
        self.rules.append(rule)
        self.parameters.update(parameters)
        return self

    def beyond_limits(self) -> RuleSet:
        return self._add(1)

    def zone_a(self, count: int = 2, window: int = 3) -> RuleSet:
        return self._add(2, zone_a=(count, window))

    def zone_b(self, count: int = 4, window: int = 5) -> RuleSet:
        return self._add(3, zone_b=(count, window))

    def run(self, length: int = 8) -> RuleSet:
        return self._add(4, run=length)

    def trend(self, length: int = 6) -> RuleSet:
        return self._add(5, trend=length)

    def oscillation(self, length: int = 14) -> RuleSet:
        return self._add(6, oscillation=length)

    def reduced_variation(self, length: int = 15) -> RuleSet:
        return self._add(7, reduced_variation=length)

    def avoiding_center(self, length: int = 8) -> RuleSet:
        return self._add(8, avoiding_center=length)

    def custom(self, name: str, detector: Custom) -> RuleSet:
        self.customs[name] = detector
        return self


def rule_columns(w: WindowSpec, value: str = "value", p: Parameters = Parameters()) -> dict[int, Column]:
    """Boolean columns of all rules over a window ordered by position; reads center, lpl, upl."""
    v, c, hi, lo = F.col(value), F.col("center"), F.col("upl"), F.col("lpl")
    sigma = (hi - c) / 3
    wide = lambda n: w.rowsBetween(-(n - 1), 0)
    total = lambda flag, n: F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(wide(n))
    full = lambda n: F.count(F.lit(1)).over(wide(n)) == n

    def sided(distance: float, count: int, width: int) -> Column:
        return full(width) & ((total(v > c + distance * sigma, width) >= count) | (total(v < c - distance * sigma, width) >= count))

    def steps(up: bool, first: int, n: int) -> list[Column]:
        """Whether each of n steps, from the one that ends `first` points back, goes up (or down)."""
        at = [v if i == 0 else F.lag(v, i).over(w) for i in range(first, first + n + 1)]
        return [a > b if up else a < b for a, b in zip(at, at[1:], strict=False)]

    def every(flags: list[Column]) -> Column:
        return F.coalesce(reduce(Column.__and__, flags), F.lit(False))

    zigzag = lambda start: every([steps((i % 2 == 0) == start, i, 1)[0] for i in range(p.oscillation - 1)])
    run, close, away = p.run, p.reduced_variation, p.avoiding_center
    return {
        1: F.coalesce((v > hi) | (v < lo), F.lit(False)),
        2: sided(p.a_from, *p.zone_a),
        3: sided(p.b_from, *p.zone_b),
        4: full(run) & ((total(v > c, run) == run) | (total(v < c, run) == run)),
        5: every(steps(True, 0, p.trend - 1)) | every(steps(False, 0, p.trend - 1)),
        6: zigzag(True) | zigzag(False),
        7: full(close) & (total((v < c + p.b_from * sigma) & (v > c - p.b_from * sigma), close) == close),
        8: full(away) & (total((v >= c + p.b_from * sigma) | (v <= c - p.b_from * sigma), away) == away),
    }


def flag_rules(chart: DataFrame, rules: tuple[int, ...], *, value: str = "value", position: str = "position", streams: list[str] | None = None, parameters: Parameters | None = None, customs: dict[str, Custom] | None = None) -> DataFrame:
    """The chart with a boolean column rule_<k> for each rule (rule_<name> for custom ones)."""
    streams, p = streams or [], parameters or Parameters()
    unknown = [r for r in rules if r not in RULES]
    if unknown:
        raise ValidationError(f"there is no rule {unknown[0]}")

    def make(w: WindowSpec) -> dict[str, Column]:
        made = rule_columns(w, value, p)
        out: dict[str, Column] = {f"rule_{r}": made[r] for r in rules}
        for name, f in (customs or {}).items():
            out[f"rule_{name}"] = F.coalesce(f(F.col(value), F.col("center"), F.col("lpl"), F.col("upl"), w), F.lit(False))
        return out

    return over_stream(chart, streams, position, p.look_back, make)


def violations(flagged: DataFrame, rules: tuple[int, ...], *, value: str = "value", keep: list[str] | None = None, customs: tuple[str, ...] = ()) -> DataFrame:
    """One row a point and rule: keep..., rule_name, rule_number, description, value, center, upl, lpl."""
    made = [F.when(F.col(f"rule_{r}"), F.struct(F.lit(RULES[r][0]).alias("rule_name"), F.lit(r).alias("rule_number"), F.lit(RULES[r][2]).alias("description"))) for r in rules]
    made += [F.when(F.col(f"rule_{n}"), F.struct(F.lit(n).alias("rule_name"), F.lit(100 + k).alias("rule_number"), F.lit(n).alias("description"))) for k, n in enumerate(customs)]
    each = flagged.withColumn("_v", F.explode(F.array_compact(F.array(*made))))
    return each.select(*(keep or []), "_v.*", F.col(value).alias("value"), "center", "upl", "lpl")


def applicable(rules: tuple[int, ...], n: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """(rules that n points suffice for, rules that are skipped)."""
    return tuple(r for r in rules if RULES[r][1] <= n), tuple(r for r in rules if RULES[r][1] > n)


def trim(chart: DataFrame, position: str, first: int = 0, last: int = 0) -> DataFrame:
    """Without the first and last points of a chart with dense positions from 0."""
    if not first and not last:
        return chart
    end = chart.agg((F.max(position) - last).alias("_end"))
    return chart.crossJoin(end).filter((F.col(position) >= first) & (F.col(position) <= F.col("_end"))).drop("_end")
