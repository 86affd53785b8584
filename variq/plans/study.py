"""Studies: formulate(response, factors, time), then execute(chart, by, value, ...).

Planning reads two small rows (the observed and the analysed design state); everything that execute returns is a lazy
DataFrame.
"""

from __future__ import annotations

import difflib
import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variq.functions.limits import SIGMA_INTERVAL_80, beyond, c4_col, calibrated, rounded
from variq.operators import capability as cap
from variq.operators import charts, clean, derive, design, effects, prepare
from variq.operators.ordered import positions
from variq.plans.result import AnalysisResult, Chart
from variq.plans.spec import CHARTS, RESIDUALS, Calibration, CalibrationNotSupportedError, ChartNotAvailableError, ChartRequest, FactorNotFoundError, FormulationSpec, SpecLimits, ValidationError, VariqWarning

#: Other names that people use for a chart, and what to ask for. Fixed values.
ALIASES = {"xmr": "X with companion=True", "imr": "X with companion=True", "i-mr": "X with companion=True", "xbar-s": "Xbar with companion=True", "xbars": "Xbar with companion=True", "individuals": "X", "individual": "X", "i": "X", "i-chart": "X", "x-chart": "X", "range": "mR", "r": "mR", "moving range": "mR", "mr-chart": "mR", "x-bar": "Xbar", "xbar-chart": "Xbar", "sigma": "S", "s-chart": "S", "hist": "Histogram"}

#: What each chart and value answers.
QUESTIONS = {
    "Xbar": "do subgroup averages differ by more than the spread within subgroups explains?", "S": "is the spread within subgroups the same everywhere?",
    "X": "is each reading predictable from those before?", "mR": "do successive readings differ by a constant amount of noise?", "Histogram": "how are the values distributed?",
    "R1": "total variation", "R2": "noise, without conditions and periods", "R3": "interaction of conditions and periods", "R4": "periods", "R5": "conditions", "R6": "the chosen factors",
}
EFFECT_RESIDUALS = ("R1", "R3", "R4", "R5")


def chart_name(name: str) -> str:
    """The canonical chart name; errors say what was probably meant."""
    for c in CHARTS:
        if name.lower() == c.lower():
            return c
    if name.lower() in ALIASES:
        raise ValidationError(f"{name!r} is not a chart's name here; ask for {ALIASES[name.lower()]}")
    near = difflib.get_close_matches(name, CHARTS, 1, 0.4)
    raise ValidationError(f"no chart {name!r}; there are {', '.join(CHARTS)}" + (f". Did you mean {near[0]}?" if near else ""))


class Process:
    """Cleaned data and derivations that are still to be made; immutable."""

    def __init__(self, data: DataFrame, na_values: list[str] | None = None, *, cleaned: bool = False, report: dict | None = None, derivations: tuple = ()):
        self.data, self.report = (data, report or {}) if cleaned else clean.clean(data, na_values)
        self.derivations = tuple(derivations)

    def _with(self, derivations) -> Process:
        return Process(self.data, cleaned=True, report=self.report, derivations=derivations)

    def transform(self, source: str, function: str, name: str | None = None, on_invalid: str = "error", **params) -> Process:
        return self._with([*self.derivations, derive.Derivation("transform", source, function, name, params, on_invalid=on_invalid)])

    def bin(self, source: str, method: str, name: str | None = None, **params) -> Process:
        return self._with([*self.derivations, derive.Derivation("bin", source, method, name, params)])

    def add_derived(self, d: derive.Derivation) -> Process:
        return self._with([*self.derivations, d])

    def remove_derived(self, name: str) -> Process:
        return self._with([d for d in self.derivations if d.output != name])

    def replace_derived(self, name: str, d: derive.Derivation) -> Process:
        return self._with([d if x.output == name else x for x in self.derivations])

    def levels(self, column: str) -> list:
        """The distinct values of a column, in natural order (driver; for factor columns)."""
        got = self.data.select(column).distinct().dropna()
        return [r[0] for r in got.orderBy(prepare.natural_key(F.col(column).cast("string"))).collect()]

    def formulate(self, response: str, factors: list[str] | tuple[str, ...] = (), time: str | None = None, *, plan: dict | None = None, obs_id: str | None = None, precision: float | None = None, unit_of_analysis: str | None = None) -> Study:
        """The study of a response by factors over time. plan: {'factors': {name: levels}, 'T': periods, 'N': readings a cell}."""
        data = self.data
        if self.derivations:
            data, _ = derive.materialise(data, list(self.derivations))
        if plan and not factors:
            factors = list(plan["factors"])
        keys = list(dict.fromkeys([*factors, *([time] if time else [])]))
        data = clean.detect_kinds(data, keys)
        spec = FormulationSpec(response, tuple(factors), time, obs_id, precision=precision, unit_of_analysis=unit_of_analysis)
        prepare.validate(data, spec)
        return Study(data, spec, plan)


def formulate(data: DataFrame, response: str, factors=(), time=None, **kw) -> Study:
    """One call from a table to a study."""
    return Process(data).formulate(response, factors, time, **kw)


@dataclass(frozen=True)
class State:
    code: int
    reason: str
    n_cells: int
    min_n: int
    max_n: int
    n_empty: int = 0


class Study:
    def __init__(self, data: DataFrame, spec: FormulationSpec, plan: dict | None = None, calibrations: dict[str, Calibration] | None = None):
        self.frame = frame = prepare.prepare(data, spec, persist=True)
        if len(spec.factors) > 1 and prepare.ambiguous(frame.sums, spec):
            warnings.warn(f"values with {spec.delimiter!r} in them would give two conditions one name; rsg is a JSON list here", VariqWarning, stacklevel=3)
            spec = replace(spec, delimiter=None)
            self.frame = frame = prepare.Frame(spec, frame.rows.withColumn("rsg", prepare.label(frame.rows, spec.factors, None)), frame.cells, frame.sums, frame.base)
        self.data, self.spec, self.plan, self.calibrations = data, spec, plan, calibrations or {}
        self.base = prepare.tidy(data, spec)  # all that charts of the response need: no means are joined to rows
        self._ads = self._ods = None
        self.r2_unavailable: str | None = None
        if spec.factors and spec.time:
            method = design.r2_method(self.analytical_design_state.code)
            if method == "ma2":
                c = prepare.scale_factor(frame.sums, spec.factors).first()
                if c["c"] is None:
                    self.r2_unavailable = f"R2 needs two conditions and two readings more than conditions; there are {c['K']} and {c['M']}"
                    warnings.warn(self.r2_unavailable, VariqWarning, stacklevel=3)
            self.frame = prepare.residuals(self.frame, method)

    def release(self) -> None:
        """Frees the sums of cells that plans of this study start from; plans made later compute it again."""
        self.frame.sums.unpersist()

    def __enter__(self) -> Study:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    # Design states

    @property
    def analytical_design_state(self) -> State:
        if self._ads is None:
            r = design.analytic_state(self.frame.sums).first()
            if not r["n_cells"] or r["max_n"] is None:
                raise ValidationError(f"{self.spec.response!r} has no reading with all factors and the time known")
            self._ads = State(r["state"], r["reason"], r["n_cells"], r["min_n"], r["max_n"])
        return self._ads

    @property
    def observed_design_state(self) -> State:
        if self._ods is None:
            plan = None
            if self.plan:
                times = [*range(1, self.plan["T"] + 1)] if self.spec.time else None
                plan = design.plan_cells(self.data.sparkSession, self.plan["factors"], self.spec.time, times, self.data.schema)
            r = design.observed_state(self.data, self.spec, plan).first()
            self._ods = State(r["state"], r["reason"], r["n_cells"], r["min_n"], r["max_n"], r["n_empty"])
        return self._ods

    @property
    def plan_design_state(self) -> State | None:
        if not self.plan:
            return None
        code, reason = design.plan_state(self.plan["factors"], self.plan["T"], self.plan["N"])
        return State(code, reason, 0, self.plan["N"], self.plan["N"])

    @property
    def has_residuals(self) -> bool:
        return bool(self.spec.factors and self.spec.time)

    @property
    def valid_charts(self) -> tuple[str, ...]:
        return design.CHARTS[self.analytical_design_state.code][0]

    @property
    def recommended_chart(self) -> str:
        return design.CHARTS[self.analytical_design_state.code][1]

    @property
    def residual_charts(self) -> dict[str, tuple[str, ...]]:
        if not self.has_residuals:
            return {}
        got = design.residual_charts(self.analytical_design_state.min_n)
        return {"R1": got["R1"]} if self.r2_unavailable else got

    @property
    def available_analysis_methods(self) -> tuple[str, ...]:
        return ("Capability",) if not self.has_residuals or self.r2_unavailable else ("Capability", "Loss function", "Maximum information")

    def support(self) -> DataFrame:
        """One row a chart and value: available, recommended, reason, and the question that it answers."""
        rows = [("response", c, self.why_not(c) is None, c == self.recommended_chart, self.why_not(c) or "", QUESTIONS[c]) for c in CHARTS]
        rows += [(v, c, self.why_not(c, v) is None, False, self.why_not(c, v) or "", f"{QUESTIONS[v]}: {QUESTIONS[c]}") for v in RESIDUALS for c in ("Xbar", "S", "X")]
        return self.data.sparkSession.createDataFrame(rows, "value string, chart string, available boolean, recommended boolean, reason string, question string")

    def why_not(self, chart: str, value: str | None = None) -> str | None:
        """Why a chart isn't available, or None."""
        chart = chart_name(chart)
        if value is None or value == self.spec.response:
            return None if chart in self.valid_charts else f"{chart} needs subgroups of two readings or more, and every cell has one"
        value = value.removeprefix("RC") if value.startswith("RCR") else value
        if not self.has_residuals:
            return "residuals need factors and a time"
        if self.r2_unavailable and value != "R1":
            return self.r2_unavailable
        if chart in ("mR", "Histogram"):
            return None
        return None if chart in self.residual_charts.get(value, ()) else f"{chart} doesn't fit {value} in this design"

    def series_length(self) -> dict:
        """Periods, within-cell degrees of freedom, and how precise a sigma from so many moving ranges is."""
        cells = self.frame.sums
        r = cells.agg((F.count_distinct(self.spec.time) if self.spec.time else F.sum("n")).alias("T"), F.sum(F.col("n") - 1).alias("df")).first()
        return {"periods": r["T"], "df_within": r["df"], "sigma_interval_80": SIGMA_INTERVAL_80.get(min(r["T"], 30))}

    def design(self) -> DataFrame:
        """One row of metrics: of what was observed and, with a plan, of what was planned."""
        out = design.report(self.frame.sums, self.spec)
        if self.has_residuals:
            out = out.crossJoin(design.period_spread(self.frame.sums, self.spec))
        if self.plan:
            planned = 1
            for levels in self.plan["factors"].values():
                planned *= len(set(map(str, levels)))
            out = out.withColumns({"K_planned": F.lit(planned), "T_planned": F.lit(self.plan["T"]), "N_planned": F.lit(self.plan["N"])})
        return out

    def design_summary(self) -> str:
        """The design in words: the state and what it comes from, what a plan lacks, what hides in the order."""
        r, state = self.design().first(), self.analytical_design_state
        said = [f"{state.reason}: {r['R']} cells of {state.min_n} to {state.max_n} readings, {r['n_single']} of them of one"]
        if r["empty"]:
            said.append(f"{r['empty']} of {r['K'] * r['T']} condition-period cells are empty")
        if self.plan:
            lacks = [f"{r[f'{x}_planned'] - r[x]} of {r[f'{x}_planned']} planned {name}" for x, name in (("K", "conditions"), ("T", "periods")) if r[f"{x}_planned"] > r[x]]
            said.append(f"missing: {', '.join(lacks)}" if lacks else "all planned conditions and periods were observed")
        nested = self.nested_factors()
        if nested:
            said.append(f"{', '.join(nested)}: one level a period, so its effect can't be told from time")
        elif self.has_residuals and r["empty"] and r["period_spread"]:
            said.append(f"conditions were observed in different periods: their mean period ranks differ by up to {r['period_spread']:.1f}")
        return "; ".join(said)

    def nested_factors(self) -> list[str]:
        """Factors of which no period has two levels, if some factor has several levels."""
        if not self.has_residuals:
            return []
        return [x["factor"] for x in design.nested_in_time(self.frame.sums, list(self.spec.factors), self.spec.time).collect() if x["nested"]]

    def missing_combos(self, limit: int | None = None) -> DataFrame:
        return design.missing_combos(self.frame.sums, self._planned(), limit)

    def extra_combos(self, limit: int | None = None) -> DataFrame:
        return design.extra_combos(self.frame.sums, self._planned(), limit)

    def _planned(self) -> DataFrame:
        return design.plan_cells(self.data.sparkSession, self.plan["factors"], None, None, self.frame.cells.schema)

    def levels(self) -> DataFrame:
        """Planned and observed levels of each planned factor."""
        return design.level_report(self.frame.sums, self.plan["factors"])

    def plan_adherence(self) -> DataFrame:
        """Over planned conditions (all periods together): complete, short and empty ones, and what would mend it."""
        plan = self._planned()
        cells = self.frame.sums.groupBy(*self.plan["factors"]).agg(F.sum("n").alias("n"))
        return design.adherence(cells, plan, self.plan["N"] * self.plan["T"])

    # Analyses of one row

    def capability(self, lsl=None, usl=None, target=None, window: tuple | None = None) -> DataFrame:
        frame = replace(self.frame, rows=self.frame.rows.drop("R2")) if self.r2_unavailable else self.frame
        out = cap.capability(frame, SpecLimits(lsl, usl, target), window)
        if window:
            n = out.select("n").first()[0]
            if n < cap.FEWEST:
                raise ValidationError(f"the window has {n} readings; {cap.FEWEST} are needed")
            if n < cap.FEW:
                warnings.warn(f"the window has {n} readings only", VariqWarning, stacklevel=2)
        return out

    def loss_function(self, target: float | None = None) -> DataFrame:
        self._need_r2("the loss function")
        nested = self.nested_factors()
        if nested:
            warnings.warn(f"each period has one level of {', '.join(nested)}: the conditions' and the time's part of the loss both hold that effect; a phased Xbar chart compares the levels", VariqWarning, stacklevel=2)
        return cap.loss(self.frame, self.analytical_design_state.min_n >= 2, target)

    def loss_by_factor(self) -> DataFrame:
        """Each factor's part, and what they leave of the conditions' part."""
        self._need_r2("the loss function")
        return cap.loss_by_factor(self.frame, remainder=True)

    def maximum_information(self) -> DataFrame:
        self._need_r2("maximum information")
        return cap.maximum_information(self.frame)

    def capability_curves(self, lsl=None, usl=None, target=None, points: int = 101) -> DataFrame:
        """Normal densities with the observed and the potential mean and sigma, ready to draw over a histogram."""
        return charts.normal_curves(self.capability(lsl, usl, target), {"observed": ("y_bar", "sigma")} | ({"potential": ("potential_mean", "sigma_R2")} if self.has_residuals and not self.r2_unavailable else {}), points)

    def r2_histogram(self, bins: int | None = None) -> DataFrame:
        """Bins of R2 with their counts and percentages."""
        self._need_r2("maximum information")
        return cap.r2_histogram(self.frame, bins)

    def _need_r2(self, what: str) -> None:
        if not self.has_residuals or self.r2_unavailable:
            raise ChartNotAvailableError(what, self.r2_unavailable or "it needs factors and a time")

    def effects(self) -> dict[str, DataFrame]:
        self._need_r2("effects")
        return {"main_effect": effects.main_effect(self.frame, "rsg"), **{f: effects.main_effect(self.frame, f) for f in self.spec.factors}, self.spec.time: effects.time_effect(self.frame)}

    def interactions(self) -> dict[str, DataFrame]:
        self._need_r2("interactions")
        out = {"rsg_x_time": effects.condition_by_time(self.frame, self.analytical_design_state.code)}
        if len(self.spec.factors) > 1:
            out["factor_x_factor"] = effects.factor_interaction(self.frame, *self.spec.factors[:2])
        return out

    def with_calibration(self, calibration: Calibration) -> Study:
        out = object.__new__(Study)
        out.__dict__ = {**self.__dict__, "calibrations": {**self.calibrations, calibration.label: calibration}}
        return out

    # Charts

    def execute(self, chart: str | None = None, by: list[str] | None = None, value: str | None = None, *, stratify_by: list[str] | None = None, recentered: bool = False, bins: int | None = None, companion: bool = False, phased: bool = False, n_sigma: float = 3.0, n_mode: str = "actual", calibration: Calibration | str | None = None) -> AnalysisResult:
        if by is not None and stratify_by is not None:
            raise ValidationError("by and stratify_by are the same; give one")
        by = by if by is not None else stratify_by
        name = chart_name(chart) if chart else self.recommended_chart
        if isinstance(calibration, str):
            if calibration not in self.calibrations:
                raise ValidationError(f"no calibration {calibration!r}; there are {', '.join(self.calibrations) or 'none'}")
            calibration = self.calibrations[calibration]
        value = None if value == self.spec.response else value
        request = ChartRequest(name, tuple(by) if by is not None else None, value, recentered, bins, companion, phased, n_sigma, n_mode, calibration)
        self._check(request)
        names = {"Xbar": ("Xbar", "S"), "S": ("S", "Xbar"), "X": ("X", "mR"), "mR": ("mR", "X")}.get(name, (name,)) if companion else (name,)
        make = {"Xbar": self._subgroup, "S": self._subgroup, "X": self._individual, "mR": self._individual, "Histogram": self._histogram}
        return AnalysisResult(self, {n: make[n](replace(request, chart=n)) for n in names})

    def _check(self, q: ChartRequest) -> None:
        spec = self.spec
        sub = q.chart in ("Xbar", "S")
        if q.bins is not None and q.chart != "Histogram":
            raise ValidationError("bins are for Histogram")
        if q.companion and q.chart == "Histogram":
            raise ValidationError("Histogram has no companion")
        if not sub and (q.n_sigma != 3.0 or q.n_mode != "actual"):
            raise ValidationError("n_sigma and n_mode are for Xbar and S")
        if q.n_mode not in ("actual", "average") or q.n_sigma <= 0:
            raise ValidationError("n_mode is actual or average, and n_sigma above 0")
        for c in q.by or ():
            if c not in spec.factors and not (c == spec.time and sub):
                raise FactorNotFoundError(c, list(spec.factors))
        if q.value is not None and q.value not in RESIDUALS:
            raise ValidationError(f"value is {spec.response!r} or one of {', '.join(RESIDUALS)}, not {q.value!r}")
        if q.recentered and (q.value is None or not self.has_residuals):
            raise ValidationError("recentered is for residuals, which need factors and a time")
        why = self.why_not(q.chart, q.value)
        if why:
            raise ChartNotAvailableError(q.chart, why)
        if not sub and q.chart != "Histogram" and spec.factors and q.by is None:
            raise ValidationError(f"{q.chart} of a study with factors needs by: the factors to stratify by, or [] for one stream")
        if q.phased:
            if q.chart == "Histogram" or (sub and (q.value is not None or not q.by or q.by[-1] != spec.time or len(q.by) < 2)):
                raise ValidationError("phased Xbar and S charts are of the response, by factors and then the time")
            if not sub and not [f for f in spec.factors if f not in (q.by or ())]:
                raise ValidationError("phases need a factor that the chart isn't stratified by")
        if q.calibration and (q.phased or self._strata(q)):
            raise CalibrationNotSupportedError("the chart is phased or stratified")

    def _strata(self, q: ChartRequest) -> list[str]:
        if q.chart in ("Xbar", "S"):
            return ["rsg"] if list(q.by or ()) == [self.spec.time] and self.spec.factors and q.value is None else []
        return list(q.by) if q.by else []

    def _value(self, q: ChartRequest) -> tuple[DataFrame, str, str]:
        """Rows, the plotted column and the column that limits come from."""
        if q.value is None:
            return self.base, self.spec.response, self.spec.response
        rows = self.frame.rows
        if q.value == "R6":
            by = [c for c in q.by or () if c in self.spec.factors] or (list(self.spec.factors) if len(self.spec.factors) == 1 else [])
            if not by:
                raise ValidationError("R6 needs by: the factors whose levels it is of")
            rows = prepare.r6(self.frame, by)
        name = q.value.replace("R", "RCR") if q.recentered else q.value
        basis = "R2" if q.value in EFFECT_RESIDUALS else name
        return rows, name, basis

    def _subgroup(self, q: ChartRequest) -> Chart:
        spec = self.spec
        rows, value, basis = self._value(q)
        factors, time, by = list(spec.factors), spec.time, list(q.by or ())
        strata, point, label = self._strata(q), None, None
        response = q.value is None
        if strata:
            keys = ["rsg", time]
        elif not by or (set(by) == {*factors, time} and time and factors):
            keys = self.frame.keys
            if not keys:
                raise ChartNotAvailableError(q.chart, "it needs factors or a time")
            label = "group" if not by else "subgroup"
            label = label if len(keys) > 1 else None
        elif by == factors:
            keys, point = ["rsg"], "Ybar_k" if response else None
        else:
            keys, label = by, "subgroup" if len(by) > 1 else None
        if q.phased:
            strata = [c for c in by if c != time]
            keys, point, label = by, None, "subgroup"
        sub = charts.subgroups(rows, keys, value, basis)
        if point:  # a condition's point is the unweighted mean of its cell means
            means = self.frame.cells.select(prepare.label(self.frame.cells, factors, spec.delimiter).alias("rsg"), point).distinct()
            sub = sub.join(means, "rsg").withColumn("xbar", F.col(point)).drop(point)
        center = None
        if not strata and response and spec.factors and time:
            center = F.col("_center")
            sub = sub.crossJoin(self.frame.cells.agg(F.first("Ybar").alias("_center")))
        if not strata and q.value in EFFECT_RESIDUALS or (not strata and q.value == "R2"):
            grain = {"R1": self.frame.keys, "R2": self.frame.keys, "R3": self.frame.keys, "R4": [time], "R5": factors}[q.value]
            one = rows.groupBy(*grain).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("_center"))
            center = F.col("_center")
            sub = sub.crossJoin(one)
        if q.calibration:
            return self._calibrated_subgroup(q, sub, value)
        make = charts.xbar_chart if q.chart == "Xbar" else charts.s_chart
        args = {"center": center} if q.chart == "Xbar" else {}
        out = make(sub, strata, m=q.n_sigma, n_mode=q.n_mode, **args)
        phases = None
        if q.phased:
            numbers = charts.phase_numbers(rows, [], strata)
            out = out.join(numbers, strata)
            phases = self._phase_table(sub, strata, q).join(numbers, strata)
        if label:
            out = out.withColumn(label, prepare.label(out, [c for c in keys if c in out.columns], spec.delimiter))
        order = ["phase", time] if q.phased else keys
        return Chart(q, out, charts.chart_statistics(out, ["phase"] if q.phased else strata), {"Xbar": "xbar", "S": "s"}[q.chart], ["phase"] if q.phased else strata, order, phases, {"n_sigma": q.n_sigma, "n_mode": q.n_mode, "value_col": value, "stratified": bool(strata) and not q.phased, "phased": q.phased})

    def _phase_table(self, sub: DataFrame, strata: list[str], q: ChartRequest) -> DataFrame:
        one = charts.fit(sub, strata)
        return one.select(*strata, "subgroups", F.col("n_max").alias("N"), F.col("xbar_bar").alias("center"), "s_bar", F.when(F.col("n_min") == F.col("n_max"), F.col("s_bar") / c4_col(F.col("n_max"))).otherwise(F.col("sigma_hat")).alias("sigma_hat"))

    def _calibrated_subgroup(self, q: ChartRequest, sub: DataFrame, value: str) -> Chart:
        c = q.calibration
        mean = 0.0 if q.value and not q.recentered else c.mean
        n = F.col("n")
        if q.chart == "Xbar":
            mid, half = F.lit(mean), q.n_sigma * c.sigma / F.sqrt(n)
            lo, hi, col = mid - half, mid + half, "xbar"
        else:
            from variq.functions.limits import b3_col, b4_col

            mid = c4_col(n) * c.sigma
            lo, hi, col = b3_col(n, q.n_sigma) * mid, b4_col(n, q.n_sigma) * mid, "s"
            sub = sub.filter("n >= 2")
        keys = [x for x in sub.columns if x not in ("xbar", "s", "n", "_center")]
        out = sub.select(*keys, n.cast("long").alias("n"), rounded(F.col(col)).alias(col), rounded(mid).alias("center"), rounded(lo).alias("lpl"), rounded(hi).alias("upl"), beyond(F.col(col), lo, hi).alias("beyond_limits"))
        return Chart(q, out, charts.chart_statistics(out, []), col, [], keys, None, {"limits_source": "calibrated", "value_col": value})

    def _stream(self, q: ChartRequest, rows: DataFrame, value: str, source: str) -> tuple[DataFrame, list[str], list[str]]:
        """Rows in order with mr; the columns whose values part streams; the strata."""
        strata = list(q.by or ())
        rows = rows.filter(F.col(source).isNotNull() | F.col(value).isNotNull())
        streams = list(strata)
        if q.phased:
            collapsed = [f for f in self.spec.factors if f not in strata]
            rows = rows.join(charts.phase_numbers(rows, strata, collapsed), [*strata, *collapsed])
            streams = [*strata, "phase"]
        blocks = [k for k in self.frame.keys if k not in strata]
        if self.frame.keys:
            rows = positions(rows.drop("sort_key"), streams, blocks, ["obs_id"], like=self.base)
        else:
            rows = prepare.canonical(rows.drop("sort_key"), self.spec, streams, like=self.base)
        return charts.moving_ranges(rows, streams, "sort_key", source), streams, strata

    def _individual(self, q: ChartRequest) -> Chart:
        rows, value, _ = self._value(q)
        source = q.value if q.value and q.recentered else value
        moved, streams, strata = self._stream(q, rows, value, source)
        spec = self.spec
        shown = [*([spec.time] if spec.time else []), *(["rsg"] if spec.factors else []), *strata, *(["phase"] if q.phased else []), "obs_id", "sort_key"]
        if q.phased:  # a phase of one point has a moving range of 0
            size = moved.groupBy(*streams).agg(F.count("*").alias("_size"))
            moved = moved.join(size, streams).withColumn("mr", F.when(F.col("_size") == 1, F.lit(0.0)).otherwise(F.col("mr"))).drop("_size")
        if q.calibration:
            c = q.calibration
            mean = 0.0 if q.value and not q.recentered else c.mean
            mid, lo, hi = calibrated(q.chart, mean, c.sigma)
            col = value if q.chart == "X" else "mr"
            held = moved if q.chart == "X" else moved.filter("mr is not null")
            out = held.select(*shown, rounded(F.col(col)).alias(col), rounded(F.lit(mid)).alias("center"), rounded(F.lit(lo)).alias("lpl"), rounded(F.lit(hi)).alias("upl"), beyond(F.col(col), F.lit(lo), F.lit(hi)).alias("beyond_limits"))
        elif q.chart == "X":
            out, col = charts.x_chart(moved.filter(F.col(value).isNotNull()), streams, value, shown), value
        else:
            out, col = charts.mr_chart(moved, streams, shown, drop_first=not q.phased), "mr"
        stats = out.withColumn("n", F.lit(1 if q.chart == "X" else 2))
        phases = None
        if q.phased:
            phases = charts.individual_fit(moved, streams, value)
        few = charts.insufficient(rows.filter(F.col(value).isNotNull()), streams, 2 if q.chart == "X" else 3) if strata and not q.phased else None
        return Chart(q, out, charts.chart_statistics(stats, streams), col, streams, ["sort_key"], phases, insufficient=few, metadata={"value_col": value, "stratified": bool(strata), "phased": q.phased, "limits_source": "calibrated" if q.calibration else "data"})

    def _histogram(self, q: ChartRequest) -> Chart:
        rows, value, _ = self._value(q)
        by = list(q.by or ())
        shown = list(dict.fromkeys([value, *by, *(["rsg"] if self.spec.factors else [])]))
        return Chart(q, rows.select(*shown).filter(F.col(value).isNotNull()), charts.histogram_statistics(rows, by, value), value, by, [], None, {"value_col": value, "bins": q.bins}, charts.histogram_bins(rows, by, value, q.bins))

    def supports_calibration(self, chart: str, by: list[str] | None = None, value: str | None = None, phased: bool = False) -> bool:
        q = ChartRequest(chart_name(chart), tuple(by) if by is not None else None, value, phased=phased)
        return q.chart != "Histogram" and not phased and not self._strata(q)



