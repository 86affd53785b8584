"""What execute returns: charts, their statistics, signals, tables and exports; all lazy."""

from __future__ import annotations

import datetime
import functools
import hashlib
import json
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variq.operators import charts, effects, signals
from variq.operators.ordered import positions
from variq.plans import workbook
from variq.plans.spec import ChartRequest, ValidationError

if TYPE_CHECKING:
    from variq.plans.study import Study

MIN_OBSERVATIONS = 20
ARROWS = {-1: "↓", 0: "", 1: "↑"}


@dataclass
class Chart:
    request: ChartRequest
    data: DataFrame
    statistics: DataFrame
    value_col: str
    strata: list[str]
    order: list[str]
    phases: DataFrame | None = None
    metadata: dict = field(default_factory=dict)
    bins: DataFrame | None = None
    insufficient: DataFrame | None = None  # strata with too few readings

    def ordered(self) -> DataFrame:
        """The data with a dense position from 0 in each stratum."""
        if "sort_key" in self.data.columns:
            return self.data.withColumnRenamed("sort_key", "position")
        blocks = [c for c in self.order if c not in self.strata]
        return positions(self.data, self.strata, blocks[:-1], blocks[-1:], "position") if blocks else positions(self.data, self.strata, [], [self.value_col], "position")

    def focus(self, **levels) -> Chart:
        """One stratum of the chart."""
        unknown = [c for c in levels if c not in self.strata]
        if unknown:
            raise ValidationError(f"{unknown[0]!r} is no stratum column; those are {', '.join(self.strata) or 'none'}")
        pick = lambda df: df.filter(_all(df, levels))
        return Chart(self.request, pick(self.data), pick(self.statistics), self.value_col, [c for c in self.strata if c not in levels], self.order, pick(self.phases) if self.phases is not None else None, {**self.metadata, "focus": levels}, self.bins, pick(self.insufficient) if self.insufficient is not None else None)


def _all(df: DataFrame, levels: dict):
    out = F.lit(True)
    for c, v in levels.items():
        out &= F.col(c) == F.lit(v)
    return out


@dataclass
class SignalResult:
    violations: DataFrame
    flagged: DataFrame
    asked: tuple[int, ...]
    strata: list[str] = field(default_factory=list)

    @functools.cached_property
    def n(self) -> int:
        """Points of the longest stratum; counted when first asked for."""
        return (self.flagged.groupBy(*self.strata).count().agg(F.max("count")).first()[0] or 0) if self.strata else self.flagged.count()

    @property
    def rules(self) -> tuple[int, ...]:
        return signals.applicable(self.asked, self.n)[0]

    @property
    def skipped(self) -> tuple[int, ...]:
        """Rules whose pattern is longer than the chart; they flag nothing."""
        return signals.applicable(self.asked, self.n)[1]

    @property
    def is_partial(self) -> bool:
        return self.n < MIN_OBSERVATIONS or bool(self.skipped)

    @property
    def evaluation_note(self) -> str:
        parts = [f"{self.n} points, fewer than {MIN_OBSERVATIONS}"] if self.n < MIN_OBSERVATIONS else []
        return "; ".join([*parts, *([f"rules {', '.join(map(str, self.skipped))} need more points"] if self.skipped else [])])

    def by_rule(self) -> DataFrame:
        return self.violations.groupBy("rule_number", "rule_name").count()

    def by_observation(self) -> DataFrame:
        return self.violations.groupBy("position").agg(F.collect_list("rule_number").alias("rules"))

    def get_rule_violations(self, rule: int) -> DataFrame:
        return self.violations.filter(F.col("rule_number") == rule)

    def get_observation_violations(self, position: int) -> DataFrame:
        return self.violations.filter(F.col("position") == position)

    def flagged_observations(self) -> DataFrame:
        return self.violations.select("position").distinct()

    def to_json(self, path: str) -> None:
        self.violations.write.mode("overwrite").json(path)

    def to_table(self, path: str) -> None:
        self.violations.write.mode("overwrite").parquet(path)

    def to_excel(self, path: str) -> list[str]:
        """A workbook of the violations and of their numbers by rule, at a path of the driver."""
        return workbook.write(path, {"violations": self.violations, "by_rule": self.by_rule()})


class AnalysisResult:
    def __init__(self, study: Study, made: dict[str, Chart]):
        self.study, self.charts = study, made

    def get_chart(self, name: str | None = None) -> Chart:
        if name is None:
            return next(iter(self.charts.values()))
        found = {k.lower(): v for k, v in self.charts.items()}.get(name.lower())
        if found is None:
            raise ValidationError(f"no chart {name!r} in this result; there are {', '.join(self.charts)}")
        return found

    def statistics(self, name: str | None = None, **levels) -> DataFrame:
        chart = self.get_chart(name)
        return chart.focus(**levels).statistics if levels else chart.statistics

    get_statistics = statistics

    def phase_statistics(self, name: str | None = None) -> DataFrame:
        chart = self.get_chart(name)
        if chart.phases is None:
            raise ValidationError("the chart has no phases")
        return chart.phases

    def iter_charts(self):
        yield from self.charts.items()

    def list_strata(self) -> list:
        """Strata that all charts have (driver; one value a stratum)."""
        sets = [{tuple(r) for r in c.data.select(*c.strata).distinct().collect()} for c in self.charts.values() if c.strata]
        return sorted(set.intersection(*sets)) if sets else []

    def focus(self, **levels) -> AnalysisResult:
        return AnalysisResult(self.study, {k: c.focus(**levels) for k, c in self.charts.items()})

    @property
    def residuals(self) -> DataFrame:
        rows = self.study.frame.rows
        return rows.select(*[c for c in rows.columns if c in ("obs_id", "rsg", *self.study.frame.keys) or (c.startswith("R") and c[1:2].isdigit()) or c.startswith("RCR")])

    def get_residual(self, name: str) -> DataFrame:
        if name not in self.residuals.columns:
            raise ValidationError(f"no residual {name!r}")
        return self.residuals.select("obs_id", name)

    @property
    def effects(self) -> dict[str, DataFrame]:
        return self.study.effects()

    @property
    def interactions(self) -> dict[str, DataFrame]:
        return self.study.interactions()

    def get_signals(self, name: str | None = None) -> DataFrame:
        """Rows beyond the limits; of all charts together if no name is given."""
        pick = [self.get_chart(name)] if name else list(self.charts.values())
        out = None
        for c in pick:
            if "beyond_limits" in c.data.columns:
                one = c.data.filter("beyond_limits <> 0").withColumn("chart", F.lit(c.request.chart))
                out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise ValidationError("a histogram has no limits")
        return out

    def chart_table(self, name: str | None = None, signal_symbols: bool = True) -> DataFrame:
        """Obs, strata, n, value, center, lpl, upl, signal of a chart, Obs counted from 1."""
        c = self.get_chart(name)
        data = c.ordered()
        flag = F.col("beyond_limits")
        signal = F.when(flag == -1, ARROWS[-1]).when(flag == 1, ARROWS[1]).otherwise(ARROWS[0]) if signal_symbols else flag
        n = [F.col("n")] if "n" in data.columns else []
        keys = [k for k in dict.fromkeys([*c.strata, *c.order, "rsg"]) if k in data.columns and k != c.value_col and k != "sort_key"]
        return data.select((F.col("position") + 1).alias("Obs"), *keys, *n, F.col(c.value_col).alias("value"), "center", "lpl", "upl", signal.alias("signal"))

    def detect_signals(self, name: str | None = None, rules=None, **options) -> SignalResult | dict[str, SignalResult]:
        """Run rules over a rounded chart, in each stratum by itself; without a name over all charts, by their names.

        rules: numbers, or standard, extended, all. options: rule_set, parameters, ignore_first_n, ignore_last_n.
        """
        if name is None:
            return {k: self._signals(c, rules, **options) for k, c in self.charts.items() if c.request.chart != "Histogram"}
        return self._signals(self.get_chart(name), rules, **options)

    def _signals(self, c: Chart, rules, *, rule_set: signals.RuleSet | None = None, parameters: signals.Parameters | None = None, ignore_first_n: int = 0, ignore_last_n: int = 0) -> SignalResult:
        if c.request.chart == "Histogram":
            raise ValidationError("a histogram has no limits to test")
        customs = rule_set.customs if rule_set else {}
        if rule_set:
            rules, parameters = tuple(rule_set.rules), signals.Parameters(**rule_set.parameters)
        if isinstance(rules, str):
            if rules not in signals.PRESETS:
                raise ValidationError(f"no preset {rules!r}; there are {', '.join(signals.PRESETS)}")
            rules = signals.PRESETS[rules]
        rules = tuple(rules) if rules is not None else (1,) if c.request.phased else signals.DEFAULTS[c.request.chart]
        data = signals.trim(c.ordered().withColumn("value", F.col(c.value_col)), "position", ignore_first_n, ignore_last_n)
        flagged = signals.flag_rules(data, rules, streams=c.strata, parameters=parameters, customs=customs)
        keep = [*c.strata, "position", *(["obs_id"] if "obs_id" in data.columns else [])]
        return SignalResult(signals.violations(flagged, rules, keep=list(dict.fromkeys(keep)), customs=tuple(customs)), flagged, rules, c.strata)

    def lane_boundaries(self, name: str | None = None, limit: int | None = None) -> DataFrame:
        c = self.get_chart(name)
        data = c.ordered()
        if "rsg" not in data.columns:
            raise ValidationError("lanes need factors")
        return charts.lane_boundaries(data, c.strata, "position", F.col("rsg"), limit)

    def zone_lines(self, name: str | None = None) -> DataFrame:
        """The lines of a chart's zones, ready to draw."""
        return charts.zone_lines(self.get_chart(name).ordered())

    def insufficient_strata(self, name: str | None = None) -> DataFrame:
        """Strata with too few readings for the chart, with their points."""
        c = self.get_chart(name)
        if c.insufficient is None:
            raise ValidationError("the chart has no strata of single readings")
        return c.insufficient

    @property
    def dataset(self) -> DataFrame:
        """All rows that were analysed, with what was computed for them."""
        return self.study.frame.rows

    def summary(self) -> DataFrame:
        """One row a chart and stratum: points, signals beyond the limits, center and limits."""
        out = None
        for name, c in self.charts.items():
            if "beyond_limits" not in c.data.columns:
                continue
            aggs = [F.count("*").alias("points"), F.count_if(F.col("beyond_limits") != 0).alias("signals"), F.max("center").alias("center"), F.min("lpl").alias("lpl"), F.max("upl").alias("upl")]
            one = c.data.groupBy(*c.strata).agg(*aggs) if c.strata else c.data.agg(*aggs)
            stratum = F.concat_ws(", ", *[F.col(k).cast("string") for k in c.strata]) if c.strata else F.lit("")
            one = one.select(F.lit(name).alias("chart"), stratum.alias("stratum"), *[x for x in one.columns if x not in c.strata])
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValidationError("a histogram has no limits")
        return out

    def provenance(self) -> dict:
        """What was analysed, and a fingerprint of the rows that doesn't depend on their order."""
        rows = self.study.frame.rows
        held = rows.select("obs_id", self.study.spec.response, *self.study.frame.keys)
        # 16 sums of 16 bits of the rows' SHA-256 each; the digest of these sums doesn't depend on the rows' order.
        digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in held.columns]), 256)
        words = [F.sum(F.conv(F.substring("_d", 4 * k + 1, 4), 16, 10).cast("long")).alias(f"h{k}") for k in range(16)]
        r = held.select(digest.alias("_d")).agg(F.count("*").alias("n"), *words).first()
        fingerprint = hashlib.sha256(",".join(str(x) for x in r).encode()).hexdigest()
        return {"created": datetime.datetime.now(datetime.UTC).isoformat(), "response": self.study.spec.response, "factors": list(self.study.spec.factors), "time": self.study.spec.time, "rows_analysed": r["n"], "fingerprint": fingerprint, "analytical_state": self.study.analytical_design_state.reason}

    def tables(self, *, residuals: bool = True, dataset: bool = False) -> dict[str, DataFrame]:
        """What an export has: charts, statistics, residuals, effects, interactions and, if asked for, all rows."""
        out = {f"chart_{k}": c.data for k, c in self.charts.items()} | {f"statistics_{k}": c.statistics for k, c in self.charts.items()}
        if self.study.has_residuals and residuals:
            out |= {"residuals": self.residuals, "effects": effects.melted(self.study.frame)} | {f"interaction_{k}": v for k, v in self.interactions.items()}
        return out | ({"full_dataset": self.study.frame.rows} if dataset else {})

    def to_excel(self, path: str, **which) -> list[str]:
        """A workbook of the tables and the provenance at a path of the driver; its sheets."""
        spark = self.study.data.sparkSession
        facts = spark.createDataFrame([(k, str(v)) for k, v in self.provenance().items()], "fact string, value string")
        return workbook.write(path, {**self.tables(**which), "provenance": facts})

    def export(self, path: str, format: str = "parquet", *, residuals: bool = True, dataset: bool = False) -> list[str]:
        """One directory a table (charts, statistics, residuals, effects, provenance) under path; the paths written."""
        written = []
        for name, df in self.tables(residuals=residuals, dataset=dataset).items():
            writer = df.write.mode("overwrite")
            (writer.option("header", True) if format == "csv" else writer).format(format).save(f"{path}/{name}")
            written.append(f"{path}/{name}")
        spark = self.study.data.sparkSession
        spark.createDataFrame([(json.dumps(self.provenance()),)], ["provenance"]).write.mode("overwrite").text(f"{path}/provenance")
        return [*written, f"{path}/provenance"]
