"""Streams against frozen limits: each micro-batch is flagged, and run rules see across batches.

Limits come from a calibration or from a finished study, so a late or early reading never moves them. The state of a
stream is its last readings (at most the rules' look-back), kept by the state store; nothing else grows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from variq.functions.limits import beyond
from variq.operators.signals import RULES, Parameters
from variq.plans.spec import Calibration, ValidationError


def flag(stream: DataFrame, value: str, calibration: Calibration) -> DataFrame:
    """The stream with center, lpl, upl and beyond_limits; stateless, for batch and streaming frames alike."""
    lo, hi = calibration.mean - 3 * calibration.sigma, calibration.mean + 3 * calibration.sigma
    return stream.withColumns({"center": F.lit(calibration.mean), "lpl": F.lit(lo), "upl": F.lit(hi), "beyond_limits": beyond(F.col(value), F.lit(lo), F.lit(hi))})


def windowed(stream: DataFrame, time: str, value: str, by: list[str], every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Subgroups of a stream by event-time window: n, mean and standard deviation; readings later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, every), *by).agg(F.count(value).alias("n"), F.avg(value).alias("xbar"), F.stddev_samp(value).alias("s"))


def run_rules(stream: DataFrame, time: str, value: str, by: str, calibration: Calibration, run: int = 8, rules: tuple[int, ...] = (1, 4)) -> DataFrame:
    """Readings that break a rule, over micro-batches: key, time, value, beyond_limits, run, rules (their numbers), late.

    State a key: its last readings (as many as the widest rule looks back on) and its last time. Readings of a key are
    taken in order of time within a micro-batch; one that is older than a reading of a former batch is tested on its own
    against the limits, marked late, and isn't put into the order any more. Readings without a value are left out.
    """
    unknown = [r for r in rules if r not in RULES]
    if unknown:
        raise ValidationError(f"there is no rule {unknown[0]}")
    p = Parameters(run=run)
    keep = p.look_back - 1

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before, last = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
        rows = pd.concat(batches).dropna(subset=[value]).sort_values(time, kind="stable")
        late = (rows[time].astype("int64") // 1000 < last).to_numpy() if last is not None else np.zeros(len(rows), bool)
        v = rows[value].to_numpy(float)
        broken = {r: np.zeros(len(rows), bool) for r in {*rules, 1, 4}}
        series = np.concatenate([np.array(before, float), v[~late]])
        for r in broken:
            broken[r][~late] = flags(series, r, calibration.mean, calibration.sigma, p)[len(before) :]
        broken[1] |= np.abs(v - calibration.mean) > 3 * calibration.sigma
        if len(rows):
            latest = int(rows[time].astype("int64").max()) // 1000
            state.update((series[-keep:].tolist(), latest if last is None else max(last, latest)))
        names = [[r for r in sorted(rules) if broken[r][k]] for k in range(len(rows))]
        told = np.array([bool(x) for x in names], bool)
        out = pd.DataFrame({by: [key[0]] * len(rows), time: rows[time].to_numpy(), value: v, "beyond_limits": broken[1], "run": broken[4], "rules": names, "late": late})
        yield out[told]

    kinds = dict(stream.dtypes)
    schema = f"{by} {kinds[by]}, {time} {kinds[time]}, {value} double, beyond_limits boolean, run boolean, rules array<int>, late boolean"
    return stream.select(by, time, value).groupBy(by).applyInPandasWithState(step, schema, "readings array<double>, last long", "append", GroupStateTimeout.NoTimeout)


def flags(v: np.ndarray, rule: int, mean: float, sigma: float, p: Parameters) -> np.ndarray:
    """Whether each point of a series ends a pattern of a rule; the batch rules' counterpart for frozen limits."""

    def full(mark: np.ndarray, width: int, count: int) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mark)])
        out = np.zeros(len(mark), bool)
        if len(mark) >= width:
            out[width - 1 :] = total[width:] - total[:-width] >= count
        return out

    def behind(mark: np.ndarray, width: int) -> np.ndarray:
        """All of the last `width` steps, each from a point to the next."""
        return np.concatenate([[False], full(mark, width, width)])[: len(v)]

    z, up = (v - mean) / sigma, np.diff(v)
    a, b = p.a_from, p.b_from
    if rule == 1:
        return np.abs(z) > 3
    if rule == 2:
        return full(z > a, p.zone_a[1], p.zone_a[0]) | full(z < -a, p.zone_a[1], p.zone_a[0])
    if rule == 3:
        return full(z > b, p.zone_b[1], p.zone_b[0]) | full(z < -b, p.zone_b[1], p.zone_b[0])
    if rule == 4:
        return full(z > 0, p.run, p.run) | full(z < 0, p.run, p.run)
    if rule == 5:
        return behind(up > 0, p.trend - 1) | behind(up < 0, p.trend - 1)
    if rule == 6:
        turn = np.concatenate([[False], up[1:] * up[:-1] < 0]) if len(up) else up > 0
        return behind(turn, p.oscillation - 2)
    if rule == 7:
        return full(np.abs(z) < b, p.reduced_variation, p.reduced_variation)
    return full(np.abs(z) >= b, p.avoiding_center, p.avoiding_center)
