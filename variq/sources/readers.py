"""Readers that clean what they read, and the demo and synthetic data sets."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variq.plans.spec import ValidationError
from variq.plans.study import Process


def from_frame(data, na_values: list[str] | None = None, spark: SparkSession | None = None) -> Process:
    """A Spark DataFrame, or a pandas one with a session."""
    if isinstance(data, DataFrame):
        return Process(data, na_values)
    if spark is None or not hasattr(data, "columns"):
        raise ValidationError("a Spark DataFrame is needed, or a pandas one and a session")
    return Process(spark.createDataFrame(data), na_values)


def read_csv(spark: SparkSession, path: str, na_values: list[str] | None = None, **options) -> Process:
    return Process(spark.read.options(**({"header": True, "inferSchema": True} | options)).csv(path), na_values)


def read_parquet(spark: SparkSession, path: str, na_values: list[str] | None = None, **options) -> Process:
    return Process(spark.read.options(**options).parquet(path), na_values)


def read_excel(spark: SparkSession, path: str, sheet_name=0, na_values: list[str] | None = None, **options) -> Process:
    """Through pandas on the driver: a workbook is small, and Spark has no reader for it."""
    try:
        import openpyxl  # noqa: F401
        import pandas
    except ImportError as e:
        raise ValidationError("reading a workbook needs pandas and openpyxl") from e
    return Process(spark.createDataFrame(pandas.read_excel(path, sheet_name=sheet_name, **options)), na_values)


def coffee_shop(spark: SparkSession, weeks: int = 16) -> DataFrame:
    """A demo of waiting times: two dayparts, four hours each, six days a week; the last half is faster."""
    hours = F.array(*[F.lit(h) for h in (8, 10, 14, 16)])
    base = spark.range(weeks * 24).select("id", (F.floor(F.col("id") / 24) + 1).cast("int").alias("week"), (F.floor(F.col("id") / 4) % 6).cast("int").alias("d"), F.get(hours, (F.col("id") % 4).cast("int")).alias("hour"))
    noise = (F.pmod(F.xxhash64("id"), F.lit(10_000)) / 10_000.0 - 0.5) * 60
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("week") - 1) * 7 + F.col("d"))
    wait = 220 + F.when(F.col("hour") < 12, 15).otherwise(-15) - F.when(F.col("week") > weeks / 2, 35).otherwise(0) + noise
    return base.select(day.alias("date"), "week", F.date_format(day, "EEEE").alias("day_of_week"), "hour", F.when(F.col("hour") < 12, "morning").otherwise("afternoon").alias("daypart"), F.rint(wait).cast("int").alias("wait_sec"))


#: Design state -> (readings of an occupied cell from, to; sds of time, interaction, noise). Fixed values.
_SHAPES = {1: (2, 3, 1.0, 0.5, 0.4), 2: (1, 1, 1.2, 0.6, 0.4), 3: (3, 3, 1.0, 0.5, 0.5), 4: (2, 3, 1.0, 0.0, 0.4), 5: (1, 1, 1.0, 0.0, 0.4), 6: (3, 3, 1.0, 0.0, 0.5)}


def make_design(state: int, k1: int = 3, k2: int = 2, periods: int = 8, n_min: int | None = None, n_max: int | None = None, seed: int = 0, p_replicated: float = 0.5, p_empty: float = 0.2, p_singleton: float = 0.4, pattern: str = "random") -> list[tuple]:
    """Rows (time, factor 1, factor 2, y) of a design state; empty cells are one row with y None.

    pattern: which cells of state 3 are replicated: at random, early or late periods, a checkerboard, or corners (the
    outer levels of factor 1 and the outer periods, others at random half as often).

    Draws, in order: effects of factor 1, of factor 2, of periods, interactions (states 1 to 3); the empty cells
    (4 and 5: one choice without replacement; 6: one draw a cell); then cell by cell its replication and readings.
    """
    if state not in _SHAPES:
        raise ValidationError("states are 1 to 6")
    lo, hi, sd_t, sd_i, sd = _SHAPES[state]
    chosen = {
        "random": lambda i, j, t: rng.random() < p_replicated,
        "early_times": lambda i, j, t: t < int(periods * p_replicated),
        "late_times": lambda i, j, t: t >= int(periods * (1 - p_replicated)),
        "checkerboard": lambda i, j, t: (i + j + t) % 2 == 0,
        "corners": lambda i, j, t: i in (0, k1 - 1) or t in (0, periods - 1) or rng.random() < p_replicated / 2,
    }
    if pattern not in chosen:
        raise ValidationError(f"no pattern {pattern!r}; there are {', '.join(chosen)}")
    lo, hi = n_min or lo, n_max or hi
    rng = np.random.default_rng(seed)
    one, two, time = rng.normal(0, 2, k1), rng.normal(0, 1.5, k2), rng.normal(0, sd_t, periods)
    inter = rng.normal(0, sd_i, (k1, k2, periods)) if sd_i else np.zeros((k1, k2, periods))
    cells = [(i, j, t) for i in range(k1) for j in range(k2) for t in range(periods)]
    empty: set[int] = set()
    if state in (4, 5):
        empty = set(rng.choice(len(cells), max(1, math.floor(p_empty * len(cells))), replace=False).tolist())
    elif state == 6:
        empty = {c for c in range(len(cells)) if rng.random() < p_empty} or {0}
    rows = []
    for c, (i, j, t) in enumerate(cells):
        names = (t + 1, f"F1_{i + 1}", f"F2_{j + 1}")
        if c in empty:
            rows.append((*names, None))
            continue
        if state == 1:
            n = int(rng.integers(lo, hi + 1))
        elif state == 3:
            n = hi if chosen[pattern](i, j, t) else 1
        elif state == 6:
            n = 1 if rng.random() < p_singleton else hi
        else:
            n = lo if lo == hi else int(rng.integers(lo, hi + 1))
        mu = 50 + one[i] + two[j] + time[t] + inter[i, j, t]
        rows += [(*names, float(mu + e)) for e in rng.normal(0, sd, n)]
    return rows


def synthetic(spark: SparkSession, state: int, **kw) -> DataFrame:
    """make_design as a DataFrame with obs_id, the row's number from 1."""
    rows = [(k + 1, *r) for k, r in enumerate(make_design(state, **kw))]
    return spark.createDataFrame(rows, "obs_id long, time int, `factor 1` string, `factor 2` string, y double")
