"""Control charts as DataFrame plans.

Subgroup charts (Xbar, S) are a two-level aggregate: rows to subgroups, subgroups to one fit per stratum, which is
joined back. Strata, phases and the plain chart differ only in the columns that a fit is grouped by, so nothing loops
over groups. Individual charts (X, mR) take the difference to the row before in each stream; a stream's rows are spread
over buckets of its positions, so one long stream needs no single task.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variq.functions.limits import D4, E2, b3_col, b4_col, beyond, c4_col, rounded
from variq.operators.ordered import over_stream, quantiles


def subgroups(rows: DataFrame, by: list[str], value: str, limits: str | None = None) -> DataFrame:
    """One row a subgroup: xbar, s and n. s and n come from the limits column."""
    limits = limits or value
    return rows.groupBy(*by).agg(F.avg(value).alias("xbar"), F.stddev_samp(limits).alias("s"), F.count(limits).alias("n")).filter("n > 0")


def fit(sub: DataFrame, strata: list[str]) -> DataFrame:
    """One row a stratum: center (mean of subgroup means), s_bar and sigma_hat over subgroups of two or more, sizes."""
    two = F.col("n") >= 2
    s = F.when(two, F.col("s"))
    aggs = [
        F.avg("xbar").alias("xbar_bar"), F.avg(s).alias("s_bar"), F.avg(s / c4_col(F.col("n"))).alias("sigma_hat"), F.count("*").alias("subgroups"),
        F.min("n").alias("n_min"), F.max("n").alias("n_max"), F.min(F.when(two, F.col("n"))).alias("n2_min"), F.max(F.when(two, F.col("n"))).alias("n2_max"), F.avg(F.when(two, F.col("n"))).alias("n_avg"),
    ]
    return sub.groupBy(*strata).agg(*aggs) if strata else sub.agg(*aggs)


def _with_fit(sub: DataFrame, strata: list[str]) -> DataFrame:
    one = fit(sub, strata)
    return sub.join(one, strata) if strata else sub.crossJoin(one)  # a single row


def xbar_chart(sub: DataFrame, strata: list[str], center: Column | None = None, m: float = 3.0, n_mode: str = "actual", digits: int = 3) -> DataFrame:
    """Subgroups with center, lpl, upl and beyond_limits.

    Subgroups of one size: s_bar / c4(n); of several: sigma_hat / sqrt(n) of each. n_mode average: one size, the mean
    one, whose whole part chooses c4. A stratum without a subgroup of two or more has no limits.
    """
    out = _with_fit(sub, strata)
    n = F.col("n_avg") if n_mode == "average" else F.col("n_max").cast("double")
    same = F.lit(True) if n_mode == "average" else F.col("n_min") == F.col("n_max")
    one_size = F.col("s_bar") / c4_col(F.floor(n)) / F.sqrt(n)
    half = m * F.when(same, one_size).otherwise(F.col("sigma_hat") / F.sqrt(F.col("n")))
    mid = F.col("xbar_bar") if center is None else center
    out = out.withColumn("_mid", mid).withColumns({"_lo": F.col("_mid") - half, "_hi": F.col("_mid") + half})
    out = out.withColumn("beyond_limits", beyond(F.col("xbar"), F.col("_lo"), F.col("_hi")))
    shown = [c for c in sub.columns if c not in ("xbar", "s", "n", "_center")]
    return out.select(*shown, F.col("n").cast("long").alias("n"), *[rounded(F.col(a), digits).alias(b) for a, b in (("xbar", "xbar"), ("_mid", "center"), ("_lo", "lpl"), ("_hi", "upl"))], "beyond_limits")


def s_chart(sub: DataFrame, strata: list[str], m: float = 3.0, n_mode: str = "actual", digits: int = 3) -> DataFrame:
    """Subgroups of two or more with s, center (s_bar), lpl, upl and beyond_limits."""
    out = _with_fit(sub.filter("n >= 2"), strata)
    n = F.floor("n_avg") if n_mode == "average" else F.col("n")
    out = out.withColumns({"_lo": b3_col(n, m) * F.col("s_bar"), "_hi": b4_col(n, m) * F.col("s_bar")})
    out = out.withColumn("beyond_limits", beyond(F.col("s"), F.col("_lo"), F.col("_hi")))
    shown = [c for c in sub.columns if c not in ("xbar", "s", "n", "_center")]
    return out.select(*shown, F.col("n").cast("long").alias("n"), *[rounded(F.col(a), digits).alias(b) for a, b in (("s", "s"), ("s_bar", "center"), ("_lo", "lpl"), ("_hi", "upl"))], "beyond_limits")


def chart_statistics(chart: DataFrame, strata: list[str]) -> DataFrame:
    """One row a stratum: N, center, lpl, upl and whether limits vary (then N and limits are null)."""
    aggs = [F.max("n").alias("_n"), F.min("n").alias("_m"), F.max("center").alias("center"), F.max("lpl").alias("_l"), F.max("upl").alias("_u")]
    out = chart.groupBy(*strata).agg(*aggs) if strata else chart.agg(*aggs)
    vary = F.col("_n") != F.col("_m")
    return out.select(*strata, *[F.when(~vary, F.col(a)).alias(b) for a, b in (("_n", "N"),)], "center", F.when(~vary, F.col("_l")).alias("lpl"), F.when(~vary, F.col("_u")).alias("upl"), vary.alias("limits_vary"))


def moving_ranges(rows: DataFrame, streams: list[str], position: str, source: str) -> DataFrame:
    """Rows with mr, the absolute difference to the row before in the stream."""
    return over_stream(rows, streams, position, 1, lambda w: {"mr": F.abs(F.col(source) - F.lag(source).over(w))})


def individual_fit(moved: DataFrame, strata: list[str], value: str) -> DataFrame:
    """One row a stratum: points, mean of the value, mr_bar."""
    aggs = [F.count(value).alias("points"), F.avg(value).alias("x_bar"), F.avg("mr").alias("mr_bar")]
    return moved.groupBy(*strata).agg(*aggs) if strata else moved.agg(*aggs)


def x_chart(moved: DataFrame, strata: list[str], value: str, shown: list[str], digits: int = 3) -> DataFrame:
    """Readings with limits mean -/+ E2 mr_bar; a stratum of one reading has its mean for limits."""
    one = individual_fit(moved, strata, value)
    out = moved.join(one, strata) if strata else moved.crossJoin(one)
    width = E2 * F.coalesce("mr_bar", F.lit(0.0))
    out = out.withColumns({"_lo": F.col("x_bar") - width, "_hi": F.col("x_bar") + width}).withColumn("beyond_limits", beyond(F.col(value), F.col("_lo"), F.col("_hi")))
    return out.select(*shown, *[rounded(F.col(a), digits).alias(b) for a, b in ((value, value), ("x_bar", "center"), ("_lo", "lpl"), ("_hi", "upl"))], "beyond_limits")


def mr_chart(moved: DataFrame, strata: list[str], shown: list[str], digits: int = 3, drop_first: bool = True) -> DataFrame:
    """Moving ranges with center mr_bar and limits 0 and D4 mr_bar; the first of a stratum has none and goes."""
    aggs = F.avg("mr").alias("mr_bar")
    one = moved.groupBy(*strata).agg(aggs) if strata else moved.agg(aggs)
    out = moved.join(one, strata) if strata else moved.crossJoin(one)
    if drop_first:
        out = out.filter("mr is not null")
    out = out.withColumns({"_lo": F.when(F.col("mr_bar").isNotNull(), F.lit(0.0)), "_hi": D4 * F.col("mr_bar")}).withColumn("beyond_limits", beyond(F.col("mr"), F.col("_lo"), F.col("_hi")))
    return out.select(*shown, *[rounded(F.col(a), digits).alias(b) for a, b in (("mr", "mr"), ("mr_bar", "center"), ("_lo", "lpl"), ("_hi", "upl"))], "beyond_limits")


def insufficient(rows: DataFrame, strata: list[str], needed: int) -> DataFrame:
    """(strata, points) of the strata with too few readings for a chart."""
    return rows.groupBy(*strata).agg(F.count("*").alias("points")).filter(F.col("points") < needed)


def zone_lines(chart: DataFrame, position: str = "position") -> DataFrame:
    """(..., sigma, level): the center and the lines at one, two and three sigma on both sides, one row a point and line.

    Where limits vary the lines are stepped: each point has its own.
    """
    each = chart.withColumn("sigma", F.explode(F.array(*[F.lit(k) for k in range(-3, 4)])))
    side = F.when(F.col("sigma") < 0, F.col("center") - F.col("lpl")).otherwise(F.col("upl") - F.col("center"))
    keep = [c for c in chart.columns if c not in ("n", "xbar", "s", "mr", "value", "center", "lpl", "upl", "beyond_limits")]
    return each.select(*keep, "sigma", (F.col("center") + F.col("sigma") / 3 * side).alias("level"))


def phase_numbers(rows: DataFrame, strata: list[str], collapsed: list[str]) -> DataFrame:
    """(strata, collapsed, phase): in canonical order the rows of a combination are contiguous, so a phase is its rank
    among the stratum's distinct combinations; only those are ranked."""
    combos = rows.select(*strata, *collapsed).distinct()
    return combos.withColumn("phase", F.dense_rank().over(Window.partitionBy(*strata).orderBy(*collapsed)))


def lane_boundaries(chart: DataFrame, streams: list[str], position: str, label: Column, limit: int | None = None) -> DataFrame:
    """Positions at which the label changes; with a limit, the first ones of all streams together."""
    moved = over_stream(chart.withColumn("label", label), streams, position, 1, lambda w: {"before": F.lag("label").over(w)})
    out = moved.filter(F.col("before").isNotNull() & (F.col("before") != F.col("label"))).select(*streams, position, "label")
    return out if limit is None else out.orderBy(*streams, position).limit(limit)


def histogram_statistics(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    aggs = [F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n")]
    return rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)


def histogram_bins(rows: DataFrame, by: list[str], value: str, bins: int | None = None) -> DataFrame:
    """Counts of equal bins shared by all groups: bin (0-based), left, right, count; empty bins are listed too.

    bins None: max(5, ceil(1 + log2 n)) of the largest group. The grid of bins is crossed with the groups, one row each.
    """
    part = rows.groupBy(*by).agg(F.count(value).alias("_n")) if by else rows.agg(F.count(value).alias("_n"))
    span = rows.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).crossJoin(part.agg(F.max("_n").alias("_n")))
    count = F.lit(bins) if bins else F.greatest(F.lit(5), F.ceil(1 + F.log2("_n")).cast("int"))
    span = span.filter("_n > 0").select("_lo", ((F.col("_hi") - F.col("_lo")) / count).alias("_w"), count.cast("int").alias("_bins"))
    place = F.least(F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_w"))), F.col("_bins") - 1)
    counted = rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(span)).groupBy(*by, F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("count"))  # span: one row
    grid = span.select(F.explode(F.sequence(F.lit(0), F.col("_bins") - 1)).alias("bin"), "_lo", "_w")
    grid = part.select(*by).crossJoin(grid) if by else grid
    out = grid.join(counted, [*by, "bin"], "left")
    return out.select(*by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("left"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("right"), F.coalesce("count", F.lit(0)).alias("count"))


def quantile_pairs(rows: DataFrame, value: str, points: int = 99) -> DataFrame:
    """(p, quantile, normal): for a normal plot at `points` probabilities from 0.01 to 0.99; normal is the standard
    normal quantile."""
    ps = [0.01 + 0.98 * i / (points - 1) for i in range(points)]
    made = [(p, q, NormalDist().inv_cdf(p)) for p, q in zip(ps, quantiles(rows, value, ps), strict=True)]
    return rows.sparkSession.createDataFrame(made, "p double, quantile double, normal double")


def normal_curves(one: DataFrame, curves: dict[str, tuple[str, str]], points: int = 101) -> DataFrame:
    """(curve, x, density): normal densities from four sigma below to four above the mean. one: a one-row frame; curves:
    name -> its columns of mean and sigma."""
    each = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("curve"), F.col(m).alias("m"), F.col(s).alias("s")) for name, (m, s) in curves.items()])).alias("c")).select("c.*").filter("s > 0")
    z = F.col("k") * (8.0 / (points - 1)) - 4
    placed = each.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("z", z)
    return placed.select("curve", (F.col("m") + F.col("z") * F.col("s")).alias("x"), (F.exp(-F.col("z") * F.col("z") / 2) / (F.col("s") * math.sqrt(2 * math.pi))).alias("density"))
