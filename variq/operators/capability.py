"""Capability, loss decomposition and maximum information: each one row, from one or two aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from variq.functions.limits import D2, E2, c4_col
from variq.operators.charts import histogram_bins, individual_fit, moving_ranges
from variq.operators.ordered import positions
from variq.operators.prepare import Frame
from variq.plans.spec import SpecLimits, ValidationError

FEWEST, FEW = 8, 30  # readings of a window: an error below, a warning below


def _side(gap: Column, sigma: Column) -> Column:
    """gap / (3 sigma); infinite, with the gap's sign, when there is no spread."""
    return F.when(sigma > 0, gap / F.when(sigma > 0, 3 * sigma)).when(gap == 0, F.lit(float("nan"))).otherwise(F.signum(gap) * F.lit(float("inf")))


def indices(mean: Column, sigma: Column, limits: SpecLimits, names: tuple[str, str, str, str]) -> dict[str, Column]:
    """Overall, upper and lower index and the smaller one of those that exist."""
    lo = _side(mean - limits.lsl, sigma) if limits.lsl is not None else F.lit(None).cast("double")
    hi = _side(limits.usl - mean, sigma) if limits.usl is not None else F.lit(None).cast("double")
    both = _side(F.lit((limits.usl - limits.lsl) / 2), sigma) if limits.is_two_sided else F.lit(None).cast("double")
    return dict(zip(names, (both, hi, lo, F.least(hi, lo)), strict=True))


def outside(c: Column, limits: SpecLimits, names: tuple[str, str], where: Column | None = None) -> list[Column]:
    """Percent of readings strictly below and above."""
    where = F.lit(True) if where is None else where
    n = F.count_if(c.isNotNull() & where)
    share = lambda flag: F.try_divide(100.0 * F.count_if(flag & where), n)
    none = F.lit(None).cast("double")
    return [(share(c < limits.lsl) if limits.lsl is not None else none).alias(names[0]), (share(c > limits.usl) if limits.usl is not None else none).alias(names[1])]


def in_window(frame_rows: DataFrame, time: str, window: tuple) -> Column:
    """Whether a row's time lies in the half-open window [start, end); None is open."""
    start, end = window
    kind = frame_rows.schema[time].dataType
    out = F.lit(True)
    if start is not None:
        out &= F.col(time) >= F.lit(start).cast(kind)
    if end is not None:
        out &= F.col(time) < F.lit(end).cast(kind)
    return out


def capability(frame: Frame, limits: SpecLimits, window: tuple | None = None) -> DataFrame:
    """One row: observed indices (from all readings, or those in the window) and potential ones (from R2).

    The process mean is the mean of cell means. The potential uses R2 of the whole study around the window's mean.
    """
    spec, rows = frame.spec, frame.rows
    if window and not spec.time:
        raise ValidationError("a window needs a time")
    inside = in_window(rows, spec.time, window) if window else F.lit(True)
    y = F.col(spec.response)
    held = F.when(inside, y)
    has_r2 = "R2" in rows.columns
    if window:  # the mean of the window's own cell means: one row
        rows = rows.drop("Ybar").crossJoin(rows.filter(inside).groupBy(*frame.keys).agg(F.avg(y).alias("m")).agg(F.avg("m").alias("Ybar")))
    middle = F.col("Ybar") if frame.keys else None
    aggs = [F.count(held).alias("n"), F.stddev_samp(held).alias("s"), (F.avg(held) if middle is None else F.first("Ybar")).alias("y_bar"), *outside(y, limits, ("pct_below_lsl", "pct_above_usl"), inside)]
    if has_r2:
        potential = middle + F.col("R2")
        aggs += [F.count("R2").alias("n_R2"), F.stddev_samp("R2").alias("s_R2"), F.count(F.when(inside, F.col("R2"))).alias("n_R2_window"), F.stddev_samp(F.when(inside, F.col("R2"))).alias("s_R2_window")]
        aggs += [F.avg(potential).alias("potential_mean"), *outside(potential, limits, ("potential_pct_below", "potential_pct_above"))]
    out = rows.agg(*aggs)
    out = out.withColumn("sigma", F.col("s") / c4_col(F.col("n")))
    out = out.withColumns(indices(F.col("y_bar"), F.col("sigma"), limits, ("pp", "ppu", "ppl", "ppk")))
    if has_r2:
        out = out.withColumns({"sigma_R2": F.col("s_R2") / c4_col(F.col("n_R2")), "sigma_R2_window": F.col("s_R2_window") / c4_col(F.col("n_R2_window"))})
        out = out.withColumns(indices(F.col("potential_mean"), F.col("sigma_R2"), limits, ("cp", "cpu", "cpl", "cpk")))
    return out


def loss(frame: Frame, replicated: bool, target: float | None = None) -> DataFrame:
    """One row: squared-error loss about the target split into centering, unexplained, pdc (conditions), time and
    interaction, each with its percentage, and what pure noise alone would give.

    replicated: every cell has two readings or more. Otherwise the unexplained part is the variance of R2 and the
    interaction what remains (not below 0).
    """
    cells = frame.cells
    square = lambda c: c * c
    n, v, c, h, g = F.col("n"), 1 / F.col("n"), F.col("c"), F.col("h"), F.col("Ybar")
    ck, hk, ct, ht = (F.col(x) for x in ("c_k", "h_k", "c_t", "h_t"))
    # Under noise alone cell means are independent with variance 1 / n (times the unexplained part), and each effect is a
    # weighted sum of them: its variance is the sum of squared weights, each times the 1 / n that it goes with.
    noise_k = square(1 / ck - 1 / c) * hk + square(1 / c) * (h - hk)
    noise_t = square(1 / ct - 1 / c) * ht + square(1 / c) * (h - ht)
    noise_kt = square(1 - 1 / ck - 1 / ct + 1 / c) * v + square(1 / c - 1 / ck) * (hk - v) + square(1 / c - 1 / ct) * (ht - v) + square(1 / c) * (h - hk - ht + v)
    gap = F.col("Ybar_kt") - F.col("Ybar_k") - F.col("Ybar_t") + g
    # Means over conditions and over periods: each cell counts as its share of them. Sums of squares of readings come
    # from those within cells and those of cell means, so the rows aren't read again.
    of_k = lambda x: F.sum(x / ck) / F.sum(1 / ck)
    of_t = lambda x: F.sum(x / ct) / F.sum(1 / ct)
    away = F.col("Ybar_kt") - g
    one = cells.agg(
        F.first(g).alias("y_bar"), F.sum(n).alias("N"), F.round(F.sum(1 / ck)).cast("long").alias("K"), F.round(F.sum(1 / ct)).cast("long").alias("T"), F.avg("V").alias("cell_variance"),
        F.sum(F.when(n > 1, (n - 1) * F.col("V")).otherwise(0.0)).alias("within"), (F.sum(n * square(away)) - square(F.sum(n * away)) / F.sum(n)).alias("between"),
        of_k(square(F.col("Ybar_k") - g)).alias("pdc"), of_t(square(F.col("Ybar_t") - g)).alias("time"), F.avg(square(gap)).alias("cell_interaction"),
        of_k(noise_k).alias("ref_pdc"), of_t(noise_t).alias("ref_time"), F.avg(noise_kt).alias("ref_interaction"),
    )
    one = one.withColumn("variance", F.try_divide(F.col("within") + F.col("between"), F.col("N") - 1))
    if not replicated:
        one = one.crossJoin(frame.rows.agg(F.var_samp("R2").alias("r2_variance")))  # one row each
    aim = F.lit(float(target)) if target is not None else F.col("y_bar")
    one = one.withColumn("target", aim).withColumn("centering", square(F.col("y_bar") - F.col("target")))
    one = one.withColumn("unexplained", F.col("cell_variance") if replicated else F.col("r2_variance"))
    one = one.withColumn("interaction", F.col("cell_interaction") if replicated else F.greatest(F.lit(0.0), F.col("variance") - F.col("pdc") - F.col("time") - F.col("unexplained")))
    parts = ["centering", "unexplained", "pdc", "time", "interaction"]
    one = one.withColumn("total", sum((F.col(p) for p in parts[1:]), F.col(parts[0])))
    one = one.withColumns({f"pct_{p}": F.coalesce(F.try_divide(100 * F.col(p), F.col("total")), F.lit(0.0)) for p in parts})
    ref = {f"ref_{p}": F.col(f"ref_{p}") * F.col("unexplained") for p in ("pdc", "time")} | {"ref_interaction": F.col("ref_interaction") * F.col("unexplained") if replicated else F.lit(None).cast("double")}
    return one.withColumns(ref).select("N", "K", "T", "y_bar", "target", *parts, "total", *[f"pct_{p}" for p in parts], "ref_pdc", "ref_time", "ref_interaction")


def loss_by_factor(frame: Frame, remainder: bool = False) -> DataFrame:
    """(factor, loss): mean squared main effect of each factor, all from one aggregate.

    remainder: also a row `factor_interaction`, what the factors leave of the conditions' part (0 for one factor).
    """
    factors = frame.spec.factors
    # R5 = Ybar_k - Ybar + R2; its sums come from sums of cells where R2 is the deviation from the cell mean.
    effect = frame.rows.select(*factors, "R5").withColumn("_level", F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).cast("string").alias("level")) for f in factors])))
    out = effect.groupBy("_level.factor", "_level.level").agg(F.avg("R5").alias("m")).groupBy("factor").agg(F.avg(F.col("m") * F.col("m")).alias("loss"))
    if not remainder:
        return out
    gap = F.col("Ybar_k") - F.col("Ybar")
    whole = frame.cells.agg((F.sum(gap * gap / F.col("c_k")) / F.sum(1 / F.col("c_k"))).alias("pdc"))
    rest = whole.crossJoin(out.agg(F.sum("loss").alias("taken"))).select(F.lit("factor_interaction").alias("factor"), (F.col("pdc") - F.col("taken") if len(factors) > 1 else F.lit(0.0)).alias("loss"))
    return out.unionByName(rest)


def maximum_information(frame: Frame) -> DataFrame:
    """One row: X and mR statistics of R2 in canonical order and how many readings lie beyond."""
    rows = frame.rows.filter("R2 is not null").select(*frame.keys, "obs_id", "R2")
    moved = moving_ranges(positions(rows, [], frame.keys, ["obs_id"], like=frame.base), [], "sort_key", "R2")
    one = individual_fit(moved, [], "R2").withColumns({"lpl": F.col("x_bar") - E2 * F.col("mr_bar"), "upl": F.col("x_bar") + E2 * F.col("mr_bar"), "sigma_hat": F.col("mr_bar") / D2})
    signals = moved.select("R2").crossJoin(one.select("lpl", "upl")).agg(F.count_if((F.col("R2") < F.col("lpl")) | (F.col("R2") > F.col("upl"))).alias("n_signals"))
    return one.crossJoin(signals).select(F.col("points").alias("n"), F.col("x_bar").alias("r2_mean"), F.col("mr_bar").alias("r2_mR"), "sigma_hat", "lpl", "upl", "n_signals")


def r2_histogram(frame: Frame, bins: int | None = None) -> DataFrame:
    """(bin, left, right, count, percent) of R2."""
    counted = histogram_bins(frame.rows.filter("R2 is not null").select("R2"), [], "R2", bins)
    return counted.crossJoin(counted.agg(F.sum("count").alias("_n"))).withColumn("percent", 100.0 * F.col("count") / F.col("_n")).drop("_n")
