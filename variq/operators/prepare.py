"""From raw rows to the analysis frame: keys, cells, residuals, order.

Rows are never shuffled for the exact residuals: cell, condition and period means come from one aggregate (one row a
cell, reduced again for conditions and periods) and return by an equi-join, which Spark broadcasts when it measures the
cell table as small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variq.operators.ordered import positions, previous
from variq.plans.spec import ColumnNotFoundError, FormulationSpec, ValidationError

RESERVED = ("obs_id", "rsg", "n", "sort_key", "Ybar_kt", "Ybar_k", "Ybar_t", "Ybar", "R1", "R2", "R3", "R4", "R5", "R6", "RCR1", "RCR2", "RCR3", "RCR4", "RCR5", "RCR6")


def validate(df: DataFrame, spec: FormulationSpec) -> None:
    """Typed errors for columns that are missing, in two roles, not numeric or of a reserved name."""
    for c in (spec.response, *spec.factors, *([spec.time] if spec.time else []), *([spec.obs_id] if spec.obs_id else [])):
        if c not in df.columns:
            raise ColumnNotFoundError(c, df.columns)
    kind = df.schema[spec.response].dataType
    if not isinstance(kind, T.NumericType | T.BooleanType):
        raise ValidationError(f"the response {spec.response!r} must be numeric, not {kind.simpleString()}")
    if len(set(spec.factors)) < len(spec.factors):
        raise ValidationError("a factor is listed twice")
    if spec.response in spec.factors or spec.response == spec.time:
        raise ValidationError(f"{spec.response!r} can't be the response and a factor or the time")
    used = [c for c in (spec.response, *spec.factors, spec.time) if c in RESERVED]
    if used:
        raise ValidationError(f"the name {used[0]!r} is reserved")


def label(df: DataFrame, columns: tuple[str, ...] | list[str], delimiter: str | None = "_") -> Column:
    """The columns' values as one string; without a delimiter as a JSON list, which is different for different values."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.concat_ws(delimiter, *parts) if delimiter is not None else F.to_json(F.array(*parts))


def ambiguous(cells: DataFrame, spec: FormulationSpec) -> bool:
    """Whether two conditions have the same label; one small job on the cell table."""
    seen = cells.agg(F.max(F.greatest(*[F.coalesce(F.col(f).cast("string").contains(spec.delimiter), F.lit(False)) for f in spec.factors])).alias("any")).first()["any"]
    if not seen:
        return False
    r = cells.agg(F.count_distinct(F.struct(*spec.factors)), F.count_distinct(label(cells, spec.factors, spec.delimiter))).first()
    return r[0] != r[1]


def natural_key(c: Column) -> Column:
    """A sort key in which runs of digits, however long, compare as numbers: each is led by its number of digits."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    digits = lambda x: F.regexp_replace(x, "^0+", "")
    return F.concat_ws("\u0001", F.transform(parts, lambda x: F.when(x.rlike(r"^\d+$"), F.concat(F.lpad(F.length(digits(x)).cast("string"), 9, "0"), digits(x))).otherwise(x)))


@dataclass
class Frame:
    """The analysis frame and the small tables that it was made of."""

    spec: FormulationSpec
    rows: DataFrame  # obs_id, response, factors, time, rsg, n [, means and residuals]
    cells: DataFrame  # one row a (factors, time) cell: n, Ybar_kt, V, Ybar_k, Ybar_t, Ybar and counts
    sums: DataFrame  # the same without what comes from other cells
    base: DataFrame  # rows before anything was joined to them
    r2_method: str | None = None  # exact, ma2, or None without factors and time

    @property
    def keys(self) -> list[str]:
        return list(dict.fromkeys([*self.spec.factors, *([self.spec.time] if self.spec.time else [])]))


def tidy(df: DataFrame, spec: FormulationSpec) -> DataFrame:
    """obs_id, response (double, NaN as null), factors, time and rsg of the rows without a null among them.

    obs_id decides the order within a cell. Spark rows have none of their own: name a column, or the order of reading
    is used, which is only defined for a source that is read in order.
    """
    validate(df, spec)
    y = F.col(spec.response).cast("double")
    keep = list(dict.fromkeys([*spec.factors, *([spec.time] if spec.time else [])]))
    identity = F.col(spec.obs_id) if spec.obs_id else F.monotonically_increasing_id() + 1
    out = df.select(identity.alias("obs_id"), F.when(F.isnan(y), None).otherwise(y).alias(spec.response), *keep)
    out = out.dropna(subset=[spec.response, *keep])
    return out.withColumn("rsg", label(out, spec.factors, spec.delimiter)) if spec.factors else out


#: What rows get from the cell table.
MEANS = ("n", "Ybar_kt", "Ybar_k", "Ybar_t", "Ybar")


def cell_sums(rows: DataFrame, spec: FormulationSpec) -> DataFrame:
    """One row a cell: n, Ybar_kt and V (variance)."""
    keys = list(dict.fromkeys([*spec.factors, *([spec.time] if spec.time else [])]))
    return rows.groupBy(*keys).agg(F.count(spec.response).alias("n"), F.avg(spec.response).alias("Ybar_kt"), F.var_samp(spec.response).alias("V"))


def cell_table(cells: DataFrame, spec: FormulationSpec) -> DataFrame:
    """cell_sums with the unweighted means of cell means by condition, by period and over all.

    c_k, c_t and c: cells of the condition, of the period and of all; h_k, h_t and h: the sums of their 1 / n.
    """
    over = lambda mean, grain: [F.avg("Ybar_kt").alias(mean), F.count("*").alias(f"c{grain}"), F.sum(1 / F.col("n")).alias(f"h{grain}")]
    overall = cells.agg(*over("Ybar", ""))  # one row
    if spec.factors:
        cells = cells.join(cells.groupBy(*spec.factors).agg(*over("Ybar_k", "_k")), list(spec.factors))
    if spec.time:
        cells = cells.join(cells.groupBy(spec.time).agg(*over("Ybar_t", "_t")), spec.time)
    return cells.crossJoin(overall)


def prepare(df: DataFrame, spec: FormulationSpec, persist: bool = False) -> Frame:
    """The frame without residuals. persist: keep the sums of cells, which later plans all start from."""
    rows = tidy(df, spec)
    sums = cell_sums(rows, spec)
    if persist:
        sums = sums.persist()
    cells = cell_table(sums, spec)
    keys = list(dict.fromkeys([*spec.factors, *([spec.time] if spec.time else [])]))
    if not keys:
        return Frame(spec, rows.withColumn("n", F.lit(1)), cells, sums, rows)
    return Frame(spec, rows.join(cells.select(*keys, *[c for c in MEANS if c in cells.columns]), keys), cells, sums, rows)


def scale_factor(cells: DataFrame, factors: tuple[str, ...]) -> DataFrame:
    """One row: c = sqrt((K - 1) / (2 K) (1 - K / (M - 1))); null if K < 2 or M < K + 2."""
    k, m = F.count_distinct(F.struct(*factors)), F.sum("n")
    return cells.agg(k.alias("K"), m.alias("M")).select("K", "M", F.when((F.col("K") >= 2) & (F.col("M") >= F.col("K") + 2), F.sqrt((F.col("K") - 1) / (2 * F.col("K")) * (1 - F.col("K") / (F.col("M") - 1)))).alias("c"))


def canonical(rows: DataFrame, spec: FormulationSpec, streams: list[str] | None = None, name: str = "sort_key", like: DataFrame | None = None) -> DataFrame:
    """Adds each row's position in canonical order: condition by value, then time, then obs_id."""
    keys = list(dict.fromkeys([*spec.factors, *([spec.time] if spec.time else [])]))
    streams = streams or []
    return positions(rows, streams, [k for k in keys if k not in streams], ["obs_id"], name, like)


def residuals(frame: Frame, method: str) -> Frame:
    """Adds R1-R5, RCR1-RCR5 and the row-weighted means of R1.

    method: exact (R2 = deviation from the cell mean; every cell has two readings or more) or ma2 (R2 = scaled
    difference of successive deviations from additivity along the canonical order, over condition bounds too).
    """
    spec, y = frame.spec, F.col(frame.spec.response)
    if not spec.factors or not spec.time:
        raise ValidationError("residuals need factors and a time")
    rows = frame.rows
    kt, k, t, all_ = (F.col(c) for c in ("Ybar_kt", "Ybar_k", "Ybar_t", "Ybar"))
    if method == "exact":
        rows = rows.withColumn("R2", y - kt)
    else:
        rows = canonical(rows, spec, like=frame.base).withColumn("_z", y - k - t + all_)
        rows = previous(rows, [], "sort_key", F.col("_z"), "_before").crossJoin(scale_factor(frame.sums, spec.factors).select("c"))
        rows = rows.withColumn("R2", (F.col("_z") - F.col("_before")) / (2 * F.col("c"))).drop("_z", "_before", "c")
    r2 = F.col("R2")
    rows = rows.withColumns({"R1": y - all_, "R3": kt - k - t + all_ + r2, "R4": t - all_ + r2, "R5": k - all_ + r2})
    rows = rows.withColumns({"RCR1": F.col("R1") + all_, "RCR2": kt + r2, "RCR3": F.col("R3") + all_, "RCR4": F.col("R4") + all_, "RCR5": F.col("R5") + all_})
    return Frame(spec, rows, frame.cells, frame.sums, frame.base, method)


def weighted_means(frame: Frame) -> DataFrame:
    """Rows with Rbar_kt, Rbar_k and Rbar_t, the row-weighted means of R1; from sums and counts of the cell table."""
    spec = frame.spec
    cells = frame.cells.withColumn("_s", (F.col("Ybar_kt") - F.col("Ybar")) * F.col("n"))
    mean = lambda keys, name: cells.groupBy(*keys).agg((F.sum("_s") / F.sum("n")).alias(name))
    table = cells.join(mean(spec.factors, "Rbar_k"), list(spec.factors)).join(mean([spec.time], "Rbar_t"), spec.time)
    table = table.select(*frame.keys, (F.col("_s") / F.col("n")).alias("Rbar_kt"), "Rbar_k", "Rbar_t")
    return frame.rows.join(table, frame.keys)


def r6(frame: Frame, by: list[str]) -> DataFrame:
    """Rows with R6 = mean of (R5 - R2) over the level's rows + R2, and RCR6 = Ybar + that mean + R2."""
    alpha = frame.rows.filter(F.col("R5").isNotNull()).groupBy(*by).agg(F.avg(F.col("R5") - F.col("R2")).alias("_alpha"))
    rows = frame.rows.join(alpha, by, "left")
    return rows.withColumns({"R6": F.col("_alpha") + F.col("R2"), "RCR6": F.col("Ybar") + F.col("_alpha") + F.col("R2")}).drop("_alpha")
