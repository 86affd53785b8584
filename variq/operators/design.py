"""Design states of the condition-by-period grid: from a plan, from the observed rows, from the analysed cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variq.operators.clean import any_date
from variq.plans.spec import FormulationSpec, ValidationError

#: State code to its reason. Fixed values.
REASONS = {1: "full_replication", 2: "no_replication", 3: "partial_replication", 4: "incomplete_no_singletons", 5: "incomplete_no_replication", 6: "incomplete_with_singletons"}
#: Tokens that mean missing in structure columns. Fixed values.
NA_TOKENS = ["*", "na", "n/a", "nan", "null", "none", ""]


def na_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null for blank values and for words that mean missing, in string columns."""
    text = [c for c in columns if dict(df.dtypes)[c] == "string"]
    return df.withColumns({c: F.when(F.lower(F.trim(c)).isin(NA_TOKENS), None).otherwise(F.col(c)) for c in text}) if text else df


def occupied(df: DataFrame, spec: FormulationSpec) -> DataFrame:
    """N_kt: readings that aren't null of each observed cell (0 if all of a cell's are null)."""
    keys = list(dict.fromkeys([*spec.factors, *([spec.time] if spec.time else [])]))
    y = F.col(spec.response).cast("double")
    view = na_to_null(df.select(*keys, F.when(F.isnan(y), None).otherwise(y).alias("_y")), keys).dropna(subset=keys)
    return view.groupBy(*keys).agg(F.count("_y").alias("N_kt"))


def grid(df: DataFrame, spec: FormulationSpec, plan: DataFrame | None = None) -> DataFrame:
    """N_kt over observed conditions x observed periods (or over the plan's cells); absent cells count 0.

    The cross join is of distinct conditions and distinct periods: the grid that is asked for, one row a cell.
    """
    cells = occupied(df, spec)
    keys = [c for c in cells.columns if c != "N_kt"]
    if plan is None:
        times = [spec.time] if spec.time and spec.time not in spec.factors else []
        parts = [cells.select(*x).distinct() for x in (list(spec.factors), times) if x]
        plan = parts[0] if len(parts) == 1 else parts[0].crossJoin(parts[1])
    return plan.select(*keys).join(cells, keys, "left").fillna(0, subset=["N_kt"])


def classify(cells: DataFrame, n: str = "N_kt") -> DataFrame:
    """One row: state, reason and the numbers behind them. With empty cells, all-single comes before some-single."""
    out = cells.agg(F.count("*").alias("n_cells"), F.min(n).alias("min_n"), F.max(n).alias("max_n"), F.count_if(F.col(n) == 1).alias("n_single"), F.count_if(F.col(n) == 0).alias("n_empty"))
    full = F.col("n_empty") == 0
    state = (
        F.when(F.coalesce(F.col("max_n"), F.lit(0)) == 0, F.when(F.lit(True), 4))
        .when(full & (F.col("min_n") >= 2), 1).when(full & (F.col("max_n") == 1), 2).when(full, 3)
        .when(F.col("max_n") == 1, 5).when(F.col("n_single") > 0, 6).otherwise(4)
    )
    out = out.withColumn("state", state)
    return out.withColumn("reason", F.get(F.array(*[F.lit(REASONS[k]) for k in range(1, 7)]), F.col("state") - 1))


def observed_state(df: DataFrame, spec: FormulationSpec, plan: DataFrame | None = None) -> DataFrame:
    return classify(grid(df, spec, plan))


def analytic_state(cells: DataFrame) -> DataFrame:
    """Over occupied cells only, so it is 1, 2 or 3."""
    return classify(cells.filter("n > 0"), "n")


def plan_state(levels: dict[str, list], periods: int, n: int) -> tuple[int, str]:
    """Of a uniform plan: replicated or not."""
    if periods < 1 or n < 1 or not all(levels.values()):
        raise ValidationError("a plan needs at least one level a factor, one period and one reading a cell")
    state = 1 if n >= 2 else 2
    return state, REASONS[state]


def typed_levels(spark, name: str, values: list, schema: T.StructType | None = None) -> DataFrame:
    """One column of a plan's distinct levels, in the type that the data's column has (its text in the plan may differ)."""
    out = spark.createDataFrame([(None if v is None else str(v),) for v in values], f"`{name}` string")
    kind = schema[name].dataType if schema is not None and name in schema.names else None
    if kind is None:
        return spark.createDataFrame([(v,) for v in values], [name]).distinct()
    if isinstance(kind, T.DateType | T.TimestampType):
        out = out.withColumn(name, any_date(F.col(name)))
    return out.select(F.col(name).try_cast(kind).alias(name) if not isinstance(kind, T.StringType) else F.trim(name).alias(name)).distinct()


def plan_cells(spark, levels: dict[str, list], time: str | None, times: list | None, schema: T.StructType | None = None) -> DataFrame:
    """The cells of a plan: a cross product of its level lists, in the types of `schema`."""
    out = None
    for name, values in [*levels.items(), *([(time, times)] if time and times else [])]:
        one = typed_levels(spark, name, values, schema)
        out = one if out is None else out.crossJoin(one)
    return out


def r2_method(ads: int) -> str:
    """One single reading anywhere makes the whole study use scaled differences."""
    return "exact" if ads == 1 else "ma2"


#: State to (valid charts, recommended). Fixed values.
CHARTS = {1: (("Xbar", "S", "X", "mR", "Histogram"), "Xbar"), 2: (("X", "mR", "Histogram"), "X"), 3: (("Xbar", "S", "X", "mR", "Histogram"), "Xbar")}


def residual_charts(min_cell: int) -> dict[str, tuple[str, ...]]:
    """Charts of each residual besides mR and Histogram, which fit all."""
    single = min_cell < 2
    return {"R1": ("Xbar", "X"), "R2": ("X",) if single else ("S", "X"), "R3": ("Xbar", "S", "X") if single else ("Xbar", "S"), "R4": ("Xbar", "S"), "R5": ("Xbar", "S"), "R6": ("Xbar", "S")}


def _first(combos: DataFrame, limit: int | None) -> DataFrame:
    return combos if limit is None else combos.orderBy(*combos.columns).limit(limit)


def missing_combos(cells: DataFrame, plan: DataFrame, limit: int | None = None) -> DataFrame:
    """Planned combinations that were never observed; with a limit, the first ones in order."""
    return _first(plan.distinct().join(cells.select(*plan.columns), plan.columns, "left_anti"), limit)


def extra_combos(cells: DataFrame, plan: DataFrame, limit: int | None = None) -> DataFrame:
    """Observed combinations that weren't planned; with a limit, the first ones in order."""
    return _first(cells.select(*plan.columns).distinct().join(plan, plan.columns, "left_anti"), limit)


def coverage(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """One row: planned cells that were observed, planned cells, their ratio."""
    both = plan.distinct().join(cells.filter("N_kt > 0").select(*plan.columns).withColumn("_seen", F.lit(1)), plan.columns, "left")
    return both.agg(F.count("_seen").alias("observed"), F.count("*").alias("planned")).withColumn("coverage", F.try_divide("observed", "planned"))


def nested_in_time(df: DataFrame, factors: list[str], time: str) -> DataFrame:
    """One row a factor: whether no period has more than one of its levels."""
    counts = df.dropna(subset=[time]).groupBy(time).agg(*[F.count_distinct(f).alias(f) for f in factors])
    return counts.agg(*[F.max(f).alias(f) for f in factors]).select(F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), (F.col(f) <= 1).alias("nested")) for f in factors])).alias("x")).select("x.*")


def report(cells: DataFrame, spec: FormulationSpec) -> DataFrame:
    """One row of design metrics over the observed cells: K, T, R, N, singles."""
    out = cells.agg(
        (F.count_distinct(F.struct(*spec.factors)) if spec.factors else F.lit(1)).alias("K"),
        (F.count_distinct(spec.time) if spec.time else F.lit(1)).alias("T"),
        F.count("*").alias("R"), F.sum("n").alias("N"), F.min("n").alias("n_min"), F.percentile("n", F.lit(0.5)).alias("n_median"), F.max("n").alias("n_max"), F.count_if(F.col("n") == 1).alias("n_single"), F.sum(F.col("n") - 1).alias("df_within"),
    )
    return out.withColumn("empty", F.col("K") * F.col("T") - F.col("R"))


def period_spread(cells: DataFrame, spec: FormulationSpec) -> DataFrame:
    """One row: the largest difference between conditions in the mean rank of the periods that they were observed in."""
    ranks = cells.select(spec.time).distinct().withColumn("_rank", F.row_number().over(Window.orderBy(spec.time)))  # one row a period
    mean = cells.join(ranks, spec.time).groupBy(*spec.factors).agg(F.avg("_rank").alias("m"))
    return mean.agg((F.max("m") - F.min("m")).alias("period_spread"))


def level_report(cells: DataFrame, levels: dict[str, list]) -> DataFrame:
    """(factor, level, planned, observed) of every planned or observed level of each planned factor."""
    spark, out = cells.sparkSession, None
    for name, values in levels.items():
        plan = typed_levels(spark, name, values, cells.schema).select(F.col(name).cast("string").alias("level")).withColumn("planned", F.lit(True))
        seen = cells.select(F.col(name).cast("string").alias("level")).distinct().withColumn("observed", F.lit(True))
        one = plan.join(seen, "level", "full").select(F.lit(name).alias("factor"), "level", F.coalesce("planned", F.lit(False)).alias("planned"), F.coalesce("observed", F.lit(False)).alias("observed"))
        out = one if out is None else out.unionByName(one)
    return out


def adherence(cells: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """One row: planned cells, those with at least n readings, with fewer, with none, and what would mend it."""
    both = plan.distinct().join(cells.select(*plan.columns, "n"), plan.columns, "left").fillna(0, subset=["n"])
    out = both.agg(F.count("*").alias("planned"), F.count_if(F.col("n") >= n).alias("complete"), F.count_if((F.col("n") > 0) & (F.col("n") < n)).alias("short"), F.count_if(F.col("n") == 0).alias("empty"), F.sum(F.greatest(F.lit(n) - F.col("n"), F.lit(0))).alias("readings_missing"))
    text = F.when(F.col("readings_missing") == 0, "none needed").otherwise(F.concat(F.lit("collect "), F.col("readings_missing").cast("string"), F.lit(" readings in "), (F.col("short") + F.col("empty")).cast("string"), F.lit(" cells")))
    return out.withColumn("remediation", text)
