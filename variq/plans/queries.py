"""Queries over the process-behaviour operators, and DuckDB SQL that computes the same on its own.

Roles: events (value by event_type over days; every cell has many readings), events by user_id (some cells have one or
none), lineitem (l_quantity by returnflag and linestatus over years), orders (o_totalprice by priority over months).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from variq.functions.limits import c4_col, rounded
from variq.operators import capability as cap
from variq.operators import charts, clean, derive, design, effects, prepare
from variq.operators.ordered import positions
from variq.plans.spec import Calibration, FormulationSpec, SpecLimits
from variq.plans.study import Study

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return keep


def six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n), 6) for n in names})


def R6(x: str) -> str:
    return f"round_even(({x}) * 1000000.0, 0) / 1000000.0"


def R3(x: str) -> str:
    return f"round_even(({x}) * 1000.0, 0) / 1000.0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value", "event_type", "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus", F.year("l_shipdate").alias("year"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month"))


EVENTS = FormulationSpec("value", ("event_type",), "day", "event_id")
USERS = FormulationSpec("value", ("user_id",), "day", "event_id")
ITEMS = FormulationSpec("l_quantity", ("l_returnflag", "l_linestatus"), "year")
ORDERS = FormulationSpec("o_totalprice", ("o_orderpriority",), "month", "o_orderkey")


def study(spark: SparkSession, sf_dir: str, of: str) -> Study:
    make, spec = {"events": (events, EVENTS), "users": (events, USERS), "items": (lineitem, ITEMS), "orders": (orders, ORDERS)}[of]
    return Study(make(spark, sf_dir), spec)


def frame(spark: SparkSession, sf_dir: str, of: str, method: str) -> prepare.Frame:
    make, spec = {"events": (events, EVENTS), "users": (events, USERS), "items": (lineitem, ITEMS), "orders": (orders, ORDERS)}[of]
    return prepare.residuals(prepare.prepare(make(spark, sf_dir), spec), method)


# Shared SQL: rows, cells, unweighted means.


def _means(rows: str, k: str) -> str:
    return f"""r AS ({rows}), c AS (SELECT {k}, t, count(*) AS n, avg(y) AS m, stddev_samp(y) AS s, var_samp(y) AS v FROM r GROUP BY ALL),
ck AS (SELECT {k}, avg(m) AS mk FROM c GROUP BY ALL), ct AS (SELECT t, avg(m) AS mt FROM c GROUP BY t), g AS (SELECT avg(m) AS g FROM c),
j AS (SELECT r.*, c.n, c.m, ck.mk, ct.mt, g.g FROM r JOIN c USING ({k}, t) JOIN ck USING ({k}) JOIN ct USING (t), g)"""


E_ROWS = "SELECT event_id AS id, value AS y, event_type AS k, strftime(ts, '%Y-%m-%d') AS t FROM events WHERE value IS NOT NULL"
U_ROWS = "SELECT event_id AS id, value AS y, user_id AS k, strftime(ts, '%Y-%m-%d') AS t FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL"
I_ROWS = "SELECT l_quantity AS y, l_returnflag AS a, l_linestatus AS b, year(l_shipdate)::INT AS t FROM lineitem"
O_ROWS = "SELECT o_orderkey AS id, o_totalprice AS y, o_orderpriority AS k, strftime(o_orderdate, '%Y-%m') AS t FROM orders"
E_CTE, U_CTE, I_CTE, O_CTE = _means(E_ROWS, "k"), _means(U_ROWS, "k"), _means(I_ROWS, "a, b"), _means(O_ROWS, "k")
C4 = "sqrt(2.0/({n}-1))*exp(lgamma({n}/2.0)-lgamma(({n}-1)/2.0))"
E2, D4 = "(3/1.128)", "(1+3*0.8525/1.128)"
STATE = """SELECT count(*) AS n_cells, min(N_kt) AS min_n, max(N_kt) AS max_n, count(*) FILTER (N_kt = 1) AS n_single, count(*) FILTER (N_kt = 0) AS n_empty FROM x"""
LADDER = "CASE WHEN n_empty = 0 AND min_n >= 2 THEN 1 WHEN n_empty = 0 AND max_n = 1 THEN 2 WHEN n_empty = 0 THEN 3 WHEN max_n = 1 THEN 5 WHEN n_single > 0 THEN 6 ELSE 4 END"
NAMES = "CASE state WHEN 1 THEN 'full_replication' WHEN 2 THEN 'no_replication' WHEN 3 THEN 'partial_replication' WHEN 4 THEN 'incomplete_no_singletons' WHEN 5 THEN 'incomplete_no_replication' ELSE 'incomplete_with_singletons' END"


def _state(x: str) -> str:
    return f"WITH {x}, s AS ({STATE}), z AS (SELECT *, {LADDER} AS state FROM s) SELECT *, {NAMES} AS reason FROM z"


U_GRID = f"r AS ({U_ROWS}), x AS (SELECT a.k, b.t, coalesce(n, 0) AS N_kt FROM (SELECT DISTINCT k FROM r) a CROSS JOIN (SELECT DISTINCT t FROM r) b LEFT JOIN (SELECT k, t, count(*) AS n FROM r GROUP BY ALL) c USING (k, t))"


@query(f"WITH {U_GRID} SELECT k AS user_id, t AS day, N_kt FROM x")
def nkt_cells(spark, sf_dir):
    return design.grid(events(spark, sf_dir), USERS)


@query(_state(U_GRID))
def design_state_ods(spark, sf_dir):
    return design.observed_state(events(spark, sf_dir), USERS)


@query(_state(f"r AS ({U_ROWS}), x AS (SELECT count(*) AS N_kt FROM r GROUP BY k, t)"))
def design_state_ads(spark, sf_dir):
    return design.analytic_state(prepare.prepare(events(spark, sf_dir), USERS).sums)


@query(f"WITH {E_CTE} SELECT k AS event_type, t AS day, n, {R6('m')} AS Ybar_kt, {R6('mk')} AS Ybar_k, {R6('mt')} AS Ybar_t, {R6('g')} AS Ybar FROM c JOIN ck USING (k) JOIN ct USING (t), g")
def cell_means(spark, sf_dir):
    cells = prepare.prepare(events(spark, sf_dir), EVENTS).cells
    return six(cells.select("event_type", "day", *prepare.MEANS), "Ybar_kt", "Ybar_k", "Ybar_t", "Ybar")


@query(f"WITH {E_CTE} SELECT 'condition' AS grain, k AS level, {R6('mk')} AS mean FROM ck UNION ALL SELECT 'period', CAST(t AS VARCHAR), {R6('mt')} FROM ct UNION ALL SELECT 'all', '', {R6('g')} FROM g")
def marginal_means(spark, sf_dir):
    cells = prepare.prepare(events(spark, sf_dir), EVENTS).cells
    out = cells.select(F.lit("condition").alias("grain"), F.col("event_type").alias("level"), F.col("Ybar_k").alias("mean")).distinct()
    out = out.unionByName(cells.select(F.lit("period").alias("grain"), F.col("day").cast("string").alias("level"), F.col("Ybar_t").alias("mean")).distinct())
    return six(out.unionByName(cells.select(F.lit("all").alias("grain"), F.lit("").alias("level"), F.col("Ybar").alias("mean")).distinct()), "mean")


RES = ["R1", "R2", "R3", "R4", "R5"]


def _res_sql(cte: str, r2: str, extra: str = "") -> str:
    return f"WITH {cte}{extra} SELECT id AS event_id, {R6('y - g')} AS R1, {R6(r2)} AS R2, {R6(f'm - mk - mt + g + ({r2})')} AS R3, {R6(f'mt - g + ({r2})')} AS R4, {R6(f'mk - g + ({r2})')} AS R5 FROM {'q' if extra else 'j'}"


@query(_res_sql(E_CTE, "y - m"))
def vas_residuals_exact(spark, sf_dir):
    return six(frame(spark, sf_dir, "events", "exact").rows.select(F.col("obs_id").alias("event_id"), *RES), *RES)


MA2 = """, f AS (SELECT sqrt((K - 1) / (2.0 * K) * (1 - K / (M - 1.0))) AS c FROM (SELECT count(DISTINCT k) AS K, count(*) AS M FROM r)),
q AS (SELECT j.*, (y - mk - mt + g - lag(y - mk - mt + g) OVER (ORDER BY k, t, id)) / (2 * f.c) AS r2 FROM j, f)"""


@query(_res_sql(U_CTE, "r2", MA2))
def vas_residuals_ma2(spark, sf_dir):
    return six(frame(spark, sf_dir, "users", "ma2").rows.select(F.col("obs_id").alias("event_id"), *RES), *RES)


@query(f"WITH {E_CTE}, w AS (SELECT *, y - g AS r1 FROM j) SELECT id AS event_id, {R6('avg(r1) OVER (PARTITION BY k, t)')} AS Rbar_kt, {R6('avg(r1) OVER (PARTITION BY k)')} AS Rbar_k, {R6('avg(r1) OVER (PARTITION BY t)')} AS Rbar_t FROM w")
def weighted_residual_means(spark, sf_dir):
    out = prepare.weighted_means(frame(spark, sf_dir, "events", "exact"))
    return six(out.select(F.col("obs_id").alias("event_id"), "Rbar_kt", "Rbar_k", "Rbar_t"), "Rbar_kt", "Rbar_k", "Rbar_t")


# Xbar and S


def _fit(by: str, strata: str = "") -> str:
    part = f"GROUP BY {strata}" if strata else ""
    keys = f"{strata}, " if strata else ""
    return f"f AS (SELECT {keys}avg(m) AS mm, avg(s) FILTER (n >= 2) AS sb, avg(s / ({C4.format(n='n')})) FILTER (n >= 2) AS sh, min(n) AS lo, max(n) AS hi, min(n) FILTER (n >= 2) AS lo2, avg(n) FILTER (n >= 2) AS na FROM u {part})"


HALF = f"3 * CASE WHEN lo = hi THEN sb / ({C4.format(n='hi')}) / sqrt(hi) ELSE sh / sqrt(n) END"


def _xbar_out(keys: str, center: str, half: str = HALF) -> str:
    return f"SELECT {keys}, n, {R3('m')} AS xbar, {R3(center)} AS center, {R3(f'{center} - ({half})')} AS lpl, {R3(f'{center} + ({half})')} AS upl, CASE WHEN m < {center} - ({half}) THEN -1 WHEN m > {center} + ({half}) THEN 1 ELSE 0 END AS beyond_limits"


@query(f"WITH {I_CTE}, u AS (SELECT * FROM c), {_fit('a, b, t')} {_xbar_out('a AS l_returnflag, b AS l_linestatus, t AS year', 'g')} FROM u, f, g")
def xbar_default(spark, sf_dir):
    return study(spark, sf_dir, "items").execute("Xbar").get_chart().data.drop("group")


@query(f"WITH {I_CTE}, u AS (SELECT a, b, mk AS m, s, n FROM ck JOIN (SELECT a, b, stddev_samp(y) AS s, count(*) AS n FROM r GROUP BY ALL) USING (a, b)), {_fit('a, b')} {_xbar_out(chr(97) + ' || chr(95) || b AS rsg', 'g')} FROM u, f, g")
def xbar_by_factor(spark, sf_dir):
    return study(spark, sf_dir, "items").execute("Xbar", by=["l_returnflag", "l_linestatus"]).get_chart().data


@query(f"WITH {I_CTE}, u AS (SELECT a, avg(y) AS m, stddev_samp(y) AS s, count(*) AS n FROM r GROUP BY a), {_fit('a')} {_xbar_out('a AS l_returnflag', 'g')} FROM u, f, g")
def xbar_by_subset(spark, sf_dir):
    return study(spark, sf_dir, "items").execute("Xbar", by=["l_returnflag"]).get_chart().data


@query(f"WITH {I_CTE}, u AS (SELECT a || '_' || b AS rsg, t, m, s, n FROM c), {_fit('t', 'rsg')} {_xbar_out('rsg, t AS year', 'mm')} FROM u JOIN f USING (rsg)")
def xbar_stratified(spark, sf_dir):
    return study(spark, sf_dir, "items").execute("Xbar", by=["year"]).get_chart().data


AVERAGE = f"3 * sb / ({C4.format(n='floor(na)')}) / sqrt(na)"


@query(f"WITH {O_CTE}, u AS (SELECT * FROM c), {_fit('k, t')} {_xbar_out('k AS o_orderpriority, t AS month', 'g', AVERAGE)} FROM u, f, g")
def xbar_n_average(spark, sf_dir):
    return study(spark, sf_dir, "orders").execute("Xbar", n_mode="average").get_chart().data.drop("group")


def _s_out(keys: str, n: str = "n") -> str:
    c = f"({C4.format(n=n)})"
    lo, hi = f"greatest(0, 1 - 3 / {c} * sqrt(1 - {c} * {c})) * sb", f"(1 + 3 / {c} * sqrt(1 - {c} * {c})) * sb"
    return f"SELECT {keys}, n, {R3('s')} AS s, {R3('sb')} AS center, {R3(lo)} AS lpl, {R3(hi)} AS upl, CASE WHEN s < {lo} THEN -1 WHEN s > {hi} THEN 1 ELSE 0 END AS beyond_limits"


@query(f"WITH {I_CTE}, u AS (SELECT * FROM c WHERE n >= 2), {_fit('a, b, t')} {_s_out('a AS l_returnflag, b AS l_linestatus, t AS year')} FROM u, f")
def s_default(spark, sf_dir):
    return study(spark, sf_dir, "items").execute("S").get_chart().data.drop("group")


@query(f"WITH {I_CTE}, u AS (SELECT a || '_' || b AS rsg, t, m, s, n FROM c WHERE n >= 2), {_fit('t', 'rsg')} {_s_out('rsg, t AS year')} FROM u JOIN f USING (rsg)")
def s_stratified(spark, sf_dir):
    return study(spark, sf_dir, "items").execute("S", by=["year"]).get_chart().data


RESIDUAL_U = "u AS (SELECT k, t, avg({r}) AS m, stddev_samp(y - m) AS s, count(*) AS n FROM j GROUP BY k, t)"


@query(f"WITH {E_CTE}, {RESIDUAL_U.format(r='y - m')}, f AS (SELECT avg(s) AS sb FROM u WHERE n >= 2) {_s_out('k AS event_type, t AS day')} FROM u, f WHERE n >= 2")
def s_of_r2(spark, sf_dir):
    return study(spark, sf_dir, "events").execute("S", value="R2").get_chart().data.drop("group")


@query(f"WITH {E_CTE}, {RESIDUAL_U.format(r='mk - g + (y - m)')}, f AS (SELECT avg(s) AS sb FROM u WHERE n >= 2) {_s_out('k AS event_type, t AS day')} FROM u, f WHERE n >= 2")
def s_of_r5(spark, sf_dir):
    return study(spark, sf_dir, "events").execute("S", value="R5").get_chart().data.drop("group")


@query(f"WITH {E_CTE}, {RESIDUAL_U.format(r='y - g')}, {_fit('k, t')}, h AS (SELECT avg(m) AS cc FROM u) {_xbar_out('k AS event_type, t AS day', 'cc')} FROM u, f, h")
def xbar_of_r1(spark, sf_dir):
    return study(spark, sf_dir, "events").execute("Xbar", value="R1").get_chart().data.drop("group")


@query(f"WITH {E_CTE}, {RESIDUAL_U.format(r='mk - g + (y - m)')}, {_fit('k, t')}, h AS (SELECT avg(e) AS cc FROM (SELECT avg(mk - g + (y - m)) AS e FROM j GROUP BY k)) {_xbar_out('k AS event_type, t AS day', 'cc')} FROM u, f, h")
def xbar_of_r5(spark, sf_dir):
    return study(spark, sf_dir, "events").execute("Xbar", value="R5").get_chart().data.drop("group")


# X and mR


def _xmr(rows: str, stream: str, order: str, keys: str) -> str:
    part = f"PARTITION BY {stream} " if stream else ""
    by = f"GROUP BY {stream}" if stream else ""
    lead = f"{stream}, " if stream else ""
    return f"r AS ({rows}), l AS (SELECT *, abs(y - lag(y) OVER ({part}ORDER BY {order})) AS mr FROM r), f AS (SELECT {lead}avg(y) AS xb, avg(mr) AS mb FROM l {by}), o AS (SELECT * FROM l {'JOIN f USING (' + stream + ')' if stream else ', f'})"


def _x_out(keys: str, value: str) -> str:
    lo, hi = f"xb - {E2} * coalesce(mb, 0)", f"xb + {E2} * coalesce(mb, 0)"
    return f"SELECT {keys}, {R3('y')} AS {value}, {R3('xb')} AS center, {R3(lo)} AS lpl, {R3(hi)} AS upl, CASE WHEN y < {lo} THEN -1 WHEN y > {hi} THEN 1 ELSE 0 END AS beyond_limits FROM o"


def _mr_out(keys: str) -> str:
    hi = f"{D4} * mb"
    return f"SELECT {keys}, {R3('mr')} AS mr, {R3('mb')} AS center, 0.0 AS lpl, {R3(hi)} AS upl, CASE WHEN mr > {hi} THEN 1 ELSE 0 END AS beyond_limits FROM o WHERE mr IS NOT NULL"


SHOWN = ["event_type", "day", "obs_id"]


@query(f"WITH {_xmr(E_ROWS, '', 'k, t, id', '')} {_x_out('k AS event_type, t AS day, id AS obs_id', 'value')}")
def x_single(spark, sf_dir):
    return study(spark, sf_dir, "events").execute("X", by=[]).get_chart().data.withColumnRenamed("rsg", "event_type").drop("sort_key")


@query(f"WITH {_xmr(E_ROWS, '', 'k, t, id', '')} {_mr_out('k AS event_type, t AS day, id AS obs_id')}")
def mr_single(spark, sf_dir):
    return study(spark, sf_dir, "events").execute("mR", by=[]).get_chart().data.withColumnRenamed("rsg", "event_type").drop("sort_key")


@query(f"WITH {_xmr(E_ROWS, 'k', 't, id', '')} {_x_out('k AS event_type, t AS day, id AS obs_id', 'value')}")
def x_stratified(spark, sf_dir):
    return study(spark, sf_dir, "events").execute("X", by=["event_type"]).get_chart().data.drop("sort_key", "rsg")


@query(f"WITH {_xmr(E_ROWS, 'k', 't, id', '')} {_mr_out('k AS event_type, t AS day, id AS obs_id')}")
def mr_stratified(spark, sf_dir):
    return study(spark, sf_dir, "events").execute("mR", by=["event_type"]).get_chart().data.drop("sort_key", "rsg")


@query(f"WITH {_xmr('SELECT event_id AS id, value AS y FROM events WHERE value IS NOT NULL', '', 'id', '')} {_x_out('id AS obs_id', 'value')}")
def x_received_order(spark, sf_dir):
    return Study(events(spark, sf_dir), FormulationSpec("value", (), None, "event_id")).execute("X").get_chart().data.drop("sort_key")


Z1 = f"z AS (SELECT k, t, id, y - g + g AS y, abs(y - g - lag(y - g) OVER (ORDER BY k, t, id)) AS mr FROM j), o AS (SELECT z.*, xb, mb FROM z, (SELECT avg(y) AS xb, avg(mr) AS mb FROM z))"


@query(f"WITH {E_CTE}, {Z1} {_x_out('k AS event_type, t AS day, id AS obs_id', 'RCR1')}")
def x_recentered_residual(spark, sf_dir):
    return study(spark, sf_dir, "events").execute("X", by=[], value="R1", recentered=True).get_chart().data.withColumnRenamed("rsg", "event_type").drop("sort_key")


@query(f"WITH {E_CTE} SELECT id AS event_id, {R6('y')} AS RCR1, {R6('m + (y - m)')} AS RCR2, {R6('m - mk - mt + 2 * g + (y - m)')} AS RCR3, {R6('mt + (y - m)')} AS RCR4, {R6('mk + (y - m)')} AS RCR5 FROM j")
def vas_recentered(spark, sf_dir):
    names = [f"RCR{k}" for k in range(1, 6)]
    return six(frame(spark, sf_dir, "events", "exact").rows.select(F.col("obs_id").alias("event_id"), *names), *names)


@query("SELECT user_id, event_type, count(*) AS points FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL HAVING count(*) < 10")
def insufficient_strata(spark, sf_dir):
    rows = prepare.tidy(events(spark, sf_dir), FormulationSpec("value", ("user_id", "event_type"), "day", "event_id"))
    return charts.insufficient(rows, ["user_id", "event_type"], 10)


# Phases, calibrated limits


@query(f"WITH {_xmr(E_ROWS, 'k', 't, id', '')} SELECT dense_rank() OVER (ORDER BY k) AS phase, event_type, obs_id, value, center, lpl, upl, beyond_limits FROM (SELECT k, k AS event_type, id AS obs_id, {R3('y')} AS value, {R3('xb')} AS center, {R3(f'xb - {E2} * mb')} AS lpl, {R3(f'xb + {E2} * mb')} AS upl, CASE WHEN y < xb - {E2} * mb THEN -1 WHEN y > xb + {E2} * mb THEN 1 ELSE 0 END AS beyond_limits FROM o)")
def phased_x(spark, sf_dir):
    out = study(spark, sf_dir, "events").execute("X", by=[], phased=True).get_chart().data
    return out.select("phase", F.col("rsg").alias("event_type"), "obs_id", "value", "center", "lpl", "upl", "beyond_limits")


@query(f"WITH {O_CTE}, u AS (SELECT k, t, m, s, n FROM c), {_fit('t', 'k')}, p AS (SELECT k, dense_rank() OVER (ORDER BY k) AS phase FROM (SELECT DISTINCT k FROM u)) {_xbar_out('k AS o_orderpriority, t AS month, phase', 'mm')} FROM u JOIN f USING (k) JOIN p USING (k)")
def phased_xbar_s(spark, sf_dir):
    return study(spark, sf_dir, "orders").execute("Xbar", by=["o_orderpriority", "month"], phased=True).get_chart().data.drop("subgroup")


@query("SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, event_id AS obs_id, round_even(value * 1000.0, 0) / 1000.0 AS value, 50.0 AS center, -10.0 AS lpl, 110.0 AS upl, CASE WHEN value < -10 THEN -1 WHEN value > 110 THEN 1 ELSE 0 END AS beyond_limits FROM events WHERE value IS NOT NULL")
def calibrated_x(spark, sf_dir):
    out = study(spark, sf_dir, "events").execute("X", by=[], calibration=Calibration(50.0, 20.0)).get_chart().data
    return out.withColumnRenamed("rsg", "event_type").drop("sort_key")


@query(f"WITH {I_CTE} SELECT a AS l_returnflag, b AS l_linestatus, t AS year, n, {R3('m')} AS xbar, 25.0 AS center, {R3('25 - 3 * 14 / sqrt(n)')} AS lpl, {R3('25 + 3 * 14 / sqrt(n)')} AS upl, CASE WHEN m < 25 - 3 * 14 / sqrt(n) THEN -1 WHEN m > 25 + 3 * 14 / sqrt(n) THEN 1 ELSE 0 END AS beyond_limits FROM c")
def calibrated_xbar(spark, sf_dir):
    return study(spark, sf_dir, "items").execute("Xbar", calibration=Calibration(25.0, 14.0)).get_chart().data.drop("group")


C4N = C4.format(n="n")


@query(f"WITH {I_CTE}, x AS (SELECT *, {C4N} AS q FROM c WHERE n >= 2), z AS (SELECT *, 14 * q AS mid, greatest(0, 1 - 3 / q * sqrt(1 - q * q)) * 14 * q AS lo, (1 + 3 / q * sqrt(1 - q * q)) * 14 * q AS hi FROM x) SELECT a AS l_returnflag, b AS l_linestatus, t AS year, n, {R3('s')} AS s, {R3('mid')} AS center, {R3('lo')} AS lpl, {R3('hi')} AS upl, CASE WHEN s < lo THEN -1 WHEN s > hi THEN 1 ELSE 0 END AS beyond_limits FROM z")
def calibrated_s(spark, sf_dir):
    return study(spark, sf_dir, "items").execute("S", calibration=Calibration(25.0, 14.0)).get_chart().data.drop("group")


@query(f"WITH r AS ({E_ROWS}), l AS (SELECT *, abs(y - lag(y) OVER (ORDER BY k, t, id)) AS mr FROM r) SELECT k AS event_type, t AS day, id AS obs_id, {R3('mr')} AS mr, {R3('1.128 * 20')} AS center, 0.0 AS lpl, {R3(f'{D4} * 1.128 * 20')} AS upl, CASE WHEN mr > {D4} * 1.128 * 20 THEN 1 ELSE 0 END AS beyond_limits FROM l WHERE mr IS NOT NULL")
def calibrated_mr(spark, sf_dir):
    out = study(spark, sf_dir, "events").execute("mR", by=[], calibration=Calibration(50.0, 20.0)).get_chart().data
    return out.withColumnRenamed("rsg", "event_type").drop("sort_key")


# Several charts at once

BOTH_SQL = f"WITH {I_CTE}, u AS (SELECT * FROM c), {_fit('a, b, t')}, x AS ({_xbar_out('a, b, t', 'g')} FROM u, f, g), w AS (SELECT u.*, sb FROM u, f WHERE n >= 2), s AS ({_s_out('a, b, t')} FROM w)"


@query(f"{BOTH_SQL} SELECT 'Xbar' AS chart, '' AS stratum, count(*) AS points, count(*) FILTER (beyond_limits <> 0) AS signals, max(center) AS center, min(lpl) AS lpl, max(upl) AS upl FROM x UNION ALL SELECT 'S', '', count(*), count(*) FILTER (beyond_limits <> 0), max(center), min(lpl), max(upl) FROM s")
def result_summary(spark, sf_dir):
    return study(spark, sf_dir, "items").execute("Xbar", companion=True).summary()


@query(f"{BOTH_SQL}, y AS (SELECT 'Xbar' AS chart, a, b, t, xbar AS value, center, lpl, upl FROM x UNION ALL SELECT 'S', a, b, t, s, center, lpl, upl FROM s) SELECT chart, row_number() OVER (PARTITION BY chart ORDER BY a, b, t) - 1 AS position, value > upl OR value < lpl AS rule_1 FROM y")
def signals_of_all_charts(spark, sf_dir):
    found = study(spark, sf_dir, "items").execute("Xbar", companion=True).detect_signals()
    parts = [r.flagged.select(F.lit(name).alias("chart"), "position", "rule_1") for name, r in found.items()]
    return parts[0].unionByName(parts[1])


@query(f"{BOTH_SQL}, p AS (SELECT *, row_number() OVER (ORDER BY a, b, t) - 1 AS position FROM x) SELECT position, q AS sigma, {R6('center + q / 3.0 * CASE WHEN q < 0 THEN center - lpl ELSE upl - center END')} AS level FROM p, (SELECT unnest(range(-3, 4))::INT AS q)")
def zone_lines(spark, sf_dir):
    return six(study(spark, sf_dir, "items").execute("Xbar").zone_lines().select("position", "sigma", "level"), "level")


# Run rules

RULE_SQL = f"""WITH {_xmr(E_ROWS, 'k', 't, id', '')},
p AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY t, id) - 1 AS position, {R3('y')} AS v, {R3('xb')} AS c, {R3(f'xb + {E2} * mb')} AS hi, {R3(f'xb - {E2} * mb')} AS lo FROM o),
d AS (SELECT *, (hi - c) / 3 AS sg, v - lag(v) OVER w AS d1, lag(v) OVER w - lag(v, 2) OVER w AS d2 FROM p WINDOW w AS (PARTITION BY k ORDER BY position)),
x AS (SELECT k AS event_type, id AS obs_id, position,
  coalesce(v > hi OR v < lo, false) AS rule_1,
  count(*) OVER w3 = 3 AND (sum((v > c + 2 * sg)::INT) OVER w3 >= 2 OR sum((v < c - 2 * sg)::INT) OVER w3 >= 2) AS rule_2,
  count(*) OVER w5 = 5 AND (sum((v > c + sg)::INT) OVER w5 >= 4 OR sum((v < c - sg)::INT) OVER w5 >= 4) AS rule_3,
  sum((v > c)::INT) OVER w8 = 8 OR sum((v < c)::INT) OVER w8 = 8 AS rule_4,
  sum(coalesce(d1 > 0, false)::INT) OVER w5 = 5 OR sum(coalesce(d1 < 0, false)::INT) OVER w5 = 5 AS rule_5,
  sum(coalesce(d1 * d2 < 0, false)::INT) OVER w12 = 12 AS rule_6,
  sum((v < c + sg AND v > c - sg)::INT) OVER w15 = 15 AS rule_7,
  sum((v >= c + sg OR v <= c - sg)::INT) OVER w8 = 8 AS rule_8
  FROM d WINDOW w3 AS (PARTITION BY k ORDER BY position ROWS 2 PRECEDING), w5 AS (PARTITION BY k ORDER BY position ROWS 4 PRECEDING), w8 AS (PARTITION BY k ORDER BY position ROWS 7 PRECEDING),
  w12 AS (PARTITION BY k ORDER BY position ROWS 11 PRECEDING), w15 AS (PARTITION BY k ORDER BY position ROWS 14 PRECEDING))"""


def _signals(spark, sf_dir):
    return study(spark, sf_dir, "events").execute("X", by=["event_type"]).detect_signals("X", rules="all")


@query(f"{RULE_SQL} SELECT event_type, obs_id, position, rule_1, rule_2, rule_3, rule_4, rule_5, rule_6, rule_7, rule_8 FROM x")
def signal_flags(spark, sf_dir):
    return _signals(spark, sf_dir).flagged.select("event_type", "obs_id", "position", *[f"rule_{k}" for k in range(1, 9)])


def _rule_query(k: int):
    def run(spark, sf_dir):
        return _signals(spark, sf_dir).flagged.filter(f"rule_{k}").select("event_type", "obs_id", "position")

    run.__name__ = f"signals_rule_{k}"
    query(f"{RULE_SQL} SELECT event_type, obs_id, position FROM x WHERE rule_{k}")(run)


for _k in range(1, 9):
    _rule_query(_k)


@query(f"{RULE_SQL} SELECT event_type, obs_id, position, r AS rule_number FROM x, unnest([CASE WHEN rule_1 THEN 1 END, CASE WHEN rule_2 THEN 2 END, CASE WHEN rule_3 THEN 3 END, CASE WHEN rule_4 THEN 4 END, CASE WHEN rule_5 THEN 5 END, CASE WHEN rule_6 THEN 6 END, CASE WHEN rule_7 THEN 7 END, CASE WHEN rule_8 THEN 8 END]) AS q(r) WHERE r IS NOT NULL")
def violations_long(spark, sf_dir):
    return _signals(spark, sf_dir).violations.select("event_type", "obs_id", "position", "rule_number")


# Effects


O2 = FormulationSpec("o_totalprice", ("o_orderpriority", "o_orderstatus"), "month", "o_orderkey")
O2_CTE = _means("SELECT o_orderkey AS id, o_totalprice AS y, o_orderpriority AS a, o_orderstatus AS b, strftime(o_orderdate, '%Y-%m') AS t FROM orders", "a, b")
O2_Q = f"{O2_CTE}, q AS (SELECT *, y - m AS r2, mk - g + (y - m) AS r5 FROM j)"


def _two_factors(spark, sf_dir) -> prepare.Frame:
    return prepare.residuals(prepare.prepare(orders(spark, sf_dir), O2), "exact")


@query(f"WITH {O2_Q}, al AS (SELECT a, avg(r5 - r2) AS al FROM q GROUP BY a) SELECT id AS obs_id, {R6('al + r2')} AS R6, {R6('g + al + r2')} AS RCR6 FROM q JOIN al USING (a)")
def r6_by_factor(spark, sf_dir):
    return six(prepare.r6(_two_factors(spark, sf_dir), ["o_orderpriority"]).select("obs_id", "R6", "RCR6"), "R6", "RCR6")


@query(f"WITH {O2_Q}, ea AS (SELECT a, avg(r5) AS ea FROM q GROUP BY a), eb AS (SELECT b, avg(r5) AS eb FROM q GROUP BY b), x AS (SELECT a, b, avg(r5) AS ab FROM q GROUP BY a, b) SELECT id AS obs_id, {R6('r2 + ab - ea - eb')} AS Rx_score FROM q JOIN ea USING (a) JOIN eb USING (b) JOIN x USING (a, b)")
def interaction_scores(spark, sf_dir):
    return six(effects.interaction_scores(_two_factors(spark, sf_dir), "o_orderpriority", "o_orderstatus").select("obs_id", "Rx_score"), "Rx_score")


@query(f"WITH {U_CTE} SELECT k AS user_id, t AS day, {R6('m - mk - mt + g')} AS interaction FROM c JOIN ck USING (k) JOIN ct USING (t), g")
def interaction_cells_single(spark, sf_dir):
    return six(effects.condition_by_time(frame(spark, sf_dir, "users", "ma2"), 2), "interaction")


@query(f"WITH {I_CTE}, q AS (SELECT *, mk - g + (y - m) AS r5 FROM j) SELECT 'l_returnflag' AS factor, a AS level, {R6('avg(r5)')} AS Main_Effect FROM q GROUP BY a UNION ALL SELECT 'l_linestatus', b, {R6('avg(r5)')} FROM q GROUP BY b UNION ALL SELECT 'rsg', a || '_' || b, {R6('avg(r5)')} FROM q GROUP BY a, b")
def main_effects(spark, sf_dir):
    got = effects.melted(frame(spark, sf_dir, "items", "exact")).filter("Effect_Type <> 'year'")
    return six(got.toDF("factor", "level", "Main_Effect"), "Main_Effect")


@query(f"WITH {I_CTE} SELECT t AS year, {R6('avg(mt - g + (y - m))')} AS PT_ME FROM j GROUP BY t")
def time_effects(spark, sf_dir):
    return six(effects.time_effect(frame(spark, sf_dir, "items", "exact")), "PT_ME")


@query(f"WITH {I_CTE}, q AS (SELECT *, mk - g + (y - m) AS r5 FROM j), ea AS (SELECT a, avg(r5) AS ea FROM q GROUP BY a), eb AS (SELECT b, avg(r5) AS eb FROM q GROUP BY b) SELECT a AS l_returnflag, b AS l_linestatus, {R6('avg(r5) - any_value(ea) - any_value(eb)')} AS Rx FROM q JOIN ea USING (a) JOIN eb USING (b) GROUP BY a, b")
def factor_interaction(spark, sf_dir):
    return six(effects.factor_interaction(frame(spark, sf_dir, "items", "exact"), "l_returnflag", "l_linestatus"), "Rx")


@query(f"WITH {I_CTE} SELECT a AS l_returnflag, b AS l_linestatus, t AS year, {R6('avg(m - mk - mt + g + (y - m))')} AS interaction FROM j GROUP BY ALL")
def interaction_cells(spark, sf_dir):
    return six(effects.condition_by_time(frame(spark, sf_dir, "items", "exact"), 1), "interaction")


@query(f"WITH {O2_Q}, ea AS (SELECT a, avg(r5) AS ea FROM q GROUP BY a) SELECT id AS obs_id, {R6('r2 + ea')} AS score FROM q JOIN ea USING (a)")
def main_effect_scores(spark, sf_dir):
    rows = effects.main_effect_scores(_two_factors(spark, sf_dir), "o_orderpriority")
    return six(rows.select("obs_id", F.col("o_orderpriority_MEs").alias("score")), "score")


# Capability, loss, maximum information

CAP_COLUMNS = ["n", "y_bar", "sigma", "pp", "ppu", "ppl", "ppk", "pct_below_lsl", "pct_above_usl", "sigma_R2", "cp", "cpu", "cpl", "cpk", "potential_pct_below", "potential_pct_above"]


def _cap_sql(where: str) -> str:
    return f"""WITH {E_CTE}, q AS (SELECT *, y - m AS r2 FROM j), w AS (SELECT * FROM q WHERE {where}),
a AS (SELECT count(*) AS n, stddev_samp(y) / ({C4.format(n='count(*)')}) AS sg, 100.0 * count(*) FILTER (y < 5) / count(*) AS lo, 100.0 * count(*) FILTER (y > 90) / count(*) AS hi FROM w),
yb AS (SELECT avg(m) AS yb FROM (SELECT avg(y) AS m FROM w GROUP BY k, t)), e AS (SELECT stddev_samp(r2) / ({C4.format(n='count(*)')}) AS sr, avg(yb + r2) AS pm, 100.0 * count(*) FILTER (yb + r2 < 5) / count(*) AS plo, 100.0 * count(*) FILTER (yb + r2 > 90) / count(*) AS phi FROM q, yb)
SELECT n, {R6('yb')} AS y_bar, {R6('sg')} AS sigma, {R6('85 / (6 * sg)')} AS pp, {R6('(90 - yb) / (3 * sg)')} AS ppu, {R6('(yb - 5) / (3 * sg)')} AS ppl, {R6('least(90 - yb, yb - 5) / (3 * sg)')} AS ppk, {R6('lo')} AS pct_below_lsl, {R6('hi')} AS pct_above_usl,
{R6('sr')} AS sigma_R2, {R6('85 / (6 * sr)')} AS cp, {R6('(90 - pm) / (3 * sr)')} AS cpu, {R6('(pm - 5) / (3 * sr)')} AS cpl, {R6('least(90 - pm, pm - 5) / (3 * sr)')} AS cpk, {R6('plo')} AS potential_pct_below, {R6('phi')} AS potential_pct_above FROM a, yb, e"""


@query(_cap_sql("true"))
def capability(spark, sf_dir):
    return six(cap.capability(frame(spark, sf_dir, "events", "exact"), SpecLimits(5, 90)).select(CAP_COLUMNS), *CAP_COLUMNS[1:])


@query(_cap_sql("t >= '2024-01-08' AND t < '2024-01-15'"))
def capability_window(spark, sf_dir):
    return six(cap.capability(frame(spark, sf_dir, "events", "exact"), SpecLimits(5, 90), ("2024-01-08", "2024-01-15")).select(CAP_COLUMNS), *CAP_COLUMNS[1:])


@query(f"WITH {E_CTE}, q AS (SELECT g + (y - m) AS p, y - m AS r2, y, g FROM j), a AS (SELECT any_value(g) AS yb, stddev_samp(y) / ({C4.format(n='count(*)')}) AS sg, avg(p) AS pm, stddev_samp(r2) / ({C4.format(n='count(*)')}) AS sr FROM q), w AS (SELECT 'observed' AS curve, yb AS m, sg AS s FROM a UNION ALL SELECT 'potential', pm, sr FROM a), z AS (SELECT *, k * (8.0::DOUBLE / 20) - 4 AS z FROM w, (SELECT unnest(range(21)) AS k)) SELECT curve, {R6('m + z * s')} AS x, {R6('exp(-z * z / 2) / (s * sqrt(2 * pi()))')} AS density FROM z")
def capability_curves(spark, sf_dir):
    return six(study(spark, sf_dir, "events").capability_curves(5, 90, points=21), "x", "density")


LOSS = ["centering", "unexplained", "pdc", "time", "interaction", "total"]
LOSS_SQL = f"""WITH {E_CTE}, l AS (SELECT power((SELECT g FROM g) - 40, 2) AS centering, (SELECT avg(v) FROM c) AS unexplained, (SELECT avg(power(mk - g, 2)) FROM ck, g) AS pdc, (SELECT avg(power(mt - g, 2)) FROM ct, g) AS time,
(SELECT avg(power(m - mk - mt + g, 2)) FROM c JOIN ck USING (k) JOIN ct USING (t), g) AS interaction), z AS (SELECT *, centering + unexplained + pdc + time + interaction AS total FROM l)"""


@query(f"{LOSS_SQL} SELECT {', '.join(R6(x) + ' AS ' + x for x in LOSS)}, {', '.join(R6('100 * ' + x + ' / total') + ' AS pct_' + x for x in LOSS[:-1])} FROM z")
def loss(spark, sf_dir):
    names = [*LOSS, *[f"pct_{x}" for x in LOSS[:-1]]]
    return six(cap.loss(frame(spark, sf_dir, "events", "exact"), True, 40.0).select(names), *names)


# Squared weights of independent cell means: those of the cell's own condition, of its period, of the others.
@query(f"""WITH {E_CTE}, x AS (SELECT k, t, (SELECT avg(v) FROM c) / n AS v FROM c), a AS (SELECT count(*) AS cc, sum(v) AS va FROM x), kk AS (SELECT k, count(*) AS nk, sum(v) AS vk FROM x GROUP BY k), tt AS (SELECT t, count(*) AS nt, sum(v) AS vt FROM x GROUP BY t)
SELECT {R6("(SELECT avg(power(1.0 / nk - 1.0 / cc, 2) * vk + (va - vk) / power(cc, 2)) FROM kk, a)")} AS ref_pdc, {R6("(SELECT avg(power(1.0 / nt - 1.0 / cc, 2) * vt + (va - vt) / power(cc, 2)) FROM tt, a)")} AS ref_time,
{R6("(SELECT avg(power(1 - 1.0 / nk - 1.0 / nt + 1.0 / cc, 2) * v + power(1.0 / cc - 1.0 / nk, 2) * (vk - v) + power(1.0 / cc - 1.0 / nt, 2) * (vt - v) + (va - vk - vt + v) / power(cc, 2)) FROM x JOIN kk USING (k) JOIN tt USING (t), a)")} AS ref_interaction""")
def loss_reference(spark, sf_dir):
    names = ["ref_pdc", "ref_time", "ref_interaction"]
    return six(cap.loss(frame(spark, sf_dir, "events", "exact"), True).select(names), *names)


@query(f"WITH {I_CTE}, q AS (SELECT *, mk - g + (y - m) AS r5 FROM j) SELECT 'l_returnflag' AS factor, {R6('(SELECT avg(e * e) FROM (SELECT avg(r5) AS e FROM q GROUP BY a))')} AS loss UNION ALL SELECT 'l_linestatus', {R6('(SELECT avg(e * e) FROM (SELECT avg(r5) AS e FROM q GROUP BY b))')}")
def loss_by_factor(spark, sf_dir):
    return six(cap.loss_by_factor(frame(spark, sf_dir, "items", "exact")), "loss")


@query(f"WITH {O2_Q}, p AS (SELECT (SELECT avg(e * e) FROM (SELECT avg(r5) AS e FROM q GROUP BY a)) AS la, (SELECT avg(e * e) FROM (SELECT avg(r5) AS e FROM q GROUP BY b)) AS lb, (SELECT avg(power(mk - g, 2)) FROM ck, g) AS pdc) SELECT 'o_orderpriority' AS factor, {R6('la / 1e9')} AS loss FROM p UNION ALL SELECT 'o_orderstatus', {R6('lb / 1e9')} FROM p UNION ALL SELECT 'factor_interaction', {R6('(pdc - la - lb) / 1e9')} FROM p")
def loss_remainder(spark, sf_dir):
    """In units of 1e9: prices are large."""
    return six(cap.loss_by_factor(_two_factors(spark, sf_dir), remainder=True).withColumn("loss", F.col("loss") / 1e9), "loss")


@query(f"""WITH {U_CTE}{MA2}, l AS (SELECT power((SELECT g FROM g) - 40, 2) AS centering, (SELECT var_samp(r2) FROM q) AS unexplained, (SELECT avg(power(mk - g, 2)) FROM ck, g) AS pdc, (SELECT avg(power(mt - g, 2)) FROM ct, g) AS time),
i AS (SELECT *, greatest(0, (SELECT var_samp(y) FROM r) - pdc - time - unexplained) AS interaction FROM l) SELECT {', '.join(R6(x) + ' AS ' + x for x in LOSS[:-1])}, {R6('centering + unexplained + pdc + time + interaction')} AS total FROM i""")
def loss_without_replication(spark, sf_dir):
    return six(cap.loss(frame(spark, sf_dir, "users", "ma2"), False, 40.0).select(LOSS), *LOSS)


@query(f"WITH {E_CTE}, q AS (SELECT y - m AS x FROM j), e AS (SELECT min(x) AS lo, (max(x) - min(x)) / 10 AS w, count(*) AS n FROM q), b AS (SELECT least(floor((x - lo) / w), 9)::INT AS bin, count(*) AS c FROM q, e GROUP BY 1) SELECT bin, {R6('lo + bin * w')} AS left, {R6('lo + (bin + 1) * w')} AS right, coalesce(c, 0) AS count, {R6('100.0 * coalesce(c, 0) / n')} AS percent FROM (SELECT unnest(range(10))::INT AS bin) LEFT JOIN b USING (bin), e")
def r2_histogram(spark, sf_dir):
    return six(cap.r2_histogram(frame(spark, sf_dir, "events", "exact"), 10), "left", "right", "percent")


@query(f"WITH {E_CTE}, q AS (SELECT y - m AS r2, abs(y - m - lag(y - m) OVER (ORDER BY k, t, id)) AS mr FROM j), f AS (SELECT count(*) AS n, avg(r2) AS a, avg(mr) AS b FROM q) SELECT any_value(n) AS n, {R6('any_value(a)')} AS r2_mean, {R6('any_value(b)')} AS r2_mR, {R6('any_value(b) / 1.128')} AS sigma_hat, {R6(f'any_value(a) - {E2} * any_value(b)')} AS lpl, {R6(f'any_value(a) + {E2} * any_value(b)')} AS upl, count(*) FILTER (r2 < a - {E2} * b OR r2 > a + {E2} * b) AS n_signals FROM q, f")
def max_information(spark, sf_dir):
    return six(cap.maximum_information(frame(spark, sf_dir, "events", "exact")), "r2_mean", "r2_mR", "sigma_hat", "lpl", "upl")


# Histogram, derived columns, cleaning


@query(f"WITH s AS (SELECT min(o_totalprice) AS lo, (max(o_totalprice) - min(o_totalprice)) / 12 AS w FROM orders), b AS (SELECT o_orderstatus, least(floor((o_totalprice - lo) / w), 11)::INT AS bin, count(*) AS n FROM orders, s GROUP BY ALL), z AS (SELECT DISTINCT o_orderstatus, bin FROM orders, (SELECT unnest(range(12))::INT AS bin)) SELECT z.o_orderstatus, z.bin, {R6('lo + z.bin * w')} AS left, {R6('lo + (z.bin + 1) * w')} AS right, coalesce(n, 0) AS count FROM z LEFT JOIN b USING (o_orderstatus, bin), s")
def histogram_bins(spark, sf_dir):
    return six(charts.histogram_bins(orders(spark, sf_dir), ["o_orderstatus"], "o_totalprice", 12), "left", "right")


@query(f"SELECT o_orderstatus, {R6('avg(o_totalprice)')} AS mean, {R6('stddev_samp(o_totalprice)')} AS std, count(*) AS n FROM orders GROUP BY 1")
def histogram_statistics(spark, sf_dir):
    return six(charts.histogram_statistics(orders(spark, sf_dir), ["o_orderstatus"], "o_totalprice"), "mean", "std")


@query(" UNION ALL ".join(f"SELECT {p} AS p, {R6(f'quantile_cont(o_totalprice, {p})')} AS quantile FROM orders" for p in (0.01, 0.255, 0.5, 0.745, 0.99)))
def quantile_pairs(spark, sf_dir):
    return six(charts.quantile_pairs(orders(spark, sf_dir), "o_totalprice", 5).drop("normal"), "p", "quantile")


def _binned(spark, sf_dir, method: str, **params):
    out, _ = derive.materialise(orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), [derive.Derivation("bin", "o_totalprice", method, "b", params | {"labels": "number"})])
    return out.groupBy("b").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


def _bin_sql(edges: list[str], count: int, source: str) -> str:
    case = " ".join(f"WHEN x >= {edges[i]} THEN {i}" for i in range(count - 1, 0, -1))
    return f"WITH e AS (SELECT {source} FROM orders), x AS (SELECT o_totalprice AS x, CASE {case} ELSE 0 END AS i FROM (SELECT o_totalprice, o_totalprice AS x FROM orders), e) SELECT 'Bin ' || (i + 1) AS b, count(*) AS n, min(x) AS low, max(x) AS high FROM x GROUP BY i"


@query(_bin_sql(["", "q[1]", "q[2]", "q[3]"], 4, "quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) AS q"))
def bin_equal_freq(spark, sf_dir):
    return _binned(spark, sf_dir, "equal_freq", bins=4)


@query(_bin_sql(["", *[f"(lo + (hi - lo) * {i} / 5)" for i in range(1, 5)]], 5, "min(o_totalprice) AS lo, max(o_totalprice) AS hi"))
def bin_equal_width(spark, sf_dir):
    return _binned(spark, sf_dir, "equal_width", bins=5)


@query(_bin_sql(["", "100000", "250000"], 3, "max(1) AS one"))
def bin_breaks(spark, sf_dir):
    return _binned(spark, sf_dir, "breaks", breaks=[100000, 250000])


@query(_bin_sql(["", "(mu - sd)", "(mu + sd)"], 3, "avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd"))
def bin_sd(spark, sf_dir):
    return _binned(spark, sf_dir, "sd")


_T = {"log": "ln(x)", "log10": "log10(x)", "sqrt": "sqrt(x)", "square": "x * x", "inverse": "1 / x", "power": "power(x, 0.5)", "arcsin": "asin(sqrt(x))"}


def _transform_query(name: str, sql: str):
    def run(spark, sf_dir):
        src = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount" if name == "arcsin" else "l_extendedprice").alias("x")).filter("x > 0")
        out, _ = derive.materialise(src, [derive.Derivation("transform", "x", name, "y", {"exponent": 0.5} if name == "power" else {})])
        scale = 1e6 if name == "square" else 1.0
        return six(out.select("l_orderkey", "l_linenumber", (F.col("y") / scale).alias("y")), "y")

    run.__name__ = f"transform_{name}"
    source = "l_discount" if name == "arcsin" else "l_extendedprice"
    query(f"SELECT l_orderkey, l_linenumber, {R6(f'({sql}) / 1e6' if name == 'square' else sql)} AS y FROM (SELECT l_orderkey, l_linenumber, {source} AS x FROM lineitem WHERE {source} > 0)")(run)


for _name, _sql in _T.items():
    _transform_query(_name, _sql)


@query(f"WITH f AS (SELECT avg(o_totalprice) AS mu, stddev_samp(o_totalprice) AS sd FROM orders) SELECT o_orderkey, {R6('(o_totalprice - mu) / sd')} AS z FROM orders, f")
def zscore(spark, sf_dir):
    out, _ = derive.materialise(orders(spark, sf_dir).select("o_orderkey", "o_totalprice"), [derive.Derivation("transform", "o_totalprice", "zscore", "z")])
    return six(out.select("o_orderkey", "z"), "z")


@query(f"SELECT o_orderkey, {R6('CASE WHEN o_orderkey % 50 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END')} AS price FROM orders")
def clean_currency(spark, sf_dir):
    shown = F.format_number("o_totalprice", 2)
    raw = F.when(F.col("o_orderkey") % 50 == 0, "BDL").when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("($"), shown, F.lit(")"))).otherwise(F.concat(F.lit("$ "), shown))
    out, _ = clean.clean(orders(spark, sf_dir).select("o_orderkey", raw.alias("price")))
    return six(out, "price")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey::DOUBLE END AS reading, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def clean_tokens(spark, sf_dir):
    src = orders(spark, sf_dir).select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "*").otherwise(F.col("o_orderkey").cast("string")).alias("reading"), F.when(F.col("o_orderkey") % 13 == 0, "unknown").otherwise(F.col("o_orderpriority")).alias("priority"))
    return clean.clean(src, ["unknown"])[0]


@query(f"SELECT o_orderkey, {R6('CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 12 ELSE round(o_totalprice, 2) END')} AS price FROM orders")
def clean_blanks(spark, sf_dir):
    """A blank within a number makes it unreadable; one behind a currency sign or at the ends doesn't."""
    shown = F.format_number("o_totalprice", 2)
    raw = F.when(F.col("o_orderkey") % 10 == 0, "10 12").when(F.col("o_orderkey") % 10 == 1, " 12 %").otherwise(F.concat(F.lit(" € "), shown))
    return six(clean.clean(orders(spark, sf_dir).select("o_orderkey", raw.alias("price")))[0], "price")


@query(f"SELECT o_orderkey, {R6('CASE WHEN o_orderkey % 9 = 0 THEN -round(o_totalprice, 2) ELSE round(o_totalprice, 2) END')} AS price FROM orders")
def clean_decimal_commas(spark, sf_dir):
    shown = F.translate(F.format_string("%.2f", "o_totalprice"), ".", ",")
    raw = F.when(F.col("o_orderkey") % 9 == 0, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    return six(clean.clean(orders(spark, sf_dir).select("o_orderkey", raw.alias("price")))[0], "price")


# Design report, order


PLAN_SQL = "WITH o AS (SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority <> '1-URGENT'), p AS (SELECT * FROM (SELECT DISTINCT o_orderpriority FROM orders) CROSS JOIN (SELECT unnest(['F', 'O', 'P', 'X']) AS o_orderstatus))"


def _plan(spark, sf_dir):
    rows = orders(spark, sf_dir)
    plan = rows.select("o_orderpriority").distinct().crossJoin(spark.createDataFrame([("F",), ("O",), ("P",), ("X",)], ["o_orderstatus"]))
    return rows.filter("o_orderstatus <> 'F' OR o_orderpriority <> '1-URGENT'"), plan


@query(f"{PLAN_SQL} SELECT o_orderpriority, o_orderstatus FROM p EXCEPT SELECT o_orderpriority, o_orderstatus FROM o")
def missing_combos(spark, sf_dir):
    rows, plan = _plan(spark, sf_dir)
    return design.missing_combos(rows, plan)


@query("SELECT DISTINCT o_orderpriority, o_orderstatus FROM orders WHERE o_orderstatus <> 'O' AND o_orderpriority <> '5-LOW'")
def extra_combos(spark, sf_dir):
    rows, plan = orders(spark, sf_dir), orders(spark, sf_dir).filter("o_orderstatus = 'O' OR o_orderpriority = '5-LOW'").select("o_orderpriority", "o_orderstatus")
    return design.extra_combos(rows, plan)


@query(f"WITH {U_CTE}, p AS (SELECT t, row_number() OVER (ORDER BY t) AS i FROM (SELECT DISTINCT t FROM c)), m AS (SELECT k, avg(i) AS a FROM c JOIN p USING (t) GROUP BY k) SELECT {R6('max(a) - min(a)')} AS period_spread FROM m")
def period_spread(spark, sf_dir):
    return six(design.period_spread(prepare.prepare(events(spark, sf_dir), USERS).sums, USERS), "period_spread")


@query("SELECT 'year' AS factor, CAST(coalesce(p.level, o.level) AS VARCHAR) AS level, p.level IS NOT NULL AS planned, o.level IS NOT NULL AS observed FROM (SELECT unnest([1992, 1995, 2001]) AS level) p FULL JOIN (SELECT DISTINCT year(l_shipdate)::INT AS level FROM lineitem) o ON p.level = o.level")
def plan_levels_typed(spark, sf_dir):
    """A plan in text against a factor that holds numbers."""
    return design.level_report(lineitem(spark, sf_dir), {"year": ["1992", " 1995", "2001"]})


@query(f"{PLAN_SQL} SELECT count(*) FILTER (o.o_orderstatus IS NOT NULL) AS observed, count(*) AS planned, {R6('count(*) FILTER (o.o_orderstatus IS NOT NULL) * 1.0 / count(*)')} AS coverage FROM p LEFT JOIN o USING (o_orderpriority, o_orderstatus)")
def coverage(spark, sf_dir):
    rows, plan = _plan(spark, sf_dir)
    return six(design.coverage(rows.groupBy(*plan.columns).agg(F.count("*").alias("N_kt")), plan), "coverage")


@query("SELECT 'o_orderpriority' AS factor, max(c) <= 1 AS nested FROM (SELECT count(DISTINCT o_orderpriority) AS c FROM orders GROUP BY strftime(o_orderdate, '%Y-%m')) UNION ALL SELECT 'year', max(c) <= 1 FROM (SELECT count(DISTINCT year(o_orderdate)) AS c FROM orders GROUP BY strftime(o_orderdate, '%Y-%m'))")
def nested_in_time(spark, sf_dir):
    return design.nested_in_time(orders(spark, sf_dir).withColumn("year", F.substring("month", 1, 4)), ["o_orderpriority", "year"], "month")


@query(f"WITH {O_CTE} SELECT count(DISTINCT k) AS K, count(DISTINCT t) AS T, count(*) AS R, sum(n)::BIGINT AS N, min(n) AS n_min, {R6('quantile_cont(n, 0.5)')} AS n_median, max(n) AS n_max, count(*) FILTER (n = 1) AS n_single, sum(n - 1)::BIGINT AS df_within, count(DISTINCT k) * count(DISTINCT t) - count(*) AS empty FROM c")
def design_report(spark, sf_dir):
    return six(design.report(prepare.prepare(orders(spark, sf_dir), ORDERS).sums, ORDERS), "n_median")


@query("SELECT event_id, row_number() OVER (ORDER BY event_type, CAST(ts AS DATE), event_id) - 1 AS sort_key FROM events WHERE value IS NOT NULL")
def canonical_order(spark, sf_dir):
    rows = prepare.canonical(prepare.tidy(events(spark, sf_dir), EVENTS), EVENTS)
    return rows.select(F.col("obs_id").alias("event_id"), "sort_key")


@query("WITH p AS (SELECT event_type, value, row_number() OVER (ORDER BY CAST(ts AS DATE), event_type, event_id) - 1 AS position FROM events WHERE value IS NOT NULL), l AS (SELECT *, lag(event_type) OVER (ORDER BY position) AS before FROM p) SELECT position, event_type AS label FROM l WHERE before <> event_type")
def lane_boundaries(spark, sf_dir):
    rows = positions(events(spark, sf_dir).filter("value IS NOT NULL"), [], ["day", "event_type"], ["event_id"], "position")
    return charts.lane_boundaries(rows, [], "position", F.col("event_type"))


@query(f"SELECT n, {R6(C4.format(n='n'))} AS c4 FROM (SELECT unnest(range(2, 400)) AS n)")
def c4_constants(spark, sf_dir):
    return six(spark.range(2, 400).select(F.col("id").alias("n"), c4_col(F.col("id")).alias("c4")), "c4")


@query("SELECT p_brand, row_number() OVER (ORDER BY length(p_brand), p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def natural_sort(spark, sf_dir):
    levels = table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("key", prepare.natural_key(F.col("p_brand")))
    ranked = positions(levels, [], [], ["key"], "place")
    return ranked.select("p_brand", (F.col("place") + 1).alias("place"))


@query(f"{PLAN_SQL} SELECT count(*) AS planned, count(*) FILTER (n >= 900) AS complete, count(*) FILTER (n > 0 AND n < 900) AS short, count(*) FILTER (n = 0) AS empty, sum(greatest(900 - n, 0))::BIGINT AS readings_missing, CASE WHEN sum(greatest(900 - n, 0)) = 0 THEN 'none needed' ELSE 'collect ' || sum(greatest(900 - n, 0))::BIGINT || ' readings in ' || count(*) FILTER (n < 900) || ' cells' END AS remediation FROM (SELECT p.*, coalesce(n, 0) AS n FROM p LEFT JOIN (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' OR o_orderpriority <> '1-URGENT' GROUP BY ALL) USING (o_orderpriority, o_orderstatus))")
def plan_adherence(spark, sf_dir):
    rows, plan = _plan(spark, sf_dir)
    return design.adherence(rows.groupBy(*plan.columns).agg(F.count("*").alias("n")), plan, 900)


@query("SELECT 'o_orderstatus' AS factor, coalesce(p.level, o.level) AS level, p.level IS NOT NULL AS planned, o.level IS NOT NULL AS observed FROM (SELECT unnest(['F', 'O', 'X']) AS level) p FULL JOIN (SELECT DISTINCT o_orderstatus AS level FROM orders) o ON p.level = o.level")
def plan_levels(spark, sf_dir):
    return design.level_report(orders(spark, sf_dir), {"o_orderstatus": ["F", "O", "X"]})
