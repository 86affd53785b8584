"""A static page of a result: statistics tables and small charts drawn as SVG.

Only chart frames of at most `points` rows are drawn; longer ones are thinned to the extremes of equal runs of
positions by an aggregate on the cluster, so the driver gets a bounded number of points.
"""

from __future__ import annotations

import html

from pyspark.sql import functions as F

from variq.plans.result import AnalysisResult, Chart

WIDTH, HEIGHT = 900, 220


def thinned(chart: Chart, points: int = 1000) -> list[tuple]:
    """(position, value, center, lpl, upl, beyond) of a single-stratum chart, bounded."""
    data = chart.ordered().withColumn("value", F.col(chart.value_col)).select("position", "value", "center", "lpl", "upl", "beyond_limits")
    n = data.count()
    if n > points:
        run = F.floor(F.col("position") * (points // 2) / F.lit(n))
        both = data.groupBy(run.alias("run")).agg(F.min_by(F.struct(*data.columns), "value").alias("a"), F.max_by(F.struct(*data.columns), "value").alias("b"))
        data = both.select(F.explode(F.array("a", "b")).alias("x")).select("x.*").distinct()
    return sorted(map(tuple, data.collect()))


def svg(rows: list[tuple]) -> str:
    rows = [r for r in rows if r[1] is not None]
    if not rows:
        return "<p>no points</p>"
    ys = [v for r in rows for v in (r[1], r[3], r[4]) if v is not None]
    lo, hi = min(ys), max(ys)
    gap = (hi - lo) or 1.0
    first, last = rows[0][0], rows[-1][0]
    x = lambda p: 10 + (WIDTH - 20) * (p - first) / ((last - first) or 1)
    y = lambda v: HEIGHT - 10 - (HEIGHT - 20) * (v - lo) / gap
    line = lambda k: " ".join(f"{x(r[0]):.1f},{y(r[k]):.1f}" for r in rows if r[k] is not None)
    parts = [f'<polyline fill="none" stroke="{c}" points="{line(k)}"/>' for k, c in ((2, "green"), (3, "firebrick"), (4, "firebrick"), (1, "steelblue"))]
    parts += [f'<circle cx="{x(r[0]):.1f}" cy="{y(r[1]):.1f}" r="3" fill="red"/>' for r in rows if r[5]]
    return f'<svg width="{WIDTH}" height="{HEIGHT}">{"".join(parts)}</svg>'


def table(df, limit: int | None = None) -> str:
    """A table; with a limit its first rows, and a line that says so."""
    rows = (df.limit(limit + 1) if limit is not None else df).collect()
    cut = limit is not None and len(rows) > limit
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in rows[:limit])
    return f"<table><tr>{head}</tr>{body}</table>" + (f"<p>the first {limit} rows; there are more</p>" if cut else "")


def write(result: AnalysisResult, path: str, strata: int | None = None, rows: int | None = None) -> str:
    """The page of all charts at a path of the driver; returns it.

    strata and rows: draw so many strata of a chart and list so many rows of a table at most (None: all); the page says
    where it was cut.
    """
    study = result.study
    out = [f"<h1>{html.escape(study.spec.response)}</h1>", f"<p>design: {study.analytical_design_state.reason}</p>"]
    for name, chart in result.iter_charts():
        out += [f"<h2>{name}</h2>", table(chart.statistics, rows)]
        if name == "Histogram":
            out.append(table(chart.bins, rows))
            continue
        levels = [None]
        if chart.strata:
            found = chart.data.select(*chart.strata).distinct().orderBy(*chart.strata)
            levels = (found.limit(strata + 1) if strata is not None else found).collect()
        for level in levels[:strata]:
            one = chart.focus(**level.asDict()) if level is not None else chart
            out += [f"<h3>{html.escape(', '.join(map(str, level)))}</h3>" if level is not None else "", svg(thinned(one))]
        if strata is not None and len(levels) > strata:
            out.append(f"<p>the first {strata} strata; there are more</p>")
    page = f"<!doctype html><meta charset='utf-8'><title>{html.escape(study.spec.response)}</title>{''.join(out)}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(page)
    return path
