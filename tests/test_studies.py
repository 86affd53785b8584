"""Studies against published and hand-computed values."""

import warnings

import pytest
from pyspark.sql import functions as F

from variq.operators import charts, derive, design, prepare, signals
from variq.plans.spec import Calibration, CalibrationNotSupportedError, ChartNotAvailableError, ColumnNotFoundError, FactorNotFoundError, SpecLimits, ValidationError
from variq.plans.study import Process, formulate
from variq.sources import readers

SERIES = [50.2, 49.8, 50.5, 50.1, 49.6, 50.9, 50.3, 49.9, 50.4, 50.0, 49.7, 50.6]


def one(df):
    return df.first().asDict()


def test_individuals_of_a_series(spark):
    df = spark.createDataFrame([(i, y) for i, y in enumerate(SERIES)], "i long, y double")
    result = formulate(df, "y", obs_id="i").execute("X", companion=True)
    assert one(result.statistics("X")) == {"N": 1, "center": 50.167, "lpl": 48.619, "upl": 51.714, "limits_vary": False}
    assert one(result.statistics("mR"))["upl"] == pytest.approx(1.901)
    assert result.get_chart("mR").data.count() == 11


def test_stages_have_their_own_limits(spark):
    stages = {"A": [[10, 12, 14], [11, 13, 12], [9, 10, 14], [12, 12, 15]], "B": [[20, 22, 21], [19, 23, 22], [21, 21, 24], [20, 20, 20]]}
    rows = [(i, s, t + 1, float(y)) for s, groups in stages.items() for t, g in enumerate(groups) for i, y in enumerate(g)]
    study = formulate(spark.createDataFrame(rows, "i int, stage string, t int, y double"), "y", ["stage"], "t", obs_id="i")
    chart = study.execute("Xbar", by=["stage", "t"], phased=True).get_chart()
    mean = {s: sum(map(sum, g)) / 12 for s, g in stages.items()}
    for r in chart.data.collect():
        assert r["center"] == pytest.approx(mean[r["stage"]], abs=1e-3)
    assert {r["phase"] for r in chart.data.collect()} == {1, 2}
    assert chart.phases.count() == 2


@pytest.mark.parametrize("state, ads", [(1, 1), (2, 2), (3, 3), (4, 1), (5, 2), (6, 3)])
def test_synthetic_states_classify_to_themselves(spark, state, ads):
    df = readers.synthetic(spark, state, seed=11, **({"n_min": 2, "n_max": 3} if state in (1, 4) else {}))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        study = Process(df).formulate("y", ["factor 1", "factor 2"], "time", obs_id="obs_id")
    assert study.observed_design_state.code == state
    assert study.analytical_design_state.code == ads


def test_identities_of_residuals(spark):
    study = Process(readers.synthetic(spark, 1, seed=3, n_min=2, n_max=4)).formulate("y", ["factor 1"], "time", obs_id="obs_id")
    r = study.frame.rows.withColumn("gap", F.abs(F.col("R3") + F.col("R4") + F.col("R5") - 2 * F.col("R2") - F.col("R1"))).agg(F.max("gap"), F.max(F.abs(F.col("RCR1") - F.col("y")))).first()
    assert r[0] < 1e-9 and r[1] < 1e-9


def test_scaled_differences_run_over_condition_bounds(spark):
    rows = [(1, "a", 1, 1.0), (2, "a", 2, 4.0), (3, "b", 1, 2.0), (4, "b", 2, 9.0)]
    study = formulate(spark.createDataFrame(rows, "i int, f string, t int, y double"), "y", ["f"], "t", obs_id="i")
    got = {r["obs_id"]: r["R2"] for r in study.frame.rows.collect()}
    z = [1.0, -1.0, -1.0, 1.0]  # y - row mean - column mean + mean
    c = (1 / 4 * (1 - 2 / 3)) ** 0.5
    assert got[1] is None
    for k in (1, 2, 3):
        assert got[k + 1] == pytest.approx((z[k] - z[k - 1]) / (2 * c))


def test_undefined_r2_warns_and_withdraws(spark):
    df = spark.createDataFrame([(i, "a", i, float(i)) for i in range(6)], "i int, f string, t int, y double")
    with pytest.warns(UserWarning, match="R2 needs"):
        study = formulate(df, "y", ["f"], "t", obs_id="i")
    assert set(study.residual_charts) == {"R1"}
    with pytest.raises(ChartNotAvailableError):
        study.loss_function()


def test_stratified_equals_a_study_of_the_stratum(spark):
    df = readers.synthetic(spark, 1, seed=5)
    study = Process(df).formulate("y", ["factor 1"], "time", obs_id="obs_id")
    got = {r["obs_id"]: (r["center"], r["lpl"], r["upl"]) for r in study.execute("X", by=["factor 1"]).focus(**{"factor 1": "F1_1"}).get_chart().data.collect()}
    alone = Process(df.filter("`factor 1` = 'F1_1'")).formulate("y", [], "time", obs_id="obs_id").execute("X")
    assert got == {r["obs_id"]: (r["center"], r["lpl"], r["upl"]) for r in alone.get_chart().data.collect()}


def test_companion_equals_solo(spark):
    study = Process(readers.synthetic(spark, 1, seed=6)).formulate("y", ["factor 1"], "time", obs_id="obs_id")
    both, solo = study.execute("Xbar", companion=True).get_chart("S"), study.execute("S").get_chart()
    assert sorted(map(str, both.data.collect())) == sorted(map(str, solo.data.collect()))


def test_halo_buckets_equal_one_window(spark):
    df = spark.range(1000).select(F.col("id").alias("position"), (F.pmod(F.xxhash64("id"), F.lit(9)) / 1.0).alias("value"), F.lit(4.0).alias("center"), F.lit(-2.0).alias("lpl"), F.lit(10.0).alias("upl"))
    from variq.operators import ordered

    rules = tuple(signals.RULES)
    whole = sorted(map(tuple, signals.flag_rules(df, rules).select("position", *[f"rule_{r}" for r in rules]).collect()))
    keep, ordered.over_stream.__defaults__ = ordered.over_stream.__defaults__, (64,)
    try:
        cut = sorted(map(tuple, signals.flag_rules(df, rules).select("position", *[f"rule_{r}" for r in rules]).collect()))
    finally:
        ordered.over_stream.__defaults__ = keep
    assert whole == cut and any(any(r[1:]) for r in whole)


def test_run_rule_and_custom_rule(spark):
    values = [0, 0, 0] + [1] * 8 + [0]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "position long, value double").withColumns({"center": F.lit(0.5), "lpl": F.lit(-3.0), "upl": F.lit(4.0)})
    got = signals.flag_rules(df, (4,), customs={"high": lambda v, c, lo, hi, w: v >= 1})
    assert [r["position"] for r in got.filter("rule_4").collect()] == [10]
    assert got.filter("rule_high").count() == 8
    assert signals.violations(got, (4,), keep=["position"], customs=("high",)).count() == 9


def test_detect_signals_skips_rules_without_points(spark):
    df = spark.createDataFrame([(i, y) for i, y in enumerate(SERIES)], "i long, y double")
    found = formulate(df, "y", obs_id="i").execute("X").detect_signals("X", rules="all")
    assert found.skipped == (6, 7) and found.is_partial and "12 points" in found.evaluation_note


def test_errors(spark):
    df = readers.synthetic(spark, 1, seed=1)
    with pytest.raises(ColumnNotFoundError):
        formulate(df, "nothing")
    with pytest.raises(ValidationError):
        formulate(df, "factor 1")
    study = formulate(df, "y", ["factor 1"], "time", obs_id="obs_id")
    for bad in (dict(chart="X"), dict(chart="Xbar", bins=3), dict(chart="X", by=[], n_sigma=2.0), dict(chart="IMR"), dict(chart="Histogram", companion=True), dict(chart="Xbar", value="R9")):
        with pytest.raises(ValidationError):
            study.execute(**bad)
    with pytest.raises(FactorNotFoundError):
        study.execute("Xbar", by=["factor 2"])
    with pytest.raises(CalibrationNotSupportedError):
        study.execute("X", by=["factor 1"], calibration=Calibration(1, 1))
    with pytest.raises(ValidationError, match="Did you mean"):
        study.execute("Xbr")
    with pytest.raises(ValidationError):
        SpecLimits()
    assert not study.supports_calibration("X", ["factor 1"]) and study.supports_calibration("X", [])


def test_cleaning(spark):
    df = spark.createDataFrame([("$ 1,234.50", "235.5", "ND"), ("(2,000)", "*", "x"), ("5%", "237.2", "y"), ("BDL", "236.1", None)], "a string, b string, c string")
    got = Process(df).data.collect()
    assert [r["a"] for r in got] == [1234.5, -2000.0, 5.0, None]
    assert [r["b"] for r in got] == [235.5, None, 237.2, 236.1]
    assert [r["c"] for r in got] == [None, "x", "y", None]
    odd = spark.createDataFrame([(x, y, z) for x, y, z in zip(["10 12", "1", "2", "3", "4"], ["2024 01"] * 5, ["1,5", "2,25", "3,125", "4", None], strict=True)], "a string, b string, c string")
    with pytest.warns(UserWarning, match="10 12"):
        read = Process(odd).data.collect()
    assert [r["a"] for r in read] == [None, 1.0, 2.0, 3.0, 4.0] and read[0]["b"] == "2024 01"
    assert [r["c"] for r in read] == [1.5, 2.25, 3.125, 4.0, None]


def test_derivations(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 4, 9, -1e-12)], "x double")
    got = derive.materialise(df, [derive.Derivation("transform", "x", "sqrt", "r"), derive.Derivation("bin", "x", "equal_width", "b", {"bins": 3, "labels": "ordinal"})])[0]
    assert sorted(r["r"] for r in got.collect()) == [0, 0, 1, 2, 3]
    assert {r["x"]: r["b"] for r in got.collect()}[9.0] == "High"
    with pytest.raises(ValidationError):
        derive.materialise(df, [derive.Derivation("transform", "x", "log", "l")])
    lost, _ = derive.materialise(df, [derive.Derivation("transform", "x", "inverse", "i", on_invalid="na")])
    assert lost.filter("i is null").count() == 1
    d = derive.fit(df, derive.Derivation("bin", "x", "breaks", "b", {"breaks": [1.0, 4.0]}))
    assert derive.Derivation.from_dict(d.to_dict()) == d
    assert d.fitted["labels"] == ["< 1", "[1, 4)", ">= 4"]
    label = lambda method, **p: derive.fit(df, derive.Derivation("bin", "x", method, "b", p)).fitted["labels"]
    assert label("breaks", breaks=[1.0, 4.0], right=True) == ["<= 1", "(1, 4]", "> 4"]
    assert label("equal_width", bins=3) == ["[-1e-12, 3)", "[3, 6)", "[6, 9]"] and label("equal_width", bins=3, right=True) == ["[-1e-12, 3]", "(3, 6]", "(6, 9]"]
    assert label("equal_width", bins=2, labels="ordinal") == ["Low", "High"] and label("equal_width", bins=2, labels=["a", "b"]) == ["a", "b"]
    assert label("equal_width", bins=2, labels=["a"]) == ["[-1e-12, 4.5)", "[4.5, 9]"] and label("equal_width", bins=6, labels="ordinal")[0] == "Bin 1"
    power = derive.materialise(df, [derive.Derivation("transform", "x", "power", "p", {"exponent": 0.0})])[0]
    assert {r["p"] for r in power.collect()} == {1.0}


def test_issues_of_derivations(spark):
    df = spark.createDataFrame([(float(v), 1.0) for v in (-1, 0, 0, 0, 5)], "x double, flat double")
    found = derive.issues(df, [derive.Derivation("transform", "x", "log", "l"), derive.Derivation("transform", "x", "log", "x", on_invalid="na"), derive.Derivation("bin", "flat", "equal_width", "b", {"bins": 3}), derive.Derivation("bin", "x", "equal_freq", "q", {"bins": 3}), derive.Derivation("transform", "gone", "log")])
    assert [(i["name"], i["severity"], i["count"]) for i in found] == [("l", "error", 4), ("x", "error", None), ("x", "warning", 4), ("b", "error", None), ("q", "warning", None), ("gone_log", "error", None)]


def test_plan_and_report(spark):
    df = readers.synthetic(spark, 1, seed=2, k1=2, k2=1, periods=4)
    study = Process(df).formulate("y", ["factor 1"], "time", plan={"factors": {"factor 1": ["F1_1", "F1_2", "F1_3"]}, "T": 4, "N": 2}, obs_id="obs_id")
    assert study.plan_design_state.code == 1
    assert [r[0] for r in study.missing_combos().collect()] == ["F1_3"]
    assert study.design().first()["K"] == 2
    assert study.support().count() == 23


def test_exports(spark, tmp_path):
    study = Process(readers.synthetic(spark, 1, seed=4)).formulate("y", ["factor 1", "factor 2"], "time", obs_id="obs_id")
    result = study.execute("Xbar", companion=True)
    written = result.export(str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "chart_Xbar")).count() == result.get_chart("Xbar").data.count()
    assert len(written) == 9
    table = result.chart_table("Xbar")
    assert table.columns[0] == "Obs" and table.agg(F.min("Obs")).first()[0] == 1
    assert result.provenance()["rows_analysed"] == study.frame.rows.count()


def test_histogram_bins(spark):
    study = Process(readers.synthetic(spark, 1, seed=4)).formulate("y", ["factor 1"], "time", obs_id="obs_id")
    chart = study.execute("Histogram", by=["factor 1"], bins=7).get_chart()
    assert chart.bins.count() == 21
    assert chart.bins.agg(F.sum("count")).first()[0] == chart.data.count()


def exchanges_of_one_task(df) -> list[int]:
    """Rows that went through exchanges to a single partition, of the plan as it ran."""
    df._jdf.queryExecution().executedPlan().executeCollect()
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in text and "ArrowEval" not in text
    return [k for k, line in enumerate(text.splitlines()) if "SinglePartition" in line]


def test_no_single_partition_for_rows(spark, monkeypatch):
    """Without replication a cell is a row; what goes to one task then has a row a range or a partition, not one a row."""
    from variq.operators import ordered

    monkeypatch.setattr(ordered, "BUCKET", 100)
    n = 3000
    df = spark.range(n).select("id", F.concat(F.lit("c"), F.col("id") % 1000).alias("f"), F.floor(F.col("id") / 1000).alias("t"), (F.pmod(F.xxhash64("id"), F.lit(97)) / 7).alias("y"))
    study = formulate(df, "y", ["f"], "t", obs_id="id")
    assert study.analytical_design_state.reason == "no_replication"
    at = ordered.positions(study.base, [], ["f", "t"], ["obs_id"])
    want = {r[0]: k for k, r in enumerate(study.base.orderBy("f", "t", "obs_id").select("obs_id").collect())}
    assert {r["obs_id"]: r["sort_key"] for r in at.collect()} == want
    parts = at.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < n
    tree = at._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in tree.splitlines() if "Window [" in line]
    assert len(windows) == 2 and all("_range" in line for line in windows)
    ranks = ordered.positions(study.base, ["f"], ["t"], ["obs_id"])
    assert {r["obs_id"]: r["sort_key"] for r in ranks.collect()} == {i: i // 1000 for i in range(n)}


def test_positions_with_nulls_and_ties(spark):
    from variq.operators import ordered

    rows = [(None, 3), (2, 1), (None, 1), (2, 1), (1, 9)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = ordered.positions(df, [], ["a"], ["b"]).collect()
    assert sorted(r["sort_key"] for r in got) == [0, 1, 2, 3, 4]
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["sort_key"])] == [(None, 1), (None, 3), (1, 9), (2, 1), (2, 1)]
    assert ordered.positions(df.limit(0), [], ["a"], ["b"]).count() == 0


def test_limits_of_reports_are_asked_for(spark):
    plan = spark.range(300).select(F.col("id").cast("string").alias("f"))
    cells = spark.createDataFrame([("7", 1)], "f string, n int")
    assert design.missing_combos(cells, plan).count() == 299
    assert [r[0] for r in design.missing_combos(cells, plan, 2).collect()] == ["0", "1"]
    assert design.extra_combos(plan, cells.select("f")).count() == 299
    df = spark.range(3000).select("id", (F.col("id") % 2).alias("label"))
    assert charts.lane_boundaries(df, [], "id", F.col("label")).count() == 2999
    assert charts.lane_boundaries(df, [], "id", F.col("label"), 10).count() == 10


def test_natural_key_of_long_digits(spark):
    names = ["x9999999999999999999998", "x9999999999999999999999", "x10", "x9", "x007b", "x7a", "x"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(prepare.natural_key(F.col("n"))).collect()]
    assert got == ["x", "x7a", "x007b", "x9", "x10", "x9999999999999999999998", "x9999999999999999999999"]


def test_conditions_whose_labels_collide_stay_apart(spark):
    rows = [(i, "a_b", "c", i, 10.0 + i % 3) for i in range(6)] + [(10 + i, "a", "b_c", i, 90.0 + i % 3) for i in range(6)]
    with pytest.warns(UserWarning, match="one name"):
        study = formulate(spark.createDataFrame(rows, "i int, p string, q string, t int, y double"), "y", ["p", "q"], "t", obs_id="i")
    assert sorted(r["rsg"] for r in study.base.select("rsg").distinct().collect()) == ['["a","b_c"]', '["a_b","c"]']
    plain = formulate(spark.createDataFrame([(i, "a_b", "c", i, 1.0 * i) for i in range(4)] + [(9, "d", "e", 1, 2.0)], "i int, p string, q string, t int, y double"), "y", ["p", "q"], "t", obs_id="i")
    assert {r["rsg"] for r in plain.base.select("rsg").collect()} == {"a_b_c", "d_e"}


def test_signals_of_all_charts_summary_and_strata(spark):
    study = Process(readers.synthetic(spark, 1, seed=4)).formulate("y", ["factor 1"], "time", obs_id="obs_id")
    result = study.execute("X", by=["factor 1"], companion=True)
    found = result.detect_signals(rules=(1, 4))
    assert set(found) == {"X", "mR"} and found["X"].n == result.get_chart("X").data.groupBy("factor 1").count().agg(F.max("count")).first()[0]
    assert result.summary().count() == 6 and result.dataset.count() == study.base.count()
    assert result.insufficient_strata("mR").count() == 0
    few = formulate(spark.createDataFrame([(i, "b" if i == 5 else "a", i % 3, float(i)) for i in range(6)], "i int, f string, t int, y double"), "y", ["f"], "t", obs_id="i")
    assert [tuple(r) for r in few.execute("X", by=["f"]).insufficient_strata().collect()] == [("b", 1)]
    lines = result.zone_lines("X").filter("position = 0 and `factor 1` = 'F1_1'").orderBy("sigma").collect()
    assert len(lines) == 7 and lines[3]["level"] == result.get_chart("X").focus(**{"factor 1": "F1_1"}).data.first()["center"]


def test_nested_factor_warns(spark):
    df = spark.createDataFrame([(i, "new" if i >= 12 else "old", i // 4, float(i % 5)) for i in range(24)], "i int, f string, t int, y double")
    study = formulate(df, "y", ["f"], "t", obs_id="i")
    with pytest.warns(UserWarning, match="each period has one level of f"):
        study.loss_function()
    assert "can't be told from time" in study.design_summary()


def test_plan_levels_get_the_type_of_the_data(spark):
    df = spark.createDataFrame([(i, str(1 + i % 2), i // 4, float(i % 5)) for i in range(24)], "i int, f string, t int, y double")
    study = formulate(df, "y", ["f"], "t", obs_id="i", plan={"factors": {"f": ["1", " 2", "3"]}, "T": 6, "N": 2})
    assert study.frame.cells.schema["f"].dataType.simpleString() == "double"
    assert [r["f"] for r in study.missing_combos().collect()] == [3.0] and study.extra_combos().count() == 0
    assert study.levels().filter("planned and observed").count() == 2
    assert study.observed_design_state.n_empty > 0 and "1 of 3 planned conditions" in study.design_summary()


def test_partial_replication_patterns():
    from variq.sources.readers import make_design

    def many(pattern):
        counts: dict = {}
        for t, a, b, _ in make_design(3, 3, 2, 8, seed=1, pattern=pattern):
            counts[a, b, t] = counts.get((a, b, t), 0) + 1
        return {k for k, n in counts.items() if n > 1}

    assert {t for *_, t in many("early_times")} == {1, 2, 3, 4} and {t for *_, t in many("late_times")} == {5, 6, 7, 8}
    assert len(many("checkerboard")) == 24
    assert {k for k in many("corners") if k[0] != "F1_2"} == {(a, b, t) for a in ("F1_1", "F1_3") for b in ("F2_1", "F2_2") for t in range(1, 9)}
    with pytest.raises(ValidationError):
        make_design(3, pattern="other")


def test_workbooks(spark, tmp_path):
    import xml.etree.ElementTree as ET
    import zipfile

    study = Process(readers.synthetic(spark, 1, seed=4)).formulate("y", ["factor 1", "factor 2"], "time", obs_id="obs_id")
    result = study.execute("Xbar", companion=True)
    names = result.to_excel(str(tmp_path / "r.xlsx"))
    assert names[0] == "chart_Xbar" and names[-1] == "provenance"
    with zipfile.ZipFile(tmp_path / "r.xlsx") as book:
        sheet = ET.fromstring(book.read("xl/worksheets/sheet1.xml"))
        rows = sheet.findall(".//{*}row")
        assert len(rows) == result.get_chart("Xbar").data.count() + 1
        assert [c.findtext(".//{*}t") for c in rows[0]] == result.get_chart("Xbar").data.columns
        for part in book.namelist():
            ET.fromstring(book.read(part))
    assert result.detect_signals("Xbar").to_excel(str(tmp_path / "s.xlsx")) == ["violations", "by_rule"]
    from variq.plans.workbook import sheet_names

    assert sheet_names(["a" * 40, "a" * 41, "x/y"]) == ["a" * 31, "a" * 29 + "~2", "x_y"]
    assert len(result.provenance()["fingerprint"]) == 64
