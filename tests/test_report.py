from variq.plans import report
from variq.plans.study import formulate
from variq.sources.readers import coffee_shop, synthetic


def test_report_and_thinning(spark, tmp_path):
    study = formulate(synthetic(spark, 1, seed=4), "y", ["factor 1"], "time", obs_id="obs_id")
    result = study.execute("X", by=["factor 1"], companion=True)
    page = open(report.write(result, str(tmp_path / "r.html"))).read()
    assert page.count("<svg") == 6 and "full_replication" in page
    whole = study.execute("X", by=[]).get_chart()
    few = report.thinned(whole, points=10)
    assert len(few) <= 10
    every = report.thinned(whole)
    assert max(r[1] for r in few) == max(r[1] for r in every) and min(r[1] for r in few) == min(r[1] for r in every)


def test_demo_data(spark):
    df = coffee_shop(spark)
    assert df.count() == 384 and df.select("daypart").distinct().count() == 2
    study = formulate(df, "wait_sec", ["daypart"], "week")
    assert study.analytical_design_state.reason == "full_replication"
