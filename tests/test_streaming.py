import datetime

from pyspark.sql import functions as F

from variq.plans.spec import Calibration
from variq.streaming import monitor


def test_flag_and_runs_over_batches(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    src = tmp_path / "in"
    for part, values in enumerate(([1.0] * 5, [1.0] * 4 + [9.0])):
        rows = [(start + datetime.timedelta(minutes=part * 100 + i), "a", v) for i, v in enumerate(values)]
        spark.createDataFrame(rows, "ts timestamp, k string, v double").coalesce(1).write.mode("append").parquet(str(src))
    stream = spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(str(src))
    flagged = monitor.flag(stream, "v", Calibration(0.0, 1.0))
    assert flagged.isStreaming
    q = monitor.run_rules(stream, "ts", "v", "k", Calibration(0.0, 1.0)).writeStream.format("memory").queryName("runs").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = spark.table("runs").orderBy("ts").collect()
    assert [r["run"] for r in got] == [True, True, True]
    assert [r["beyond_limits"] for r in got] == [False, False, True]
    assert monitor.windowed(stream, "ts", "v", ["k"]).isStreaming
    assert flagged.select(F.col("upl")).schema["upl"].dataType.simpleString() == "double"


def test_rules_over_a_series_equal_the_batch_rules(spark):
    import numpy as np

    from variq.operators import signals

    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(0, 1.2, 300), np.linspace(-1, 1, 9), [1, -1] * 9, rng.normal(0, 0.2, 40), rng.normal(1.5, 0.3, 20)])
    df = spark.createDataFrame([(k, float(x), 0.0, -3.0, 3.0) for k, x in enumerate(v)], "position long, value double, center double, lpl double, upl double")
    got = sorted(signals.flag_rules(df, tuple(signals.RULES)).collect(), key=lambda r: r["position"])
    for rule in signals.RULES:
        want = [bool(r[f"rule_{rule}"]) for r in got]
        assert any(want) and monitor.flags(v, rule, 0.0, 1.0, signals.Parameters()).tolist() == want, rule


def test_late_readings_stand_alone(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    src = tmp_path / "in"
    for part, rows in enumerate(([(10, 1.0), (11, 1.0)], [(1, 9.0), (2, 1.0), (12, 1.0), (13, None)])):
        spark.createDataFrame([(start + datetime.timedelta(minutes=i), "a", v) for i, v in rows], "ts timestamp, k string, v double").coalesce(1).write.mode("append").parquet(str(src))
        if not part:
            import time

            time.sleep(1.1)  # files are read in order of their time
    stream = spark.readStream.schema("ts timestamp, k string, v double").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = monitor.run_rules(stream, "ts", "v", "k", Calibration(0.0, 1.0), run=3, rules=(1, 4)).writeStream.format("memory").queryName("late").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(120)
    got = [(r["ts"].minute, r["rules"], r["late"]) for r in spark.table("late").orderBy("ts").collect()]
    assert got == [(1, [1], True), (12, [4], False)]
