"""Statistics of published scenarios, made again by the seeded generator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from variq.plans.study import formulate
from variq.sources.readers import make_design

SCHEMA = "obs_id long, time int, `factor 1` string, `factor 2` string, y double"
BOTH = ["factor 1", "factor 2"]


def study(spark, rows, factors=BOTH):
    return formulate(spark.createDataFrame([(k + 1, *r) for k, r in enumerate(rows)], SCHEMA), "y", factors, "time", obs_id="obs_id")


def numbers(df):
    r = df.first()
    return [r["center"], r["lpl"], r["upl"]]


def test_balanced_xbar_and_s(spark):
    got = study(spark, make_design(1, 3, 2, 4, 3, 3, seed=42)).execute("Xbar", companion=True)
    assert numbers(got.statistics("Xbar")) == [48.928, 48.441, 49.415]
    assert numbers(got.statistics("S")) == [0.249, 0.0, 0.640]
    assert got.statistics("Xbar").first()["N"] == 3


@pytest.mark.parametrize("shape, xbar, s", [((1, 2, 2, 4, 2, 5), 49.739, 0.276), ((1, 3, 2, 6, 2, 4), 49.040, 0.292)])
def test_unequal_sizes(spark, shape, xbar, s):
    got = study(spark, make_design(*shape, seed=42)).execute("Xbar", companion=True)
    assert numbers(got.statistics("Xbar"))[0] == xbar and numbers(got.statistics("S"))[0] == s
    assert got.statistics("Xbar").first()["limits_vary"]


def test_residual_s_chart(spark):
    got = study(spark, make_design(1, 3, 2, 4, 3, 3, seed=42)).execute("S", value="R2")
    assert numbers(got.statistics()) == [0.249, 0.0, 0.640]


@pytest.mark.parametrize(
    "rows, factors, x, mr",
    [
        (make_design(2, 1, 1, 15, seed=42), ["factor 1"], [49.213, 46.365, 52.061], [1.071, 0.0, 3.499]),
        (make_design(1, 3, 2, 6, 2, 4, seed=42), BOTH, [49.085, 46.739, 51.432], [0.882, 0.0, 2.883]),
        (make_design(3, 3, 2, 4, seed=42, p_replicated=0.3), BOTH, [48.991, 45.230, 52.753], [1.414, 0.0, 4.621]),
        (make_design(1, 2, 2, 4, 2, 2, seed=42)[::-1], BOTH, [49.774, 47.549, 52.000], [0.837, 0.0, 2.734]),
    ],
)
@pytest.mark.filterwarnings("ignore")
def test_single_streams(spark, rows, factors, x, mr):
    got = study(spark, rows, factors).execute("X", by=[], companion=True)
    assert numbers(got.statistics("X")) == x and numbers(got.statistics("mR")) == mr


def test_missing_values(spark):
    rows = make_design(1, 2, 2, 4, 3, 3, seed=42)
    gone = np.random.default_rng(99).random(len(rows)) < 0.1
    rows = [(*r[:3], None if g else r[3]) for r, g in zip(rows, gone, strict=True)]
    got = study(spark, rows).execute("X", by=[], companion=True)
    assert numbers(got.statistics("X")) == [49.711, 47.830, 51.593] and numbers(got.statistics("mR")) == [0.707, 0.0, 2.311]


def test_phased_statistics_are_one_a_phase(spark):
    got = study(spark, make_design(1, 3, 2, 6, 2, 4, seed=42)).execute("Xbar", by=["factor 1", "factor 2", "time"], phased=True)
    assert got.statistics().count() == 6 and got.phase_statistics().agg(F.count("*")).first()[0] == 6
