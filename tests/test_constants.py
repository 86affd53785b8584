import math

import pytest
from pyspark.sql import functions as F

from variq.functions import limits as L


def test_c4_values():
    assert L.c4(2) == pytest.approx(0.7978845608)
    assert L.c4(5) == pytest.approx(0.9399856030)
    assert L.b4(5) == pytest.approx(2.089, abs=1e-3)
    assert L.b3(5) == 0
    with pytest.raises(ValueError):
        L.c4(1)


def test_columns_equal_numbers(spark):
    ns = [2, 3, 10, 39, 40, 41, 200, 5000]
    got = spark.createDataFrame([(n,) for n in [1, *ns]], "n long").select("n", L.c4_col(F.col("n")).alias("c"), L.b3_col(F.col("n")).alias("l"), L.b4_col(F.col("n")).alias("u")).collect()
    assert got[0]["c"] is None
    for r in got[1:]:
        assert r["c"] == pytest.approx(L.c4(r["n"]), rel=1e-10)
        assert r["l"] == pytest.approx(L.b3(r["n"]), abs=1e-9)
        assert r["u"] == pytest.approx(L.b4(r["n"]), rel=1e-9)


def test_rounding_is_half_even(spark):
    got = spark.range(1).select(L.rounded(F.lit(0.0625), 3).alias("a"), L.rounded(F.lit(2.5), 0).alias("b")).first()
    assert (got["a"], got["b"]) == (0.062, 2.0)


def test_calibrated():
    assert L.calibrated("Xbar", 10, 2, 4) == (10, 7, 13)
    center, low, high = L.calibrated("mR", 0, 1)
    assert (center, low) == (1.128, 0) and math.isclose(high, L.D4 * 1.128)
