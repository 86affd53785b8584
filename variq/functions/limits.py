"""Constants and limit formulas of control charts, as Python numbers and as Spark columns.

Column forms are plain expressions (a literal table for small n, a series beyond), so a limit for any subgroup size is
computed inside code generation and no distinct size has to reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Constants of moving ranges of two readings. Fixed values.
D2, D3 = 1.128, 0.8525
E2 = 3 / D2
D4 = 1 + 3 * D3 / D2
#: Points of a moving-range chart -> 80 % interval of its sigma relative to the truth; 30 bounds longer series. Fixed values.
SIGMA_INTERVAL_80 = {
    3: (0.337, 1.810), 4: (0.430, 1.676), 5: (0.488, 1.593), 6: (0.528, 1.526), 7: (0.565, 1.484), 8: (0.595, 1.453), 9: (0.618, 1.418),
    10: (0.637, 1.396), 11: (0.656, 1.375), 12: (0.670, 1.359), 13: (0.680, 1.344), 14: (0.694, 1.329), 15: (0.703, 1.315), 16: (0.714, 1.310),
    17: (0.721, 1.300), 18: (0.730, 1.288), 19: (0.739, 1.280), 20: (0.745, 1.274), 21: (0.749, 1.266), 22: (0.756, 1.258), 23: (0.761, 1.253),
    24: (0.766, 1.249), 25: (0.771, 1.243), 26: (0.774, 1.238), 27: (0.780, 1.234), 28: (0.784, 1.229), 29: (0.787, 1.223), 30: (0.790, 1.220),
}
_TABLE = 40  # c4 is tabled below this n; from there on the series is exact to double precision


def c4(n: int) -> float:
    if n < 2:
        raise ValueError(f"c4 needs a subgroup size of 2 or more, not {n}")
    return math.sqrt(2 / (n - 1)) * math.exp(math.lgamma(n / 2) - math.lgamma((n - 1) / 2))


def b3(n: int, m: float = 3.0) -> float:
    return max(0.0, 1 - m / c4(n) * math.sqrt(1 - c4(n) ** 2))


def b4(n: int, m: float = 3.0) -> float:
    return 1 + m / c4(n) * math.sqrt(1 - c4(n) ** 2)


def c4_col(n: Column) -> Column:
    """c4 of an integer column; null below 2.

    With x = (n - 1) / 2, c4 = exp(lnGamma(x + 1/2) - lnGamma(x) - ln(x) / 2), whose asymptotic series is used from
    n = 40 on.
    """
    x = (n.cast("double") - 1) / 2
    table = F.array(*[F.lit(c4(k)) for k in range(2, _TABLE)])
    series = F.exp(-1 / (8 * x) + 1 / (192 * x * x * x) - 1 / (640 * F.pow(x, F.lit(5))) + 17 / (14336 * F.pow(x, F.lit(7))) - 31 / (18432 * F.pow(x, F.lit(9))))
    return F.when(n < 2, None).when(n < _TABLE, F.get(table, n.cast("int") - 2)).otherwise(series)


def b3_col(n: Column, m: float = 3.0) -> Column:
    c = c4_col(n)
    return F.greatest(F.lit(0.0), 1 - m / c * F.sqrt(1 - c * c))


def b4_col(n: Column, m: float = 3.0) -> Column:
    c = c4_col(n)
    return 1 + m / c * F.sqrt(1 - c * c)


def rounded(c: Column, digits: int = 3) -> Column:
    """Half-even on the scaled double, as numpy rounds."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def beyond(v: Column, lpl: Column, upl: Column) -> Column:
    """-1 below, 1 above, else 0; unknown counts as inside."""
    return F.when(v < lpl, -1).when(v > upl, 1).otherwise(0)


def xmr_limits(center: float, mr_bar: float) -> tuple[float, float]:
    return center - E2 * mr_bar, center + E2 * mr_bar


def calibrated(chart: str, mean: float, sigma: float, n: int | None = None, m: float = 3.0) -> tuple[float, float, float]:
    """(center, lower, upper) from given standards."""
    if chart == "Xbar":
        half = m * sigma / math.sqrt(n)
        return mean, mean - half, mean + half
    if chart == "S":
        s = c4(n) * sigma
        return s, b3(n, m) * s, b4(n, m) * s
    if chart == "X":
        return mean, mean - 3 * sigma, mean + 3 * sigma
    r = D2 * sigma
    return r, 0.0, D4 * r
