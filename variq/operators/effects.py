"""Main effects and interactions from residuals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from variq.operators.prepare import Frame


def main_effect(frame: Frame, column: str) -> DataFrame:
    """(level, Main_Effect): mean of R5 by a factor or by rsg."""
    return frame.rows.groupBy(column).agg(F.avg("R5").alias("Main_Effect"))


def time_effect(frame: Frame) -> DataFrame:
    """(period, PT_ME): mean of R4."""
    return frame.rows.groupBy(frame.spec.time).agg(F.avg("R4").alias("PT_ME"))


def main_effect_scores(frame: Frame, column: str) -> DataFrame:
    """Rows with <column>_MEs = R2 + the level's main effect."""
    return frame.rows.join(main_effect(frame, column), column).withColumn(f"{column}_MEs", F.col("R2") + F.col("Main_Effect")).drop("Main_Effect")


def condition_by_time(frame: Frame, ads: int) -> DataFrame:
    """One row a cell: the interaction of condition and period (without replication it comes from the means alone)."""
    keys = frame.keys
    if ads == 2:
        return frame.cells.select(*keys, (F.col("Ybar_kt") - F.col("Ybar_k") - F.col("Ybar_t") + F.col("Ybar")).alias("interaction"))
    return frame.rows.groupBy(*keys).agg(F.avg("R3").alias("interaction"))


def factor_interaction(frame: Frame, a: str, b: str) -> DataFrame:
    """(a, b, Rx): mean R5 of the combination less both main effects."""
    one, two = (main_effect(frame, c).withColumnRenamed("Main_Effect", f"_{k}") for k, c in enumerate((a, b)))
    both = frame.rows.groupBy(a, b).agg(F.avg("R5").alias("_m"))
    return both.join(one, a).join(two, b).select(a, b, (F.col("_m") - F.col("_0") - F.col("_1")).alias("Rx"))


def interaction_scores(frame: Frame, a: str, b: str) -> DataFrame:
    """Rows with Rx_score = R2 + Rx of their combination."""
    return frame.rows.join(factor_interaction(frame, a, b), [a, b]).withColumn("Rx_score", F.col("R2") + F.col("Rx")).drop("Rx")


def melted(frame: Frame) -> DataFrame:
    """(Effect_Type, Level, Value) of all main effects."""
    parts = [main_effect(frame, c).select(F.lit(c).alias("Effect_Type"), F.col(c).cast("string").alias("Level"), F.col("Main_Effect").alias("Value")) for c in ("rsg", *frame.spec.factors)]
    parts.append(time_effect(frame).select(F.lit(frame.spec.time).alias("Effect_Type"), F.col(frame.spec.time).cast("string").alias("Level"), F.col("PT_ME").alias("Value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
