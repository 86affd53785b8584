"""Ordered streams without a single partition.

Rows are dealt into ranges of their order, whose bounds come from a bounded sample of keys. A position is a range's
offset (a running sum over one row a range and stream) plus the row number within the range, so no task sorts more than
a range. Windows over positions are cut into buckets of BUCKET rows; the last rows of a bucket are copied into the next
one as a halo that is as wide as the window looks back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 100_000
#: Sampled keys a range; the driver sees ranges x SAMPLED keys at most.
SAMPLED = 64


def _before(columns: list[str], bound: list[Column]) -> Column:
    """Whether a row's key comes before the bound (nulls first, as in a sort)."""
    out = F.lit(False)
    for c, at in zip(reversed(columns), reversed(bound), strict=True):
        here = F.col(c)
        out = F.when(here.eqNullSafe(at), out).otherwise(F.coalesce(here < at, here.isNull()))
    return out


def ranges(df: DataFrame, keys: list[str], n: int | None = None) -> Column:
    """The number of each row's range, out of about n ranges of equal size in order of the keys.

    Runs one job: a sample of rows' keys, bounded by the number of ranges whatever the number of rows. Equal keys are in
    one range. The bounds are constants of the plan, so every part of it deals rows alike.
    """
    n = n or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = df.select(*keys)
    found = held.withColumn("_r", F.rand(11)).orderBy("_r").limit(n * SAMPLED).select(*keys).collect() if n > 1 else []
    found = sorted({tuple(r) for r in found}, key=lambda r: [(v is not None, v != v, 0 if v is None or v != v else v) for v in r])  # nulls first, NaN last, as Spark sorts
    cuts = list(dict.fromkeys(found[len(found) * i // n] for i in range(1, n))) if found else []
    bounds = [[F.lit(v).cast(field.dataType) for v, field in zip(row, held.schema.fields, strict=True)] for row in cuts]

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(_before(keys, bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def positions(df: DataFrame, streams: list[str], blocks: list[str], order: list[str], name: str = "sort_key", like: DataFrame | None = None) -> DataFrame:
    """Adds the 0-based position of each row in its stream, in order of (blocks, order).

    like: a frame with about the same keys that costs less to read; ranges are then bounded by its keys. They decide how
    rows are dealt, not the positions.
    """
    keys = [*blocks, *order]
    known = like if like is not None and {*streams, *keys} <= {*like.columns} else df
    dealt = df.withColumn("_range", ranges(known, [*streams, *keys]))
    size = dealt.groupBy(*streams, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*streams).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    size = size.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    row = F.row_number().over(Window.partitionBy(*streams, "_range").orderBy(*keys))
    out = dealt.withColumn("_row", row).join(size, [*streams, "_range"])
    return out.withColumn(name, (F.col("_offset") + F.col("_row") - 1).cast("long")).drop("_offset", "_row", "_range")


def over_stream(df: DataFrame, streams: list[str], position: str, look_back: int, make, bucket: int = BUCKET) -> DataFrame:
    """df with the columns make(window) -> {name: Column}, for windows that look back at most look_back rows.

    Every bucket is a partition of its own, so one long stream is spread over the cluster.
    """
    late = F.col(position) % bucket >= bucket - look_back
    halo = df.withColumn("_halo", F.explode(F.when(late, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    cut = halo.withColumn("_bucket", F.floor(F.col(position) / bucket) + F.col("_halo").cast("int"))
    window = Window.partitionBy(*streams, "_bucket").orderBy(position)
    return cut.withColumns(make(window)).filter(~F.col("_halo")).drop("_halo", "_bucket")


def previous(df: DataFrame, streams: list[str], position: str, value: Column, name: str) -> DataFrame:
    """df with the value of the row before it in the stream (null for the first)."""
    return over_stream(df, streams, position, 1, lambda w: {name: F.lag(value).over(w)})


def quantiles(df: DataFrame, value: str, ps: list[float]) -> list[float | None]:
    """Exact quantiles (linear between neighbours) of the non-null values; nulls without any.

    Values are sorted in ranges and only the rows at the wanted places, two a quantile, reach the driver.
    """
    held = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    n = held.count()
    if not n:
        return [None] * len(ps)
    spots = [p * (n - 1) for p in ps]
    wanted = sorted({k for s in spots for k in (int(s), min(int(s) + 1, n - 1))})
    at = dict(positions(held, [], [], ["v"], "at").filter(F.col("at").isin(wanted)).select("at", "v").collect())
    return [at[int(s)] + (s - int(s)) * (at[min(int(s) + 1, n - 1)] - at[int(s)]) for s in spots]
