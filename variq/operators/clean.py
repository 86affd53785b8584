"""Cleaning of text columns: garbage tokens, formatted numbers, kinds of time and factor columns.

Decisions that depend on the data (does a column convert?) are counted for all columns in one aggregate, whose single
row reaches the driver; the casts themselves are projections.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from variq.plans.spec import VariqWarning

#: Entries that mean no value, compared exactly. Fixed values.
TOKENS = ["*", "?", "--", "ND", "BDL", "BQL", "<LOD", ">ULQ", "N/D", "n/d", "MISSING", "missing"]
#: Currency signs that are ignored in numbers. Fixed values.
CURRENCY = "[$€£¥]"
ACCEPT = 0.8  # share of a column's values that must convert
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
#: Groups of three behind commas, with a sign, decimals or a per cent sign at most.
GROUPED = r"^-?\d{1,3}(,\d{3})+(\.\d+)?%?$"
DATES = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "MM/dd/yyyy", "M/d/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy", "MMM d, yyyy"]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def tokens_to_null(df: DataFrame, na_values: list[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    tokens = [*TOKENS, *(na_values or [])]
    return df.withColumns({c: F.when(F.col(c).isin(tokens), None).otherwise(F.col(c)) for c in columns or text_columns(df)}) if text_columns(df) else df


def plain_number(c: Column) -> Column:
    """A double, or null if the text isn't a bare number (Spark's own cast would take 12d and inf)."""
    c = F.trim(c)
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def formatted_number(c: Column, role: str) -> Column:
    """A double from text with currency signs, per cent, commas or accounting parentheses.

    role of commas: none, decimal or thousands; a comma that doesn't part groups of three is no thousands mark. Blanks
    count only at the ends and behind a currency sign, so "10 12" is no number.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\((.*)\)$", "-$1"), CURRENCY + r"\s*", "")
    if role == "decimal":
        bare = F.replace(bare, F.lit(","), F.lit("."))
    elif role == "thousands":
        bare = F.when(~bare.contains(","), bare).when(bare.rlike(GROUPED), F.replace(bare, F.lit(",")))
    return plain_number(F.replace(bare, F.lit("%")))


def _role(stats, c: str) -> str:
    if not stats[f"{c}_comma"]:
        return "none"
    return "decimal" if not stats[f"{c}_dot"] and stats[f"{c}_odd"] else "thousands"


def clean(df: DataFrame, na_values: list[str] | None = None) -> tuple[DataFrame, dict[str, dict]]:
    """The rows with garbage as null and number-like columns as doubles; and a report a column.

    Two aggregates at most, whatever the number of columns: comma roles, then counts of what converts.
    """
    df = tokens_to_null(df, na_values)
    columns = text_columns(df)
    if not columns:
        return df, {}
    stats = df.agg(
        *[F.count_if(F.col(c).contains(",")).alias(f"{c}_comma") for c in columns], *[F.count_if(F.col(c).contains(".")).alias(f"{c}_dot") for c in columns],
        *[F.count_if(F.col(c).rlike(r"\d,(?!\d{3}(?!\d))\d")).alias(f"{c}_odd") for c in columns],
    ).first()
    roles = {c: _role(stats, c) for c in columns}
    made = {c: formatted_number(F.col(c), roles[c]) for c in columns}
    plain = {c: plain_number(F.col(c)) for c in columns}
    odd = lambda c: [f(F.when(made[c].isNull(), F.col(c))).alias(f"{c}_{k}") for k, f in (("low", F.min), ("high", F.max))]
    counts = df.agg(*[F.count(c).alias(f"{c}_n") for c in columns], *[F.count(made[c]).alias(f"{c}_ok") for c in columns], *[F.count(plain[c]).alias(f"{c}_plain") for c in columns], *[x for c in columns for x in odd(c)]).first()
    report, casts = {}, {}
    for c in columns:
        n, ok, bare = counts[f"{c}_n"], counts[f"{c}_ok"], counts[f"{c}_plain"]
        # A column that is plain numbers for the most part is read as that alone.
        direct = n > 0 and roles[c] == "none" and bare >= ACCEPT * n
        taken = direct or n > 0 and ok >= ACCEPT * n
        read = bare if direct else ok
        examples = sorted({x for x in (counts[f"{c}_low"], counts[f"{c}_high"]) if x is not None})
        report[c] = {"values": n, "converted": taken, "reformatted": read - bare if taken else 0, "unreadable": n - read if taken else 0, "examples": examples if taken else [], "commas": roles[c]}
        if taken:
            casts[c] = plain[c] if direct else made[c]
            if report[c]["unreadable"]:
                warnings.warn(f"{c}: {n - read} values are no numbers" + f", as {' and '.join(map(repr, examples))}" * bool(examples) + "; they count as missing", VariqWarning, stacklevel=2)
    return (df.withColumns(casts) if casts else df), report


def any_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATES])


def detect_kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """String columns among `columns` as numbers (all values parse, or some do and one is null), else as timestamps
    (more than half parse), else unchanged."""
    text = [c for c in columns if c in text_columns(df)]
    if not text:
        return df
    got = df.agg(F.count("*").alias("_all"), *[F.count(c).alias(f"{c}_n") for c in text], *[F.count(plain_number(F.col(c))).alias(f"{c}_num") for c in text], *[F.count(any_date(F.col(c))).alias(f"{c}_date") for c in text]).first()
    casts = {}
    for c in text:
        n, num, date = got[f"{c}_n"], got[f"{c}_num"], got[f"{c}_date"]
        if num and (num == n or got["_all"] > n):
            casts[c] = plain_number(F.col(c))
        elif date > 0.5 * n:
            casts[c] = any_date(F.col(c))
    return df.withColumns(casts) if casts else df
