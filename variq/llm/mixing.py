"""Mixing sources to target weights with DataFrame expressions only.

One aggregate gives the words of each source, size class and range of draws; windows over that small table fill targets
up to `limit` times a source's size and count the documents before each range. Every document is copied floor(rate)
times plus one Bernoulli copy with probability equal to the rate's fraction, seeded by a hash of its id, so reruns and
retried tasks agree. Draws of a source are systematic: along its documents, from the largest size class down and by hash
within a class, the k-th takes its copy when start + k x fraction passes a whole number (the start is a hash of the
source). So a source's taken words differ from its target by about its largest document at most, not by chance.

A document's place in its source is the small table's offset plus its row number in its range, so a hot source is spread
over as many tasks as there are ranges. The small table is written and goes back to the rows by an ordinary equi-join:
Spark broadcasts it only when its size is below its own threshold.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; rows without an id are seeded
by a hash of their other columns; rows repeated with the same id and size lie next to each other; an empty table gives
no rows; columns of the input named like an output are replaced by the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variq.llm._store import Tables

#: What counts as a word: a run of anything but blanks and the separators 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Digits of the hash that seed a draw: 13 hex digits fit a double's 52 bits.
_DIGITS = 13


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), key.cast("string")).cast("binary")), 1, _DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def source_targets(sized: DataFrame, size: str, weights: tuple[int, ...], limit: int) -> DataFrame:
    """One row a source (_none, _source): source_size and target.

    Water filling: order sources by the level at which they reach their limit; with all sooner ones at their limit, a
    source is full when the level that the rest would share is at or above its own. The first that isn't full sets
    the level of all later ones.
    """
    total = sized.groupBy("_none", "_source").agg(F.sum(size).alias("source_size"))
    rank = F.row_number().over(Window.orderBy("_none", "_source"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    t = total.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * limit)
    t = t.withColumn("_reach", F.col("_cap") / F.col("_w"))
    before = Window.orderBy("_reach", "_none", "_source").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("_reach", "_none", "_source").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
    t = t.withColumn("_level", F.col("_left") / F.sum("_w").over(after))
    t = t.withColumn("_full", F.col("_level") >= F.col("_reach"))
    t = t.withColumn("_shared", F.min_by(F.when(~F.col("_full"), F.col("_level")), F.when(~F.col("_full"), F.col("_reach"))).over(everything))
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_shared") * F.col("_w"))
    return t.select("_none", "_source", "source_size", target.alias("target"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", size: Column | None = None, text: str = "text", weights: tuple[int, ...] = (1, 2, 3), limit: int = 3, seed: str = "mix") -> DataFrame:
    """The documents with size, source_size, target, copies and taken (= copies x size).

    weights go round over the sources in code-point order; `size` replaces the word count of `text`. Runs one job, for
    the table of sources, size classes and ranges.
    """
    made, own = ["size", "source_size", "target", "copies", "taken"], ["_none", "_source", "_class", "_range", "_draw"]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sized = docs.drop(*made, *own).withColumn("size", n_words(F.col(text)) if size is None else size)
    sized = sized.withColumn("_none", F.col(source).isNull()).withColumn("_source", F.coalesce(F.col(source), F.lit("")))
    key = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("-"), F.xxhash64(*[c for c in sized.columns if c != doc_id]).cast("string")))
    sized = sized.withColumn("_class", F.length(F.bin("size"))).withColumn("_draw", draw(key, seed))
    sized = sized.withColumn("_range", F.floor(F.col("_draw") * n).cast("int"))
    small = sized.groupBy("_none", "_source", "_class", "_range").agg(F.sum("size").alias("size"), F.count("*").alias("_n"))
    tables = Tables(docs.sparkSession, "mix")
    small = tables.save(small, "sizes")
    sooner = Window.partitionBy("_none", "_source").orderBy(F.desc("_class"), "_range").rowsBetween(Window.unboundedPreceding, -1)
    offset = small.select("_none", "_source", "_class", "_range", F.coalesce(F.sum("_n").over(sooner), F.lit(0)).alias("_offset"))
    places = tables.save(offset.join(source_targets(small, "size", weights, limit), ["_none", "_source"]), "places")
    tables.drop(small)
    row = F.row_number().over(Window.partitionBy("_none", "_source", "_class", "_range").orderBy("_draw", doc_id, "size"))
    out = sized.withColumn("_row", row).join(places, ["_none", "_source", "_class", "_range"], "left")
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    out = out.withColumn("_fraction", rate - F.floor(rate)).withColumn("_start", draw(F.concat(F.lit("source:"), F.col("_source")), seed))
    k = (F.col("_offset") + F.col("_row")).cast("double")
    copy = F.floor(F.col("_start") + k * F.col("_fraction")) - F.floor(F.col("_start") + (k - 1) * F.col("_fraction"))
    out = out.withColumn("copies", (F.floor(rate) + copy).cast("long"))
    return out.withColumn("taken", F.col("copies") * F.col("size")).drop(*own, "_row", "_offset", "_fraction", "_start")


def emit_copies(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it; a column copy counts from 0."""
    return mixed.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
