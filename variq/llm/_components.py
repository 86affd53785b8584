"""Connected components of a large graph with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from variq.llm._store import Tables


def components(edges: DataFrame, tables: Tables, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has an edge, with the smallest node of its component.

    Distributed union-find by alternating stars: the large star hangs every larger neighbour of a node on the node's
    smallest neighbour, the small star hangs the node and its smaller neighbours on the smallest of them. The edges
    become stars after about log of the longest path rounds. Each round is a written table, so lineage stays short and
    an executor may be lost. Loops and repeated edges are harmless; null nodes are dropped.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    now, seen = tables.save(now, "edges"), None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        seen_now = Observation()  # counted while the round is written
        marks = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("s")]
        new = tables.save(small.select("e.u", "e.v").filter("u <> v").distinct().observe(seen_now, *marks), "edges")
        mark = seen_now.get
        tables.drop(now)
        now = new
        if mark == seen:
            break
        seen = mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
