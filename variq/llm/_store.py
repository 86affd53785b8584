"""Intermediate tables in the folder that the cluster shares, and session helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only where it is unset and all runs in one JVM (tests), one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="variq-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def arrow_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows: documents can be long, and a batch is held whole by a worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)

def partition_keys(spark: SparkSession, n: int) -> np.ndarray:
    """n numbers, the k-th of which repartition(n, column) sends to a partition of its own."""
    held, at = {}, 0
    while len(held) < n:
        place = F.pmod(F.hash("id"), F.lit(n))
        held = {r[0]: r[1] for r in spark.range(at, at + 32 * n).groupBy(place.alias("p")).agg(F.min("id")).collect()} | held
        at += 32 * n
    return np.array([held[p] for p in range(n)], np.int64)


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Tables:
    """Written tables that cut lineage: every executor can read them after another is lost."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.held: list[DataFrame] = []

    @contextlib.contextmanager
    def _clean_shuffles(self):
        """Shuffle files of a table that is being written go with the end of the write: nothing reads them again."""
        old = self.spark.conf.get(_CLEAN, None)
        self.spark.conf.set(_CLEAN, "true")
        try:
            yield
        finally:
            self.spark.conf.unset(_CLEAN) if old is None else self.spark.conf.set(_CLEAN, old)

    def save(self, df: DataFrame, label: str = "t", small: bool = False) -> DataFrame:
        """Writes the table and reads it back. small: it has few bytes a task, which are gathered into files of the
        advisory size first."""
        df = df.hint("rebalance") if small else df
        path = f"{self.root}/{label}{self.n}"
        self.n += 1
        with self._clean_shuffles():
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.variq_path = path
        self.held.append(out)
        return out

    def save_bucketed(self, df: DataFrame, key: str, label: str) -> DataFrame:
        """As `save`, in as many buckets by a hash of the key as a shuffle has partitions: joins on the key read it as it is.

        Give it the result of an aggregate by that key: its tasks then write whole buckets.
        """
        path, name = f"{self.root}/{label}{self.n}", f"variq_{uuid.uuid4().hex}"
        self.n += 1
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        with self._clean_shuffles():
            df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        out = self.spark.table(name)
        out.variq_path, out.variq_name = path, name
        self.held.append(out)
        return out

    def drop(self, df: DataFrame) -> None:
        """Removes a table that nothing lazy reads any more."""
        path, name = getattr(df, "variq_path", None), getattr(df, "variq_name", None)
        if name:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            self.held = [x for x in self.held if x is not df]
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def drop_all_but(self, *kept: DataFrame) -> None:
        """Removes all tables saved here but those that the result still reads."""
        for df in [x for x in self.held if not any(x is k for k in kept)]:
            self.drop(df)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
