"""What several of the corpus operators share: the shared folder, tables written there, connected components."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see. One of our own is set only where there is no cluster."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder. drop() removes those that no lazy result reads any more; the rest goes as the driver ends."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        atexit.register(self._end)

    def _end(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            if self.spark.sparkContext._jsc is not None:
                self.drop("")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) for undirected ``edges`` (a, b), where component is the smallest node that can be reached.

    Alternates the large-star and small-star steps: each keeps connectivity, and a forest of stars is reached in a
    number of rounds that grows with the logarithm of the longest path. Every round is checkpointed, so that a lost
    executor costs one round. Hub nodes cost nothing extra: minima are combined before the shuffle, and joins on a
    hub are ordinary joins that adaptive execution can split.
    """

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()

    def small_star(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        joined = e.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        return joined.union(low.select("a", F.col("m").alias("b"))).distinct()

    def settled(e: DataFrame) -> bool:
        """Are all edges those of stars: one for each node that is no center?"""
        if not e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return False
        return e.groupBy("a").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").isEmpty()

    e = checkpointed(small_star(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()))
    for _ in range(max_rounds):
        if settled(e):
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        e = checkpointed(small_star(large_star(e)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
