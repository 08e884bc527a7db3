"""Shared pieces of the corpus operators: scratch tables, words, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as a Java and a Python pattern.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is made only where none is set and Spark runs in one process."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="statelace-"))
        found = sc.getCheckpointDir()
    return found


#: Whether the shuffle files of a query go as soon as it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables written to the shared folder, to cut lineage or to compute a step once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{shared_dir(spark)}/scratch"

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        """A table of ``df``'s rows; the shuffles that made them leave no files."""
        path = f"{self.base}/{tag}-{uuid.uuid4().hex}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Count of words of a text; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(*cols: Column) -> Column:
    """A number in [0, 1) fixed by the given values alone."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / F.lit(float(1 << 53))


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, for every node that has a link.

    Alternating large-star and small-star rounds: each points the neighbours of a node at its smallest
    neighbour. Minima are combined before the shuffle and hubs meet them in a plain sort-merge join, which
    adaptive execution splits; every round is written to the shared folder, so lost executors cost one round.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark)
    now = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "links"
    )
    if now.isEmpty():
        return now.select(F.col("v").alias("node"), F.col("u").alias("component"))

    def stamp(df: DataFrame) -> tuple:
        r = df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        return (r[0], r[1])

    def star(e: DataFrame) -> DataFrame:
        # large star: v > u, v goes to the least neighbour of u
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = e.join(low, "u").select("v", F.col("m").alias("u")).where("v <> u").distinct()
        # small star: v's lesser neighbours and v itself go to the least of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        hooked = large.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        return hooked.union(least.select("v", F.col("m").alias("u"))).distinct()

    before, after = None, stamp(now)
    while after != before:  # a round shortens every path, so their number grows with the logarithm of the longest
        new = scratch.write(star(now), "links")
        before, after = after, stamp(new)
        scratch.drop(now)
        now = new
    return now.select(F.col("v").alias("node"), F.col("u").alias("component"))
