"""Domain tables over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Samples per second of the sequences below.
FS = 250.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, sample_ix, label, value): a user's events in order; errors are unassigned samples."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events")
    label = F.when(F.col("event_type") != "error", F.col("event_type"))
    return e.select(F.col("user_id").alias("recording_id"), (F.row_number().over(w) - 1).cast("long").alias("sample_ix"), label.alias("label"), "value")


def long_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, sample_ix, label): the events of twenty users, one user after the other, as a recording."""
    s = segmentation(spark, sf_dir).withColumn("group_id", F.floor(F.col("recording_id") / 20))
    w = Window.partitionBy("group_id").orderBy("recording_id", "sample_ix")
    return s.select(F.col("group_id").alias("recording_id"), (F.row_number().over(w) - 1).cast("long").alias("_i"), "label").withColumnRenamed("_i", "sample_ix")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, t_ms, label): the samples of each user as a trial, 10 ms apart, from -200 ms on."""
    s = segmentation(spark, sf_dir)
    return s.select(F.col("recording_id").alias("trial"), ((F.col("sample_ix") - 20) * 10.0).cast("double").alias("t_ms"), "label")


def topographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_ix, state0, topo): embeddings as samples; state0 is their given label."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("sample_ix"), F.col("label").alias("state0"), F.col("embedding").cast("array<double>").alias("topo"))


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(state, label, topo): the first member of each embedding label."""
    t = topographies(spark, sf_dir).groupBy("state0").agg(F.min_by("topo", "sample_ix").alias("topo"))
    return t.select(F.col("state0").alias("state"), F.concat(F.lit("S"), F.col("state0")).alias("label"), "topo")


def leadfield(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, topo): the first two members of each embedding label as the fields of sources."""
    w = Window.partitionBy("state0").orderBy("sample_ix")
    first = topographies(spark, sf_dir).withColumn("_n", F.row_number().over(w)).where("_n <= 2")
    return first.select((F.col("state0") * 2 + F.col("_n") - 1).cast("int").alias("source"), "topo")


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, onset_s, description): signups and purchases, a sample every 0.004 s."""
    s = segmentation(spark, sf_dir).where("label in ('signup', 'purchase')")
    return s.select("recording_id", (F.col("sample_ix") / FS).alias("onset_s"), F.col("label").alias("description"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, grp, subject, value): mean event value by type; two studies of paired subjects."""
    e = read(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.avg("value").alias("value"))
    grp = F.when(F.col("user_id") % 2 == 0, "a").otherwise("b")
    return e.select(F.col("event_type").alias("feature"), grp.alias("grp"), F.floor(F.col("user_id") / 2).alias("subject"), "value")


def trial_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(feature, grp, subject, value): every event's value by type; users of two groups are subjects, events their trials."""
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("feature"), F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("grp"), F.col("user_id").alias("subject"), "value")


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trial, grp, t_ms, state, value): whether a trial of ``epochs`` is in a state at a time, for every state that occurs."""
    e = epochs(spark, sf_dir)
    states = e.where("label is not null").agg(F.array_sort(F.collect_set("label")).alias("_s"))
    cells = e.join(F.broadcast(states)).withColumn("state", F.explode("_s"))  # one row of a few states
    here = F.coalesce((F.col("label") == F.col("state")).cast("double"), F.lit(0.0))
    return cells.select("trial", F.when(F.col("trial") % 2 == 0, "a").otherwise("b").alias("grp"), "t_ms", "state", here.alias("value"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name): a pre and a post recording of each customer, the first alone of those in debt."""
    c = read(spark, sf_dir, "customer")
    base = F.concat(F.lit("sub-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"), F.lit("_task-rest"))
    both = F.when(F.col("c_acctbal") < 0, F.array(F.lit("_Pre"))).otherwise(F.array(F.lit("_Pre"), F.lit("_Post")))
    return c.select(base.alias("base"), F.explode(both).alias("part")).select(F.concat("base", "part", F.lit("_trial1")).alias("name"))


def pairs_of_names(spark: SparkSession, sf_dir: str, table: str, key: str, before: str, after: tuple[str, str]) -> DataFrame:
    """(name): two names of each customer or supplier, the first alone of those in debt."""
    t = read(spark, sf_dir, table)
    number = F.col("c_custkey" if key == "c" else "s_suppkey").cast("string")
    both = F.when(F.col(f"{key}_acctbal") < 0, F.array(F.lit(after[0]))).otherwise(F.array(*map(F.lit, after)))
    return t.select(number.alias("k"), F.explode(both).alias("part")).select(F.concat(F.lit(before), "k", "part").alias("name"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording_id, channel_ix, channel, is_bad, montage): parts as channels of recordings, spelt in two ways."""
    p = read(spark, sf_dir, "part")
    prefix = F.when(F.col("p_size") % 2 == 0, "CH").otherwise("Ch")
    spelt = F.concat(prefix, F.floor(F.sqrt("p_partkey")).cast("string"))
    return p.select((F.col("p_partkey") % 10).alias("recording_id"), F.col("p_partkey").alias("channel_ix"), spelt.alias("channel"), (F.col("p_size") > 45).alias("is_bad"), F.col("p_brand").alias("montage"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(montage, channel_ix, x, y, z): parts as electrodes, 32 to a montage."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey").cast("double")
    return p.select(F.concat(F.lit("m"), F.floor(F.col("p_partkey") / 32).cast("string")).alias("montage"), F.col("p_partkey").cast("int").alias("channel_ix"), (k % 7).alias("x"), (k * 0.37 % 3).alias("y"), (k * k % 11 * 0.1).alias("z"))
