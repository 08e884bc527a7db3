"""Joins and set operations between studies, files, channels and subjects."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_common(a: DataFrame, b: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Full outer join on the columns both have (or ``keys``)."""
    return a.join(b, list(keys or [c for c in a.columns if c in b.columns]), "full")


def stack_common(parts: dict[str, DataFrame], tag: str = "study") -> DataFrame:
    """Rows of all tables in the columns they share, tagged by name."""
    shared = [c for c in next(iter(parts.values())).columns if all(c in p.columns for p in parts.values())]
    return reduce(DataFrame.unionByName, [p.select(*shared, F.lit(n).alias(tag)) for n, p in parts.items()])


def matched_subjects(a: DataFrame, b: DataFrame, subject: str = "subject") -> DataFrame:
    return a.select(subject).distinct().join(b.select(subject).distinct(), subject)


def missing(wanted: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` without a partner."""
    return wanted.join(found, list(keys), "left_anti")


def channel_consistency(channels: DataFrame) -> DataFrame:
    """(channel, files, consistent): files per name whatever its case, under its first spelling. Rows: (recording_id, channel_ix, channel)."""
    n = channels.select(F.countDistinct("recording_id").alias("_n"))
    by = channels.groupBy(F.lower("channel").alias("_c")).agg(F.min_by("channel", F.struct("recording_id", "channel_ix")).alias("channel"), F.countDistinct("recording_id").alias("files"))
    return by.join(F.broadcast(n)).select("channel", "files", (F.col("files") == F.col("_n")).alias("consistent"))  # n is one row


def condition_pairs(files: DataFrame, first: str, second: str) -> DataFrame:
    """(base, first, second): names that differ in the condition alone, where both conditions have one file. Rows: (name)."""
    condition = F.when(F.contains("name", F.lit(first)), first).when(F.contains("name", F.lit(second)), second)
    f = files.withColumn("_c", condition).where("_c is not null").withColumn("base", F.regexp_replace("name", f"[_-]?(?:{first}|{second})", ""))
    g = f.groupBy("base").agg(F.count("*").alias("_n"), F.max(F.when(F.col("_c") == first, F.col("name"))).alias("first"), F.max(F.when(F.col("_c") == second, F.col("name"))).alias("second"))
    return g.where("_n = 2 and first is not null and second is not null").drop("_n")


def union_of_bads(channels: DataFrame) -> DataFrame:
    """(montage, bads): sorted names that are bad in any recording."""
    return channels.where("is_bad").groupBy("montage").agg(F.sort_array(F.collect_set("channel")).alias("bads"))


def with_recordings(segments: DataFrame, recordings: DataFrame, key: str = "recording_id") -> DataFrame:
    """Segmentations beside their recordings' columns, by file stem; a segmentation without recording is an error."""
    named = recordings.withColumn("_found", F.lit(True))
    both = segments.join(named, key, "left")
    lost = F.raise_error(F.concat(F.lit("no recording for "), F.col(key).cast("string"))).cast("boolean")
    return both.where(F.coalesce(F.col("_found"), lost)).drop("_found")


def file_pairs(files: DataFrame, first: str, second: str) -> DataFrame:
    """(base, first, second): names that differ in one component alone, which is one condition in one and the other in the other.

    Components stand between _ and -; every component is left out in turn, so the condition may be any of them. Rows: (name).
    """
    parts = files.select("name", F.split("name", "[_-]").alias("_p")).withColumn("_i", F.explode(F.sequence(F.lit(1), F.size("_p"))))
    at = F.element_at("_p", F.col("_i"))
    rest = F.concat(F.slice("_p", F.lit(1), F.col("_i") - 1), F.array(F.lit("*")), F.slice("_p", F.col("_i") + 1, F.greatest(F.size("_p") - F.col("_i"), F.lit(0))))
    named = parts.where(at.isin(first, second)).select("name", at.alias("_c"), F.array_join(rest, "_").alias("base"))
    g = named.groupBy("base").agg(F.count("*").alias("_n"), *[F.max(F.when(F.col("_c") == c, F.col("name"))).alias(n) for n, c in (("first", first), ("second", second))])
    return g.where("_n = 2 and first is not null and second is not null").drop("_n")
