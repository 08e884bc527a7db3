"""Cutting long recordings into chunks: halos, and values handed on from chunk to chunk.

A recording of any length is spread over tasks by chunks of its time; what crosses a border goes either as a halo,
the rows within reach of the border, or through a table with a row for each chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Samples of a chunk.
CHUNK = 50_000


def chunk_of(position: str | Column, size: float) -> Column:
    return F.floor((F.col(position) if isinstance(position, str) else position) / size).cast("long")


def halos(rows: DataFrame, size: int, reach: int, order: str = "sample_ix") -> DataFrame:
    """``rows`` with chunk and own: each in its chunk, and as a guest in those that begin or end within ``reach`` of it."""
    at = F.col(order)
    to = F.sequence(chunk_of(at - reach, size), chunk_of(at + reach, size))
    return rows.withColumn("chunk", F.explode(to)).withColumn("own", F.col("chunk") == chunk_of(at, size))


def numbered(rows: DataFrame, keys: Sequence[str], order: str, chunk: str = "chunk") -> DataFrame:
    """``rows`` with n, their place from 0 within ``keys`` by chunk, then ``order``: places in a chunk plus the rows of those before."""
    inside = F.row_number().over(Window.partitionBy(*keys, chunk).orderBy(order)) - 1
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*keys, chunk).agg(F.count("*").alias("_c")).withColumn("_c", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    return rows.withColumn("n", inside).join(counts, [*keys, chunk]).withColumn("n", F.col("n") + F.col("_c")).drop("_c")
