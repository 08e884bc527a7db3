"""Label streams: counts per event-time window, sessions, and runs tracked across batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_counts(stream: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(recording_id, start, label, n) per tumbling window; rows: (recording_id, ts TIMESTAMP, label)."""
    w = stream.withWatermark("ts", late).groupBy("recording_id", F.window("ts", width).alias("w"), "label").agg(F.count("*").alias("n"))
    return w.select("recording_id", F.col("w.start").alias("start"), "label", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(recording_id, start, end, n): stretches without a pause of ``gap``."""
    w = stream.withWatermark("ts", late).groupBy("recording_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("recording_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def closed_runs(stream: DataFrame) -> DataFrame:
    """(recording_id, label, n): each run of equal labels when the next label arrives; rows must come in order per recording.

    The state of a recording is its open run alone.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        label, n = state.get if state.exists else (None, 0)
        out = []
        for b in batches:
            for x in b.sort_values("ts")["label"]:
                if n and x != label:
                    out.append((key[0], label, n))
                    n = 0
                label, n = x, n + 1
        state.update((label, n))
        yield pd.DataFrame(out, columns=["recording_id", "label", "n"])

    rows = stream.select("recording_id", "ts", F.coalesce("label", F.lit("")).alias("label"))
    return rows.groupBy("recording_id").applyInPandasWithState(step, "recording_id long, label string, n long", "label string, n long", "append", GroupStateTimeout.NoTimeout)
