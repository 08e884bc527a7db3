"""Features of stretches around events: before and after in each trial or over all trials, and from event to event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .blocks import numbered
from .events import before_after, in_windows
from .features import features, random_labels, shuffled
from .runs import RECORDING

#: Features that compare times of all trials; stretches have none.
WHOLE = ("ROF", "RTF")
PRE, POST = (-1000.0, -10.0), (20.0, 1000.0)


def _features(rows: DataFrame, fs: float, codes: Sequence[str], keys: Sequence[str], real: bool, duration_method: str) -> DataFrame:
    scored = rows if real and {"gfp", "r"} <= set(rows.columns) else None
    wanted = [c for c in codes if c not in WHOLE]
    if not wanted:
        raise ValueError(f"no features of stretches among {list(codes)}")
    return features(rows, fs, wanted, keys, scored=scored, duration_method=duration_method).drop("t_ms")


def _labels(rows: DataFrame, kind: str, seed: int, keys: Sequence[str], from_keys: Sequence[str]) -> DataFrame:
    """Labels as they are, in an order drawn within ``keys``, or drawn from those of ``from_keys``."""
    if kind not in ("real", "surrogate", "random"):
        raise ValueError(f"unknown kind {kind!r}")
    if kind == "surrogate":
        return shuffled(rows, seed, keys)
    return random_labels(rows, seed, from_keys) if kind == "random" else rows


def trial_features(
    epochs: DataFrame,
    fs: float,
    codes: Sequence[str],
    pre: tuple[float, float] = PRE,
    post: tuple[float, float] = POST,
    keys: Sequence[str] = RECORDING,
    kind: str = "real",
    seed: int = 42,
    duration_method: str = "geometric",
) -> DataFrame:
    """(keys..., trial, window_type, start_ms, end_ms, feature, state, state_to, value): features before and after the event in each trial.

    ``epochs``: (keys..., trial, t_ms, label), for GEV with gfp and r. Windows are half open, "pre" and "post"; a window
    without samples has no rows. ROF and RTF are left out, as they compare all trials. kind "surrogate" puts the labels
    of a window in another order, "random" draws them from those of the whole trial; neither has GEV. Rows with null
    keys, trial or time are in no window.
    """
    of = [*keys, "trial", "window_type"]
    rows = epochs.dropna(subset=[*keys, "trial", "t_ms"])
    if kind == "random":
        rows = _labels(rows.withColumn("sample_ix", F.col("t_ms")), kind, seed, [*keys, "trial"], [*keys, "trial"])
    rows = before_after(rows, pre, post)
    rows = rows.withColumn("sample_ix", (F.row_number().over(Window.partitionBy(*of).orderBy("t_ms")) - 1).cast("long"))
    if kind != "random":
        rows = _labels(rows, kind, seed, of, of)
    out = _features(rows, fs, codes, of, kind == "real", duration_method)
    return out.select(*of, *_bounds(pre, post), "feature", "state", "state_to", "value")


def pooled_features(
    epochs: DataFrame,
    fs: float,
    codes: Sequence[str],
    pre: tuple[float, float] = PRE,
    post: tuple[float, float] = POST,
    keys: Sequence[str] = RECORDING,
    kind: str = "real",
    seed: int = 42,
    duration_method: str = "geometric",
) -> DataFrame:
    """(keys..., window_type, start_ms, end_ms, n_trials, feature, state, state_to, value): ``trial_features`` of all trials in a row.

    The windows of trials follow each other in the order of trials as one sequence, so runs and steps may cross from
    one trial to the next. n_trials counts all trials of the recording. "random" draws from the labels of the window.
    """
    of = [*keys, "window_type"]
    rows = epochs.dropna(subset=[*keys, "trial", "t_ms"])
    trials = rows.groupBy(*keys).agg(F.countDistinct("trial").alias("n_trials"))
    # a place is that in the trial's window plus the rows of the trials before
    rows = numbered(before_after(rows, pre, post), of, "t_ms", "trial").withColumn("sample_ix", F.col("n").cast("long")).drop("n")
    out = _features(_labels(rows, kind, seed, of, of), fs, codes, of, kind == "real", duration_method)
    out = out.join(trials, list(keys)) if keys else out.crossJoin(F.broadcast(trials))  # one row beside the features
    return out.select(*of, *_bounds(pre, post), "n_trials", "feature", "state", "state_to", "value")


def _bounds(pre: tuple[float, float], post: tuple[float, float]) -> list:
    before = F.col("window_type") == "pre"
    return [F.when(before, float(a)).otherwise(float(b)).alias(n) for n, a, b in (("start_ms", pre[0], post[0]), ("end_ms", pre[1], post[1]))]


def event_features(
    samples: DataFrame,
    windows: DataFrame,
    fs: float,
    codes: Sequence[str],
    keys: Sequence[str] = RECORDING,
    kind: str = "real",
    seed: int = 42,
    duration_method: str = "geometric",
) -> DataFrame:
    """(keys..., event_ix, description, start_s, end_s, feature, state, state_to, value): features inside each window of its recording.

    ``samples``: (keys..., sample_ix, t_s, label), for GEV with gfp and r; ``windows`` as of ``events.event_windows``.
    A window without samples has no rows; "random" draws from the labels of the window.
    """
    of = [*keys, "event_ix"]
    rows = in_windows(samples, windows, keys).drop("description", "start_s", "end_s")
    out = _features(_labels(rows, kind, seed, of, of), fs, codes, of, kind == "real", duration_method)
    named = windows.select(*of, "description", "start_s", "end_s")
    return out.join(named, of).select(*of, "description", "start_s", "end_s", "feature", "state", "state_to", "value")
