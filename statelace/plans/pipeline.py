"""The study as stages: preprocess, select points, learn templates, label them, backfit, compute features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from statelace.functions import arrays as A
from statelace.operators import around, cluster, features, inverse, runs, sequence, signal
from statelace.operators.scoring import Templates, assign
from statelace.sources import files
from statelace.sources.config import Settings


@dataclass(frozen=True)
class StageResult:
    ok: bool
    message: str = ""
    payload: Any = None


def preprocess(samples: DataFrame, channels: Sequence[str], fs: float, s: Settings) -> tuple[DataFrame, list[str], float]:
    """Samples without unwanted channels, average-referenced, filtered, resampled; their channels and their rate.

    Only recordings in one piece are filtered and resampled; other columns than topo don't pass a filter.
    """
    if unknown := set(s.channels_to_remove) - set(channels):
        raise ValueError(f"unknown channels {sorted(unknown)}")
    left = [c for c in channels if c not in s.channels_to_remove]
    at = [list(channels).index(c) for c in left]
    if len(left) < len(channels):
        samples = samples.withColumn("topo", F.array(*[F.get("topo", i) for i in at]))
    to = s.resample_hz or fs
    signal.check_band(fs, s.low_hz, s.high_hz, to)
    samples = signal.average_reference(samples)
    if (s.low_hz is None and s.high_hz is None) and to == fs:
        return samples, left, fs
    if s.data_type == "epoched":
        raise ValueError("filter recordings before they are cut into trials")
    series = signal.band_filter(signal.to_series(samples, left), fs, s.low_hz, s.high_hz, s.filter_method, to)
    return signal.to_samples(signal.resample(series, fs, to), left), left, to


def learn(samples: DataFrame, s: Settings) -> Templates:
    """Templates from average-referenced samples; k is given, or chosen by a vote over criteria."""
    pool = signal.select_points(samples, s.points, s.points_percent, s.random_seed or 0)
    pool = pool.withColumn("topo", A.unit(A.centre(F.col("topo"))))
    pool = pool.withColumn("key", F.concat_ws("/", *s.keys, "sample_ix"))
    k = s.k or choose_k(pool, s)
    return cluster.best_of(pool, k, s.repeats, s.random_seed or 0, s.method, s.max_rounds, "key", s.tolerance)


def choose_k(pool: DataFrame, s: Settings, names: Sequence[str] | None = None) -> int:
    """Most voted k among the criteria of ``cluster.DIRECTION`` (or ``names`` of them, or the one of the settings); 5 without votes.

    The pool is kept for all k and all criteria. Pairwise criteria see ``s.pairwise_cap`` drawn samples at most.
    """
    if names is None and s.criterion != "majority_vote":
        if s.criterion not in cluster.DIRECTION:
            raise ValueError(f"unknown criterion {s.criterion!r}")
        names = [s.criterion]
    spark, pool = pool.sparkSession, pool.persist()
    try:
        ks = range(s.k_min, s.k_max + 1)
        starts = cluster.spread_starts(pool, [(k, 42 + k) for k in ks], "key")
        fits = cluster.kmeans_many(pool, starts, s.method, s.max_rounds, s.tolerance)
        scores = {k: cluster.criteria(assign(pool, t), t, "key", names, s.pairwise_cap) for k, t in zip(ks, fits)}
        channels = len(pool.first()["topo"])
    finally:
        pool.unpersist()
    votes = list(cluster.choose(scores, channels).items())
    won = cluster.consensus(spark.createDataFrame(votes, "method string, k int"), s.k_min, s.k_max).first()
    return won["k"] if won else 5


def short_length(samples: DataFrame, templates: Templates, fs: float, s: Settings) -> int:
    """Samples up to which a run is short: as set, or the median of the recordings' best lengths."""
    if s.short_ms is not None:
        return int(s.short_ms * fs / 1000)
    return sequence.study_length(assign(samples, templates), fs, s.keys)


def backfit(samples: DataFrame, templates: Templates, fs: float, s: Settings) -> DataFrame:
    """(keys..., sample_ix, label): scored, rejected below the threshold, filtered.

    "peaks" labels peaks of global field power alone and spreads their labels to the troughs between; it neither
    rejects nor filters. "smooth" then gives short runs to their neighbours until none is left.
    """
    keys = s.keys
    if s.backfit_to == "peaks":
        scored = assign(samples, templates).select(*keys, "sample_ix", "label", F.col("gfp").alias("value"))
        return runs.from_peaks(scored, runs.peaks(scored, keys=keys), keys=keys).select(*keys, "sample_ix", "label")
    scored = assign(samples, templates, s.threshold)
    before = scored.select(*keys, "sample_ix", "label")
    if s.filter == "none":
        return before
    least = short_length(samples, templates, fs, s)
    if s.filter == "smooth":
        channels = templates.maps.shape[1]
        power = scored.withColumn("power", A.norm(A.centre(F.col("topo"))) ** 2)
        weight = s.smooth_weight if s.smooth_weight is not None else sequence.study_weight(power, channels, s.smooth_half, keys)
        new = sequence.smooth_weights(power, channels, [weight], s.smooth_half, keys, s.smooth_tolerance).drop("weight")
        fitted = new.join(scored.select(*keys, "sample_ix", "r"), [*keys, "sample_ix"])
        new = sequence.spread_gaps(fitted, least, keys=keys)
        labels = F.array(*map(F.lit, templates.labels))
        out = new.select(*keys, "sample_ix", F.get(labels, F.col("state")).alias("label"))
    else:
        out = runs.FILTERS[s.filter](before, least, keys)
    return runs.keep_rejected(out, before, keys) if s.rejection == "reject" else out


def source_significance(spark: SparkSession, weights, s: Settings) -> DataFrame:
    """Which sources a state's weights single out, by as many permutations as the settings say."""
    return inverse.permutation_z(spark, weights, s.permutations, seed=s.random_seed or 0)


def recordings(spark: SparkSession, folder: str, s: Settings) -> DataFrame:
    """Files of a folder with the settings' suffix."""
    return files.find_files(spark, folder, s.suffix)


class Study:
    """Runs stages in order; a stage that fails says so and stops the rest."""

    def __init__(self, samples: DataFrame, fs: float, settings: Settings | None = None, channels: Sequence[str] | None = None):
        """With the names of their ``channels``, samples are preprocessed first; without, they are taken as they are."""
        self.samples, self.fs, self.settings, self.channels = samples, fs, settings or Settings(), channels
        self.results: dict[str, StageResult] = {}
        self.templates: Templates | None = None
        self.segmentation: DataFrame | None = None

    def _stage(self, name: str, f) -> StageResult:
        try:
            out = f()
        except Exception as e:  # a stage's failure is its result
            r = StageResult(False, str(e).split("\n")[0])
        else:
            r = out if isinstance(out, StageResult) else StageResult(out is not False, payload=out)
        self.results[name] = r
        return r

    def preprocess(self) -> StageResult:
        def f():
            if self.channels is not None:
                self.samples, self.channels, self.fs = preprocess(self.samples, self.channels, self.fs, self.settings)
            return self.samples

        return self._stage("preprocess", f)

    def cluster(self) -> StageResult:
        def f():
            self.templates = learn(self.samples, self.settings)
            return self.templates

        return self._stage("cluster", f)

    def label(self, scores=None) -> StageResult:
        """Names for the maps: by a score matrix (maps x labels), else in order."""

        def f():
            names = cluster.unique_labels(scores, self.settings.labels) if scores is not None else list(self.settings.labels[: len(self.templates.maps)])
            names += [f"MS{i + 1}" for i in range(len(names), len(self.templates.maps))]
            self.templates = Templates(tuple(n or f"MS{i + 1}" for i, n in enumerate(names)), self.templates.maps)
            return self.templates

        return self._stage("label", f)

    def backfit(self) -> StageResult:
        def f():
            self.segmentation = backfit(self.samples, self.templates, self.fs, self.settings)
            return self.segmentation

        return self._stage("backfit", f)

    def features(self) -> StageResult:
        def f():
            s, seq = self.settings, self.segmentation
            keys = s.keys
            if s.window_s:
                if s.data_type == "epoched":
                    raise ValueError("windows cut recordings, not trials")
                seq, keys = features.windowed(seq, self.fs, s.window_s), ("recording_id", "window_ix")
            if s.around != "none":  # before and after the event, in each trial or over all
                place = F.col("sample_ix") - F.min("sample_ix").over(Window.partitionBy(*keys))
                epochs = seq.withColumn("t_ms", place * (1000.0 / self.fs) + s.trial_start_ms)
                f = around.trial_features if s.around == "trial" else around.pooled_features
                pre, post = (s.pre_from_ms, s.pre_to_ms), (s.post_from_ms, s.post_to_ms)
                return f(epochs, self.fs, s.features, pre, post, duration_method=s.duration_method)
            return features.features(seq, self.fs, s.features, keys, duration_method=s.duration_method)

        return self._stage("features", f)

    def run(self) -> dict[str, StageResult]:
        for stage in (self.preprocess, self.cluster, self.label, self.backfit, self.features):
            if not stage().ok:
                break
        return self.results
