"""Preparing recordings: references, filters, resampling, neighbours, noisy channels.

Filters need a channel's samples in order, so they run as grouped Arrow functions per recording and channel over
rows (recording_id, channel, sample_ix, x). FIR and IIR filters cut recordings into chunks: the first sees the halo that its
taps reach, the second hands its state from chunk to chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from statelace.functions import arrays as A

from .blocks import CHUNK, chunk_of

SERIES = "recording_id string, channel string, sample_ix long, x double"


def average_reference(samples: DataFrame) -> DataFrame:
    return samples.withColumn("topo", A.centre(F.col("topo")))


def to_series(samples: DataFrame, channels: list[str]) -> DataFrame:
    """(recording_id, sample_ix, topo) -> one row per channel and sample."""
    names = F.array(*map(F.lit, channels))
    rows = samples.select("recording_id", "sample_ix", F.posexplode("topo").alias("i", "x"))
    return rows.select(F.col("recording_id").cast("string").alias("recording_id"), F.get(names, F.col("i")).alias("channel"), "sample_ix", "x")


def to_samples(series: DataFrame, channels: list[str]) -> DataFrame:
    """Back to topographies, channels in the given order."""
    at = F.array_position(F.array(*map(F.lit, channels)), F.col("channel"))
    topo = F.transform(F.sort_array(F.collect_list(F.struct(at.alias("i"), "x"))), lambda s: s["x"])
    return series.groupBy("recording_id", "sample_ix").agg(topo.alias("topo"))


def _per_channel(series: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        y = f(g.sort_values("sample_ix")["x"].to_numpy(float))
        return pd.DataFrame({"recording_id": key[0], "channel": key[1], "sample_ix": np.arange(len(y)), "x": y})

    return series.groupBy("recording_id", "channel").applyInPandas(run, SERIES)


CHANNEL = ("recording_id", "channel")


def check_band(fs: float, low: float | None, high: float | None, to: float | None = None) -> None:
    """Cut-offs must lie below half of every rate the samples will have, and the low one below the high one."""
    nyquist = min(fs, to or fs) / 2
    if high is not None and high >= nyquist or low is not None and low >= nyquist:
        raise ValueError(f"cut-offs must lie below {nyquist} Hz")
    if low is not None and high is not None and low >= high:
        raise ValueError("the low cut-off must lie below the high one")


def fir_taps(fs: float, low: float | None, high: float | None) -> np.ndarray:
    """Odd, symmetric taps: a windowed sinc, with transition bands of a quarter of the cut-off, 2 Hz at least where they fit.

    A Hamming window needs 3.3 sampling intervals for each width of the narrower band.
    """
    a = min(max(0.25 * low, 2.0), low) if low else None
    b = min(max(0.25 * high, 2.0), fs / 2 - high) if high else None
    n = int(np.ceil(3.3 / min(x for x in (a, b) if x is not None) * fs)) | 1
    m = np.arange(n) - n // 2
    lo, hi = (low - a / 2 if low else 0.0), (high + b / 2 if high else fs / 2)
    taps = (2 * hi * np.sinc(2 * hi * m / fs) - 2 * lo * np.sinc(2 * lo * m / fs)) / fs * np.hamming(n)
    middle = 0.0 if not low else fs / 2 if not high else (lo + hi) / 2
    return taps / (taps * np.cos(2 * np.pi * middle * m / fs)).sum()


def mirrored(series: DataFrame, reach: int) -> DataFrame:
    """``series`` (samples from 0 on) with own, and up to ``reach`` samples turned about each of its ends."""
    ends = series.groupBy(*CHANNEL).agg(F.max("sample_ix").alias("_n"), F.min_by("x", "sample_ix").alias("_a"), F.max_by("x", "sample_ix").alias("_b"))
    rows = series.join(ends, list(CHANNEL))
    i = F.col("sample_ix")
    sides = F.array(
        F.struct(i.alias("sample_ix"), F.col("x").alias("x"), F.lit(True).alias("own")),
        F.when((i > 0) & (i <= reach), F.struct((-i).alias("sample_ix"), (2 * F.col("_a") - F.col("x")).alias("x"), F.lit(False).alias("own"))),
        F.when((i < F.col("_n")) & (i >= F.col("_n") - reach), F.struct((2 * F.col("_n") - i).alias("sample_ix"), (2 * F.col("_b") - F.col("x")).alias("x"), F.lit(False).alias("own"))),
    )
    return rows.select(*CHANNEL, F.inline(F.array_compact(sides)))


def fir(series: DataFrame, taps: np.ndarray, chunk: int = CHUNK) -> DataFrame:
    """Each sample becomes the weighted sum of those around it; ends are turned about, beyond that samples count as 0.

    A chunk is one row with its samples as lists. It gets those that its taps reach from the chunks around it, and turns ends
    about itself, so chunks without samples of their own are never made.
    """
    half = len(taps) // 2
    series = series.select(F.col("recording_id").cast("string").alias("recording_id"), "channel", F.col("sample_ix").cast("long").alias("sample_ix"), F.col("x").cast("double").alias("x"))
    line = F.sort_array(F.collect_list(F.struct("sample_ix", "x")))
    own = series.groupBy(*CHANNEL, chunk_of("sample_ix", chunk).alias("chunk")).agg(line.alias("l"))
    ends = own.groupBy(*CHANNEL).agg(F.min(F.get("l", F.lit(0))).alias("first"), F.max(F.element_at("l", -1)).alias("last"))
    rows = own.join(ends, list(CHANNEL))
    reach = math.ceil(half / chunk)
    there = F.sequence(F.greatest(F.col("chunk") - reach, chunk_of("first.sample_ix", chunk)), F.least(F.col("chunk") + reach, chunk_of("last.sample_ix", chunk)))
    rows = rows.select(*CHANNEL, "first", "last", "l", F.col("chunk").alias("from"), F.explode(there).alias("chunk"))
    near = F.filter("l", lambda s: (s["sample_ix"] >= F.col("chunk") * chunk - half) & (s["sample_ix"] < (F.col("chunk") + 1) * chunk + half))
    met = rows.select(*CHANNEL, "chunk", "first", "last", F.when(F.col("from") == F.col("chunk"), F.col("l")).otherwise(near).alias("l"))
    met = met.groupBy(*CHANNEL, "chunk").agg(F.any_value("first").alias("first"), F.any_value("last").alias("last"), F.flatten(F.collect_list("l")).alias("l"))
    met = met.select(*CHANNEL, "chunk", F.col("first.x").alias("a"), F.col("last.sample_ix").alias("n"), F.col("last.x").alias("b"), F.col("l.sample_ix").alias("ix"), F.col("l.x").alias("x"))

    def weighed(ix: np.ndarray, x: np.ndarray, c: int, a: float, n: int, b: float) -> tuple[np.ndarray, np.ndarray]:
        keep = np.sort(ix[ix // chunk == c])
        if not len(keep):
            return keep, np.zeros(0)
        lo = keep[0] - half
        out = np.zeros(keep[-1] - keep[0] + 1 + 2 * half)
        before, after = (ix > 0) & (ix <= half), (ix < n) & (ix >= n - half)
        for at, v in ((ix, x), (-ix[before], 2 * a - x[before]), (2 * n - ix[after], 2 * b - x[after])):
            inside = (at >= lo) & (at < lo + len(out))
            out[at[inside] - lo] = v[inside]
        if len(out) <= 4 * len(taps):
            y = np.convolve(out, taps, "valid")
        else:
            size = 1 << int(len(out) + len(taps) - 1).bit_length()
            y = np.fft.irfft(np.fft.rfft(out, size) * np.fft.rfft(taps, size), size)[2 * half :]
        return keep, y[keep - keep[0]]

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            ends = t.column("ix").offsets.to_numpy()
            ix, x = t.column("ix").values.to_numpy(), t.column("x").values.to_numpy(zero_copy_only=False)
            marks = zip(*(t.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("chunk", "a", "n", "b")))
            made = [weighed(ix[lo:hi], x[lo:hi], *m) for lo, hi, m in zip(ends, ends[1:], marks)]
            of = pa.array(np.repeat(np.arange(len(made)), [len(k) for k, _ in made]))
            yield pa.record_batch([t.column("recording_id").take(of), t.column("channel").take(of), np.concatenate([k for k, _ in made]), np.concatenate([y for _, y in made])], ["recording_id", "channel", "sample_ix", "x"])

    return met.mapInArrow(run, SERIES)


def butterworth(fs: float, low: float | None, high: float | None, order: int = 4) -> list[tuple[np.ndarray, np.ndarray]]:
    """Second-order sections (b, a) of a Butterworth filter of even ``order``, by the bilinear transform."""
    p = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    w = [2 * fs * np.tan(np.pi * f / fs) for f in (low, high) if f is not None]
    if low is not None and high is not None:
        half = p * (w[1] - w[0]) / 2
        root = np.sqrt(half**2 - w[0] * w[1])
        p, b, at = np.concatenate([half + root, half - root]), [1.0, 0.0, -1.0], np.sqrt(w[0] * w[1])
    elif high is not None:
        p, b, at = p * w[0], [1.0, 2.0, 1.0], 0.0
    else:
        p, b, at = w[0] / p, [1.0, -2.0, 1.0], np.inf
    z = (2 * fs + p) / (2 * fs - p)
    z = z[z.imag > 0]
    z = z[np.argsort(np.abs(z))]
    unit = np.exp(1j * (np.pi if at == np.inf else 2 * np.arctan(at / (2 * fs))))
    out = []
    for q in z:  # every section has gain 1 where the whole filter has
        a = np.array([1.0, -2 * q.real, abs(q) ** 2])
        gain = abs(np.polyval(a, unit) / np.polyval(b, unit))
        out.append((np.array(b) * gain, a))
    return out


def state_space(sections: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(A, B, C, D) of sections in a row: state' = A state + B x, y = C state + D x."""
    n = 2 * len(sections)
    big, into, out, through = np.zeros((n, n)), np.zeros(n), np.zeros(n), 1.0
    for k, (b, a) in enumerate(sections):
        own = slice(2 * k, 2 * k + 2)
        gain = b[1:] - a[1:] * b[0]
        big[own] = np.outer(gain, out)  # what the sections before give
        big[own, own] += np.array([[-a[1], 1.0], [-a[2], 0.0]])
        into[own] = gain * through
        out, through = b[0] * out, b[0] * through
        out[2 * k] += 1.0
    return big, into, out, through


class Recursion:
    """A recursive filter over stretches of samples: what a stretch gives, and the state it leaves, are affine in the state it finds."""

    STEP = 128

    def __init__(self, sections: list[tuple[np.ndarray, np.ndarray]]):
        self.a, self.b, self.c, self.d = state_space(sections)
        n, m = len(self.b), self.STEP
        powers = [np.eye(n)]
        for _ in range(m):
            powers.append(self.a @ powers[-1])
        self.jump = powers[m]
        self.seen = np.stack([self.c @ q for q in powers[:m]])  # (m, n): outputs from a state alone
        self.left = np.stack([powers[m - 1 - i] @ self.b for i in range(m)], axis=1)  # (n, m): state from inputs alone
        h = np.concatenate([[self.d], self.seen[:-1] @ self.b])
        self.response = np.array([[h[i - j] if i >= j else 0.0 for j in range(m)] for i in range(m)])
        self.steady = np.linalg.solve(np.eye(n) - self.a, self.b)  # the state under a constant input of 1

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs for x from ``state`` on, and the state after."""
        m = self.STEP
        whole = len(x) // m * m
        blocks = x[:whole].reshape(-1, m)
        pushed = blocks @ self.left.T
        states = np.empty((len(blocks), len(state)))
        for i, p in enumerate(pushed):
            states[i] = state
            state = self.jump @ state + p
        y = [(blocks @ self.response.T + states @ self.seen.T).ravel()]
        tail = x[whole:]
        if len(tail):
            k = len(tail)
            y.append(self.response[:k, :k] @ tail + self.seen[:k] @ state)
            for v in tail:
                state = self.a @ state + self.b * v
        return np.concatenate(y), state

    def after(self, n: int, state: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The state after n samples that leave ``left`` when they start from zero."""
        return np.linalg.matrix_power(self.a, n) @ state + left

    def ringing(self, share: float = 1e-3) -> int:
        """Samples after which what a state has left fades to a share of itself."""
        return int(np.ceil(np.log(share) / np.log(np.abs(np.linalg.eigvals(self.a)).max())))


def iir(series: DataFrame, sections: list[tuple[np.ndarray, np.ndarray]], chunk: int = CHUNK) -> DataFrame:
    """A recursive filter run forwards, then backwards, over recordings with their ends turned about.

    A chunk first says what state it would leave if it began with none; a table with a row for each chunk turns that
    into the state each begins with, and each chunk is filtered from there. One shuffle makes chunks of samples.
    """
    f = Recursion(sections)
    n = len(f.b)
    rows = mirrored(series, f.ringing()).withColumn("chunk", chunk_of("sample_ix", chunk))
    line = F.sort_array(F.collect_list(F.struct("sample_ix", "x", "own")))
    chunks = rows.groupBy(*CHANNEL, "chunk").agg(line.alias("l"))
    get = lambda c: F.transform("l", lambda s: s[c])
    chunks = chunks.select(*CHANNEL, "chunk", get("sample_ix").alias("ix"), get("own").alias("own"), get("x").alias("x"))
    for back in (False, True):
        chunks = _pass(chunks, f, n, back)
    out = chunks.select(*CHANNEL, F.explode(F.arrays_zip("ix", "own", "x")).alias("s")).where("s.own")
    return out.select(F.col("recording_id").cast("string").alias("recording_id"), "channel", F.col("s.ix").alias("sample_ix"), F.col("s.x").alias("x"))


def _pass(chunks: DataFrame, f: Recursion, n: int, back: bool) -> DataFrame:
    turn = slice(None, None, -1) if back else slice(None)

    @F.pandas_udf("array<double>")
    def leaves(x: pd.Series) -> pd.Series:
        """The first sample and the state left from none."""
        each = [np.asarray(v, float)[turn] for v in x]
        return pd.Series([np.append(v[0], f.run(v, np.zeros(n))[1]) for v in each])

    @F.pandas_udf("array<double>")
    def given(x: pd.Series, state: pd.Series) -> pd.Series:
        return pd.Series([f.run(np.asarray(v, float)[turn], np.asarray(s, float))[0][turn] for v, s in zip(x, state)])

    kinds = {c: chunks.schema[c].dataType.simpleString() for c in (*CHANNEL, "chunk")}

    def hand_on(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("chunk", ascending=not back)
        state, found = f.steady * g["left"].iloc[0][0], []
        for size, left in zip(g["n"], g["left"]):
            found.append(state)
            state = f.after(int(size), state, np.asarray(left)[1:])
        return pd.DataFrame({**{c: g[c] for c in kinds}, "state": found})

    ends = chunks.select(*kinds, F.size("x").alias("n"), leaves("x").alias("left"))
    states = ends.groupBy(*CHANNEL).applyInPandas(hand_on, ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", state array<double>")
    return chunks.join(states, list(kinds)).withColumn("x", given("x", "state")).drop("state")


def band_filter(series: DataFrame, fs: float, low: float | None, high: float | None, method: str = "fir", to: float | None = None, chunk: int = CHUNK) -> DataFrame:
    """Zero-phase filter of rows (recording_id, channel, sample_ix from 0 on, x): "fir", "iir" (Butterworth, both ways) or "fft".

    ``to`` is the rate of a later resampling, which the cut-offs must suit as well. Without cut-offs rows stay as they are.
    """
    check_band(fs, low, high, to)
    if method not in ("fir", "iir", "fft"):
        raise ValueError(f"unknown filter method {method!r}")
    if low is None and high is None:
        return series
    if method == "fft":
        return band_pass(series, fs, low, high)
    return fir(series, fir_taps(fs, low, high), chunk) if method == "fir" else iir(series, butterworth(fs, low, high), chunk)


def band_pass(series: DataFrame, fs: float, low: float | None, high: float | None, transition: float = 1.0) -> DataFrame:
    """Zero-phase band-pass in the frequency domain, with raised-cosine edges ``transition`` Hz wide; a channel is a group."""
    check_band(fs, low, high)

    def f(x: np.ndarray) -> np.ndarray:
        pad = min(len(x) - 1, int(fs * 2))  # mirrored ends, so that edges don't ring
        y = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad > 0 else x
        q = np.fft.rfftfreq(len(y), 1 / fs)
        edge = lambda d: 0.5 - 0.5 * np.cos(np.pi * np.clip(d / transition + 0.5, 0, 1))
        gain = np.ones(len(q))
        if low is not None:
            gain *= edge(q - low)
        if high is not None:
            gain *= edge(high - q)
        return np.fft.irfft(np.fft.rfft(y) * gain, len(y))[pad : pad + len(x)]

    return _per_channel(series, f)


def resample(series: DataFrame, fs: float, to: float) -> DataFrame:
    """Fourier resampling; rows as they are if the rates agree."""
    if fs == to:
        return series

    def f(x: np.ndarray) -> np.ndarray:
        n = int(round(len(x) * to / fs))
        c = np.fft.rfft(x)
        out = np.zeros(n // 2 + 1, complex)
        m = min(len(c), len(out))
        out[:m] = c[:m]
        return np.fft.irfft(out, n) * n / len(x) if n else np.zeros(0)

    return _per_channel(series, f)


def neighbours(channels: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """(montage, channel_ix, neighbour_ix, rank): nearest channels up to the first jump in distance.

    A jump is a step over twice the mean of the first three steps; ``least`` to ``most`` neighbours are kept.
    """
    a, b = channels.alias("a"), channels.alias("b")
    apart = F.sqrt(sum((F.col(f"a.{c}") - F.col(f"b.{c}")) ** 2 for c in "xyz"))
    d = a.join(b, (F.col("a.montage") == F.col("b.montage")) & (F.col("a.channel_ix") != F.col("b.channel_ix")))
    d = d.select(F.col("a.montage").alias("montage"), F.col("a.channel_ix").alias("channel_ix"), F.col("b.channel_ix").alias("neighbour_ix"), apart.alias("d"))
    w = Window.partitionBy("montage", "channel_ix").orderBy("d", "neighbour_ix")
    d = d.withColumns({"rank": F.row_number().over(w), "_step": F.lead("d").over(w) - F.col("d")})
    c = Window.partitionBy("montage", "channel_ix")
    usual = F.avg(F.when(F.col("rank") <= 3, F.col("_step"))).over(c)
    d = d.withColumn("_usual", usual).withColumn("_cut", F.min(F.when((F.col("_step") > 2 * F.col("_usual")) & (F.col("rank") >= least), F.col("rank"))).over(c))
    return d.where(F.col("rank") <= F.least(F.lit(most), F.coalesce("_cut", F.lit(most)))).select("montage", "channel_ix", "neighbour_ix", "rank")


def spatial_smooth(samples: DataFrame, near: dict[int, list[int]], channels: int | None = None) -> DataFrame:
    """Each channel becomes the mean of itself and its neighbours; those without neighbours stay. ``channels`` is their number."""
    t = F.col("topo")
    new = [sum((F.get(t, j) for j in near.get(i, [])), F.get(t, i)) / (1 + len(near.get(i, []))) for i in range(channels or max(near, default=-1) + 1)]
    return samples.withColumn("topo", F.array(*new))


def noisy_channels(series: DataFrame, limit: float = 5.0) -> DataFrame:
    """(recording_id, channel, z, is_bad): robust z of each channel's deviation among its recording's channels."""
    s = series.groupBy("recording_id", "channel").agg(F.log(F.stddev_pop("x") + 1e-30).alias("s"))
    w = Window.partitionBy("recording_id")
    s = s.withColumn("_m", F.median("s").over(w)).withColumn("_a", F.median(F.abs(F.col("s") - F.col("_m"))).over(w))
    z = F.coalesce(F.try_divide(F.col("s") - F.col("_m"), 1.4826 * F.col("_a")), F.lit(0.0))
    return s.select("recording_id", "channel", z.alias("z"), (F.abs(z) > limit).alias("is_bad"))


def keep_between_events(samples: DataFrame, windows: DataFrame) -> DataFrame:
    """Samples inside selected event windows, in time order, sample_ix counted anew."""
    from .events import in_windows

    met = in_windows(samples, windows).dropDuplicates(["recording_id", "t_s"])
    order = Window.partitionBy("recording_id").orderBy("t_s")
    return met.withColumn("sample_ix", (F.row_number().over(order) - 1).cast("long")).drop("event_ix", "description", "start_s", "end_s")


def select_points(samples: DataFrame, mode: str, percent: float = 50.0, seed: int = 42) -> DataFrame:
    """Samples for clustering: "all", "random" (a share drawn by hash), or "peaks" of global field power."""
    from .runs import peaks

    if mode == "all":
        return samples
    if mode == "random":
        return samples.where(F.pmod(F.xxhash64("recording_id", "sample_ix", F.lit(seed)), F.lit(1_000_000)) < int(percent * 10_000))
    if mode == "peaks":
        g = samples.withColumn("gfp", A.gfp(F.col("topo")))
        return samples.join(peaks(g, "gfp").select("recording_id", "sample_ix"), ["recording_id", "sample_ix"], "left_semi")
    raise ValueError(f"unknown mode {mode!r}")
