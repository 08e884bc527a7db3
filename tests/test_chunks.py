"""Operators that cut recordings into chunks, against the same thing done on whole recordings."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from statelace.operators import events, runs, sequence, signal


@pytest.mark.parametrize("chunk_s", [0.5, 3.0, 1e9])
def test_windows_that_overlap(spark, chunk_s):
    r = random.Random(int(chunk_s))
    samples = [(rec, i, i / 10, r.choice("ab")) for rec in ("x", "y") for i in range(200)] + [("x", 999, None, "a"), (None, 0, 1.0, "a")]
    windows = []
    for rec in ("x", "y", "z"):
        for e in range(25):
            start = r.choice([r.randrange(-20, 220) / 10, r.random() * 20])
            windows.append((rec, e, f"d{e % 3}", start, r.choice([start + r.random() * 8, start + 0.5, start, start - 1, None])))
    windows += [("x", 50, "n", None, 5.0), ("x", 51, "twin", 3.0, 4.0), ("x", 52, "twin", 3.0, 4.0)]
    want = []
    for rec, e, _, start, end in windows:
        inside = [s for s in samples if s[0] == rec and s[2] is not None and start is not None and s[2] >= start and (end is None or s[2] < end)]
        want += [(rec, e, k, s[2], s[3]) for k, s in enumerate(inside)]
    s = spark.createDataFrame(samples, "recording_id string, sample_ix long, t_s double, label string")
    w = spark.createDataFrame(windows, "recording_id string, event_ix long, description string, start_s double, end_s double")
    got = events.in_windows(s, w, chunk_s=chunk_s).select("recording_id", "event_ix", "sample_ix", "t_s", "label").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_a_long_recording_meets_many_events(spark):
    n, m = 1_000_000, 10_000
    s = spark.range(n).select(F.lit("r").alias("recording_id"), F.col("id").alias("sample_ix"), (F.col("id") / 250).alias("t_s"))
    a = spark.range(m).select(F.lit("r").alias("recording_id"), (F.col("id") * (n // m) / 250).alias("onset_s"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("description"))
    got = events.in_windows(s, events.event_windows(a, ["a"]), chunk_s=100.0)
    per = got.groupBy("event_ix").agg(F.count("*").alias("n"), F.max("sample_ix").alias("last")).agg(F.count("*"), F.min("n"), F.max("n"), F.max("last")).first()
    assert tuple(per) == (m // 2, n // m, n // m, n // m - 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def line(spark, x, rec="r", channel="c"):
    return spark.createDataFrame([(rec, channel, i, float(v)) for i, v in enumerate(x)], signal.SERIES)


def turned(x, reach):
    reach = min(reach, len(x) - 1)
    return np.concatenate([2 * x[0] - x[reach:0:-1], x, 2 * x[-1] - x[-2 : -reach - 2 : -1]]) if reach else x, reach


def plain_fir(x, taps):
    half = len(taps) // 2
    y, reach = turned(x, half)
    y = np.concatenate([np.zeros(half - reach), y, np.zeros(half - reach)])
    return np.convolve(y, taps, "valid")


def plain_iir(x, sections):
    y, reach = turned(x, signal.Recursion(sections).ringing())
    for _ in range(2):
        start = y[0]
        for b, a in sections:
            z = np.linalg.solve([[1 + a[1], -1.0], [a[2], 1.0]], [b[1] - a[1] * b[0], b[2] - a[2] * b[0]]) * start
            start *= b.sum() / a.sum()
            out = []
            for v in y.tolist():
                o = b[0] * v + z[0]
                z = [b[1] * v - a[1] * o + z[1], b[2] * v - a[2] * o]
                out.append(o)
            y = np.array(out)
        y = y[::-1]
    return y[reach : reach + len(x)]


@pytest.mark.parametrize("band", [(1.0, 40.0), (None, 30.0), (2.0, None)])
@pytest.mark.parametrize("n", [5_300, 150, 1])
def test_filters_by_chunks(spark, band, n):
    g = np.random.default_rng(n)
    x = np.cumsum(g.normal(size=n)) + 20
    taps, sections = signal.fir_taps(250, *band), signal.butterworth(250, *band)
    for chunk in (1_000, 10**9):
        for method, want in (("fir", plain_fir(x, taps)), ("iir", plain_iir(x, sections))):
            got = signal.band_filter(line(spark, x), 250, *band, method, chunk=chunk).orderBy("sample_ix").collect()
            assert [r["sample_ix"] for r in got] == list(range(n))
            assert np.abs(np.array([r["x"] for r in got]) - want).max() < 1e-9 * max(1, np.abs(x).max())


def test_filters_pass_and_stop(spark):
    t = np.arange(5_000) / 250
    for method in ("fir", "iir", "fft"):
        for hz, low, high in ((10, 0.97, 1.03), (0.1, 0, 0.05), (80, 0, 0.02)):
            got = signal.band_filter(line(spark, np.sin(2 * np.pi * hz * t)), 250, 2, 40, method, chunk=1_500).orderBy("sample_ix").toPandas()["x"].to_numpy()
            size = np.sqrt(2 * (got[1_000:4_000] ** 2).mean())
            assert low <= size <= high, (method, hz, size)
    b = signal.butterworth(250, 5, 20)
    for hz in (5, 20):  # half the power at the cut-offs
        z = np.exp(2j * np.pi * hz / 250)
        assert abs(np.prod([abs(np.polyval(p, z) / np.polyval(q, z)) for p, q in b]) ** 2 - 0.5) < 1e-9


def test_filter_guards(spark):
    for args in ((250, 1, 130), (250, 40, 20), (250, 1, 60, "fir", 100), (250, 1, 40, "other")):
        with pytest.raises(ValueError):
            signal.band_filter(line(spark, [1.0, 2.0]), *args)
    assert signal.band_filter(line(spark, [1.0, 2.0]), 250, None, None).count() == 2


def scored(spark, recordings):
    rows = []
    for rec, (r, power, s) in recordings.items():
        rows += [(rec, i, a.tolist(), float(p), None if q < 0 else int(q)) for i, (a, p, q) in enumerate(zip(r, power, s))]
    return spark.createDataFrame(rows, "recording_id string, sample_ix long, r array<double>, power double, state int")


def noisy(seed, n, states=4, stick=0.8, unassigned=0.05):
    g = np.random.default_rng(seed)
    truth = np.zeros(n, int)
    for i in range(1, n):
        truth[i] = truth[i - 1] if g.random() < stick else g.integers(states)
    r = np.clip(g.normal(0, 0.35, (n, states)), -0.95, 0.95)
    r[np.arange(n), truth] = np.clip(r[np.arange(n), truth] + 0.4, -0.98, 0.98)
    s = np.abs(r).argmax(axis=1)
    s[g.random(n) < unassigned] = -1
    return r, g.uniform(0.5, 2, n), s


@pytest.mark.parametrize("chunk", [7, 100, 10**6])
def test_smoothing_by_chunks(spark, chunk):
    data = {f"r{i}": noisy(i, n) for i, n in enumerate((1, 2, 60, 501, 90))} | {"none": (np.ones((5, 4)) * 0.3, np.ones(5), np.full(5, -1))}
    got = {}
    for w in (0.5, 5.0):
        out = sequence.smooth(scored(spark, data), 20, 3, w, chunk=chunk).orderBy("recording_id", "sample_ix").collect()
        for x in out:
            got.setdefault((w, x["recording_id"]), []).append(-1 if x["state"] is None else x["state"])
    for w in (0.5, 5.0):
        for rec, (r, power, s) in data.items():
            assert got[w, rec] == sequence.smooth_states(r, power, s, 20, 3, w).tolist(), (w, rec)


def plain_spread(s, fit, least, rounds=15):
    """The whole recording at once, in loops."""
    s = list(s)

    def pieces():
        out = []
        for i, v in enumerate(s):
            if i and v == s[i - 1]:
                out[-1][1] = i + 1
            else:
                out.append([i, i + 1])
        return out

    for _ in range(rounds):
        found = pieces()
        short = [(a, b) for a, b in found if s[a] >= 0 and b - a <= least]
        if not short or len(found) == 1:
            break
        for a, b in short:
            s[a:b] = [-1] * (b - a)
        for a, b in pieces():
            if s[a] >= 0:
                continue
            left, right = s[a - 1] if a else -1, s[b] if b < len(s) else -1
            if left < 0 or right < 0:
                s[a:b] = [max(left, right)] * (b - a)
                continue
            i, j = a, b
            while i < j and fit[i][left] >= fit[i][right]:
                i += 1
            while j > i and fit[j - 1][right] >= fit[j - 1][left]:
                j -= 1
            for k in range(a, b):
                s[k] = left if k < i + (j - i + 1) // 2 else right
    return s


@pytest.mark.parametrize("chunk", [5, 40, 10**6])
@pytest.mark.parametrize("least", [1, 3, 8])
def test_gaps_across_chunks(spark, chunk, least):
    data = {f"r{i}": noisy(10 + i, n, stick=stick, unassigned=u) for i, (n, stick, u) in enumerate([(1, 0.8, 0), (3, 0.99, 0), (400, 0.8, 0.1), (400, 0.95, 0), (300, 0.3, 0), (300, 0.97, 0.02)])}
    r, power, _ = noisy(1, 60)
    data |= {"one": (r, power, np.zeros(60, int)), "none": (r, power, np.full(60, -1)), "calm": (r, power, np.repeat([0, -1, 1], 20)), "few": (r[:2], power[:2], np.array([2, 2]))}
    out = sequence.spread_gaps(scored(spark, data), least, chunk=chunk).orderBy("recording_id", "sample_ix").collect()
    got = {}
    for x in out:
        got.setdefault(x["recording_id"], []).append(-1 if x["state"] is None else x["state"])
    for rec, (r, _, s) in data.items():
        assert got[rec] == plain_spread(s, np.abs(r), least), rec


def plain_quality(states, r, kept):
    at = np.flatnonzero(kept)
    if not len(at):
        return 0.0
    fit = np.mean([np.mean([abs(r[i][s]) for i in at if states[i] == s]) for s in sorted({states[i] for i in at})])
    turns = sum(states[a] != states[b] for a, b in zip(at, at[1:]))
    return 0.6 * fit + 0.3 / (1 + turns / len(at)) + 0.1 * len(at) / len(states)


def test_best_length_and_weight(spark):
    fs, data = 500.0, {f"r{i}": noisy(30 + i, 300, stick=0.93, unassigned=0) for i in range(4)}
    rows = scored(spark, data).withColumn("label", F.col("state")).withColumn("abs_r", F.abs(F.get("r", F.col("state"))))
    lengths = sequence.run_lengths(fs)
    assert lengths[0] == 1 and lengths[-1] == 30 and len(lengths) == 20 and sequence.run_lengths(250) == list(range(1, 16))
    got = {(x["recording_id"], x["parameter"]): x["quality"] for x in sequence.length_qualities(rows, lengths).collect()}
    best, weights = {}, {}
    for rec, (r, power, s) in data.items():
        scores = []
        for t in lengths:
            kept = np.zeros(len(s), bool)
            for a, b in sequence._pieces(s):
                kept[a:b] = b - a > t
            scores.append(plain_quality(s.tolist(), r, kept))
            assert got[rec, float(t)] == pytest.approx(scores[-1])
        best[rec] = float(min(max(lengths[int(np.argmax(scores))], 2), 25))
        grid = np.linspace(5, 15, 5)
        tried = [plain_quality((n := sequence.smooth_states(r, power, s, 20, 3, w)).tolist(), r, n >= 0) for w in grid]
        weights[rec] = round(float(grid[int(np.argmax(tried))]), 1)
    assert {x["recording_id"]: x["parameter"] for x in sequence.best_length(rows, fs).collect()} == best
    assert sequence.study_length(rows, fs) == round(float(np.median(list(best.values()))))
    assert {x["recording_id"]: x["parameter"] for x in sequence.best_weight(rows, 20).collect()} == weights
    assert sequence.study_weight(rows, 20) == round(float(np.median(list(weights.values()))), 1)
    assert sequence.study_length(rows.limit(0), fs) == 10 and sequence.study_weight(rows.limit(0), 20) == 10.0
    assert runs.quality(rows).count() == 4 and math.isfinite(got["r0", 1.0])


def test_restarts_side_by_side_end_as_they_do_alone(spark):
    from statelace.operators import cluster
    from statelace.operators.scoring import total_explained

    g = np.random.default_rng(9)
    maps = g.normal(size=(4, 10))
    x = maps[g.integers(4, size=600)] * g.choice([-1, 1], size=(600, 1)) + g.normal(size=(600, 10)) * 0.3
    samples = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_ix long, topo array<double>").cache()
    wanted = [(2, 1), (4, 1), (4, 2), (7, 3)]
    starts = cluster.spread_starts(samples, wanted)
    for (k, seed), t in zip(wanted, starts):
        assert t.maps.shape == (k, 10) and np.allclose(t.maps, cluster.initial_spread(samples, k, seed).maps)
    passes = []
    plain = cluster._rounds
    try:
        cluster._rounds = lambda *a: passes.append(len(a[1])) or plain(*a)
        many = cluster.kmeans_many(samples, starts)
        together, alone = list(passes), []
        for t, got in zip(starts, many):
            passes.clear()
            assert np.allclose(cluster.kmeans(samples, t).maps, got.maps, atol=1e-9)
            alone.append(len(passes))
    finally:
        cluster._rounds = plain
    assert len(together) == max(alone) and sum(together) == sum(alone)
    gev = cluster.explained_by_each(samples, many)
    assert all(abs(a - total_explained(samples, t).first()["gev"]) < 1e-12 for a, t in zip(gev, many))
