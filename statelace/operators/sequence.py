"""Features that need labels in order: complexity and long-range memory, whose groups are recordings, and smoothing and
filling, whose groups are chunks of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .blocks import CHUNK, chunk_of, halos
from .runs import RECORDING, collapse


def phrase_count(symbols: str) -> int:
    """Phrases of the exhaustive-history parse: each is the shortest piece that hasn't occurred before its last symbol.

    A suffix automaton knows where each substring first ends, so time grows with the length.
    """
    step: list[dict[str, int]] = [{}]  # transitions, suffix links, lengths and first ends of states
    link, size, ends = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(symbols):
        now = len(step)
        step.append({}), link.append(0), size.append(size[last] + 1), ends.append(i)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[now] = q
            else:
                copy = len(step)
                step.append(dict(step[q])), link.append(link[q]), size.append(size[p] + 1), ends.append(ends[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    count, at = 0, 0
    for i, c in enumerate(symbols):
        at = step[at][c]
        if ends[at] == i:  # its first end is here: the phrase is new
            count, at = count + 1, 0
    return count + (at != 0)


def complexity_of(labels: list[str]) -> float:
    """Phrases after the first symbol over n / log2 n; 0 for fewer than three runs."""
    n = len(labels)
    if n < 3:
        return 0.0
    code = {s: chr(0x100 + i) for i, s in enumerate(dict.fromkeys(labels))}
    return phrase_count("".join(code[s] for s in labels[1:])) * math.log2(n) / n


def _each(seq: DataFrame, keys: Sequence[str], f) -> DataFrame:
    """``f`` of each recording's labels without unassigned ones -> (keys..., value)."""
    schema = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in seq.select(*keys).schema)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        labels = g.sort_values("sample_ix")["label"].dropna().tolist()
        return pd.DataFrame([[*key, f(labels)]], columns=[*keys, "value"])

    return seq.select(*keys, "sample_ix", "label").groupBy(*keys).applyInPandas(run, f"{schema}, value double")


def lempel_ziv(seq: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Lempel-Ziv complexity of the sequence of runs."""
    return _each(collapse(seq, keys), keys, complexity_of)


def fluctuations(steps: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Detrended fluctuation of the profile of ``steps`` per box size; NaN for fewer than two boxes."""
    profile = np.cumsum(steps - steps.mean())
    out = np.full(len(scales), np.nan)
    for i, s in enumerate(scales):
        boxes = len(profile) // s
        if boxes < 2:
            continue
        y = profile[: boxes * s].reshape(boxes, s)
        x = np.arange(s) - (s - 1) / 2
        y = y - y.mean(axis=1, keepdims=True)
        slope = y @ x / (x @ x)
        out[i] = math.sqrt(np.maximum((y**2).mean(axis=1) - slope**2 * (x @ x) / s, 0).mean())
    return out


def hurst_of(labels: list[str], least: int = 50, most: int = 2500, n_scales: int = 50) -> float | None:
    """Mean DFA slope over walks that step up in two states and down in all others; null under 2 * ``least`` samples."""
    n = len(labels)
    if n < 2 * least:
        return None
    states = np.unique(labels, return_inverse=True)[1]
    scales = np.unique(np.logspace(np.log10(least), np.log10(min(most, n // 2)), n_scales).astype(int))
    slopes = []
    for pair in combinations(range(states.max() + 1), 2):
        f = fluctuations(np.where(np.isin(states, pair), 1.0, -1.0), scales)
        ok = np.nan_to_num(f) > 0
        if ok.sum() > 1:
            slopes.append(np.polyfit(np.log10(scales[ok]), np.log10(f[ok]), 1)[0])
    return float(np.mean(slopes)) if slopes else None


def hurst(seq: DataFrame, keys: Sequence[str] = RECORDING, least: int = 50) -> DataFrame:
    return _each(seq, keys, lambda labels: hurst_of(labels, least))


def sweep(states: np.ndarray, held: np.ndarray, misfit: np.ndarray, half: int, weight: float) -> np.ndarray:
    """Each held sample takes the state of least misfit less ``weight`` times its neighbours of that state, as they were before."""
    own = np.zeros((len(states) + 2 * half + 1, misfit.shape[1]))
    own[half + 1 : half + 1 + len(states)][held, states[held]] = 1
    sums = np.cumsum(own, axis=0)
    at = np.arange(len(states))
    near = sums[at + 2 * half + 1 if half else at + 1] - sums[at]
    near[held, states[held]] -= 1
    return np.where(held, np.argmin(misfit - weight * near, axis=1), -1)


def explained(r: np.ndarray, power: np.ndarray, states: np.ndarray, of: np.ndarray) -> float:
    """Power that the states of the samples ``of`` explain."""
    return float((power * r[np.arange(len(states)), np.maximum(states, 0)] ** 2)[of].sum())


def settled(before: float, now: float, total: float, eps: float) -> bool:
    return abs(now - before) / total / (before / total + 1e-10) <= eps


def smooth_states(r: np.ndarray, power: np.ndarray, states: np.ndarray, channels: int, half: int, weight: float, eps: float = 1e-6, sweeps: int = 20) -> np.ndarray:
    """Temporal smoothing of one sequence in memory.

    r: (samples, states) correlations; power: squared norm of each centred sample; states: -1 is unassigned and stays.
    """
    states, held = states.copy(), states >= 0
    if not held.any():
        return states
    total, now = float(power[held].sum()), explained(r, power, states, held)
    noise = (total - now) / (held.sum() * (channels - 1))
    if noise <= 0:
        return states
    misfit = power[:, None] * (1 - r**2) / (2 * noise * (channels - 1))
    for _ in range(sweeps):
        new = sweep(states, held, misfit, half, weight)
        if (new == states).all():
            break
        before, states = now, new
        now = explained(r, power, states, held)
        if settled(before, now, total, eps):
            break
    return states


def smooth_weights(
    scored: DataFrame, channels: int, weights: Sequence[float], half: int = 3, keys: Sequence[str] = RECORDING, eps: float = 1e-6, sweeps: int = 20, chunk: int = CHUNK
) -> DataFrame:
    """(keys..., weight, sample_ix, state) after smoothing with each weight; rows have r (array by state), power and state (null unassigned).

    A recording is cut into chunks. A sweep reaches ``half`` samples far, so chunks with a halo of ``half * sweeps`` can
    make all sweeps alone. The noise is one sum over the recording; a first pass adds up what each sweep explains and
    changes, from which follows the sweep to stop at, and a second makes that many. sample_ix counts without gaps.
    """
    fields = {x.name: x.dataType.simpleString() for x in scored.schema}
    names = ", ".join(f"{k} {fields[k]}" for k in keys)
    rows = scored.select(*keys, "sample_ix", "r", F.col("power").cast("double").alias("power"), F.coalesce("state", F.lit(-1)).cast("int").alias("state"))
    held = F.col("state") >= 0
    fit = F.col("power") * F.pow(F.get("r", F.col("state")), 2)
    sums = rows.groupBy(*keys).agg(F.sum(F.when(held, F.col("power"))).alias("total"), F.sum(F.when(held, fit)).alias("first"), F.sum(held.cast("long")).alias("n"))
    sums = sums.withColumn("noise", (F.col("total") - F.col("first")) / (F.when(F.col("n") > 0, F.col("n")) * (channels - 1)))
    cut = halos(rows, chunk, half * sweeps).join(sums.select(*keys, "noise"), list(keys))

    def arrays(g: pd.DataFrame) -> tuple:
        g = g.sort_values("sample_ix")
        return g, np.stack(g["r"].to_numpy()).astype(float), g["power"].to_numpy(), g["state"].to_numpy().astype(int), g["own"].to_numpy(bool)

    def misfit(r: np.ndarray, power: np.ndarray, noise: float) -> np.ndarray:
        return power[:, None] * (1 - r**2) / (2 * noise * (channels - 1))

    def measure(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        noise, found = g["noise"].iloc[0], []
        if noise is not None and noise > 0 and g["own"].any():
            _, r, power, start, own = arrays(g)
            cost, on = misfit(r, power, noise), start >= 0
            for w in weights:
                states = start
                for i in range(1, sweeps + 1):
                    new = sweep(states, on, cost, half, w)
                    found.append((*key[:-1], w, i, explained(r, power, new, on & own), int((new != states)[own].sum())))
                    states = new
        return pd.DataFrame(found, columns=[*keys, "weight", "sweep", "explained", "changed"])

    seen = cut.groupBy(*keys, "chunk").applyInPandas(measure, f"{names}, weight double, sweep int, explained double, changed long")
    seen = seen.groupBy(*keys, "weight", "sweep").agg(F.sum("explained").alias("now"), F.sum("changed").alias("changed")).join(sums, list(keys))
    w = Window.partitionBy(*keys, "weight").orderBy("sweep")  # as many rows as sweeps
    before = F.coalesce(F.lag("now").over(w), F.col("first"))
    calm = F.abs(F.col("now") - before) / F.col("total") / (before / F.col("total") + 1e-10) <= eps
    stop = F.min(F.when((F.col("changed") == 0) | calm, F.col("sweep"))).over(Window.partitionBy(*keys, "weight"))
    seen = seen.withColumn("stop", F.coalesce(stop, F.lit(sweeps))).groupBy(*keys, "weight").agg(F.max("stop").alias("stop"))
    stops = seen.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("weight", "stop"))).alias("stops"))

    def make(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        stops_, noise = g["stops"].iloc[0], g["noise"].iloc[0]
        g, r, power, start, own = arrays(g)
        on, parts = start >= 0, []
        counts = dict(stops_) if stops_ is not None else {}
        cost = misfit(r, power, noise) if counts else None
        for w in weights:
            states = start
            for _ in range(counts.get(w, 0)):
                states = sweep(states, on, cost, half, w)
            out = g.loc[own, [*keys, "sample_ix"]].copy()
            out["weight"] = w
            out["state"] = pd.Series(states[own], index=out.index).astype("Int32").where(states[own] >= 0)
            parts.append(out)
        return pd.concat(parts)[[*keys, "weight", "sample_ix", "state"]]

    return cut.join(stops, list(keys), "left").groupBy(*keys, "chunk").applyInPandas(make, f"{names}, weight double, sample_ix {fields['sample_ix']}, state int")


def smooth(scored: DataFrame, channels: int, half: int = 3, weight: float = 5.0, keys: Sequence[str] = RECORDING, chunk: int = CHUNK) -> DataFrame:
    """(keys..., sample_ix, state) after smoothing with one weight, see ``smooth_weights``."""
    return smooth_weights(scored, channels, [float(weight)], half, keys, chunk=chunk).drop("weight")


def _pieces(s: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(s)) + 1
    return list(zip([0, *edge.tolist()], [*edge.tolist(), len(s)]))


def fill_between(s: np.ndarray, fit: np.ndarray, stays: np.ndarray, least: int, rounds: int, gaps: bool) -> np.ndarray:
    """Runs of ``least`` or fewer become gaps and gaps are filled from both ends inwards, round after round.

    Runs with a sample that ``stays`` are long. ``gaps`` tells that the first round fills gaps even where no run is short.
    """
    s = s.copy()
    for turn in range(rounds):
        short = [(a, b) for a, b in _pieces(s) if s[a] >= 0 and b - a <= least and not stays[a:b].any()]
        if not short and not (gaps and turn == 0):
            break
        for a, b in short:
            s[a:b] = -1
        for a, b in _pieces(s):
            if s[a] >= 0:
                continue
            left, right = (s[a - 1] if a else -1), (s[b] if b < len(s) else -1)
            if left < 0 and right < 0:
                continue
            if left < 0 or right < 0:
                s[a:b] = max(left, right)
                continue
            lead = fit[a:b, left] >= fit[a:b, right]
            i = int(np.argmin(lead)) if not lead.all() else b - a
            back = (fit[a:b, right] >= fit[a:b, left])[::-1]
            j = int(np.argmin(back)) if not back.all() else b - a
            j = min(j, b - a - i)
            mid = a + i + (b - a - i - j + 1) // 2
            s[a:mid], s[mid:b] = left, right
    return s


def spread_gaps(scored: DataFrame, least: int, rounds: int = 15, keys: Sequence[str] = RECORDING, chunk: int = CHUNK) -> DataFrame:
    """(keys..., sample_ix, state): runs of ``least`` or fewer are given to their neighbours by fit, from both ends inwards.

    From each end of a gap, samples go to the state beside them while they fit it at least as well as the state at the
    other end; what is left in the middle is halved. Repeated until no run is short, ``rounds`` times at most.

    Long runs only ever grow, so what lies between two of them depends on nothing else. Runs are found chunk by chunk
    and joined at borders as rows of runs; a group is all that begins, after a long run, within one chunk, whether or
    not it goes on in the next, and the long run after it. A stretch of short runs alone is never cut.
    """
    fields = {x.name: x.dataType.simpleString() for x in scored.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in keys) + f", sample_ix {fields['sample_ix']}, state int"
    base = scored.select(*keys, "sample_ix", "r", F.coalesce("state", F.lit(-1)).cast("int").alias("state")).withColumn("chunk", chunk_of("sample_ix", chunk))
    here = Window.partitionBy(*keys, "chunk").orderBy("sample_ix")
    base = base.withColumn("_new", F.coalesce((F.col("state") != F.lag("state").over(here)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(here)).drop("_new")
    local = base.groupBy(*keys, "chunk", "_run").agg(F.first("state").alias("state"), F.min("sample_ix").alias("a"), F.count("*").alias("n"))
    line = Window.partitionBy(*keys).orderBy("a")
    local = local.withColumn("_new", F.coalesce((F.col("state") != F.lag("state").over(line)).cast("int"), F.lit(1))).withColumn("_g", F.sum("_new").over(line))
    whole, every = Window.partitionBy(*keys, "_g"), Window.partitionBy(*keys)
    local = local.withColumns({"_a": F.min("a").over(whole), "_n": F.sum("n").over(whole)})
    is_long = (F.col("state") >= 0) & (F.col("_n") > least)
    is_short = (F.col("state") >= 0) & (F.col("_n") <= least)
    runs = local.withColumns(
        {
            "_long": is_long,
            "_from": F.last(F.when(is_long, F.col("_a")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "_next": F.first(F.when(is_long, F.col("state")), ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing)),
            "_some": F.max(is_short.cast("int")).over(every),
            "_runs": F.max("_g").over(every),
        }
    )
    runs = runs.select(*keys, "chunk", "_run", "_long", "_next", "_some", "_runs", chunk_of(F.coalesce("_from", F.lit(-1)), chunk).alias("_to"))
    rows = base.join(runs, [*keys, "chunk", "_run"])

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("sample_ix")
        s, fit, stays = g["state"].to_numpy().astype(int), np.abs(np.stack(g["r"].to_numpy())), g["_long"].to_numpy(bool)
        after = g["_next"].iloc[-1]
        if g["_runs"].iloc[0] > 1:
            if after == after and after is not None:  # the long run that ends the last stretch
                s, fit, stays = np.append(s, int(after)), np.concatenate([fit, fit[-1:]]), np.append(stays, True)
            s = fill_between(s, fit, stays, least, rounds, bool(g["_some"].iloc[0]))[: len(g)]
        out = g[[*keys, "sample_ix"]].copy()
        out["state"] = pd.Series(s, index=out.index).astype("Int32").where(s >= 0)
        return out

    return rows.groupBy(*keys, "_to").applyInPandas(run, schema)


def run_lengths(fs: float, low_ms: float = 2.0, high_ms: float = 60.0, most: int = 20) -> list[int]:
    """Candidates in samples for the longest run that counts as short: up to ``most`` between two durations."""
    lo, hi = max(1, int(low_ms * fs / 1000)), int(high_ms * fs / 1000)
    return list(range(lo, hi + 1)) if hi - lo <= most else sorted({int(x) for x in np.linspace(lo, hi, most)})


def length_qualities(scored: DataFrame, lengths: Sequence[int], keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., parameter, quality): quality of the sequence without its runs of ``parameter`` samples or fewer, for each.

    Rows have sample_ix, label and abs_r. Samples are read once, as runs with their length and sum of fits; a run takes
    part in every candidate below its length, so nothing is filtered again.
    """
    from .runs import with_run

    run = with_run(scored.select(*keys, "sample_ix", "label", "abs_r"), keys)
    table = run.groupBy(*keys, "run_ix").agg(F.max("label").alias("label"), F.count("*").alias("n"), F.sum("abs_r").alias("fit"))
    every = table.groupBy(*keys).agg(F.sum("n").alias("all"))
    below = F.filter(F.array(*map(F.lit, lengths)), lambda t: t < F.col("n"))
    left = table.where("label is not null").withColumn("parameter", F.explode(below))
    line = Window.partitionBy(*keys, "parameter").orderBy("run_ix")
    left = left.withColumn("turn", (F.col("label") != F.lag("label").over(line)).cast("int"))
    by_label = left.groupBy(*keys, "parameter", "label").agg(F.sum("fit").alias("fit"), F.sum("n").alias("n"), F.sum("turn").alias("turn"))
    score = by_label.groupBy(*keys, "parameter").agg(F.avg(F.col("fit") / F.col("n")).alias("r"), F.sum("n").alias("n"), F.coalesce(F.sum("turn"), F.lit(0)).alias("turn"))
    grid = every.withColumn("parameter", F.explode(F.array(*map(F.lit, lengths))))
    out = grid.join(score, [*keys, "parameter"], "left")
    quality = 0.6 * F.col("r") + 0.3 / (1 + F.col("turn") / F.col("n")) + 0.1 * F.col("n") / F.col("all")
    return out.select(*keys, F.col("parameter").cast("double").alias("parameter"), F.coalesce(quality, F.lit(0.0)).alias("quality"))


def best_length(scored: DataFrame, fs: float, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., parameter, quality): each recording's best length in samples, the least of equals, held between 5 and 50 ms."""
    q = length_qualities(scored, run_lengths(fs), keys)
    lo, hi = max(1, int(5 * fs / 1000)), int(50 * fs / 1000)
    best = q.groupBy(*keys).agg(F.max_by("parameter", F.struct("quality", -F.col("parameter"))).alias("parameter"), F.max("quality").alias("quality"))
    return best.withColumn("parameter", F.greatest(F.lit(1.0), F.least(F.greatest("parameter", F.lit(float(lo))), F.lit(float(hi)))))


def study_length(scored: DataFrame, fs: float, keys: Sequence[str] = RECORDING) -> int:
    """The median of all recordings' best lengths, in whole samples; 20 ms without recordings."""
    m = best_length(scored, fs, keys).agg(F.median("parameter")).first()[0]
    return max(1, round(20 * fs / 1000 if m is None else float(m)))


def best_weight(scored: DataFrame, channels: int, half: int = 3, low: float = 5.0, high: float = 15.0, n: int = 5, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., parameter, quality): each recording's best weight among ``n``; all of them smooth in one pass. 10 where no quality is above zero."""
    from .runs import quality

    weights = [float(x) for x in np.linspace(low, high, n)]
    new = smooth_weights(scored, channels, weights, half, keys)
    fitted = new.join(scored.select(*keys, "sample_ix", "r"), [*keys, "sample_ix"])
    fitted = fitted.select(*keys, "weight", "sample_ix", F.col("state").alias("label"), F.abs(F.get("r", F.col("state"))).alias("abs_r"))
    q = quality(fitted, [*keys, "weight"])
    best = q.groupBy(*keys).agg(F.max_by("weight", F.struct("quality", -F.col("weight"))).alias("parameter"), F.max("quality").alias("quality"))
    return best.withColumn("parameter", F.when(F.col("quality") > 0, F.round("parameter", 1)).otherwise(10.0))


def study_weight(scored: DataFrame, channels: int, half: int = 3, keys: Sequence[str] = RECORDING) -> float:
    """The median of all recordings' best weights, to one decimal; 10 without recordings."""
    m = best_weight(scored, channels, half, keys=keys).agg(F.median("parameter")).first()[0]
    return 10.0 if m is None else round(float(m), 1)


def median_parameter(best: DataFrame, default: float, scale: float = 1.0) -> float:
    """The median over recordings of their best parameter, times ``scale``; ``default`` without recordings."""
    m = best.agg(F.median("parameter")).first()[0]
    return (default if m is None else float(m)) * scale


def best_parameter(grid: dict[float, DataFrame], keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., parameter) with the best quality among tables of (keys..., quality), the smallest of equals."""
    parts = [d.withColumn("parameter", F.lit(float(p))) for p, d in grid.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys).agg(F.max_by("parameter", F.struct("quality", -F.col("parameter"))).alias("parameter"))
