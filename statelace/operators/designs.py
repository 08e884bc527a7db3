"""Designs beyond two groups of subjects: repeated measures, bootstrap of trials, clusters under exchanged labels.

Values are rows (feature, grp, subject, value). Draws are hashes of units and replicates, so a draw is the same in every
task and on every rerun, and sums under all draws are made where the rows lie: what is shuffled are sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelace.functions import special

#: Trials whose labels are exchanged among themselves.
BLOCK = 1_000
#: Numbers a task holds before it hands its sums on.
HELD = 4_000_000


# --- repeated measures ---------------------------------------------------------------------------------------------------


def condition_covariances(values: DataFrame) -> DataFrame:
    """(feature, k, i, j, n, c, mi): covariance of conditions i <= j and mean of i, over subjects that have all k conditions.

    Conditions are numbered from 0 by name. Trials of a subject are averaged first; nulls and NaN are no values.
    """
    v = values.where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("grp").isNotNull() & F.col("subject").isNotNull())
    per = v.groupBy("feature", "subject", "grp").agg(F.avg("value").alias("value"))
    k = v.select("feature", "grp").distinct().groupBy("feature").agg(F.count("*").cast("int").alias("k"))
    row = per.groupBy("feature", "subject").agg(F.sort_array(F.collect_list(F.struct("grp", "value"))).alias("_v"))
    row = row.join(k, "feature").where(F.size("_v") == F.col("k")).select("feature", "k", F.col("_v.value").alias("x"))
    pair = F.transform(F.sequence(F.lit(0), F.col("k") * F.col("k") - 1), lambda e: F.struct(F.floor(e / F.col("k")).cast("int").alias("i"), (e % F.col("k")).cast("int").alias("j")))
    e = row.select("feature", "k", "x", F.inline(F.filter(pair, lambda p: p["i"] <= p["j"])))
    a, b = F.get("x", F.col("i")), F.get("x", F.col("j"))
    return e.groupBy("feature", "k", "i", "j").agg(F.count("*").alias("n"), F.covar_samp(a, b).alias("c"), F.avg(a).alias("mi"))


def sphericity(cov: np.ndarray, n: int) -> tuple[float, float, float, float]:
    """(Greenhouse-Geisser, Huynh-Feldt, Mauchly's W, its p) of the covariance of k conditions over n subjects.

    W needs more subjects than contrasts and contrasts that aren't degenerate; for two conditions W is 1.
    """
    k = len(cov)
    centred = cov - cov.mean(axis=0) - cov.mean(axis=1, keepdims=True) + cov.mean()
    own = np.sort(np.linalg.eigvalsh(centred))[1:]  # without the direction all conditions share
    d = k - 1
    if own.sum() <= 0:
        return math.nan, math.nan, math.nan, math.nan
    gg = own.sum() ** 2 / (d * (own**2).sum())
    under = d * (n - 1 - d * gg)
    hf = min(1.0, (n * d * gg - 2) / under) if under > 0 else 1.0
    if d == 1:
        return 1.0, 1.0, 1.0, 1.0
    if n <= d or own.min() <= 1e-12 * own.max():
        return gg, hf, math.nan, math.nan
    log_w = float(np.log(own).sum() - d * math.log(own.mean()))
    chi = -(n - 1 - (2 * d * d + d + 2) / (6 * d)) * log_w
    return gg, hf, math.exp(log_w), float(special.chi2_sf(chi, d * (d + 1) / 2 - 1))


def repeated_anova(values: DataFrame) -> DataFrame:
    """(feature, n, k, stat, df1, df2, p, gg, p_gg, hf, p_hf, w, p_w, eta): analysis of variance within subjects.

    Only subjects with every condition count (n of them). gg and hf multiply both degrees of freedom for p_gg and p_hf, w is
    Mauchly's statistic, eta the partial eta squared. Fewer than two conditions or subjects, or no variance left within
    subjects: stat is null and p are 1. A feature where no subject has every condition has no row. One aggregate carries
    each feature's covariances, so its last group holds conditions squared, whatever the subjects.
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        k, n = int(g["k"].iloc[0]), int(g["n"].iloc[0])
        out = [key[0], n, k, math.nan, float(k - 1), float((k - 1) * (n - 1)), 1.0, math.nan, 1.0, math.nan, 1.0, math.nan, math.nan, math.nan]
        if k > 1 and n > 1:
            cov, mean = np.zeros((k, k)), np.zeros(k)
            cov[g["i"], g["j"]] = cov[g["j"], g["i"]] = g["c"]
            mean[g["i"]] = g["mi"]
            error = (np.trace(cov) - cov.sum() / k) / (k - 1)
            if error > 1e-12 * max(np.trace(cov), 1e-300):
                stat = n * ((mean - mean.mean()) ** 2).sum() / (k - 1) / error
                gg, hf, w, pw = sphericity(cov, n)
                d1, d2 = out[4], out[5]
                p = [float(special.f_sf(stat, d1 * e, d2 * e)) for e in (1.0, gg, hf)]
                out[3:] = [stat, d1, d2, p[0], gg, p[1], hf, p[2], w, pw, stat * d1 / (stat * d1 + d2)]
        return pd.DataFrame([out], columns=names)

    names = ["feature", "n", "k", "stat", "df1", "df2", "p", "gg", "p_gg", "hf", "p_hf", "w", "p_w", "eta"]
    kinds = ["string", "long", "int", *["double"] * 11]
    done = condition_covariances(values).groupBy("feature").applyInPandas(run, ", ".join(f"{a} {b}" for a, b in zip(names, kinds)))
    return done.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("stat", "gg", "hf", "w", "p_w", "eta")})


# --- hashes --------------------------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(unit: np.ndarray, draw: np.ndarray, seed: int) -> np.ndarray:
    """(units, draws) of numbers in [0, 1), each a hash of unit, draw and seed."""
    turn = _mixed(draw.astype(np.int64).view(np.uint64) + np.uint64(((seed & 0xFFFFFFFF) << 32) + 0x9E3779B9))
    return (_mixed(_mixed(unit.astype(np.int64).view(np.uint64))[:, None] ^ turn[None]) >> np.uint64(11)) / float(1 << 53)


# --- bootstrap -----------------------------------------------------------------------------------------------------------

_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(18)])


def weights(unit: np.ndarray, replicates: int, folds: int, seed: int, lo: int, hi: int) -> np.ndarray:
    """(units, hi - lo) weights of columns lo to hi: column 0 counts each unit once, then Poisson(1) draws, then each fold left out."""
    at = np.arange(lo, hi)
    w = np.searchsorted(_POISSON, uniform(unit, at, seed), side="right").astype(float)
    w[:, at == 0] = 1.0
    out = at > replicates
    if out.any():
        fold = (uniform(unit, np.array([-1]), seed)[:, 0] * folds).astype(int)
        w[:, out] = fold[:, None] != (at[out] - replicates - 1)[None]
    return w


def bca(own: float, draws: np.ndarray, left_out: np.ndarray, level: float) -> tuple[float, float]:
    """Bias-corrected and accelerated interval from sorted draws and the estimates with one fold left out."""
    normal = NormalDist()
    share = (np.sum(draws < own) + np.sum(draws == own) / 2) / len(draws)
    z0 = normal.inv_cdf(min(max(share, 0.5 / len(draws)), 1 - 0.5 / len(draws)))
    gap = left_out.mean() - left_out
    spread = (gap**2).sum() ** 1.5
    a = (gap**3).sum() / (6 * spread) if spread > 0 else 0.0
    ends = []
    for q in ((1 - level) / 2, (1 + level) / 2):
        z = z0 + normal.inv_cdf(q)
        ends.append(float(np.quantile(draws, normal.cdf(z0 + z / (1 - a * z)))))
    return ends[0], ends[1]


def bootstrap_sums(values: DataFrame, a: str, b: str, replicates: int, folds: int, seed: int, block: int = 256) -> DataFrame:
    """(feature, draw, n1, s1, n2, s2): weighted numbers and sums of both groups for each column of ``weights``.

    Trials of a subject are summed first and drawn as one. A task adds up all draws of what it holds, so it sends a row
    for each feature, group and draw, not for each subject.
    """
    v = values.where(F.col("grp").isin(a, b) & F.col("value").isNotNull() & ~F.isnan("value"))
    unit = v.groupBy("feature", "grp", "subject").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("value").cast("double")).alias("s"))
    rows = unit.select("feature", (F.col("grp") == b).alias("second"), F.xxhash64(F.col("subject").cast("string")).alias("h"), "n", "s")
    columns = 1 + replicates + folds

    def total(batches):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            for (feature, second), x in held.items():
                yield pa.record_batch({"feature": pa.array([feature] * columns, pa.string()), "second": pa.array([second] * columns), "draw": pa.array(np.arange(columns), pa.int32()), "n": x[0], "s": x[1]})
            held.clear()

        for batch in batches:
            h, n, s = (batch.column(c).to_numpy() for c in ("h", "n", "s"))
            kind = pd.MultiIndex.from_arrays([batch.column("feature").to_pandas(), batch.column("second").to_pandas()])
            code, names = pd.factorize(kind)
            for i, name in enumerate(names):
                mine = code == i
                both = np.stack([n[mine], s[mine]])
                sums = held.setdefault((None if pd.isna(name[0]) else name[0], bool(name[1])), np.zeros((2, columns)))
                for lo in range(0, columns, block):
                    hi = min(lo + block, columns)
                    sums[:, lo:hi] += both @ weights(h[mine], replicates, folds, seed, lo, hi)
                if len(held) * 2 * columns > HELD:
                    yield from flush()
        yield from flush()

    sums = rows.mapInArrow(total, "feature string, second boolean, draw int, n double, s double")
    part = lambda c, second: F.coalesce(F.sum(F.when(F.col("second") == second, F.col(c))), F.lit(0.0))
    return sums.groupBy("feature", "draw").agg(part("n", False).alias("n1"), part("s", False).alias("s1"), part("n", True).alias("n2"), part("s", True).alias("s2"))


def bootstrap(values: DataFrame, a: str, b: str, replicates: int = 2000, level: float = 0.95, folds: int = 50, seed: int = 42) -> DataFrame:
    """(feature, n1, n2, diff, se, ci_low, ci_high, p, draws): mean of ``b`` less mean of ``a``, subjects drawn with all their trials.

    Weights are Poisson(1), intervals BCa with the acceleration of a jackknife over ``folds`` groups of subjects. p doubles
    the smaller share of draws beyond zero. n1 and n2 count trials; draws are those in which both groups have somebody
    (others have no difference). A group without values, or fewer than two draws or folds, gives nulls and p = 1. Null subjects are one subject.
    """

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("draw")
        with np.errstate(all="ignore"):
            diff = (g["s2"] / g["n2"] - g["s1"] / g["n1"]).to_numpy(float)
        own, draws, left = diff[0], diff[1 : 1 + replicates], diff[1 + replicates :]
        draws, left = np.sort(draws[np.isfinite(draws)]), left[np.isfinite(left)]
        out = [key[0], int(g["n1"].iloc[0]), int(g["n2"].iloc[0]), own if math.isfinite(own) else None, None, None, None, 1.0, len(draws)]
        if math.isfinite(own) and len(draws) > 1 and len(left) > 1:
            low, high = bca(own, draws, left, level)
            beyond = min(np.sum(draws <= 0), np.sum(draws >= 0))
            out[4:8] = [float(draws.std(ddof=1)), low, high, min(1.0, 2 * (1 + beyond) / (1 + len(draws)))]
        return pd.DataFrame([out], columns=["feature", "n1", "n2", "diff", "se", "ci_low", "ci_high", "p", "draws"])

    sums = bootstrap_sums(values, a, b, replicates, folds, seed)
    return sums.groupBy("feature").applyInPandas(run, "feature string, n1 long, n2 long, diff double, se double, ci_low double, ci_high double, p double, draws long")


# --- clusters of times and states under exchanged labels -------------------------------------------------------------------


def exchanged(block: int, size: int, first: int, permutations: np.ndarray, seed: int) -> np.ndarray:
    """(permutations, size) booleans: which places of a block are of the first group. Permutation 0 leaves labels alone.

    Every permutation keeps the block's numbers; places 0 to ``first`` - 1 hold the first group's trials.
    """
    rank = uniform(np.arange(size) + (np.int64(block) << np.int64(20)), permutations, seed).T.argsort(axis=1, kind="stable").argsort(axis=1, kind="stable")
    rank[permutations == 0] = np.arange(size)
    return rank < first


def cell_tests(cells: DataFrame, a: str, b: str, permutations: int, seed: int = 42, within: str | None = None, share: int = 100, block: int = BLOCK) -> DataFrame:
    """(perm, t_ms, state, stat): pooled t of the first less the second group in every cell, under every exchange of labels.

    Cells are rows (trial, grp, t_ms, state, value), one label to a trial; repeated cells of a trial are averaged. Trials are dealt by hash
    into blocks of about ``block`` (of one ``within`` each, where given), and labels are exchanged inside a block, which
    keeps the numbers of both groups. A task holds some times and states of at most ``share`` blocks.
    """
    v = cells.where(F.col("grp").isin(a, b) & F.col("value").isNotNull() & ~F.isnan("value"))
    key = [within] if within else []
    v = v.groupBy(*key, "trial", "grp", "t_ms", "state").agg(F.avg("value").alias("value"))
    trials = v.select(*key, "trial", "grp").distinct().withColumn("_h", F.xxhash64(F.lit(seed), *key, "trial"))
    total = trials.groupBy(*key).agg(F.ceil(F.count("*") / block).alias("_b"))
    trials = trials.join(total, key) if key else trials.join(F.broadcast(total))  # one row
    trials = trials.withColumn("_block", F.xxhash64(*key, F.pmod("_h", "_b")))
    by = lambda *order: _window("_block").orderBy(*order)
    trials = trials.withColumn("_first", F.count(F.when(F.col("grp") == a, 1)).over(_window("_block"))).withColumn("_size", F.count("*").over(_window("_block")))
    trials = trials.withColumn("_at", F.row_number().over(by(F.col("grp") != a, "_h", "trial")) - 1).select(*key, "trial", "grp", "_block", "_at", "_first", "_size")
    rows = v.join(trials, [*key, "trial", "grp"]).select("t_ms", "state", F.col("value").cast("double").alias("value"), "_block", "_at", "_first", "_size")
    spread = rows.select("_block").distinct().agg(F.greatest(F.ceil(F.count("*") / share), F.lit(1)).alias("_s"))
    rows = rows.join(F.broadcast(spread)).withColumn("_salt", F.pmod("_block", "_s")).drop("_s")  # one row
    ids = np.arange(permutations + 1)

    def added(batches):
        held: dict[tuple, np.ndarray] = {}

        def flush():
            for (t, state), x in held.items():
                yield pa.record_batch({"perm": pa.array(ids, pa.int32()), "t_ms": np.full(len(ids), t), "state": pa.array([state] * len(ids), pa.string()), "n1": x[0], "s1": x[1]})
            held.clear()

        def take(g: pd.DataFrame):
            size, first = int(g["_size"].iloc[0]), int(g["_first"].iloc[0])
            number = int(np.int64(g["_block"].iloc[0]) & np.int64((1 << 43) - 1))
            code, names = pd.factorize(pd.MultiIndex.from_arrays([g["t_ms"], g["state"]]))
            grid, seen = np.zeros((size, len(names))), np.zeros((size, len(names)))
            grid[g["_at"], code], seen[g["_at"], code] = g["value"], 1.0
            for lo in range(0, len(ids), 512):
                own = exchanged(number, size, first, ids[lo : lo + 512], seed).astype(float)
                n1, s1 = own @ seen, own @ grid
                for i, name in enumerate(names):
                    x = held.setdefault((float(name[0]), name[1]), np.zeros((2, len(ids))))
                    x[0, lo : lo + 512] += n1[:, i]
                    x[1, lo : lo + 512] += s1[:, i]

        rest = None
        for batch in batches:  # sorted by block; a block may go on in the next batch
            g = batch.to_pandas()
            g = g if rest is None else pd.concat([rest, g], ignore_index=True)
            if not len(g):
                continue
            last = g["_block"] == g["_block"].iloc[-1]
            rest = g[last]
            for _, part in g[~last].groupby("_block", sort=False):
                take(part)
                if len(held) * 2 * len(ids) > HELD:
                    yield from flush()
        if rest is not None and len(rest):
            take(rest)
        yield from flush()

    dealt = rows.repartition("t_ms", "state", "_salt").sortWithinPartitions("_block").withColumn("t_ms", F.col("t_ms").cast("double"))
    sums = dealt.mapInArrow(added, "perm int, t_ms double, state string, n1 double, s1 double").groupBy("perm", "t_ms", "state").agg(F.sum("n1").alias("n1"), F.sum("s1").alias("s1"))
    whole = v.groupBy(F.col("t_ms").cast("double").alias("t_ms"), "state").agg(F.count("*").cast("double").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") ** 2).alias("q"))
    n1, n2, s2 = F.col("n1"), F.col("n") - F.col("n1"), F.col("s") - F.col("s1")
    left = F.col("q") - F.col("s1") ** 2 / n1 - s2**2 / n2
    stat = (F.col("s1") / n1 - s2 / n2) / F.sqrt(left / (F.col("n") - 2) * (1 / n1 + 1 / n2))
    fine = (n1 > 0) & (n2 > 0) & (F.col("n") > 2)
    return sums.join(whole, ["t_ms", "state"]).select("perm", "t_ms", "state", F.when(fine, F.when(left > 1e-12 * F.col("q"), stat)).alias("_t")).select("perm", "t_ms", "state", F.coalesce("_t", F.lit(0.0)).alias("stat"))


def _window(*key: str):
    from pyspark.sql import Window

    return Window.partitionBy(*key)


def components(stat: np.ndarray, threshold: float) -> np.ndarray:
    """Number of each cell's cluster in a (times, states) grid, from 1 on, 0 for none: cells of one sign beyond
    ``threshold`` that meet along time or between states next in order. Numbers follow the clusters' first cells."""
    sign = np.where(np.abs(stat) > threshold, np.sign(stat), 0).astype(int)
    of = np.where(sign != 0, np.arange(1, sign.size + 1).reshape(sign.shape), 0)
    while True:  # each cell takes the least number around it, until none changes
        before = of.copy()
        for axis in (0, 1):
            for step in (1, -1):
                near, like = np.roll(of, step, axis), np.roll(sign, step, axis)
                edge = [slice(None)] * 2
                edge[axis] = 0 if step == 1 else -1
                like[tuple(edge)] = 0
                of = np.where((sign != 0) & (like == sign), np.minimum(of, near), of)
        if (of == before).all():
            break
    numbers = np.unique(of[of > 0])
    return np.where(of > 0, np.searchsorted(numbers, of) + 1, 0)


def permuted_clusters(cells: DataFrame, a: str, b: str, permutations: int = 5000, threshold: float = 2.0, seed: int = 42, within: str | None = None, states: Sequence[str] | None = None) -> DataFrame:
    """(cluster, start_ms, end_ms, states, cells, mass, p): clusters of times and states in which trials of two groups differ.

    Cells are as ``cell_tests`` takes them. A cluster joins neighbouring cells of one sign with |t| above ``threshold``: next
    times of a state, and states next in the order of ``states`` (by name if not given; other states are left out) at a time.
    mass is the sum of t, p the share of permutations, and the data's own labels, whose largest |mass| is as large. A
    cell that was never seen is 0. A permutation's grid of times and states is a group; its result is one number.
    """
    tests = cell_tests(cells, a, b, permutations, seed, within)

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(g["t_ms"].unique())
        names = list(states) if states is not None else sorted(g["state"].unique())
        place = {s: i for i, s in enumerate(names)}
        g = g[g["state"].isin(place)]
        grid = np.zeros((len(times), len(names)))
        grid[np.searchsorted(times, g["t_ms"]), g["state"].map(place).to_numpy(int)] = g["stat"]
        of = components(grid, threshold)
        mass = np.bincount(of.ravel(), grid.ravel(), minlength=1)[1:]
        if key[0] > 0:
            return pd.DataFrame([[int(key[0]), 0, None, None, None, 0, float(np.abs(mass).max(initial=0))]], columns=columns)
        out = []
        for i, m in enumerate(mass, 1):
            t, s = np.nonzero(of == i)
            out.append([0, i, times[t.min()], times[t.max()], ",".join(names[j] for j in np.unique(s)), len(t), float(m)])
        return pd.DataFrame(out, columns=columns)

    columns = ["perm", "cluster", "start_ms", "end_ms", "states", "cells", "mass"]
    done = tests.groupBy("perm").applyInPandas(run, "perm int, cluster int, start_ms double, end_ms double, states string, cells long, mass double")
    own = F.collect_list(F.when(F.col("perm") == 0, F.struct(*columns[1:])))
    null = F.collect_list(F.when(F.col("perm") > 0, F.abs("mass")))
    rows = done.agg(own.alias("own"), null.alias("null")).select(F.inline("own"), "null")  # a number for each permutation
    beyond = F.size(F.filter("null", lambda x: x >= F.abs("mass") - 1e-9))
    return rows.select(*columns[1:], ((1 + beyond) / (1 + F.size("null"))).alias("p"))
