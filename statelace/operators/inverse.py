"""Sources of microstates: linear inverses of a given leadfield, source regression, permutation tests, averages."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelace.functions import arrays as A
from statelace.functions.special import normal_sf2

from .scoring import Templates, by_batch, centred_rows, matrix

#: Sources of a leadfield, which is held by the driver and every task.
MOST_SOURCES = 20_000


def leadfield_of(table: DataFrame) -> np.ndarray:
    """(channels, sources) of rows (source, topo), by source; over ``MOST_SOURCES`` of them are an error."""
    rows = table.select("source", "topo").orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return np.array([r["topo"] for r in rows], float).T


def _neighbourhood(positions: np.ndarray, near: int) -> np.ndarray:
    """(sources, sources) distances to the ``near`` nearest others, either way round; infinite for the rest."""
    d = np.linalg.norm(positions[:, None] - positions[None], axis=2)
    np.fill_diagonal(d, np.inf)
    order = d.argsort(axis=1, kind="stable")[:, :near]
    on = np.zeros(d.shape, bool)
    np.put_along_axis(on, order, True, axis=1)
    return np.where(on | on.T, np.maximum(d, 1e-12), np.inf)


def _penalty(g: np.ndarray, method: str, positions: np.ndarray | None, near: int) -> np.ndarray:
    """(sources, sources) matrix whose product with a source vector is penalised: its roughness among neighbours."""
    if positions is None or len(positions) != g.shape[1]:
        raise ValueError(f"{method} needs a position of each source")
    d = _neighbourhood(np.asarray(positions, float), min(near, g.shape[1] - 1))
    if method == "loreta":  # each source less the mean of those around it, at the strength of its field
        on = np.isfinite(d).astype(float)
        return (np.eye(len(d)) - on / (1 + on.sum(axis=1).max())) * np.linalg.norm(g, axis=0)
    pull = np.where(np.isfinite(d), d, 1.0) ** -2.0 * np.isfinite(d)  # laura: fields fall with the square of the distance
    count = np.isfinite(d).sum(axis=1)
    return np.diag((1 + count.max()) / np.maximum(count, 1) * pull.sum(axis=1)) - pull


def inverse_operator(leadfield: np.ndarray, method: str = "mne", snr: float = 3.0, positions: np.ndarray | None = None, near: int = 6, rounds: int = 200) -> np.ndarray:
    """(sources, channels) linear inverse of an average-referenced leadfield.

    "mne" has the least norm; "dspm" and "sloreta" scale its rows. "eloreta" finds weights of sources as a fixed point, so
    that a single source is found where it is. "loreta" and "laura" ask for smoothness among the ``near`` nearest
    sources by ``positions``. The noise's power is the leadfield's over ``snr`` squared.
    """
    g = leadfield - leadfield.mean(axis=0)
    c = len(g)
    eye = np.eye(c)

    def weighted(cov: np.ndarray) -> np.ndarray:
        gram = g @ cov @ g.T
        return cov @ g.T @ np.linalg.pinv(gram + np.trace(gram) / (c * snr**2) * eye, hermitian=True)

    if method in ("loreta", "laura"):
        b = _penalty(g, method, positions, near)
        return weighted(np.linalg.inv(b.T @ b))
    if method == "eloreta":
        lam = np.trace(g @ g.T) / (c * snr**2)
        w = np.ones(g.shape[1])
        for _ in range(rounds):
            m = np.linalg.pinv((g / w) @ g.T + lam * (eye - 1 / c), hermitian=True)
            new = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", g, m, g, optimize=True), 1e-24))
            moved = np.abs(new - w).max() / w.max()
            w = new
            if moved < 1e-12:
                break
        return (g / w).T @ np.linalg.pinv((g / w) @ g.T + lam * (eye - 1 / c), hermitian=True)
    k = weighted(np.eye(g.shape[1]))
    if method == "mne":
        return k
    if method == "dspm":
        return k / np.maximum(np.linalg.norm(k, axis=1, keepdims=True), 1e-12)
    if method == "sloreta":
        return k / np.sqrt(np.maximum(np.einsum("ij,ji->i", k, g), 1e-12))[:, None]
    raise ValueError(f"unknown inverse {method!r}")


def localise(samples: DataFrame, operator: np.ndarray) -> DataFrame:
    """Adds src, the operator applied to topo, batch by batch; null for null."""
    return by_batch(samples.drop("src"), "src array<double>", lambda x, _: {"src": x @ operator.T})


def localise_sparse(samples: DataFrame, leadfield: np.ndarray, share: float = 0.05, rounds: int = 500) -> DataFrame:
    """Adds src, few sources that explain topo: least squares with a penalty on the sum of magnitudes.

    The penalty is ``share`` of the least one that would leave no source, sample by sample. All samples of a batch take
    accelerated proximal steps of one length together, until none moves.
    """
    g = leadfield - leadfield.mean(axis=0)
    step = 1 / max(np.linalg.norm(g, 2) ** 2, 1e-300)

    def solve(x: np.ndarray, _) -> dict[str, np.ndarray]:
        field = np.nan_to_num(centred_rows(x)) @ g
        bound = share * np.abs(field).max(axis=1, keepdims=True)
        gram = g.T @ g
        now = ahead = np.zeros(field.shape)
        t = 1.0
        for _ in range(rounds):
            y = ahead - step * (ahead @ gram - field)
            new = np.sign(y) * np.maximum(np.abs(y) - step * bound, 0)
            nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
            ahead = new + (t - 1) / nt * (new - now)
            moved = np.abs(new - now).max(initial=0)
            now, t = new, nt
            if moved <= 1e-10 * np.abs(now).max(initial=0):
                break
        return {"src": now}

    return by_batch(samples.drop("src"), "src array<double>", solve)


def state_weights(samples: DataFrame, templates: Templates) -> DataFrame:
    """Adds w: least-squares weights of the templates in each sample, a product with their pseudo-inverse."""
    inv = np.linalg.pinv(templates.maps.T)
    return samples.withColumn("w", F.array(*[A.dot(F.col("topo"), A.vector(r)) for r in inv]))


def _reduced(w: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Triangular factor of ``w`` beside what its orthogonal factor makes of ``s``: as many rows as states at most."""
    q, r = np.linalg.qr(w)
    return np.hstack([r, q.T @ s])


def regress_sources(rows: DataFrame, n_states: int, n_sources: int) -> np.ndarray:
    """(states, sources) least-squares weights of src on w, of least norm where states can't be told apart.

    A task reduces its samples to a triangular factor and the rotated sources, and factors are reduced again in a tree,
    so nothing is squared and nearly parallel states keep their digits. The driver gets the last factor. Samples
    without w or src, or with infinite or NaN entries, don't count; without samples all weights are 0.
    """
    width = n_states + n_sources

    def first(batches):
        part = np.zeros((0, width))
        for b in batches:
            w, s = matrix(b.column("w")), matrix(b.column("src"))
            fine = np.isfinite(w).all(axis=1) & np.isfinite(s).all(axis=1)
            w, s = w[fine], s[fine]
            if len(w):
                part = _reduced(np.vstack([part[:, :n_states], w]), np.vstack([part[:, n_states:], s]))
        if len(part):
            yield pa.record_batch({"node": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": pa.array([part.tobytes()], pa.binary())})

    def merge(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        both = np.vstack([np.frombuffer(r).reshape(-1, width) for r in g.sort_values("node")["r"]])
        return pd.DataFrame({"node": [key[0]], "r": [_reduced(both[:, :n_states], both[:, n_states:]).tobytes()]})

    tree = rows.where("w is not null and src is not null").select("w", "src").mapInArrow(first, "node long, r binary")
    for _ in range(3):  # 64 factors meet at a time: enough for 262,144 tasks, and more meet in the last
        tree = tree.groupBy(F.floor(F.col("node") / 64).alias("_n")).applyInPandas(merge, "node long, r binary")
    parts = [np.frombuffer(r["r"]).reshape(-1, width) for r in tree.orderBy("node").collect()]
    if not parts:
        return np.zeros((n_states, n_sources))
    last = np.vstack(parts)
    return np.linalg.lstsq(last[:, :n_states], last[:, n_states:], rcond=None)[0]


def permutation_z(spark, weights: np.ndarray, permutations: int = 2000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """(state, source, z, p, significant): observed weights within those of shuffled sources.

    p is the two-sided normal tail times the number of sources, unclipped; significant is p < alpha / permutations.
    """
    k, n = weights.shape

    def run(batches):
        total, square, count = np.zeros((k, n)), np.zeros((k, n)), 0
        for b in batches:
            for i in b["id"]:
                w = weights[:, np.random.default_rng([seed, int(i)]).permutation(n)]
                total, square, count = total + w, square + w**2, count + 1
        yield pd.DataFrame({"state": np.repeat(np.arange(k), n), "source": np.tile(np.arange(n), k), "s": total.ravel(), "q": square.ravel(), "n": count})

    sums = spark.range(permutations, numPartitions=min(32, permutations)).mapInPandas(run, "state int, source int, s double, q double, n long")
    sums = sums.groupBy("state", "source").agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    own = spark.createDataFrame([(i, j, float(weights[i, j])) for i in range(k) for j in range(n)], "state int, source int, w double")
    m = (F.col("s") + F.col("w")) / (F.col("n") + 1)
    sd = F.sqrt(F.greatest((F.col("q") + F.col("w") ** 2) / (F.col("n") + 1) - m**2, F.lit(0.0)))
    z = own.join(sums, ["state", "source"]).withColumn("z", F.coalesce(F.try_divide(F.col("w") - m, sd), F.lit(0.0)))

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return pd.Series(n * normal_sf2(z.to_numpy()))

    z = z.withColumn("p", tail("z"))
    return z.select("state", "source", "z", "p", (F.col("p") < alpha / permutations).alias("significant"))


def mean_by_label(samples: DataFrame) -> DataFrame:
    """(label, pos, value): mean source of the samples of each label."""
    return samples.where("label is not null").select("label", F.posexplode("src").alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("value"))


def group_average(sources: DataFrame) -> DataFrame:
    """(label, pos, value): mean over subjects of their min-max scaled sources. Rows: (subject, label, src)."""
    return sources.select("label", F.posexplode(A.min_max(F.col("src"))).alias("pos", "x")).groupBy("label", "pos").agg(F.avg("x").alias("value"))


def inconsistent(sources: DataFrame, states: list[str]) -> DataFrame:
    """(subject, missing, wrong_size): subjects that lack states, or whose sources differ in size from the first subject's."""
    first = sources.agg(F.min_by(F.size("src"), F.struct("subject", "label")).alias("_size"))
    g = sources.groupBy("subject").agg(F.collect_set("label").alias("_has"), F.min(F.size("src")).alias("_lo"), F.max(F.size("src")).alias("_hi"))
    lacks = F.array_except(F.array(*map(F.lit, states)), "_has")
    out = g.join(F.broadcast(first)).select("subject", F.array_sort(lacks).alias("missing"), ((F.col("_lo") != F.col("_size")) | (F.col("_hi") != F.col("_size"))).alias("wrong_size"))
    return out.where((F.size("missing") > 0) | F.col("wrong_size"))


def similarity_transform(source: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(scale, rotation, shift) that maps source points on target points in the least squares."""
    a, b = source - source.mean(axis=0), target - target.mean(axis=0)
    u, s, v = np.linalg.svd(b.T @ a / len(a))
    flip = np.ones(len(s))
    if np.linalg.det(u) * np.linalg.det(v) < 0:
        flip[-1] = -1
    r = u @ np.diag(flip) @ v
    c = float((s * flip).sum() / max((a**2).sum() / len(a), math.ulp(1.0)))
    return c, r, target.mean(axis=0) - c * r @ source.mean(axis=0)
