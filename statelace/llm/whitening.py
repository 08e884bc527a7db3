"""Embedding whitening by a tall-skinny QR, without forming a covariance.

Entries become whole numbers, so sums are exact and so are centred rows, n * x - sum. Every partition is folded into
one triangular factor, block by block; factors meet a few at a time in a tree, and the right singular vectors of the
last one are the components. Only factors and sums, whose size depends on the dimensions alone, leave their tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

SCALE, SHIFT = 1024.0, 100_000
COMPONENTS = 8
#: Factors that meet in one task of the tree.
FAN_IN = 8
#: Singular values below this share of the largest count as zero.
RANK = 1e-13
#: Beyond it a scaled entry stays at this size, as whole numbers of 64 bits end.
MOST = float(1 << 61)


def finite(vectors: DataFrame, column: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers alone."""
    v = F.col(column)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.where(v.isNotNull() & ~bad)


def whole_numbers(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of int64: floor(1024 c) + 100000; components that a shorter vector lacks count as 0."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (lengths == dims).all():
        c = flat.reshape(len(lengths), dims)
    else:
        c = np.zeros((len(lengths), dims))
        c[np.arange(dims) < lengths[:, None]] = flat
    return np.floor(np.clip(SCALE * c, -MOST, MOST)).astype(np.int64) + SHIFT


def tree_merge(parts: DataFrame, merge: Callable[[list[np.ndarray]], np.ndarray], fan_in: int = FAN_IN) -> np.ndarray | None:
    """One array from rows (part, value array<double>): ``fan_in`` neighbours are merged at a time, in the order of parts."""
    scratch = Scratch(parts.sparkSession)
    now = scratch.write(parts, "parts")
    while True:
        most = now.agg(F.max("part")).first()[0]
        if most is None:
            return None
        if most == 0:
            out = np.array(now.first()["value"])
            scratch.drop(now)
            return out

        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            values = [np.asarray(v) for v in g.sort_values("part")["value"]]
            return pd.DataFrame({"part": [key[0]], "value": [merge(values).ravel()]})

        met = now.withColumn("to", F.floor(F.col("part") / fan_in)).groupBy("to").applyInPandas(run, "part long, value array<double>")
        new = scratch.write(met, "parts")
        scratch.drop(now)
        now = new


@dataclass(frozen=True)
class Whitening:
    """What a fit knows: n rows, exact sums, components as columns, eigenvalues of them and the trace of the covariance."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    rank: int

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: int64 where that holds them, else Python's whole numbers."""
        sums = np.array(self.sums, dtype=object)
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0)
        return x * self.n - sums.astype(np.int64) if most < 1 << 63 else x.astype(object) * self.n - sums

    def project(self, d: np.ndarray) -> np.ndarray:
        """Whitened components of deviations; NaN for components without variance."""
        e = self.eigenvalues.copy()
        e[self.rank :] = np.nan
        return (d.astype(np.float64) / self.n) @ self.components / np.sqrt(e)

    def squares(self, d: np.ndarray) -> list[int | None]:
        """Sums of squared deviations, exact; none where 64 bits don't hold one."""
        most = int(np.abs(d).max(initial=0))
        if most * most * max(d.shape[1], 1) < 1 << 63:
            return (d.astype(np.int64) ** 2).sum(axis=1).tolist()
        exact = (sum(v * v for v in row) for row in d.astype(object).tolist())
        return [v if v < 1 << 63 else None for v in exact]


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """Components of all finite vectors of ``vectors``, in the order of falling eigenvalue."""
    rows = finite(vectors, column).select(F.col(column).alias("v"))
    dims = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = [0] * dims, 0
        for b in batches:
            x = whole_numbers(b["v"], dims)
            # halves of 32 bits, so that no sum of a batch can overflow
            high, low = x >> 32, x & 0xFFFFFFFF
            total = [t + (int(h) << 32) + int(s) for t, h, s in zip(total, high.sum(axis=0), low.sum(axis=0))]
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["n", "sums"])

    sums = rows.mapInArrow(sums_of, "n long, sums array<string>")
    totals = sums.select("n", F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    if not totals:
        return Whitening(0, (), np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    n = totals[0]["n"]
    exact = Whitening(n, tuple(int(r["s"]) for r in sorted(totals, key=lambda r: r["i"])), np.zeros((dims, 0)), np.zeros(0), 0.0, 0)

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for b in batches:
            rows_ = exact.deviations(whole_numbers(b["v"], dims)).astype(np.float64) / n
            for i in range(0, len(rows_), 4 * dims + 1024):
                r = np.linalg.qr(np.concatenate([r, rows_[i : i + 4 * dims + 1024]]), mode="r")
        if len(r):
            values = pa.array([r.ravel()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), values], names=["part", "value"])

    def merge(factors: list[np.ndarray]) -> np.ndarray:
        return np.linalg.qr(np.concatenate([f.reshape(-1, dims) for f in factors]), mode="r")

    r = tree_merge(rows.mapInArrow(factor, "part long, value array<double>"), merge).reshape(-1, dims)
    s, right = np.linalg.svd(r, full_matrices=True)[1:]
    s = np.append(s, np.zeros(dims - len(s)))
    k = min(components, dims)
    rank = int((s[:k] > RANK * s[0]).sum()) if s[0] > 0 else 0
    return Whitening(n, exact.sums, right[:k].T.copy(), s[:k] ** 2 / n, float((s**2).sum() / n), rank)


def identity_error(vectors: DataFrame, w: Whitening, column: str = "embedding") -> float | None:
    """The largest absolute entry of the whitened rows' covariance less the identity; none without a component."""
    if not w.rank:
        return None
    k, dims = w.rank, len(w.sums)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            y = w.project(w.deviations(whole_numbers(b["v"], dims)))[:, :k]
            if len(y):
                c = y - y.mean(axis=0)
                new = np.concatenate([[len(y)], y.mean(axis=0), (c.T @ c).ravel()])
                held = new if held is None else merge([held, new])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([held], pa.list_(pa.float64()))], names=["part", "value"])

    def merge(parts: list[np.ndarray]) -> np.ndarray:
        """(rows, mean, centred products) of several such."""
        p = np.stack(parts)
        n, means = p[:, 0], p[:, 1 : k + 1]
        mean = n @ means / n.sum()
        apart = means - mean
        return np.concatenate([[n.sum()], mean, p[:, k + 1 :].sum(axis=0) + ((apart * n[:, None]).T @ apart).ravel()])

    rows = finite(vectors, column).select(F.col(column).alias("v"))
    total = tree_merge(rows.mapInArrow(moments, "part long, value array<double>"), merge)
    return float(np.abs(total[k + 1 :].reshape(k, k) / total[0] - np.eye(k)).max())


def transform(vectors: DataFrame, w: Whitening, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, deviation, whitened array<double>) of every finite vector."""
    dims = len(w.sums)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = w.deviations(whole_numbers(b["v"], dims))
            y = w.project(d)
            flat = pa.array(y.ravel(), pa.float64(), from_pandas=True)  # NaN gives null
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b["k"], pa.array(w.squares(d), pa.int64()), lists], names=["key", "deviation", "whitened"])

    rows = finite(vectors, column).select(F.col(key).alias("k"), F.col(column).alias("v"))
    return rows.mapInArrow(run, f"key {kind}, deviation long, whitened array<double>").withColumnRenamed("key", key)


def whiten(vectors: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error), a row for each finite vector and component.

    Null vectors and those with null or non-finite entries give no rows; null and repeated keys and repeated vectors
    are rows like any other, and equal eigenvalues come in the order the decomposition gives them. A vector shorter
    than the longest counts as 0 where it ends; fewer dimensions than ``components`` give as many components.
    A component without variance has null ``whitened``, and ``explained`` is null where nothing varies. Scaled entries
    stay within 2^61; a ``deviation`` beyond 64 bits is null. Other columns are ignored, an empty table gives no rows.
    """
    w = fit(vectors, column, components)
    kind = vectors.schema[key].dataType.simpleString()
    if not w.components.size:
        return vectors.sparkSession.createDataFrame([], f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(vectors, w, column)
    shares = F.array(*[F.lit(float(e / w.trace) if w.trace else None).cast("double") for e in w.eigenvalues])
    rows = transform(vectors, w, column, key).select(key, "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return rows.select(
        key,
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(w.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("i")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_whitening": op13_whitening}
ORACLES: dict[str, str] = {}
