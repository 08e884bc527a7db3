"""Near-duplicate vectors: spherical k-means cells, blocked cosine products inside cells, one vector kept per group.

Two unit vectors that link lie on both sides of a bisector between their cells only if one of them is within half
their largest distance of it. So every vector visits, besides its own cell, each cell whose bisector is that near,
and products of a cell's own vectors with its own and visiting ones find every link: recall is 1 by construction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, table
from .simhash import forest

COSINE = 0.98
#: Vectors the cells are fitted on: those whose hashed ids come first.
SAMPLE = 8_192
#: Products this near the border are computed anew with exact sums, as those of a block depend on its shape.
NEAR = 1e-9
PER_CELL = 256
MAX_CELLS = 2_048
#: Vectors of a label and cell that meet in one task; larger cells are cut into chunks that meet pairwise.
CHUNK = 4_096


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k unit centres (fewer if x has fewer rows) of unit rows x."""
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norms = np.linalg.norm(sums, axis=1)
        centres = np.where(norms[:, None] > 1e-12, sums / np.maximum(norms, 1e-12)[:, None], centres)
    return centres


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine of two vectors, the same in whatever block they meet."""
    a, b = a / np.abs(a).max(), b / np.abs(b).max()  # squares of extreme components stay finite
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def _unit(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision from lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _typed(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding); vectors of floats stay so, as they shuffle at half the size."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").cast(kind).alias("embedding"))


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(rep, label, embedding, m, dim): vectors that can link, copies under one label as one row with their number and least vec_id."""
    v = _typed(vectors)
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    v = v.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0.0))
    rows = v.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    return rows.select("rep", "label", "embedding", "m", F.size("embedding").alias("dim"))


def cells(reps: DataFrame, cosine: float, per_cell: int = PER_CELL) -> DataFrame:
    """``reps`` with home and the list of cells to meet in (own first). Vectors of an uncommon length stay in cell -1."""
    n = reps.count()
    k = max(1, min(MAX_CELLS, n // per_cell))
    top = reps.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = top["dim"] if top else 0
    drawn = reps.where(F.col("dim") == dim).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()
    centres = spherical_kmeans(_unit(drawn.column("embedding").combine_chunks()), k) if drawn.num_rows else np.zeros((1, 1))
    half = math.sqrt(max(0.0, 2 - 2 * cosine)) / 2 + 1e-9
    gaps = np.maximum(np.linalg.norm(centres[:, None] - centres[None], axis=2), 1e-12) if k <= 512 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home, meet = np.full(b.num_rows, -1, np.int32), [[-1]] * b.num_rows
            usual = np.flatnonzero(b.column("dim").to_numpy() == dim)
            for at in np.array_split(usual, max(1, len(usual) // 1024)):
                if not len(at):
                    continue
                like = _unit(b.column("embedding").take(pa.array(at))) @ centres.T
                own = like.argmax(axis=1)
                best = like[np.arange(len(at)), own]
                gap = gaps[own] if gaps is not None else np.sqrt(np.maximum(2 - 2 * (centres[own] @ centres.T), 1e-24))
                near = (best[:, None] - like) <= half * gap
                home[at] = own
                for i, o, row in zip(at.tolist(), own.tolist(), near):
                    meet[i] = [o, *(c for c in np.flatnonzero(row).tolist() if c != o)]
            yield pa.record_batch([*b.columns, pa.array(home), pa.array(meet, pa.list_(pa.int32()))], [*b.schema.names, "home", "meet"])

    kind = reps.schema["label"].dataType.simpleString()
    schema = f"rep long, label {kind}, embedding {reps.schema['embedding'].dataType.simpleString()}, m long, dim int, home int, meet array<int>"
    return reps.mapInArrow(run, schema)


def cell_links(placed: DataFrame, cosine: float, chunk: int = CHUNK) -> DataFrame:
    """(rep, n, root): links found in each cell of a vector, counted with copies, and the least vector of its set there."""
    rows = placed.withColumn("cell", F.explode("meet"))
    key = ["label", "dim", "cell"]
    large = Scratch(placed.sparkSession).write(rows.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > chunk), "large")
    rows = rows.withColumns({c: F.lit(0) for c in ("part", "i", "j")})
    if not large.isEmpty():
        rows = rows.drop("i", "j").join(large, key, "left").withColumn("g", F.coalesce(F.ceil(F.col("size") / chunk), F.lit(1)).cast("int"))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        rows = rows.withColumn("i", F.least("part", "o")).withColumn("j", F.greatest("part", "o"))
    rows = rows.select("rep", "m", "embedding", "home", "meet", "part", *key, "i", "j")

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        order = np.argsort(t.column("rep").to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        rep, m, home, part = (t.column(c).to_numpy() for c in ("rep", "m", "home", "part"))
        cell, i, j = (t.column(c)[0].as_py() for c in ("cell", "i", "j"))
        raw = t.column("embedding").combine_chunks()
        x = _unit(raw)
        raw = raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(x.shape)
        meet = t.column("meet").combine_chunks()
        met = np.sort(np.repeat(np.arange(len(rep)), pa.compute.list_value_length(meet).to_numpy()) << 32 | meet.flatten().to_numpy().astype(np.int64) & 0xFFFFFFFF)

        def visits(v: np.ndarray, c: np.ndarray) -> np.ndarray:
            """Whether vectors v meet in cells c."""
            want = v.astype(np.int64) << 32 | c.astype(np.int64) & 0xFFFFFFFF
            return met[np.minimum(np.searchsorted(met, want), len(met) - 1)] == want

        counts = np.zeros(len(rep), np.int64)
        left, right = [np.zeros(0, int)], [np.zeros(0, int)]
        for lo in range(0, len(rep), 512):
            like = x[lo : lo + 512] @ x[lo:].T
            a, b = np.nonzero(like >= cosine - NEAR)
            border = np.flatnonzero(like[a, b] < cosine + NEAR)
            a, b = a + lo, b + lo
            if len(border):
                below = [_cosine(raw[p], raw[q]) < cosine for p, q in zip(a[border].tolist(), b[border].tolist())]
                a, b = np.delete(a, border[below]), np.delete(b, border[below])
            ok = (a < b) & ((home[a] == cell) | (home[b] == cell))
            ok &= (part[a] != part[b]) if i != j else True
            a, b = a[ok], b[ok]
            # a pair that meets in both homes counts in the smaller one
            twice = (home[a] != home[b]) & (cell > np.minimum(home[a], home[b])) & visits(a, home[b]) & visits(b, home[a])
            a, b = a[~twice], b[~twice]
            np.add.at(counts, a, m[b])
            np.add.at(counts, b, m[a])
            f, r = forest(np.concatenate([*left, a]), np.concatenate([*right, b]), len(rep))
            left, right = [f], [r]
        root = np.arange(len(rep))
        root[left[0]] = right[0]
        some = counts > 0
        return pa.table({"rep": rep[some], "n": counts[some], "root": rep[root[some]]})

    return rows.groupBy(*key, "i", "j").applyInArrow(run, "rep long, n long, root long")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, per_cell: int = PER_CELL, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of ``vectors``, each a vector of its own.

    Vectors link within one label only. Null vectors, those without components, with null or non-finite components
    or with zeros alone, and those with a null label or vec_id link with nothing. Copies link with each other. Vectors
    of different lengths don't link. Different vectors under one vec_id are one node. Labels may have any type. Vectors may
    have any length; other columns are ignored. Empty table: no rows.
    """
    scratch = Scratch(vectors.sparkSession)
    reps = scratch.write(distinct_vectors(vectors), "vectors")
    if reps.isEmpty():
        own = F.col("vec_id").cast("long")
        return vectors.select(own.alias("vec_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), own.isNotNull().alias("kept"))
    placed = scratch.write(cells(reps, cosine, per_cell), "placed")
    found = scratch.write(cell_links(placed, cosine, chunk), "links")
    scratch.drop(placed)
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = reps.select("rep", F.col("label").alias("l"), F.col("embedding").alias("e"), "m").join(counts, "rep", "left")
    known = known.join(parts, F.col("rep") == F.col("node"), "left")
    known = known.select("l", "e", F.xxhash64("e").alias("h"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    v = _typed(vectors)
    v = v.withColumn("hash", F.xxhash64("embedding"))
    same = (F.col("vec_id").isNotNull()) & (F.col("label") == F.col("l")) & (F.col("hash") == F.col("h")) & (F.col("embedding") == F.col("e"))
    out = v.join(known, same, "left")
    component = F.coalesce("c", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, F.lit(False))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), kept.alias("kept"))


def op2_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op2_embedding": op2_embedding}
#: All pairs of a label, and what each vector reaches.
ORACLES = {
    "op2_embedding": """WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= 0.98),
g AS (SELECT a AS v, a AS c FROM l UNION SELECT l.b, least(g.c, l.a) FROM g JOIN l ON l.a = g.v), c AS (SELECT v, min(c) AS c FROM g GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM e LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.v = vec_id"""
}
