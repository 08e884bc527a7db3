"""op13: whitening against a covariance formed in numpy."""

import math
import random

import numpy as np
import pytest

from statelace.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, key string, v string, k string, part string, value string, deviation string, n string"


def make(spark, vectors):
    return spark.createDataFrame([(i, v, 0, *["x"] * 7) for i, v in vectors], SCHEMA)


def check(rows, vectors, components=8):
    kept = [(i, v) for i, v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100_000 for c in v] for _, v in kept], dtype=object)
    n, k = len(kept), min(components, x.shape[1])
    dev = (x * n - x.sum(axis=0)).astype(object)
    c = (dev / n).astype(float)
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1], u[:, ::-1]
    assert len(rows) == n * k and {r["n"] for r in rows} == {n}
    want = {}
    for (i, _), d, row in zip(kept, dev.tolist(), c):
        want.setdefault(i, []).append((sum(a * a for a in d), np.abs(row @ u[:, :k]) / np.sqrt(e[:k])))
    for r in rows:
        j = r["component"] - 1
        assert any(r["deviation"] == d and abs(abs(r["whitened"]) - y[j]) < 1e-6 for d, y in want[r["vec_id"]])
        assert abs(r["explained"] / (e[j] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    y = np.array([[r["whitened"] for r in sorted(rows, key=lambda r: (r["vec_id"], r["component"]))]]).reshape(n, k)
    assert np.abs(y.T @ y / n - np.eye(k)).max() < 1e-9  # one sign for all rows


@pytest.mark.parametrize("dims", [3, 12, 70])
def test_components(spark, dims):
    g = np.random.default_rng(dims)
    scale = 1.5 ** -np.arange(dims)
    vectors = [(i, v) for i, v in enumerate((g.normal(size=(900, dims)) * scale * 5 + 3).tolist())]
    vectors += [(-1, None), (-2, [None] + [0.0] * (dims - 1)), (-3, [math.nan] * dims), (-4, [-math.inf] * dims)]
    check(whitening.whiten(make(spark, vectors)).collect(), vectors)


def test_parts_and_fan_in_do_not_matter(spark):
    g = np.random.default_rng(1)
    vectors = list(enumerate(g.normal(size=(400, 9)).tolist()))
    for parts in (1, 5, 70):
        check(whitening.whiten(make(spark, vectors).repartition(parts)).collect(), vectors)


def test_nothing_varies(spark):
    rows = whitening.whiten(make(spark, [(1, [2.0, 3.0]), (1, [2.0, 3.0]), (None, [2.0, 3.0])])).collect()
    assert len(rows) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in rows} == {(3, 0, None, None, None)}
    lone = whitening.whiten(make(spark, [(1, [1.0, 2.0])])).collect()
    assert [r["whitened"] for r in lone] == [None, None]


def test_one_direction_only(spark):
    vectors = [(i, [float(i), 2.0 * i, 0.5]) for i in range(10)]
    rows = whitening.whiten(make(spark, vectors)).collect()
    first = [r for r in rows if r["component"] == 1]
    assert all(r["whitened"] is not None and abs(r["explained"] - 1) < 1e-12 for r in first)
    assert all(r["whitened"] is None for r in rows if r["component"] > 1)


def test_unlike_lengths_and_huge_entries(spark):
    r = random.Random(4)
    vectors = [(i, [r.random() for _ in range(4)]) for i in range(50)]
    short = [*vectors, (50, [0.5, 0.25]), (51, [])]
    check(whitening.whiten(make(spark, short)).collect(), [(i, v + [0.0] * (4 - len(v))) for i, v in short])
    rows = whitening.whiten(make(spark, [*vectors, (99, [1e300, -1e300, 0.0, 1.0])])).collect()
    assert len(rows) == 51 * 4 and any(r["deviation"] is None for r in rows)
    exact = [(i, [1e6 * (i + 1), 0.0]) for i in range(3)]
    assert [x["deviation"] for x in whitening.whiten(make(spark, exact)).where("component = 1").orderBy("vec_id").collect()] == [
        (3 * 1024_000_000 * (i + 1) - 6 * 1024_000_000) ** 2 if (3 * 1024_000_000 * (i - 1)) ** 2 < 1 << 63 else None for i in range(3)
    ]


def test_empty(spark):
    assert whitening.whiten(make(spark, [])).count() == 0
    assert whitening.whiten(make(spark, [(1, None), (2, [])])).count() == 0
