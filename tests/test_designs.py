"""Repeated measures, bootstrap and permuted clusters against plain loops and known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statelace.functions import special
from statelace.operators import compare, designs, stats

VALUES = "feature string, grp string, subject int, value double"


def test_chi_square_tails():
    known = [(3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (18.307038053275146, 10, 0.05), (29.58829844507442, 10, 0.001), (2.0, 2, math.exp(-1))]
    for x, df, p in known:
        assert float(special.chi2_sf(x, df)) == pytest.approx(p, rel=1e-9)


def test_repeated_measures(spark):
    """Five conditions against sums of squares from scratch; a subject that lacks one doesn't count, trials are averaged."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9, 1)) + rng.normal(size=(9, 5)) * [1, 2, 1, 3, 1] + [0, 0.5, 1, 0, 2]
    rows = [("f", f"c{j}", i, float(x[i, j] + e)) for i in range(9) for j in range(5) for e in (-0.25, 0.25)]
    rows += [("f", "c1", 99, 50.0), ("f", "c2", 99, None), ("f", "c2", 98, math.nan), ("one", "c1", 1, 2.0), ("flat", "a", 1, 1.0), ("flat", "b", 1, 1.0), ("flat", "a", 2, 2.0), ("flat", "b", 2, 2.0), ("apart", "a", 1, 1.0), ("apart", "b", 2, 1.0)]
    got = {r["feature"]: r for r in designs.repeated_anova(spark.createDataFrame(rows, VALUES)).collect()}
    n, k = x.shape
    resid = x - x.mean(0) - x.mean(1, keepdims=True) + x.mean()
    f = (n * ((x.mean(0) - x.mean()) ** 2).sum() / (k - 1)) / ((resid**2).sum() / ((n - 1) * (k - 1)))
    contrasts = np.linalg.qr(np.column_stack([np.ones(k), np.eye(k)[:, :-1]]))[0][:, 1:]
    m = contrasts.T @ np.cov(x.T) @ contrasts
    gg = np.trace(m) ** 2 / ((k - 1) * np.trace(m @ m))
    r = got["f"]
    assert (r["n"], r["k"], r["df1"], r["df2"]) == (9, 5, 4.0, 32.0)
    assert r["stat"] == pytest.approx(f, rel=1e-9) and r["gg"] == pytest.approx(gg, rel=1e-9)
    assert r["hf"] == pytest.approx(min(1, (n * 4 * gg - 2) / (4 * (n - 1 - 4 * gg))), rel=1e-9)
    assert r["w"] == pytest.approx(np.linalg.det(m) / (np.trace(m) / 4) ** 4, rel=1e-8)
    assert r["p_gg"] == pytest.approx(float(special.f_sf(f, 4 * gg, 32 * gg)), rel=1e-9) and r["p"] < r["p_gg"]
    assert r["eta"] == pytest.approx(4 * f / (4 * f + 32), rel=1e-9) and 0 < r["p_w"] < 1
    assert got["one"]["stat"] is None and got["one"]["p"] == 1.0 and got["flat"]["stat"] is None and "apart" not in got


def test_two_conditions_are_the_paired_t(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(8, 2)) + [0, 1]
    rows = [("f", "ab"[j], i, float(x[i, j])) for i in range(8) for j in range(2)]
    r = designs.repeated_anova(spark.createDataFrame(rows, VALUES)).first()
    d = x[:, 1] - x[:, 0]
    t = d.mean() / d.std(ddof=1) * math.sqrt(8)
    assert r["stat"] == pytest.approx(t**2) and r["p"] == pytest.approx(float(special.t_sf2(t, 7))) and r["gg"] == 1.0


def test_bootstrap_against_loops(spark):
    """Draws from one frame with the same weights, whatever the partitions; empty and null inputs."""
    rng = np.random.default_rng(3)
    rows = [("f", "ab"[i % 2], i, float(rng.exponential() + i % 2)) for i in range(60) for _ in range(1 + i % 3)]
    extra = [("f", "a", 1000, None), ("f", "b", 1001, math.nan), ("f", "c", 5, 9.0), ("half", "a", 1, 1.0), ("half", "a", 2, 2.0)]
    df = spark.createDataFrame(rows + extra, VALUES)
    got = {r["feature"]: r for r in designs.bootstrap(df.repartition(7), "a", "b", 300, folds=10).collect()}
    again = {r["feature"]: r for r in designs.bootstrap(df.coalesce(1), "a", "b", 300, folds=10).collect()}
    hashes = {r["subject"]: r["h"] for r in df.select("subject", F.xxhash64(F.col("subject").cast("string")).alias("h")).distinct().collect()}
    w = designs.weights(np.array([hashes[r[2]] for r in rows]), 300, 10, 42, 0, 311)
    v, second = np.array([r[3] for r in rows]), np.array([r[1] == "b" for r in rows])
    diff = (w[second].T @ v[second]) / w[second].sum(0) - (w[~second].T @ v[~second]) / w[~second].sum(0)
    low, high = designs.bca(diff[0], np.sort(diff[1:301]), diff[301:], 0.95)
    r = got["f"]
    assert (r["n1"], r["n2"], r["draws"]) == ((~second).sum(), second.sum(), 300)
    assert r["diff"] == pytest.approx(v[second].mean() - v[~second].mean()) and r["se"] == pytest.approx(diff[1:301].std(ddof=1))
    assert (r["ci_low"], r["ci_high"]) == (pytest.approx(low), pytest.approx(high)) and r["ci_low"] < r["diff"] < r["ci_high"]
    assert all(again["f"][c] == pytest.approx(r[c]) for c in ("diff", "se", "ci_low", "ci_high", "p"))
    assert got["half"]["diff"] is None and got["half"]["p"] == 1.0 and got["half"]["draws"] == 0
    assert designs.bootstrap(df.where("false"), "a", "b", 10).count() == 0


def test_poisson_weights():
    w = designs.weights(np.arange(4000), 50, 5, 7, 0, 56)
    assert (w[:, 0] == 1).all() and abs(w[:, 1:51].mean() - 1) < 0.01 and abs(w[:, 1:51].var() - 1) < 0.03
    assert ((w[:, 51:] == 0).sum(1) == 1).all() and abs(np.corrcoef(w[:, 1], w[:, 2])[0, 1]) < 0.06


def test_bootstrap_covers(spark):
    """Of 95 % intervals of a difference of skewed values, about 95 % hold the true one."""
    rng = np.random.default_rng(4)
    rows = [(f"f{k}", "ab"[g], 1000 * k + 100 * g + i, float(rng.exponential() + 0.5 * g)) for k in range(200) for g in range(2) for i in range(40)]
    got = designs.bootstrap(spark.createDataFrame(rows, VALUES), "a", "b", 600).collect()
    inside = np.mean([r["ci_low"] <= 0.5 <= r["ci_high"] for r in got])
    assert len(got) == 200 and 0.89 <= inside <= 0.99


CELLS = "trial int, grp string, t_ms double, state string, value double"


def _trials(rng, effect, n=(14, 10), times=8):
    rows = []
    for i in range(sum(n)):
        grp = "a" if i < n[0] else "b"
        for t in range(times):
            for s in "ABC":
                shift = effect if grp == "a" and s in "AB" and 2 <= t < 6 else 0.0
                rows.append((i, grp, float(t * 10), s, float(rng.normal() + shift)))
    return rows


def test_permuted_clusters_against_loops(spark):
    """Every statistic under every exchange, the clusters and their p, with trials in several blocks."""
    rng = np.random.default_rng(5)
    rows = [r for r in _trials(rng, 1.5) if rng.random() > 0.05]
    df = spark.createDataFrame([*rows, (3, "a", 0.0, "A", None), (77, "other", 0.0, "A", 9.0)], CELLS)
    tests = designs.cell_tests(df, "a", "b", 60, block=9, share=1).toPandas()
    grid = pd.DataFrame(rows, columns=["trial", "grp", "t", "s", "v"])
    own = tests[tests["perm"] == 0].set_index(["t_ms", "state"])["stat"]
    for (t, s), g in grid.groupby(["t", "s"]):
        x, y = g["v"][g["grp"] == "a"], g["v"][g["grp"] == "b"]
        pooled = math.sqrt(((len(x) - 1) * x.var() + (len(y) - 1) * y.var()) / (len(x) + len(y) - 2) * (1 / len(x) + 1 / len(y)))
        assert own[(t, s)] == pytest.approx((x.mean() - y.mean()) / pooled)
    assert tests.groupby("perm").size().eq(24).all() and tests["perm"].nunique() == 61
    assert tests[tests["perm"] > 0].groupby("perm")["stat"].first().nunique() > 50
    whole = designs.cell_tests(df, "a", "b", 200).toPandas()
    null = []
    for p, g in whole.groupby("perm"):
        m = g.pivot(index="t_ms", columns="state", values="stat").sort_index().to_numpy()
        of = designs.components(m, 2.0)
        mass = [m[of == i].sum() for i in range(1, of.max() + 1)]
        if p == 0:
            own_mass = mass
        else:
            null.append(max(map(abs, mass), default=0))
    got = sorted(designs.permuted_clusters(df, "a", "b", 200).collect(), key=lambda r: r["cluster"])
    assert [r["mass"] for r in got] == pytest.approx(own_mass)
    assert [r["p"] for r in got] == pytest.approx([(1 + sum(x >= abs(m) - 1e-9 for x in null)) / 201 for m in own_mass])
    top = max(got, key=lambda r: abs(r["mass"]))
    assert top["p"] < 0.05 and top["mass"] > 0 and "A" in top["states"] and 10 <= top["start_ms"] <= 30


def test_exchanges_keep_numbers_and_are_uniform():
    e = designs.exchanged(5, 20, 6, np.arange(4001), 42)
    assert (e.sum(axis=1) == 6).all() and e[0].tolist() == [True] * 6 + [False] * 14
    assert np.abs(e[1:].mean(axis=0) - 0.3).max() < 0.04


def test_exchange_within_subjects(spark):
    """Differences between subjects alone give nothing when labels are exchanged within them; the numbers within each stay."""
    rng = np.random.default_rng(6)
    rows = [(i, "ab"[i % 2], float(t), "A", float(rng.normal() + 10 * (i // 8)), i // 8) for i in range(40) for t in range(5)]
    got = designs.permuted_clusters(spark.createDataFrame(rows, CELLS + ", subject int"), "a", "b", 99, threshold=0.01, within="subject").collect()
    assert got and min(r["p"] for r in got) > 0.05
    assert designs.permuted_clusters(spark.createDataFrame([], CELLS), "a", "b", 9).count() == 0


def test_components_against_search():
    rng = np.random.default_rng(8)
    for _ in range(20):
        m = rng.normal(size=(12, 4)) * 2
        of = designs.components(m, 1.0)
        seen, number = np.zeros(m.shape, int), 0
        for t, s in np.ndindex(m.shape):
            if abs(m[t, s]) > 1 and not seen[t, s]:
                number, todo = number + 1, [(t, s)]
                while todo:
                    i, j = todo.pop()
                    if 0 <= i < 12 and 0 <= j < 4 and not seen[i, j] and abs(m[i, j]) > 1 and m[i, j] * m[t, s] > 0:
                        seen[i, j] = number
                        todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
        assert (of == seen).all()


def test_exact_signed_ranks(spark):
    """All signs of six ranks counted one by one; ties, equal values and many pairs take the normal p."""
    sums = [sum(i + 1 for i in range(6) if m >> i & 1) for m in range(64)]
    for w in range(11):
        assert special.signed_rank_p(w, 6) == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 64))
    d = {"few": [1.0, -2.0, 3.0, 4.0, 5.0, 6.0], "ties": [1.0, 1.0, 3.0, 4.0, 5.0], "zero": [0.0, 1.0, 2.0, 3.0], "many": [float(i) for i in range(1, 61)]}
    pairs = spark.createDataFrame([(f, i, x, 0.0) for f, v in d.items() for i, x in enumerate(v)], "feature string, subject int, x double, y double")
    got = {r["feature"]: r for r in stats.wilcoxon_p(pairs).collect()}
    assert {f: r["exact"] for f, r in got.items()} == {"few": True, "ties": False, "zero": False, "many": False}
    assert got["few"]["stat"] == 2 and got["few"]["p"] == pytest.approx(2 * sum(s <= 2 for s in sums) / 64)
    assert got["many"]["p"] < 1e-9 and 0 < got["ties"]["p"] < 1


def test_models_by_name(spark):
    """Every model that is offered runs and gives p between 0 and 1; planted differences are found by those of values."""
    rng = np.random.default_rng(9)
    rows = [("f", "ab"[g], i, float(rng.gamma(8) + 6 * g)) for g in range(2) for i in range(12) for _ in range(2)]
    values, cells = spark.createDataFrame(rows, VALUES), spark.createDataFrame(_trials(rng, 2.0), CELLS)
    for model in sorted({m for of in compare.OFFERED.values() for m in of}):
        if model == "cluster_permutation":
            got = compare.tested(cells, model, "a", "b", permutations=50).collect()
        else:
            got = compare.tested(values, model, "a", "b").collect()
        assert got and all(0 <= r["p"] <= 1 for r in got) and min(r["p"] for r in got) < 0.05, model
    assert compare.offered("trial", False, False) == ("gee_gamma", "bootstrap")
    with pytest.raises(ValueError):
        compare.tested(values, "guess", "a", "b")
    with pytest.raises(ValueError):
        compare.offered("site", True, True)
