"""Inverse solutions on planted sources, and the regression tree against a solver that holds everything."""

import numpy as np
import pytest

from statelace.operators import inverse

TOPO = "sample_ix int, topo array<double>"
WS = "w array<double>, src array<double>"


def _field(seed=0, channels=24, side=7):
    """Positions on a grid below electrodes on a plane, with fields that fall with the square of the distance."""
    rng = np.random.default_rng(seed)
    xy = np.stack(np.meshgrid(np.linspace(-1, 1, side), np.linspace(-1, 1, side)), -1).reshape(-1, 2)
    sources = np.column_stack([xy, np.full(len(xy), -0.4)])
    electrodes = np.column_stack([rng.uniform(-1.2, 1.2, (channels, 2)), np.full(channels, 0.3)])
    gap = electrodes[:, None] - sources[None]
    return gap[..., 2] / np.linalg.norm(gap, axis=2) ** 3, sources


@pytest.mark.parametrize("method", ["eloreta", "sloreta"])
def test_a_single_source_is_found_where_it_is(spark, method):
    lead, positions = _field()
    n = lead.shape[1]
    samples = spark.createDataFrame([(i, lead[:, i].tolist()) for i in range(n)] + [(n, None)], TOPO)
    got = inverse.localise(samples, inverse.inverse_operator(lead, method, positions=positions)).orderBy("sample_ix").collect()
    assert [int(np.abs(r["src"]).argmax()) for r in got[:n]] == list(range(n)) and got[n]["src"] is None
    assert all(r["src"] is None for r in inverse.localise(samples.where(f"sample_ix = {n}"), lead.T).collect())


def test_eloreta_is_a_fixed_point():
    lead, _ = _field(1)
    k = inverse.inverse_operator(lead, "eloreta")
    g = lead - lead.mean(axis=0)
    resolution = k @ g
    assert np.abs(resolution).argmax(axis=0).tolist() == list(range(g.shape[1]))
    assert np.diag(resolution).min() > 0


@pytest.mark.parametrize("method", ["loreta", "laura"])
def test_smooth_inverses_explain_and_are_smooth(method):
    """At little noise the data come back, at a roughness that no other solution with the same data goes below."""
    lead, positions = _field(2)
    g = lead - lead.mean(axis=0)
    penalty = inverse._penalty(g, method, positions, 6)
    x = g @ np.exp(-4 * ((positions[:, :2] - 0.3) ** 2).sum(axis=1))
    s = inverse.inverse_operator(lead, method, snr=1e5, positions=positions) @ x
    assert np.allclose(g @ s, x, atol=1e-4 * np.abs(x).max())
    null = np.linalg.svd(g)[2][np.linalg.matrix_rank(g) :]
    for v in null:
        for step in (-0.1, 0.1):
            assert np.linalg.norm(penalty @ s) <= np.linalg.norm(penalty @ (s + step * v)) + 1e-9
    assert abs(int(np.abs(s).argmax()) - int(np.exp(-4 * ((positions[:, :2] - 0.3) ** 2).sum(axis=1)).argmax())) <= 8
    with pytest.raises(ValueError):
        inverse.inverse_operator(lead, method)


def test_sparse_sources(spark):
    """A planted source alone is found, and the penalty's optimality conditions hold for every sample."""
    lead = np.random.default_rng(3).normal(size=(24, 40))
    g = lead - lead.mean(axis=0)
    rng = np.random.default_rng(4)
    x = np.vstack([lead[:, [7]].T * 3, rng.normal(size=(5, 24)), np.zeros((1, 24))])
    got = inverse.localise_sparse(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], TOPO), lead, 0.2, 20_000).orderBy("sample_ix").collect()
    src = np.array([r["src"] for r in got])
    assert np.flatnonzero(np.abs(src[0]) > 1e-6).tolist() == [7] and (src[-1] == 0).all()
    for s, row in zip(src[:-1], x):
        c = row - row.mean()
        pull = g.T @ (c - g @ s)
        bound = 0.2 * np.abs(g.T @ c).max()
        assert np.abs(pull).max() <= bound * (1 + 1e-4) and np.allclose(pull[np.abs(s) > 1e-6], bound * np.sign(s[np.abs(s) > 1e-6]), rtol=1e-3)


def test_regression_tree_against_lstsq(spark):
    """Nearly parallel states: normal equations would lose them. Rows without values don't count."""
    rng = np.random.default_rng(5)
    w = rng.normal(size=(400, 4))
    w[:, 3] = w[:, 2] + 1e-6 * rng.normal(size=400)
    s = w @ rng.normal(size=(4, 9)) + 1e-3 * rng.normal(size=(400, 9))
    rows = [(a.tolist(), b.tolist()) for a, b in zip(w, s)] + [(None, s[0].tolist()), (w[0].tolist(), None), ([float("nan")] * 4, s[0].tolist())]
    df = spark.createDataFrame(rows, WS)
    want = np.linalg.lstsq(w, s, rcond=None)[0]
    for parts in (1, 13, 150):
        got = inverse.regress_sources(df.repartition(parts), 4, 9)
        assert np.allclose(w @ got, w @ want, atol=1e-8) and np.allclose(got, want, rtol=1e-6, atol=1e-6)
    twin = np.column_stack([w[:, :3], w[:, 2]])
    same = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(twin, s)], WS)
    assert np.allclose(inverse.regress_sources(same, 4, 9), np.linalg.lstsq(twin, s, rcond=None)[0], atol=1e-8)
    few = inverse.regress_sources(df.limit(2), 4, 9)
    assert np.allclose(few, np.linalg.lstsq(w[:2], s[:2], rcond=None)[0], atol=1e-8)
    assert (inverse.regress_sources(df.where("false"), 4, 9) == 0).all()


def test_leadfields_come_from_a_table(spark):
    t = spark.createDataFrame([(1, [1.0, 2.0]), (0, [3.0, 4.0])], "source int, topo array<double>")
    assert inverse.leadfield_of(t).tolist() == [[3.0, 1.0], [4.0, 2.0]]
