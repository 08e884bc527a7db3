"""Features of stretches around events against plain loops."""

from itertools import groupby

import numpy as np
import pytest

from statelace.operators import around

FS = 100.0
PRE, POST = (-50.0, 0.0), (0.0, 100.0)


@pytest.fixture(scope="module")
def trials():
    g = np.random.default_rng(5)
    rows = []
    for rec in ("a", "b"):
        for trial in range(3):
            for i in range(20 if (rec, trial) != ("b", 1) else 4):  # one trial ends before the event
                rows.append((rec, trial, -50.0 + 10 * i, None if g.random() < 0.1 else "ABC"[g.integers(3)], float(g.random()), float(g.uniform(-1, 1))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "recording_id string, trial int, t_ms double, label string, gfp double, r double")


def stretches(rows, pooled):
    """{(recording, trial or None, window): samples in order}"""
    out = {}
    for rec, trial, t, *rest in sorted(rows, key=lambda x: x[:3]):
        for name, (a, b) in (("pre", PRE), ("post", POST)):
            if a <= t < b:
                out.setdefault((rec, None if pooled else trial, name), []).append(rest)
    return out


def plain(samples):
    """{(feature, state, state_to): value}"""
    labels = [x[0] for x in samples]
    held = [x for x in labels if x is not None]
    out = {("COV", s, None): 100 * held.count(s) / len(held) for s in set(held)}
    runs = [(k, len(list(v))) for k, v in groupby(labels)]
    for s in set(held):
        own = [n for k, n in runs if k == s]
        out["OCC", s, None] = len(own) * FS / len(held)
        out["DUR", s, None] = float(np.exp(np.mean(np.log(own)))) * 1000 / FS
        power = sum(g**2 for _, g, _ in samples)
        out["GEV", s, None] = 100 * sum((g * r) ** 2 for x, g, r in samples if x == s) / power
    steps = [(a, b) for a, b in zip(labels, labels[1:]) if a is not None and b is not None and a != b]
    for a, b in set(steps):
        out["TP", a, b] = steps.count((a, b)) / sum(x == a for x, _ in steps)
    return out


@pytest.mark.parametrize("pooled", [False, True])
def test_before_and_after(spark, trials, pooled):
    noise = [(None, 1, 0.0, "A", 1.0, 1.0), ("a", None, 0.0, "A", 1.0, 1.0), ("a", 1, None, "A", 1.0, 1.0)]  # in no window
    f = around.pooled_features if pooled else around.trial_features
    got = f(frame(spark, trials + noise), FS, ("COV", "OCC", "DUR", "GEV", "TP", "ROF", "RTF"), PRE, POST)
    rows = got.collect()
    want = {(*k, *f): v for k, s in stretches(trials, pooled).items() for f, v in plain(s).items()}
    found = {(x["recording_id"], None if pooled else x["trial"], x["window_type"], x["feature"], x["state"], x["state_to"]): x["value"] for x in rows}
    assert found.keys() == want.keys() and len(found) == len(rows)
    assert all(found[k] == pytest.approx(want[k]) for k in want)
    assert {(x["window_type"], x["start_ms"], x["end_ms"]) for x in rows} == {("pre", *PRE), ("post", *POST)}
    if pooled:
        assert {x["n_trials"] for x in rows} == {3}


def test_drawn_labels(spark, trials):
    df = frame(spark, trials)
    shares = lambda rows: {(x["recording_id"], x["trial"], x["window_type"], x["state"]): x["value"] for x in rows if x["feature"] == "COV"}
    codes = ("COV", "DUR")
    real, other, again, drawn = (around.trial_features(df, FS, codes, PRE, POST, kind=k).collect() for k in ("real", "surrogate", "surrogate", "random"))
    assert shares(real) == pytest.approx(shares(other)) and sorted(other) == sorted(again)
    assert {x["value"] for x in real if x["feature"] == "DUR"} != {x["value"] for x in other if x["feature"] == "DUR"}
    seen = {(rec, t): {x[3] for x in trials if x[:2] == (rec, t)} for rec, t, *_ in trials}
    assert drawn and all(x["state"] in seen[x["recording_id"], x["trial"]] for x in drawn)
    assert around.pooled_features(df, FS, codes, PRE, POST, kind="random").count() > 0
    for wrong in ({"kind": "other", "codes": codes}, {"kind": "surrogate", "codes": ("GEV",)}, {"codes": ("ROF",)}):
        with pytest.raises(ValueError):
            around.pooled_features(df, FS, pre=PRE, post=POST, **wrong)


def test_empty(spark):
    assert around.trial_features(frame(spark, []), FS, ("COV", "TP")).count() == 0
    assert around.pooled_features(frame(spark, []), FS, ("COV", "TP")).count() == 0


def test_from_event_to_event(spark, trials):
    samples = [(rec, i, i / FS, x[3], x[4], x[5]) for rec in ("a", "b") for i, x in enumerate(x for x in trials if x[0] == rec)]
    windows = [("a", 0, "x", 0.05, 0.2), ("a", 1, "y", 0.2, None), ("b", 0, "x", 0.1, 0.3), ("b", 1, "x", 0.25, 0.4), ("b", 2, "z", 9.0, None)]
    s = spark.createDataFrame(samples, "recording_id string, sample_ix long, t_s double, label string, gfp double, r double")
    w = spark.createDataFrame(windows, "recording_id string, event_ix int, description string, start_s double, end_s double")
    rows = around.event_features(s, w, FS, ("COV", "OCC", "DUR", "GEV", "TP")).collect()
    want = {}
    for rec, ix, name, a, b in windows:
        inside = [x[3:] for x in samples if x[0] == rec and x[2] >= a and (b is None or x[2] < b)]
        if inside:
            want |= {(rec, ix, name, a, b, *f): v for f, v in plain(inside).items()}
    found = {tuple(x[c] for c in ("recording_id", "event_ix", "description", "start_s", "end_s", "feature", "state", "state_to")): x["value"] for x in rows}
    assert found.keys() == want.keys() and len(found) == len(rows)
    assert all(found[k] == pytest.approx(want[k]) for k in want)
