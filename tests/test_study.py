"""Settings of the study: each changes what comes out; files of several recordings."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from statelace.operators.scoring import Templates
from statelace.plans import pipeline
from statelace.sources import config, files

FS = 250.0
CHANNELS = [f"ch{i}" for i in range(8)]


@pytest.fixture(scope="module")
def study(spark):
    """Two recordings of noisy states, and their maps."""
    g = np.random.default_rng(3)
    maps = g.normal(size=(4, 8))
    rows = []
    for rec in ("a", "b"):
        state = 0
        for i in range(400):
            state = state if g.random() < 0.85 else int(g.integers(4))
            x = maps[state] * g.normal() + g.normal(size=8) * 0.45
            rows.append((rec, i // 100, i, x.tolist()))
    samples = spark.createDataFrame(rows, "recording_id string, trial int, sample_ix long, topo array<double>").cache()
    samples.count()
    return samples, Templates(tuple("ABCD"), maps)


BASE = config.Settings(k=4, points="all", repeats=1, max_rounds=3, threshold=0.6, short_ms=8.0, features=("COV", "DUR"))


def fitted(study, **changes):
    samples, maps = study
    s = replace(BASE, **changes)
    return {(r["recording_id"], r["sample_ix"]): r["label"] for r in pipeline.backfit(samples, maps, FS, s).select("recording_id", "sample_ix", "label").collect()}


def test_backfit_settings(study):
    base = fitted(study)
    assert len(base) == 800
    for change in (
        {"threshold": 0.8}, {"short_ms": 40.0}, {"filter": "remove"}, {"filter": "replace_half"}, {"filter": "none"}, {"filter": "smooth"},
        {"rejection": "flag"}, {"backfit_to": "peaks"}, {"data_type": "epoched"},
    ):
        assert fitted(study, **change) != base, change
    best = pipeline.short_length(*study, FS, replace(BASE, short_ms=None))
    assert fitted(study, short_ms=None) == fitted(study, short_ms=best * 1000 / FS + 0.5) != fitted(study, short_ms=40.0)
    smooth = fitted(study, filter="smooth", rejection="flag")
    for change in ({"smooth_weight": 0.5}, {"smooth_half": 1}, {"smooth_tolerance": 10.0}, {"short_ms": 30.0}):
        assert fitted(study, filter="smooth", rejection="flag", **change) != smooth, change
    assert len(fitted(study, filter="smooth", smooth_weight=None, short_ms=None)) == 800


def lengths(labels):
    out = [[labels[0], 0]]
    for x in labels:
        if x != out[-1][0]:
            out.append([x, 0])
        out[-1][1] += 1
    return [n for _, n in out]


def test_smoothing_leaves_no_short_run(study):
    got = fitted(study, filter="smooth", rejection="flag", threshold=None, short_ms=16.0)
    for rec in ("a", "b"):
        assert min(lengths([got[rec, i] for i in range(400)])) > 4


def test_peaks_mode_changes_labels_at_troughs_only(study):
    samples, maps = study
    got = fitted(study, backfit_to="peaks")
    gfp = {(r["recording_id"], r["sample_ix"]): np.std(r["topo"]) for r in samples.collect()}
    for rec in ("a", "b"):
        for i in range(1, 400):
            if got[rec, i] != got[rec, i - 1]:
                assert gfp[rec, i] <= gfp[rec, i - 1] and (i == 399 or gfp[rec, i] <= gfp[rec, i + 1])


def test_learning_settings(study):
    samples, _ = study
    maps = lambda **c: pipeline.learn(samples, replace(BASE, **c)).maps
    base = maps(max_rounds=20)
    assert maps(max_rounds=20, tolerance=1e9).tolist() != base.tolist()
    assert len(maps(k=None, k_min=2, k_max=4, criterion="gev", max_rounds=2)) in (2, 3, 4)
    ks = {c: len(maps(k=None, k_min=2, k_max=5, criterion=c, max_rounds=2)) for c in ("wss", "davies_bouldin", "bic") if c in pipeline.cluster.DIRECTION}
    assert len(ks) >= 1
    with pytest.raises(ValueError):
        maps(k=None, criterion="other")
    with pytest.raises(ValueError):
        pipeline.learn(samples, replace(BASE, points="other"))


def test_feature_settings(study):
    samples, maps = study
    def values(**changes):
        st = pipeline.Study(samples, FS, replace(BASE, **changes))
        st.templates, st.segmentation = maps, pipeline.backfit(samples, maps, FS, replace(BASE, **changes))
        r = st.features()
        assert r.ok, r.message
        return {tuple(x[c] for c in x.asDict() if c != "value"): x["value"] for x in r.payload.where("feature = 'DUR'").collect()}

    base = values()
    assert values(duration_method="median") != base and values(duration_method="arithmetic") != base
    assert len(values(data_type="epoched")) > len(base) and len(values(window_s=0.4)) > len(base)


def test_features_around_an_event(study):
    samples, maps = study
    s = replace(BASE, data_type="epoched", trial_start_ms=-200.0, pre_from_ms=-200.0, pre_to_ms=0.0, post_from_ms=0.0, post_to_ms=100.0)
    seg = pipeline.backfit(samples, maps, FS, s).cache()
    labels = {(r["recording_id"], r["trial"], r["sample_ix"] % 100): r["label"] for r in seg.collect()}
    out = {}
    for mode in ("trial", "pooled"):
        st = pipeline.Study(samples, FS, replace(s, around=mode))
        st.segmentation = seg
        r = st.features()
        assert r.ok, r.message
        out[mode] = r.payload.where("feature = 'COV'").collect()
    assert {x["n_trials"] for x in out["pooled"]} == {4} and {(x["window_type"], x["start_ms"], x["end_ms"]) for x in out["trial"]} == {("pre", -200.0, 0.0), ("post", 0.0, 100.0)}
    for mode, rows in out.items():
        assert rows
        for x in rows:
            at = range(50) if x["window_type"] == "pre" else range(50, 75)
            trials = [x["trial"]] if mode == "trial" else range(4)
            here = [labels[x["recording_id"], t, i] for t in trials for i in at]
            here = [v for v in here if v is not None]
            assert x["value"] == pytest.approx(100 * here.count(x["state"]) / len(here))
    for wrong in ({"data_type": "raw"}, {"window_s": 1.0}, {"around": "other"}):
        with pytest.raises(ValueError):
            replace(s, **{"around": "trial", **wrong})


def test_preprocessing_settings(study):
    samples, _ = study
    one = lambda **c: pipeline.preprocess(samples, CHANNELS, FS, replace(BASE, **c))
    rows = lambda df: [r["topo"] for r in df.orderBy("recording_id", "sample_ix").collect()]
    base, names, fs = one()
    assert names == CHANNELS and fs == FS and len(rows(base)) == 800
    for change in ({"low_hz": 4.0}, {"high_hz": 20.0}, {"filter_method": "iir"}, {"filter_method": "fft"}, {"low_hz": None, "high_hz": None}):
        assert rows(one(**change)[0]) != rows(base), change
    less, names, _ = one(channels_to_remove=("ch3",))
    assert names == [c for c in CHANNELS if c != "ch3"] and len(rows(less)[0]) == 7
    slow, _, fs = one(resample_hz=125.0)
    assert fs == 125.0 and len(rows(slow)) == 400
    for bad in ({"channels_to_remove": ("x",)}, {"resample_hz": 60.0}, {"low_hz": 50.0}):
        with pytest.raises(ValueError):
            one(**bad)
    whole = pipeline.Study(samples, FS, replace(BASE, resample_hz=125.0, high_hz=30.0), CHANNELS)
    assert all(r.ok for r in whole.run().values()) and whole.segmentation.count() == 400


def test_permutations_and_suffix(spark, tmp_path):
    w = np.random.default_rng(1).normal(size=(3, 6))
    few, many = (pipeline.source_significance(spark, w, replace(BASE, permutations=n)).orderBy("state", "source").collect() for n in (50, 400))
    assert len(few) == 18 and [r["z"] for r in few] != [r["z"] for r in many]
    (tmp_path / "a.set").write_text("x")
    (tmp_path / "b.edf").write_text("x")
    names = lambda s: {r["name"] for r in pipeline.recordings(spark, str(tmp_path), replace(BASE, suffix=s)).collect()}
    assert names(".auto") == {"a", "b"} and names(".edf") == {"b"}


@pytest.mark.parametrize("name", ["rejection", "backfit_to", "data_type", "filter_method", "duration_method", "filter"])
def test_unknown_settings(name):
    with pytest.raises(ValueError):
        config.Settings(**{name: "other"})


def test_settings_text():
    s = config.Settings(short_ms=None, smooth_weight=None, backfit_to="peaks", filter_method="iir", data_type="epoched")
    assert config.loads(config.dumps(s)) == s


def test_electrode_lists_of_several_files(spark, tmp_path):
    for n, scale in (("one", 1.0), ("two", 1000.0)):
        lines = "".join(f"{i}\tE{i}\t{0.1 * i * scale}\t{0.2 * scale}\t{-0.05 * i * scale}\n" for i in range(1, 5))
        (tmp_path / f"{n}.ced").write_text("Number\tlabels\tX\tY\tZ\n" + lines)
    got = {(r["montage"], r["channel_ix"]): r for r in files.read_electrodes(spark, str(tmp_path)).collect()}
    assert set(got) == {(m, i) for m in ("one", "two") for i in range(4)}
    assert all(got["two", i]["name"] == f"E{i + 1}" and got["two", i]["y"] == pytest.approx(got["one", i]["y"]) for i in range(4))
    assert {r["montage"] for r in files.read_electrodes(spark, str(tmp_path / "one.ced"), "mine").collect()} == {"mine"}
    with pytest.raises(ValueError):
        files.read_electrodes(spark, str(tmp_path), "mine")


def test_wide_tables_drop_no_column(spark, monkeypatch):
    rof = spark.range(30).select(F.lit("r").alias("recording_id"), F.lit(0.0).alias("t_ms"), F.col("id").cast("string").alias("state"), F.col("id").cast("double").alias("clr_bc"))
    assert len(files.rof_table(rof).columns) == 32
    monkeypatch.setattr(files, "MOST_COLUMNS", 20)
    with pytest.raises(ValueError):
        files.rof_table(rof)
    assert len(files.rof_table(rof, ["1", "2"]).columns) == 4
