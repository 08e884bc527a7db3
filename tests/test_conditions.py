"""Finding the varying condition, each way against known answers and plain Python."""

import pytest
from pyspark.sql import functions as F

from statelace.operators import conditions


def found(spark, names):
    rows = conditions.varying_condition(spark.createDataFrame([(n,) for n in names], "name string")).collect()
    return sorted((r["strategy"], r["component"], r["first_condition"], r["second_condition"], r["first"], r["second"]) for r in rows)


VARYING = [
    ("sub-01_task-eyesopen_eeg.set", "sub-01_task-eyesclosed_eeg.set", ("eyesopen", "eyesclosed")),
    ("sub-01_task-ec", "sub-01_task-eo", ("eyesclosed", "eyesopen")),
    ("sub-01_acq-dlpfcactive_eeg", "sub-01_acq-dlpfcsham_eeg", ("active", "sham")),
    ("sub-01_task-music", "sub-01_task-maths", ("music", "maths")),
    ("sub-01_task-music", "sub-01_task-speech", ("music", "eyesclosed")),  # words are looked for inside labels: "ec"
    ("sub-01_task-rest_before", "sub-01_task-rest_after", ("pre", "post")),
    ("S01_verum_x", "S01_placebo_x", ("real", "placebo")),
    ("S01_longword_x", "S01_short_x", ("longword", "short")),
    ("sub-01_x1_y", "sub-01_x1_y", None),
    ("sub-01_01_rest.edf", "sub-01_02_rest.edf", None),  # numbers alone say nothing
    ("sub-01_raw.fif", "sub-01_clean.fif", None),
    ("sub-1_p_up", "sub-1_p_down", ("up", "down")),
]


def test_what_varies_between_two_names(spark):
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(VARYING)], "i int, a string, b string")
    got = {r["i"]: r["v"] for r in df.select("i", conditions.varying(F.col("a"), F.col("b")).alias("v")).collect()}
    assert [got[i] and (got[i]["a"], got[i]["b"]) for i in range(len(VARYING))] == [w for *_, w in VARYING]


PARSED = [
    ("sub-5_ses-2_task-memory_run-1_eeg", dict(subject="sub-05", session="ses-02", task="memory", run="run-01", condition=None)),
    ("participant12_session3", dict(subject="sub-12", session="ses-03", task=None, run=None, condition=None)),
    ("sub-100_task-rest_acq-dlpfcsham", dict(subject="sub-100", session=None, task=None, run=None, condition="sham")),
    ("sub-01_acq-foo", dict(subject="sub-01", session=None, task=None, run=None, condition="foo")),
    ("x_task-eyesclosed", dict(subject=None, session=None, task=None, run=None, condition="eyesclosed")),
    ("a-post-b.set", dict(subject=None, session=None, task=None, run=None, condition="post")),
    ("x_condition2", dict(subject=None, session=None, task=None, run=None, condition="cond2")),
    ("xx_b_yy", dict(subject=None, session=None, task=None, run=None, condition="b")),
    ("xx_k_yy", dict(subject=None, session=None, task=None, run=None, condition=None)),
    ("xx_b_y", dict(subject=None, session=None, task=None, run=None, condition=None)),
    ("x_3", dict(subject=None, session=None, task=None, run=None, condition="cond3")),
]


def test_components(spark):
    df = spark.createDataFrame([(n,) for n, _ in PARSED], "name string")
    got = {r["name"]: r.asDict() for r in df.select("name", *[c.alias(k) for k, c in conditions.components(F.col("name")).items()]).collect()}
    for name, want in PARSED:
        assert {k: got[name][k] for k in want} == want, name


def test_by_subject(spark):
    names = [f"sub-{i:02}_task-rest_{c}_trial1" for i in range(1, 6) for c in ("Pre", "Post")] + ["sub-09_task-rest_Pre_trial1", None]
    got = found(spark, names + names[:2])
    assert got == [("subject", "condition", "post", "pre", f"sub-{i:02}_task-rest_Post_trial1", f"sub-{i:02}_task-rest_Pre_trial1") for i in range(1, 6)]


def test_by_component(spark):
    """Subjects have four files each, two in a session, so only components tell pairs."""
    names = [f"sub-{i:02}_ses-{j}_acq-{c}" for i in (1, 2, 3) for j in (1, 2, 3) for c in ("active", "sham")] + ["sub-07_ses-1_acq-sham"]
    got = found(spark, names)
    assert len(got) == 9 and {g[:4] for g in got} == {("component", "condition", "active", "sham")}
    assert all(g[4].replace("active", "sham") == g[5] for g in got)
    assert [g[0] for g in found(spark, [n.replace("acq-", "") for n in names])][:1] == ["delimiter"]  # a word between underscores is no word of its own


def test_by_delimiter(spark):
    names = [f"man{c} {h} hand" for c in "pqr" for h in ("left", "right")] + ["manz left hand", "other"]
    assert found(spark, names) == [("delimiter", " ", "left", "right", f"man{c} left hand", f"man{c} right hand") for c in "pqr"]


@pytest.mark.parametrize("names", [[], ["alone"], ["sub-01_pre", "sub-01_post"], ["", " ", "_", "x"]])
def test_nothing_is_found(spark, names):
    assert found(spark, names) == []


def test_mixed_conditions_are_no_answer_by_subject(spark):
    names = ["sub-01_pre", "sub-01_post", "sub-02_pre", "sub-02_post", "sub-03_sham", "sub-03_real"]
    assert all(g[0] != "subject" for g in found(spark, names))
