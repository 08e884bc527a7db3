"""What a review found, on small tables of its own."""

import duckdb
import numpy as np

from statelace import catalog
from statelace.operators import cluster, conditions, features, signal, stats


def events(tmp_path, users):
    """A folder with events: for each user a list of (event_type, value) in order of time."""
    rows = [(u, i, kind, value) for u, series in users.items() for i, (kind, value) in enumerate(series)]
    c = duckdb.connect()
    c.sql("CREATE TABLE e (user_id BIGINT, i BIGINT, event_type VARCHAR, value DOUBLE)")
    c.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", rows)
    c.sql(f"""COPY (SELECT row_number() OVER (ORDER BY user_id, i) AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, user_id, event_type, value FROM e)
        TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    return str(tmp_path)


def of_sql(name, folder, tables=("events",)):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return sorted(c.sql(catalog.ORACLES[name]).fetchall())


def test_flat_tops_are_no_peaks_of_the_query(spark, tmp_path):
    folder = events(tmp_path, {1: [(k, v) for k, v in zip(("view", "click", "signup", "view", "purchase", "view", "click"), (1.0, 5.0, 5.0, 2.0, 7.0, 3.0, 1.0))], 2: [("view", 1.0), ("click", 2.0), ("signup", 2.0), ("view", 1.0)]})
    got = sorted(tuple(r) for r in catalog.QUERIES["peak_backfit"](spark, folder).collect())
    assert got == of_sql("peak_backfit", folder)


def test_pairs_meet_in_a_fixed_number_of_copies(spark):
    copies = []
    for n in (300, 3_000):
        some = spark.range(n).selectExpr("id AS i", "id % 3 AS si", "array(rand(1), rand(2), rand(3)) AS topo")
        blocks = cluster._blocks(some, (), n, cluster.PARTS)
        copies.append(blocks.count().agg({"count": "sum"}).first()[0] / n)
    assert copies[0] == copies[1] == cluster.PARTS


def test_pairwise_criteria_with_copies_strings_and_no_state(spark, monkeypatch):
    monkeypatch.setattr(cluster, "TILE", 7)
    g = np.random.default_rng(0)
    x = g.normal(size=(200, 6))
    state = [None if i % 50 == 7 else "abc"[i % 3] for i in range(200)]
    key = [i // 2 if i < 20 else i for i in range(200)]  # ten keys come twice, and meet not themselves
    rows = spark.createDataFrame([(k, s, t.tolist()) for k, s, t in zip(key, state, x)], "sample_ix long, state string, topo array<double>")
    keep = np.array([s is not None for s in state])
    x, state, key = x[keep], np.array(state)[keep], np.array(key)[keep]
    z = x - x.mean(axis=1, keepdims=True)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    d = 1 - np.minimum(np.abs(z @ z.T), 1)
    other, same = key[:, None] != key[None], state[:, None] == state[None]
    assert abs(cluster.dunn(rows).first()["value"] - d[~same & other].min() / d[same & other].max()) < 1e-9
    want = sum((d[same & other & (state == s)[:, None]] ** 2).sum() / (2 * (state == s).sum()) for s in "abc")
    assert abs(cluster.within_dispersion(rows).first()["value"] - want) < 1e-9
    plain = spark.createDataFrame([(int(k), str(s), t.tolist()) for k, s, t in zip(np.arange(len(x)), state, x)], "sample_ix long, state string, topo array<double>")
    mean = lambda i, s: d[i, (state == s) & (np.arange(len(x)) != i)].mean()
    each = [(mean(i, state[i]), min(mean(i, s) for s in "abc" if s != state[i])) for i in range(len(x))]
    assert abs(cluster.silhouette(plain).first()["value"] - np.mean([(b - a) / max(a, b) for a, b in each])) < 1e-9


def test_fir_makes_no_chunks_without_samples(spark, monkeypatch):
    made = []
    g = np.random.default_rng(1)
    taps = signal.fir_taps(250.0, 5.0, 60.0)
    lines = {"a": g.normal(size=30), "b": g.normal(size=500), "c": g.normal(size=64), "d": g.normal(size=1)}
    rows = [(r, "v", i, float(v)) for r, x in lines.items() for i, v in enumerate(x)]
    series = spark.createDataFrame(rows, "recording_id string, channel string, sample_ix long, x double")
    frame = type(series)
    one = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, *a, **k: made.append(df.count()) or one(df, *a, **k))
    got = signal.fir(series, taps, 64)
    assert made == [1 + 8 + 1 + 1]  # each chunk of each recording, none before its beginning or after its end
    for r, x in lines.items():
        n, half = len(x) - 1, len(taps) // 2
        line = np.zeros(len(x) + 2 * half)
        for i, v in enumerate(x):
            line[half + i] = v
            if 0 < i <= half:
                line[half - i] = 2 * x[0] - v
            if n - half <= i < n:
                line[half + 2 * n - i] = 2 * x[-1] - v
        y = {k: v for k, v in got.where(f"recording_id = '{r}'").select("sample_ix", "x").collect()}
        assert np.abs(np.convolve(line, taps, "valid") - np.array([y[i] for i in range(len(x))])).max() < 1e-9


def test_a_subject_gets_its_signs_once(monkeypatch):
    drawn, one = [], stats.signs
    monkeypatch.setattr(stats, "signs", lambda h, *a: drawn.append(len(h)) or one(h, *a))
    g = np.random.default_rng(2)
    for h, t in ((np.repeat(np.arange(20), 30), np.tile(np.arange(30.0), 20)), (np.arange(200), np.arange(200.0))):  # a full table, and one with gaps
        v, ids = g.normal(size=len(h)), np.arange(50)
        times, parts = stats.flipped_sums(h, t, v, ids, 42, 16)
        got = np.concatenate([x for _, x in parts], axis=1)
        assert set(drawn) == {len(set(h.tolist()))}
        drawn.clear()
        want = [(one(h, ids, 42) * v[:, None])[t == x].sum(axis=0) for x in times]
        assert np.abs(got - want).max() < 1e-12


def test_features_deal_samples_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(features, "DEALT", 50)
    seq = spark.range(1_000).selectExpr("id % 100 AS recording_id", "id AS sample_ix", "substr('ABC', 1 + id % 7 % 3, 1) AS label")
    codes = ("COV", "OCC", "DUR", "MMD", "TP", "ER", "ERR", "LZC")
    plan = features.features(seq, 250.0, codes)._jdf.queryExecution().toString()
    assert plan.count("RepartitionByExpression [recording_id") >= len(codes) and "hashpartitioning(recording_id" in plan and ", 20), REPARTITION_BY_NUM" in plan
    each = [features.features(seq, 250.0, (c,)).count() for c in codes]
    assert features.features(seq, 250.0, codes).count() == sum(each)


def test_short_recordings_are_shuffled_as_arrays(spark, monkeypatch):
    g = np.random.default_rng(3)
    rows = [(r, i, [None, "a", "b", "c"][g.integers(0, 4)]) for r, n in ((1, 40), (2, 7), (3, 2), (4, 1), (5, 90)) for i in range(n)]
    rows += [(6, i, None) for i in range(3)] + [(7, i, "a") for i in range(9)]
    seq = spark.createDataFrame(rows, "recording_id long, sample_ix long, label string")
    for size in (2, 3):
        found = []
        for short in (100_000, 0, 20):  # all as arrays, all as rows, some of each
            monkeypatch.setattr(features, "SHORT", short)
            monkeypatch.setattr(features, "CELLS", 200)
            df = features.surrogate_ratios(seq, 30, size)
            assert short < 100_000 or "MapInArrow" in df._jdf.queryExecution().toString()
            found.append({(r["recording_id"], r["class"]): (r["n"], r["mean"], r["sd"]) for r in df.collect()})
        for other in found[1:]:
            assert other.keys() == found[0].keys()
            for k, (n, *v) in other.items():
                assert n == found[0][k][0] and all(x is y or abs(x - y) < 1e-9 for x, y in zip(v, found[0][k][1:])), k


def test_names_are_parsed_once_after_they_are_dealt(spark, monkeypatch):
    names = spark.createDataFrame([(f"man{i}_{h}_hand",) for i in range(20) for h in ("left", "right")], "name string").distinct()
    plans, frame = [], type(names)
    for action in ("first", "collect"):
        one = getattr(frame, action)
        monkeypatch.setattr(frame, action, lambda df, one=one: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or one(df))
    assert conditions.by_subject(names) is None and conditions.by_component(names) is None
    for pattern in (r"sub-?0*(\d+)", r"participant-?(\d+)", r"(?:condition|cond)(\d+)", r"\b(sham)\b"):
        plan = next(p for p in plans if pattern in p)
        assert plan.count(pattern) == 1, pattern  # not once more for each use of its result and each filter
        assert plan.index(pattern) < plan.index("Aggregate [name"), pattern  # above the step that deals names to tasks, not in the tasks that read them
