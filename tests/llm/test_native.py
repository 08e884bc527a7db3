"""op7 and op8."""

import hashlib
import random
import unicodedata

import pytest

from statelace.llm import fingerprint, mixing


def test_edited_texts(documents):
    r = random.Random(1)
    rows = [(i * 3, "".join(r.choice("abc é\U0001f600\n") for _ in range(r.randrange(0, 30)))) for i in range(80)]
    rows += [(1000, None), (1001, ""), (1002, "x" * 50_000), (1003, "same"), (1004, "same"), (1005, "SAME ")]
    got = {x["doc_id"]: x for x in fingerprint.fingerprint_pairs(documents(rows), rows_per_range=7).collect()}
    texts = [t or "" for _, t in rows]
    for i, (d, t) in enumerate(rows):
        t, after = t or "", texts[(i + 1) % len(texts)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        fold = lambda s: " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", s).casefold()).split())
        assert got[d]["near_edited"] == float(fold(t) == fold(edited)) and got[d]["near_next"] == float(fold(t) == fold(after))
    assert got[1003]["fingerprint"] == got[1004]["fingerprint"] == got[1005]["fingerprint"]


def test_ties_nulls_and_empty(documents):
    got = fingerprint.fingerprint_pairs(documents([(1, "b"), (1, "a"), (1, "a"), (None, "zz")])).collect()
    assert len(got) == 4
    lone = fingerprint.fingerprint_pairs(documents([(5, "abcd")])).collect()
    assert lone[0]["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and lone[0]["near_next"] == 1.0
    assert fingerprint.fingerprint_pairs(documents([])).count() == 0


@pytest.mark.parametrize("bits", [64, 2])
def test_equal_digests_of_different_texts_are_told_apart(documents, bits):
    rows = [(i, t) for i, t in enumerate(["one", "ONE ", "two", "three", "four", "five", "ﬁve", "fi ve", "Straße", "STRASSE", None, ""] * 2)]
    canon = lambda t: " ".join(unicodedata.normalize("NFKC", t or "").casefold().split())
    got = fingerprint.fingerprints(documents(rows), bits=bits).collect()
    assert len(got) == len(rows) and "rank" in got[0].asDict()
    by = {}
    for x in got:
        by.setdefault(x["fingerprint"], set()).add(canon(x["text"]))
    assert all(len(v) == 1 for v in by.values()) and len(by) == len({canon(t) for _, t in rows})
    pairs = fingerprint.fingerprint_pairs(documents(rows), bits=bits, rows_per_range=4).collect()
    by = {}
    for x in pairs:
        by.setdefault(x["fingerprint"], set()).add(canon(dict(rows)[x["doc_id"]]))
    assert all(len(v) == 1 for v in by.values())


def targets(sizes):
    """Shares by weight, refilled until none is above three times its size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_mixture(documents):
    r = random.Random(4)
    rows = []
    for s, n in (("a", 400), ("b", 3), ("Z", 60), ("é", 30), (None, 20), ("c", 1), ("empty", 4)):
        rows += [(len(rows) + i, " ".join(["w"] * (0 if s == "empty" else r.randrange(0, 90))), s) for i in range(n)]
    rows += [(9000, None, "a"), (9001, "x y", "a"), (9001, "x y", "a"), (None, "q", "a")]
    docs = documents(rows)
    got = mixing.mixture(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, at = {}, {}, {}
    source = {(d, len((t or "").split())): s for d, t, s in rows}
    for d, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    for x in got:
        s = source[x["doc_id"], x["size"]]
        assert x["source_size"] == sizes[s] and x["taken"] <= 3 * x["size"]
        taken[s] = taken.get(s, 0) + x["taken"]
        at[s] = x["target"]
    for s, want in targets(sizes).items():
        assert at[s] == pytest.approx(want) and abs(taken[s] - want) <= 90, s
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixture(docs).collect()), key=str)
    mix = mixing.mix(docs)
    assert mix.columns == docs.columns and mix.count() == sum(x["copies"] for x in got)
    assert mixing.mixture(documents([])).count() == 0 and mixing.mix(documents([])).count() == 0


@pytest.mark.parametrize("ranges", [True, False])
def test_targets_of_many_sources(spark, ranges):
    r = random.Random(9)
    sizes = {f"{r.choice('aZé~')}{i}": r.choice([0, 1, 7, 7, 40, r.randrange(1, 5_000)]) for i in range(600)} | {None: 70, "": 3}
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, str(not ranges).lower())  # several ranges of sources, or all in one
    try:
        for many in (sizes, {"one": 5}, {"a": 0, None: 0}, {}):
            df = spark.createDataFrame(list(many.items()), "source string, source_size long")
            got = {x["source"]: x["target"] for x in mixing.source_targets(df).collect()}
            assert got == pytest.approx(targets(many) if many else {})
    finally:
        spark.conf.set(name, before)


def test_rounding_keeps_sums_and_chances(spark):
    r = random.Random(2)
    items = [(g, f"{g}{i}", r.uniform(1, 9), r.uniform(0.01, 0.99)) for g in ("g", "h") for i in range(700)]
    df = spark.createDataFrame(items, "grp string, id string, w double, p double")
    x = {(y["grp"], y["id"]): y["x"] for y in mixing.pivotal_rounding(df, block=16).collect()}
    assert len(x) == len(items) and set(x.values()) == {0, 1}
    for g in ("g", "h"):
        assert abs(sum(w * (x[g, i] - p) for h, i, w, p in items if h == g)) < 9
    half = [(p, x[g, i]) for g, i, w, p in items]
    low, high = [y for p, y in half if p < 0.3], [y for p, y in half if p > 0.7]
    assert sum(low) / len(low) < 0.25 and sum(high) / len(high) > 0.75
