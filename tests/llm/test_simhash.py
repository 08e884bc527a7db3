import random
import re

import numpy as np
import pytest
import xxhash

from statelace.llm import simhash
from statelace.llm.common import connected_components


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps):
    """Smallest index reachable over links of at most 4 bits."""
    x = np.array(fps, np.uint64)
    link = np.bitwise_count(x[:, None] ^ x[None]) <= 4
    c = np.arange(len(x))
    while True:
        new = np.array([c[link[i]].min() for i in range(len(x))])
        if (new == c).all():
            return c
        c = new


def test_against_brute_force(documents):
    r = random.Random(3)
    vocabulary = [f"Word{i}" for i in range(300)]
    rows = []
    for i in range(150):
        t = [r.choice(vocabulary) for _ in range(r.randrange(0, 200))]
        rows.append((i, " ".join(t)))
        if i % 3 == 0 and t:
            for j in range(3):
                u = list(t)
                u[r.randrange(len(u))] = "edit"
                rows.append((1000 + 3 * i + j, "\n".join(u)))
    rows += [(7000, None), (7001, ""), (7002, " \t"), (7003, "ÀB c"), (7004, "Àb C"), (7005, "one"), (7006, "long " * 30_000)]
    got = {x["doc_id"]: x for x in simhash.simhash_classes(documents(rows)).collect()}
    rows.sort()
    fps = [fingerprint(t) for _, t in rows]
    assert [got[d]["fp"] % (1 << 64) for d, _ in rows] == fps
    assert [got[d]["component_id"] for d, _ in rows] == [rows[c][0] for c in classes(fps)]


@pytest.mark.parametrize("chunk", [20_000, 40])
def test_dense_groups(spark, chunk):
    r = np.random.default_rng(2)
    centres = r.integers(0, 1 << 63, 30).astype(np.uint64)
    fps = set(r.integers(0, 1 << 63, 500).tolist())
    for c in centres:
        for _ in range(20):
            bits = r.integers(0, 64, r.integers(1, 7))
            fps.add(int(np.bitwise_xor.reduce(np.append(c, np.uint64(1) << bits.astype(np.uint64)))))
    fps = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    links = simhash.hamming_links(spark.createDataFrame([(x,) for x in fps], "fp long"), len(fps), chunk=chunk)
    got = dict(connected_components(links).collect())
    want = classes([x % (1 << 64) for x in fps])
    assert {x: got.get(x, x) for x in fps} == {x: fps[c] for x, c in zip(fps, want)}


def test_trie_links_are_exact():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, 40).astype(np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)]))
    a, b = simhash.trie_links(fp, np.array([0]), np.array([len(fp)]), 4, step=16)
    c = np.arange(len(fp))
    c[a] = b
    assert (c == classes(fp.tolist())).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (9, 7), (5, 5), (200, 139)] + [(500, 500 + i) for i in range(1, 300)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got[140] == got[200] == 100 and got[9] == 3 and got[799] == 500 and 5 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_leave_one(documents):
    a, b = (" ".join(f"{x}{i * i % 997}" for i in range(900)) for x in "ab")
    docs = documents([(3, a), (1, a), (2, b), (2, b), (9, a + " end"), (None, None), (4, "")])
    kept = simhash.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]
    assert simhash.drop_near_copies(documents([])).count() == 0
    assert simhash.simhash_classes(documents([(None, "x")])).first()["component_id"] is None


def test_classes_without_an_id_of_their_own_stay(documents):
    a, b, c, d, e, f = (" ".join(f"{x}{i * i % 997}" for i in range(900)) for x in "abcdef")
    docs = documents([(None, a), (None, b), (None, b), (None, b + " end"), (None, c), (5, c), (7, d), (7, e), (7, e), (8, e + " end"), (9, f)])
    kept = [(r["doc_id"], r["text"]) for r in simhash.drop_near_copies(docs).collect()]
    assert len(kept) == 6
    assert {(i, t[0]) for i, t in kept} == {(None, "a"), (None, "b"), (5, "c"), (7, "d"), (7, "e"), (9, "f")}


def test_blocks_cover_the_budget():
    for b in (5, 6, 7, 8):
        masks = simhash._block_masks(b, 4)
        for bits in ([0, 20, 40, 63], [1, 2, 3, 4], [0, 16, 32, 48]):
            diff = sum(1 << x for x in bits)
            assert any(m % (1 << 64) & diff == 0 for m in masks)
