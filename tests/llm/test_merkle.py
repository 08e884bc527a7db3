"""op12: hash trees and proofs against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from statelace.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row, text=...):
    values = [row[0], row[2], row[3], row[4], row[1] if text is ... else text]
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(hashes):
    levels = [hashes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        yield i % 16, run
        i //= 16


def brute(rows):
    """(doc_id, leaf, subroot, root, proof) of every row (doc_id, text, source, lang, n_chars), sorted."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is None, r[0] or 0, leaf(r), r[0]))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    out = []
    for n, s in enumerate(sources):
        for i, x in enumerate(sorted(by[s])):
            steps = [*path(trees[s], i), *path(top, n)]
            proof = sha("".join(h for at, run in steps for h in run[:at] + run[at + 1 :]))
            out.append((str(x[3]), x[2], trees[s][-1][0], top[-1][0], proof))
    return sorted(out)


def got(spark, rows):
    schema = "doc_id long, text string, source string, lang string, n_chars long, g string, k string, h string, m string, key string, total string"
    docs = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], schema)
    made = merkle.manifest(docs)
    made = made.withColumn("proof", F.sha2(F.array_join(merkle.siblings(F.col("steps")), ""), 256)).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps")))
    found = made.collect()
    assert all(x["folded"] == x["root"] for x in found)
    return sorted((str(x["doc_id"]), x["leaf"], x["subroot"], x["root"], x["proof"]) for x in found)


CASES = {
    "lone": [(5, "a", "s", "en", 1)],
    "sizes": [(i * 7 - 900, f"text {i}", f"s{n}", "en", i) for n in (1, 2, 15, 16, 17, 256, 257, 300) for i in range(n)],
    "nulls": [(None, None, None, None, None), (None, "", None, "", 0), (None, "a", "", "en", 1), (1, None, "null", "-", None), (2, "é\U0001f600", None, "en", 2)],
    "repeats": [(3, "same", "s", "en", 4)] * 40 + [(4, "same", "s", "en", 4), (-(1 << 63), "x", "s", "en", 1), ((1 << 63) - 1, "y" * 200_000, "s", "en", 1), (3, "other", "s", "en", 5)],
    "sources": [(i, "t", f"{'é' * (i % 3)}{i:x}", "en", 1) for i in range(300)],
}


@pytest.mark.parametrize("case", CASES)
def test_trees(spark, case):
    assert got(spark, CASES[case]) == brute(CASES[case])


def test_small_blocks_and_buckets_give_the_same(spark, monkeypatch):
    r = random.Random(3)
    rows = [(r.choice([i, r.getrandbits(62), 1 << 40, None]), f"t{i % 50}", r.choice(["a", "a", "a", "b", None]), "en", 1) for i in range(700)] + [(9, "same", "a", "en", 1)] * 60
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    monkeypatch.setattr(merkle, "BROADCAST", 2)
    monkeypatch.setattr(merkle.radix_ranks, "__defaults__", (8,))
    assert got(spark, rows) == brute(rows)


def test_tampering_shows(spark):
    sf = "/root/testdata/sf0.001"
    docs = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for x in merkle.op12_merkle(spark, sf).collect():
        text = docs[x["doc_id"]] or ""
        touched = zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in text)
        assert x["verified"] == (not touched) == (x["folded_root"] == x["root"])


def test_empty(spark):
    assert got(spark, []) == []
