"""corpus_pipeline, stage by stage, against plain Python."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from statelace.llm import packing, pii, toxicity
from statelace.llm.common import n_words

from test_native import targets
from test_simhash import classes, fingerprint
from test_texts import token_ids

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture
def sf_dir(spark, documents, tmp_path):
    """Documents with toxic ones, near copies, personal data, nulls in every column, repeated rows and clashing columns."""
    r = random.Random(21)
    vocabulary = [f"{a}{b}" for a in "river house stone bread town water market road tree window".split() for b in ("", "s", "er", "ing", "y")]
    rows, labels = [], []
    for i in range(240):
        words = [r.choice(vocabulary) for _ in range(r.randrange(30, 120))]
        toxic = i % 6 == 0
        if toxic:
            for w in r.sample(["idiot", "moron", "scum", "loser"], 3):
                words.insert(r.randrange(len(words)), w)
        if i % 4 == 1:
            words.insert(r.randrange(len(words)), f"user{i}@mail.example.com")
        if i % 8 == 3:
            words.insert(r.randrange(len(words)), f"10.0.{i}.7")
        rows.append((i, " ".join(words), f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    for i in range(1, 60, 6):
        rows.append((1000 + i, rows[i][1], "s1"))
        rows.append((2000 + i, rows[i][1] + " end", None))
    rows += [(3000, None, "s0"), (3001, "", None), (None, "a text without a number of its own " * 9, "s2"), (None, "and another text that has none " * 9, "s2"), (5, rows[5][1], "s2"), (5, rows[5][1], "s2"), (3002, "word " * 40_000, "s1")]
    documents(rows).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def kept(spark, df, path):
    df.write.parquet(path)
    return spark.read.parquet(path)


def bag(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=repr)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns

    clean = kept(spark, STAGES["toxicity"](spark, docs, sf_dir), f"{sf_dir}/0")
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    of = model.scorer()
    assert clean.columns == columns
    assert bag(clean) == sorted((x for x in bag(docs) if of(x[1] or "") < toxicity.THRESHOLD), key=repr)
    gone = {x[0] for x in bag(docs)} - {x[0] for x in bag(clean)}
    assert {i for i in range(240) if i % 6 == 0} <= gone and len(gone) <= 45

    single = kept(spark, STAGES["simhash_near_dedup"](spark, clean, sf_dir), f"{sf_dir}/1")
    assert single.columns == columns
    rows = sorted(bag(clean), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
    found = classes([fingerprint(t) for _, t, _ in rows])
    left = bag(single)
    assert len(left) == len(set(found.tolist()))
    assert sorted((x[0] for x in left), key=repr) == sorted((rows[c][0] for c in set(found.tolist())), key=repr)
    assert len({x[1] for x in left}) == len(left) and all(x in rows for x in left)

    redacted = kept(spark, STAGES["pii"](spark, single, sf_dir), f"{sf_dir}/2")
    assert redacted.columns == columns

    def plain(t):
        for start, end, kind in reversed(pii.base_spans(t or "")):
            t = t[:start] + f"[{kind.upper()}]" + t[end:]
        return t

    assert bag(redacted) == sorted(((d, plain(t), s) for d, t, s in left), key=repr)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in redacted.collect())

    mixed = kept(spark, STAGES["mixing"](spark, redacted, sf_dir), f"{sf_dir}/3")
    assert mixed.columns == columns
    before, after = bag(redacted), bag(mixed)
    sizes, taken = {}, {}
    for x in before:
        sizes[x[2]] = sizes.get(x[2], 0) + len((x[1] or "").split())
    for x in after:
        taken[x[2]] = taken.get(x[2], 0) + len((x[1] or "").split())
    most = max(len((x[1] or "").split()) for x in before if x[2] != "s1")
    for s, want in targets(sizes).items():
        assert abs(taken.get(s, 0) - want) <= (40_000 if s == "s1" else most), s
    assert all(x in before for x in after) and max(after.count(x) / before.count(x) for x in before) <= 3

    packed = kept(spark, STAGES["packing"](spark, mixed, sf_dir), f"{sf_dir}/4").toPandas()
    want = sorted(zlib.crc32(np.array([*token_ids(x[1] or ""), packing.END], "<u4").tobytes()) for x in after if len(token_ids(x[1] or "")) < 200)
    whole = packed[(packed.start == 0) & (packed.length == packed.doc_tokens) & (packed.doc_tokens <= 200)]
    assert set(whole.ids_crc32) <= set(want)
    assert packed.length.sum() == sum(len(token_ids(x[1] or "")) + 1 for x in after)
    for _, s in packed.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= packing.LENGTH


def test_run_applies_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns[:3] == ["doc_id", "start", "length"] and got.count() > 100
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} <= {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_empty_tables(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_words_are_counted_alike(spark):
    texts = ["a b", " a\t\nb\x0bc ", "", None, "é x y", " z"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(n_words("text").alias("n")).collect()
    assert [r["n"] for r in got] == [len((t or "").encode().split()) for t in texts]
