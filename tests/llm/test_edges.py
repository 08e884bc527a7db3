"""What every corpus operator does with nulls in any column, empty and very long texts and tokens, repeated rows and clashing columns."""

import hashlib
import math
import random
import time

import numpy as np
import pytest

from statelace.llm import fingerprint, html, mixing, packing, pii, simhash, substring, suffix, toxicity

LONG = 1_500_000


@pytest.fixture(scope="module")
def texts():
    r = random.Random(31)
    words = [f"{a}{b}" for a in "river house stone bread town water".split() for b in ("", "s", "er", "ing")]
    prose = " ".join(r.choices(words, k=LONG // 7))
    return {
        "prose": prose,
        "token": "ab1" * 100_000,
        "dashes": "x" + "-" * 300_000 + "y",
        "lines": "=====\n" * 50_000,
        "digits": "1 " * 150_000,
        "blank": " \t\n" * 1_000,
        "same": "the same words stand in this text and in no other text of the table " * 3,
    }


@pytest.fixture
def rows(texts):
    t = texts
    return [
        (None, None, None), (1, None, "s"), (2, "", "s"), (3, t["blank"], None), (4, t["prose"], "s"), (5, t["token"], "s"), (6, t["dashes"], "t"),
        (7, t["lines"], "t"), (8, t["digits"], "t"), (9, t["same"], "t"), (9, t["same"], "t"), (10, t["same"], None), (None, t["same"], None),
    ]


def test_repeats(documents, rows):
    got = substring.remove_repeated_words(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append(x)
    n = len(rows[9][1].split())
    assert all(x["n_removed"] == n for x in by[9] + by[10])  # the null id comes first, so its row keeps the text
    assert sorted(x["n_removed"] for x in by[None])[0] == 0 and by[1][0]["n_words"] == by[2][0]["n_words"] == by[3][0]["n_words"] == 0
    assert by[2][0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[7][0]["n_words"] == 50_000 and by[7][0]["n_removed"] == 49_999  # all but the first word stand in windows that came before
    got = {x["doc_id"]: x for x in suffix.remove_repeated_bytes(documents(rows)).collect() if x["doc_id"]}
    assert got[5]["n_bytes"] == 300_000 and got[5]["n_removed"] == 300_000 - 3 and got[6]["n_removed"] == 300_002 - 1 - 1 - 1
    assert got[9]["n_removed"] == len(rows[9][1]) and got[1]["n_bytes"] == 0


def test_simhash(documents, rows):
    got = simhash.simhash_classes(documents(rows)).collect()
    assert len(got) == len(rows)
    assert {x["fp"] for x in got if x["doc_id"] in (1, 2, 3)} == {0}
    assert {x["component_id"] for x in got if x["doc_id"] in (9, 10)} == {9}
    kept = simhash.drop_near_copies(documents(rows))
    assert kept.columns == documents(rows).columns
    ids = [x["doc_id"] for x in kept.collect()]
    assert ids.count(9) == 1 and 10 not in ids and ids.count(None) == 0 and ids.count(1) == 1 and not {2, 3} & set(ids)


def test_toxicity(spark, documents, rows):
    labels = spark.createDataFrame([(None, None, None), (1, None, 1), (2, 0, None), (4, 0, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    began = time.perf_counter()
    model = toxicity.fit(documents(rows), labels)
    got = toxicity.score(documents(rows), model).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got) and time.perf_counter() - began < 120
    assert len({x["score"] for x in got if x["doc_id"] in (1, 2, 3)}) == 1
    assert toxicity.drop_toxic(documents(rows), model).columns == documents(rows).columns
    assert toxicity.restore(documents(rows), model).where("doc_id in (1, 2, 3)").where("restored = ''").count() == 3


def test_personal_data(documents, rows):
    more = [*rows, (11, "u@a.bc " * 30_000, "s"), (12, "4111 1111 1111 1111 " + "7" * 200_000, "s")]
    got = pii.find(documents(more)).collect()
    assert len(got) == len(more)
    by = {x["doc_id"]: x for x in got}
    assert by[11]["n_email"] == 30_000 and by[12]["n_card"] == 0 and by[2]["spans"] == ""
    assert pii.redact(documents(more)).where("text is null").count() == 2


def test_packing(documents, rows):
    got = packing.pack(documents(rows)).toPandas()
    assert got[got.doc_id == 1].length.tolist() == [1] and got[got.doc_id == 9].shape[0] >= 2
    assert (got.groupby("sequence_id").length.sum() <= packing.LENGTH).all()


def test_native(documents, rows):
    got = fingerprint.fingerprint_pairs(documents(rows)).collect()
    assert len(got) == len(rows) and len({x["fingerprint"] for x in got if x["doc_id"] in (1, 2, 3)}) == 1
    clash = documents(rows).selectExpr("*", "source as canon", "source as part")
    named = fingerprint.fingerprints(clash)
    assert named.columns == [*clash.columns, "fingerprint"] and named.count() == len(rows)
    mixed = mixing.mixture(documents(rows)).collect()
    assert len(mixed) == len(rows) and all(x["taken"] <= 3 * x["size"] for x in mixed)
    assert {x["size"] for x in mixed if x["doc_id"] in (1, 2, 3)} == {0}


def test_pages(spark, texts):
    rows = [(1, None, "<p>" * 100_000), (2, "u", "<div>" * 100_000 + texts["prose"]), (3, "u", "<p>a b</p>" * 100_000), (4, "u", '<a href="x>' * 50_000), (None, None, None)]
    began = time.perf_counter()
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows) and time.perf_counter() - began < 60
    assert {x["page_id"]: x["n_chars"] for x in got}[2] == len(texts["prose"])


BODY = "This is the story of a man who went to the sea and it was good for him that he had not been alone on the way. "


def test_pages_that_name_their_layout():
    """A wrapper named after the parts it has is the page; unclosed controls end with their block; other scripts go by length."""
    for name in ("page has-sidebar", "layout-sidebar-right", "with-nav content"):
        page = f'<div class="{name}"><p>{BODY * 3}</p><div class="sidebar"><p>{BODY}</p></div></div><div class="nav"><p>{BODY}</p></div>'
        assert html.main_text(page) == (BODY * 3).strip(), name
    page = f"<article><p>{BODY}</p><button>Send<p>{BODY}</p><svg><text>x</text><p>{BODY}</p></article>"
    assert html.main_text(page) == "\n\n".join([BODY.strip()] * 3)
    assert html.main_text(f'<form action="/x"><p>{BODY * 3}</p><p>{BODY * 2}</p></form>') == f"{(BODY * 3).strip()}\n\n{(BODY * 2).strip()}"
    assert html.main_text(f'<p>{BODY}</p><section class="comments"><p>{BODY * 9}</p></section>') == BODY.strip()
    other = "Это длинный рассказ о человеке который ушёл к морю и долго думал о доме и о друзьях которых оставил. "
    page = f'<div><a href="a">Начало</a> <a href="b">Новости</a></div><h2>Рассказ</h2><p>{other * 3}</p><p>Конец.</p><p>{other * 3}</p><footer>сайт</footer>'
    assert html.main_text(page) == "\n\n".join(["Рассказ", (other * 3).strip(), "Конец.", (other * 3).strip()])


@pytest.mark.parametrize("name", ["hidden-gems", "share-price-story", "promo", "press-release related", "newsletter-archive", "login-guide", "post comments-open", "single comments-open", "search-results", "post reply", "nav"])
def test_a_name_alone_loses_no_article(name):
    page = f'<body><nav><a href="/">Home</a> <a href="/a">News</a></nav>%s<footer>All rights reserved by the owner of this site</footer></body>'
    story = "".join(f"<p>{BODY}</p>" for _ in range(5))
    text = "\n\n".join(["The title", *[BODY.strip()] * 5])
    assert html.main_text(page % f'<div class="{name}"><h1>The title</h1>{story}</div>') == text
    assert html.main_text(page % f'<main><div class="{name}"><h1>The title</h1>{story}</div></main>') == text
    both = f'<div class="story"><h1>The title</h1>{story}</div><div class="comments-list comments"><p>{BODY * 20}</p></div>'
    assert html.main_text(page % both) == text


def test_open_character_data_end_at_the_tag():
    assert html.main_text(f"<article><p>{BODY}<![CDATA[ x</p><p>{BODY}</p></article>") == "\n\n".join([BODY.strip()] * 2)


def test_long_blanks_are_packed(documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(i, f"a{c * 1_000_000}b") for i, c in enumerate([" ", "\n", " \t\r\n"[:2], "-", "x", "1", "é"])]
    got = packing.pack(documents(rows)).groupBy("doc_id").max("doc_tokens").collect()
    assert {x[0]: x[1] for x in got} == {i: len(whole.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}


def test_long_numbers_in_addresses(documents):
    (got,) = pii.find(documents([(1, "a " + "0" * 5_000 + "1.1.1.1 b and " + "9" * 5_000 + ".1.1.1")])).collect()
    assert got["n_ip"] == 1 and f"ip:2:{5_000 + 9}" in got["spans"]


def test_long_names_in_addresses():
    name, host = "n" * 300, ".".join(["part"] * 9)
    for text in (f"{name} [at] {host}", f"{name}(at){host.replace('.', '(dot)')}"):
        assert (2, 2 + len(text), "email") in pii.candidates(f"a {text} b")


@pytest.mark.parametrize("kind", ["string", "double", "boolean", "date"])
def test_labels_of_any_type(spark, kind):
    from pyspark.sql import functions as F

    from statelace.llm import embedding

    value = {"string": "'x y'", "double": "0.5", "boolean": "true", "date": "date'2020-01-01'"}[kind]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = embedding.near_vectors(v.withColumn("label", F.expr(value))).orderBy("vec_id").collect()
    assert [(x["n_links"], x["component_id"]) for x in got] == [(1, 1), (1, 1), (0, 3)]


def test_cosines_of_extreme_vectors(spark):
    from statelace.llm import embedding

    rows = []
    for n, scale in enumerate([1e-200, 1e200, 1.0]):
        for i, v in enumerate([[1.0, 0.0], [0.98, math.sqrt(1 - 0.98**2)], [0.9799, math.sqrt(1 - 0.9799**2)]]):
            rows.append((10 * n + i, [x * scale for x in v], n))
    got = {x["vec_id"]: x["n_links"] for x in embedding.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got[0] == got[10] == got[20] and got[2] == got[12] == got[22] == 1


def test_settling_changes_no_reading(monkeypatch):
    r = random.Random(8)
    reader = toxicity.Reader(np.random.default_rng(3).integers(0, 50, toxicity.ALPHABET**3))
    token = "".join(r.choice("abcdest0134578@$!|.-_ 1l") for _ in range(5_000))
    monkeypatch.setattr(toxicity, "SETTLE", 10**9)
    whole = reader.read(token)
    for step in (1, 64, 1_000):
        monkeypatch.setattr(toxicity, "SETTLE", step)
        assert reader.read(token) == whole
