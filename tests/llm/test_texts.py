"""op3, op4, op5 and op6."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from statelace.llm import html, packing, pii, toxicity


def token_ids(text, slow=Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))):
    return slow.encode(text, add_special_tokens=False).ids


def test_ids_equal_the_tokenizers():
    texts = ["", " ", "a", " lead", "trail ", "two  spaces", "tab\there now", "line\n\nbreak x", "it's we'll 12 a1!? é ü nb sp", "x<|endoftext|>y z", "日本 語 　wide sp", "a \x1c b", "end\n", "\n start", "many   three    four", "emoji \U0001f600 \U0001f600\U0001f600"]
    r = random.Random(1)
    texts += ["".join(r.choice("ab1.' \n\té ") for _ in range(60)) for _ in range(300)]
    encode = packing.tokens(packing.byte_bpe()).encode
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == token_ids(t), repr(t)


def test_ids_of_a_whole_table():
    encode = packing.tokens(packing.byte_bpe()).encode
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column("text").to_pylist()]
    for i in range(0, len(texts), 500):
        want = slow.encode_batch(texts[i : i + 500], add_special_tokens=False)
        assert all(np.frombuffer(encode(t), "<u4").tolist() == w.ids for t, w in zip(texts[i : i + 500], want))


def test_packing_round_trip(spark, documents):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(r.choice([0, 5, 300, 900, 5000])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "w " * 20_000), (503, "twice"), (None, "no id")]
    got = packing.pack(documents(rows).repartition(5), open_windows=4).toPandas()
    for d, t in rows:
        ids = np.array([*token_ids(t or ""), 1], "<u4").tobytes()
        p = got[got.doc_id.isna() if d is None else got.doc_id == d].sort_values("start")
        at = 0
        for x in p.itertuples():
            assert x.start == at and x.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + x.length)]) and x.doc_tokens == len(ids) // 4
            at += x.length
        assert at == len(ids) // 4
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.to_numpy() == np.cumsum(s.length) - s.length).all() and s.length.sum() <= 2048
    assert got.length.sum() / (got.sequence_id.nunique() * 2048) > 0.95
    assert packing.pack(documents([])).count() == 0
    twice = packing.pack(documents([(1, "same text"), (1, "same text")])).collect()
    assert len(twice) == 2 and len({(x["sequence_id"], x["offset"]) for x in twice}) == 2


def test_plain_personal_data():
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def keeps(kind, s):
        d = re.sub("[^0-9]", "", s)
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in s.split(".")), "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]

    r = random.Random(3)
    bits = ["a@b.c", "x.y+z@ex-a.co.uk.", "@", "a@b", "@b.c", "a@b.c@d.e", "a@@b.c", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111-1111 1111", "4111111111111112", "5500-0000-0000-0004", "+1 (555) 123-4567", "+12", "++49 30 1234567 ", "9", " ", "-", ".", "é", "\n", "z"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randrange(1, 9)))
        want = sorted((m.start(), pii.KINDS.index(k), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, t) if keeps(k, m[0]))
        assert pii.base_spans(t) == [(s, e, k) for s, _, e, k in want], t
    assert pii.base_spans("a" * 200_000 + "@") == [] and pii.base_spans("1" * 200_000) == []


def personal(n):
    r = random.Random(7)
    out = []
    for i in range(n):
        card = [int(c) for c in f"4{r.randrange(10**14):014d}"]
        card.append(next(c for c in range(10) if pii.luhn("".join(map(str, [*card, c])))))
        out.append((i, f"words and numbers {r.randrange(10**6)} then u{i}.x@mail{i % 5}.example.com and host {r.randrange(255)}.{r.randrange(255)}.7.{i % 250} on 2024-0{i % 9 + 1}-1{i % 9} pay {''.join(map(str, card))} or +1 ({r.randrange(200, 999)}) 555-{r.randrange(10**4):04d} at 12:30 v1.2.{i}"))
    return out


def test_disguised_personal_data(documents):
    rows = [*personal(300), (900, None), (901, ""), (902, "clean text with 12 and 2023-05-06 and 10-20-30 only"), (903, "reach joe.q (at) example (dot) com or u@x.io and (212) 555-0187 now"), (None, "a@b.co " * 5000)]
    docs = documents(rows)
    model = pii.fit(docs)
    got = {x["doc_id"]: x for x in pii.find(docs, model).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["n_email"] == got[i]["n_ip"] == got[i]["n_card"] == got[i]["n_phone"] == 1 for i in range(300))
    assert got[902]["spans"] == "" and got[900]["redacted"] is None and got[901]["redacted"] == ""
    assert got[903]["redacted"] == "reach [EMAIL] or [EMAIL] and [PHONE] now"
    assert got[None]["n_email"] == 5000
    redacted = pii.redact(docs, model)
    assert redacted.columns == docs.columns
    by = {x["doc_id"]: x for x in redacted.collect()}
    assert by[903]["text"] == got[903]["redacted"] and by[903]["n_chars"] == len(by[903]["text"]) and by[900]["text"] is None
    assert pii.find(documents([])).count() == 0 and pii.redact(documents([])).count() == 0


def test_rare_kinds_get_a_threshold(documents):
    cards = [(100_000 + i, t) for i, t in personal(60)]
    docs = documents([(i, f"u{i}.x@mail{i % 5}.example.com wrote at 12:{i % 50 + 10}") for i in range(30_000)] + cards)
    model = pii.fit(docs)
    assert all(x < 1 for x in model.thresholds.values())
    found = pii.find(documents([(1, "pay 4111.1111.1111.1111 or call"), (2, "and host 10[.]1[.]7[.]9 then")]), model)
    assert {x["doc_id"]: x["spans"].partition(":")[2] for x in found.collect()} == {1: "4:23", 2: "9:23"}


def unlike(r, kind, s):
    """Disguises that the operator's own variants don't have."""
    d = re.sub("[^0-9]", "", s)
    if kind == "email":
        user, host = s.split("@")
        return r.choice([f"{user}[@]{host}", f"{user} {{at}} {host.replace('.', ' {dot} ')}", f"{user} <at> {host.replace('.', '[.]')}"])
    if kind == "ip":
        return r.choice([s.replace(".", "(.)"), s.replace(".", " ."), s.replace(".", ". ")])
    if kind == "card":
        return r.choice(["_", " / ", ". "]).join(d[i : i + 4] for i in range(0, len(d), 4))
    return r.choice([f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}", f"({d[-10:-7]}) {d[-7:-4]} {d[-4:]}", f"00{d[:-10]}-{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}"])


def test_disguises_of_other_kinds_than_the_variants(documents):
    r = random.Random(17)
    rows, hidden = personal(300), {}
    model = pii.fit(documents(rows))
    for i, t in personal(200):
        start, end, kind = r.choice(pii.base_spans(t))
        form = unlike(r, kind, t[start:end])
        hidden[5_000 + i] = (kind, start, start + len(form), t[:start] + form + t[end:])
    clean = [(9_000 + i, f"in {1900 + i} the {r.randrange(1000)} of {i % 28 + 1}.{i % 12 + 1}.{1950 + i % 70} sold {r.randrange(1000)} {r.randrange(1000)} for {r.randrange(100)}.{r.randrange(100)} at {i % 24}:{i % 60:02} see v{i % 9}.{i % 7}.{i % 5} or www.site{i}.com") for i in range(200)]
    got = {x["doc_id"]: x for x in pii.find(documents([(d, x[3]) for d, x in hidden.items()] + clean), model).collect()}
    found = [d for d, (k, s, e, _) in hidden.items() if any(x.startswith(f"{k}:") and int(x.split(":")[1]) < e and int(x.split(":")[2]) > s for x in got[d]["spans"].split(","))]
    false = [d for d, _ in clean if got[d]["n_added"]]
    print(len(found), "of", len(hidden), "found,", len(false), "of", len(clean), "clean ones touched")
    assert len(found) >= 0.8 * len(hidden) and len(false) <= 2


def test_texts_that_can_be_read_are_no_negatives():
    text = "write joe.q (at) example (dot) com or 4111.1111.1111.1111 or 4111.1111.1111.1112"
    negative = {(t[s:e], k) for t, s, e, k, good in pii.examples(text, 0) if not good}
    assert negative == {("4111.1111.1111.1112", "card")}


def test_all_matches_of_a_document_are_examples():
    text = " then ".join(f"u{i}@mail.example.com" for i in range(30))
    disguised = {t[s:e] for t, s, e, _, good in pii.examples(text, 0) if good and "[at]" in t[s:e]}
    assert any("u29 [at]" in x for x in disguised)


@pytest.fixture
def judged(spark, documents):
    r = random.Random(11)
    clean = "the river and house were quiet when people came to town for market day with bread stones water trees".split()
    bad = ["idiot", "moron", "scum", "loser"]
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(clean) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            for w in r.sample(bad, 2):
                words.insert(r.randrange(30), w)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return rows, spark.createDataFrame([*labels, (None, 1, 1), (9999, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(documents, judged):
    rows, labels = judged
    more = [(1000, "you are an 1d10t in town"), (1001, "what a m o r o n came"), (1002, "such sssccuuummmm here"), (1003, "an i.d.i.o.t came"), (1004, "the quiet river"), (1005, None), (1006, ""), (1007, "the LOSER! came"), (None, "bread and stones"), (1004, "the quiet river"), (1008, "people came to town " * 20_000)]
    docs = documents(rows + more)
    model = toxicity.fit(docs, labels)
    got = [(x["doc_id"], x) for x in toxicity.score(docs, model).collect()]
    assert len(got) == len(rows) + len(more)
    by = dict(got)
    assert all(by[i]["predicted"] == int(i % 5 == 0) for i in range(600))
    assert all(by[i]["predicted"] == 1 for i in (1000, 1001, 1002, 1003, 1007)) and all(by[i]["predicted"] == 0 for i in (1004, 1005, 1006, 1008, None))
    assert all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(600))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 120 + len(more) - 5


def test_held_out_labels_teach_nothing(documents, judged):
    from pyspark.sql import functions as F

    rows, labels = judged
    docs = documents(rows)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a.odds == b.odds and np.allclose(a.weights, b.weights)


def test_toxicity_without_rows(documents, judged):
    rows, labels = judged
    empty = toxicity.fit(documents([]), labels.limit(0))
    assert toxicity.score(documents([]), empty).count() == 0
    assert toxicity.score(documents(rows[:3]), toxicity.fit(documents(rows[:3]), labels.limit(0))).where("score between 0 and 1").count() == 3


def test_lattice_reads_disguises():
    text = " ".join(["idiot people stupid moron the and quiet"] * 50)
    codes = toxicity._codes()[np.frombuffer(f" {text} ".encode(), np.uint8)]
    counts = np.bincount(codes[:-2] * 784 + codes[1:-1] * 28 + codes[2:], minlength=28**3)
    reader = toxicity.Reader(counts)
    read = reader.read
    restored = toxicity.Evidence(reader).restored
    assert restored("An iddiot is\n 5tup1d: t h e  m\to r o n, q u i e t!") == "an idiot is stupid the moron quiet"
    assert [read(w) for w in ("1d10t", "$tup1d", "m0r0nnn", "i.d.i.o.t", "idiiiiot", "p-e-o-p-l-e")] == ["idiot", "stupid", "moron", "idiot", "idiot", "people"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header class="top"><a href="/">Home</a></header><nav><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></nav>
<div class="cookie-notice">We use cookies and the site of it is for you and us to be good in all the ways we can.</div><div id=sidebar><p>Popular posts in the week</div>
<main><h1>Title &amp; more</h1><p>First   paragraph of the\n text<br>goes on with <b>bold</b>ness &eacute;&#8212;yes.<p>To.</p><ul><li>point a<li>point b</ul>
<form><label>Your name</label><input></form><p>Last one is here for the reader and it is long enough.</p><aside>Advert</aside>
<section class="comments"><p>I think that the article is very good and that you are right.</p></section></main>
<footer>&copy; site</footer></body></html>"""


def test_main_text():
    want = ["Title & more", "First paragraph of the text goes on with boldness é—yes.", "To.", "point a", "point b", "Last one is here for the reader and it is long enough."]
    assert html.main_text(PAGE) == "\n\n".join(want)
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>x</nav>") == html.main_text("<!-- open") == ""
    assert html.main_text("<article><p>cut off in the mid<p class='") == "cut off in the mid"


def test_pages_without_an_article():
    body = "This is the story of a man who went to the sea and it was good for him that he had not been alone on the way. " * 2
    page = f"<div><a href=a>Home</a> <a href=b>News</a></div><h2>The story</h2><p>{body}</p><p>Short end.</p><p>{body}</p><div><a href=c>Next page of the site</a></div>"
    assert html.main_text(page) == "\n\n".join(["The story", body.strip(), "Short end.", body.strip()])


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", "x"), (3, "w", "<article>" + "<p>word</p>" * 20_000, "x")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(x["n_chars"] == len(x["text"]) for x in got)
    assert max(x["n_chars"] for x in got) == 20_000 * 4 + 19_999 * 2
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
