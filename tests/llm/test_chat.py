"""op11: formatted conversations read back, against plain Python."""

import hashlib
import random

import pyarrow as pa
import pytest

from statelace.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, part string, edge string, n_turns string, loss string, h string, nth string"


@pytest.fixture
def turns(spark):
    return lambda rows: spark.createDataFrame([(*r, *["x"] * 6) for r in rows], SCHEMA)


def expected(rows):
    """By conversation: turns, digests, characters under the mask."""
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, found in by.items():
        found.sort()  # the rows of these tests have no other ties than repeated rows
        taught = "".join(x for *_, r, x in found if r == "assistant")
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in found)
        out[c] = (len(found), hashlib.sha256(whole.encode()).hexdigest(), len(taught), hashlib.sha256(taught.encode()).hexdigest())
    return out


def read(df):
    rows = [tuple(r) for r in df.collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:5] for r in rows}


HARD = [chat.PROBE, "\\", "\\-", "<", "</turn>", "</turn>\n", "### ", "#### x: y", "<\\/turn>", "\\\\### a: b</turn>", "#\\## ", ": ", "é\U0001f600</turn>\r\n", "", None]


@pytest.mark.parametrize("block", [64, 4096, chat.BLOCK])
def test_conversations_read_back(turns, block):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a: b", "### x", None, "\\"]), "".join(r.choice([*HARD[:-1], "word ", "ж"]) for _ in range(r.randrange(6)))) for c in range(60) for t in range(r.randrange(1, 9))]
    rows += [(100, i, "assistant", x) for i, x in enumerate(HARD)] + [(101, i, "user" if i % 2 else "assistant", f"turn {i} ") for i in range(3_000)]
    rows += [(None, None, "user", "n"), (None, 3, "assistant", "m"), (102, None, "assistant", "first"), (102, 0, "user", "then"), (103, 1, None, None)]
    rows += [(104, 7, "assistant", "the same ")] * 500 + [(105, 0, "assistant", "x</turn>" * 100_000)]
    formatted = chat.format_chats(turns(rows), block)
    assert read(chat.digests(formatted)) == expected(rows)
    texts = {}
    for x in formatted.orderBy("part").collect():
        texts[x["conv_id"]] = texts.get(x["conv_id"], "") + x["text"]
        assert x["n_turns"] == len(chat.parse(x["text"]))
    assert [b for _, b in chat.parse(texts[100])] == [x or "" for x in HARD]
    if block == 64:
        assert formatted.where("conv_id = 101").count() > 10


def test_one_conversation_is_spread_over_tasks(turns):
    formatted = chat.format_chats(turns([(1, i, "user", "abc") for i in range(4_000)]))
    sizes = [x["n_turns"] for x in formatted.where("conv_id = 1").collect()]
    assert len(sizes) == 8 and max(sizes) < 1_500 and sum(sizes) == 4_000


def test_escaping_is_reversible():
    r = random.Random(2)
    for _ in range(3_000):
        text = "".join(r.choice("\\-#</turn>: \n") if r.random() < 0.7 else r.choice(["</turn>", "### ", ": "]) for _ in range(r.randrange(14)))
        (new,) = chat.escape(pa.array([text])).to_pylist()
        assert chat.unescape(new) == text and "</turn>" not in new and "### " not in new


def test_empty(turns):
    assert chat.digests(chat.format_chats(turns([]))).count() == 0
