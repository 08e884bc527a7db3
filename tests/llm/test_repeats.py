"""op1 and op10 against brute force."""

import hashlib
import random

import numpy as np
import pytest

from statelace.llm import substring, suffix
from statelace.llm.superkmer import PACKED, Bytes, Words, _by_key, _compared, _frequent, batch, covered, gram_hashes, identified, sliding_argmin


def brute(docs, k):
    """doc -> (symbols, removed flags); docs are in order."""
    seen, out = set(), []
    for name, s in docs:
        gone = [False] * len(s)
        for i in range(len(s) - k + 1):
            w = tuple(s[i : i + k])
            if w in seen:
                gone[i : i + k] = [True] * k
            seen.add(w)
        out.append((name, s, gone))
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def corpus():
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, other = say(60), say(25)
    rows = []
    for i in range(60):
        t = say(r.randrange(0, 120))
        if i % 3 == 0:
            t = t[:10] + passage[i % 7 : 50 + i % 9] + t[10:]
        if i % 5 == 0:
            t = t + other + ["x"] * (i % 40) + other[::-1] + other
        rows.append((1000 - i if i % 2 else i, " ".join(t) if i % 4 else "\t".join(t) + "\n"))
    rows += [(i + 2000, rows[i][1]) for i in range(0, 20)]
    rows += [(5000, "é ü " + "ab " * 300), (5001, "a" * 700), (5002, "a" * 99), (5003, ""), (5004, None), (5005, "é" * 60 + "b" + "é" * 60), (None, rows[3][1])]
    return rows


ordered = lambda rows: sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0))


@pytest.mark.parametrize("frequent", [50_000, 3])
def test_words_against_brute_force(documents, frequent):
    rows = corpus()
    got = {r["doc_id"]: r for r in substring.remove_repeated_words(documents(rows), frequent=frequent).collect()}
    assert len(got) == len(rows)
    for name, words, gone in brute([(d, (t or "").encode().split()) for d, t in ordered(rows)], 20):
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        assert (got[name]["n_words"], got[name]["n_removed"], got[name]["kept_sha256"]) == (len(words), sum(gone), sha(kept)), name


@pytest.mark.parametrize("frequent", [50_000, 3])
def test_bytes_against_brute_force(documents, frequent):
    rows = corpus()
    got = {r["doc_id"]: r for r in suffix.remove_repeated_bytes(documents(rows), frequent=frequent).collect()}
    assert len(got) == len(rows)
    for name, data, gone in brute([(d, (t or "").encode()) for d, t in ordered(rows)], 100):
        kept = bytes(b for b, g in zip(data, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        assert (got[name]["n_bytes"], got[name]["n_removed"], got[name]["n_spans"], got[name]["kept_sha256"]) == (len(data), sum(gone), runs, sha(kept)), name


def test_frequent_keys_are_found(documents):
    rows = [(i, " ".join([f"{w}.{i}" for w in range(30)] + list("abcdefghijklmno") + [f"{w}:{i}" for w in range(30)])) for i in range(200)]
    assert _frequent(identified(documents(rows)), Words(), 20, 4, 10)


def test_repeated_rows_are_one_document(documents):
    t = " ".join(f"w{i}" for i in range(40))
    got = substring.remove_repeated_words(documents([(1, t), (1, t), (2, t), (2, "other text")])).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(1, 40, 0), (1, 40, 0), (2, 2, 0), (2, 40, 40)]
    got = suffix.remove_repeated_bytes(documents([(1, t), (1, t)])).collect()
    assert [r["n_removed"] for r in got] == [0, 0]


def test_empty_table(documents):
    assert substring.remove_repeated_words(documents([])).count() == 0
    assert suffix.remove_repeated_bytes(documents([])).count() == 0


def test_pieces():
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 63, 200).astype(np.uint64)
    for m in (1, 2, 3, 4, 7, 8, 20):
        h = gram_hashes(np.concatenate([x, x]), m)
        assert len(h) == 400 - m + 1 and (h[: 200 - m] == h[200 : 400 - m]).all() and len(set(h[:200].tolist())) == 200
    v = r.integers(0, 9, 100).astype(np.uint64) << np.uint64(30)
    for w in (1, 2, 5, 16, 17):
        assert sliding_argmin(v, w).tolist() == [i + int(np.argmin(v[i : i + w])) for i in range(100 - w + 1)]
    lo, hi = covered(np.array([5, 0, 30]), np.array([2, 3, 1]), 10)
    assert lo.tolist() == [0, 30] and hi.tolist() == [16, 40]


def test_parts_of_long_texts_hold_each_window_once():
    r = random.Random(3)
    for n in (0, 1, 5, 19, 20, 21, 400):
        text = " ".join(f"w{r.randrange(50)}" * r.randrange(1, 4) for _ in range(n)).encode()
        words, k = text.split(), 20
        for size in (1, 7, 100, 10_000):
            got = sorted((at + i, part.split()[i : i + k]) for at, part in Words().slices(text, k, size) for i in range(len(part.split()) - k + 1))
            assert got == [(i, words[i : i + k]) for i in range(len(words) - k + 1)]
            got = sorted((at + i, part[i : i + k]) for at, part in Bytes().slices(text, k, size) for i in range(len(part) - k + 1))
            assert got == [(i, text[i : i + k]) for i in range(len(text) - k + 1)]


def test_a_text_of_several_parts(documents):
    r = random.Random(9)
    text = " ".join(r.choices([f"w{i:05}" for i in range(60_000)], k=700_000))  # beyond 3 MB
    text += text[2_000_000:2_400_000] + " and then"
    rows = [(1, text), (2, text[100_000:3_500_000]), (3, text[:150]), (4, "short")]
    sets = {}
    for name, of, k in (("bytes", suffix.remove_repeated_bytes, 100), ("words", substring.remove_repeated_words, 20)):
        sets[name] = {x["doc_id"]: x for x in of(documents(rows)).collect()}
        seen = set()
        for d, t in rows:
            s = t.encode() if name == "bytes" else t.encode().split()
            gone = np.zeros(len(s) + 1, np.int64)
            for i in range(len(s) - k + 1):
                h = hash(s[i : i + k] if name == "bytes" else tuple(s[i : i + k]))
                if h in seen:
                    gone[i] += 1
                    gone[i + k] -= 1
                seen.add(h)
            assert sets[name][d]["n_removed"] == (np.cumsum(gone[:-1]) > 0).sum(), (name, d)


def test_packed_strings_against_comparison():
    """Keys over several batches, keys beyond the bound, equal rows; symbols are words."""
    r = random.Random(4)
    rows = []
    for key in range(60):
        for _ in range(r.choice([1, 1, 2, 5, 30])):
            n = r.randrange(1, 6)
            rows.append((key, r.randrange(8), 0, r.randrange(4), n, " ".join(r.choice("ab") for _ in range(n + 2)).encode()))
    rows = [x for i, x in enumerate(rows) if x[:4] not in {y[:4] for y in rows[:i]}]
    rows += rows[:3]
    rows.sort(key=lambda x: x[0])
    for size in (1, 3, 7, 1000):
        batches = [batch(PACKED, *zip(*rows[i : i + size])) for i in range(0, len(rows), size)]
        got, over = set(), []
        for b in _by_key(iter(batches), Words(), 3, 20):
            for x in b.to_pylist():
                if x["packed"] is None:
                    got |= {(x["doc"], x["rid"], x["start"] + j) for j in range(x["n"])}
                else:
                    over.append(x["key"])
        count = [sum(x[0] == k for x in rows) for k in range(60)]
        many = {k for k in range(60) if count[k] > 20}
        assert set(over) == many and len(over) == sum(x[0] in many for x in rows)
        assert got == {x[:3] for x in _compared([x for x in rows if 1 < count[x[0]] <= 20], Words(), 3)}
