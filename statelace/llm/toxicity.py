"""Toxicity of documents, read through disguises.

A noisy channel turns letters into look-alikes, repeats them and puts marks or spaces between them. A suspicious
token, or a run of single characters with white space between, opens a lattice of what its characters may stand for,
word breaks among them, and Viterbi decoding under a character trigram model of the whole corpus picks the likeliest
reading. Words and word beginnings of the text as written and as restored, that occur significantly more often in toxic
documents of the training rows, are the evidence; a logistic model of a document's evidence gives its score.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled documents that evidence and weights are learned from: those whose hashed ids come first.
TRAIN_ROWS = 8_000
THRESHOLD = 0.3

#: What a character may stand for besides itself. Common look-alikes.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
}
MARKS = ".-_*'~,:/"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
EDGE, OTHER, ALPHABET = 0, 27, 28
PREFIXES = (4, 5, 6)

#: Runs of characters after which a lattice gives out what all its paths begin with, so that it holds no long texts.
SETTLE = 64
#: Tokens up to this length are remembered with their evidence.
REMEMBERED = 48

SUSPICIOUS = re.compile(r"[0-9@$!|+€£(][^\W\d_]|[^\W\d_][0-9@$!|+€£(]|@[0-9$!]|([^\W\d_])\1|[^\W_][.\-_*'~,:/]+[^\W_]")
LETTER = re.compile("[a-z@]")
RUN = re.compile(r"(.)\1*", re.DOTALL)
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S[.,;:!?]?){2,}(?!\S)")


def _codes() -> np.ndarray:
    """Trigram symbol of each byte of lower-cased text: letters 1 to 26, white space the edge, others 27."""
    codes = np.full(256, OTHER, np.int32)
    codes[[9, 10, 11, 12, 13, 32]] = EDGE
    codes[[ord(c) for c in LETTERS]] = np.arange(1, 27)
    return codes


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts, an array of 28 ** 3; each task sends its sums alone."""
    codes = _codes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**3, np.int64)
        for b in batches:
            for t in b.column("text"):
                x = codes[np.frombuffer(b" " + (t.as_py() or "").encode().lower() + b" ", np.uint8)]
                for i in range(0, max(len(x) - 2, 0), 1 << 20):
                    y = x[i : i + (1 << 20) + 2]
                    total += np.bincount(y[:-2] * ALPHABET**2 + y[1:-1] * ALPHABET + y[2:], minlength=ALPHABET**3)
        at = np.flatnonzero(total)
        yield pa.record_batch({"gram": pa.array(at, pa.int32()), "n": pa.array(total[at])})

    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(ALPHABET**3)
    for r in sums.collect():  # 28 ** 3 rows at most
        counts[r["gram"]] = r["n"]
    return counts


class Reader:
    """Viterbi decoding of disguised tokens."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(ALPHABET, ALPHABET, ALPHABET)
        pair, one = c.sum(axis=0), c.sum(axis=(0, 1))
        uni = (one + 0.5) / (one.sum() + 0.5 * ALPHABET)
        bi = (pair + 4 * uni) / (pair.sum(axis=1, keepdims=True) + 4)
        tri = (c + 4 * bi[None]) / (c.sum(axis=2, keepdims=True) + 4)
        self.cost = (-np.log(tri)).ravel().tolist()  # by (first * ALPHABET + second) * ALPHABET + third
        self.symbol = {x: i + 1 for i, x in enumerate(LETTERS)}

    def lattice(self, token: str) -> Iterator[list[tuple[str, float]]]:
        """Per run of one character: the strings it may stand for, and their costs. A blank is a word break."""
        for m in RUN.finditer(token):
            c, n = m[1], m.end() - m.start()
            if "a" <= c <= "z":
                yield [(c, 0.0 if n == 1 else 0.7)] + ([(c + c, 0.0 if n == 2 else 0.7)] if n > 1 else [])
            elif c in LOOKS_LIKE:
                ways = [(x, 1.0) for x in LOOKS_LIKE[c]] + ([(x + x, 1.5) for x in LOOKS_LIKE[c]] if n > 1 else [])
                yield [*ways, ("", 4.0)]
            elif c == " ":
                yield [("", 0.0), (" ", 0.0)]
            elif c in MARKS:
                yield [("", 0.5), (" ", 0.5)]
            else:
                yield [(c, 1.0)]

    def read(self, token: str) -> str:
        """The likeliest reading of a lower-cased token; in spaced ones, blanks may be word breaks."""
        cost, get = self.cost, self.symbol.get
        size, square = ALPHABET, ALPHABET**2
        best: dict[int, tuple[float, str]] = {EDGE * size + EDGE: (0.0, "")}  # the last two symbols -> cost and reading
        done: list[str] = []
        for step, ways in enumerate(self.lattice(token), 1):
            new: dict[int, tuple[float, str]] = {}
            for state, (total, text) in best.items():
                for way, price in ways:
                    at, s = state, total + price
                    if way == " ":
                        s += cost[at * size + EDGE] if at % size != EDGE else math.inf
                        at = EDGE * size + EDGE
                    else:
                        for ch in way:
                            r = get(ch, OTHER)
                            at = at * size + r
                            s += cost[at]
                            at %= square
                    if at not in new or s < new[at][0]:
                        new[at] = (s, text + way)
            best = new
            if step % SETTLE == 0:
                texts = [text for _, text in best.values()]
                shared = len(os.path.commonprefix([min(texts), max(texts)]))
                done.append(texts[0][:shared])
                best = {at: (total, text[shared:]) for at, (total, text) in best.items()}
        return "".join([*done, min((s + cost[at * size + EDGE], text) for at, (s, text) in best.items())[1]])


def bare(token: str) -> str:
    """A token without the marks around it; @ and $ may begin a word."""
    if token.isalnum():
        return token
    lo, hi = 0, len(token)
    while lo < hi and not (token[lo].isalnum() or token[lo] in "_@$"):
        lo += 1
    while hi > lo and not (token[hi - 1].isalnum() or token[hi - 1] in "_$!"):
        hi -= 1
    end = hi
    while end > lo and token[end - 1] == "!":  # one that ends a sentence
        end -= 1
    return token[lo : end if token[lo:end].isalnum() else hi]


class Evidence(dict):
    """Token -> its features, remembered: the word, its beginnings, and those of its reading where it is suspicious."""

    MOST = 200_000

    def __init__(self, reader: Reader, known: dict[str, int] | None = None):
        super().__init__()
        self.reader, self.known = reader, known

    def reading(self, token: str) -> str:
        """A token as it is restored: itself without marks around it, or its likeliest reading."""
        word = bare(token)
        return self.reader.read(word) if SUSPICIOUS.search(word) and LETTER.search(word) else word

    def __missing__(self, token: str) -> tuple:
        word, known = bare(token), self.known
        forms = {word, *self.reader.read(word).split()} if SUSPICIOUS.search(word) and LETTER.search(word) else (word,)
        names = [f for w in forms if w for f in ("=" + w, *("^" + w[:n] for n in PREFIXES if len(w) > n))]
        out = tuple(set(names)) if known is None else tuple(known[f] for f in names if f in known)
        if len(token) <= REMEMBERED:
            if len(self) >= self.MOST:
                self.clear()
            self[token] = out
        return out

    def spaced(self, text: str, tokens: set[str]) -> list[re.Match]:
        """Runs of single characters with white space between them, half of them letters or more."""
        if sum(len(t) == 1 for t in tokens) < 3:
            return []
        runs = SPACED.finditer(text)
        return [m for m in runs if sum(c.isalpha() for c in m[0]) * 2 >= sum(not c.isspace() for c in m[0])]

    def joined(self, run: str) -> str:
        """The likeliest words of a run of single characters."""
        return self.reader.read(" ".join(run.rstrip(".,;:!?").split()))

    def of(self, text: str) -> set:
        """Features of a text as written and as restored."""
        text = text.lower()
        tokens = set(text.split())
        for m in self.spaced(text, tokens):
            tokens.update(self.joined(m[0]).split())
        found: set = set()
        for f in filter(None, map(self.__getitem__, tokens)):
            found.update(f)
        return found

    def restored(self, text: str) -> str:
        """The lower-cased text in its likeliest reading, words joined by one blank."""
        text = text.lower()
        out, at = [], 0
        for m in self.spaced(text, set(text.split())):
            out += map(self.reading, text[at : m.start()].split())
            out.append(self.joined(m[0]))
            at = m.end()
        out += map(self.reading, text[at:].split())
        return " ".join(filter(None, out))


@dataclass
class Model:
    """Evidence with its log odds, and the logistic weights of a document's evidence."""

    counts: np.ndarray
    odds: dict[str, float]
    weights: np.ndarray

    def scorer(self):
        """Text -> score; what it remembers of tokens is bounded."""
        known = {f: i for i, f in enumerate(self.odds)}
        odds, evidence = np.array(list(self.odds.values())), Evidence(Reader(self.counts), known)

        def score(text: str) -> float:
            z = float(_document(evidence.of(text), odds) @ self.weights)
            return 1 / (1 + math.exp(-max(min(z, 30.0), -30.0)))

        return score


def _document(found: set, odds: np.ndarray) -> np.ndarray:
    """What the logistic model sees: a constant, whether there is evidence, the strongest and the three strongest odds, how much."""
    x = np.sort(odds[list(found)])[::-1] if found else np.zeros(0)
    return np.array([1.0, float(len(x) > 0), x[:1].sum(), x[:3].sum() / 3, math.log1p(len(x))])


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def significant(toxic: float, clean: float, n_toxic: int, n_clean: int) -> float | None:
    """Log odds of a feature in toxic against clean documents, where chance hardly gives it (normal approximation of the binomial and at least four documents)."""
    p = n_toxic / (n_toxic + n_clean)
    n = toxic + clean
    odds = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    if toxic < 4 or odds < 1.5:
        return None
    share = min(toxic / n, 1 - 1e-12)
    surprise = n * (share * math.log(share / p) + (1 - share) * math.log(max(1 - share, 1e-12) / (1 - p)))
    return odds if surprise > 7.5 else None


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Character model over all documents; evidence over ``rows`` labelled documents that aren't held out, at most."""
    spark = docs.sparkSession
    counts = trigram_counts(docs)
    some = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select(F.col("doc_id").alias("_l"), F.col("toxic").cast("int").alias("toxic"))
    some = some.groupBy("_l").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("_l")).limit(rows)
    drawn = spark.createDataFrame([tuple(r) for r in some.collect()], "_l long, toxic int")  # at most ``rows`` ids
    train = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("_l"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(Reader(counts))
        sums: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist()):
                sums[toxic].update(evidence.of(text.as_py() or ""))
                sums[toxic][""] += 1  # documents
        for toxic in (0, 1):
            yield pa.record_batch({"feature": pa.array(list(sums[toxic]), pa.string()), "clean": pa.array([n * (1 - toxic) for n in sums[toxic].values()], pa.int64()), "toxic": pa.array([n * toxic for n in sums[toxic].values()], pa.int64())})

    seen = train.mapInArrow(features, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    number = seen.where("feature = ''").first()
    n_clean, n_toxic = (number["clean"], number["toxic"]) if number else (0, 0)
    odds: dict[str, float] = {}
    if n_clean and n_toxic:
        # features of ``rows`` documents at most, and of these the ones that toxic documents repeat
        for r in seen.where("toxic >= 4 and feature <> ''").where((F.col("toxic") + 0.5) * (n_clean + 1) > 4 * (F.col("clean") + 0.5) * (n_toxic + 1)).orderBy("feature").collect():
            if (o := significant(r["toxic"], r["clean"], n_toxic, n_clean)) is not None:
                odds[r["feature"]] = o
    known, values = {f: i for i, f in enumerate(odds)}, np.array(list(odds.values()))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(Reader(counts), known)
        for b in batches:
            x = [_document(evidence.of(t.as_py() or ""), values).tolist() for t in b.column("text")]
            yield pa.record_batch({"x": pa.array(x, pa.list_(pa.float64())), "y": b.column("toxic").cast(pa.float64())})

    got = train.mapInArrow(documents, "x array<double>, y double").collect()  # five numbers for each training row
    if odds:
        weights = logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got]))
    else:
        share = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
        weights = np.array([math.log(share / (1 - share)) if n_toxic + n_clean else -2.0, 0, 0, 0, 0])
    return Model(counts, odds, weights)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per row of ``docs``, repeated ones too; an empty table gives no rows.

    Null texts count as empty and get the score of a text without evidence; a null doc_id isn't held out. Time grows with
    a text's length, also in one long token. Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": pa.array([of(t.as_py() or "") for t in b.column("text")], pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return rows.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def restore(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, restored): the text that is scored beside the written one: lower-cased, disguises undone. Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Evidence(Reader(model.counts), {}).restored
        for b in batches:
            yield pa.record_batch({"doc_id": b.column("doc_id"), "restored": pa.array([of(t.as_py() or "") for t in b.column("text")], pa.string())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, restored string")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below the threshold, with all their columns. Null texts count as empty;
    repeated rows stay or go together; an empty table stays empty."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for b in batches:
            yield b.filter(pa.array([of(t.as_py() or "") < threshold for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
