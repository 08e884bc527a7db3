"""Personal data: plain patterns are always redacted; further candidates are chosen by boosted trees.

Generators with high recall propose spans, overlapping ones too. Trees score each from its format (digits, groups,
separators, checksums) and its context (the characters and words around it). They are fitted on a bounded sample of
documents, drawn for each kind from those with a plain match of it: plain matches and variants of them as people
disguise them are positive; candidates that can't be read as personal data, and broken variants, are negative. A candidate
that turns into a plain match once its disguise is undone is neither, as nobody has labelled it. All documents that the trees
haven't seen, a quarter of the texts at least, set each kind's threshold at the wanted precision. Texts stay in the executors:
the driver gets features of ``EXAMPLES`` examples of a kind at most.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import BoostedTrees
from .common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
#: Different texts that the trees are fitted on, in equal shares: for each kind those with a plain match of it, and
#: those with a candidate that is none; in each share those whose hashes come first.
SAMPLE = 2_000
#: Examples of a kind that the trees are fitted on at most, drawn evenly from all of the sample, so that no kind outweighs the others.
EXAMPLES = 2_000
PRECISION = 0.995
#: Scores from which a threshold is chosen, by steps of 0.01 in log odds; no threshold lies under the first.
LEVELS = 1 / (1 + np.exp(-0.01 * np.arange(2_001)))

# look-behinds only skip starts inside a run of digits, where a leftmost match can't begin
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Numbers are as long as their formats allow: three digits a part of an address, 19 digits a card, 15 a phone; names have any length.
AT = r"\s?(?:@|[\[({<]\s?(?:at|@)\s?[\])}>])\s?|\sat\s(?=[\w-]+\sdot\s)"
DOT = r"\.|\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s"
LOOSE = {
    "email": re.compile(rf"(?<![\w.+-])[\w.+-]++(?:{AT})[\w-]++(?:(?:{DOT})[\w-]++)+", re.ASCII),
    "ip": re.compile(r"(?<![\d.])\d{1,3}(?:(?:\s?[\[({]?\.[\])}]?\s?)\d{1,3}){3}(?![\d])", re.ASCII),
    "card": re.compile(r"(?<!\d)\d{4}(?:[ ._/-]{0,3}\d){9,15}(?!\d)", re.ASCII),
    "phone": re.compile(r"(?<![\w+.])(?:\+|00)?[ ]?\(?\d{1,4}\)?(?:[ ./-]{1,2}\(?\d{2,4}\)?){2,4}(?!\w)", re.ASCII),
}
HINTS = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
}
SEPARATORS = " ().-/_[]{}"


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of plain matches by start, then kind: leftmost, not overlapping within a kind."""
    out = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in IP.finditer(text):
        if all(len(x) <= 3 and int(x or 0) <= 255 for x in (p.lstrip("0") for p in m[0].split("."))):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    for m in PHONE.finditer(text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans that the generators propose. No phone number has over 15 digits."""
    kinds = []
    if "@" in text or re.search(r"[\[({<]\s?at\s?[\])}>]|\sdot\s", text):
        kinds.append("email")
    if re.search(r"[0-9][^A-Za-z]{0,3}[0-9]", text):
        kinds += ["ip", "card", "phone"]
    return [(*m.span(), k) for k in kinds for m in LOOSE[k].finditer(text) if k != "phone" or sum("0" <= c <= "9" for c in m[0]) <= 15]


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    s = text[start:end]
    digits = "".join(c for c in s if "0" <= c <= "9")
    groups = re.findall("[0-9]+", s)
    sizes = [len(g) for g in groups] or [0]
    before, after = text[start - 1 : start], text[end : end + 1]
    around = text[max(0, start - 40) : start].lower()
    marks = {c for c in s if c in SEPARATORS}
    letters = sum(c.isalpha() for c in s)
    return [
        *(float(kind == k) for k in KINDS),
        len(s), len(digits), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], letters,
        float("@" in s), float(bool(re.search(r"[\[({<]\s?at|\sat\s", s))), float(bool(re.search(r"dot|\[\.|\(\.", s))),
        float(s.startswith("+")), float(s.startswith("00")), float("(" in s), float(len(marks)),
        float(len(digits) > 1 and luhn(digits)), float(len(groups) == 4 and all(int(g) <= 255 for g in groups if len(g) < 9)),
        float(any(len(g) > 1 and g[0] == "0" for g in groups)),
        float(len(re.split(r"[^A-Za-z0-9]+", s)[-1])),
        float(before.isalnum()), float(after.isalnum()), float(before in ("", " ", "\n")), float(after in ("", " ", "\n", ".", ",")),
        float(before in ".-/=#:" and before != ""), float(any(h in around for h in HINTS[kind])),
    ]


def _variants(s: str, kind: str, turn: int) -> list[tuple[str, bool]]:
    """Disguised (true) and broken (false) forms of a plain match."""
    if kind == "email":
        user, _, host = s.partition("@")
        return [(f"{user} [at] {host}", True), (f"{user}(at){host.replace('.', '(dot)')}", True), (f"{user} at {host.replace('.', ' dot ')}", True)]
    if kind == "ip":
        parts = s.split(".")
        bad = [*parts[:3], str(300 + turn % 600)]
        return [("[.]".join(parts), True), (" . ".join(parts), True), ("[.]".join(bad), False), (" . ".join(bad), False)]
    digits = "".join(c for c in s if c.isdigit())
    if kind == "card":
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + turn % 9) % 10)
        cut = lambda d, sep: sep.join(d[i : i + 4] for i in range(0, len(d), 4))
        return [(cut(digits, "."), True), (cut(digits, "/"), True), (cut(wrong, "."), False), (cut(wrong, " "), False), (wrong, False)]
    last = digits[-10:]
    return [
        (f"({last[:3]}) {last[3:6]}-{last[6:]}", True),
        (f"{last[:3]}-{last[3:6]}-{last[6:]}", True),
        (f"00{digits[:-10] or '1'} {last[:3]} {last[3:6]} {last[6:]}", True),
        (f"{last[:4]}-{last[4:6]}-{last[6:8]}", False),  # a date
        (f"{last[:2]}.{last[2:4]}.{last[4:8]}", False),
        (f"{last[:3]} {last[3:5]} {last[5:8]}", False),
    ]


def _free(found: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[bool]:
    """Whether each span overlaps no plain one."""
    taken = sorted(base)
    ends = np.maximum.accumulate([b[1] for b in taken]) if taken else np.zeros(0, int)
    starts = np.array([b[0] for b in taken], int)
    i = np.searchsorted(starts, [c[1] for c in found])  # plain spans that start before a candidate ends
    return [k == 0 or bool(ends[k - 1] <= c[0]) for c, k in zip(found, i.tolist())]


def readable(s: str, kind: str) -> bool:
    """Whether a span is a plain match of a kind once its disguise is undone."""
    if kind == "email":
        plain = re.sub(r"\s", "", re.sub(DOT, ".", re.sub(AT, "@", s)))
    elif kind == "ip":
        plain = re.sub(r"[^0-9.]", "", s)
    else:
        digits = re.sub("[^0-9]", "", s)
        plain = digits if kind == "card" else "+" + (digits[2:] if digits.startswith("00") else digits)
    return (0, len(plain), kind) in base_spans(plain)


def examples(text: str, turn: int, addable: bool = False) -> Iterator[tuple[str, int, int, str, int]]:
    """(text, start, end, kind, label) of candidates that can't be read as personal data of any kind or equal a plain match,
    and of variants of all plain matches. If ``addable``, without plain matches, which are redacted whatever their score."""
    base, found = base_spans(text), candidates(text)
    plain = set(base)
    for c, free in zip(found, _free(found, base)):
        if (c in plain and not addable) or (free and not any(readable(text[c[0] : c[1]], k) for k in KINDS)):
            yield (text, *c, int(not free))
    for start, end, kind in base:
        lo = min(60, start)
        for form, true in _variants(text[start:end], kind, turn):
            new = text[start - lo : start] + form + text[end : end + 60]
            for s, e, k in candidates(new):
                if k == kind and s <= lo + 1 and e >= lo + len(form) - 1:
                    yield new, s, e, k, int(true)


def _turn(h: int) -> int:
    return h % 5_400  # a multiple of what variants use


class Model:
    """Trees over candidates and a threshold for each kind, 2 where nothing reaches the precision."""

    def __init__(self, trees: BoostedTrees, thresholds: dict[str, float]):
        self.trees, self.thresholds = trees, thresholds

    @classmethod
    def fit(cls, x: list[list[float]], label: list[int]) -> Model:
        """Trees fitted on features of examples; thresholds are still to come."""
        trees = BoostedTrees()
        if x:
            trees = trees.fit(np.array(x, float), np.array(label, float))
        return cls(trees, dict.fromkeys(KINDS, 2.0))

    def spans(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Further spans of a text: the best that overlap neither plain ones nor each other."""
        found = candidates(text)
        found = [c for c, free in zip(found, _free(found, base)) if free]
        if not found:
            return []
        p = self.trees.predict(np.array([features(text, *c) for c in found], float))
        good = sorted((-q, c) for q, c in zip(p.tolist(), found) if q >= self.thresholds[c[2]])
        out: list[tuple[int, int, str]] = []
        for _, c in good:
            if all(c[1] <= o[0] or o[1] <= c[0] for o in out):
                out.append(c)
        return out


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.xxhash64(text).alias("h"), text.alias("text")).where("text <> ''")


def _drawn(docs: DataFrame, sample: int) -> list[int]:
    """Hashes of the texts to fit on: a share for each kind of plain match and for other candidates."""
    share = -(-sample // (len(KINDS) + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[set[int]] = [set() for _ in range(len(KINDS) + 1)]
        for b in batches:
            for h, value in zip(b.column("h").to_pylist(), b.column("text")):
                text = value.as_py()
                base = base_spans(text)
                held = {KINDS.index(k) for _, _, k in base}
                found = candidates(text)
                if found and any(_free(found, base)):
                    held.add(len(KINDS))
                for i in held:
                    least[i].add(h)
            least = [x if len(x) < 4 * share else set(heapq.nsmallest(share, x)) for x in least]
        pairs = [(i, h) for i, x in enumerate(least) for h in heapq.nsmallest(share, x)]
        yield pa.record_batch({"part": pa.array([i for i, _ in pairs], pa.int32()), "h": pa.array([h for _, h in pairs], pa.int64())})

    scratch = Scratch(docs.sparkSession)
    parts = scratch.write(docs.where(F.pmod("h", F.lit(4)) != 0).mapInArrow(run, "part int, h long"), "drawn")
    out: set[int] = set()
    for i in range(len(KINDS) + 1):
        out.update(r["h"] for r in parts.where(F.col("part") == i).select("h").distinct().orderBy("h").limit(share).collect())
    scratch.drop(parts)
    return sorted(out)


def _examples(docs: DataFrame, used: list[int]) -> DataFrame:
    """(kind, draw, x, label): examples of the used texts with the hash that draws them."""
    wanted = docs.sparkSession.createDataFrame([(h,) for h in used], "h long")  # as many as the sample at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in batches:
            for h, value in zip(b.column("h").to_pylist(), b.column("text")):
                out = []
                for i, (text, s, e, k, label) in enumerate(examples(value.as_py(), _turn(h))):
                    out.append((KINDS.index(k), xxh64_intdigest(f"{h} {i}") >> 1, features(text, s, e, k), label))
                    if len(out) >= 5_000:
                        yield batch(out)
                        out = []
                if out:
                    yield batch(out)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.int32())
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["kind", "draw", "x", "label"])

    texts = docs.join(F.broadcast(wanted), "h").dropDuplicates(["h"]).select("h", "text")
    return texts.mapInArrow(run, "kind int, draw long, x array<double>, label int")


def _levels(docs: DataFrame, model: Model, used: list[int]) -> DataFrame:
    """(kind, level, good, n): examples that the method decides, of all documents but the used ones, by score from the first level on."""
    skip = frozenset(used)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(KINDS), len(LEVELS), 2), np.int64)
        held: list[tuple[list[float], int, int]] = []

        def tally() -> None:
            if held:
                level = np.searchsorted(LEVELS, model.trees.predict(np.array([r[0] for r in held], float)), "right") - 1
                kind, label = (np.array([r[i] for r in held], int) for i in (1, 2))
                some = level >= 0
                np.add.at(count, (kind[some], level[some], 0), label[some])
                np.add.at(count, (kind[some], level[some], 1), 1)
                held.clear()

        for b in batches:
            for h, value in zip(b.column("h").to_pylist(), b.column("text")):
                if h in skip:
                    continue
                for text, s, e, k, label in examples(value.as_py(), _turn(h), addable=True):
                    held.append((features(text, s, e, k), KINDS.index(k), label))
                    if len(held) >= 10_000:
                        tally()
        tally()
        kind, level = np.nonzero(count[:, :, 1])
        cols = (kind, level, count[kind, level, 0], count[kind, level, 1])
        yield pa.record_batch({c: pa.array(x, pa.int64()) for c, x in zip(("kind", "level", "good", "n"), cols)})

    rows = docs.mapInArrow(run, "kind long, level long, good long, n long")
    return rows.groupBy("kind", "level").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))


def fit(docs: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Model:
    """Trees from ``sample`` texts; the threshold of a kind is the least score from which on ``precision`` of the examples of all other documents are positive."""
    rows = _hashed(docs)
    used = _drawn(rows, sample)
    if not used:
        return Model.fit([], [])
    scratch = Scratch(docs.sparkSession)
    seen = scratch.write(_examples(rows, used), "examples")
    drawn = [r for i in range(len(KINDS)) for r in seen.where(F.col("kind") == i).orderBy("draw", "x").limit(EXAMPLES).collect()]
    scratch.drop(seen)
    model = Model.fit([r["x"] for r in drawn], [r["label"] for r in drawn])
    good, n = (np.zeros((len(KINDS), len(LEVELS)), np.int64) for _ in range(2))
    for r in _levels(rows, model, used).collect():  # a row per kind and level
        good[r["kind"], r["level"]], n[r["kind"], r["level"]] = r["good"], r["n"]
    for i, k in enumerate(KINDS):
        of, right = (np.cumsum(x[i][::-1])[::-1] for x in (n, good))
        ok = np.flatnonzero((n[i] > 0) & (right >= precision * of))
        model.thresholds[k] = float(LEVELS[ok[0]]) if len(ok) else 2.0
    return model


def find(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, redacted): one row per row of ``docs``.

    Counts and digest are of plain matches; ``spans`` has all as kind:start:end in code points, by start. ``redacted``
    has each maximal run of overlapping spans replaced by its first kind in brackets. Null text counts as empty and
    stays null in ``redacted``. Repeated rows stay, empty tables give no rows, extra columns are ignored.
    """
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shown = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64(), pa.string()]
        names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "redacted"]
        for b in batches:
            out = []
            for value in b.column("text"):
                text = value.as_py() or ""
                base = base_spans(text)
                added = model.spans(text, base)
                every = sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                parts, end = [], 0
                for s, e, k in every:
                    if s >= end:
                        parts += [text[end:s], f"[{k.upper()}]"]
                    end = max(end, e)
                count = [sum(k == x[2] for x in base) for k in KINDS]
                new = "".join([*parts, text[end:]]) if value.is_valid else None
                out.append((*count, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every), len(added), new))
            cols = zip(*out) if out else [()] * 8
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, redacted string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced and ``n_chars``, where there is one, counted anew.

    Null texts stay null, empty ones empty, repeated rows stay, an empty table gives no rows; other columns are kept.
    """
    model = model or fit(docs)
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for value in b.column(at):
                text = value.as_py()
                if text:
                    base = base_spans(text)
                    parts, end = [], 0
                    for s, e, k in sorted([*base, *model.spans(text, base)], key=lambda s: (s[0], KINDS.index(s[2]), s[1])):
                        if s >= end:
                            parts += [text[end:s], f"[{k.upper()}]"]
                        end = max(end, e)
                    text = "".join([*parts, text[end:]])
                new.append(text)
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents")).drop("redacted")


QUERIES = {"op6_pii": op6_pii}
ORACLES: dict[str, str] = {}
