"""Repeated windows of documents, exactly, by super-k-mers.

A window is k consecutive symbols (words or bytes) of one document. Its minimiser is the leftmost of its
m-grams with the least hash, so equal windows have equal minimisers at equal places. Consecutive windows that
share one minimiser travel as one packed string, keyed by that m-gram; rows of one key hold all copies of their
windows, and sorting them there finds the windows that start earlier, too. Copies of a packed string inside one
map task don't travel: a short row reports them at once.

Only keys that occur more than once are worth packed strings, so keys and places alone are shuffled before.
Keys with many different packed strings are sent window by window under the window's own hash, which spreads them:
the most frequent of them before the shuffle, and any other key as soon as a task meets more than ``FREQUENT`` rows of it.

Documents are ordered by doc_id (null first), then, where a doc_id occurs more than once, by a hash of the text;
rows equal in both are one document. Long texts are cut into parts of ``PIECE`` bytes that share k - 1 symbols.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Bytes of text that a map task works on at a time.
PIECE = 1 << 20
#: Bits of a place in a piece: pieces and the part that ends them are shorter than 4 MB.
INDEX_BITS = 22
#: Packed strings of one key that a task lists at most; more are sent window by window.
FREQUENT = 10_000
#: Packed strings that are compared at a time, at least.
LISTED = 5_000
#: Keys that are known as frequent before the shuffle, at most: their list goes to all tasks.
HOT_KEYS = 100_000

PLACES = "key long, doc long, rid long, start int, n int, sure boolean"
PACKED = "key long, doc long, rid long, start int, n int, packed binary"
RUNS = "doc long, rid long, start int, n int"
SPACES = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(x: np.ndarray, m: int) -> np.ndarray:
    """Hash of x[i : i + m] for every i, from hashes of spans of doubling length."""
    base, span, size = 0x9E3779B97F4A7C15 | 1, x, 1
    out, length = None, 0
    while m:
        if m & 1:
            if out is None:
                out, length = span, size
            else:
                n = min(len(out), len(span) - length)
                out = out[:n] * np.uint64(pow(base, size, 1 << 64)) + span[length : length + n]
                length += size
        m >>= 1
        if m:
            span = span[:-size] * np.uint64(pow(base, size, 1 << 64)) + span[size:]
            size *= 2
    return mix(out)


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Index of the leftmost least hash of h[i : i + w] for every i; hashes are told apart by their upper 42 bits."""
    low = np.uint64((1 << INDEX_BITS) - 1)
    least, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while size < w:
        s = min(size, w - size)
        least = np.minimum(least[:-s], least[s:])
        size += s
    return (least & low).astype(np.int64)


class Bytes:
    """Texts as UTF-8 bytes."""

    def slices(self, text: bytes, k: int, size: int) -> Iterator[tuple[int, bytes]]:
        """Parts of a text and where they begin; each window of k symbols lies in one part alone."""
        for at in range(0, max(len(text) - k + 1, 1), size):
            yield at, text[at : at + size + k - 1]

    def piece(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable]:
        """Symbol hashes, the symbols of each text, and what packs symbols [s, e)."""
        joined = b"".join(texts)
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        return BYTE_HASH[np.frombuffer(joined, np.uint8)], n, lambda s, e: [joined[a:b] for a, b in zip(s.tolist(), e.tolist())]

    def windows(self, packed: bytes, n: int, k: int) -> list[bytes]:
        return [packed[j : j + k] for j in range(n)]

    def cut(self, text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        """Symbols [lo, hi) of a text for every pair."""
        return [text[x:y] for x, y in zip(lo.tolist(), hi.tolist())]


class Words:
    """Texts as words between ASCII white space."""

    def slices(self, text: bytes, k: int, size: int) -> Iterator[tuple[int, bytes]]:
        begin, seen, tail = 0, 0, []
        while begin < len(text):
            space = SPACES.search(text, begin + size)
            end = space.start() if space else len(text)
            part = text[begin:end]
            yield seen - len(tail), b" ".join([*tail, part])
            begin = end
            if begin < len(text):
                words = part.split()
                seen += len(words)
                tail = (tail + words)[-(k - 1) :] if k > 1 else []

    def piece(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable]:
        from xxhash import xxh64_intdigest

        split = [t.split() for t in texts]
        n = np.fromiter(map(len, split), np.int64, len(split))
        words = [w for s in split for w in s]
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        coded = pa.array(words, pa.binary()).dictionary_encode()
        known = np.array([xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
        hashes = known[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
        starts = np.concatenate([[0], ends[:-1] + 1])

        def pack(s: np.ndarray, e: np.ndarray) -> list[bytes]:
            return [joined[a:b] for a, b in zip(starts[s].tolist(), ends[e - 1].tolist())]

        return hashes, n, pack

    def windows(self, packed: bytes, n: int, k: int) -> list[bytes]:
        words = packed.split(b" ")
        return [b" ".join(words[j : j + k]) for j in range(n)]

    def cut(self, text: bytes, lo: np.ndarray, hi: np.ndarray) -> list[bytes]:
        words = text.split()
        return [b" ".join(words[x:y]) for x, y in zip(lo.tolist(), hi.tolist())]


def pieces(batches: Iterator[pa.RecordBatch], unit, k: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts, or parts of long ones, of PIECE bytes or a little more, with doc, rid and at of each."""
    texts, names, size = [], [], 0

    def out():
        doc, rid, at = np.array(names, np.int64).reshape(-1, 3).T
        return texts, doc, rid, at

    for b in batches:
        for text, doc, rid, at in zip(b.column("text"), *(b.column(c).to_pylist() for c in ("doc", "rid", "at"))):
            t = text.as_py() or b""
            for o, part in unit.slices(t.encode() if isinstance(t, str) else t, k, PIECE):
                texts.append(part)
                names.append((doc, rid, at + o))
                size += len(part)
                if size >= PIECE:
                    yield out()
                    texts, names, size = [], [], 0
    if texts:
        yield out()


def super_kmers(unit, texts: list[bytes], k: int, m: int):
    """Super-k-mers of some texts: key, text, minimiser, first window and number of windows of each; the packer; symbols before each text."""
    hashes, n, pack = unit.piece(texts)
    before = np.cumsum(n) - n
    if len(hashes) < k:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, pack, before
    grams = gram_hashes(hashes, m)
    least = sliding_argmin(grams, k - m + 1)
    ok = np.zeros(len(least) + 1, np.int8)  # 1 where a window starts, as every window lies in one text
    has = n >= k
    np.add.at(ok, before[has], 1)
    np.add.at(ok, before[has] + n[has] - k + 1, -1)
    ok = np.cumsum(ok[:-1]).astype(bool)
    new = least[1:] != least[:-1]
    first = ok & np.concatenate([[True], new | ~ok[:-1]])
    last = ok & np.concatenate([new | ~ok[1:], [True]])
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    return grams[least[s]].view(np.int64), np.searchsorted(before, s, "right") - 1, least[s], s, e - s + 1, pack, before


def spread(doc: np.ndarray, rid: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Keys that deal rows by their place."""
    return mix(mix(doc.view(np.uint64) ^ rid.view(np.uint64)) + start.astype(np.uint64)).view(np.int64)


def schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.schema([(a, kinds[b]) for a, b in (x.split() for x in ddl.split(", "))])


def batch(ddl: str, *cols) -> pa.RecordBatch:
    """A batch of the columns in ``ddl``."""
    fields = schema(ddl)
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, fields)], schema=fields)


def sliced(rows: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    for i in range(0, rows.num_rows, size):
        yield rows.slice(i, size)


def identified(docs: DataFrame) -> DataFrame:
    """(doc, rid, at, text): doc_id with null as the least; rid tells apart texts under one doc_id and is 0 where each
    occurs once; at is where the text begins in its document, 0 for whole ones."""
    doc: Column = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    twice = docs.groupBy("doc_id").count().where("count > 1")
    rid = F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64("text")
    return docs.select(doc.alias("doc"), rid.alias("rid"), F.lit(0).alias("at"), F.col("text").cast("string").alias("text"))


def squeezed(rows: DataFrame) -> DataFrame:
    """(doc, rid, z) with each text as compressed UTF-8, which halves what a later shuffle of texts writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdCompressor

        pack = ZstdCompressor(level=3).compress
        for b in batches:
            z = [pack((t.as_py() or "").encode()) for t in b.column("text")]
            yield pa.record_batch([b.column("doc"), b.column("rid"), pa.array(z, pa.binary())], ["doc", "rid", "z"])

    return rows.select("doc", "rid", "text").mapInArrow(run, "doc long, rid long, z binary")


def combined(key: np.ndarray, doc: np.ndarray, rid: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """PLACES of a map task. A key that it meets twice is known to be repeated: one row goes under the key, to tell
    other tasks, and the rest are spread by place."""
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    sure, rest = np.zeros(len(key), bool), np.zeros(len(key), bool)
    rest[order[same]] = True
    sure[order[same]] = sure[order[np.flatnonzero(same) - 1]] = True
    return batch(PLACES, np.where(rest, spread(doc, rid, start), key), doc, rid, start.astype(np.int32), n.astype(np.int32), sure)


def candidates(rows: DataFrame, unit, k: int, m: int) -> DataFrame:
    """RUNS: super-k-mers whose minimiser occurs more than once, by its hash; all other windows are unique."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, doc, rid, at in pieces(batches, unit, k):
            key, of, _, s, n, _, before = super_kmers(unit, texts, k, m)
            if len(key):
                yield from sliced(combined(key, doc[of], rid[of], s - before[of] + at[of], n), 50_000)

    return repeated_keys(rows.mapInArrow(places, PLACES))


def looking_ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches that begin with the last row of the one before, so that each row is met beside its neighbours; at last that row alone, and True."""
    last = None
    for b in batches:
        if b.num_rows:
            b = b if last is None else pa.Table.from_batches([last, b]).combine_chunks().to_batches()[0]
            yield b, False
            last = b.slice(b.num_rows - 1)
    if last is not None:
        yield last, True


def repeated_keys(places: DataFrame) -> DataFrame:
    """RUNS of the rows of PLACES whose key occurs more than once or is sure to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the key before the batch
        for b, done in looking_ahead(batches):
            key = b.column("key").to_numpy()
            same = key[1:] == key[:-1]
            keep = b.column("sure").to_numpy(zero_copy_only=False) | np.concatenate([[before is not None and key[0] == before], same]) | np.append(same, False)
            keep[-1] &= done
            if keep.any():
                yield b.take(pa.array(np.flatnonzero(keep))).select(["doc", "rid", "start", "n"])
            before = key[-2] if len(key) > 1 else before

    return places.repartition("key").sortWithinPartitions("key").mapInArrow(run, RUNS)


def segments(rows: DataFrame, found: DataFrame, unit, k: int) -> DataFrame:
    """(doc, rid, at, text): the stretches of documents that hold the windows of the RUNS ``found``."""
    spans = found.groupBy("doc", "rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    met = squeezed(rows).join(spans.withColumnsRenamed({"doc": "d", "rid": "r"}), (F.col("doc") == F.col("d")) & (F.col("rid") == F.col("r")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        for b in batches:
            out = []
            for doc, rid, z, spans in zip(b.column("doc").to_pylist(), b.column("rid").to_pylist(), b.column("z"), b.column("spans")):
                lo, hi = covered(*runs_of(spans), k)
                out += [(doc, rid, x, part) for x, part in zip(lo.tolist(), unit.cut(unpack(z.as_py()), lo, hi))]
            if out:
                yield batch("doc long, rid long, at int, text binary", *zip(*out))

    return met.select("doc", "rid", "z", "spans").mapInArrow(cut, "doc long, rid long, at int, text binary")


def _frequent(parts: DataFrame, unit, k: int, m: int, least: int) -> list[int]:
    """Keys with many different packed strings: over ``least``, and over one in HOT_KEYS of all, hence so many keys at most.

    A map task counts copies once, as it sends one of them, and reports keys that it meets often.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for texts, *_ in pieces(batches, unit, k):
            key, _, _, s, n, pack, _ = super_kmers(unit, texts, k, m)
            if not len(key):
                continue
            some = np.unique(key, return_inverse=True, return_counts=True)
            often = some[2][some[1]] >= 4
            found = pack(s[often], s[often] + n[often] - 1 + k)
            different = set(zip(key[often].tolist(), map(xxh3_64_intdigest, found)))
            keys, n = np.unique(np.fromiter((x for x, _ in different), np.int64, len(different)), return_counts=True)
            keys, n = np.append(keys[n >= 4], 0), np.append(n[n >= 4], len(key))
            yield batch("key long, n long, total boolean", keys, n, np.arange(len(keys)) == len(keys) - 1)

    counts = parts.mapInArrow(run, "key long, n long, total boolean").groupBy("key", "total").agg(F.sum("n").alias("n"))
    scratch = Scratch(parts.sparkSession)
    found = scratch.write(counts.where(F.col("total") | (F.col("n") > least)), "frequent")
    total = found.where("total").first()
    top = [] if total is None else found.where(~F.col("total") & (F.col("n") > max(least, total["n"] // HOT_KEYS))).select("key").collect()
    scratch.drop(found)
    return [r["key"] for r in top]


def packed_windows(parts: DataFrame, unit, k: int, m: int, frequent: int = FREQUENT) -> DataFrame:
    """Rows of PACKED from texts: packed strings, and short rows (packed null) for windows known to start earlier, too."""
    hot = np.array(_frequent(parts, unit, k, m, frequent), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, doc, rid, at0 in pieces(batches, unit, k):
            key, of, _, s, n, pack, before = super_kmers(unit, texts, k, m)
            if not len(key):
                continue
            single = np.isin(key, hot)
            if single.any():  # window by window
                each = np.where(single, n, 1)
                i = np.repeat(np.arange(len(key)), each)
                step = np.arange(len(i)) - np.repeat(np.cumsum(each) - each, each)
                s, n, of, key, single = s[i] + step, np.where(single[i], 1, n[i]), of[i], key[i].copy(), single[i]
            packed = pack(s, s + n - 1 + k)
            _window_keys(key, packed, np.flatnonzero(single))
            yield from sliced(_pack(key, doc[of], rid[of], s - before[of] + at0[of], n, packed), 20_000)

    return parts.mapInArrow(run, PACKED)


def _window_keys(key: np.ndarray, packed: list[bytes], at: np.ndarray) -> None:
    """The key of single windows is their own hash."""
    from xxhash import xxh64_intdigest

    key[at] = np.array([xxh64_intdigest(packed[i], 7) for i in at.tolist()], np.uint64).view(np.int64)


def _pack(key: np.ndarray, d: np.ndarray, r: np.ndarray, start: np.ndarray, n: np.ndarray, packed: list[bytes | None]) -> pa.RecordBatch:
    """PACKED rows of a map task. Only the first of equal packed strings travels; the others are short rows, one for
    those that follow each other in a text."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twin = np.zeros(len(key), bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    at = np.flatnonzero(twin)
    seen: dict[bytes, int] = {}
    drop, short = np.zeros(len(key), bool), np.zeros(len(key), bool)
    for i in at[np.lexsort((start[at], r[at], d[at]))].tolist():
        f = seen.setdefault(packed[i], i)
        if f != i:
            packed[i] = None
            if d[f] == d[i] and r[f] == r[i] and start[f] == start[i]:
                drop[i] = True  # an equal row
            else:
                short[i] = True
    if short.any():
        on = np.concatenate([[False], short[1:] & short[:-1] & (d[1:] == d[:-1]) & (r[1:] == r[:-1]) & (start[1:] == start[:-1] + n[:-1])])
        head = np.flatnonzero(~on)
        n = n.copy()
        n[head] = np.add.reduceat(n, head)
        drop |= on
        key = np.where(short, spread(d, r, start), key)
    out = batch(PACKED, key, d, r, start.astype(np.int32), n.astype(np.int32), pa.array(packed, pa.binary()))
    return out.filter(pa.array(~drop)) if drop.any() else out


def repeated_spans(parts: DataFrame, unit, k: int, m: int, frequent: int = FREQUENT) -> DataFrame:
    """RUNS of windows of ``parts`` that start earlier, too, as a written table."""
    spark = parts.sparkSession
    scratch = Scratch(spark)
    dealt = packed_windows(parts, unit, k, m, frequent).repartition("key").sortWithinPartitions("key")
    found = scratch.write(dealt.mapInArrow(lambda b: _by_key(b, unit, k, frequent), PACKED), "runs")
    over = found.where("packed is not null")
    runs = found.where("packed is null").select("doc", "rid", "start", "n")
    if over.isEmpty():
        return runs

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in sliced(b, 2_000):
                n, packs = part.column("n").to_numpy(), part.column("packed").to_pylist()
                i = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                windows = [w for p, c in zip(packs, n.tolist()) for w in unit.windows(p, c, k)]
                key = np.zeros(len(i), np.int64)
                _window_keys(key, windows, np.arange(len(i)))
                d, r, s = (part.column(c).to_numpy().astype(np.int64)[i] for c in ("doc", "rid", "start"))
                yield from sliced(_pack(key, d, r, s + step, np.ones(len(i), np.int64), windows), 20_000)

    place = ["doc", "rid", "start"]
    rest = over.mapInArrow(single, PACKED).repartition("key").sortWithinPartitions("key", *place).mapInArrow(_by_window, RUNS)
    return runs.unionByName(scratch.write(rest, "frequent_runs"))


def _by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of single windows sorted by key and place: all but the first of equal ones. A task holds one string per key."""
    now, first = None, {}
    for b in batches:
        out = []
        for key, d, r, s, n, w in zip(*(c.to_pylist() for c in b.columns)):
            if w is None:
                out.append((d, r, s, n))
                continue
            if key != now:
                now, first = key, {}
            if first.setdefault(w, (d, r, s)) != (d, r, s):
                out.append((d, r, s, n))
        if out:
            yield batch(RUNS, *zip(*out))


def _by_key(batches: Iterator[pa.RecordBatch], unit, k: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of PACKED sorted by key -> runs of windows that start earlier, too (packed null), and, unchanged, the rows
    of keys that have more than ``most``."""
    whole: list[pa.RecordBatch] = []  # rows of keys that are complete
    rows = 0
    held: list[pa.RecordBatch] = []  # rows of the key that the next batch may go on with
    key, size, over = None, 0, False
    for b in batches:
        plain = b.column("packed").is_valid()
        short = b.filter(pa.array(~plain.to_numpy(zero_copy_only=False)))
        if short.num_rows:
            yield short
            b = b.filter(plain)
        if not b.num_rows:
            continue
        keys = b.column("key").to_numpy()
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        first, last = int(np.append(edge, len(keys))[1]), int(edge[-1])
        if first < last:  # keys that lie in this batch alone
            met = np.diff(edge[1:])
            met = np.repeat(met, met)
            inner = b.slice(first, last - first)
            whole.append(inner.filter(pa.array((met > 1) & (met <= most))))
            rows += whole[-1].num_rows
            if (met > most).any():
                yield inner.filter(pa.array(met > most))
        for lo, hi in ((0, first), (last, len(keys)))[: min(len(edge), 2)]:
            if key is None or keys[lo] != key:
                if size > 1 and not over:
                    whole += held
                    rows += size
                held, key, size, over = [], keys[lo], 0, False
            held.append(b.slice(lo, hi - lo))
            size += hi - lo
            if size > most:
                over = True
                yield from held
                held = []
        if rows >= LISTED:
            yield from _first_windows(whole, unit, k)
            whole, rows = [], 0
    if size > 1 and not over:
        whole += held
    yield from _first_windows(whole, unit, k)


def _first_windows(held: list[pa.RecordBatch], unit, k: int) -> Iterator[pa.RecordBatch]:
    """Packed strings of whole keys -> runs of windows that start earlier, too. Windows are sorted by their hashes;
    those that follow each other in equal ones are compared in full."""
    held = [h for h in held if h.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    key, doc, rid, start, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("key", "doc", "rid", "start", "n"))
    symbols, size, pack = unit.piece(rows.column("packed").to_pylist())
    row = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[row] + step
    hashed = gram_hashes(symbols, k)[at]
    name = np.unique(key, return_inverse=True)[1]
    place = start[row] + step
    order = np.lexsort((place, rid[row], doc[row], hashed, name[row]))
    new = np.concatenate([[True], (name[row][order][1:] != name[row][order][:-1]) | (hashed[order][1:] != hashed[order][:-1])])
    first = np.empty(len(row), np.int64)
    first[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    again = np.flatnonzero((doc[row] != doc[row[first]]) | (rid[row] != rid[row[first]]) | (place != place[first]))
    if not len(again):
        return
    # windows and first windows that both go on
    f = first[again]
    on = (row[again][1:] == row[again][:-1]) & (again[1:] == again[:-1] + 1) & (row[f][1:] == row[f][:-1]) & (f[1:] == f[:-1] + 1)
    head = np.flatnonzero(np.concatenate([[True], ~on]))
    count = np.diff(np.append(head, len(again)))
    w, f = again[head], f[head]
    unlike = [i for i, (x, y) in enumerate(zip(pack(at[w], at[w] + count - 1 + k), pack(at[f], at[f] + count - 1 + k))) if x != y]
    if unlike:  # hashes met by chance: these keys are compared window by window
        clash = np.unique(name[row[w[unlike]]])
        some = np.isin(name, clash)
        out = list(_compared([tuple(r) for r in zip(name[some].tolist(), doc[some].tolist(), rid[some].tolist(), start[some].tolist(), n[some].tolist(), rows.column("packed").filter(pa.array(some)).to_pylist())], unit, k))
        good = ~np.isin(name[row[w]], clash)
        w, count = w[good], count[good]
        if out:
            yield _result(*zip(*out))
    if len(w):
        yield _result(doc[row[w]], rid[row[w]], place[w].astype(np.int32), count.astype(np.int32))


def _compared(rows: list[tuple], unit, k: int) -> Iterator[tuple]:
    """(key, doc, rid, start, n, packed) -> windows that start earlier, too, by comparing them."""
    seen: dict[tuple, tuple] = {}
    windows = sorted((key, d, r, s + j, w) for key, d, r, s, n, p in rows for j, w in enumerate(unit.windows(p, n, k)))
    for key, d, r, s, w in windows:
        if seen.setdefault((key, w), (d, r, s)) != (d, r, s):
            yield d, r, s, 1


def _result(doc, rid, start, n) -> pa.RecordBatch:
    return batch(PACKED, np.zeros(len(doc), np.int64), doc, rid, start, n, pa.nulls(len(doc), pa.binary()))


def runs_of(spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Starts and numbers of windows of a list of runs."""
    return tuple(spans.values.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))


def covered(starts: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches that runs of ``n`` windows of length k cover."""
    order = np.argsort(starts, kind="stable")
    lo, hi = starts[order], (starts + n - 1 + k)[order]
    if not len(lo):
        return lo, hi
    reach = np.maximum.accumulate(hi)
    new = np.concatenate([[True], lo[1:] > reach[:-1]])
    at = np.flatnonzero(new)
    return lo[at], reach[np.append(at[1:] - 1, len(reach) - 1)]
