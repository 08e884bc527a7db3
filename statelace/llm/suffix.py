"""Repeated byte strings of documents: every byte under a string that also starts earlier is removed.

Prefix doubling over anchors. An anchor is the start of the 16-byte string with the least hash in a window of the
threshold's length, so copies of a passage have the same anchors, one in some 37 bytes. The bytes from an anchor to
the end of the next one are its phrase. A position's first rank is the earliest place known to have the same phrase.
In each round Spark sorts the pairs of ranks at an offset that doubles (1, 2, 4 ... phrases) and ranks the pairs anew,
until a position is unique or its phrases reach past the threshold. Ranks are places, so those of copied passages run
in step with their positions and travel as runs; pairs that go on in step are equal to the earlier place without being sorted.

Whatever windows lie in ranked spans start earlier, too. What the rounds leave open are the first copies and the windows
at the ends of repeats, between two anchors: of these, the ones whose anchor occurs more than once are compared byte by
byte as packed strings. A phrase is known by its first 16 bytes' hash and a 64-bit hash of all its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .superkmer import (
    FREQUENT, PLACES, Bytes, batch, combined, covered, identified, looking_ahead, mix, pieces, repeated_keys, repeated_spans, runs_of,
    segments, sliced, spread, squeezed, super_kmers,
)

LENGTH = 100
#: Length of the anchors.
GRAM = 16

# Two numbers travel as one: place is start << 32 | at, rest is i << 32 | n << 2 | sure << 1 | many.
ANCHORS = "part long, key long, phrase long, doc long, rid long, place long, rest long, ref_doc long, ref_rid long, ref_i int"
RANKED = "doc long, rid long, key long, place long, rest long, ref_doc long, ref_rid long, ref_i int"
AT = "struct<key: bigint, i: int, start: int, n: int, at: int>"
RUN = "struct<i: int, n: int, need: int, ref_doc: bigint, ref_rid: bigint, ref_i: int>"
PAIRS = "doc long, rid long, need int, i int, n int, d1 long, r1 long, i1 int, d2 long, r2 long, i2 int"
#: Anchors of documents that are worked on at a time.
PART = 50_000
#: The least class of positions by the phrases they need; classes are powers of two.
CLASS = 4


def anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """Rows of ANCHORS of ``identified`` documents: anchors with their windows and the hash of their phrase.

    Of equal phrases in a map task one goes out; the others name it as their rank and are spread by place. Rows are
    dealt by their key; those of a key that the task meets twice are known to be repeated and dealt by phrase, too,
    while one row with n = 0 tells other tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        ahead = 0  # anchors of the last text so far, where its next part comes first in the next piece
        for texts, doc, rid, at0 in pieces(batches, Bytes(), length):
            key, of, least, s, n, pack, before = super_kmers(Bytes(), texts, length, gram)
            if not len(key):
                continue
            d, r = doc[of], rid[of]
            start, at = s - before[of] + at0[of], least - before[of] + at0[of]
            head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            i = np.arange(len(of)) - np.repeat(head, np.diff(np.append(head, len(of))))
            if at0[0]:
                i[of == 0] += ahead
            ahead = i[-1] + 1

            lone = spread(d, r, start)
            phrase = lone.copy()  # a text's last anchor has no phrase
            on = np.flatnonzero(of[1:] == of[:-1])
            phrase[on] = np.fromiter(map(xxh3_64_intdigest, pack(least[on], least[on + 1] + gram)), np.uint64, len(on)).view(np.int64)

            order = np.lexsort((i, r, d, phrase, key))
            new_key = np.concatenate([[True], key[order][1:] != key[order][:-1]])
            new = new_key | np.concatenate([[True], phrase[order][1:] != phrase[order][:-1]])
            lead = np.empty(len(key), np.int64)
            lead[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
            follows = lead != np.arange(len(key))
            many, sure = np.zeros(len(key), bool), np.zeros(len(key), bool)
            many[lead[follows]] = True
            met = np.diff(np.append(np.flatnonzero(new_key), len(key)))
            sure[order] = np.repeat(met > 1, met)
            part = np.where(follows, lone, np.where(sure, mix(mix(key.view(np.uint64)) ^ phrase.view(np.uint64)).view(np.int64), key))
            place, rest = start << 32 | at, i << 32 | n << 2 | sure << 1 | many
            refs = [pa.array(c[lead], mask=~follows) for c in (d, r, i.astype(np.int32))]
            yield from sliced(batch(ANCHORS, part, key, phrase, d, r, place, rest, *refs), 50_000)
            tell = order[new_key][met > 1]
            none = [pa.nulls(len(tell), t) for t in (pa.int64(), pa.int64(), pa.int32())]
            yield from sliced(batch(ANCHORS, key[tell], key[tell], phrase[tell], d[tell], r[tell], place[tell], i[tell] << 32 | 2, *none), 50_000)

    return rows.mapInArrow(run, ANCHORS)


def first_ranks(found: DataFrame) -> DataFrame:
    """RANKED anchors whose key occurs more than once; the rank is null where the phrase is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, first = None, ()  # dealing key and phrase of the row before the batch, and the place of the first row like it
        for b, done in looking_ahead(batches):
            part, phrase = b.column("part").to_numpy(), b.column("phrase").to_numpy()
            next_key = part[1:] == part[:-1]
            next_like = next_key & (phrase[1:] == phrase[:-1])
            on_key = before is not None and before[0] == part[0]
            on = on_key and before[1] == phrase[0]
            rest = b.column("rest").to_numpy()
            sure, many = (rest & 2) > 0, (rest & 1) > 0
            follows = b.column("ref_doc").is_valid().to_numpy(zero_copy_only=False)
            repeated = sure | follows | np.concatenate([[on_key], next_key]) | np.append(next_key, False)
            ranked = many | follows | np.concatenate([[on], next_like]) | np.append(next_like, False)
            head = np.flatnonzero(np.concatenate([[True], ~next_like]))
            lead = np.repeat(head, np.diff(np.append(head, len(part))))
            refs, places = [], []
            for j, (c, of) in enumerate((("doc", b.column("doc").to_numpy()), ("rid", b.column("rid").to_numpy()), ("i", (rest >> 32).astype(np.int32)))):
                place = of[lead]
                if on:
                    place = np.where(lead == 0, first[j], place)
                places.append(place)
                given = b.column(f"ref_{c}")
                refs.append(pa.array(np.where(follows, given.fill_null(0).to_numpy(), place).astype(place.dtype), given.type, mask=~ranked))
            keep = repeated & ((rest >> 2 & 0x3FFFFFFF) > 0)
            keep[-1] &= done
            if keep.any():
                yield batch(RANKED, *(b.column(c) for c in ("doc", "rid", "key", "place", "rest")), *refs).filter(pa.array(keep))
            if len(part) > 1:
                before, first = (part[-2], phrase[-2]), tuple(p[-2] for p in places)

    return found.repartition("part").sortWithinPartitions("part", "phrase", "doc", "rid", "rest").mapInArrow(run, RANKED)


class Lists:
    """Rows of documents' lists of structs, flat: ``of`` numbers the document of each, fields are arrays."""

    def __init__(self, column: pa.Array, *fields: str):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = column.flatten()
        self.of = np.repeat(np.arange(len(size)), size)
        self.valid = {f: values.field(f).is_valid().to_numpy(zero_copy_only=False) for f in fields}
        self.at = {f: values.field(f).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields}

    def __getitem__(self, field: str) -> np.ndarray:
        return self.at[field]

    def take(self, keep: np.ndarray) -> Lists:
        out = object.__new__(Lists)
        out.of, out.at, out.valid = self.of[keep], {f: x[keep] for f, x in self.at.items()}, {f: x[keep] for f, x in self.valid.items()}
        return out


def in_parts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose lists in ``column`` have about PART elements together, or one row."""
    for b in batches:
        lists = b.column(column)
        size = np.diff(lists.offsets.to_numpy().astype(np.int64))
        part = (np.cumsum(size) - size) // PART
        edge = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), b.num_rows]):
            yield b.slice(lo, hi - lo)


def listed(of: np.ndarray, docs: int, kind: str, **fields: np.ndarray) -> pa.Array:
    """The reverse: lists of structs from flat rows that are in order of ``of``."""
    types = {"bigint": pa.int64(), "int": pa.int32()}
    kinds = {x.split(": ")[0]: types[x.split(": ")[1]] for x in kind[7:-1].split(", ")}
    structs = pa.StructArray.from_arrays([pa.array(fields[f].astype(t.to_pandas_dtype())) for f, t in kinds.items()], list(kinds))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(docs + 1)).astype(np.int32)), structs)


def _wide(of: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Places of different documents in one line."""
    return (of << 33) + i


def in_step(of: np.ndarray, i: np.ndarray, n: np.ndarray, need: np.ndarray, d: np.ndarray, r: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs in order, those that go on in step as one."""
    if not len(of):
        return of, i, n, need, d, r, ref
    go = (of[1:] == of[:-1]) & (i[1:] == i[:-1] + n[:-1]) & (need[1:] == need[:-1]) & (d[1:] == d[:-1]) & (r[1:] == r[:-1]) & (ref[1:] == ref[:-1] + n[:-1])
    at = np.flatnonzero(np.concatenate([[True], ~go]))
    return of[at], i[at], np.add.reduceat(n, at), need[at], d[at], r[at], ref[at]


def by_document(ranked: DataFrame, length: int, gram: int) -> DataFrame:
    """(doc, rid, need, anchors, runs): each document's repeated anchors, the ranks of their phrases as runs, and the
    most phrases that any of its positions needs to reach past ``length``; a run's need is the power of two from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole(batches):
            doc, rid, key, place, rest = (b.column(c).to_numpy() for c in ("doc", "rid", "key", "place", "rest"))
            order = np.lexsort((rest, rid, doc))
            b, doc, rid, key, place, rest = b.take(pa.array(order)), doc[order], rid[order], key[order], place[order], rest[order]
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1])])
            i = rest >> 32
            once = new | np.concatenate([[True], i[1:] != i[:-1]])  # equal rows are one document
            b, new = b.filter(pa.array(once)), new[once]
            doc, rid, key, place, rest, i = (x[once] for x in (doc, rid, key, place, rest, i))
            of, docs = np.cumsum(new) - 1, int(new.sum())
            start, at, n = place >> 32, place & 0xFFFFFFFF, rest >> 2 & 0x3FFFFFFF
            line, ranks = _wide(of, i), b.column("ref_doc").is_valid().to_numpy(zero_copy_only=False)
            # phrases in a row from each position on, and phrases up to the bytes it needs
            stop = np.flatnonzero(~ranks | np.append(np.diff(line) != 1, True))
            chain = stop[np.searchsorted(stop, np.arange(len(line)))] - np.arange(len(line))
            reach = _wide(of, at + gram)
            after = np.append(reach[1:], reach[-1:]) - gram + length - 1
            most = np.maximum(np.minimum(np.searchsorted(reach, after) - np.arange(len(line)), chain), 1)
            need = np.zeros(docs, np.int64)
            np.maximum.at(need, of, most)
            classes = np.maximum(1 << np.ceil(np.log2(most)).astype(np.int64), CLASS)
            refs = (b.column(c).drop_null().to_numpy().astype(np.int64) for c in ("ref_doc", "ref_rid", "ref_i"))
            o, *cols = in_step(of[ranks], i[ranks], np.ones(ranks.sum(), np.int64), classes[ranks], *refs)
            anchor = listed(of, docs, AT, key=key, i=i, start=start, n=n, at=at)
            runs = listed(o, docs, RUN, **dict(zip(("i", "n", "need", "ref_doc", "ref_rid", "ref_i"), cols)))
            yield pa.record_batch([pa.array(doc[new]), pa.array(rid[new]), pa.array(need.astype(np.int32)), anchor, runs], ["doc", "rid", "need", "anchors", "runs"])

    # one number names a document, as Spark sorts single numbers by radix; documents that share it are told apart above
    rows = ranked.withColumn("name", F.xxhash64("doc", "rid")).repartition("name").sortWithinPartitions("name")
    return rows.mapInArrow(run, f"doc long, rid long, need int, anchors array<{AT}>, runs array<{RUN}>")


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of whole documents; a document that goes on waits for its rest."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        name = b.column("name").to_numpy()
        if held and held[-1].column("name")[0].as_py() != name[0]:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        last = int(np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))[-1])
        if last:
            yield pa.Table.from_batches([*held, b.slice(0, last)]).combine_chunks().to_batches()[0]
            held = []
        held.append(b.slice(last))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def double(ranks: DataFrame, offset: int) -> DataFrame:
    """Rows of PAIRS for runs of positions that need more than ``offset`` phrases and have a rank that far on, too; d2 is
    null where that goes on in step with the first, so that the pair is equal to the one at the earlier place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, "runs"):
            x = Lists(b.column("runs"), "i", "n", "need", "ref_doc", "ref_rid", "ref_i")
            x = x.take(np.lexsort((x["i"], x.of)))
            of, i, n, need, d, r, ref = in_step(x.of, *(x[f] for f in ("i", "n", "need", "ref_doc", "ref_rid", "ref_i")))
            s = _wide(of, i)
            # overlaps of runs with runs moved back by the offset
            lo, hi = np.searchsorted(s + n, s + offset, "right"), np.searchsorted(s, s + n + offset, "left")
            many = np.where(need > offset, np.maximum(hi - lo, 0), 0)
            a = np.repeat(np.arange(len(s)), many)
            c = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many) + lo[a]
            begin, end = np.maximum(s[a], s[c] - offset), np.minimum(s[a] + n[a], s[c] + n[c] - offset)
            first, second = ref[a] + begin - s[a], ref[c] + begin + offset - s[c]
            on = (d[a] == d[c]) & (r[a] == r[c]) & (second == first + offset)
            keep = begin < end
            a, c, begin, end, first, second, on = (v[keep] for v in (a, c, begin, end, first, second, on))
            doc, rid = (b.column(name).to_numpy()[of[a]] for name in ("doc", "rid"))
            place = (begin - _wide(of[a], 0)).astype(np.int32)
            yield batch(PAIRS, doc, rid, need[a].astype(np.int32), place, (end - begin).astype(np.int32), d[a], r[a], first.astype(np.int32), pa.array(d[c], mask=on), r[c], second.astype(np.int32))

    return ranks.mapInArrow(run, PAIRS)


def rerank(pairs: DataFrame) -> DataFrame:
    """(doc, rid, need, i, n, ref_doc, ref_rid, ref_i): the rank of a pair is the first place that has it; unique pairs have none.

    Minima are combined before the shuffle, and only pairs that occur twice meet their positions.
    """
    going = pairs.where("d2 is null").selectExpr("doc", "rid", "need", "i", "n", "d1 ref_doc", "r1 ref_rid", "i1 ref_i")
    each = pairs.where("d2 is not null").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    each = each.selectExpr("doc", "rid", "need", "i + j as i", "d1", "r1", "i1 + j as i1", "d2", "r2", "i2 + j as i2")
    pair = ["d1", "r1", "i1", "d2", "r2", "i2"]
    least = each.groupBy(*pair).agg(F.min(F.struct("doc", "rid", "i")).alias("first"), F.count("*").alias("many")).where("many > 1")
    new = each.join(least, pair).selectExpr("doc", "rid", "need", "i", "1 as n", "first.doc ref_doc", "first.rid ref_rid", "first.i ref_i")
    return going.unionByName(new)


def settle(documents: DataFrame, ranks: list[tuple[int, DataFrame]], length: int, gram: int) -> DataFrame:
    """(doc, rid, settled, open): windows (start, n) in ranked spans, whose earlier place is known, and the anchors
    (key, start, n) with other windows."""
    spans = None
    for phrases, of in ranks:
        repeats = of.where("doc <> ref_doc or rid <> ref_rid or i <> ref_i").select("doc", "rid", "i", "n", F.lit(phrases).alias("phrases"))
        spans = repeats if spans is None else spans.unionByName(repeats)
    if spans is None:
        met = documents.withColumn("spans", F.expr("cast(null as array<struct<i: int, n: int, phrases: int>>)"))
    else:
        spans = spans.groupBy(F.col("doc").alias("d"), F.col("rid").alias("r")).agg(F.collect_list(F.struct("i", "n", "phrases")).alias("spans"))
        met = documents.join(spans, (F.col("doc") == F.col("d")) & (F.col("rid") == F.col("r")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, "anchors"):
            x, one, more = Lists(b.column("anchors"), "key", "i", "start", "n", "at"), Lists(b.column("runs"), "i", "n", "ref_doc", "ref_rid", "ref_i"), Lists(b.column("spans"), "i", "n", "phrases")
            doc, rid = (b.column(c).to_numpy() for c in ("doc", "rid"))
            own = (one["ref_doc"] == doc[one.of]) & (one["ref_rid"] == rid[one.of]) & (one["ref_i"] == one["i"])
            one = one.take(~own)
            of, i, n = (np.concatenate([p, q]) for p, q in ((one.of, more.of), (one["i"], more["i"]), (one["n"], more["n"])))
            phrases = np.concatenate([np.ones(len(one.of), np.int64), more["phrases"]])
            each = np.repeat(np.arange(len(n)), n)
            i = i[each] + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            place = _wide(x.of, x["i"])
            first, last = (np.searchsorted(place, _wide(of[each], v)) for v in (i, i + phrases[each]))
            lo, hi = _wide(of[each], x["at"][first]), _wide(of[each], x["at"][last] + gram - length + 1)
            good = hi > lo
            lo, hi = covered(lo[good], (hi - lo)[good], 1)
            # an anchor's windows without settled ones at both ends
            a = _wide(x.of, x["start"])
            e = a + x["n"]
            if len(lo):
                j = np.searchsorted(lo, a, "right") - 1
                a = np.where(j >= 0, np.maximum(a, hi[j]), a)
                j = np.searchsorted(lo, e, "left") - 1
                e = np.where((j >= 0) & (hi[j] >= e), np.minimum(e, lo[j]), e)
            left = a < e
            of = lo >> 33
            settled = listed(of, b.num_rows, "struct<start: int, n: int>", start=lo - (of << 33), n=hi - lo)
            rest = listed(x.of[left], b.num_rows, "struct<key: bigint, start: int, n: int>", key=x["key"][left], start=(a - _wide(x.of, 0))[left], n=(e - a)[left])
            yield pa.record_batch([b.column("doc"), b.column("rid"), settled, rest], ["doc", "rid", "settled", "open"])

    ddl = "doc long, rid long, settled array<struct<start: int, n: int>>, open array<struct<key: bigint, start: int, n: int>>"
    return met.select("doc", "rid", "anchors", "runs", "spans").mapInArrow(run, ddl)


def open_places(settled: DataFrame) -> DataFrame:
    """PLACES of the anchors that still have windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_parts(batches, "open"):
            x = Lists(b.column("open"), "key", "start", "n")
            if len(x.of):
                doc, rid = (b.column(c).to_numpy()[x.of] for c in ("doc", "rid"))
                yield from sliced(combined(x["key"], doc, rid, x["start"], x["n"]), 50_000)

    return settled.select("doc", "rid", "open").mapInArrow(run, PLACES)


def repeated_byte_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, frequent: int = FREQUENT) -> DataFrame:
    """(doc, rid, spans): runs (start, n) of positions whose next ``length`` bytes start earlier too."""
    gram = min(gram, length)
    scratch = Scratch(rows.sparkSession)
    documents = scratch.write(by_document(first_ranks(anchors(rows, length, gram)), length, gram), "anchors")
    most = documents.agg(F.max("need")).first()[0] or 1
    ranks: list[tuple[int, DataFrame]] = []
    now, phrases = documents.where("need > 1").select("doc", "rid", "runs"), 1
    while phrases < most:
        pairs = scratch.write(double(now, phrases), "pairs")
        phrases *= 2
        ranks.append((phrases, scratch.write(rerank(pairs), "ranks")))
        scratch.drop(pairs)
        runs = F.collect_list(F.struct("i", "n", "need", "ref_doc", "ref_rid", "ref_i")).alias("runs")
        now = ranks[-1][1].groupBy("doc", "rid").agg(runs, F.max("need").alias("need")).where(F.col("need") > phrases)
    settled = scratch.write(settle(documents, ranks, length, gram), "settled")
    scratch.drop(documents, *(of for _, of in ranks))
    parts = scratch.write(segments(rows, repeated_keys(open_places(settled)), Bytes(), length), "segments")
    again = repeated_spans(parts, Bytes(), length, gram, frequent)
    scratch.drop(parts)
    again = again.unionByName(settled.select("doc", "rid", F.explode("settled").alias("s")).select("doc", "rid", "s.*"))
    return again.groupBy("doc", "rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): what stays of every row's UTF-8 bytes.

    Null text: empty. Equal rows are one document, each reported; of rows that share a doc_id, those with different
    texts count as different documents. Empty table: no rows. Extra columns are ignored.
    """
    rows = identified(docs)
    found = repeated_byte_spans(rows, length, gram, frequent).withColumnsRenamed({"doc": "d", "rid": "r"})
    both = squeezed(rows).join(found, (F.col("doc") == F.col("d")) & (F.col("rid") == F.col("r")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        for b in batches:
            out = []
            for z, spans in zip(b.column("z"), b.column("spans")):
                data = unpack(z.as_py())
                kept, n_spans = data, 0
                if spans.is_valid:
                    lo, hi = covered(*runs_of(spans), length)
                    n_spans, edges = len(lo), [0, *np.stack([lo, hi], axis=1).ravel().tolist(), len(data)]
                    kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2]))
                out.append((len(data), len(data) - len(kept), n_spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = zip(*out) if out else ((), (), (), (), ())
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([b.column("doc"), *(pa.array(c, t) for c, t in zip(cols, kinds))], ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = both.select("doc", "z", "spans").mapInArrow(run, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn("doc_id", F.when(F.col("doc") > F.lit(-(1 << 63)), F.col("doc"))).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op1_suffix": op1_suffix}
#: A row per byte; strings of 100 bytes are told apart by their MD5.
ORACLES = {
    "op1_suffix": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n_bytes FROM d),
k AS (SELECT doc_id, unnest(range(0, n_bytes - 99)) AS pos, h FROM n WHERE n_bytes >= 100), m AS (SELECT doc_id, pos, md5_number(substr(h, 2 * pos + 1, 200)) AS win FROM k),
r AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS i FROM m) WHERE i > 1),
e AS (SELECT doc_id, pos, CASE WHEN lag(pos) OVER w >= pos - 100 THEN 0 ELSE 1 END AS new FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
i AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM e), s AS (SELECT doc_id, span, min(pos) AS lo, max(pos) + 100 AS hi FROM i GROUP BY 1, 2),
b AS (SELECT doc_id, hi AS lo, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY lo), n_bytes) AS hi FROM (SELECT doc_id, lo, hi, n_bytes FROM s JOIN n USING (doc_id) UNION ALL SELECT doc_id, -1, 0, n_bytes FROM n)),
t AS (SELECT doc_id, string_agg(substr(h, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS kept FROM b JOIN n USING (doc_id) GROUP BY 1), c AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(hi - lo) AS BIGINT) AS n_removed FROM s GROUP BY 1)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM n JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)"""
}
