"""SimHash near-duplicates: 64-bit fingerprints and a binary-trie self-join under a Hamming budget.

Distinct fingerprints are dealt into sub-tries: with e bits of budget and b > e blocks of bits, two
fingerprints within the budget agree on b - e blocks at least, so for every choice of b - e blocks the
fingerprints that agree there form one sub-trie, and each link lies inside some sub-trie. Sub-tries are walked
as node pairs: both nodes descend to their next branching bit, the bits in which their common prefixes differ
are added up, a pair over the budget is dropped with all that hangs below it, and a pair that can't exceed the
budget any more links whole ranges at once. What leaves a task is a spanning forest of the links, never all pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, connected_components, table

BUDGET = 4
WIDTH = 4
#: A sub-trie with more fingerprints is cut into chunks, and every two chunks meet in a task of their own.
CHUNK = 20_000
#: Sub-tries should hold few unrelated fingerprints: blocks are added until this many share one by chance at most.
BY_CHANCE = 8


def text_fingerprint(text: str | None, width: int = WIDTH) -> int:
    """SimHash of the word shingles of a text, A-Z lower-cased; 0 if it has no words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    h = np.array([xxh64_intdigest(joined[s:e], 42) for s, e in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        counts += np.unpackbits(h[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view("<u8")[0])


def simhash(docs: DataFrame, width: int = WIDTH, *more: Column) -> DataFrame:
    """(doc_id, fp, then ``more``, bigints with names): one row per row of ``docs``. Null and blank texts have fingerprint 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
    others = rows.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([text_fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fp.view(np.int64))} | {c: b.column(c) for c in others})

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in ("doc_id", "fp", *others)))


def _bit_length(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x |= x >> np.uint64(s)
    return np.bitwise_count(x).astype(np.int64)


def _shift(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.where(by >= 64, np.uint64(0), x >> np.minimum(by, 63).astype(np.uint64))


def _branch(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """First index in each sorted range whose bit ``depth - 1`` is set."""
    lo, hi, bit = lo.copy(), hi.copy(), np.maximum(depth - 1, 0).astype(np.uint64)
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        on = ((fp[np.minimum(mid, len(fp) - 1)] >> bit) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & on, mid, hi)
        lo = np.where(open_ & ~on, mid + 1, lo)
    return lo


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every index of every range, and the range it is from."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[which], which


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) of each set that links join, without the least ones."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            member = np.flatnonzero(label != np.arange(n))
            return member, label[member]
        label = new


def trie_links(fp: np.ndarray, lo: np.ndarray, hi: np.ndarray, budget: int, step: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links between fingerprints of one range that differ in ``budget`` bits at most.

    ``fp``: distinct and sorted within each range [lo, hi); links are index pairs.
    """
    todo = [(lo, hi, lo, hi)]
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    held = 0
    while todo:
        a, a_end, b, b_end = todo.pop()
        if len(a) > step:
            todo.append((a[step:], a_end[step:], b[step:], b_end[step:]))
            a, a_end, b, b_end = a[:step], a_end[:step], b[:step], b_end[:step]
        own = a == b
        deep_a, deep_b = _bit_length(fp[a] ^ fp[a_end - 1]), _bit_length(fp[b] ^ fp[b_end - 1])
        depth = np.maximum(deep_a, deep_b)
        errors = np.bitwise_count(_shift(fp[a] ^ fp[b], depth)).astype(np.int64)
        keep = (errors <= budget) & ~(own & (a_end - a == 1))
        whole = keep & (errors + depth <= budget)
        if whole.any():
            for one, lo_, hi_ in ((b, a, a_end), (a, b, b_end)):
                i, of = _ranges(lo_[whole], hi_[whole])
                left.append(i), right.append(one[whole][of])
                held += len(i)
        if held > 1 << 21:
            x, y = forest(np.concatenate(left), np.concatenate(right), len(fp))
            left, right, held = [x], [y], len(x)
        go = keep & ~whole
        if not go.any():
            continue
        own, a, a_end, b, b_end, deep_a, deep_b, depth = (x[go] for x in (own, a, a_end, b, b_end, deep_a, deep_b, depth))
        mid_a = np.where(deep_a == depth, _branch(fp, a, a_end, depth), a_end)
        mid_b = np.where(deep_b == depth, _branch(fp, b, b_end, depth), b_end)
        halves_a, halves_b = ((a, mid_a), (mid_a, a_end)), ((b, mid_b), (mid_b, b_end))
        parts = []
        for i, j in itertools.product(range(2), range(2)):
            (p, q), (r, s) = halves_a[i], halves_b[j]
            some = (p < q) & (r < s) & ~(own & (i > j))
            parts.append((p[some], q[some], r[some], s[some]))
        todo.append(tuple(np.concatenate(x) for x in zip(*parts)))
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return forest(np.concatenate(left), np.concatenate(right), len(fp))


def _block_masks(n_blocks: int, budget: int) -> list[int]:
    edges = [round(i * 64 / n_blocks) for i in range(n_blocks + 1)]
    bits = [((1 << (hi - lo)) - 1) << lo for lo, hi in itertools.pairwise(edges)]
    masks = [sum(c) for c in itertools.combinations(bits, n_blocks - budget)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def n_blocks(n: int, budget: int) -> int:
    """Blocks of bits for n fingerprints; all counts give the same links."""
    b = budget + 1
    while b < budget + 4 and n >> (64 * (b - budget) // b) > BY_CHANCE:
        b += 1
    return b


def hamming_links(fps: DataFrame, n: int, budget: int = BUDGET, chunk: int = CHUNK) -> DataFrame:
    """(a, b): spanning links between distinct fingerprints ``fp`` within the budget."""
    masks = _block_masks(n_blocks(n, budget), budget)
    keys: Column = F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("t")).select("t.c", "t.k", "fp")
    big = Scratch(fps.sparkSession).write(rows.groupBy("c", "k").agg(F.count("*").alias("n")).where(F.col("n") > chunk), "large")
    rows = rows.withColumns({"i": F.lit(0), "j": F.lit(0)})
    if not big.isEmpty():
        cut = F.greatest(F.ceil(F.col("n") / chunk), F.lit(1)).cast("int")
        cut_rows = rows.drop("i", "j").join(big, ["c", "k"], "left").withColumn("g", F.coalesce(cut, F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("g")).cast("int")
        cut_rows = cut_rows.withColumn("m", mine).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        cut_rows = cut_rows.where((F.col("g") == 1) | (F.col("o") != F.col("m")))
        rows = cut_rows.select("c", "k", "fp", F.least("m", "o").alias("i"), F.greatest("m", "o").alias("j"))
    by = ["c", "k", "i", "j"]
    rows = rows.repartition(*by).sortWithinPartitions(*by)

    def links(names: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, names))
        names, fp = names[order], fp[order]
        edge = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        ends = np.concatenate([edge[1:], [len(names)]])
        many = ends - edge > 1
        a, b = trie_links(fp, edge[many], ends[many], budget) if many.any() else (np.zeros(0, int), np.zeros(0, int))
        return pa.record_batch({"a": pa.array(fp[a].view(np.int64)), "b": pa.array(fp[b].view(np.int64))})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(np.stack([b.column(c).to_numpy().astype(np.int64) for c in (*by, "fp")]))
            size += b.num_rows
            if size < 100_000:
                continue
            rows = np.concatenate(held, axis=1)
            new = np.flatnonzero((rows[:4, 1:] != rows[:4, :-1]).any(axis=0))
            if not len(new):
                held = [rows]
                continue
            done = new[-1] + 1  # the last sub-trie may go on in the next batch
            names = np.concatenate([[0], np.cumsum((rows[:4, 1:done] != rows[:4, : done - 1]).any(axis=0))])
            yield links(names, rows[4, :done])
            held, size = [rows[:, done:]], rows.shape[1] - done
        if held and size:
            rows = np.concatenate(held, axis=1)
            names = np.concatenate([[0], np.cumsum((rows[:4, 1:] != rows[:4, :-1]).any(axis=0))])
            yield links(names, rows[4])

    return rows.mapInArrow(run, "a long, b long")


def _named(rows: DataFrame, least: Column, budget: int, chunk: int) -> DataFrame:
    """(fp, least, component): every fingerprint of ``rows`` with ``least`` over its rows and the smallest fingerprint its links reach."""
    scratch = Scratch(rows.sparkSession)
    nodes = scratch.write(rows.groupBy("fp").agg(least.alias("least")), "nodes")
    links = hamming_links(nodes.select("fp"), nodes.count(), budget, chunk)
    parts = connected_components(links)
    named = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    named = scratch.write(named, "named")
    scratch.drop(nodes)
    return named


def simhash_classes(docs: DataFrame, budget: int = BUDGET, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, fp, component_id): every row with its fingerprint and the smallest doc_id its links reach.

    Empty table: no rows. Repeated rows stay. A null doc_id is never the smallest of others; a class with only
    such rows has a null component_id. Extra columns are ignored.
    """
    rows = Scratch(docs.sparkSession).write(simhash(docs, width), "fingerprints")
    named = _named(rows, F.min("doc_id"), budget, chunk)
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id")
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, budget: int = BUDGET, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """One row of every class stays, that with the smallest doc_id, with all its columns.

    Null ids come last, and among rows with one id the least hash of the text decides. Classes are told apart by
    their fingerprints, as several may have only null ids or share an id.
    """
    key = ["_k", "_h", "_g"]  # two hashes of the text: many texts may have a null id
    hashes = (F.xxhash64(F.col("text").cast("string")).alias("_h"), F.xxhash64(F.lit(1), F.col("text").cast("string")).alias("_g"))
    rows = Scratch(docs.sparkSession).write(simhash(docs, width, *hashes), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id").alias("_k"), "_h", "_g"))
    named = _named(rows, first, budget, chunk)
    keep = named.groupBy("component").agg(F.min("least").alias("_keep")).select("_keep.*")
    # rows with one id and text become one before they meet the keys, so copies don't gather in a task
    same = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_k"), *hashes).groupBy(*key).agg(F.first("row").alias("row"))
    match = [same[c].eqNullSafe(keep[c]) for c in key]
    return same.join(keep, match[0] & match[1] & match[2], "left_semi").select("row.*")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = simhash_classes(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash": op9_simhash}
ORACLES: dict[str, str] = {}
