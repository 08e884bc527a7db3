"""Packing documents into sequences of a fixed number of tokens with bounded memory.

Each task keeps a fixed number of open windows. A document goes to the window it fits best; where none fits and no
more may open, the fullest is filled with the first part of the document and leaves. Windows that are still open at
the end of a task are merged, largest first, in groups of bounded size.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

LENGTH = 2_048
END = 1
OPEN_WINDOWS = 32
#: A window is left short by fewer tokens than this rather than cutting a document for it.
LEAST_CUT = 16
MERGED_AT_ONCE = 4_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"


class Tokens:
    """Byte-level BPE ids of texts as little-endian 32-bit bytes, equal to those that the tokenizers library makes from
    the vocabulary's JSON file, which tests hold against whole tables.

    A text is cut before every single space between two other characters, where the vocabulary's own splitting
    always cuts too, and the ids of each piece are remembered; other texts are encoded whole.
    """

    MOST = 250_000
    #: Texts with a longer run of one kind of character go to the slower library, as the faster one recurses over it.
    RUN = 50_000
    RUNS = re.compile(r"\s+|\w+|[^\s\w]+")
    #: Longer pieces are encoded each time, which bounds what is remembered in bytes.
    REMEMBERED = 48

    def __init__(self, json_path: str, ranks_path: str, pattern: str, special: str = "<|endoftext|>"):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.special, self.slow = json_path, special, None
        fast, short = self.fast, self.REMEMBERED

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if not piece or piece[0].isspace() or piece[-1].isspace():
                    raise ValueError
                out = np.array(fast.encode_ordinary(" " + piece), "<u4").tobytes()
                if len(piece) <= short:
                    self[piece] = out
                return out

        self.pieces = Pieces()

    def slowly(self, text: str) -> bytes:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.special in text:  # one id of its own
            return self.slowly(text)
        if len(text) > self.RUN and any(m.end() - m.start() > self.RUN for m in self.RUNS.finditer(text)):
            return self.slowly(text)
        if len(self.pieces) > self.MOST:
            self.pieces.clear()
        first, *rest = text.split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise ValueError
            tail = b"".join(map(self.pieces.__getitem__, rest))
        except ValueError:
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(first), "<u4").tobytes() + tail


_TOKENS: dict[tuple, Tokens] = {}


def tokens(vocabulary: tuple[str, str, str]) -> Tokens:
    if vocabulary not in _TOKENS:
        _TOKENS[vocabulary] = Tokens(*vocabulary)
    return _TOKENS[vocabulary]


def byte_bpe() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class Windows:
    """The open windows of one task. ``place`` gives the windows that leave, as (number, pieces)."""

    def __init__(self, length: int, most: int, least_cut: int):
        self.length, self.most, self.least_cut, self.next = length, most, least_cut, 0
        self.open: list[list] = []  # [free, number, pieces]

    def place(self, start: int, n: int, piece) -> Iterator[tuple[int, list]]:
        """Place n ids from ``start`` on; ``piece(start, n)`` makes what is kept of a part of them."""
        while n:
            if n >= self.length:
                yield self.next, [(0, piece(start, self.length))]
                self.next, start, n = self.next + 1, start + self.length, n - self.length
                continue
            fits = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if fits is None and len(self.open) < self.most:
                fits = [self.length, self.next, []]
                self.next += 1
                self.open.append(fits)
            if fits is not None:
                fits[2].append((self.length - fits[0], piece(start, n)))
                fits[0] -= n
                if not fits[0]:
                    self.open.remove(fits)
                    yield fits[1], fits[2]
                return
            full = min(self.open, key=lambda w: w[0])
            self.open.remove(full)
            if (cut := full[0]) >= self.least_cut:
                full[2].append((self.length - cut, piece(start, cut)))
                start, n = start + cut, n - cut
            yield full[1], full[2]


def placed(docs: DataFrame, vocabulary: tuple[str, str, str], length: int, open_windows: int, end: int = END) -> DataFrame:
    """Rows of PIECES: where each task put its documents' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 32
        encode, windows, last = tokens(vocabulary).encode, Windows(length, open_windows, LEAST_CUT), np.array([end], "<u4").tobytes()
        names = [x.split()[0] for x in PIECES.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.bool_()]
        rows: list[tuple] = []

        def keep(left: Iterator[tuple[int, list]], still_open: bool) -> None:
            for number, pieces in left:
                rows.extend((*p, base + number, offset, still_open) for offset, p in pieces)

        def batch() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = encode(text.as_py() or "") + last
                n = len(ids) // 4
                piece = lambda s, k: (doc_id, s, k, zlib.crc32(ids[4 * s : 4 * (s + k)]), n)  # noqa: E731, B023
                keep(windows.place(0, n, piece), False)
            if rows:
                yield batch()
        keep(((w[1], w[2]) for w in windows.open), True)
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def merged(windows: DataFrame, n: int, length: int) -> DataFrame:
    """(window, fill) -> (window, sequence_id, base): first fit, largest first, in groups of about MERGED_AT_ONCE."""
    groups = max(1, -(-n // MERGED_AT_ONCE))

    def run(key: tuple, w: pd.DataFrame) -> pd.DataFrame:
        w = w.sort_values(["fill", "window"], ascending=[False, True])
        fills: list[int] = []
        at, base = [], []
        for fill in w["fill"].tolist():
            i = next((i for i, f in enumerate(fills) if f + fill <= length), len(fills))
            if i == len(fills):
                fills.append(0)
            at.append(i), base.append(fills[i])
            fills[i] += fill
        ids = (1 << 62) + (int(key[0]) << 32) + np.array(at, np.int64)
        return pd.DataFrame({"window": w["window"].to_numpy(), "sequence_id": ids, "base": np.array(base, np.int64)})

    dealt = windows.withColumn("g", F.pmod(F.xxhash64("window"), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(run, "window long, sequence_id long, base long")


def pack(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, length: int = LENGTH, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece of a document.

    A document is its ids and an end id; null text is empty, so every row gives one id at least. Equal rows are
    packed each. Empty table: no rows. Extra columns are ignored. Tasks must see the same rows in the same order
    when run again, as file scans do.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.write(placed(docs, vocabulary or byte_bpe(), length, open_windows), "pieces")
    left = pieces.where("open").groupBy("window").agg(F.sum("length").alias("fill"))
    moves = merged(left, left.count(), length)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    closed = pieces.where(~F.col("open")).withColumnRenamed("window", "sequence_id").select(*columns)
    moved = pieces.where("open").join(moves, "window").withColumn("offset", F.col("offset") + F.col("base")).select(*columns)
    return closed.union(moved)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
