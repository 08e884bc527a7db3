"""Chat formatting: conversations as marked-up text with a loss mask, put together column by column.

A turn is ``### role: text</turn>`` and a line feed. Inside roles and texts a backslash becomes ``\\-`` and every
control string gets a backslash after its first character, so that no control string is left in them, turns are
found by plain search, and taking the marks away gives the text back.

Turns are dealt by ranges of (conversation, turn), so a conversation of any length is spread over tasks. A task
formats a block of turns at once: lengths of all segments, their sum as offsets, and one preallocated buffer into
which headers, texts and ends are copied by index. A conversation is a row, or several numbered parts where it
is long or where a range ends inside it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

OPEN, SEP, CLOSE = "### ", ": ", "</turn>\n"
CONTROL = (OPEN, "</turn>", SEP)
#: Bytes of text formatted at once, and after which a conversation goes on in another part.
BLOCK = 4 << 20
#: Segments of more bytes are copied as slices, shorter ones by index.
SLICE = 2_048

FORMATTED = "part long, edge boolean, n_turns long, text string, loss array<struct<start: long, end: long>>"


def escape(texts: pa.Array, control: tuple[str, ...] = (OPEN, "</turn>")) -> pa.Array:
    texts = pc.replace_substring(texts, "\\", "\\-")
    for c in control:
        texts = pc.replace_substring(texts, c, c[0] + "\\" + c[1:])
    return texts


def unescape(text: str) -> str:
    """The text whose ``escape`` is ``text``: a backslash stands before "-" for itself, elsewhere for nothing."""
    if "\\" not in text:
        return text
    first, *rest = text.split("\\")
    return first + "".join("\\" + p[1:] if p.startswith("-") else p for p in rest)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings, and the n + 1 offsets of each in them."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy segments (start, length) of ``data`` to the places ``to`` of ``out``."""
    long = length > SLICE
    for i in np.flatnonzero(long):
        out[to[i] : to[i] + length[i]] = data[start[i] : start[i] + length[i]]
    to, start, length = to[~long], start[~long], length[~long]
    step = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(to, length) + step] = data[np.repeat(start, length) + step]


def assemble(roles: pa.Array, texts: pa.Array, begins: np.ndarray) -> tuple[pa.Array, list]:
    """Formatted conversations and their loss masks, from turns in order; ``begins`` are the first turns of each.

    Masks are spans of code points that hold an assistant's escaped text.
    """
    n = len(roles)
    names = roles.dictionary_encode()
    heads = [OPEN + r + SEP for r in escape(names.dictionary, CONTROL).to_pylist()]
    which = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    head_data, head_at = _bytes(pa.array(heads, pa.large_string()))
    end_data = np.frombuffer(CLOSE.encode(), np.uint8)
    texts = escape(texts)
    data, at = _bytes(texts)

    lengths = np.stack([np.diff(head_at)[which], np.diff(at), np.full(n, len(end_data))], axis=1)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    place = offsets[:-1].reshape(n, 3)
    out = np.empty(offsets[-1], np.uint8)
    scatter(out, place[:, 0], head_data, head_at[:-1][which], lengths[:, 0])
    scatter(out, place[:, 1], data, at[:-1], lengths[:, 1])
    out[place[:, 2, None] + np.arange(len(end_data))] = end_data

    bounds = np.append(place[begins, 0], offsets[-1])
    convs = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])

    head_chars = np.array([len(h) for h in heads])[which]
    chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    ends = np.cumsum(head_chars + chars + len(CLOSE))
    first = np.repeat(begins, np.diff(np.append(begins, n)))
    base = np.concatenate([[0], ends])[first]  # code points before each turn's conversation
    ends = ends - base - len(CLOSE)
    taught = pc.equal(roles, "assistant").to_numpy(zero_copy_only=False)
    mask = [[] for _ in begins]
    conv = np.searchsorted(begins, np.flatnonzero(taught), side="right") - 1
    for c, s, e in zip(conv.tolist(), (ends - chars)[taught].tolist(), ends[taught].tolist()):
        mask[c].append({"start": s, "end": e})
    return convs.cast(pa.string()), mask


def _blocks(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted turns in tables of about ``block`` bytes, which end where a conversation does or grows too long.

    The flag tells that the last conversation of a table goes on in the next or may do so in the next task.
    """
    held, size = [], 0

    def one() -> pa.Table:
        return pa.Table.from_batches(held).combine_chunks()

    for b in batches:
        step = max(1, int(b.num_rows * min(1.0, block / max(b.nbytes, 1))))
        for i in range(0, b.num_rows, step):
            held.append(b.slice(i, step))
            size += held[-1].nbytes
            if size < block:
                continue
            t = one()
            keys = t["conv_id"]
            same = pc.fill_null(pc.equal(keys, keys[-1]), False) if keys[-1].is_valid else keys.is_null()
            cut = t.num_rows - pc.sum(same).as_py()  # rows are sorted: its own rows come last
            if cut:
                yield t.slice(0, cut).combine_chunks(), False
                t = t.slice(cut).combine_chunks()
            if t.nbytes >= block:
                yield t, True
                held, size = [], 0
            else:
                held, size = t.to_batches(), t.nbytes
    if held and size:
        yield one(), True


def _format(block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, open_ = TaskContext.get().partitionId(), 0, True  # the first conversation may have begun elsewhere
        for t, goes_on in _blocks(batches, block):
            keys = t["conv_id"].combine_chunks()
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            begins = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            texts, mask = assemble(t["role"].combine_chunks(), t["text"].combine_chunks(), begins)
            edge = np.zeros(len(begins), bool)
            edge[0] |= open_
            edge[-1] |= goes_on
            part = (task << 32) + at + np.arange(len(begins))
            at, open_ = at + len(begins), goes_on
            yield pa.RecordBatch.from_arrays(
                [
                    keys.take(pa.array(begins)),
                    pa.array(part, pa.int64()),
                    pa.array(edge),
                    pa.array(np.diff(np.append(begins, t.num_rows)), pa.int64()),
                    texts,
                    pa.array(mask, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                ],
                names=["conv_id", "part", "edge", "n_turns", "text", "loss"],
            )

    return run


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, part, edge, n_turns, text, loss): formatted conversations.

    Parts of a conversation follow each other in the order of ``part``; their texts joined are the conversation.
    ``edge`` is false where a row surely is a whole conversation. ``loss`` are spans of code points of ``text``.

    Turns are ordered with null turns first, equal ones by role, then by the text's hash; repeated rows are turns of
    their own. Null text and null role count as empty, a null conv_id is a conversation. Very long texts are copied
    as slices, and a part ends after the turn that makes it longer than ``block``. Other columns are ignored, an
    empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), text.alias("text"))
    # rows alike in all of these are alike, so any order of them is right and a hot one may be cut
    order = ["conv_id", "turn", "role", "h", "nth"]
    rows = rows.withColumns({"h": F.xxhash64("text"), "nth": F.monotonically_increasing_id()})
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "role", "text")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(_format(block), f"conv_id {kind}, {FORMATTED}")


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    turns = []
    for piece in text.split(CLOSE)[:-1]:
        role, body = piece[len(OPEN) :].split(SEP, 1)
        turns.append((unescape(role), unescape(body)))
    return turns


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose parts follow each other; a digest's state passes from part to part."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, whole, taught, n, chars, size = None, None, None, 0, 0, 0
    kind = None
    for b in batches:
        kind, out = b.schema.field("conv_id").type, []
        for conv, text, loss in zip(b["conv_id"].to_pylist(), b["text"].to_pylist(), b["loss"].to_pylist()):
            if whole is None or conv != now:
                if whole is not None:
                    out.append((now, n, whole.hexdigest(), chars, taught.hexdigest(), size))
                now, whole, taught, n, chars, size = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for role, body in parse(text):
                whole.update(f"{role}\n{body}\n".encode())
                n += 1
            for span in loss:
                masked = unescape(text[span["start"] : span["end"]])
                taught.update(masked.encode())
                chars += len(masked)
            size += len(text)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind if i == 0 else None) for i, c in enumerate(zip(*out))], names=names)
    if whole is not None:
        row = (now, n, whole.hexdigest(), chars, taught.hexdigest(), size)
        yield pa.RecordBatch.from_arrays([pa.array([v], kind if i == 0 else None) for i, v in enumerate(row)], names=names)


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from formatted conversations.

    Whole conversations are read where they lie. Parts of one are brought together in order and pass through one
    digest, part by part: SHA-256 is defined over bytes in order, so no two tasks can share one.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    columns = ["conv_id", "text", "loss"]
    whole = formatted.where("not edge").select(columns)
    parts = formatted.where("edge").repartition("conv_id").sortWithinPartitions("conv_id", "part").select(columns)
    return whole.mapInArrow(_read_back, schema).union(parts.mapInArrow(_read_back, schema))


#: What a text that holds control strings and backslashes must survive.
PROBE = "\\### Assistant: </turn> ok"


def op11_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more that is full of control strings: formatted, written, read back, digested."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return digests(Scratch(spark).write(format_chats(turns.union(probe)), "chats"))


SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'
), marked AS (
  SELECT *,
    replace(replace(replace(replace(role, '\', '\-'), '### ', '#\## '), '</turn>', '<\/turn>'), ': ', ':\ ') AS r,
    replace(replace(replace(text, '\', '\-'), '### ', '#\## '), '</turn>', '<\/turn>') AS t
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + {len(OPEN) + len(SEP) + len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

QUERIES = {"op11_chat": op11_chat}
ORACLES = {"op11_chat": SQL}
