"""Repeated passages of words: windows that also start earlier are removed, exactly, by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .superkmer import FREQUENT, Words, candidates, covered, identified, repeated_spans, runs_of, segments, squeezed

WINDOW = 20
GRAM = 6


def repeated_word_spans(rows: DataFrame, window: int = WINDOW, gram: int = GRAM, frequent: int = FREQUENT) -> DataFrame:
    """(doc, rid, spans): runs (start, n) of windows that start earlier too, for ``identified`` rows that have some."""
    scratch = Scratch(rows.sparkSession)
    found = candidates(rows, Words(), window, gram)
    parts = scratch.write(segments(rows, found, Words(), window), "segments")
    again = repeated_spans(parts, Words(), window, gram, frequent)
    scratch.drop(parts)
    return again.groupBy("doc", "rid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def remove_repeated_words(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, frequent: int = FREQUENT
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): kept words of every row joined by one space.

    Null or blank text: no words. Equal rows are one document, each reported. Empty table: no rows. Extra columns
    are ignored. Of rows that share a doc_id, those with different texts count as different documents.
    """
    rows = identified(docs)
    found = repeated_word_spans(rows, window, gram, frequent).withColumnsRenamed({"doc": "d", "rid": "r"})
    both = squeezed(rows).join(found, (F.col("doc") == F.col("d")) & (F.col("rid") == F.col("r")), "left").drop("d", "r", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        for b in batches:
            out = []
            for z, spans in zip(b.column("z"), b.column("spans")):
                words = unpack(z.as_py()).split()
                kept = words
                if spans.is_valid:
                    lo, hi = covered(*runs_of(spans), window)
                    gone = np.zeros(len(words) + 1, np.int64)
                    gone[lo] += 1
                    gone[hi] -= 1
                    stays = np.cumsum(gone[:-1]) == 0
                    kept = [w for w, k in zip(words, stays.tolist()) if k]
                kept_text = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(kept_text).hexdigest(), kept_text.decode()))
            n, gone, sha, kept = zip(*out) if out else ((), (), (), ())
            yield pa.record_batch({"doc": b.column("doc"), "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept, pa.string())})

    out = both.select("doc", "z", "spans").mapInArrow(run, "doc long, n_words long, n_removed long, kept_sha256 string, kept string")
    return out.withColumn("doc_id", F.when(F.col("doc") > F.lit(-(1 << 63)), F.col("doc"))).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op10_substring": op10_substring}
#: A row per word and per window: quadratic in nothing, but a window is a string of twenty words.
ORACLES = {
    "op10_substring": r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
s AS (SELECT doc_id, unnest(range(1, len(ws) - 18)) AS pos, ws FROM d WHERE len(ws) >= 20), k AS (SELECT doc_id, pos, list_aggregate(ws[pos:pos + 19], 'string_agg', ' ') AS win FROM s),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) > 1 AS again FROM k),
g AS (SELECT w.doc_id, w.pos, word, coalesce(bool_or(again) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), false) AS gone FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.pos = w.pos),
t AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM g GROUP BY 1)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
}
