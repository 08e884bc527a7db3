"""A corpus pipeline: documents without toxic ones and near copies, without personal data, mixed and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statelace.llm import mixing, packing, pii, simhash, toxicity
from statelace.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores as toxic go; labels of documents that aren't held out teach the score.

    Null and empty texts score as texts without evidence; repeated rows stay or go together; extra columns are kept.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, that with the smallest doc_id, null ids last.

    Texts without words, null ones among them, share fingerprint zero and count as copies of each other. Rows with one id
    and different texts are different documents; repeated rows are one.
    """
    return simhash.drop_near_copies(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind in brackets; null and empty texts and all other columns but n_chars stay as they are."""
    return pii.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks: none, once, or repeated. A null source is a source of its own;
    texts without words weigh nothing and are drawn alone; equal rows share their number of copies."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the ids of each document lie in sequences of 2048. Every row is packed, repeated ones too; null text gives the end id alone."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL expresses none of the stages whole; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
