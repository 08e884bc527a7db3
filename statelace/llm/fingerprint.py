"""Canonical exact digests of documents.

A text is canonical after compatibility composition, full case folding and white-space folding. Its digest
is two chained 64-bit xxhashes; texts that share a digest are compared byte by byte, and those that differ
get a rank after the digest, so equal fingerprints always mean equal canonical texts.

Everything runs in built-in DataFrame functions; normalisation and case folding call the ICU library that
Spark itself ships, through ``java_method``.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, table

#: Up to so many digests (16 bytes each) are broadcast; beyond that they are joined by shuffle.
BROADCAST_DIGESTS = 500_000
ROWS_PER_RANGE = 2_000
MAX_RANGES = 8_192


def _icu(kind: str, method: str, text: Column) -> Column:
    return F.java_method(F.lit(f"com.ibm.icu.{kind}"), F.lit(method), text, F.lit(True))


def canonical(text: Column) -> Column:
    """Canonical form of a text; null counts as empty."""
    composed = _icu("text.Normalizer", "compose", F.coalesce(text, F.lit("")))
    folded = _icu("text.Normalizer", "compose", _icu("lang.UCharacter", "foldCase", composed))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def digest(canon: Column, bits: int = 64) -> Column:
    """(h1, h2) of a canonical text. Fewer bits than 64 are for tests of the byte comparison."""
    cut = 64 - bits
    return F.struct(
        F.shiftrightunsigned(F.xxhash64(canon), cut).alias("h1"),
        F.shiftrightunsigned(F.xxhash64(F.lit("second"), canon), cut).alias("h2"),
    )


def _hex(h: Column, rank: Column) -> Column:
    wide = F.concat(F.lpad(F.lower(F.hex(h["h1"])), 16, "0"), F.lpad(F.lower(F.hex(h["h2"])), 16, "0"))
    return F.when(rank > 0, F.concat(wide, F.lit("-"), rank.cast("string"))).otherwise(wide)


def _collisions(texts: DataFrame) -> DataFrame:
    """(h, canon) -> (h, canon, rank > 0) for digests that different canonical texts share."""
    distinct = texts.select("h", "canon").distinct()
    shared = distinct.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    by = Window.partitionBy("h").orderBy("canon")
    return distinct.join(shared, "h").withColumn("rank", F.row_number().over(by) - 1)


def _meet(texts: DataFrame, digests: DataFrame, n: int) -> DataFrame:
    return texts.join(F.broadcast(digests) if n <= BROADCAST_DIGESTS else digests, "h")


def fingerprints(docs: DataFrame, text: str = "text", bits: int = 64) -> DataFrame:
    """Adds ``fingerprint`` to the rows of ``docs``, in place of a column of that name.

    Null texts count as empty, repeated rows stay, an empty table gives no rows; other columns are kept whatever their names.
    """
    docs = docs.drop("fingerprint")
    spark = docs.sparkSession
    named = docs.select(F.struct("*").alias("row"), canonical(F.col(text)).alias("canon"))
    hashed = named.withColumn("h", digest(F.col("canon"), bits))
    scratch = Scratch(spark)
    many = scratch.write(hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "digests")
    clash = scratch.write(_collisions(_meet(hashed, many, many.count())), "collisions")
    if clash.isEmpty():
        out = hashed.withColumn("rank", F.lit(0))
    else:
        out = hashed.join(clash, ["h", "canon"], "left")
    return out.select("row.*", _hex(F.col("h"), F.coalesce("rank", F.lit(0))).alias("fingerprint"))


def in_id_ranges(docs: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(part, k, text, last) with each range of doc_id in one ``part``, closed by the first row of the next range.

    Ranges are cut at quantiles of doc_id over all rows, so parts hold like numbers of rows whatever the ids.
    Rows are in the order of doc_id (null first), then text; the last range is closed by the very first row.
    """
    rows = docs.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    n = rows.count()
    parts = max(1, min(MAX_RANGES, n // rows_per_range))
    if parts > 1:
        points = [i / parts for i in range(1, parts)]
        cuts = rows.agg(F.percentile_approx("k", points, 10 * parts).alias("c")).first()["c"]
    else:
        cuts = []
    cuts = sorted(set(cuts))
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    if cuts:
        bounds = F.array(*map(F.lit, cuts))
        part = F.aggregate(
            F.array(*map(F.lit, steps)),
            F.lit(0),
            lambda i, s: F.when((i + s <= len(cuts)) & (F.get(bounds, i + s - 1) <= F.col("k")), i + s).otherwise(i),
        )
    else:
        part = F.lit(0)
    rows = rows.withColumn("part", part)
    lows = rows.groupBy("part").agg(F.min("k").alias("k"))  # a row per range: at most MAX_RANGES
    firsts = rows.join(F.broadcast(lows), ["part", "k"]).groupBy("part", "k").agg(F.min("text").alias("text"))
    before = F.lag("part").over(Window.orderBy("part"))
    top = F.max("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    closing = firsts.select(F.coalesce(before, top).alias("part"), F.lit(None).cast("long").alias("doc_id"), "k", "text")
    cols = ["part", "doc_id", "k", "text"]
    return rows.select(*cols, F.lit(0).alias("last")).union(closing.select(*cols, F.lit(1).alias("last")))


def edited_documents(docs: DataFrame, bits: int = 64, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Each document with its digest, its edited text and the next document's digest.

    The edit replaces the last floor(n/2) code points by the first as many of the next document in the order
    of doc_id; after the last comes the first (a lone document is its own next one). One shuffle moves texts.
    """
    rows = in_id_ranges(docs, rows_per_range).withColumn("canon", canonical(F.col("text")))
    rows = rows.withColumn("h", digest(F.col("canon"), bits)).drop("canon")
    order = Window.partitionBy("part").orderBy("last", "k", "text")
    rows = rows.select(
        "*",
        F.row_number().over(order).alias("rn"),
        F.lead("text").over(order).alias("after"),
        F.lead("h").over(order).alias("next_h"),
    ).where("last = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    keep = F.col("n_chars").cast("int") - half
    return rows.withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), keep), F.substring("after", F.lit(1), half))
    )


def fingerprint_pairs(docs: DataFrame, bits: int = 64, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are (1.0 equal, 0.0 not).

    Digests of all texts are grouped first; only texts whose digest occurs more than once are compared.
    Empty table: no rows. Null text: empty. Repeated rows: one result each. Extra columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    base = edited_documents(docs, bits, rows_per_range)
    full = base.withColumn("edited_canon", canonical(F.col("edited"))).withColumn("eh", digest(F.col("edited_canon"), bits))
    slim = scratch.write(
        full.select("part", "rn", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "h", "eh", "next_h"),
        "digests",
    )
    every = slim.select(F.explode(F.array("h", "eh")).alias("h"))
    many = scratch.write(every.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    texts = base.select("part", "rn", F.explode(F.array("text", "edited")).alias("t"))
    texts = texts.withColumn("canon", canonical(F.col("t"))).withColumn("h", digest(F.col("canon"), bits))
    clash = scratch.write(_collisions(_meet(texts, many, many.count())), "collisions")
    out = slim.withColumns({c: F.lit(0) for c in ("r", "er", "nr")})
    if not clash.isEmpty():  # different texts under one digest: tell them apart by their rank
        clash = clash.select("h", "canon", "rank")
        ranked = base.select(
            "part", "rn", canonical(F.col("text")).alias("c"), canonical(F.col("edited")).alias("ec"), canonical(F.col("after")).alias("nc")
        )
        out = slim.join(ranked, ["part", "rn"])
        for h, c, r in (("h", "c", "r"), ("eh", "ec", "er"), ("next_h", "nc", "nr")):
            side = clash.select(F.col("h").alias(h), F.col("canon").alias(c), F.col("rank").alias(r))
            out = out.join(side, [h, c], "left").withColumn(r, F.coalesce(r, F.lit(0)))
    same = lambda h, r: ((F.col("h") == F.col(h)) & (F.col("r") == F.col(r))).cast("double")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _hex(F.col("h"), F.col("r")).alias("fingerprint"),
        _hex(F.col("eh"), F.col("er")).alias("edited_fingerprint"),
        same("eh", "er").alias("near_edited"),
        same("next_h", "nr").alias("near_next"),
    )


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(table(spark, sf_dir, "documents"))


QUERIES = {"op7_fingerprint": op7_fingerprint}
ORACLES: dict[str, str] = {}
