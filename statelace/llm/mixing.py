"""Mixing sources to target weights by pivotal dependent rounding.

Every source gets a share of all words; a document's expected number of copies is its source's share over
its source's size. Whole copies are certain; the fractions are rounded so that a source's words hardly vary:
two open fractions exchange mass, at random but in step with their sizes, until one of them is 0 or 1. Blocks
of bounded size are folded first, each leaves one open fraction at most, and these meet in further rounds, a
reduction tree, until a source has one left, which a last draw decides.

Draws hash doc_id and the seed, so reruns agree. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, n_words, table, uniform

BLOCK = 64
EPS = 1e-9


def _before(rows: DataFrame, order: list[Column], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """``rows``, written in ranges of ``order``, with the sum of each of ``sums`` over all rows before (0 for the first).

    A range is a task's window; only one row a range meets the others, as many as Spark has shuffle partitions.
    """
    ranged = scratch.write(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("_part").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    parts = parts.select(F.col("_part").alias("_p"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    out = out.join(F.broadcast(parts), F.col("_part") == F.col("_p"))
    out = out.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_p", "_part", *[f"_{n}" for n in sums])
    out.scratch_path = ranged.scratch_path
    return out


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """(source, source_size, target), a written table: one row per source.

    ``sizes``: (source, source_size). Weights repeat over the sources in code-point order, null last. A target stops at
    ``most`` times its source's size; the excess goes to the others by weight until none is above, which has
    the closed form min(cap, level * weight). Sources are filled in the order of cap / weight, and the level is that
    of the first one whose cap lies above what is left for it. Both orders are prefix sums over ranges of sources, so
    sources may be as many as sites.
    """
    scratch = Scratch(sizes.sparkSession)
    by_name = [F.col("source").asc_nulls_last()]
    named = _before(sizes, by_name, {"nth": F.lit(1)}, scratch)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    s = named.select("source", "source_size", weight.alias("w")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    s = s.withColumn("full", F.col("cap") / F.col("w"))
    filled = _before(s, [F.col("full").asc(), *by_name], {"used": F.col("cap"), "gone": F.col("w")}, scratch)
    whole = filled.agg(F.sum("source_size").alias("total"), F.sum("w").alias("all_w"))
    level = (F.col("total") - F.col("used")) / (F.col("all_w") - F.col("gone"))
    levels = filled.crossJoin(F.broadcast(whole)).withColumn("level", level).where("level * w <= cap")  # one row beside the sources
    level = levels.agg(F.min_by("level", F.struct("full", F.col("source").isNull(), "source")).alias("level"))
    out = filled.crossJoin(F.broadcast(level))  # one row again; null if every source is full
    out = out.select("source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("w")), F.col("cap")).alias("target"))
    out = scratch.write(out, "targets")
    scratch.drop(named, filled)
    return out


def _fold(items: Column, salt: Column) -> Column:
    """Fold a block of (id, w, p): the open item and the outcomes (id, x) of all others.

    With p and q the fractions of the open item and the next, moving m words from one to the other changes them by
    m / w each. Either the first gives until it is 0 or the second 1, or the reverse; the odds keep the expectations.
    """

    def step(acc: Column, it: Column) -> Column:
        o = acc["open"]
        give = F.least(o["p"] * o["w"], (1 - it["p"]) * it["w"])  # words from the open item to this one
        take = F.least((1 - o["p"]) * o["w"], it["p"] * it["w"])
        u = uniform(o["id"], it["id"], salt)
        move = F.when(u * (give + take) < take, -give).otherwise(take)
        p, q = o["p"] + move / o["w"], it["p"] - move / it["w"]
        p_done = (p <= EPS) | (p >= 1 - EPS)
        done = F.struct(F.when(p_done, o["id"]).otherwise(it["id"]).alias("id"), F.round(F.when(p_done, p).otherwise(q)).cast("long").alias("x"))
        rest = F.struct(
            F.when(p_done, it["id"]).otherwise(o["id"]).alias("id"),
            F.when(p_done, it["w"]).otherwise(o["w"]).alias("w"),
            F.when(p_done, q).otherwise(p).alias("p"),
        )
        settled = (rest["p"] <= EPS) | (rest["p"] >= 1 - EPS)
        both = F.array(done, F.struct(rest["id"].alias("id"), F.round(rest["p"]).cast("long").alias("x")))
        first = o["id"].isNull()
        return F.struct(
            F.when(first, it).when(~settled, rest).alias("open"),
            F.when(first, acc["out"]).otherwise(F.concat(acc["out"], F.when(settled, both).otherwise(F.array(done)))).alias("out"),
        )

    item = "struct<id:string,w:double,p:double>"
    start = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast("array<struct<id:string,x:bigint>>").alias("out"))
    return F.aggregate(items, start, step)


def pivotal_rounding(items: DataFrame, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(grp, id, w, p) with 0 < p < 1, ids unique in a group -> (grp, id, x), x 0 or 1.

    Within a group sum(w * x) differs from sum(w * p) by less than one w, and x is 1 with probability p. Blocks
    hold about ``block`` items of one group, whatever the group's size; the tree has log_block(n) rounds.
    """
    scratch = Scratch(items.sparkSession)
    now, outs, turn = items, [], 0
    while True:
        counts = now.groupBy("grp").agg(F.count("*").alias("n"))
        most = counts.agg(F.max("n")).first()[0] or 0
        if most == 0:
            break
        last = most <= 2 * block
        salt = F.lit(seed * 1000 + turn)
        if last:
            dealt = now.withColumn("b", F.lit(0).cast("long"))
        else:  # one row per group, joined by key: a plain join that adaptive execution may split
            dealt = now.join(counts.withColumnRenamed("grp", "g"), F.col("grp").eqNullSafe(F.col("g")))
            dealt = dealt.withColumn("b", F.pmod(F.xxhash64("id", salt), F.ceil(F.col("n") / block))).drop("g", "n")
        # large items first, so that what stays open is small
        packed = F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("o"), "id", "w", "p")))
        packed = F.transform(packed, lambda s: F.struct(s["id"].alias("id"), s["w"].alias("w"), s["p"].alias("p")))
        folded = dealt.groupBy("grp", "b").agg(packed.alias("items")).select("grp", _fold(F.col("items"), salt).alias("f"))
        folded = scratch.write(folded, "folded")
        outs.append(folded.select("grp", F.explode("f.out").alias("o")).select("grp", "o.id", "o.x"))
        now = folded.where("f.open is not null").select("grp", "f.open.*")
        if last:
            x = (uniform(F.col("id"), salt) < F.col("p")).cast("long")
            outs.append(now.select("grp", "id", x.alias("x")))
            break
        turn += 1
    out = outs[0] if outs else items.select("grp", "id", F.lit(0).cast("long").alias("x"))
    for o in outs[1:]:
        out = out.union(o)
    return out


def mixed(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, block: int = BLOCK) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, m): one row per distinct (doc_id, source, size).

    ``m`` counts its rows, which share their copies. Documents without words have copies drawn alone, as they
    weigh nothing; null text has size 0; null doc_id and null source are values like any other.
    """
    scratch = Scratch(docs.sparkSession)
    units = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col("text")).alias("size"))
    units = scratch.write(units.groupBy("doc_id", "source", "size").agg(F.count("*").alias("m")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "src")
    rows = units.join(targets, F.col("source").eqNullSafe(F.col("src"))).drop("src")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + EPS))
    rows = rows.withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    rows = rows.withColumn("id", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size").cast("string")))
    rows = rows.withColumn("grp", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")))
    draws = rows.where((F.col("size") > 0) & (F.col("p") > EPS) & (F.col("p") < 1 - EPS))
    x = pivotal_rounding(draws.select("grp", "id", (F.col("size") * F.col("m")).cast("double").alias("w"), "p"), seed, block)
    out = rows.join(x, ["grp", "id"], "left")
    alone = F.when(F.col("p") >= 1 - EPS, 1).when(F.col("p") <= EPS, 0).otherwise((uniform(F.col("id"), F.lit(seed)) < F.col("p")).cast("int"))
    copies = F.col("whole") + F.coalesce("x", alone)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.cast("long").alias("copies"), "m")


def mixture(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per document row: doc_id, size, source_size, target, copies, taken (= copies * size).

    Empty table: no rows. Equal rows share their number of copies. Extra columns are ignored.
    """
    rows = mixed(docs, seed)
    rows = rows.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The documents of the mix: each row as often as its copies say, none if 0, with all its columns.

    Null texts have size 0 and are drawn alone; a null source is a source; equal rows share their copies; an empty table stays empty.
    """
    units = mixed(docs, seed).select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_n"), "copies")
    units = units.where("copies > 0")
    keys = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_k"), F.col("source").alias("_f"), n_words(F.col("text")).alias("_w"))
    both = keys.join(units, F.col("_k").eqNullSafe(F.col("_d")) & F.col("_f").eqNullSafe(F.col("_s")) & (F.col("_w") == F.col("_n")))
    return both.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


QUERIES = {"op8_mixing": op8_mixing}
ORACLES: dict[str, str] = {}
