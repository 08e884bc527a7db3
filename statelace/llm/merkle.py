"""Merkle manifest of a dataset: a hash tree for each source, joined by a tree of sources, with proofs for every row.

Ranks inside a source come from a radix trie: counts of keys by their next few digits, summed over a bucket's children,
give every child the rank it begins with, and only children that still hold many keys are looked at again, a few
digits deeper. So no table is sorted as a whole, and every window sees a bounded number of rows. The digits of a
rank in base 16 name the nodes above a leaf. Three digits at a time, the nodes that share all other digits are
brought together and reduced, until a source has one node left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Scratch, table

FANOUT = 16
#: Levels that are reduced at once, so blocks hold up to FANOUT ** LEVELS nodes.
LEVELS = 3
BLOCK = FANOUT**LEVELS
#: Hexadecimal digits that a bucket's children differ in.
DIGITS = 3
#: Buckets that are broadcast at most; more of them are joined by a shuffle, salted.
BROADCAST = 50_000
SALTS = 32

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _encoded(value: Column) -> Column:
    v = value.cast("string")
    return F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))


def leaf_hash(values: list[Column]) -> Column:
    """SHA-256 of all values, each with its length before it, so that no two rows share their bytes."""
    return F.sha2(F.concat(*map(_encoded, values)), 256)


def _common(a: Column, b: Column) -> Column:
    """Length of the common start of two strings."""
    both = F.transform(F.sequence(F.lit(1), F.greatest(F.length(a), F.length(b))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.coalesce(F.nullif(F.array_position(both, True), F.lit(0)) - 1, F.length(a))


def radix_ranks(keys: DataFrame, bucket: int = BLOCK) -> DataFrame:
    """(g, key, m, ...) -> the same with (rank, total): copies before each key in its group, and copies in the group.

    ``key``s are strings of hexadecimal digits, distinct in their group and ranked bytewise; each stands for ``m``
    copies. ``keys`` is read several times, so it should be a written table.
    """
    scratch = Scratch(keys.sparkSession)
    ends = keys.agg(F.min("key").alias("a"), F.max("key").alias("b"))
    ends = ends.select(_common(F.col("a"), F.col("b")).alias("d")).first()["d"] or 0
    now = keys.withColumns({"_d": F.lit(ends + DIGITS), "_base": F.lit(0).cast("long"), "_up": F.lit("")})
    total = keys.groupBy("g").agg(F.sum("m").alias("total"))
    done = []
    while True:
        child = now.withColumn("_p", F.substring(F.col("key"), F.lit(1), F.col("_d").cast("int")))
        # a bucket is named by the digits of its parent and its own: at most FANOUT ** DIGITS children meet in a window
        counts = child.groupBy("g", "_up", "_p").agg(
            F.first("_base").alias("_base"), F.sum("m").alias("_m"), F.count("*").alias("_n"), F.min("key").alias("_a"), F.max("key").alias("_b")
        )
        before = F.sum("_m").over(Window.partitionBy("g", "_up").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
        counts = scratch.write(counts.withColumn("_base", F.col("_base") + F.coalesce(before, F.lit(0))), "buckets")
        small = counts.where(F.col("_n") <= bucket).select("g", "_up", "_p", F.col("_base").alias("_from"))
        met = child.join(small, ["g", "_up", "_p"])
        inside = Window.partitionBy("g", "_up", "_p").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
        rank = F.col("_from") + F.coalesce(F.sum("m").over(inside), F.lit(0))
        done.append(met.withColumn("rank", rank).drop("_d", "_base", "_up", "_p", "_from"))
        large = counts.where(F.col("_n") > bucket).select("g", "_up", "_p", F.col("_base").alias("_from"), (_common(F.col("_a"), F.col("_b")) + DIGITS).alias("_next"))
        n = large.count()
        if n == 0:
            break
        if n <= BROADCAST:
            met = child.join(F.broadcast(large), ["g", "_up", "_p"])
        else:  # a large bucket may hold any share of all keys
            salted = large.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            met = child.withColumn("_s", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["g", "_up", "_p", "_s"]).drop("_s")
        met = met.select(*keys.columns, F.col("_next").alias("_d"), F.col("_from").alias("_base"), F.col("_p").alias("_up"))
        now = scratch.write(met, "deeper")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.join(total, "g")


def _hash(parts: Column) -> Column:
    return F.sha2(F.array_join(parts, ""), 256)


def _up(nodes: Column) -> Column:
    """The hashes of runs of FANOUT nodes."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / FANOUT).cast("int") - 1)
    return F.transform(runs, lambda i: _hash(F.slice(nodes, i * FANOUT + 1, F.lit(FANOUT))))


def _levels(df: DataFrame) -> DataFrame:
    """Adds h1, h2, h3, the levels above the ``items`` of a block, as long as its tree has ``left`` > 1 nodes there."""
    below = F.transform("items", lambda i: i["h"])
    for j in range(LEVELS):
        df = df.withColumn(f"h{j + 1}", F.when(F.col("left") > FANOUT**j, _up(below)).otherwise(below))
        below = F.col(f"h{j + 1}")
    return df


def _step(at: Column, run: Column) -> Column:
    return F.struct(F.pmod(at, F.lit(FANOUT)).cast("int").alias("at"), run.alias("run"))


def _run_of(nodes: Column, i: Column) -> Column:
    """The run that node i lies in."""
    return F.slice(nodes, (F.floor(i / FANOUT) * FANOUT + 1).cast("int"), F.lit(FANOUT))


def _descend(blocks: DataFrame, keep: list[str]) -> DataFrame:
    """(keep..., i, item, steps): a row for each node of a block, its place there and the runs above it inside the block.

    A block is taken apart run by run, so that a row never holds more than its own runs.
    """
    left = F.col("left")

    def one(r: Column) -> Column:
        up = [F.when(left > FANOUT**j, _step(F.floor(r / FANOUT ** (j - 1)), _run_of(F.col(f"h{j}"), F.floor(r / FANOUT ** (j - 1))))) for j in range(1, LEVELS)]
        steps = F.array_compact(F.array(*up)) if up else F.array().cast(f"array<{STEP}>")
        return F.struct(r.alias("r"), F.slice("items", r * FANOUT + 1, F.lit(FANOUT)).alias("items"), steps.alias("up"))

    runs = F.transform(F.sequence(F.lit(0), F.ceil(F.size("items") / FANOUT).cast("int") - 1), one)
    cut = blocks.select(*keep, "left", F.explode(runs).alias("run"))
    cut = cut.select(*keep, "left", F.col("run.r").alias("r"), F.transform("run.items", lambda x: x["h"]).alias("hs"), F.col("run.up").alias("up"), F.posexplode("run.items").alias("j", "item"))
    own = F.array_compact(F.array(F.when(left > 1, _step(F.col("j"), F.col("hs")))))
    return cut.select(*keep, (F.col("r") * FANOUT + F.col("j")).alias("i"), "item", F.concat(own, "up").alias("steps"))


STEP = "struct<at:int,run:array<string>>"


@dataclass(frozen=True)
class Tree:
    """Trees of groups. ``layers`` hold their blocks, leaves first; ``roots`` are (g, root)."""

    layers: list[DataFrame]
    roots: DataFrame

    def leaves(self, tops: DataFrame | None = None) -> DataFrame:
        """(g, item, steps, top): every leaf with its steps up to its group's root and those of ``tops`` (g, steps, top) from there on.

        What lies above a block goes down with it from layer to layer, so steps meet leaves where they are taken apart.
        """
        scratch, below = Scratch(self.roots.sparkSession), None
        for t in reversed(self.layers):
            here = t.where(F.col("left") <= BLOCK)
            here = here.join(tops.withColumnRenamed("steps", "above"), "g") if tops is not None else here.withColumns({"above": F.array().cast(f"array<{STEP}>"), "top": F.lit(0)})
            if below is not None:
                here = here.unionByName(t.where(F.col("left") > BLOCK).join(below, ["g", "block"]))
            nodes = _descend(here, ["g", "block", "above", "top"]).withColumn("steps", F.concat("steps", "above"))
            if t is self.layers[0]:
                break
            below = scratch.write(nodes.select("g", (F.col("block") * BLOCK + F.col("i")).alias("block"), F.col("steps").alias("above"), "top"), "paths")
        return nodes.select("g", "item", "steps", "top")


def reduce_tree(leaves: DataFrame, carry: list[str]) -> Tree:
    """Trees over (g, rank, m, total, h, carry...), leaves of every group in the order of their ranks.

    A row stands for ``m`` leaves with ranks from ``rank`` on. Blocks hold the BLOCK leaves, or nodes, whose ranks agree
    in all but their last LEVELS digits; the node of a block is an item of the next layer.
    """
    scratch = Scratch(leaves.sparkSession)
    # a row of many copies is cut where blocks end, so that no block receives more than it holds
    cut = leaves.withColumn("block", F.explode(F.sequence(F.floor(F.col("rank") / BLOCK), F.floor((F.col("rank") + F.col("m") - 1) / BLOCK))))
    low = F.greatest("rank", F.col("block") * BLOCK)
    times = F.least(F.col("rank") + F.col("m"), (F.col("block") + 1) * BLOCK) - low
    piece = F.struct(low.alias("rank"), times.cast("int").alias("times"), F.struct("h", *carry).alias("item"))
    items = F.flatten(F.transform(F.sort_array(F.collect_list(piece)), lambda p: F.array_repeat(p["item"], p["times"])))
    layer = cut.groupBy("g", "block", F.col("total").alias("left")).agg(items.alias("items"))
    layers = []
    while True:  # upwards
        layers.append(scratch.write(_levels(layer), "nodes"))
        more = layers[-1].where(F.col("left") > BLOCK)
        if more.isEmpty():
            break
        node = F.struct("block", F.get(f"h{LEVELS}", F.lit(0)).alias("h"))
        up = more.select("g", F.floor(F.col("block") / BLOCK).alias("to"), F.ceil(F.col("left") / BLOCK).cast("long").alias("left"), node.alias("node"))
        layer = up.groupBy("g", F.col("to").alias("block"), "left").agg(F.sort_array(F.collect_list("node")).alias("items"))
    root = None
    for t in layers:
        ended = t.where(F.col("left") <= BLOCK).select("g", F.get(f"h{LEVELS}", F.lit(0)).alias("root"))
        root = ended if root is None else root.union(ended)
    return Tree(layers, root)


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its steps give: the leaf takes its place in each run, whose hash goes on."""
    return F.aggregate(
        steps, leaf, lambda h, s: _hash(F.concat(F.slice(s["run"], F.lit(1), s["at"]), F.array(h), F.slice(s["run"], s["at"] + 2, F.lit(FANOUT))))
    )


def siblings(steps: Column) -> Column:
    """All hashes a proof needs, level by level, from left to right."""
    return F.flatten(F.transform(steps, lambda s: F.concat(F.slice(s["run"], F.lit(1), s["at"]), F.slice(s["run"], s["at"] + 2, F.lit(FANOUT)))))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(F.encode(value, "UTF-8")))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, order: str = "doc_id", group: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """(order, leaf, subroot, root, steps, carry...): a row for each row of ``docs``.

    ``steps`` are a row's way to ``root``: its place in a run of nodes and that run, level by level; ``siblings`` and
    ``fold`` read them. ``order`` is a whole number; rows without one come last, rows that share one are ordered by
    their leaf. Repeated rows are leaves of their own. A null ``group`` is one of its own and comes first. Texts count as a
    whole, whatever their length; null fields differ from empty ones. An empty table gives no rows. Columns of other
    names are ignored; ``carry`` names expressions of ``docs`` that are handed on.
    """
    scratch = Scratch(docs.sparkSession)
    extra = {f"c_{k}": v for k, v in (carry or {}).items()}
    k = F.col(order).cast("long")
    digits = F.when(k.isNull(), F.repeat(F.lit("g"), 16)).otherwise(F.lower(F.lpad(F.hex(k.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")))
    g = F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("s"), F.col(group).cast("string")))
    hashed = docs.select(g.alias("g"), k.alias("k"), digits.alias("d"), leaf_hash([F.col(f) for f in fields]).alias("h"), *[v.alias(n) for n, v in extra.items()])
    hashed = hashed.groupBy("g", "k", "d", "h", *extra).agg(F.count("*").alias("m")).withColumn("key", F.concat("d", "h", *[F.coalesce(F.col(n).cast("string"), F.lit("")) for n in extra])).drop("d")
    leaves = scratch.write(hashed, "leaves")
    tree = reduce_tree(radix_ranks(leaves), ["k", *extra])
    roots = scratch.write(tree.roots, "subroots")
    groups = roots.select(F.lit("all").alias("g"), _hex(F.col("g")).alias("key"), F.lit(1).cast("long").alias("m"), F.col("root").alias("h"), F.col("g").alias("name"))
    over = reduce_tree(radix_ranks(scratch.write(groups, "groups")), ["name"])
    top = scratch.write(over.roots, "root")
    tops = over.leaves().crossJoin(F.broadcast(top.select("root")))  # one root
    tops = scratch.write(tops.select(F.col("item.name").alias("g"), "steps", F.struct(F.col("item.h").alias("subroot"), "root").alias("top")), "tops")
    return tree.leaves(tops).select(
        F.col("item.k").alias(order), F.col("item.h").alias("leaf"), "top.subroot", "top.root", "steps", *[F.col(f"item.c_{n}").alias(n) for n in (carry or {})]
    )


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' proofs, and what tampering with a fifth of the texts does to the root."""
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    tampered = leaf_hash([text if f == "text" else F.col(f) for f in FIELDS])
    rows = manifest(docs, carry={"tampered": tampered})
    rows = rows.withColumn("folded_root", fold(F.col("tampered"), F.col("steps")))
    proof = F.sha2(F.array_join(siblings(F.col("steps")), ""), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(levels: int = 7, top: int = 4) -> str:
    """DuckDB SQL of op12_merkle for up to 16 ** levels rows of a source and 16 ** top sources."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(text if f == "text" else f) for f in FIELDS) + ")"
    low = f"translate(text, '{UPPER}', '{LOWER}')"
    parts = [
        # the table of CRC-32: eight steps for each byte
        "crc AS (SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))",
        f"""docs AS (SELECT doc_id, coalesce('s' || source, '-') AS g, {leaf('text')} AS leaf, {leaf(low)} AS lowered,
  list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ord(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT)) AS codes FROM documents)""",
        """leaves AS (SELECT doc_id, g, leaf,
  CASE WHEN xor(list_reduce([4294967295] || codes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0 THEN lowered ELSE leaf END AS mine,
  row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS r, count(*) OVER (PARTITION BY g) AS n FROM docs, crc)""",
        "n0 AS (SELECT g, n, r, leaf AS h FROM leaves)",
    ]

    def climb(name: str, levels: int) -> None:
        for j in range(levels):
            parts.append(f"{name}r{j} AS (SELECT g, n, r // 16 AS r, list(h ORDER BY r) AS run FROM {name}{j} WHERE n > {16 ** j} GROUP BY g, n, r // 16)")
            parts.append(f"{name}{j + 1} AS (SELECT g, n, r, sha256(array_to_string(run, '')) AS h FROM {name}r{j} UNION ALL SELECT g, n, r, h FROM {name}{j} WHERE n <= {16 ** j})")

    climb("n", levels)
    parts.append(f"s0 AS (SELECT 0 AS g, count(*) OVER () AS n, row_number() OVER (ORDER BY encode(g)) - 1 AS r, h, g AS name FROM n{levels})")
    parts.append("t0 AS (SELECT g, n, r, h FROM s0)")
    climb("t", top)
    parts.append("p0 AS (SELECT l.doc_id, l.g, l.leaf, l.n, l.r, l.mine, '' AS proof FROM leaves l)")
    for j in range(levels):
        at = f"(p.r // {16 ** j}) % 16"
        parts.append(
            f"""p{j + 1} AS (SELECT p.doc_id, p.g, p.leaf, p.n, p.r,
  CASE WHEN q.run IS NULL THEN p.mine ELSE sha256(array_to_string(q.run[1:CAST({at} AS BIGINT)] || [p.mine] || q.run[CAST({at} AS BIGINT) + 2:], '')) END AS mine,
  proof || CASE WHEN q.run IS NULL THEN '' ELSE array_to_string(q.run[1:CAST({at} AS BIGINT)] || q.run[CAST({at} AS BIGINT) + 2:], '') END AS proof
  FROM p{j} p LEFT JOIN nr{j} q ON p.g = q.g AND p.r // {16 ** (j + 1)} = q.r)"""
        )
    parts.append(f"q0 AS (SELECT p.doc_id, p.leaf, s.h AS subroot, s.n, s.r, p.mine, p.proof FROM p{levels} p JOIN s0 s ON p.g = s.name)")
    for j in range(top):
        at = f"(p.r // {16 ** j}) % 16"
        parts.append(
            f"""q{j + 1} AS (SELECT p.doc_id, p.leaf, p.subroot, p.n, p.r,
  CASE WHEN q.run IS NULL THEN p.mine ELSE sha256(array_to_string(q.run[1:CAST({at} AS BIGINT)] || [p.mine] || q.run[CAST({at} AS BIGINT) + 2:], '')) END AS mine,
  proof || CASE WHEN q.run IS NULL THEN '' ELSE array_to_string(q.run[1:CAST({at} AS BIGINT)] || q.run[CAST({at} AS BIGINT) + 2:], '') END AS proof
  FROM q{j} p LEFT JOIN tr{j} q ON p.r // {16 ** (j + 1)} = q.r)"""
        )
    return (
        "WITH "
        + ",\n".join(parts)
        + f"\nSELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, mine AS folded_root, mine = h AS verified FROM q{top}, t{top}"
    )


QUERIES = {"op12_merkle": op12_merkle}
ORACLES = {"op12_merkle": _sql()}
