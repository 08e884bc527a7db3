"""Features of label sequences, long form: one row per key, state (or pair) and value."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .runs import RECORDING, by, runs


def coverage(seq: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., state, value): % of assigned samples."""
    n = seq.where(F.col("label").isNotNull()).groupBy(*keys, F.col("label").alias("state")).agg(F.count("*").alias("n"))
    return n.select(*keys, "state", (100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("value"))


def occurrence(seq: DataFrame, fs: float, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Runs per second of assigned time."""
    r = runs(seq, keys).where(F.col("label").isNotNull())
    r = r.groupBy(*keys, F.col("label").alias("state")).agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return r.select(*keys, "state", (F.col("r") * float(fs) / F.sum("n").over(Window.partitionBy(*keys))).alias("value"))


def duration(seq: DataFrame, fs: float, method: str = "geometric", keys: Sequence[str] = RECORDING) -> DataFrame:
    """Run length in ms: geometric, arithmetic (mean less one sample), median, or trimmed (a tenth of over ten runs each side)."""
    r = runs(seq, keys).where(F.col("label").isNotNull()).withColumnRenamed("label", "state")
    ms, group = 1000.0 / fs, [*keys, "state"]
    match method:
        case "geometric":
            value: Column = F.exp(F.avg(F.log("n")))
        case "arithmetic":
            value = F.avg("n") - 1
        case "median":
            value = F.median("n")
        case "trimmed":
            w = Window.partitionBy(*group)
            r = r.withColumns({"at": F.row_number().over(w.orderBy("n", "run_ix")), "of": F.count("*").over(w)})
            cut = F.when(F.col("of") > 10, F.greatest(F.lit(1), F.floor(F.col("of") / 10))).otherwise(0)
            r = r.where((F.col("at") > cut) & (F.col("at") <= F.col("of") - cut))
            value = F.avg("n")
        case _:
            raise ValueError(f"unknown duration method {method!r}")
    return r.groupBy(*group).agg((value * ms).alias("value"))


def explained_variance(scored: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """% of all power that each state's own samples explain; 0 without power. Rows have label, gfp and r."""
    power = Window.partitionBy(*keys)
    own = scored.groupBy(*keys, "label").agg(F.sum((F.col("gfp") * F.col("r")) ** 2).alias("own"), F.sum(F.col("gfp") ** 2).alias("all"))
    own = own.withColumn("all", F.sum("all").over(power)).where(F.col("label").isNotNull())
    return own.select(*keys, F.col("label").alias("state"), F.coalesce(100 * F.try_divide("own", "all"), F.lit(0.0)).alias("value"))


def transitions(seq: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., state, state_to, n): steps between different assigned labels."""
    pairs = seq.select(*keys, F.col("label").alias("state"), F.lead("label").over(by(keys)).alias("state_to"))
    return pairs.where("state <> state_to").groupBy(*keys, "state", "state_to").agg(F.count("*").alias("n"))


def transition_probability(seq: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    of = F.sum("n").over(Window.partitionBy(*keys, "state"))
    return transitions(seq, keys).select(*keys, "state", "state_to", (F.col("n") / of).alias("value"))


def _entropy(n: str, keys: Sequence[str]) -> Column:
    return F.log(F.sum(n)) - F.sum(F.col(n) * F.log(n)) / F.sum(n)


def label_entropy(seq: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Shannon entropy of labels, in nats, unassigned left out."""
    n = seq.where(F.col("label").isNotNull()).groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(_entropy("n", keys).alias("value"))


def words(seq: DataFrame, size: int, keys: Sequence[str] = RECORDING, last: bool = True) -> DataFrame:
    """(keys..., sample_ix, word) of ``size`` labels from each sample on; unassigned is a symbol. The last word may be left out."""
    w = by(keys)
    ahead = [F.coalesce(F.lead("label", i).over(w) if i else F.col("label"), F.lit("")) for i in range(size)]
    more = size - 1 if last else size
    there = F.lead("sample_ix", more).over(w) if more else F.col("sample_ix")
    return seq.select(*keys, "sample_ix", F.array(*ahead).alias("word"), there.alias("_end")).where("_end is not null").drop("_end")


def joint_entropy(seq: DataFrame, size: int, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Entropy of words of ``size`` labels in nats; the last word is left out."""
    n = words(seq, size, keys, last=False).groupBy(*keys, "word").agg(F.count("*").alias("n"))
    return n.groupBy(*keys).agg(_entropy("n", keys).alias("value"))


def entropy_rate(seq: DataFrame, sizes: int = 6, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., rate, excess): slope and intercept of joint entropy over word sizes 1 to ``sizes``.

    One pass: the longest word at each sample has all shorter ones as beginnings.
    """
    w = by(keys)
    ahead = [F.coalesce(F.lead("label", i).over(w) if i else F.col("label"), F.lit("")) for i in range(sizes)]
    there = [F.lead("sample_ix", k).over(w).isNotNull() for k in range(1, sizes + 1)]
    each = F.array(*[F.when(there[k - 1], F.struct(F.lit(k).alias("k"), F.array(*ahead[:k]).alias("word"))) for k in range(1, sizes + 1)])
    n = seq.select(*keys, each.alias("e")).select(*keys, F.explode("e").alias("e")).where("e is not null")
    n = n.groupBy(*keys, "e.k", "e.word").agg(F.count("*").alias("n"))
    h = n.groupBy(*keys, "k").agg(_entropy("n", keys).alias("h"))
    return h.groupBy(*keys).agg(F.regr_slope("h", "k").alias("rate"), F.regr_intercept("h", "k").alias("excess"))


def word_entropy(word: Column) -> Column:
    """Shannon entropy of the symbols of a word."""
    size = F.size(word).cast("double")
    share = lambda x: F.size(F.filter(word, lambda y: y == x)) / size
    return F.aggregate(F.array_distinct(word), F.lit(0.0), lambda s, x: s - share(x) * F.log(share(x)))


def entropy_classes(seq: DataFrame, size: int = 2, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., class, value): share of words per entropy class, the least entropy first. Unassigned samples are left out first."""
    dense = seq.where(F.col("label").isNotNull()).withColumn("sample_ix", F.row_number().over(by(keys)))
    n = words(dense, size, keys).withColumn("h", F.round(word_entropy(F.col("word")), 9)).groupBy(*keys, "h").agg(F.count("*").alias("n"))
    of = Window.partitionBy(*keys)
    return n.select(*keys, F.dense_rank().over(of.orderBy("h")).alias("class"), "h", (F.col("n") / F.sum("n").over(of)).alias("value"))


def theoretical_words(seq: DataFrame, size: int = 2, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., word): every word of the labels seen without equal neighbours."""
    seen = seq.where(F.col("label").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set("label")).alias("all"))
    out = seen.select(*keys, "all", F.explode("all").alias("x")).select(*keys, "all", F.array("x").alias("word"))
    for _ in range(size - 1):
        out = out.select(*keys, "all", "word", F.explode("all").alias("x")).where(F.element_at("word", -1) != F.col("x"))
        out = out.select(*keys, "all", F.concat("word", F.array("x")).alias("word"))
    return out.drop("all")


def representation_ratio(seq: DataFrame, size: int = 2, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., class, value): share of a class in the sequence over its share among possible words; null if none is possible."""
    real = entropy_classes(seq, size, keys)
    t = theoretical_words(seq, size, keys).withColumn("h", F.round(word_entropy(F.col("word")), 9)).groupBy(*keys, "h").agg(F.count("*").alias("n"))
    t = t.select(*keys, "h", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("of"))
    return real.join(t, [*keys, "h"], "left").select(*keys, "class", F.try_divide("value", "of").alias("value"))


def windowed(seq: DataFrame, fs: float, seconds: float, keys: Sequence[str] = RECORDING) -> DataFrame:
    """``seq`` in whole tumbling windows: window_ix, and sample_ix counted inside; a trailing part is dropped."""
    w = int(fs * seconds)
    n = F.count("*").over(Window.partitionBy(*keys))
    ix = (F.row_number().over(by(keys)) - 1).cast("long")
    rows = seq.withColumns({"_n": n, "_i": ix}).withColumn("window_ix", F.floor(F.col("_i") / w))
    return rows.where(F.col("window_ix") < F.floor(F.col("_n") / w)).withColumn("sample_ix", F.col("_i") % w).drop("_n", "_i")


def sliding_coverage(seq: DataFrame, fs: float, seconds: float, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Coverage per window, with zeros for states that the recording has elsewhere."""
    seen = seq.where(F.col("label").isNotNull()).groupBy(*keys).agg(F.collect_set("label").alias("_all"))
    rows = windowed(seq, fs, seconds, keys)
    grid = rows.select(*keys, "window_ix").distinct().join(seen, list(keys)).select(*keys, "window_ix", F.explode("_all").alias("state"))
    found = coverage(rows, [*keys, "window_ix"])
    return grid.join(found, [*keys, "window_ix", "state"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def sliding_occurrence(seq: DataFrame, fs: float, seconds: float, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Runs per second of nominal window time, for states seen in the window."""
    rows = windowed(seq, fs, seconds, keys)
    r = runs(rows, [*keys, "window_ix"]).where(F.col("label").isNotNull())
    return r.groupBy(*keys, "window_ix", F.col("label").alias("state")).agg((F.count("*") / float(seconds)).alias("value"))


def sliding_duration(seq: DataFrame, fs: float, seconds: float, method: str = "geometric", keys: Sequence[str] = RECORDING) -> DataFrame:
    return duration(windowed(seq, fs, seconds, keys), fs, method, [*keys, "window_ix"])


def variability(windows: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., state, sd, rmssd) of window values; null from a single window."""
    w = by([*keys, "state"], "window_ix")
    step = windows.withColumn("_d", F.col("value") - F.lag("value").over(w))
    return step.groupBy(*keys, "state").agg(F.stddev_samp("value").alias("sd"), F.sqrt(F.avg(F.col("_d") ** 2)).alias("rmssd"))


def wide(long: DataFrame, states: Sequence[str], code: str, keys: Sequence[str] = RECORDING) -> DataFrame:
    """One column CODE_STATE per state, means of duplicates."""
    out = long.groupBy(*keys).pivot("state", list(states)).agg(F.avg("value"))
    return out.withColumnsRenamed({s: f"{code}_{s}" for s in states})


#: Codes that need more than labels: scored samples, or epochs with trial and t_ms.
NEEDS = {"GEV": "scored", "ROF": "epochs", "RTF": "epochs"}

#: Samples that a task of several features sorts and counts at once, as long as recordings are no longer.
DEALT = 100_000


def _dealt(seq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``seq`` by its keys in as many parts as its rows need. Adaptive execution would join them, as the features of one union
    share the tasks that it aims at, and as packed shuffles are far smaller than the tables that are sorted from them."""
    least = int(seq.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return seq.repartition(max(least, math.ceil(seq.count() / DEALT)), *keys) if keys else seq


def features(
    seq: DataFrame,
    fs: float,
    codes: Sequence[str] = ("COV", "OCC", "DUR"),
    keys: Sequence[str] = RECORDING,
    scored: DataFrame | None = None,
    epochs: DataFrame | None = None,
    windows: dict[str, tuple[float, float]] | None = None,
    baseline: tuple[float, float] = (-1000.0, -10.0),
    duration_method: str = "geometric",
) -> DataFrame:
    """(keys..., feature, state, state_to, t_ms, value) of several features at once.

    GEV needs ``scored`` samples (label, gfp, r); ROF and RTF need ``epochs`` (keys..., trial, t_ms, label), RTF also ``windows``
    of times after its ``baseline``, named in the feature (RTF_window).
    """
    from . import events, sequence

    seq = _dealt(seq, keys)
    parts = {
        "COV": lambda: coverage(seq, keys),
        "OCC": lambda: occurrence(seq, fs, keys),
        "DUR": lambda: duration(seq, fs, duration_method, keys),
        "MMD": lambda: duration(seq, fs, keys=keys),
        "GEV": lambda: explained_variance(scored, keys),
        "TP": lambda: transition_probability(seq, keys),
        "ER": lambda: entropy_rate(seq, keys=keys).withColumnRenamed("rate", "value"),
        "ERR": lambda: entropy_classes(seq, keys=keys).withColumn("state", F.concat(F.lit("EntropyClass"), F.col("class"))),
        "HE": lambda: sequence.hurst(seq, keys),
        "LZC": lambda: sequence.lempel_ziv(seq, keys),
        "ROF": lambda: events.relative_occurrence(epochs, baseline, keys).withColumnRenamed("clr_bc", "value"),
        "RTF": lambda: events.transition_rates(epochs, windows or {}, baseline, keys).withColumnRenamed("pct_change", "value"),
    }
    if unknown := set(codes) - set(parts):
        raise ValueError(f"unknown features {sorted(unknown)}")
    given = {"scored": scored, "epochs": epochs}
    if lacking := [c for c in codes if c in NEEDS and given[NEEDS[c]] is None]:
        raise ValueError(f"features {lacking} need {sorted({NEEDS[c] for c in lacking})}")
    out = None
    for code in codes:
        f = parts[code]()
        name = F.concat(F.lit("RTF_"), F.col("window")) if code == "RTF" else F.lit(code)
        kinds = {"state": "string", "state_to": "string", "t_ms": "double"}
        f = f.select(*keys, name.alias("feature"), *[(F.col(c) if c in f.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()], "value")
        out = f if out is None else out.unionByName(f)
    return out


def window_variability(seq: DataFrame, fs: float, seconds: float, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., state, feature, value): SD and RMSSD over windows of duration, coverage and occurrence, named DUR_SD and so on."""
    sources = {"DUR": sliding_duration(seq, fs, seconds, keys=keys), "COV": sliding_coverage(seq, fs, seconds, keys), "OCC": sliding_occurrence(seq, fs, seconds, keys)}
    out = None
    for code, windows in sources.items():
        v = variability(windows, keys)
        names = F.array(*[F.struct(F.lit(f"{code}_{n}").alias("feature"), F.col(c).alias("value")) for n, c in (("SD", "sd"), ("RMSSD", "rmssd"))])
        v = v.select(*keys, "state", F.inline(names))
        out = v if out is None else out.unionByName(v)
    return out


def truncated(seq: DataFrame, least: int, keys: Sequence[str] = RECORDING) -> DataFrame:
    """The first ``least`` samples of every recording; a shorter recording is an error once its rows are read."""
    n = F.count("*").over(Window.partitionBy(*keys))
    short = F.raise_error(F.concat(F.lit(f"fewer than {least} samples in "), F.concat_ws("/", *[F.col(k).cast("string") for k in keys])))
    rows = seq.withColumns({"_n": n, "_i": F.row_number().over(by(keys))})
    return rows.where(F.when(F.col("_n") < least, short.cast("boolean")).otherwise(F.col("_i") <= least)).drop("_n", "_i")


#: Recordings of up to so many samples are shuffled as arrays, so many cells (samples times replicates) at a time; longer ones as rows.
SHORT, CELLS = 100_000, 1 << 20


def surrogate_ratios(seq: DataFrame, replicates: int = 1000, size: int = 2, seed: int = 42, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., class, n, mean, sd): representation ratios over shuffled sequences.

    A recording of up to ``SHORT`` samples is one row with its labels in order, of which a task makes all replicates; the
    replicates of a longer one are rows of one plan. Both draw by the same hashes.
    """
    rows = seq.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    each = rows.where(F.col("_n") > SHORT).drop("_n").withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    of = [*keys, "replicate"]
    draw = F.row_number().over(Window.partitionBy(*of).orderBy(F.xxhash64("sample_ix", "replicate", F.lit(seed)), "sample_ix"))
    # the labels stay where they are and get new places
    r = representation_ratio(each.withColumn("sample_ix", draw.cast("long")), size, of)
    long = r.groupBy(*keys, "class").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    order = F.sort_array(F.collect_list(F.struct(F.col("sample_ix").cast("long").alias("at"), "label")))
    short = rows.where(F.col("_n") <= SHORT).groupBy(*keys).agg(order.alias("_s")).select(*keys, F.col("_s.at").alias("at"), F.col("_s.label").alias("label"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                at, labels = b.column("at")[i].values.to_numpy(), b.column("label")[i].values.to_numpy(zero_copy_only=False)
                found = shuffled_ratios(at, labels, replicates, size, seed)
                k = pa.array([i] * len(found), pa.int64())
                kind, n, mean, sd = zip(*found) if found else ((), (), (), ())
                values = [pa.array(kind, pa.int32()), pa.array(n, pa.int64()), pa.array(mean, pa.float64()), pa.array(sd, pa.float64())]
                yield pa.record_batch([*(b.column(x).take(k) for x in keys), *values], names=[*keys, "class", "n", "mean", "sd"])

    types = ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in seq.select(*keys).schema)
    return short.mapInArrow(run, ", ".join(filter(None, [types, "class int, n long, mean double, sd double"]))).unionByName(long)


def hashed(at: np.ndarray, replicate: np.ndarray, seed: int) -> np.ndarray:
    """``xxhash64(at, replicate, seed)`` of a long and two ints, as Spark computes it."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, n: (x << np.uint64(n)) | (x >> np.uint64(64 - n))

    def end(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    with np.errstate(over="ignore"):
        h = np.uint64(42) + p5 + np.uint64(8) ^ turn(at.astype(np.int64).view(np.uint64) * p2, 31) * p1
        h = end(turn(h, 27) * p1 + p4)
        for x in (replicate.astype(np.int64), np.array([seed])):
            h = h + p5 + np.uint64(4) ^ (x & 0xFFFFFFFF).astype(np.uint64) * p1
            h = end(turn(h, 23) * p2 + p3)
    return h.view(np.int64)


@cache
def possible_shares(labels: int, size: int) -> dict[float, float]:
    """Share of each entropy among the words of so many labels without equal neighbours."""
    counts: dict[float, int] = {}

    def more(word: tuple[int, ...], used: int, ways: int) -> None:
        if len(word) == size:
            share = [word.count(x) / size for x in range(used)]
            h = round(-sum(x * math.log(x) for x in share), 9) + 0.0
            counts[h] = counts.get(h, 0) + ways
            return
        for x in range(used):
            if not word or x != word[-1]:
                more((*word, x), used, ways)
        if used < labels:
            more((*word, used), used + 1, ways * (labels - used))

    more((), 0, 1)
    return {h: n / sum(counts.values()) for h, n in counts.items()}


def shuffled_ratios(at: np.ndarray, labels: np.ndarray, replicates: int, size: int, seed: int) -> list[tuple]:
    """(class, n, mean, sd) of the representation ratios of one recording over its shuffled sequences."""
    names = {x: i for i, x in enumerate(dict.fromkeys(x for x in labels if x is not None))}
    code, held = np.array([names.get(x, -1) for x in labels]), sum(x is not None for x in labels)
    if held < size:
        return []
    possible, values, step = possible_shares(len(names), size), {}, max(1, CELLS // len(at))
    for lo in range(1, replicates + 1, step):
        r = np.arange(lo, min(lo + step, replicates + 1))
        order = np.argsort(hashed(at[None], r[:, None], seed), axis=1, kind="stable")
        seq = code[order]
        seq = seq[seq >= 0].reshape(len(r), held)
        words = np.lib.stride_tricks.sliding_window_view(seq, size, axis=1)
        same = np.stack([(words == words[..., i : i + 1]).sum(axis=-1) for i in range(size)], axis=-1)
        h = np.round(-np.log(same / size).sum(axis=-1) / size, 9) + 0.0
        kinds, which = np.unique(h, return_inverse=True)
        n = np.zeros((len(r), len(kinds)), int)
        np.add.at(n, (np.arange(len(r))[:, None], which.reshape(h.shape)), 1)
        for row in n:
            for c, k in enumerate(np.flatnonzero(row), 1):
                of = possible.get(float(kinds[k]))
                values.setdefault(c, []).append(row[k] / words.shape[1] / of if of else None)
    out = []
    for c, v in sorted(values.items()):
        v = [x for x in v if x is not None]
        out.append((c, len(v), float(np.mean(v)) if v else None, float(np.std(v, ddof=1)) if len(v) > 1 else None))
    return out


def shuffled(seq: DataFrame, seed: int, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Surrogate sequence: the same labels in an order drawn by hash, so reruns agree."""
    draw = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("sample_ix", F.lit(seed)), "sample_ix"))
    place = F.row_number().over(by(keys))
    rows = seq.withColumns({"_to": draw, "_at": place})
    labels = rows.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_to").alias("_t"), F.col("label").alias("_label"))
    on = [rows[k].eqNullSafe(labels[f"_{k}"]) for k in keys]
    return rows.join(labels, [*on, rows["_at"] == labels["_t"]]).withColumn("label", F.col("_label")).select(*seq.columns)


def random_labels(seq: DataFrame, seed: int, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Labels drawn evenly, by hash, from those the recording has."""
    seen = seq.where(F.col("label").isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set("label")).alias("_all"))
    pick = F.get("_all", F.pmod(F.xxhash64("sample_ix", *keys, F.lit(seed)), F.size("_all")).cast("int"))
    return seq.join(seen, list(keys)).withColumn("label", pick).drop("_all")


