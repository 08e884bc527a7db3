"""Runs of equal labels, and filters that work on them.

Sequences are rows (keys..., sample_ix, label); a null label is an unassigned sample, and forms runs of its own.
Every operator partitions by the same keys, so one shuffle serves a chain of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

RECORDING = ("recording_id",)


def by(keys: Sequence[str], order: str = "sample_ix"):
    return Window.partitionBy(*keys).orderBy(order)


def with_run(seq: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """``seq`` with run_ix, from 0."""
    w = by(keys)
    new = F.when(F.row_number().over(w) == 1, 1).when(F.col("label").eqNullSafe(F.lag("label").over(w)), 0).otherwise(1)
    return seq.withColumn("_new", new).withColumn("run_ix", F.sum("_new").over(w) - 1).drop("_new")


def runs(seq: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., run_ix, label, start_ix, end_ix, n), unassigned runs included."""
    return (
        with_run(seq, keys)
        .groupBy(*keys, "run_ix")
        .agg(F.max("label").alias("label"), F.min("sample_ix").alias("start_ix"), F.max("sample_ix").alias("end_ix"), F.count("*").alias("n"))
    )


def collapse(seq: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """One row per run: (keys..., sample_ix, label), sample_ix counting runs; a gap splits its neighbours."""
    return runs(seq, keys).select(*keys, F.col("run_ix").alias("sample_ix"), "label")


def _run_columns(seq: DataFrame, keys: Sequence[str]) -> DataFrame:
    r = Window.partitionBy(*keys, "run_ix")
    return with_run(seq, keys).withColumns({"run_n": F.count("*").over(r), "run_at": F.row_number().over(r.orderBy("sample_ix"))})


def remove_short(seq: DataFrame, least: int, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Runs of ``least`` samples or fewer become unassigned."""
    kept = F.when(F.col("run_n") > least, F.col("label"))
    return _run_columns(seq, keys).withColumn("label", kept).drop("run_ix", "run_n", "run_at")


def _gaps(seq: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the label and length of the runs before and after their own."""
    marked = _run_columns(seq, keys)
    w = by(keys)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    held = F.when(F.col("label").isNotNull(), F.struct("label", "run_n"))
    return marked.withColumns({"_b": F.last(held, ignorenulls=True).over(before), "_a": F.first(held, ignorenulls=True).over(after)})


def _fill(gaps: DataFrame, choice: Column) -> DataFrame:
    return gaps.withColumn("label", F.coalesce("label", choice)).drop("run_ix", "run_n", "run_at", "_b", "_a")


def replace_high(seq: DataFrame, least: int, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Short runs give way to the longer run beside the gap they form, the earlier one of equals."""
    b, a = F.col("_b"), F.col("_a")
    choice = F.when(b.isNull(), a["label"]).when(a.isNull() | (b["run_n"] >= a["run_n"]), b["label"]).otherwise(a["label"])
    return _fill(_gaps(remove_short(seq, least, keys), keys), choice)


def replace_half(seq: DataFrame, least: int, keys: Sequence[str] = RECORDING) -> DataFrame:
    """The first half of a gap, with its middle sample, goes to the run before, the rest to the run after."""
    b, a = F.col("_b"), F.col("_a")
    first = F.col("run_at") <= F.ceil(F.col("run_n") / 2)
    choice = F.when(b.isNull(), a["label"]).when(a.isNull() | first, b["label"]).otherwise(a["label"])
    return _fill(_gaps(remove_short(seq, least, keys), keys), choice)


def keep_rejected(filtered: DataFrame, original: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """Samples that were unassigned before a filter stay so (mode "reject")."""
    was = original.select(*keys, "sample_ix", F.col("label").isNull().alias("_rejected"))
    return filtered.join(was, [*keys, "sample_ix"]).withColumn("label", F.when(~F.col("_rejected"), F.col("label"))).drop("_rejected")


FILTERS = {"remove": remove_short, "replace_high": replace_high, "replace_half": replace_half}


def peaks(series: DataFrame, value: str = "value", keys: Sequence[str] = RECORDING, strict: bool = False) -> DataFrame:
    """(keys..., sample_ix, value) of local maxima. Borders are none; a flat top counts once, at its middle rounded down,
    or not at all if ``strict``."""
    w = by(keys)
    flat = series.select(*keys, "sample_ix", F.col(value).alias("value"))
    new = F.when(F.row_number().over(w) == 1, 1).when(F.col("value").eqNullSafe(F.lag("value").over(w)), 0).otherwise(1)
    flat = flat.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    tops = flat.groupBy(*keys, "_run").agg(F.first("value").alias("value"), F.min("sample_ix").alias("lo"), F.max("sample_ix").alias("hi"))
    r = by(keys, "_run")
    tops = tops.withColumns({"_b": F.lag("value").over(r), "_a": F.lead("value").over(r)})
    found = tops.where((F.col("value") > F.col("_b")) & (F.col("value") > F.col("_a")))
    if strict:
        found = found.where("lo = hi")
    return found.select(*keys, F.floor((F.col("lo") + F.col("hi")) / 2).cast("long").alias("sample_ix"), "value")


def from_peaks(seq: DataFrame, tops: DataFrame, value: str = "value", keys: Sequence[str] = RECORDING) -> DataFrame:
    """Each sample gets the label at its peak; peaks meet at the first least value between them. Without peaks labels stay."""
    at = tops.select(*keys, "sample_ix", F.lit(1).alias("_peak"))
    w = by(keys)
    rows = seq.join(at, [*keys, "sample_ix"], "left")
    rows = rows.withColumn("_p", F.sum(F.coalesce("_peak", F.lit(0))).over(w))
    rows = rows.withColumn("_n", F.max("_p").over(Window.partitionBy(*keys)))
    low = F.min(F.struct(F.col(value), F.col("sample_ix"))).over(Window.partitionBy(*keys, "_p"))["sample_ix"]
    own = (F.col("_p") > 0) & (F.col("_p") < F.col("_n")) & (F.col("sample_ix") >= low)
    rows = rows.withColumn("_g", F.greatest(F.lit(1), F.col("_p") + own.cast("int")))
    label = F.max(F.when(F.col("_peak") == 1, F.col("label"))).over(Window.partitionBy(*keys, "_g"))
    return rows.withColumn("label", F.when(F.col("_n") > 0, label).otherwise(F.col("label"))).drop("_peak", "_p", "_n", "_g")


def quality(scored: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., quality): 0.6 mean over states of mean |r| + 0.3 / (1 + transitions per sample) + 0.1 coverage.

    ``scored`` rows have label and abs_r. Transitions are counted without unassigned samples.
    """
    n = scored.groupBy(*keys).agg(F.count("*").alias("all"), F.count("label").alias("n"))
    held = scored.where(F.col("label").isNotNull())
    fit = held.groupBy(*keys, "label").agg(F.avg("abs_r").alias("r")).groupBy(*keys).agg(F.avg("r").alias("r"))
    turn = held.withColumn("_t", (F.col("label") != F.lag("label").over(by(keys))).cast("int")).groupBy(*keys).agg(F.sum("_t").alias("t"))
    score = 0.6 * F.col("r") + 0.3 / (1 + F.col("t") / F.col("n")) + 0.1 * F.col("n") / F.col("all")
    return n.join(fit, list(keys), "left").join(turn, list(keys), "left").select(*keys, F.coalesce(score, F.lit(0.0)).alias("quality"))


def retention(scored: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., threshold, retained %): share of samples with abs_r at or above each threshold."""
    kept = [F.struct(F.lit(float(t)).alias("threshold"), (100 * F.avg((F.col("abs_r") >= t).cast("double"))).alias("retained")) for t in thresholds]
    return scored.groupBy(*keys).agg(F.array(*kept).alias("_k")).select(*keys, F.inline("_k"))
