"""Event-locked windows, occurrence and transition rates around events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .blocks import chunk_of, numbered
from .runs import RECORDING, by


def event_list(annotations: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., description, onsets): sorted onsets in seconds, three decimals."""
    return annotations.groupBy(*keys, "description").agg(F.sort_array(F.collect_list(F.round("onset_s", 3))).alias("onsets"))


def event_windows(annotations: DataFrame, wanted: Sequence[str], keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., event_ix, description, start_s, end_s): each wanted event up to the next later onset of any event; the last is open."""
    onsets = annotations.select(*keys, "onset_s").distinct()
    following = onsets.withColumn("end_s", F.lead("onset_s").over(by(keys, "onset_s")))
    picked = annotations.where(F.col("description").isin(list(wanted))).join(following, [*keys, "onset_s"])
    order = Window.partitionBy(*keys).orderBy("onset_s", "description")
    return picked.select(*keys, (F.row_number().over(order) - 1).alias("event_ix"), "description", F.col("onset_s").alias("start_s"), "end_s")


def open_windows(windows: DataFrame, keys: Sequence[str] = RECORDING) -> DataFrame:
    """(keys..., start_s, open): at each onset, the windows (event_ix, description, start_s, end_s) that are open from it on.

    Windows may overlap. Each is listed at every onset that it covers, whose places it knows from one sorted pass over
    starts and ends; windows without a start, or that end before they start, are open nowhere.
    """
    w = windows.where(F.col("start_s").isNotNull() & (F.col("end_s").isNull() | (F.col("end_s") > F.col("start_s"))))
    w = w.dropna(subset=list(keys)).select(*keys, "event_ix", "description", "start_s", "end_s")
    starts = w.groupBy(*keys, "start_s").agg(F.count("*").alias("_n"))
    starts = starts.select(*keys, "start_s", (F.row_number().over(by(keys, "start_s")) - 1).alias("_r"), F.count("*").over(Window.partitionBy(*keys)).alias("_all"))
    ends = w.where("end_s is not null").select(*keys, F.col("end_s").alias("x")).distinct()
    edges = starts.select(*keys, F.col("start_s").alias("x"), F.lit(1).alias("_s")).unionByName(ends.withColumn("_s", F.lit(0)))
    # an end sees the starts before it, not the one at its own time
    seen = F.sum("_s").over(Window.partitionBy(*keys).orderBy("x", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = edges.withColumn("_to", seen).where("_s = 0").select(*keys, F.col("x").alias("end_s"), "_to")
    spans = w.join(starts, [*keys, "start_s"]).join(ends, [*keys, "end_s"], "left")
    spans = spans.withColumn("_at", F.explode(F.sequence("_r", F.coalesce("_to", "_all") - 1)))
    window = F.struct("event_ix", "description", "start_s", "end_s")
    listed = spans.groupBy(*keys, "_at").agg(F.sort_array(F.collect_list(window)).alias("open"))
    return listed.join(starts.select(*keys, F.col("_r").alias("_at"), "start_s"), [*keys, "_at"]).select(*keys, "start_s", "open")


def in_windows(samples: DataFrame, windows: DataFrame, keys: Sequence[str] = RECORDING, chunk_s: float = 300.0, count: bool = True) -> DataFrame:
    """``samples`` (with t_s) inside each window of their recording; sample_ix counts inside the window, or stays if not ``count``.

    Onsets and samples are sorted together by time and the windows open at the last onset are carried forward, so no
    sample meets a window that it isn't in. Recordings are cut into chunks of ``chunk_s``, and the windows open at a
    chunk's end are handed on, so a long recording is many tasks. sample_ix must grow with t_s. Samples without a time
    and null keys are in no window.
    """
    opened = open_windows(windows, keys)
    kind = opened.schema["open"].dataType
    rows = samples.where(F.col("t_s").isNotNull()).dropna(subset=list(keys))
    rows = rows.select(*keys, F.col("t_s").cast("double").alias("_t"), F.lit(1).alias("_k"), F.struct("*").alias("_row"), F.lit(None).cast(kind).alias("open"))
    rows = rows.withColumn("chunk", chunk_of("_t", chunk_s))
    marks = opened.select(*keys, F.col("start_s").cast("double").alias("_t"), F.lit(0).alias("_k"), "open").withColumn("chunk", chunk_of("_t", chunk_s))
    # what is open at a chunk's end is marked anew in each chunk up to the next that has marks, or the recording's last
    ends = marks.groupBy(*keys, "chunk").agg(F.max_by("open", "_t").alias("open"))
    stop = rows.groupBy(*keys).agg((F.max("chunk") + 1).alias("chunk")).withColumn("open", F.lit(None).cast(kind))
    ends = ends.unionByName(stop).withColumn("_to", F.lead("chunk").over(by(keys, "chunk"))).where("open is not null and _to > chunk")
    handed = ends.select(*keys, F.lit(None).cast("double").alias("_t"), F.lit(-1).alias("_k"), "open", F.explode(F.sequence(F.col("chunk") + 1, "_to")).alias("chunk"))
    both = rows.unionByName(marks.unionByName(handed).withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType)))
    line = Window.partitionBy(*keys, "chunk").orderBy(F.col("_t").asc_nulls_first(), "_k")
    met = both.withColumn("open", F.last("open", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("_k = 1")
    met = met.select(*keys, "chunk", "_row", F.inline("open")).where(F.col("end_s").isNull() | (F.col("_row.t_s") < F.col("end_s")))
    met = met.select(*keys, "chunk", "event_ix", "description", "start_s", "end_s", "_row", F.col("_row.sample_ix").alias("_ix"))
    out = numbered(met, [*keys, "event_ix"], "_ix") if count else met.withColumn("n", F.col("_ix"))
    rest = [F.col(f"_row.{c}").alias(c) for c in samples.columns if c not in keys and c != "sample_ix"]
    return out.select(*keys, F.col("n").cast("long").alias("sample_ix"), *rest, "event_ix", "description", "start_s", "end_s")


def before_after(epochs: DataFrame, pre: tuple[float, float], post: tuple[float, float]) -> DataFrame:
    """Samples with window_type "pre" or "post"; windows are half open."""
    t = F.col("t_ms")
    kind = F.when((t >= pre[0]) & (t < pre[1]), "pre").when((t >= post[0]) & (t < post[1]), "post")
    return epochs.withColumn("window_type", kind).where("window_type is not null")


def occurrence_over_trials(epochs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., t_ms, state, occ): share of all trials in a state at each time, on a full grid of times and states."""
    trials = epochs.groupBy(*keys).agg(F.countDistinct("trial").alias("_n"), F.collect_set("label").alias("_states"))
    hits = epochs.where(F.col("label").isNotNull()).groupBy(*keys, "t_ms", F.col("label").alias("state")).agg(F.count("*").alias("_c"))
    times = epochs.select(*keys, "t_ms").distinct()
    grid = times.join(trials, list(keys)) if keys else times.crossJoin(F.broadcast(trials))  # one row beside times
    grid = grid.select(*keys, "t_ms", "_n", F.explode("_states").alias("state"))
    return grid.join(hits, [*keys, "t_ms", "state"], "left").select(*keys, "t_ms", "state", (F.coalesce("_c", F.lit(0)) / F.col("_n")).alias("occ"))


def centred_log_ratio(shares: DataFrame, keys: Sequence[str] = ("t_ms",), value: str = "occ", delta: float = 0.5) -> DataFrame:
    """Adds clr: log shares less their mean, zeros first replaced by ``delta`` times the least positive share over the number of states."""
    w = Window.partitionBy(*keys)
    x = F.col(value)
    rows = shares.withColumns({"_d": F.count("*").over(w), "_z": F.sum((x == 0).cast("int")).over(w), "_s": F.sum(x).over(w), "_p": F.min(F.when(x > 0, x)).over(w)})
    eps = delta * F.col("_p") / F.col("_d")
    # what the zeros get is taken from the others in proportion, and the whole keeps its sum
    kept = F.when(x == 0, eps).otherwise(x - eps * F.col("_z") * x / F.col("_s"))
    rows = rows.withColumn("_x", kept).withColumn("_x", F.col("_x") * F.col("_s") / F.sum("_x").over(w))
    rows = rows.withColumn("_l", F.log("_x"))
    return rows.withColumn("clr", F.col("_l") - F.avg("_l").over(w)).drop("_d", "_z", "_s", "_p", "_x", "_l")


def relative_occurrence(epochs: DataFrame, baseline: tuple[float, float] = (-1000.0, -10.0), keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., t_ms, state, occ, clr, clr_bc): clr_bc is less the state's median over baseline times, both ends included."""
    rows = centred_log_ratio(occurrence_over_trials(epochs, keys), [*keys, "t_ms"])
    inside = F.when(F.col("t_ms").between(*baseline), F.col("clr"))
    base = rows.groupBy(*keys, "state").agg(F.median(inside).alias("_b"))
    return rows.join(base, [*keys, "state"]).select(*keys, "t_ms", "state", "occ", "clr", (F.col("clr") - F.col("_b")).alias("clr_bc"))


def transition_rates(epochs: DataFrame, windows: dict[str, tuple[float, float]], baseline: tuple[float, float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys..., window, state, state_to, rate, pct_change): mean transitions per trial and step, and change from the baseline.

    A step lies midway between two times of a trial; steps without the transition count as zero. A pair that the
    baseline lacks is divided by 1e-10.
    """
    trial = Window.partitionBy(*keys, "trial").orderBy("t_ms")
    steps = epochs.select(*keys, "trial", "t_ms", F.lead("t_ms").over(trial).alias("_t"), F.col("label").alias("state"), F.lead("label").over(trial).alias("state_to"))
    steps = steps.where("_t is not null").withColumn("at", (F.col("t_ms") + F.col("_t")) / 2)
    spans = {"baseline": baseline, **windows}
    kinds = F.array(*[F.when(F.col("at").between(a, b), F.lit(n)) for n, (a, b) in spans.items()])
    steps = steps.withColumn("window", F.explode(F.array_compact(kinds)))
    of = steps.groupBy(*keys, "window").agg((F.countDistinct("trial") * F.countDistinct("at")).alias("_n"))
    n = steps.where("state <> state_to").groupBy(*keys, "window", "state", "state_to").agg(F.count("*").alias("_c"))
    rate = n.join(of, [*keys, "window"]).select(*keys, "window", "state", "state_to", (F.col("_c") / F.col("_n")).alias("rate"))
    base = rate.where("window = 'baseline'").select(*keys, "state", "state_to", F.col("rate").alias("_b"))
    out = rate.where("window <> 'baseline'").join(base, [*keys, "state", "state_to"], "left")
    b = F.coalesce("_b", F.lit(0.0))
    change = 100 * (F.col("rate") - b) / F.when(b == 0, F.lit(1e-10)).otherwise(b)
    return out.select(*keys, "window", "state", "state_to", "rate", change.alias("pct_change"))
