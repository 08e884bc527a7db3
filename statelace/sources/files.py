"""Readers and writers of recordings, montages, events, templates, segmentations and features.

Everything goes through Spark's readers, so paths may be in any store that Spark reaches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

# Suffixes of recordings.
SUFFIXES = (".vhdr", ".edf", ".bdf", ".gdf", ".cnt", ".egi", ".mff", ".set", ".data", ".nxe", ".lay")


#: Columns that a wide table has at most.
MOST_COLUMNS = 10_000


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def find_files(spark: SparkSession, folder: str, suffix: str = ".auto", pattern: str = "*", derivatives: bool = True) -> DataFrame:
    """(path, name, length) of files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    wanted = SUFFIXES if suffix == ".auto" else (suffix,)
    f = files.select("path", stem(F.col("path")).alias("name"), "length")
    keep = F.lit(False)
    for s in wanted:
        keep = keep | F.lower("path").endswith(s)
    return f.where(keep & (F.lit(derivatives) | ~F.contains("path", F.lit("/derivatives/"))))


def unassigned_to_null(label: Column) -> Column:
    """Unassigned samples are written NaN, nan or nothing."""
    return F.when(~F.lower(F.trim(label)).isin("nan", ""), label)


def read_segmentation(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    """(recording_id, trial, sample_ix, t_ms, label) from files with columns [trial,] time, label."""
    from pyspark.sql import Window

    df = spark.read.csv(path, header=True, inferSchema=False) if kind == "csv" else spark.read.format(kind).load(path)
    trial = F.col("trial").cast("int") if "trial" in df.columns else F.lit(1)
    rows = df.select(stem(F.col("_metadata.file_path")).alias("recording_id"), trial.alias("trial"), F.col("time").cast("double").alias("t_ms"), unassigned_to_null(F.col("label").cast("string")).alias("label"))
    order = Window.partitionBy("recording_id", "trial").orderBy("t_ms")
    return rows.withColumn("sample_ix", (F.row_number().over(order) - 1).cast("long")).select("recording_id", "trial", "sample_ix", "t_ms", "label")


def write_segmentation(seg: DataFrame, path: str, kind: str = "csv") -> None:
    """One folder per recording; unassigned is NaN."""
    rows = seg.select("recording_id", "trial", F.col("t_ms").alias("time"), F.coalesce("label", F.lit("NaN")).alias("label"))
    rows = rows.repartition("recording_id").sortWithinPartitions("recording_id", "trial", "time")
    writer = rows.write.mode("overwrite").partitionBy("recording_id")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)


def read_templates(spark: SparkSession, path: str) -> DataFrame:
    """(state, label, topo) from a table of channel rows and state columns."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    labels = [c for c in df.columns if c != "channel"]
    w = df.select(F.monotonically_increasing_id().alias("_i"), *labels)
    parts = [F.transform(F.sort_array(F.collect_list(F.struct("_i", F.col(f"`{c}`").cast("double").alias("x")))), lambda s: s["x"]).alias(c) for c in labels]
    wide = w.agg(*parts)
    each = F.array(*[F.struct(F.lit(i).alias("state"), F.lit(c).alias("label"), F.col(f"`{c}`").alias("topo")) for i, c in enumerate(labels)])
    return wide.select(F.inline(each))


def write_templates(templates: DataFrame, channels: Sequence[str], path: str) -> None:
    """Channel rows, one column per state: a table of channels x states."""
    labels = [r["label"] for r in templates.orderBy("state").select("label").collect()]
    names = F.array(*map(F.lit, channels))
    rows = templates.select("label", F.posexplode("topo").alias("i", "x")).groupBy("i").pivot("label", labels).agg(F.first("x"))
    rows.orderBy("i").select(F.get(names, F.col("i")).alias("channel"), *[F.col(f"`{c}`") for c in labels]).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """(recording_id, onset_s, duration_s, description) from BIDS event tables."""
    df = spark.read.csv(path, header=True, sep="\t")
    name = F.regexp_replace(stem(F.col("_metadata.file_path")), "_events$", "")
    duration = F.col("duration").cast("double") if "duration" in df.columns else F.lit(0.0)
    return df.select(name.alias("recording_id"), F.col("onset").cast("double").alias("onset_s"), duration.alias("duration_s"), F.col("trial_type").alias("description"))


def read_electrodes(spark: SparkSession, path: str, montage: str | None = None) -> DataFrame:
    """(montage, channel_ix, name, x, y, z) from electrode lists with columns labels, X, Y, Z: axes turn to x = -Y, y = X; units become metres.

    Each file is a montage of its own, named after the file, with channels counted in its order and units told from its
    farthest electrode; ``montage`` renames that of a single file.
    """
    df = spark.read.csv(path, header=True, sep="\t", inferSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    place = F.struct("_metadata.file_block_start", F.monotonically_increasing_id())
    rows = df.select(stem(F.col("_metadata.file_path")).alias("_file"), place.alias("_at"), F.trim("labels").alias("name"), *[F.col(c).cast("double").alias(c) for c in ("X", "Y", "Z")]).dropna()
    if montage is not None and rows.select("_file").distinct().limit(2).count() > 1:
        raise ValueError("several electrode lists can't be one montage")
    file = Window.partitionBy("_file")
    rows = rows.withColumn("_r", F.max(F.sqrt(F.col("X") ** 2 + F.col("Y") ** 2 + F.col("Z") ** 2)).over(file))
    unit = F.when(F.col("_r") > 20, 1e-3).when(F.col("_r") > 2, 1e-2).when(F.col("_r") > 0.5, 0.095 / F.col("_r")).otherwise(1.0)
    rows = rows.withColumn("channel_ix", F.row_number().over(file.orderBy("_at")) - 1)
    name = F.lit(montage) if montage is not None else F.col("_file")
    return rows.select(name.alias("montage"), F.col("channel_ix").cast("int").alias("channel_ix"), "name", (-F.col("Y") * unit).alias("x"), (F.col("X") * unit).alias("y"), (F.col("Z") * unit).alias("z"))


def write_features(long: DataFrame, folder: str, sequence: str, mode: str, kind: str = "csv") -> str:
    """``folder``/{sequence}_{mode}_features, as csv, json lines or parquet."""
    path = f"{folder}/{sequence}_{mode}_features"
    writer = long.write.mode("overwrite")
    writer.option("header", True).csv(path) if kind == "csv" else writer.format(kind).save(path)
    return path


def read_features(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True) if kind == "csv" else spark.read.format(kind).load(path)


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def changed(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """(path, problem): recorded artefacts that are gone or differ."""
    j = recorded.select("path", F.col("sha256").alias("_was")).join(now.select("path", "sha256"), "path", "left")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("_was"), "changed")
    return j.select("path", problem.alias("problem")).where("problem is not null")


def _wide(long: DataFrame, keys: Sequence[str], column: str, names: Sequence[str] | None, value: str) -> DataFrame:
    """One column per name; names not given are found in the data. Missing cells are null. More than MOST_COLUMNS names are an error."""
    found = list(names) if names is not None else [r[0] for r in long.select(column).distinct().orderBy(column).limit(MOST_COLUMNS + 1).collect()]
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"a table of over {MOST_COLUMNS} columns; give the names of those wanted, or keep the long form")
    return long.groupBy(*keys).pivot(column, found).agg(F.avg(value)).orderBy(*keys)


def rof_table(rof: DataFrame, states: Sequence[str] | None = None, value: str = "clr_bc", key: str = "recording_id") -> DataFrame:
    """(file, time, ROF_state...): relative occurrence in one row per file and time, sorted."""
    out = _wide(rof, [key, "t_ms"], "state", states, value)
    return out.withColumnsRenamed({c: f"ROF_{c}" for c in out.columns if c not in (key, "t_ms")})


def rof_long(rof: DataFrame, value: str = "clr_bc", key: str = "recording_id") -> DataFrame:
    """(file, time, state, value), sorted."""
    return rof.select(key, "t_ms", "state", F.col(value).alias("value")).orderBy(key, "t_ms", "state")


def rtf_table(rtf: DataFrame, names: Sequence[str] | None = None, wanted: str = "post_tms", key: str = "recording_id") -> DataFrame:
    """(file, RTF_from_to...): changes of transition rates in the window ``wanted``, or the first other one where a file lacks it."""
    rank = F.struct((F.col("window") != wanted).alias("_o"), F.col("window").alias("_w"))
    best = rtf.groupBy(F.col(key).alias("_k")).agg(F.min(rank)["_w"].alias("_best"))
    rows = rtf.join(best, (rtf[key] == best["_k"]) & (rtf["window"] == best["_best"])).where("state <> state_to")
    return _wide(rows.withColumn("_n", F.concat_ws("_", F.lit("RTF"), "state", "state_to")), [key], "_n", names, "pct_change")


def variability_table(variability: DataFrame, names: Sequence[str] | None = None, key: str = "recording_id") -> DataFrame:
    """(file, DUR_SD_state...): rows (file, state, feature, value) in one row per file."""
    return _wide(variability.withColumn("_n", F.concat_ws("_", "feature", "state")), [key], "_n", names, "value")


def rof_columns(table: DataFrame) -> DataFrame:
    """(file, t_ms, state, value) of a wide table of any origin: time and file columns are known by name, all other numbers are states."""
    lower = {c.lower(): c for c in table.columns}
    time = next((lower[n] for n in ("t_ms", "time", "time_ms", "times", "time (ms)") if n in lower), None)
    file = next((lower[n] for n in ("filename", "file", "recording_id", "subject", "name") if n in lower), None)
    if time is None:
        raise ValueError("no column of times")
    numbers = {"double", "float", "int", "bigint"}
    states = [c for c, kind in table.dtypes if kind in numbers and c not in (time, file)]
    cells = F.array(*[F.struct(F.lit(c.removeprefix("ROF_")).alias("state"), F.col(f"`{c}`").cast("double").alias("value")) for c in states])
    of = F.lit(None).cast("string") if file is None else F.col(f"`{file}`").cast("string")
    return table.select(of.alias("file"), F.col(f"`{time}`").cast("double").alias("t_ms"), F.inline(cells))


def feature_kinds(table: DataFrame) -> DataFrame:
    """(feature, states): the codes that a long feature table has, with how many states."""
    return table.groupBy("feature").agg(F.countDistinct("state").alias("states"))


def averaged_sources(sources: DataFrame, label: str) -> DataFrame:
    """(subject, src, labels): sources of one state, with all states the subject has. Rows: (subject, label, src)."""
    has = sources.groupBy("subject").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    return sources.where(F.col("label") == label).select("subject", "src").join(has, "subject")


def load_clean(spark: SparkSession, folder: str, kind: str = "parquet") -> DataFrame:
    """Recordings below a study folder: the cleaned derivative of each where there is one, else the raw one.

    ``folder``/raw and ``folder``/derivatives hold rows (recording_id, ...) in the same columns.
    """
    raw = spark.read.format(kind).load(f"{folder}/raw")
    try:
        clean = spark.read.format(kind).load(f"{folder}/derivatives")
    except AnalysisException:  # no derivative at all
        return raw
    return raw.join(clean.select("recording_id").distinct(), "recording_id", "left_anti").unionByName(clean)


def write_recordings(samples: DataFrame, path: str) -> str:
    """Samples as Parquet, one folder per recording."""
    samples.write.mode("overwrite").partitionBy("recording_id").parquet(path)
    return path
