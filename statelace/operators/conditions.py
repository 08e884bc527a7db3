"""Finding what varies between the two recordings of each subject, from file names alone.

Three ways are tried in turn: the two names of a subject, components with a meaning (subject, session, task, run,
condition), and parts between delimiters. Each is grouping with counts and least and greatest names, so a base that
many names share is no burden; the driver sees the two conditions, never names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statelace.functions import names as N

# Words for conditions and what they mean, in the order in which they are looked for.
WORDS = (
    ("eyesclosed", "eyesclosed"), ("eyesclose", "eyesclosed"), ("eyeclose", "eyesclosed"), ("ec", "eyesclosed"), ("closed", "eyesclosed"), ("close", "eyesclosed"),
    ("eyesopen", "eyesopen"), ("eyeopen", "eyesopen"), ("eo", "eyesopen"), ("open", "eyesopen"),
    ("pre", "pre"), ("post", "post"), ("before", "pre"), ("after", "post"),
    ("active", "active"), ("baseline", "baseline"), ("base", "baseline"), ("rest", "rest"), ("resting", "rest"), ("task", "task"),
    ("sham", "sham"), ("real", "real"), ("verum", "real"), ("control", "control"), ("treatment", "treatment"), ("placebo", "placebo"), ("drug", "drug"),
    ("a", "a"), ("b", "b"), ("c", "c"), ("d", "d"), ("1", "1"), ("2", "2"), ("3", "3"), ("4", "4"),
    ("cond1", "cond1"), ("cond2", "cond2"), ("condition1", "cond1"), ("condition2", "cond2"),
    ("stim", "stim"), ("nostim", "nostim"), ("stimulation", "stim"),
    ("session1", "session1"), ("session2", "session2"), ("run1", "run1"), ("run2", "run2"),
)

# What is cut from the ends of names, and parts that say no condition.
EXTENSION = r"\.(eeg|set|fdt|edf|bdf|cnt|vhdr|vmrk|fif|gz|mat)$"
PROCESSING = r"[_\-](eeg|clean|proc|preproc|processed|raw|filt|filtered|ica|epoch|avg)$"
SILENT_PART = r"^((sub|subject|subj|s|p|participant)|\d{1,3})$"

# Patterns of numbered components, in the order in which they are tried.
NUMBERED = {
    "subject": ("sub", (r"sub-?(\d+)", r"subject-?(\d+)", r"s(\d+)(?=[_\-\.]|$)", r"participant-?(\d+)", r"p(\d+)(?=[_\-\.]|$)")),
    "session": ("ses", (r"ses-?session(\d+)", r"ses-?(\d+)", r"session-?(\d+)", r"sess-?(\d+)")),
    "run": ("run", (r"run-?(\d+)", r"r(\d+)(?=[_\-\.]|$)")),
}

# Task labels that are conditions, labels of acquisitions, and patterns of conditions, in order.
NO_TASK = ("eyesclosed", "eyesopen", "closed", "open", "ec", "eo", "rest", "resting", "active", "baseline", "stimulation", "stim", "pre", "post", "before", "after", "control", "treatment", "a", "b", "1", "2", "cond1", "cond2", "condition1", "condition2")
ACQUISITION = (("active", "active"), ("sham", "sham"), ("rest", "rest"), ("baseline", "baseline"), ("pre", "pre"), ("post", "post"), ("stim", "stimulation"), ("nostim", "nostimulation"), ("real", "real"), ("control", "control"), ("treatment", "treatment"))
CONDITION = (
    (r"task-?(eyesclosed|eyes?closed|ec)", "eyesclosed"), (r"task-?(eyesopen|eyes?open|eo)", "eyesopen"), (r"task-?(rest|resting)", "rest"),
    (r"task-?(active)", "active"), (r"task-?(baseline|base)", "baseline"), (r"task-?(stimulation|stim)", "stimulation"),
    (r"\b(eyesclosed|eyes?closed|ec)\b", "eyesclosed"), (r"\b(eyesopen|eyes?open|eo)\b", "eyesopen"), (r"\b(restingstate|resting|rest)\b", "rest"),
    (r"\b(baseline|base)\b", "baseline"), (r"\b(stimulation|stim)\b", "stimulation"), (r"\b(pre)\b", "pre"), (r"\b(post)\b", "post"),
    (r"\b(active)\b", "active"), (r"\b(passive)\b", "passive"), (r"\b(control|ctrl)\b", "control"), (r"\b(treatment|treat)\b", "treatment"),
    (r"\b(sham)\b", "sham"), (r"\b(real)\b", "real"),
)
DELIMITERS = ("_", "-", ".", " ")


def _table(pairs) -> Column:
    return F.expr("array(" + ", ".join(f"struct('{a}' AS word, '{b}' AS means)" for a, b in pairs) + ")")


def _exact(part: Column) -> Column:
    return F.get(F.filter(_table(WORDS), lambda w: w["word"] == part), 0)["means"]


def _inside(part: Column, pairs=WORDS) -> Column:
    """Meaning of the first word of two letters or more that ``part`` holds."""
    return F.get(F.filter(_table([w for w in pairs if len(w[0]) > 1]), lambda w: F.contains(part, w["word"])), 0)["means"]


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), 0)


def _parsed(value: Column, f) -> Column:
    """The fields of the struct ``f`` of a value as columns, computed once a row.

    As a generator, so that filters on the fields are neither computed anew nor moved to before a shuffle, where a small file is one task.
    """
    return F.inline(F.transform(F.array(value), lambda x: f(x)))


def _labelled(name: Column) -> Column:
    """Condition that a task- or else an acq- label says."""
    label = F.coalesce(N.extract(name, "task-([a-z0-9]+)"), N.extract(name, "acq-([a-z0-9]+)"))
    return _let(label, lambda x: F.coalesce(_exact(x), _inside(x), x))


def _of_parts(parts: Column) -> Column:
    """Condition of parts that one name alone has: a known word, a part that holds one, or the longest (the first of equals)."""

    def choose(p: Column) -> Column:
        first = lambda f: F.get(F.filter(F.transform(p, lambda x: f(x)), lambda c: c.isNotNull()), 0)
        longest = F.array_max(F.transform(p, lambda x: F.length(x)))
        return F.coalesce(first(_exact), first(_inside), _let(longest, lambda n: F.get(F.filter(p, lambda x: F.length(x) == n), 0)))

    return _let(parts, choose)


def varying(first: Column, second: Column) -> Column:
    """Struct (a, b) of what differs between two names of a subject, null if nothing does.

    Labels of tasks or acquisitions are compared first, then parts that one name alone has, then parts place by place.
    """
    clean = lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), EXTENSION, ""), PROCESSING, "")
    parts = lambda x: F.filter(F.split(x, r"[_\-\.]"), lambda p: (p != "") & ~F.rlike(p, F.lit(SILENT_PART)))
    known = lambda p: F.coalesce(_exact(p), p)
    differ = lambda a, b: _let(F.struct(a.alias("a"), b.alias("b")), lambda w: F.when(w["a"] != w["b"], w))

    def ways(n: Column) -> Column:
        p, q = n["p"], n["q"]
        placed = F.zip_with(p, q, lambda x, y: F.struct(known(x).alias("a"), known(y).alias("b")))
        return F.coalesce(
            differ(_labelled(n["x"]), _labelled(n["y"])),
            differ(_of_parts(F.array_except(p, q)), _of_parts(F.array_except(q, p))),
            F.get(F.filter(placed, lambda z: z["a"] != z["b"]), 0),
        )

    names = F.struct(clean(first).alias("x"), clean(second).alias("y"))
    both = _let(names, lambda n: F.struct(n["x"].alias("x"), n["y"].alias("y"), parts(n["x"]).alias("p"), parts(n["y"]).alias("q")))
    return _let(both, ways)


def components(name: Column) -> dict[str, Column]:
    """Columns subject, session, task, condition, run and labelled (whether an acquisition names the condition); null where a name has none."""
    return _components(_bare(name))


def _bare(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), PROCESSING, ""), EXTENSION, "")


def _components(clean: Column) -> dict[str, Column]:
    out = {}
    for kind, (prefix, patterns) in NUMBERED.items():
        number = F.coalesce(*[N.extract(clean, p) for p in patterns])
        out[kind] = F.concat(F.lit(prefix + "-"), N.two_digits(number))
    labels = [N.extract(clean, p) for p in ("task-([a-z0-9]+)", "task_([a-z0-9]+)")]
    out["task"] = F.coalesce(*[F.when(~x.isin(*NO_TASK), x) for x in labels])
    acquired = N.extract(clean, "acq-([a-z0-9]+)")
    said = F.coalesce(*[F.when(F.rlike(clean, F.lit(p)), c) for p, c in CONDITION])
    numbered = F.concat(F.lit("cond"), N.extract(clean, r"(?:condition|cond)(\d+)"))
    alone = lambda p: F.regexp_extract_all(clean, F.lit(p), F.lit(1))
    letters, digits = alone(r"[_\-]([a-z])(?=[_\-]|$)"), alone(r"[_\-](\d)(?=[_\-]|$)")
    letter = F.when(F.size(letters) == 1, F.get(letters, 0))
    digit = F.when(F.size(digits) == 1, F.concat(F.lit("cond"), F.get(digits, 0)))
    out["condition"] = F.coalesce(_let(acquired, lambda x: F.coalesce(_inside(x, ACQUISITION), x)), said, numbered, F.when(letter <= "h", letter), digit)
    out["labelled"] = acquired.isNotNull()
    return out


_OUT = "strategy string, component string, first_condition string, second_condition string, base string, first string, second string"


def _found(pairs: DataFrame, strategy: str, component: str, a: str, b: str) -> DataFrame:
    return pairs.select(F.lit(strategy).alias("strategy"), F.lit(component).alias("component"), F.lit(a).alias("first_condition"), F.lit(b).alias("second_condition"), "base", "first", "second")


def by_subject(files: DataFrame) -> DataFrame | None:
    """Pairs of subjects with two files where all subjects vary between the same two conditions; two subjects at least."""
    subject = files.select("name", _parsed(F.col("name"), lambda x: F.struct(N.subject_id(x).alias("base")))).where("base is not null")
    two = subject.groupBy("base").agg(F.count("*").alias("_n"), F.min("name").alias("x"), F.max("name").alias("y")).where("_n = 2")
    v = two.select("base", "x", "y", F.inline(F.array(varying(F.col("x"), F.col("y"))))).where("a is not null")
    turned = F.col("a") > F.col("b")
    pairs = v.select("base", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("first"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("second"))
    kinds = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).limit(2).collect()
    if len(kinds) != 1 or kinds[0]["n"] < 2:
        return None
    return _found(pairs, "subject", "condition", kinds[0]["a"], kinds[0]["b"])


def by_component(files: DataFrame) -> DataFrame | None:
    """Pairs that agree in all components but one, which has two values in all; two pairs at least, the first such component."""
    parsed = files.select("name", _parsed(_bare(F.col("name")), lambda x: F.struct(*[c.alias(k) for k, c in _components(x).items()])))
    kinds = ["subject", "session", "task", "condition", "run"]
    parsed = parsed.where(F.coalesce(*kinds).isNotNull())
    counted = parsed.agg(F.count("*").alias("n"), F.max("labelled").alias("labelled"), *[f(k).alias(f"{k}_{n}") for k in kinds for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if counted["n"] < 4:
        return None
    order = kinds if counted["labelled"] else ["subject", "session", "task", "run", "condition"]
    for kind in order:
        a, b = counted[f"{kind}_lo"], counted[f"{kind}_hi"]
        if a is None or a == b:
            continue
        rest = [k for k in kinds if k != kind]
        named = [F.concat(F.lit(k + ":"), F.col(k)) for k in sorted(rest)]
        rows = parsed.where(F.col(kind).isNotNull()).withColumn("base", F.concat_ws("|", *named))
        if rows.where(~F.col(kind).isin(a, b)).limit(1).count():  # a third value
            continue
        g = rows.groupBy("base").agg(F.count("*").alias("_n"), F.countDistinct(kind).alias("_k"), F.min_by("name", kind).alias("first"), F.max_by("name", kind).alias("second"))
        pairs = g.where("_n = 2 and _k = 2")
        if pairs.limit(2).count() == 2:
            return _found(pairs, "component", kind, a, b)
    return None


def by_delimiter(files: DataFrame) -> DataFrame | None:
    """Pairs that agree in all parts but one, by the first delimiter and the two values that most pairs differ in; two pairs at least."""
    each = [F.struct(F.lit(i).alias("d"), F.filter(F.split("name", f"\\Q{x}\\E"), lambda p: p != "").alias("p")) for i, x in enumerate(DELIMITERS)]
    parts = files.select("name", F.inline(F.array(*each))).withColumn("i", F.explode(F.when(F.size("p") > 0, F.sequence(F.lit(0), F.size("p") - 1))))
    rest = F.transform("p", lambda x, i: F.when(i == F.col("i"), "*").otherwise(x))
    rows = parts.select("name", "d", F.get("p", F.col("i")).alias("v"), F.array_join(rest, "\u0000").alias("_key"), F.array_join(rest, " ").alias("base"))
    g = rows.groupBy("d", "_key").agg(F.count("*").alias("_n"), F.min("base").alias("base"), F.min("v").alias("a"), F.max("v").alias("b"), F.min_by("name", "v").alias("first"), F.max_by("name", "v").alias("second"))
    pairs = g.where("_n = 2 and a <> b")
    best = pairs.groupBy("d", "a", "b").agg(F.count("*").alias("n")).where("n > 1").orderBy("d", F.desc("n"), "a", "b").limit(1).collect()
    if not best:
        return None
    d, a, b = best[0]["d"], best[0]["a"], best[0]["b"]
    return _found(pairs.where((F.col("d") == d) & (F.col("a") == a) & (F.col("b") == b)), "delimiter", DELIMITERS[d], a, b)


def varying_condition(files: DataFrame) -> DataFrame:
    """(strategy, component, first_condition, second_condition, base, first, second): a row for each pair of files, none if nothing is found.

    ``files`` are rows (name); names that are null or repeated are taken once or not at all. The three ways are tried in
    turn and the first that finds something stands. Conditions are ordered by name.
    """
    names = files.where("name is not null").select("name").distinct().persist()  # each way reads them, some more than once
    try:
        for way in (by_subject, by_component, by_delimiter):
            found = way(names)
            if found is not None:
                return found
    finally:
        names.unpersist()
    return files.sparkSession.createDataFrame([], _OUT)
