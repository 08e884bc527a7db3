"""Group comparisons and reliability of features.

Values are rows (feature, grp, subject, value). Statistics come from grouped aggregates; p values from Arrow functions
over the few result rows. Tests without enough data have a null statistic and p = 1.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from statelace.functions import special


def paired(values: DataFrame, a: str, b: str, how: str = "subject") -> DataFrame:
    """(feature, subject, x, y): values of two groups by subject, or i-th with i-th in the order of subjects ("order")."""
    v = values.where(F.col("grp").isin(a, b) & F.col("value").isNotNull() & ~F.isnan("value"))
    if how == "order":
        v = v.withColumn("subject", F.row_number().over(Window.partitionBy("feature", "grp").orderBy("subject")))
    elif how != "subject":
        raise ValueError(f"unknown pairing {how!r}")
    p = v.groupBy("feature", "subject").agg(F.avg(F.when(F.col("grp") == a, F.col("value"))).alias("x"), F.avg(F.when(F.col("grp") == b, F.col("value"))).alias("y"))
    return p.where("x is not null and y is not null")


def paired_t(pairs: DataFrame) -> DataFrame:
    """(feature, n, stat, df, d): t of mean(x - y); d is the mean difference over its deviation."""
    s = pairs.groupBy("feature").agg(F.count("*").alias("n"), F.avg(F.col("x") - F.col("y")).alias("m"), F.stddev_samp(F.col("x") - F.col("y")).alias("sd"))
    d = F.try_divide("m", "sd")
    return s.select("feature", "n", F.when(F.col("n") > 1, d * F.sqrt("n")).alias("stat"), (F.col("n") - 1).cast("double").alias("df"), F.when(F.col("n") > 1, d).alias("d"), "m", "sd")


def with_p(tests: DataFrame) -> DataFrame:
    """Adds p of Student's t from stat and df."""
    return tests.withColumn("p", F.coalesce(F.nanvl(special.t_p("stat", "df"), F.lit(1.0)), F.lit(1.0)))


def with_interval(tests: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds ci_low, ci_high of the mean difference of ``paired_t``."""
    half = special.t_upper(F.lit(0.5 + level / 2), "df") * F.col("sd") / F.sqrt("n")
    return tests.withColumn("_h", half).withColumns({"ci_low": F.col("m") - F.col("_h"), "ci_high": F.col("m") + F.col("_h")}).drop("_h")


def _two(values: DataFrame, a: str, b: str) -> DataFrame:
    return values.where(F.col("grp").isin(a, b) & F.col("value").isNotNull() & ~F.isnan("value"))


def levene(values: DataFrame, a: str, b: str) -> DataFrame:
    """(feature, stat, df1, df2): one-way F of absolute deviations from the group medians."""
    g = Window.partitionBy("feature", "grp")
    z = _two(values, a, b).withColumn("z", F.abs(F.col("value") - F.median("value").over(g)))
    s = z.groupBy("feature", "grp").agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v"))
    w = Window.partitionBy("feature")
    s = s.withColumn("all", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    t = s.groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("all")) ** 2).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"), F.sum("n").alias("n"), F.count("*").alias("k"))
    stat = F.try_divide(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k")))
    return t.where("k = 2").select("feature", stat.alias("stat"), F.lit(1.0).alias("df1"), (F.col("n") - 2).cast("double").alias("df2"))


def _moments(values: DataFrame, a: str, b: str) -> DataFrame:
    pick = lambda g: F.when(F.col("grp") == g, F.col("value"))
    return _two(values, a, b).groupBy("feature").agg(
        *[f(pick(g)).alias(n + i) for i, g in (("1", a), ("2", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))]
    )


def independent_t(values: DataFrame, a: str, b: str, equal: bool) -> DataFrame:
    """(feature, n1, n2, stat, df): pooled t if ``equal``, else Welch's."""
    s = _moments(values, a, b)
    q1, q2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    if equal:
        df: Column = (F.col("n1") + F.col("n2") - 2).cast("double")
        v = F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), df)
        se = F.sqrt(v * (1 / F.col("n1") + 1 / F.col("n2")))
    else:
        df = F.try_divide((q1 + q2) ** 2, q1**2 / (F.col("n1") - 1) + q2**2 / (F.col("n2") - 1))
        se = F.sqrt(q1 + q2)
    s = s.where("n1 > 1 and n2 > 1")
    return s.select("feature", "n1", "n2", F.try_divide(F.col("m1") - F.col("m2"), se).alias("stat"), df.alias("df"))


def t_test(values: DataFrame, a: str, b: str) -> DataFrame:
    """(feature, n1, n2, stat, df, p, welch): Welch's t where variances differ (Levene p < .05, three values each), else pooled."""
    lev = levene(values, a, b)
    lev = lev.select("feature", (special.f_p("stat", "df1", "df2") < 0.05).alias("_differ"))
    pooled, welch = independent_t(values, a, b, True), independent_t(values, a, b, False)
    w = welch.select("feature", F.col("stat").alias("_s"), F.col("df").alias("_d"))
    t = pooled.join(w, "feature").join(lev, "feature", "left")
    t = t.withColumn("welch", F.coalesce("_differ", F.lit(False)) & (F.least("n1", "n2") >= 3))
    t = t.select("feature", "n1", "n2", F.when(F.col("welch"), F.col("_s")).otherwise(F.col("stat")).alias("stat"), F.when(F.col("welch"), F.col("_d")).otherwise(F.col("df")).alias("df"), "welch")
    return with_p(t)


def cohens_d(values: DataFrame, a: str, b: str) -> DataFrame:
    """(feature, d): difference of means over the pooled deviation."""
    s = _moments(values, a, b)
    sd = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2"), F.col("n1") + F.col("n2") - 2))
    return s.where("n1 > 1 and n2 > 1").select("feature", F.try_divide(F.col("m1") - F.col("m2"), sd).alias("d"))


def mean_difference(values: DataFrame, a: str, b: str, level: float = 0.95) -> DataFrame:
    """(feature, n1, n2, mean1, mean2, diff, ci_low, ci_high): second less first, with an interval from both standard errors and n1 + n2 - 2 degrees."""
    s = _moments(values, a, b).where("n1 > 1 and n2 > 1")
    s = s.withColumn("_se", F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))).withColumn("_df", (F.col("n1") + F.col("n2") - 2).cast("double"))
    s = s.withColumn("_h", special.t_upper(F.lit(0.5 + level / 2), "_df") * F.col("_se"))
    diff = F.col("m2") - F.col("m1")
    return s.select("feature", "n1", "n2", F.col("m1").alias("mean1"), F.col("m2").alias("mean2"), diff.alias("diff"), (diff - F.col("_h")).alias("ci_low"), (diff + F.col("_h")).alias("ci_high"))


def _mean_rank(value: Column, *group: str) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*group, value)) - 1) / 2.0


def mann_whitney(values: DataFrame, a: str, b: str) -> DataFrame:
    """(feature, n1, n2, stat, z): U of the first group, z with tie and continuity correction."""
    r = _two(values, a, b).withColumn("r", _mean_rank(F.col("value"), "feature"))
    ties = r.groupBy("feature", "value").agg(F.count("*").cast("double").alias("t")).groupBy("feature").agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    s = r.groupBy("feature").agg(F.sum(F.when(F.col("grp") == a, F.col("r"))).alias("r1"), F.count_if(F.col("grp") == a).alias("n1"), F.count_if(F.col("grp") == b).alias("n2")).join(ties, "feature")
    n = F.col("n1") + F.col("n2")
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("ties") / (n * (n - 1))))
    off = u - F.col("n1") * F.col("n2") / 2.0
    s = s.where("n1 > 0 and n2 > 0")
    return s.select("feature", "n1", "n2", u.alias("stat"), F.try_divide(F.signum(off) * F.greatest(F.abs(off) - 0.5, F.lit(0.0)), sd).alias("z"))


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """(feature, n, stat, z): the smaller signed-rank sum, zeros left out, z with tie correction."""
    d = pairs.select("feature", (F.col("x") - F.col("y")).alias("d")).where("d <> 0").withColumn("m", F.abs("d"))
    r = d.withColumn("r", _mean_rank(F.col("m"), "feature"))
    ties = r.groupBy("feature", "m").agg(F.count("*").cast("double").alias("t")).groupBy("feature").agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    s = r.groupBy("feature").agg(F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down")).join(ties, "feature")
    n = F.col("n").cast("double")
    w = F.least("up", "down")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return s.select("feature", "n", w.alias("stat"), F.try_divide(w - n * (n + 1) / 4, sd).alias("z"))


def wilcoxon_p(pairs: DataFrame, most: int = 50) -> DataFrame:
    """(feature, n, stat, z, p, exact): ``wilcoxon`` with p counted out for up to ``most`` pairs without ties or equal values, else normal."""
    size = F.abs(F.col("x") - F.col("y"))
    plain = pairs.groupBy("feature").agg(((F.min(size) > 0) & (F.countDistinct(size) == F.count("*"))).alias("_plain"))
    t = with_normal_p(wilcoxon(pairs)).join(plain, "feature").withColumn("exact", F.col("_plain") & (F.col("n") <= most))

    @F.pandas_udf("double")
    def counted(w: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([special.signed_rank_p(a, int(b)) if b <= most else math.nan for a, b in zip(w, n)], dtype=float)

    return t.select("feature", "n", "stat", "z", F.when(F.col("exact"), counted("stat", "n")).otherwise(F.col("p")).alias("p"), "exact")


def with_normal_p(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", F.coalesce(F.nanvl(special.normal_p("z"), F.lit(1.0)), F.lit(1.0)))


# --- multiple tests: rows (feature, p) ------------------------------------------------------------------------------

STEP_METHODS = ("bonferroni", "sidak", "holm", "holm-sidak", "fdr_bh")


def adjust(tests: DataFrame, method: str = "fdr_bh", family: tuple[str, ...] = ()) -> DataFrame:
    """Adds p_adj within each family."""
    if method not in STEP_METHODS:
        return _adjust_all(tests, method, family)
    group = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(1))
    up = group.orderBy("p", "feature")
    m, i = F.count("p").over(group), F.row_number().over(up)
    p, left = F.col("p"), F.col("_m") - F.col("_i") + 1
    t = tests.withColumns({"_m": m, "_i": i})
    so_far = up.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    from_here = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    value = {
        "bonferroni": lambda: p * F.col("_m"),
        "sidak": lambda: 1 - F.pow(1 - p, F.col("_m")),
        "holm": lambda: F.max(p * left).over(so_far),
        "holm-sidak": lambda: F.max(1 - F.pow(1 - p, left)).over(so_far),
        "fdr_bh": lambda: F.min(p * F.col("_m") / F.col("_i")).over(from_here),
    }[method]()
    return t.withColumn("p_adj", F.least(value, F.lit(1.0))).drop("_m", "_i")


def hommel(p: np.ndarray) -> np.ndarray:
    n = len(p)
    order = np.argsort(p, kind="stable")
    q = p[order]
    out = q.copy()
    for m in range(n, 1, -1):
        tail = q[n - m + 1 :]
        c = (m * tail / np.arange(2, m + 1)).min()
        out[n - m + 1 :] = np.maximum(out[n - m + 1 :], c)
        head = slice(0, n - m + 1)
        out[head] = np.maximum(out[head], np.minimum(c, m * q[head]))
    back = np.empty(n)
    back[order] = np.minimum(out, 1.0)
    return back


def _bh(p: np.ndarray) -> np.ndarray:
    n, order = len(p), np.argsort(p, kind="stable")
    out = np.empty(n)
    out[order] = np.minimum(np.minimum.accumulate((p[order] * n / np.arange(1, n + 1))[::-1])[::-1], 1.0)
    return out


def two_stage(p: np.ndarray, alpha: float, yekutieli: bool) -> np.ndarray:
    """Two-stage FDR: the first stage estimates how many hypotheses are null, the second scales by it."""
    n = len(p)
    level = alpha / (1 + alpha) if yekutieli else alpha
    rejected = int((_bh(p) <= level).sum())
    if rejected == n:
        return _bh(p)
    factor = (n - rejected) / n * ((1 + alpha) if yekutieli else 1.0)
    return np.minimum(_bh(p) * factor if rejected else _bh(p) * ((1 + alpha) if yekutieli else 1.0), 1.0)


def _adjust_all(tests: DataFrame, method: str, family: tuple[str, ...]) -> DataFrame:
    """Methods that need a family's p values at once; a family is a list of tests."""
    rule = {"hommel": hommel, "fdr_tsbh": lambda p: two_stage(p, 0.05, False), "fdr_tsbky": lambda p: two_stage(p, 0.05, True)}
    if method not in rule:
        raise ValueError(f"unknown correction {method!r}")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ok = g["p"].notna()
        g["p_adj"] = np.nan
        g.loc[ok, "p_adj"] = rule[method](g.loc[ok, "p"].to_numpy(float))
        return g

    schema = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in tests.schema) + ", p_adj double"
    return tests.groupBy(*family).applyInPandas(run, schema)


# --- reliability -----------------------------------------------------------------------------------------------------


def icc(values: DataFrame) -> DataFrame:
    """(feature, n, icc, ms_rows, ms_error): ICC(2,1) of rows (feature, subject, session, value), complete subjects only."""
    k = values.select("feature", "session").distinct().groupBy("feature").agg(F.count("*").alias("k"))
    per = values.groupBy("feature", "subject", "session").agg(F.avg("value").alias("v"))
    full = per.join(k, "feature").withColumn("_n", F.count("v").over(Window.partitionBy("feature", "subject"))).where("_n = k")
    w = Window.partitionBy("feature")
    rows = full.withColumns({"g": F.avg("v").over(w), "r": F.avg("v").over(Window.partitionBy("feature", "subject")), "c": F.avg("v").over(Window.partitionBy("feature", "session"))})
    s = rows.groupBy("feature").agg(
        F.countDistinct("subject").cast("double").alias("n"),
        F.max("k").cast("double").alias("k"),
        F.sum((F.col("r") - F.col("g")) ** 2).alias("rows"),
        F.sum((F.col("c") - F.col("g")) ** 2).alias("cols"),
        F.sum((F.col("v") - F.col("r") - F.col("c") + F.col("g")) ** 2).alias("error"),
    )
    n, kk = F.col("n"), F.col("k")
    s = s.where("n > 1 and k > 1").withColumns({"ms_rows": F.col("rows") / (n - 1), "ms_cols": F.col("cols") / (kk - 1), "ms_error": F.col("error") / ((n - 1) * (kk - 1))})
    value = F.try_divide(F.col("ms_rows") - F.col("ms_error"), F.col("ms_rows") + (kk - 1) * F.col("ms_error") + kk * (F.col("ms_cols") - F.col("ms_error")) / n)
    return s.select("feature", n.cast("long").alias("n"), value.alias("icc"), "ms_rows", "ms_error", kk.alias("k"))


def icc_interval(table: DataFrame, level: float = 0.95) -> DataFrame:
    """Adds ci_low, ci_high from the F of rows over error, within [0, 1]."""

    @F.pandas_udf("ci_low double, ci_high double")
    def bounds(n: pd.Series, k: pd.Series, rows: pd.Series, error: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, r, e in zip(n, k, rows, error):
            f, d1, d2 = (r / e if e else math.inf), a - 1, (a - 1) * (b - 1)
            low, high = f / special.f_quantile(0.5 + level / 2, d1, d2), f * special.f_quantile(0.5 + level / 2, d2, d1)
            out.append([min(1.0, max(0.0, (x - 1) / (x + b - 1))) if math.isfinite(x) else 1.0 for x in (low, high)])
        return pd.DataFrame(out, columns=["ci_low", "ci_high"])

    return table.withColumn("_b", bounds("n", "k", "ms_rows", "ms_error")).select(*table.columns, "_b.*")


def mean_interval(values: DataFrame, *group: str) -> DataFrame:
    """(group..., mean, low, high): mean with 1.96 standard errors."""
    s = values.groupBy(*group).agg(F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"))
    return s.select(*group, "mean", (F.col("mean") - 1.96 * F.col("se")).alias("low"), (F.col("mean") + 1.96 * F.col("se")).alias("high"))


# --- groups of more than two, offered beside the two-group tests ---------------------------------------------------------


def one_way(values: DataFrame) -> DataFrame:
    """(feature, stat, df1, df2): one-way analysis of variance over grp."""
    s = values.where("value is not null").groupBy("feature", "grp").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    w = Window.partitionBy("feature")
    s = s.withColumn("g", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    t = s.groupBy("feature").agg(F.sum(F.col("n") * (F.col("m") - F.col("g")) ** 2).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum("n").alias("n"), F.count("*").alias("k"))
    return t.where("k > 1").select("feature", F.try_divide(F.col("b") / (F.col("k") - 1), F.col("w") / (F.col("n") - F.col("k"))).alias("stat"), (F.col("k") - 1).cast("double").alias("df1"), (F.col("n") - F.col("k")).cast("double").alias("df2"))


def kruskal(values: DataFrame) -> DataFrame:
    """(feature, stat, df): Kruskal-Wallis H with tie correction."""
    r = values.where("value is not null").withColumn("r", _mean_rank(F.col("value"), "feature"))
    ties = r.groupBy("feature", "value").agg(F.count("*").cast("double").alias("t")).groupBy("feature").agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"), F.sum("t").alias("n"))
    g = r.groupBy("feature", "grp").agg((F.sum("r") ** 2 / F.count("*")).alias("q")).groupBy("feature").agg(F.sum("q").alias("q"), F.count("*").alias("k"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n**3 - n))
    return g.join(ties, "feature").select("feature", h.alias("stat"), (F.col("k") - 1).cast("double").alias("df"))


def friedman(values: DataFrame) -> DataFrame:
    """(feature, n, stat, df): Friedman's chi-square of ranks within subjects that have every group."""
    k = values.where("value is not null").select("feature", "grp").distinct().groupBy("feature").agg(F.count("*").alias("k"))
    per = values.groupBy("feature", "subject", "grp").agg(F.avg("value").alias("value")).join(k, "feature")
    full = per.withColumn("_n", F.count("value").over(Window.partitionBy("feature", "subject"))).where("_n = k")
    r = full.withColumn("r", _mean_rank(F.col("value"), "feature", "subject"))
    sums = r.groupBy("feature", "grp", "k").agg(F.sum("r").alias("s"), F.count("*").cast("double").alias("n")).groupBy("feature", "k", "n").agg(F.sum(F.col("s") ** 2).alias("s"))
    ties = r.groupBy("feature", "subject", "value").agg(F.count("*").cast("double").alias("t")).groupBy("feature").agg(F.sum(F.col("t") ** 3 - F.col("t")).alias("ties"))
    kk, n = F.col("k"), F.col("n")
    stat = (12 / (n * kk * (kk + 1)) * F.col("s") - 3 * n * (kk + 1)) / (1 - F.col("ties") / (n * kk * (kk**2 - 1)))
    return sums.where("k > 1").join(ties, "feature").select("feature", n.cast("long").alias("n"), stat.alias("stat"), (kk - 1).cast("double").alias("df"))


# --- models and permutation tests: one grouped Arrow call per feature or per block of permutations ------------------------


def random_intercept(y: np.ndarray, x: np.ndarray, subject: np.ndarray) -> tuple[float, float, float]:
    """(slope, standard error, residual scale) of y = a + b x + subject, by restricted likelihood over one variance ratio."""
    ids = np.unique(subject, return_inverse=True)[1]
    design = np.column_stack([np.ones(len(y)), x])
    size = np.bincount(ids)

    def fit(ratio: float):
        shrink = ratio / (1 + ratio * size)
        inner = lambda a, b: a.T @ b - (np.stack([np.bincount(ids, c) for c in a.T]) * shrink) @ np.stack([np.bincount(ids, c) for c in b.T]).T
        xx, xy, yy = inner(design, design), inner(design, y[:, None]), inner(y[:, None], y[:, None])
        beta = np.linalg.solve(xx, xy)
        scale = float((yy - xy.T @ beta).item()) / (len(y) - 2)
        like = (len(y) - 2) * math.log(max(scale, 1e-300)) + np.log1p(ratio * size).sum() + math.log(max(np.linalg.det(xx), 1e-300))
        return like, beta.ravel(), math.sqrt(max(scale * np.linalg.inv(xx)[1, 1], 0)), scale

    low, high = -12.0, 12.0
    for _ in range(80):  # the likelihood has one minimum over the log ratio, by golden section
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if fit(math.exp(a))[0] < fit(math.exp(b))[0] else (a, high)
    at = min((fit(0.0), fit(math.exp((low + high) / 2))), key=lambda f: f[0])
    return float(at[1][1]), at[2], at[3]


def mixed_model(values: DataFrame, a: str, b: str) -> DataFrame:
    """(feature, coef, se, z, p, d, ci_low, ci_high): Value ~ Group with a random intercept per subject; needs three subjects."""

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna()
        x = (g["grp"] == b).to_numpy(float)
        out = [key[0], *[math.nan] * 7]
        if g["subject"].nunique() >= 3 and len(g) > 3 and 0 < x.mean() < 1:
            coef, se, scale = random_intercept(g["value"].to_numpy(float), x, g["subject"].to_numpy())
            z = coef / se if se else math.nan
            out = [key[0], coef, se, z, float(special.normal_sf2(z)), coef / math.sqrt(scale) if scale > 0 else math.nan, coef - 1.96 * se, coef + 1.96 * se]
        return pd.DataFrame([out], columns=["feature", "coef", "se", "z", "p", "d", "ci_low", "ci_high"])

    rows = values.where(F.col("grp").isin(a, b)).select("feature", "grp", F.col("subject").cast("string").alias("subject"), "value")
    return rows.groupBy("feature").applyInPandas(run, "feature string, coef double, se double, z double, p double, d double, ci_low double, ci_high double")


def gee(values: DataFrame, a: str, b: str, exchangeable: bool = True, family: str = "gaussian") -> DataFrame:
    """(feature, coef, se, z, p): population-average effect of group b with robust errors by subject.

    "gaussian" has the identity link; "gamma" the log link, and values are first shifted above zero where some aren't.
    """
    if family not in ("gaussian", "gamma"):
        raise ValueError(f"unknown family {family!r}")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.dropna()
        y, ids = g["value"].to_numpy(float), np.unique(g["subject"], return_inverse=True)[1]
        x = np.column_stack([np.ones(len(y)), (g["grp"] == b).to_numpy(float)])
        out = [key[0], *[math.nan] * 4]
        if len(y) and ids.max() >= 2 and 0 < x[:, 1].mean() < 1:
            groups, alpha = [np.flatnonzero(ids == i) for i in range(ids.max() + 1)], 0.0
            if family == "gamma" and y.min() <= 0:
                y = y - y.min() + 1e-6
            beta = np.array([math.log(y.mean()), 0.0]) if family == "gamma" else np.zeros(2)
            for _ in range(100):
                # working response and design, scaled so that the working variance is one
                mu = np.exp(x @ beta) if family == "gamma" else np.ones(len(y))
                d = x
                e = (y - mu) / mu if family == "gamma" else y - x @ beta
                bread, right = np.zeros((2, 2)), np.zeros(2)
                inv = [np.linalg.inv(np.full((len(i), len(i)), alpha) + (1 - alpha) * np.eye(len(i))) for i in groups]
                for i, v in zip(groups, inv):
                    bread += d[i].T @ v @ d[i]
                    right += d[i].T @ v @ e[i]
                move = np.linalg.solve(bread, right)
                beta = beta + move
                mu = np.exp(x @ beta) if family == "gamma" else mu
                e = (y - mu) / mu if family == "gamma" else y - x @ beta
                phi = (e**2).sum() / (len(y) - 2)
                n_pairs = sum(len(i) * (len(i) - 1) / 2 for i in groups)
                new = alpha
                if exchangeable and n_pairs > 2 and phi > 0:
                    new = sum((e[i].sum() ** 2 - (e[i] ** 2).sum()) / 2 for i in groups) / (n_pairs - 2) / phi
                    new = min(max(new, -0.3), 0.99)
                if abs(new - alpha) < 1e-8 and np.abs(move).max() < 1e-9:
                    break
                alpha = new
            meat = sum(np.outer(s, s) for s in (x[i].T @ v @ e[i] for i, v in zip(groups, inv)))
            cov = np.linalg.inv(bread) @ meat @ np.linalg.inv(bread)
            se = math.sqrt(max(cov[1, 1], 0))
            z = beta[1] / se if se else math.nan
            out = [key[0], beta[1], se, z, float(special.normal_sf2(z))]
        return pd.DataFrame([out], columns=["feature", "coef", "se", "z", "p"])

    rows = values.where(F.col("grp").isin(a, b)).select("feature", "grp", F.col("subject").cast("string").alias("subject"), "value")
    return rows.groupBy("feature").applyInPandas(run, "feature string, coef double, se double, z double, p double")


def enhance(t: np.ndarray, step: float = 0.2, e: float = 0.5, h: float = 2.0) -> np.ndarray:
    """Threshold-free cluster enhancement of a series, each sign by itself."""
    out = np.zeros(len(t))
    for sign in (1, -1):
        x = np.maximum(sign * np.nan_to_num(t), 0)
        for level in np.arange(step, x.max() + 1e-12, step):
            on = x >= level
            edge = np.diff(np.concatenate([[0], on.view(np.int8), [0]]))
            for lo, hi in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
                out[lo:hi] += sign * (hi - lo) ** e * level**h * step
    return out


def signs(subject: np.ndarray, permutations: np.ndarray, seed: int) -> np.ndarray:
    """(subjects, permutations) of 1.0 and -1.0 by hash; permutation 0 flips nobody."""
    mix = lambda x: (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    own = mix(mix(subject.astype(np.int64).view(np.uint64)))
    turn = mix(mix((permutations + (seed << 32)).astype(np.int64).view(np.uint64)))
    bit = mix(mix(own[:, None] ^ turn[None])) >> np.uint64(63)
    return np.where((bit == 1) & (permutations > 0)[None], -1.0, 1.0)


def flipped_sums(h: np.ndarray, t: np.ndarray, v: np.ndarray, ids: np.ndarray, seed: int, block: int):
    """The times of some rows, and an iterator of (first permutation, sums of flipped values by time and permutation) in blocks of ``ids``.

    Signs are drawn once for each subject, not for each of its times.
    """
    times, of = np.unique(t, return_inverse=True)
    subjects, who = np.unique(h, return_inverse=True)
    order = np.argsort(of, kind="stable")
    edge = np.flatnonzero(np.diff(of[order], prepend=-1))
    wide = None
    if len(times) * len(subjects) <= 64 * len(v):  # rows with few gaps are one matrix product
        wide = np.zeros((len(times), len(subjects)))
        np.add.at(wide, (of, who), v)

    def parts():
        for lo in range(0, len(ids), block):
            turned = signs(subjects, ids[lo : lo + block], seed)
            if wide is not None:
                yield lo, wide @ turned
            elif len(v):
                yield lo, np.add.reduceat((turned[who] * v[:, None])[order], edge, axis=0)

    return times, parts()


def tfce(series: DataFrame, permutations: int = 5000, seed: int = 42, block: int = 500) -> DataFrame:
    """(t_ms, stat, score, p): one-sample enhancement of (subject, t_ms, value) against sign flips, corrected by the maximum.

    Each time has the subjects that were seen then; a subject flips as a whole. Sums of flipped values come from one
    pass over rows dealt by time, and each permutation's series of times, as long as one recording, is enhanced in a
    group of its own. The driver gets one maximum for each permutation.
    """
    import pyarrow as pa

    value = series.groupBy("subject", "t_ms").agg(F.avg("value").alias("value")).where("value is not null")
    rows = value.select(F.xxhash64("subject").alias("h"), F.col("t_ms").cast("double").alias("t_ms"), F.col("value").cast("double").alias("value"))
    ids = np.arange(permutations + 1)

    def flipped(batches):
        sums: dict[float, np.ndarray] = {}
        for b in batches:
            h, t, v = (b.column(c).to_numpy() for c in ("h", "t_ms", "value"))
            times, parts = flipped_sums(h, t, v, ids, seed, block)
            for lo, got in parts:
                for time, x in zip(times.tolist(), got):
                    sums.setdefault(time, np.zeros(len(ids)))[lo : lo + block] += x
        for time, x in sums.items():
            yield pa.record_batch({"perm": pa.array(ids, pa.int32()), "t_ms": np.full(len(ids), time), "s": x})

    totals = rows.repartition("t_ms").mapInArrow(flipped, "perm int, t_ms double, s double")
    moments = rows.groupBy("t_ms").agg(F.count("*").cast("double").alias("n"), F.sum(F.col("value") ** 2).alias("q"))
    n, mean = F.col("n"), F.col("s") / F.col("n")
    variance = (F.col("q") - n * mean**2) / (n - 1)
    stat = F.when((n > 1) & (variance > 1e-12 * F.col("q")), mean * F.sqrt(n / variance)).otherwise(0.0)
    tests = totals.join(moments, "t_ms").select("perm", "t_ms", stat.alias("stat"))

    def enhanced(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t_ms")
        score = enhance(g["stat"].to_numpy())
        if key[0] == 0:
            return pd.DataFrame({"perm": 0, "t_ms": g["t_ms"], "stat": g["stat"], "score": score})
        return pd.DataFrame({"perm": [key[0]], "t_ms": [math.nan], "stat": [math.nan], "score": [np.abs(score).max(initial=0)]})

    done = tests.groupBy("perm").applyInPandas(enhanced, "perm int, t_ms double, stat double, score double").toPandas()
    null = np.sort(done.loc[done["perm"] > 0, "score"].to_numpy())
    own = done[done["perm"] == 0].drop(columns="perm")
    own["p"] = (1 + len(null) - np.searchsorted(null, np.abs(own["score"].to_numpy()) - 1e-12)) / (len(null) + 1)
    return series.sparkSession.createDataFrame([tuple(map(float, r)) for r in own.itertuples(index=False)], "t_ms double, stat double, score double, p double")


def paired_tfce(first: DataFrame, second: DataFrame, permutations: int = 5000, seed: int = 42) -> DataFrame:
    """``tfce`` of second less first for subjects and times that both have."""
    a = first.groupBy("subject", "t_ms").agg(F.avg("value").alias("_a"))
    b = second.groupBy("subject", "t_ms").agg(F.avg("value").alias("_b"))
    return tfce(a.join(b, ["subject", "t_ms"]).select("subject", "t_ms", (F.col("_b") - F.col("_a")).alias("value")), permutations, seed)


def clusters(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(cluster, start_ms, end_ms, mean_stat, direction): stretches of times with p below ``alpha`` and one sign."""
    w = Window.partitionBy(F.lit(1)).orderBy("t_ms")  # the times of one series
    s = tests.withColumn("_s", F.when(F.col("p") < alpha, F.signum("stat")))
    s = s.withColumn("_n", F.when(F.col("_s").eqNullSafe(F.lag("_s").over(w)), 0).otherwise(1)).withColumn("cluster", F.sum("_n").over(w))
    c = s.where("_s is not null").groupBy("cluster").agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.avg("stat").alias("mean_stat"), F.max("_s").alias("_d"))
    return c.select("cluster", "start_ms", "end_ms", "mean_stat", F.when(F.col("_d") > 0, "positive").otherwise("negative").alias("direction"))
