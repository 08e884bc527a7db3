"""Comparisons of two studies, composed of the tests in ``stats``: sliding windows, event windows, pre and post, transitions.

Values are rows (feature, grp, subject, value), one for each window or event; ``level`` columns name what else tells tests apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statelace.functions import special

from . import designs, stats


def _named(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """Values whose feature carries the ``by`` columns, which ``_split`` takes apart again."""
    return values.withColumn("feature", F.to_json(F.struct("feature", *by))) if by else values


def _split(tests: DataFrame, by: Sequence[str]) -> DataFrame:
    if not by:
        return tests
    name = F.from_json("feature", "feature string, " + ", ".join(f"{c} string" for c in by))
    rest = [c for c in tests.columns if c != "feature"]
    return tests.withColumn("_f", name).select("_f.*", *rest)


def sliding_paired(values: DataFrame, a: str, b: str, method: str = "fdr_bh", least: int = 3) -> DataFrame:
    """(feature, n, windows1, windows2, mean1, mean2, diff, ci_low, ci_high, stat, p, d, p_adj): windows are averaged per subject, and
    subjects that both studies have, ``least`` of them at the fewest, are paired. diff, stat and d are second less first."""
    ok = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    windows = ok.groupBy("feature").agg(F.count_if(F.col("grp") == a).alias("windows1"), F.count_if(F.col("grp") == b).alias("windows2"))
    pairs = stats.paired(ok, b, a)
    means = pairs.groupBy("feature").agg(F.avg("y").alias("mean1"), F.avg("x").alias("mean2"))
    t = stats.with_interval(stats.with_p(stats.paired_t(pairs).where(F.col("n") >= least))).withColumnRenamed("m", "diff")
    out = t.join(windows, "feature").join(means, "feature")
    out = out.select("feature", "n", "windows1", "windows2", "mean1", "mean2", "diff", "ci_low", "ci_high", "stat", "p", F.coalesce("d", F.lit(0.0)).alias("d"))
    return stats.adjust(out, method)


def modelled(values: DataFrame, a: str, b: str, by: Sequence[str] = (), method: str = "fdr_bh", least: int = 2) -> DataFrame:
    """(feature, by..., subjects1, subjects2, n1, n2, mean1, mean2, diff, ci_low, ci_high, p, d, p_adj): value ~ group with a random
    intercept for each subject, where both groups have ``least`` subjects.

    Serves sliding windows of unpaired studies, windows between events (``by`` their description) and, with the window
    type as group, pre and post of one study.
    """
    v = _named(values, by).where(F.col("value").isNotNull() & ~F.isnan("value") & F.col("grp").isin(a, b))
    pick = lambda g, c: F.when(F.col("grp") == g, F.col(c))
    s = v.groupBy("feature").agg(
        *[f(pick(g, c)).alias(n + i) for i, g in (("1", a), ("2", b)) for n, f, c in (("subjects", F.countDistinct, "subject"), ("n", F.count, "value"), ("mean", F.avg, "value"))]
    )
    m = stats.mixed_model(v, a, b).withColumnRenamed("coef", "diff").drop("se", "z")
    out = s.where((F.col("subjects1") >= least) & (F.col("subjects2") >= least)).join(m, "feature")
    out = out.select("feature", "subjects1", "subjects2", "n1", "n2", "mean1", "mean2", "diff", "ci_low", "ci_high", "p", "d")
    return _split(stats.adjust(out, method), by)


def transitions_compared(values: DataFrame, a: str, b: str, pairing: bool = False, method: str = "fdr_bh") -> DataFrame:
    """(feature, n1, n2, mean1, mean2, diff, ci_low, ci_high, stat, p, d, p_adj): one test for each transition of RTF values.

    Unpaired studies are tested by ``t_test``; paired ones by order of subjects, where both have as many values. d is
    second less first, over the pooled deviation or that of the differences.
    """
    base = stats.mean_difference(values, a, b)
    if pairing:
        pairs = stats.paired(values, a, b, "order")
        t = stats.with_p(stats.paired_t(pairs)).select("feature", "stat", "p", (-F.coalesce("d", F.lit(0.0))).alias("d"))
        base = base.where("n1 = n2")
    else:
        d = stats.cohens_d(values, a, b).select("feature", (-F.coalesce("d", F.lit(0.0))).alias("d"))
        t = stats.t_test(values, a, b).select("feature", "stat", "p").join(d, "feature")
    return stats.adjust(base.join(t, "feature"), method)


def summary_counts(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(tests, raw, adjusted, greater_first, greater_second): how many tests are significant, before and after correction, and of the
    latter how many means are greater in which study (equal means count for the first)."""
    hit = F.col("p_adj") < alpha
    return tests.agg(
        F.count("*").alias("tests"),
        F.count_if(F.col("p") < alpha).alias("raw"),
        F.count_if(hit).alias("adjusted"),
        F.count_if(hit & (F.col("mean2") <= F.col("mean1"))).alias("greater_first"),
        F.count_if(hit & (F.col("mean2") > F.col("mean1"))).alias("greater_second"),
    )


def box_data(values: DataFrame, *group: str) -> DataFrame:
    """(group..., n, low, q1, median, q3, high): what box, violin and bar plots draw; whiskers end at the last value within 1.5 quartile ranges."""
    v = values.where(F.col("value").isNotNull() & ~F.isnan("value"))
    q = v.groupBy(*group).agg(F.count("*").alias("n"), F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"))
    q = q.select(*[F.col(c).alias(f"_{c}") for c in group], "n", *[F.get("_q", i).alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    span = 1.5 * (F.col("q3") - F.col("q1"))
    met = v.join(q, [v[c].eqNullSafe(q[f"_{c}"]) for c in group])
    low, high = (F.when((F.col("value") >= F.col("q1") - span) & (F.col("value") <= F.col("q3") + span), F.col("value")) for _ in range(2))
    return met.groupBy(*group, "n", "q1", "median", "q3").agg(F.min(low).alias("low"), F.max(high).alias("high"))


def of_files(values: DataFrame, files: DataFrame, name: str = "subject") -> DataFrame:
    """Values of the files (column ``name``) that a selection lists."""
    return values.join(files.select(name).distinct(), name, "left_semi")


def of_code(values: DataFrame, code: str) -> DataFrame:
    """Values whose feature is ``code`` itself or one of its states (code_state)."""
    return values.where((F.col("feature") == code) | F.col("feature").startswith(f"{code}_"))


# --- models by name -------------------------------------------------------------------------------------------------------

#: What is offered by (subject or trial level, paired, parametric).
OFFERED = {
    ("subject", True, True): ("paired_t", "repeated_anova"),
    ("subject", True, False): ("wilcoxon", "friedman"),
    ("subject", False, True): ("independent_t", "one_way_anova"),
    ("subject", False, False): ("mann_whitney", "kruskal_wallis"),
    ("trial", True, True): ("mixed_model", "gee_gaussian"),
    ("trial", True, False): ("gee_gamma", "cluster_permutation"),
    ("trial", False, True): ("mixed_model", "gee_gaussian"),
    ("trial", False, False): ("gee_gamma", "bootstrap"),
}


def offered(level: str, paired: bool, parametric: bool) -> tuple[str, ...]:
    if (level, paired, parametric) not in OFFERED:
        raise ValueError(f"unknown level {level!r}")
    return OFFERED[level, paired, parametric]


def tested(values: DataFrame, model: str, a: str, b: str, **options) -> DataFrame:
    """Result of a model by name, with at least feature and p (clusters have p alone).

    Models of several groups (repeated_anova, friedman, one_way_anova, kruskal_wallis) take all groups of ``values``, the
    others ``a`` and ``b``. cluster_permutation takes rows (trial, grp, t_ms, state, value), and exchanges labels ``within`` a column if asked.
    """
    both = values.where(F.col("grp").isin(a, b))
    match model:
        case "paired_t":
            return stats.with_p(stats.paired_t(stats.paired(both, a, b)))
        case "repeated_anova":
            return designs.repeated_anova(values)
        case "wilcoxon":
            return stats.wilcoxon_p(stats.paired(both, a, b), **options)
        case "friedman":
            return _with_chi2(stats.friedman(values))
        case "independent_t":
            return stats.t_test(both, a, b)
        case "one_way_anova":
            return stats.one_way(values).withColumn("p", _known(special.f_p("stat", "df1", "df2")))
        case "mann_whitney":
            return stats.with_normal_p(stats.mann_whitney(both, a, b))
        case "kruskal_wallis":
            return _with_chi2(stats.kruskal(values))
        case "mixed_model":
            return stats.mixed_model(both, a, b)
        case "gee_gaussian" | "gee_gamma":
            return stats.gee(both, a, b, family=model.removeprefix("gee_"), **options)
        case "bootstrap":
            return designs.bootstrap(both, a, b, **options)
        case "cluster_permutation":
            return designs.permuted_clusters(both, a, b, **options)
    raise ValueError(f"unknown model {model!r}")


def _known(p):
    return F.coalesce(F.nanvl(p, F.lit(1.0)), F.lit(1.0))


def _with_chi2(tests: DataFrame) -> DataFrame:
    return tests.withColumn("p", _known(special.chi2_p("stat", "df")))
