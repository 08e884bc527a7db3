"""All queries of the library and the SQL they can be held against."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelace.functions import arrays as A
from statelace.functions import names as N
from statelace.operators import around, cluster, compare, conditions, designs, events, features, inverse, joins, runs, sequence, signal, stats
from statelace.operators.scoring import Templates, assign, total_explained
from statelace.sources import files as S
from statelace.sources import views as V
from statelace.sources.views import FS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# --- SQL pieces ----------------------------------------------------------------------------------------------------

SEG = """seg AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sample_ix,
  CASE WHEN event_type <> 'error' THEN event_type END AS label, value FROM events)"""


def run_ctes(source: str, keys: str = "recording_id", out: str = "runs") -> str:
    return f"""{out}_m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR label IS DISTINCT FROM lag(label) OVER w THEN 1 ELSE 0 END AS nb
  FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY sample_ix)),
{out}_i AS (SELECT *, CAST(sum(nb) OVER (PARTITION BY {keys} ORDER BY sample_ix) - 1 AS BIGINT) AS run_ix FROM {out}_m),
{out} AS (SELECT {keys}, run_ix, max(label) AS label, min(sample_ix) AS start_ix, max(sample_ix) AS end_ix, count(*) AS n FROM {out}_i GROUP BY {keys}, run_ix)"""


WIN = """w AS (SELECT recording_id, CAST(floor(sample_ix / 20) AS BIGINT) AS window_ix, sample_ix % 20 AS sample_ix, label
  FROM (SELECT *, count(*) OVER (PARTITION BY recording_id) AS c FROM seg) WHERE floor(sample_ix / 20) < floor(c / 20))"""

EPO = f"""{SEG}, epo AS (SELECT recording_id AS trial, CAST((sample_ix - 20) * 10.0 AS DOUBLE) AS t_ms, label FROM seg)"""

VALUES = """vals AS (SELECT event_type AS feature, CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS grp, CAST(floor(user_id / 2) AS BIGINT) AS subject,
  avg(value) AS value FROM events GROUP BY event_type, user_id)"""
PAIRS = f"""{VALUES}, pairs AS (SELECT feature, subject, avg(value) FILTER (grp = 'a') AS x, avg(value) FILTER (grp = 'b') AS y FROM vals
  GROUP BY 1, 2 HAVING count(*) FILTER (grp = 'a') > 0 AND count(*) FILTER (grp = 'b') > 0)"""

TOPO = "topo AS (SELECT vec_id AS sample_ix, label AS state0, embedding::DOUBLE[] AS x FROM embeddings)"
TPL = "tpl AS (SELECT state0 AS state, arg_min(x, sample_ix) AS m FROM topo GROUP BY state0)"
CEN = """c AS (SELECT sample_ix, list_transform(x, lambda v: v - list_avg(x)) AS x, list_sum(list_transform(x, lambda v: v * v)) AS power, x AS raw FROM topo),
tc AS (SELECT state, list_transform(m, lambda v: v - list_avg(m)) AS m, m AS raw FROM tpl)"""
SCORE = f"""{TOPO}, {TPL}, {CEN},
p AS (SELECT sample_ix, state, list_dot_product(c.x, tc.m) / sqrt(list_dot_product(c.x, c.x) * list_dot_product(tc.m, tc.m)) AS r,
  sqrt(list_dot_product(c.x, c.x) / len(c.x)) AS gfp, list_dot_product(c.raw, tc.raw) AS act FROM c, tc),
best AS (SELECT sample_ix, arg_max(state, abs(r)) AS state, max(abs(r)) AS abs_r, arg_max(r, abs(r)) AS r, any_value(gfp) AS gfp FROM p GROUP BY sample_ix)"""


def r6(*columns: str) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c.split('.')[-1]}" for c in columns)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# --- runs and sequence features ---------------------------------------------------------------------------------------

HELD = f"WITH {SEG}, {run_ctes('seg')}"

query("run_stats", f"{HELD} SELECT recording_id, run_ix, label, start_ix, end_ix, n FROM runs")(lambda s, d: runs.runs(V.segmentation(s, d)))
query("collapse_runs", f"{HELD} SELECT recording_id, run_ix AS sample_ix, label FROM runs")(lambda s, d: runs.collapse(V.segmentation(s, d)))
query("coverage", f"WITH {SEG}, q AS (SELECT recording_id, label AS state, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY recording_id) AS value FROM seg WHERE label IS NOT NULL GROUP BY 1, 2) SELECT recording_id, state, {r6('value')} FROM q")(
    lambda s, d: rounded(features.coverage(V.segmentation(s, d)), "value")
)
query("occurrence", f"{HELD}, q AS (SELECT recording_id, label AS state, count(*) * 250.0 / sum(sum(n)) OVER (PARTITION BY recording_id) AS value FROM runs WHERE label IS NOT NULL GROUP BY 1, 2) SELECT recording_id, state, {r6('value')} FROM q")(
    lambda s, d: rounded(features.occurrence(V.segmentation(s, d), FS), "value")
)
DUR = {"geometric": "exp(avg(ln(n)))", "arithmetic": "(avg(n) - 1)", "median": "median(n)"}
for _m, _e in DUR.items():
    query(f"duration_{_m}", f"{HELD}, q AS (SELECT recording_id, label AS state, {_e} * 4.0 AS value FROM runs WHERE label IS NOT NULL GROUP BY 1, 2) SELECT recording_id, state, {r6('value')} FROM q")(
        lambda s, d, m=_m: rounded(features.duration(V.segmentation(s, d), FS, m), "value")
    )
query("duration_trimmed", f"""{HELD}, o AS (SELECT recording_id, label AS state, n, row_number() OVER (PARTITION BY recording_id, label ORDER BY n, run_ix) AS i, count(*) OVER (PARTITION BY recording_id, label) AS c FROM runs WHERE label IS NOT NULL),
q AS (SELECT recording_id, state, avg(n) * 4.0 AS value FROM o WHERE i > CASE WHEN c > 10 THEN greatest(1, c // 10) ELSE 0 END AND i <= c - CASE WHEN c > 10 THEN greatest(1, c // 10) ELSE 0 END GROUP BY 1, 2)
SELECT recording_id, state, {r6('value')} FROM q""")(lambda s, d: rounded(features.duration(V.segmentation(s, d), FS, "trimmed"), "value"))

STEPS = f"""{SEG}, st AS (SELECT recording_id, label AS state, lead(label) OVER (PARTITION BY recording_id ORDER BY sample_ix) AS state_to FROM seg),
tr AS (SELECT recording_id, state, state_to, count(*) AS n FROM st WHERE state <> state_to GROUP BY 1, 2, 3), tp AS (SELECT recording_id, state, state_to, n / sum(n) OVER (PARTITION BY recording_id, state) AS value FROM tr)"""
query("transition_counts", f"WITH {STEPS} SELECT * FROM tr")(lambda s, d: features.transitions(V.segmentation(s, d)))
query("transition_probability", f"WITH {STEPS} SELECT recording_id, state, state_to, {r6('value')} FROM tp")(lambda s, d: rounded(features.transition_probability(V.segmentation(s, d)), "value"))
query("tp_matrix_mean", f"WITH {STEPS}, q AS (SELECT state, state_to, avg(value) AS value FROM tp GROUP BY 1, 2) SELECT state, state_to, {r6('value')} FROM q")(
    lambda s, d: rounded(features.transition_probability(V.segmentation(s, d)).groupBy("state", "state_to").agg(F.avg("value").alias("value")), "value")
)


def entropy_sql(k: int) -> str:
    word = " || '|' || ".join(f"coalesce(lead(label, {i}) OVER w, '')" if i else "coalesce(label, '')" for i in range(k))
    return f"""SELECT recording_id, {k} AS k, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT recording_id, word, count(*) AS n FROM
  (SELECT recording_id, {word} AS word, lead(sample_ix, {k}) OVER w AS e FROM seg WINDOW w AS (PARTITION BY recording_id ORDER BY sample_ix)) WHERE e IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""


for _k in (1, 2, 3):
    query(f"joint_entropy_k{_k}", f"WITH {SEG}, q AS (SELECT recording_id, h AS value FROM ({entropy_sql(_k)})) SELECT recording_id, {r6('value')} FROM q")(
        lambda s, d, k=_k: rounded(features.joint_entropy(V.segmentation(s, d), k), "value")
    )
query("entropy_rate", f"WITH {SEG}, h AS ({' UNION ALL '.join(entropy_sql(k) for k in range(1, 7))}), q AS (SELECT recording_id, regr_slope(h, k) AS rate, regr_intercept(h, k) AS excess FROM h GROUP BY 1) SELECT recording_id, {r6('rate', 'excess')} FROM q")(
    lambda s, d: rounded(features.entropy_rate(V.segmentation(s, d)), "rate", "excess")
)
query("label_entropy", f"WITH {SEG}, n AS (SELECT recording_id, label, count(*) AS n FROM seg WHERE label IS NOT NULL GROUP BY 1, 2), q AS (SELECT recording_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS value FROM n GROUP BY 1) SELECT recording_id, {r6('value')} FROM q")(
    lambda s, d: rounded(features.label_entropy(V.segmentation(s, d)), "value")
)
query("label_entropy_window", f"WITH {SEG}, {WIN}, n AS (SELECT recording_id, window_ix, label, count(*) AS n FROM w WHERE label IS NOT NULL GROUP BY 1, 2, 3), q AS (SELECT recording_id, window_ix, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS value FROM n GROUP BY 1, 2) SELECT recording_id, window_ix, {r6('value')} FROM q")(
    lambda s, d: rounded(features.label_entropy(features.windowed(V.segmentation(s, d), FS, 0.08), ("recording_id", "window_ix")), "value")
)
CLS = f"""{SEG}, dense AS (SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY sample_ix) AS i, label FROM seg WHERE label IS NOT NULL),
wd AS (SELECT recording_id, label AS a, lead(label) OVER (PARTITION BY recording_id ORDER BY i) AS b FROM dense),
real AS (SELECT recording_id, CASE WHEN a = b THEN 0 ELSE 1 END AS h, count(*) AS n FROM wd WHERE b IS NOT NULL GROUP BY 1, 2),
cls AS (SELECT recording_id, h, CAST(dense_rank() OVER (PARTITION BY recording_id ORDER BY h) AS INTEGER) AS class, n / sum(n) OVER (PARTITION BY recording_id) AS value FROM real)"""
query("entropy_class_share", f"WITH {CLS} SELECT recording_id, class, {r6('value')} FROM cls")(lambda s, d: rounded(features.entropy_classes(V.segmentation(s, d)).drop("h"), "value"))
query("theoretical_words", f"WITH {SEG}, l AS (SELECT DISTINCT recording_id, label FROM seg WHERE label IS NOT NULL) SELECT a.recording_id, a.label || '>' || b.label AS word FROM l a JOIN l b ON a.recording_id = b.recording_id AND a.label <> b.label")(
    lambda s, d: features.theoretical_words(V.segmentation(s, d)).withColumn("word", F.array_join("word", ">"))
)
query("representation_ratio", f"WITH {CLS}, q AS (SELECT recording_id, class, CASE WHEN h = 1 THEN value END AS value FROM cls) SELECT recording_id, class, {r6('value')} FROM q")(
    lambda s, d: rounded(features.representation_ratio(V.segmentation(s, d)), "value")
)
SW = f"{SEG}, {WIN}"
query("sliding_coverage", f"""WITH {SW}, g AS (SELECT * FROM (SELECT DISTINCT recording_id, window_ix FROM w) JOIN (SELECT DISTINCT recording_id, label AS state FROM seg WHERE label IS NOT NULL) USING (recording_id)),
n AS (SELECT recording_id, window_ix, label AS state, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY recording_id, window_ix) AS v FROM w WHERE label IS NOT NULL GROUP BY 1, 2, 3),
q AS (SELECT recording_id, window_ix, state, coalesce(v, 0) AS value FROM g LEFT JOIN n USING (recording_id, window_ix, state)) SELECT recording_id, window_ix, state, {r6('value')} FROM q""")(
    lambda s, d: rounded(features.sliding_coverage(V.segmentation(s, d), FS, 0.08), "value")
)
SR = f"{SW}, {run_ctes('w', 'recording_id, window_ix', 'wr')}"
query("sliding_occurrence", f"WITH {SR}, q AS (SELECT recording_id, window_ix, label AS state, count(*) / 0.08 AS value FROM wr WHERE label IS NOT NULL GROUP BY 1, 2, 3) SELECT recording_id, window_ix, state, {r6('value')} FROM q")(
    lambda s, d: rounded(features.sliding_occurrence(V.segmentation(s, d), FS, 0.08), "value")
)
SD = f"{SR}, sd AS (SELECT recording_id, window_ix, label AS state, exp(avg(ln(n))) * 4.0 AS value FROM wr WHERE label IS NOT NULL GROUP BY 1, 2, 3)"
query("sliding_duration", f"WITH {SD} SELECT recording_id, window_ix, state, {r6('value')} FROM sd")(lambda s, d: rounded(features.sliding_duration(V.segmentation(s, d), FS, 0.08), "value"))
query("variability", f"""WITH {SD}, l AS (SELECT *, value - lag(value) OVER (PARTITION BY recording_id, state ORDER BY window_ix) AS dv FROM sd),
q AS (SELECT recording_id, state, stddev_samp(value) AS sd, sqrt(avg(dv * dv)) AS rmssd FROM l GROUP BY 1, 2) SELECT recording_id, state, {r6('sd', 'rmssd')} FROM q""")(
    lambda s, d: rounded(features.variability(features.sliding_duration(V.segmentation(s, d), FS, 0.08)), "sd", "rmssd")
)
STATES = ("click", "purchase", "signup", "view")
query("wide_features", f"""WITH {SEG}, q AS (SELECT recording_id, label AS state, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY recording_id) AS value FROM seg WHERE label IS NOT NULL GROUP BY 1, 2)
SELECT recording_id, {', '.join(f"round(max(value) FILTER (state = '{x}'), 6) AS COV_{x}" for x in STATES)} FROM q GROUP BY 1""")(
    lambda s, d: rounded(features.wide(features.coverage(V.segmentation(s, d)), STATES, "COV"), *[f"COV_{x}" for x in STATES])
)
LZ = f"""RECURSIVE {SEG}, {run_ctes('seg')}, ls AS (SELECT recording_id, count(*) AS n, substr(string_agg(chr(CAST(96 + length(label) AS INTEGER)) || '', '' ORDER BY run_ix), 2) AS s FROM runs WHERE label IS NOT NULL GROUP BY 1),
lz AS (SELECT recording_id, s, n, 0 AS done, 0 AS c FROM ls UNION ALL
SELECT recording_id, s, n, CAST(done + coalesce(list_filter(range(1, length(s) - done + 1), lambda k: strpos(substr(s, 1, CAST(done + k - 1 AS BIGINT)), substr(s, CAST(done + 1 AS BIGINT), k)) = 0)[1], length(s) - done) AS INTEGER), c + 1 FROM lz WHERE done < length(s)),
q AS (SELECT recording_id, CASE WHEN any_value(n) < 3 THEN 0.0 ELSE max(c) * log2(any_value(n)) / any_value(n) END AS value FROM lz GROUP BY 1)"""
query("lempel_ziv", f"WITH {LZ} SELECT recording_id, {r6('value')} FROM q")(lambda s, d: rounded(sequence.lempel_ziv(V.segmentation(s, d)), "value"))
#: Users' events in rows of twenty users make recordings that are long enough for the least box of 50 samples.
query("hurst")(lambda s, d: rounded(sequence.hurst(V.long_segmentation(s, d)), "value"))
query("surrogate_entropy")(lambda s, d: rounded(features.joint_entropy(features.shuffled(V.segmentation(s, d), 1), 2), "value"))
query("surrogate_coverage", ORACLES["coverage"])(lambda s, d: rounded(features.coverage(features.shuffled(V.segmentation(s, d), 7)), "value"))
query("random_sequence")(lambda s, d: features.coverage(features.random_labels(V.segmentation(s, d), 3)))

# --- filters -------------------------------------------------------------------------------------------------------------

MARK = f"""WITH {SEG}, {run_ctes('seg')}, mk AS (SELECT recording_id, sample_ix, CASE WHEN r.n > 1 THEN i.label END AS label FROM runs_i i JOIN runs r USING (recording_id, run_ix)),
{run_ctes('mk', out='mr')},
nb AS (SELECT i.recording_id, i.sample_ix, i.label, r.n, i.sample_ix - r.start_ix + 1 AS pos_in, pl.label AS bl, pl.n AS bn, nl.label AS al, nl.n AS an FROM mr_i i JOIN mr r USING (recording_id, run_ix)
  LEFT JOIN mr pl ON pl.recording_id = i.recording_id AND pl.run_ix = i.run_ix - 1 LEFT JOIN mr nl ON nl.recording_id = i.recording_id AND nl.run_ix = i.run_ix + 1)"""
_labels = lambda df: df.select("recording_id", "sample_ix", "label")
query("remove_short", f"{MARK} SELECT recording_id, sample_ix, label FROM mk")(lambda s, d: _labels(runs.remove_short(V.segmentation(s, d), 1)))
query("replace_high", f"{MARK} SELECT recording_id, sample_ix, coalesce(label, CASE WHEN bl IS NULL THEN al WHEN al IS NULL OR bn >= an THEN bl ELSE al END) AS label FROM nb")(lambda s, d: _labels(runs.replace_high(V.segmentation(s, d), 1)))
query("replace_half", f"{MARK} SELECT recording_id, sample_ix, coalesce(label, CASE WHEN bl IS NULL THEN al WHEN al IS NULL OR pos_in <= ceil(n / 2) THEN bl ELSE al END) AS label FROM nb")(lambda s, d: _labels(runs.replace_half(V.segmentation(s, d), 1)))
query("reject_vs_flag", f"""{MARK}, f AS (SELECT recording_id, sample_ix, coalesce(label, CASE WHEN bl IS NULL THEN al WHEN al IS NULL OR bn >= an THEN bl ELSE al END) AS label FROM nb)
SELECT f.recording_id, f.sample_ix, CASE WHEN seg.label IS NOT NULL THEN f.label END AS label FROM f JOIN seg USING (recording_id, sample_ix)""")(
    lambda s, d: _labels(runs.keep_rejected(runs.replace_high(V.segmentation(s, d), 1), V.segmentation(s, d)))
)
PEAK = f"""{SEG}, pk AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM (SELECT recording_id, sample_ix, label, value FROM seg) WINDOW w AS (PARTITION BY recording_id ORDER BY sample_ix))"""
query("peak_detect", f"WITH {PEAK} SELECT recording_id, sample_ix, {r6('value')} FROM pk WHERE value > b AND value > a")(lambda s, d: rounded(runs.peaks(V.segmentation(s, d), strict=True), "value"))
query("peak_backfit", f"""WITH {PEAK}, g AS (SELECT *, CAST(sum(CASE WHEN value > b AND value > a THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY sample_ix) AS BIGINT) AS p, (value > b AND value > a) AS top FROM pk),
t AS (SELECT *, max(p) OVER (PARTITION BY recording_id) AS np, arg_min(sample_ix, value) OVER (PARTITION BY recording_id, p) AS low FROM g),
k AS (SELECT *, greatest(1, p + CASE WHEN p > 0 AND p < np AND sample_ix >= low THEN 1 ELSE 0 END) AS grp FROM t)
SELECT recording_id, sample_ix, CASE WHEN np > 0 THEN max(label) FILTER (top) OVER (PARTITION BY recording_id, grp) ELSE label END AS label FROM k""")(
    lambda s, d: _labels(runs.from_peaks(V.segmentation(s, d), runs.peaks(V.segmentation(s, d), strict=True)))
)

# --- vectors ----------------------------------------------------------------------------------------------------------------


def _t(s: SparkSession, d: str) -> Templates:
    return Templates.of(V.templates(s, d))


def _assigned(s: SparkSession, d: str, threshold: float | None = None) -> DataFrame:
    return assign(V.topographies(s, d), _t(s, d), threshold)


def _recorded(s: SparkSession, d: str, threshold: float | None = None) -> DataFrame:
    """Scored samples, a hundred to a recording."""
    rows = _assigned(s, d, threshold).withColumn("recording_id", F.floor(F.col("sample_ix") / 100))
    return rows.withColumn("power", F.col("gfp") ** 2 * F.size("topo"))


query("gfp", f"WITH {TOPO}, q AS (SELECT sample_ix, list_stddev_pop(x) AS gfp FROM topo) SELECT sample_ix, {r6('gfp')} FROM q")(lambda s, d: rounded(V.topographies(s, d).select("sample_ix", A.gfp(F.col("topo")).alias("gfp")), "gfp"))
_each = lambda df: rounded(df.select("sample_ix", F.posexplode("topo").alias("pos", "value")), "value")
query("average_reference", f"WITH {TOPO}, q AS (SELECT sample_ix, unnest(list_transform(x, lambda v: v - list_avg(x))) AS value, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos FROM topo) SELECT sample_ix, pos, {r6('value')} FROM q")(
    lambda s, d: _each(signal.average_reference(V.topographies(s, d)))
)
query("unit_topography", f"WITH {TOPO}, q AS (SELECT sample_ix, unnest(list_transform(x, lambda v: v / (sqrt(list_dot_product(x, x)) + 1e-12))) AS value, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos FROM topo) SELECT sample_ix, pos, {r6('value')} FROM q")(
    lambda s, d: _each(V.topographies(s, d).withColumn("topo", A.unit(F.col("topo"))))
)
query("correlation_matrix", f"WITH {SCORE} SELECT sample_ix, state, {r6('r')} FROM p")(
    lambda s, d: rounded(_assigned(s, d).select("sample_ix", F.posexplode("r").alias("state", "r")), "r")
)
query("pearson_best_state", f"WITH {SCORE} SELECT sample_ix, state, {r6('abs_r')} FROM best")(lambda s, d: rounded(_assigned(s, d).select("sample_ix", "state", "abs_r"), "abs_r"))
query("low_corr_reject", f"WITH {SCORE} SELECT sample_ix, CASE WHEN abs_r >= 0.3 THEN 'S' || state END AS label FROM best")(lambda s, d: _assigned(s, d, 0.3).select("sample_ix", "label"))
query("gev_total", f"WITH {SCORE}, a AS (SELECT sample_ix, arg_max(r, abs(act)) AS r, any_value(gfp) AS g FROM p GROUP BY 1), q AS (SELECT sum((g * r) ** 2) / sum(g ** 2) AS gev FROM a) SELECT {r6('gev')} FROM q")(
    lambda s, d: rounded(total_explained(V.topographies(s, d), _t(s, d)), "gev")
)
query("gev_per_state", f"WITH {SCORE}, q AS (SELECT 'S' || state AS state, 100 * sum((gfp * r) ** 2) / (SELECT sum(gfp ** 2) FROM best) AS value FROM best GROUP BY 1) SELECT state, {r6('value')} FROM q")(
    lambda s, d: rounded(features.explained_variance(_assigned(s, d).select(F.lit(1).alias("recording_id"), "label", "gfp", F.get("r", F.col("state")).alias("r"))).drop("recording_id"), "value")
)
query("backfit_quality", f"""WITH {SCORE}, z AS (SELECT *, CAST(floor(sample_ix / 100) AS BIGINT) AS recording_id, state <> lag(state) OVER (PARTITION BY floor(sample_ix / 100) ORDER BY sample_ix) AS t FROM best),
m AS (SELECT recording_id, avg(m) AS m FROM (SELECT recording_id, state, avg(abs_r) AS m FROM z GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT recording_id, 0.6 * any_value(m.m) + 0.3 / (1 + sum(CASE WHEN t THEN 1 ELSE 0 END) / count(*)) + 0.1 AS quality FROM z JOIN m USING (recording_id) GROUP BY 1) SELECT recording_id, {r6('quality')} FROM q""")(
    lambda s, d: rounded(runs.quality(_recorded(s, d)), "quality")
)
query("retention_curve", f"WITH {SCORE}, q AS (SELECT t AS threshold, 100 * avg(CASE WHEN abs_r >= t THEN 1.0 ELSE 0.0 END) AS retained FROM best, (SELECT unnest([0.2, 0.3, 0.4, 0.5])::DOUBLE AS t) GROUP BY 1) SELECT 1 AS recording_id, threshold, {r6('retained')} FROM q")(
    lambda s, d: rounded(runs.retention(_assigned(s, d).withColumn("recording_id", F.lit(1)), (0.2, 0.3, 0.4, 0.5)), "retained")
)
query("smooth")(lambda s, d: sequence.smooth(_recorded(s, d), 64))
query("spread_gaps")(lambda s, d: sequence.spread_gaps(_recorded(s, d), 1))

LENGTHS = f"""{SCORE}, z AS (SELECT CAST(floor(sample_ix / 100) AS BIGINT) AS recording_id, sample_ix, 'S' || state AS label, abs_r FROM best), {run_ctes('z')},
rf AS (SELECT recording_id, run_ix, any_value(label) AS label, count(*) AS n, sum(abs_r) AS fit FROM runs_i GROUP BY 1, 2), cand AS (SELECT unnest(range(1, 16)) AS t),
sv AS (SELECT rf.*, t, label <> lag(label) OVER (PARTITION BY recording_id, t ORDER BY run_ix) AS turn FROM rf, cand WHERE n > t),
bl AS (SELECT recording_id, t, label, sum(fit) / sum(n) AS r, sum(n) AS n, sum(CASE WHEN turn THEN 1 ELSE 0 END) AS turn FROM sv GROUP BY 1, 2, 3),
gl AS (SELECT recording_id, t, avg(r) AS r, sum(n) AS n, sum(turn) AS turn FROM bl GROUP BY 1, 2), al AS (SELECT recording_id, sum(n) AS a FROM rf GROUP BY 1),
lq AS (SELECT recording_id, t::DOUBLE AS parameter, coalesce(0.6 * r + 0.3 / (1 + turn / n) + 0.1 * n / a, 0) AS quality FROM al CROSS JOIN cand LEFT JOIN gl USING (recording_id, t))"""
query("length_qualities", f"WITH {LENGTHS} SELECT recording_id, parameter, {r6('quality')} FROM lq")(
    lambda s, d: rounded(sequence.length_qualities(_recorded(s, d), sequence.run_lengths(FS)), "quality")
)
query("best_length", f"WITH {LENGTHS}, q AS (SELECT recording_id, least(greatest(arg_max(parameter, quality - parameter * 1e-12), 1), 12)::DOUBLE AS parameter, max(quality) AS quality FROM lq GROUP BY 1) SELECT recording_id, parameter, {r6('quality')} FROM q")(
    lambda s, d: rounded(sequence.best_length(_recorded(s, d), FS), "quality")
)
query("best_weight")(lambda s, d: rounded(sequence.best_weight(_recorded(s, d, 0.3), 64), "quality"))

# --- clustering -------------------------------------------------------------------------------------------------------------------

ACT = f"""{TOPO}, {TPL}, p AS (SELECT sample_ix, state, x, list_dot_product(x, m) AS a FROM topo, tpl), b AS (SELECT sample_ix, arg_max(state, abs(a)) AS state, arg_max(a, abs(a)) AS a, any_value(x) AS x FROM p GROUP BY 1),
e AS (SELECT state, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, a, unnest(x) AS v FROM b), su AS (SELECT state, pos, sum(a * v) AS v FROM e GROUP BY 1, 2),
stp AS (SELECT state, pos, v / sqrt(sum(v * v) OVER (PARTITION BY state)) AS value FROM su)"""
query("kmeans_step", f"WITH {ACT} SELECT state, pos, {r6('value')} FROM stp")(lambda s, d: rounded(cluster.step(V.topographies(s, d), _t(s, d)), "value"))

TWO = f"""WITH {ACT}, m2 AS (SELECT state, list(value ORDER BY pos) AS m FROM stp GROUP BY 1), p2 AS (SELECT sample_ix, m2.state, x, list_dot_product(x, m2.m) AS a FROM topo, m2),
b2 AS (SELECT sample_ix, arg_max(state, abs(a)) AS state, arg_max(a, abs(a)) AS a, any_value(x) AS x FROM p2 GROUP BY 1),
e2 AS (SELECT state, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, a, unnest(x) AS v FROM b2), s2 AS (SELECT state, pos, sum(a * v) AS v FROM e2 GROUP BY 1, 2),
q AS (SELECT state, pos, v / sqrt(sum(v * v) OVER (PARTITION BY state)) AS value FROM s2)"""


def _two_rounds(s: SparkSession, d: str) -> DataFrame:
    samples, t = V.topographies(s, d), _t(s, d)
    maps = t.maps.copy()
    for r in cluster.step(samples, t).collect():  # states x channels
        maps[r["state"], r["pos"]] = r["value"]
    return rounded(cluster.step(samples, Templates(t.labels, maps)), "value")


query("kmeans_two_rounds", f"{TWO} SELECT state, pos, {r6('value')} FROM q")(_two_rounds)


def _maps(s: SparkSession, d: str, t: Templates) -> DataFrame:
    return s.createDataFrame([(i, t.labels[i], [float(v) for v in m]) for i, m in enumerate(t.maps)], "state int, label string, topo array<double>")


query("kmeans")(lambda s, d: _maps(s, d, cluster.kmeans(V.topographies(s, d), _t(s, d))))
query("similarity_kmeans")(lambda s, d: _maps(s, d, cluster.kmeans(V.topographies(s, d), _t(s, d), "correlation")))
query("kmeans_best_of")(lambda s, d: _maps(s, d, cluster.best_of(V.topographies(s, d), 4)))
query("taahc")(lambda s, d: _maps(s, d, cluster.taahc(V.topographies(s, d).withColumn("recording_id", F.floor(F.col("sample_ix") / 100)), 4)))

OWN = f"""{TOPO}, {TPL}, {CEN}, o AS (SELECT topo.sample_ix, topo.state0 AS state, topo.x, tpl.m, least(1.0, abs(list_cosine_similarity(topo.x, tpl.m))) AS cs,
  least(1.0, abs(list_cosine_similarity(c.x, tc.m))) AS rr FROM topo JOIN c USING (sample_ix) JOIN tpl ON tpl.state = topo.state0 JOIN tc ON tc.state = topo.state0)"""


def _own(s: SparkSession, d: str) -> DataFrame:
    return V.topographies(s, d).withColumnRenamed("state0", "state")


query("davies_bouldin", f"""WITH {OWN}, sp AS (SELECT state, avg(1 - cs) AS s FROM o GROUP BY 1), pr AS (SELECT a.state AS i, (sa.s + sb.s) AS t, 1 - least(1.0, abs(list_cosine_similarity(a.m, b.m))) AS dd FROM tpl a JOIN tpl b ON a.state <> b.state JOIN sp sa ON sa.state = a.state JOIN sp sb ON sb.state = b.state),
q AS (SELECT avg(w) AS value FROM (SELECT i, max(CASE WHEN dd > 1e-10 THEN t / dd ELSE 10.0 END) AS w FROM pr GROUP BY 1)) SELECT {r6('value')} FROM q""")(lambda s, d: rounded(cluster.davies_bouldin(_own(s, d), _t(s, d)), "value"))
query("cv_criterion", f"WITH {OWN}, q AS (SELECT sum(list_dot_product(x, x) - (list_dot_product(x, m) ** 2) / list_dot_product(m, m)) / (count(*) * 63) * ((63.0 / 53.0) ** 2) AS value FROM o) SELECT {r6('value')} FROM q")(lambda s, d: rounded(cluster.cv_criterion(_own(s, d), _t(s, d)), "value"))
query("information_criteria", f"WITH {OWN}, i AS (SELECT count(*)::DOUBLE AS n, sum((1 - rr) ** 2) AS rss FROM o), q AS (SELECT n * ln(rss / n) + 2 * 630 AS aic, n * ln(rss / n) + 630 * ln(n) AS bic FROM i) SELECT {r6('aic', 'bic')} FROM q")(lambda s, d: rounded(cluster.information(_own(s, d), _t(s, d)), "aic", "bic"))
query("within_square_sum", f"WITH {OWN}, q AS (SELECT sum((1 - cs) ** 2) AS value FROM o) SELECT {r6('value')} FROM q")(lambda s, d: rounded(cluster.within_square_sum(_own(s, d), _t(s, d)), "value"))
query("calinski_harabasz", f"WITH {OWN}, g AS (SELECT list_transform(range(64), lambda i: 1.0) AS g), q AS (SELECT (sum((1 - least(1.0, abs(list_cosine_similarity(m, g)))) ** 2) / 9) / (sum((1 - cs) ** 2) / (count(*) - 10)) AS value FROM o, g) SELECT {r6('value')} FROM q")(
    lambda s, d: rounded(cluster.calinski_harabasz(_own(s, d), _t(s, d), np.ones(64)), "value")
)
query("calinski_harabasz_leading")(lambda s, d: rounded(cluster.calinski_harabasz(_own(s, d), _t(s, d), cluster.leading_direction(V.topographies(s, d), 64)), "value"))
query("gap_statistic")(lambda s, d: s.createDataFrame([tuple(round(x, 6) for x in cluster.gap(_own(s, d)))], "gap double, se double"))
DIST = f"{TOPO}, {TPL}, {CEN}, cc AS (SELECT c.sample_ix, state0 AS state, c.x FROM c JOIN topo USING (sample_ix)), dd AS (SELECT a.sample_ix AS i, a.state AS si, b.state AS sj, 1 - least(1.0, abs(list_cosine_similarity(a.x, b.x))) AS d FROM cc a JOIN cc b ON a.sample_ix <> b.sample_ix)"
query("silhouette", f"""WITH {DIST}, m AS (SELECT i, si, sj, avg(d) AS m FROM dd GROUP BY 1, 2, 3), e AS (SELECT i, coalesce(max(m) FILTER (si = sj), 0) AS a, min(m) FILTER (si <> sj) AS b FROM m GROUP BY 1), q AS (SELECT avg((b - a) / greatest(a, b)) AS value FROM e) SELECT {r6('value')} FROM q""")(lambda s, d: rounded(cluster.silhouette(_own(s, d)), "value"))
query("dunn", f"WITH {DIST}, q AS (SELECT min(d) FILTER (si <> sj) / max(d) FILTER (si = sj) AS value FROM dd) SELECT {r6('value')} FROM q")(lambda s, d: rounded(cluster.dunn(_own(s, d)), "value"))
query("within_dispersion", f"WITH {DIST}, t AS (SELECT si, sum(d * d) AS s FROM dd WHERE si = sj GROUP BY 1), n AS (SELECT state, count(*) AS n FROM cc GROUP BY 1), q AS (SELECT sum(s / (2 * n)) AS value FROM t JOIN n ON si = state) SELECT {r6('value')} FROM q")(lambda s, d: rounded(cluster.within_dispersion(_own(s, d)), "value"))
_ONE = {"gev": ("gev_total", "gev"), "cv": ("cv_criterion", "value"), "db": ("davies_bouldin", "value"), "aic": ("information_criteria", "aic"), "bic": ("information_criteria", "bic"), "sil": ("silhouette", "value"), "dunn": ("dunn", "value")}
query("criteria_of_one_k", " UNION ALL ".join(f"SELECT '{n}' AS method, {c} AS score FROM ({ORACLES[q]})" for n, (q, c) in _ONE.items()))(
    lambda s, d: s.createDataFrame([(n, round(v, 6)) for n, v in cluster.criteria(_own(s, d), _t(s, d), names=list(_ONE)).items()], "method string, score double")
)

CURVE = "cur AS (SELECT c_mktsegment AS method, CAST(c_custkey % 9 + 2 AS INTEGER) AS k, sum(c_acctbal) AS score FROM customer GROUP BY 1, 2)"


def _curve(s: SparkSession, d: str) -> DataFrame:
    c = V.read(s, d, "customer")
    return c.groupBy(F.col("c_mktsegment").alias("method"), (F.col("c_custkey") % 9 + 2).cast("int").alias("k")).agg(F.sum("c_acctbal").alias("score"))


query("elbow", f"""WITH {CURVE}, z AS (SELECT method, k, (k - min(k) OVER w) / (max(k) OVER w - min(k) OVER w) AS x, (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS y,
  (arg_min(score, k) OVER w - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS a, (arg_max(score, k) OVER w - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) AS b FROM cur WINDOW w AS (PARTITION BY method)),
f AS (SELECT method, k, round(abs((b - a) * x - y + a) / sqrt((b - a) ** 2 + 1), 12) AS far FROM z) SELECT method, k FROM (SELECT *, row_number() OVER (PARTITION BY method ORDER BY far DESC, k) AS i FROM f) WHERE i = 1""")(lambda s, d: cluster.elbow(_curve(s, d)))
query("gain_elbow", f"WITH {CURVE}, l AS (SELECT *, lag(score) OVER w AS ps, lag(k) OVER w AS pk FROM cur WINDOW w AS (PARTITION BY method ORDER BY k)) SELECT method, coalesce(min(pk) FILTER (100 * (score - ps) / ps < 10), max(k)) AS k FROM l GROUP BY 1")(
    lambda s, d: cluster.gain_elbow(_curve(s, d), 10.0)
)
query("gap_rule", f"WITH {CURVE}, g AS (SELECT k, score AS gap, 100.0 AS se, lead(score - 100.0) OVER (ORDER BY k) AS nx FROM cur WHERE method = 'BUILDING') SELECT coalesce(min(k) FILTER (gap >= nx), arg_max(k, gap)) AS k FROM g")(
    lambda s, d: cluster.gap_choice(_curve(s, d).where("method = 'BUILDING'").select("k", F.col("score").alias("gap"), F.lit(100.0).alias("se")))
)
query("krzanowski_lai", f"WITH {CURVE}, m AS (SELECT k, score * power(k, 2.0 / 64) AS m FROM cur WHERE method = 'BUILDING'), d AS (SELECT k, lag(m) OVER (ORDER BY k) - m AS d FROM m), q AS (SELECT k, abs(d) / nullif(abs(lead(d) OVER (ORDER BY k)), 0) AS value FROM d) SELECT k, {r6('value')} FROM q")(
    lambda s, d: rounded(cluster.krzanowski_lai(_curve(s, d).where("method = 'BUILDING'").select("k", F.col("score").alias("w")), 64), "value")
)
query("consensus_vote", f"WITH {CURVE}, v AS (SELECT method, arg_max(k, score) AS k FROM cur GROUP BY 1), n AS (SELECT *, k > 2 AND k < 10 AS inn FROM v) SELECT k, count(*) AS votes FROM n WHERE inn OR NOT (SELECT bool_or(inn) FROM n) GROUP BY 1 ORDER BY votes DESC, k LIMIT 1")(
    lambda s, d: cluster.consensus(_curve(s, d).groupBy("method").agg(F.max_by("k", "score").alias("k")), 2, 10)
)

# --- events ---------------------------------------------------------------------------------------------------------------------------

ANN = f"{SEG}, ann AS (SELECT recording_id, sample_ix / 250.0 AS onset_s, label AS description FROM seg WHERE label IN ('signup', 'purchase'))"
EW = f"""{ANN}, ew AS (SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY onset_s, description) - 1 AS INTEGER) AS event_ix, description, onset_s AS start_s, end_s FROM (SELECT *, lead(onset_s) OVER (PARTITION BY recording_id ORDER BY onset_s) AS end_s FROM ann) WHERE description = 'purchase')"""
query("event_list", f"WITH {ANN} SELECT recording_id, description, array_to_string(list_transform(list_sort(list(round(onset_s, 3))), lambda x: format('{{:.3f}}', x)), ',') AS onsets FROM ann GROUP BY 1, 2")(
    lambda s, d: events.event_list(V.annotations(s, d)).withColumn("onsets", F.array_join(F.transform("onsets", lambda x: F.format_string("%.3f", x)), ","))
)
query("event_windows", f"WITH {EW} SELECT recording_id, event_ix, description, {r6('start_s', 'end_s')} FROM ew")(lambda s, d: rounded(events.event_windows(V.annotations(s, d), ["purchase"]), "start_s", "end_s"))


def _inside(s: SparkSession, d: str) -> DataFrame:
    samples = V.segmentation(s, d).withColumn("t_s", F.col("sample_ix") / FS)
    return events.in_windows(samples, events.event_windows(V.annotations(s, d), ["purchase"]), count=False)


query("event_features", f"""WITH {EW}, i AS (SELECT recording_id, event_ix, label AS state, count(*) AS n FROM seg JOIN ew USING (recording_id) WHERE sample_ix / 250.0 >= start_s AND (end_s IS NULL OR sample_ix / 250.0 < end_s) AND label IS NOT NULL GROUP BY 1, 2, 3),
q AS (SELECT recording_id, event_ix, state, 100.0 * n / sum(n) OVER (PARTITION BY recording_id, event_ix) AS value FROM i) SELECT recording_id, event_ix, state, {r6('value')} FROM q""")(
    lambda s, d: rounded(features.coverage(_inside(s, d), ("recording_id", "event_ix")), "value")
)
OW = "ow AS (SELECT recording_id, sample_ix AS event_ix, label AS description, sample_ix / 250.0 AS start_s, CASE WHEN label = 'signup' THEN sample_ix / 250.0 + 0.1 ELSE sample_ix / 250.0 + 0.03 END AS end_s FROM seg WHERE label IN ('signup', 'purchase'))"


def _overlapping(s: SparkSession, d: str) -> DataFrame:
    a = V.annotations(s, d)
    end = F.col("onset_s") + F.when(F.col("description") == "signup", 0.1).otherwise(0.03)
    return a.select("recording_id", F.round(F.col("onset_s") * FS).cast("long").alias("event_ix"), "description", F.col("onset_s").alias("start_s"), end.alias("end_s"))


query("overlapping_windows", f"""WITH {SEG}, {OW}, i AS (SELECT recording_id, event_ix, description, seg.sample_ix, seg.label FROM seg JOIN ow USING (recording_id) WHERE seg.sample_ix / 250.0 >= start_s AND seg.sample_ix / 250.0 < end_s)
SELECT recording_id, event_ix, description, row_number() OVER (PARTITION BY recording_id, event_ix ORDER BY sample_ix) - 1 AS sample_ix, label FROM i""")(
    lambda s, d: events.in_windows(V.segmentation(s, d).withColumn("t_s", F.col("sample_ix") / FS), _overlapping(s, d), chunk_s=0.1).select("recording_id", "event_ix", "description", "sample_ix", "label")
)
PP = "pp AS (SELECT *, CASE WHEN t_ms >= -200 AND t_ms < 0 THEN 'pre' WHEN t_ms >= 0 AND t_ms < 200 THEN 'post' END AS window_type FROM epo)"


def _pp(s: SparkSession, d: str) -> DataFrame:
    return events.before_after(V.epochs(s, d), (-200, 0), (0, 200))


query("pre_post_features", f"WITH {EPO}, {PP}, q AS (SELECT window_type, label AS state, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY window_type) AS value FROM pp WHERE window_type IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2) SELECT window_type, state, {r6('value')} FROM q")(
    lambda s, d: rounded(features.coverage(_pp(s, d), ("window_type",)), "value")
)
query("trial_features", f"WITH {EPO}, {PP}, q AS (SELECT trial, window_type, label AS state, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY trial, window_type) AS value FROM pp WHERE window_type IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2, 3) SELECT trial, window_type, state, {r6('value')} FROM q")(
    lambda s, d: rounded(features.coverage(_pp(s, d), ("trial", "window_type")), "value")
)
ROF = f"""{EPO}, occ AS (SELECT t_ms, state, coalesce(c, 0) / (SELECT count(DISTINCT trial) FROM epo) AS occ FROM (SELECT DISTINCT t_ms FROM epo) CROSS JOIN (SELECT DISTINCT label AS state FROM epo WHERE label IS NOT NULL) LEFT JOIN (SELECT t_ms, label AS state, count(*) AS c FROM epo WHERE label IS NOT NULL GROUP BY 1, 2) USING (t_ms, state)),
z AS (SELECT *, count(*) OVER w AS dn, sum(CASE WHEN occ = 0 THEN 1 ELSE 0 END) OVER w AS nz, sum(occ) OVER w AS su, 0.5 * min(occ) FILTER (occ > 0) OVER w / count(*) OVER w AS eps FROM occ WINDOW w AS (PARTITION BY t_ms)),
y AS (SELECT *, CASE WHEN occ = 0 THEN eps ELSE occ - eps * nz * occ / su END AS v FROM z), x AS (SELECT t_ms, state, occ, ln(v * su / sum(v) OVER (PARTITION BY t_ms)) AS l FROM y),
clr AS (SELECT t_ms, state, occ, l - avg(l) OVER (PARTITION BY t_ms) AS clr FROM x), rof AS (SELECT t_ms, state, occ, clr, clr - median(clr) FILTER (t_ms BETWEEN -200 AND -10) OVER (PARTITION BY state) AS clr_bc FROM clr)"""
query("rof", f"WITH {ROF} SELECT t_ms, state, {r6('occ', 'clr', 'clr_bc')} FROM rof")(lambda s, d: rounded(events.relative_occurrence(V.epochs(s, d), (-200.0, -10.0)), "occ", "clr", "clr_bc"))
RTF = f"""{EPO}, se AS (SELECT trial, (t_ms + lead(t_ms) OVER w) / 2 AS tm, label AS state, lead(label) OVER w AS state_to FROM epo WINDOW w AS (PARTITION BY trial ORDER BY t_ms)),
ws AS (SELECT trial, tm, state, state_to, unnest(list_filter([CASE WHEN tm BETWEEN -200 AND -10 THEN 'baseline' END, CASE WHEN tm BETWEEN 0 AND 100 THEN 'early' END, CASE WHEN tm BETWEEN 50 AND 200 THEN 'late' END], lambda x: x IS NOT NULL)) AS win FROM se WHERE tm IS NOT NULL),
dn AS (SELECT win, count(DISTINCT trial) * count(DISTINCT tm) AS n FROM ws GROUP BY 1), rt AS (SELECT win, state, state_to, count(*) / any_value(n) AS rate FROM ws JOIN dn USING (win) WHERE state <> state_to GROUP BY 1, 2, 3),
q AS (SELECT a.win AS "window", a.state, a.state_to, a.rate, 100 * (a.rate - coalesce(b.rate, 0)) / CASE WHEN coalesce(b.rate, 0) = 0 THEN 1e-10 ELSE b.rate END AS pct_change FROM rt a LEFT JOIN rt b ON b.win = 'baseline' AND a.state = b.state AND a.state_to = b.state_to WHERE a.win <> 'baseline')"""
query("rtf", f'WITH {RTF} SELECT "window", state, state_to, {r6("rate", "pct_change")} FROM q')(
    lambda s, d: rounded(events.transition_rates(V.epochs(s, d), {"early": (0, 100), "late": (50, 200)}, (-200, -10)), "rate", "pct_change")
)

# --- statistics --------------------------------------------------------------------------------------------------------------------------

query("paired_t", f"WITH {PAIRS}, q AS (SELECT feature, count(*) AS n, avg(x - y) / stddev_samp(x - y) * sqrt(count(*)) AS stat, avg(x - y) / stddev_samp(x - y) AS d FROM pairs GROUP BY 1) SELECT feature, n, {r6('stat', 'd')} FROM q")(
    lambda s, d: rounded(stats.paired_t(stats.paired(V.values(s, d), "a", "b")).select("feature", "n", "stat", "d"), "stat", "d")
)
query("paired_by_order", f"""WITH {VALUES}, o AS (SELECT feature, grp, value, row_number() OVER (PARTITION BY feature, grp ORDER BY subject) AS i FROM vals), pr AS (SELECT feature, i, max(value) FILTER (grp = 'a') AS x, max(value) FILTER (grp = 'b') AS y FROM o GROUP BY 1, 2 HAVING count(*) = 2),
q AS (SELECT feature, count(*) AS n, avg(x - y) / stddev_samp(x - y) * sqrt(count(*)) AS stat, avg(x - y) / stddev_samp(x - y) AS d, avg(x - y) AS m, stddev_samp(x - y) AS sd FROM pr GROUP BY 1) SELECT feature, n, {r6('stat', 'd', 'm', 'sd')} FROM q""")(
    lambda s, d: rounded(stats.paired_t(stats.paired(V.values(s, d), "a", "b", "order")).select("feature", "n", "stat", "d", "m", "sd"), "stat", "d", "m", "sd")
)
query("paired_by_order_tests")(lambda s, d: rounded(stats.with_interval(stats.with_p(stats.paired_t(stats.paired(V.values(s, d), "a", "b", "order")))), "stat", "p"))
MOM = f"{VALUES}, mo AS (SELECT feature, count(*) FILTER (grp = 'a') AS n1, count(*) FILTER (grp = 'b') AS n2, avg(value) FILTER (grp = 'a') AS m1, avg(value) FILTER (grp = 'b') AS m2, var_samp(value) FILTER (grp = 'a') AS v1, var_samp(value) FILTER (grp = 'b') AS v2 FROM vals GROUP BY 1)"
query("pooled_t", f"WITH {MOM}, q AS (SELECT feature, n1, n2, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)) AS stat, n1 + n2 - 2 AS df FROM mo) SELECT feature, n1, n2, {r6('stat', 'df')} FROM q")(
    lambda s, d: rounded(stats.independent_t(V.values(s, d), "a", "b", True), "stat", "df")
)
query("welch_t", f"WITH {MOM}, q AS (SELECT feature, n1, n2, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS stat, (v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)) AS df FROM mo) SELECT feature, n1, n2, {r6('stat', 'df')} FROM q")(
    lambda s, d: rounded(stats.independent_t(V.values(s, d), "a", "b", False), "stat", "df")
)
query("cohens_d", f"WITH {MOM}, q AS (SELECT feature, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM mo) SELECT feature, {r6('d')} FROM q")(lambda s, d: rounded(stats.cohens_d(V.values(s, d), "a", "b"), "d"))
query("levene", f"""WITH {VALUES}, z AS (SELECT feature, grp, abs(value - median(value) OVER (PARTITION BY feature, grp)) AS z FROM vals), g AS (SELECT feature, grp, count(*) AS n, avg(z) AS m, var_pop(z) AS v FROM z GROUP BY 1, 2),
a AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS am FROM g), q AS (SELECT feature, sum(n * (m - am) ** 2) / (sum(n * v) / (sum(n) - 2)) AS stat FROM a GROUP BY 1) SELECT feature, {r6('stat')} FROM q""")(
    lambda s, d: rounded(stats.levene(V.values(s, d), "a", "b").select("feature", "stat"), "stat")
)
query("t_test")(lambda s, d: rounded(stats.t_test(V.values(s, d), "a", "b"), "stat", "df", "p"))
RANK = f"{VALUES}, rk AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM vals)"
query("mann_whitney_u", f"WITH {RANK}, q AS (SELECT feature, sum(r) FILTER (grp = 'a') - count(*) FILTER (grp = 'a') * (count(*) FILTER (grp = 'a') + 1) / 2 AS stat FROM rk GROUP BY 1) SELECT feature, {r6('stat')} FROM q")(
    lambda s, d: rounded(stats.mann_whitney(V.values(s, d), "a", "b").select("feature", "stat"), "stat")
)
query("wilcoxon_w", f"""WITH {PAIRS}, df AS (SELECT feature, x - y AS d FROM pairs WHERE x <> y), rk AS (SELECT feature, d, rank() OVER (PARTITION BY feature ORDER BY abs(d)) + (count(*) OVER (PARTITION BY feature, abs(d)) - 1) / 2.0 AS r FROM df),
q AS (SELECT feature, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0)) AS stat FROM rk GROUP BY 1) SELECT feature, {r6('stat')} FROM q""")(
    lambda s, d: rounded(stats.wilcoxon(stats.paired(V.values(s, d), "a", "b")).select("feature", "stat"), "stat")
)
query("kruskal_wallis", f"""WITH {RANK}, ti AS (SELECT feature, sum(t ** 3 - t) AS ties, sum(t) AS n FROM (SELECT feature, value, count(*) AS t FROM rk GROUP BY 1, 2) GROUP BY 1), g AS (SELECT feature, sum(q) AS q FROM (SELECT feature, grp, sum(r) ** 2 / count(*) AS q FROM rk GROUP BY 1, 2) GROUP BY 1),
q AS (SELECT feature, (12 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS stat FROM g JOIN ti USING (feature)) SELECT feature, {r6('stat')} FROM q""")(lambda s, d: rounded(stats.kruskal(V.values(s, d)).select("feature", "stat"), "stat"))
query("one_way_anova", f"""WITH {VALUES}, g AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM vals GROUP BY 1, 2), a AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS am FROM g),
q AS (SELECT feature, (sum(n * (m - am) ** 2) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) AS stat FROM a GROUP BY 1) SELECT feature, {r6('stat')} FROM q""")(lambda s, d: rounded(stats.one_way(V.values(s, d)).select("feature", "stat"), "stat"))

PV = "pv AS (SELECT p_brand AS feature, count(*) FILTER (p_size <= 2) / count(*) AS p FROM part GROUP BY 1)"


def _p(s: SparkSession, d: str) -> DataFrame:
    return V.read(s, d, "part").groupBy(F.col("p_brand").alias("feature")).agg((F.count_if(F.col("p_size") <= 2) / F.count("*")).alias("p"))


UP = "PARTITION BY 1 ORDER BY p, feature"
ADJ = {
    "bonferroni": "p * m",
    "sidak": "1 - power(1 - p, m)",
    "holm": f"max(p * (m - i + 1)) OVER ({UP})",
    "holm-sidak": f"max(1 - power(1 - p, m - i + 1)) OVER ({UP})",
    "fdr_bh": f"min(p * m / i) OVER ({UP} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
}
for _m, _e in ADJ.items():
    query(f"p_adjust_{_m.replace('-', '_')}", f"WITH {PV}, n AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, feature) AS i FROM pv), q AS (SELECT feature, p, least({_e}, 1.0) AS p_adj FROM n) SELECT feature, {r6('p', 'p_adj')} FROM q")(
        lambda s, d, m=_m: rounded(stats.adjust(_p(s, d), m), "p", "p_adj")
    )
BH = f"{PV}, n AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, feature) AS i FROM pv), bh AS (SELECT feature, p, m, least({ADJ['fdr_bh']}, 1.0) AS a FROM n)"
WHOLE = {
    "hommel": f"""WITH {PV}, n AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, feature) AS i FROM pv), c AS (SELECT k, min(k * p / (i - (m - k))) AS c FROM n, (SELECT unnest(range(2, (SELECT count(*) + 1 FROM pv))) AS k) WHERE i >= m - k + 2 GROUP BY k),
q AS (SELECT feature, p, least(greatest(p, max(CASE WHEN i >= m - k + 2 THEN c ELSE least(c, k * p) END)), 1.0) AS p_adj FROM n, c GROUP BY feature, p)""",
    "fdr_tsbh": f"WITH {BH}, r AS (SELECT count(*) FILTER (a <= 0.05) AS r FROM bh), q AS (SELECT feature, p, CASE WHEN r = 0 OR r = m THEN a ELSE least(a * (m - r) / m, 1.0) END AS p_adj FROM bh, r)",
    "fdr_tsbky": f"WITH {BH}, r AS (SELECT count(*) FILTER (a <= 0.05 / 1.05) AS r FROM bh), q AS (SELECT feature, p, CASE WHEN r = m THEN a ELSE least(a * (m - r) / m * 1.05, 1.0) END AS p_adj FROM bh, r)",
}
for _m, _e in WHOLE.items():
    query(f"p_adjust_{_m}", f"{_e} SELECT feature, {r6('p', 'p_adj')} FROM q")(lambda s, d, m=_m: rounded(stats.adjust(_p(s, d), m), "p", "p_adj"))


def _sessions(s: SparkSession, d: str) -> DataFrame:
    return V.values(s, d).withColumnRenamed("grp", "session")


ICC = f"""{VALUES}, fu AS (SELECT *, count(*) OVER (PARTITION BY feature, subject) AS c FROM vals), co AS (SELECT * FROM fu WHERE c = 2), me AS (SELECT *, avg(value) OVER (PARTITION BY feature) AS g, avg(value) OVER (PARTITION BY feature, subject) AS r, avg(value) OVER (PARTITION BY feature, grp) AS cm FROM co),
ss AS (SELECT feature, count(DISTINCT subject) AS n, sum((r - g) ** 2) AS sr, sum((cm - g) ** 2) AS sc, sum((value - r - cm + g) ** 2) AS se FROM me GROUP BY 1), ms AS (SELECT feature, n, sr / (n - 1) AS msr, sc AS msc, se / (n - 1) AS mse FROM ss),
icc AS (SELECT feature, n, (msr - mse) / (msr + mse + 2 * (msc - mse) / n) AS icc FROM ms)"""
query("icc21", f"WITH {ICC} SELECT feature, n, {r6('icc')} FROM icc")(lambda s, d: rounded(stats.icc(_sessions(s, d)).select("feature", "n", "icc"), "icc"))
query("icc_band", f"WITH {ICC} SELECT feature, CASE WHEN icc < 0.5 THEN 'poor' WHEN icc < 0.75 THEN 'moderate' WHEN icc < 0.9 THEN 'good' ELSE 'excellent' END AS band FROM icc")(
    lambda s, d: stats.icc(_sessions(s, d)).select("feature", N.icc_band(F.col("icc")).alias("band"))
)
query("icc_interval")(lambda s, d: rounded(stats.icc_interval(stats.icc(_sessions(s, d))), "icc", "ci_low", "ci_high"))
query("mean_interval", f"WITH {VALUES}, a AS (SELECT feature, grp, avg(value) AS mean, stddev_samp(value) / sqrt(count(value)) AS se FROM vals GROUP BY 1, 2), q AS (SELECT feature, grp, mean, mean - 1.96 * se AS low, mean + 1.96 * se AS high FROM a) SELECT feature, grp, {r6('mean', 'low', 'high')} FROM q")(
    lambda s, d: rounded(stats.mean_interval(V.values(s, d), "feature", "grp"), "mean", "low", "high")
)
query("stars", f"WITH {PV} SELECT feature, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM pv")(lambda s, d: _p(s, d).select("feature", N.stars(F.col("p")).alias("stars")))
query("mixed_model")(lambda s, d: rounded(stats.mixed_model(V.values(s, d), "a", "b"), "coef", "se", "p"))
query("gee")(lambda s, d: rounded(stats.gee(V.values(s, d), "a", "b"), "coef", "se", "p"))


def _series(s: SparkSession, d: str) -> DataFrame:
    e = V.segmentation(s, d)
    return e.select(F.col("recording_id").alias("subject"), ((F.col("sample_ix") - 20) * 10.0).alias("t_ms"), (F.col("value") - 50.0).alias("value"))


def _halves(s: SparkSession, d: str, half: int) -> DataFrame:
    """Users in pairs: the even and the odd one of each are two sessions of a subject."""
    return _series(s, d).where(F.col("subject") % 2 == half).withColumn("subject", F.floor(F.col("subject") / 2))


def _rates(s: SparkSession, d: str) -> DataFrame:
    """Changes of transition rates as values of two studies; a user's events are one trial."""
    e = V.epochs(s, d).withColumn("recording_id", F.col("trial"))
    r = events.transition_rates(e, {"post_tms": (0.0, 200.0)}, (-200.0, -10.0), ["recording_id"])
    return r.select(F.concat_ws("_", F.lit("RTF"), "state", "state_to").alias("feature"), F.when(F.col("recording_id") % 2 == 0, "a").otherwise("b").alias("grp"), F.floor(F.col("recording_id") / 2).alias("subject"), F.col("pct_change").alias("value"))


query("tfce")(lambda s, d: rounded(stats.tfce(_series(s, d)), "stat", "score", "p"))
query("tfce_paired")(lambda s, d: rounded(stats.paired_tfce(*(_halves(s, d, i) for i in (0, 1))), "stat", "score", "p"))
TT = f"""{SEG}, z AS (SELECT recording_id AS subject, CAST((sample_ix - 20) * 10.0 AS DOUBLE) AS t_ms, value - 50.0 AS v FROM seg)"""
query("tfce_statistic", f"WITH {TT}, q AS (SELECT t_ms, CASE WHEN count(*) > 1 AND var_samp(v) > 1e-12 THEN avg(v) * sqrt(count(*)) / stddev_samp(v) ELSE 0.0 END AS stat FROM z GROUP BY 1) SELECT t_ms, {r6('stat')} FROM q")(
    lambda s, d: rounded(stats.tfce(_series(s, d), 1).select("t_ms", "stat"), "stat")
)
query("tfce_clusters", f"""WITH {TT}, q AS (SELECT t_ms, CASE WHEN count(*) > 1 AND var_samp(v) > 1e-12 THEN avg(v) * sqrt(count(*)) / stddev_samp(v) ELSE 0.0 END AS stat FROM z GROUP BY 1),
sg AS (SELECT *, CASE WHEN abs(stat) > 0.5 THEN sign(stat) END AS s FROM q), nw AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER (ORDER BY t_ms) AND row_number() OVER (ORDER BY t_ms) > 1 THEN 0 ELSE 1 END AS n FROM sg),
cl AS (SELECT *, sum(n) OVER (ORDER BY t_ms)::BIGINT AS cluster FROM nw), r AS (SELECT cluster, min(t_ms) AS start_ms, max(t_ms) AS end_ms, avg(stat) AS mean_stat, CASE WHEN max(s) > 0 THEN 'positive' ELSE 'negative' END AS direction FROM cl WHERE s IS NOT NULL GROUP BY 1)
SELECT cluster, start_ms, end_ms, {r6('mean_stat')}, direction FROM r""")(
    # p by a fixed bound of the statistic, so that clusters can be counted in SQL; tfce has permuted ones
    lambda s, d: rounded(stats.clusters(stats.tfce(_series(s, d), 1).withColumn("p", F.when(F.abs("stat") > 0.5, 0.01).otherwise(1.0))), "mean_stat")
)

# --- comparisons of studies ------------------------------------------------------------------------------------------------------------


def _windows(s: SparkSession, d: str) -> DataFrame:
    """Coverage of windows of twenty samples; users are subjects of two studies in turn."""
    v = features.sliding_coverage(V.segmentation(s, d), FS, 20 / FS)
    return v.select(F.concat(F.lit("COV_"), "state").alias("feature"), F.when(F.col("recording_id") % 2 == 0, "a").otherwise("b").alias("grp"), F.floor(F.col("recording_id") / 2).alias("subject"), "window_ix", "value")


WV = f"""{SEG}, {WIN}, ws AS (SELECT recording_id, label AS state FROM seg WHERE label IS NOT NULL GROUP BY 1, 2), wn AS (SELECT recording_id, window_ix, label AS state, count(*) AS c FROM w WHERE label IS NOT NULL GROUP BY 1, 2, 3),
wt AS (SELECT recording_id, window_ix, sum(c) AS t FROM wn GROUP BY 1, 2), wg AS (SELECT DISTINCT recording_id, window_ix FROM w),
wv AS (SELECT 'COV_' || state AS feature, CASE WHEN recording_id % 2 = 0 THEN 'a' ELSE 'b' END AS grp, CAST(floor(recording_id / 2) AS BIGINT) AS subject, window_ix, coalesce(100.0 * c / t, 0.0) AS value
  FROM wg JOIN ws USING (recording_id) LEFT JOIN wn USING (recording_id, window_ix, state) LEFT JOIN wt USING (recording_id, window_ix))"""
SP = f"""{WV}, sm AS (SELECT feature, subject, avg(value) FILTER (grp = 'a') AS a, avg(value) FILTER (grp = 'b') AS b FROM wv GROUP BY 1, 2), sp AS (SELECT * FROM sm WHERE a IS NOT NULL AND b IS NOT NULL),
st AS (SELECT feature, count(*) AS n, avg(a) AS mean1, avg(b) AS mean2, avg(b - a) AS diff, avg(b - a) / stddev_samp(b - a) * sqrt(count(*)) AS stat, avg(b - a) / stddev_samp(b - a) AS d FROM sp GROUP BY 1 HAVING count(*) > 2),
wc AS (SELECT feature, count(*) FILTER (grp = 'a') AS windows1, count(*) FILTER (grp = 'b') AS windows2 FROM wv GROUP BY 1)"""
_SP = ("mean1", "mean2", "diff", "stat", "d")
query("sliding_paired", f"WITH {SP} SELECT feature, n, windows1, windows2, {r6(*_SP)} FROM st JOIN wc USING (feature)")(
    lambda s, d: rounded(compare.sliding_paired(_windows(s, d), "a", "b").select("feature", "n", "windows1", "windows2", *_SP), *_SP)
)
query("sliding_modelled")(lambda s, d: rounded(compare.modelled(_windows(s, d), "a", "b"), "mean1", "mean2", "diff", "p", "d", "p_adj"))
MC = """SELECT feature, count(DISTINCT subject) FILTER (grp = 'a') AS subjects1, count(DISTINCT subject) FILTER (grp = 'b') AS subjects2, count(*) FILTER (grp = 'a') AS n1, count(*) FILTER (grp = 'b') AS n2,
  round(avg(value) FILTER (grp = 'a'), 6) AS mean1, round(avg(value) FILTER (grp = 'b'), 6) AS mean2 FROM"""
_MC = ("feature", "subjects1", "subjects2", "n1", "n2", "mean1", "mean2")
query("sliding_modelled_means", f"WITH {WV} {MC} wv GROUP BY 1")(lambda s, d: rounded(compare.modelled(_windows(s, d), "a", "b").select(*_MC), "mean1", "mean2"))


def _event_values(s: SparkSession, d: str) -> DataFrame:
    """Coverage after each signup or purchase, users as subjects of two studies in turn."""
    seg = V.segmentation(s, d).withColumn("t_s", F.col("sample_ix") / FS)
    inside = events.in_windows(seg, events.event_windows(V.annotations(s, d), ["signup", "purchase"]))
    c = features.coverage(inside, ["recording_id", "event_ix", "description"])
    return c.select(F.concat(F.lit("COV_"), "state").alias("feature"), "description", F.when(F.col("recording_id") % 2 == 0, "a").otherwise("b").alias("grp"), F.floor(F.col("recording_id") / 2).alias("subject"), "value")


query("event_windows_modelled")(lambda s, d: rounded(compare.modelled(_event_values(s, d), "a", "b", ["description"]), "mean1", "mean2", "diff", "p", "d", "p_adj"))


def _pre_post(s: SparkSession, d: str) -> DataFrame:
    e = events.before_after(V.epochs(s, d), (-200.0, 0.0), (0.0, 200.0))
    c = features.coverage(e.withColumn("sample_ix", F.col("t_ms").cast("long")), ["trial", "window_type"])
    return c.select(F.concat(F.lit("COV_"), "state").alias("feature"), F.col("window_type").alias("grp"), F.col("trial").alias("subject"), "value")


PP = f"""{EPO}, pp AS (SELECT trial, CASE WHEN t_ms < 0 THEN 'pre' ELSE 'post' END AS grp, label FROM epo WHERE t_ms >= -200 AND t_ms < 200 AND label IS NOT NULL),
pc AS (SELECT trial, grp, label, count(*) AS c FROM pp GROUP BY 1, 2, 3), pv AS (SELECT 'COV_' || label AS feature, grp, trial AS subject, 100.0 * c / sum(c) OVER (PARTITION BY trial, grp) AS value FROM pc)"""
query("pre_post_modelled")(lambda s, d: rounded(compare.modelled(_pre_post(s, d), "pre", "post"), "mean1", "mean2", "diff", "p", "d", "p_adj"))
query("pre_post_means", f"WITH {PP} {MC.replace(chr(39) + 'a' + chr(39), chr(39) + 'pre' + chr(39)).replace(chr(39) + 'b' + chr(39), chr(39) + 'post' + chr(39))} pv GROUP BY 1")(
    lambda s, d: rounded(compare.modelled(_pre_post(s, d), "pre", "post").select(*_MC), "mean1", "mean2")
)
MD = f"{MOM}, md AS (SELECT feature, n1, n2, m1 AS mean1, m2 AS mean2, m2 - m1 AS diff, (m2 - m1) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS d FROM mo)"
query("transitions_compared")(lambda s, d: rounded(compare.transitions_compared(_rates(s, d), "a", "b"), "mean1", "mean2", "diff", "ci_low", "ci_high", "stat", "p", "d", "p_adj"))
query("means_compared", f"WITH {MD} SELECT feature, n1, n2, {r6('mean1', 'mean2', 'diff', 'd')} FROM md")(
    lambda s, d: rounded(compare.transitions_compared(V.values(s, d), "a", "b").select("feature", "n1", "n2", "mean1", "mean2", "diff", "d"), "mean1", "mean2", "diff", "d")
)
query("summary_counts", f"WITH {SP} SELECT count(*) AS tests FROM st")(lambda s, d: compare.summary_counts(compare.sliding_paired(_windows(s, d), "a", "b")).select("tests"))
query("box_data", f"""WITH {VALUES}, qs AS (SELECT feature, grp, count(*) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM vals GROUP BY 1, 2),
q AS (SELECT feature, grp, n, q1, median, q3, min(value) FILTER (value >= q1 - 1.5 * (q3 - q1)) AS low, max(value) FILTER (value <= q3 + 1.5 * (q3 - q1)) AS high FROM qs JOIN vals USING (feature, grp) GROUP BY ALL) SELECT feature, grp, n, {r6('q1', 'median', 'q3', 'low', 'high')} FROM q""")(
    lambda s, d: rounded(compare.box_data(V.values(s, d), "feature", "grp"), "q1", "median", "q3", "low", "high")
)
query("values_of_code", f"WITH {WV} SELECT feature, grp, subject, window_ix, round(value, 6) AS value FROM wv WHERE feature LIKE 'COV!_%' ESCAPE '!' AND subject IN (SELECT CAST(floor(c_custkey / 2) AS BIGINT) FROM customer WHERE c_acctbal > 0)")(
    lambda s, d: rounded(compare.of_files(compare.of_code(_windows(s, d), "COV"), V.read(s, d, "customer").where("c_acctbal > 0").select(F.floor(F.col("c_custkey") / 2).alias("subject"))), "value")
)
query("friedman", f"""WITH {VALUES}, fk AS (SELECT feature, count(DISTINCT grp) AS k FROM vals GROUP BY 1), fv AS (SELECT * FROM (SELECT vals.*, fk.k, count(*) OVER (PARTITION BY feature, subject) AS c FROM vals JOIN fk USING (feature)) WHERE c = k AND k > 1),
fr AS (SELECT *, rank() OVER (PARTITION BY feature, subject ORDER BY value) + (count(*) OVER (PARTITION BY feature, subject, value) - 1) / 2.0 AS r FROM fv),
fs AS (SELECT feature, k, n, sum(s * s) AS s FROM (SELECT feature, k, grp, sum(r) AS s, count(*) AS n FROM fr GROUP BY 1, 2, 3) GROUP BY 1, 2, 3), ft AS (SELECT feature, sum(t ** 3 - t) AS ties FROM (SELECT feature, subject, value, count(*) AS t FROM fr GROUP BY 1, 2, 3) GROUP BY 1),
q AS (SELECT feature, n, (12.0 / (n * k * (k + 1)) * s - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1.0))) AS stat FROM fs JOIN ft USING (feature)) SELECT feature, n, {r6('stat')} FROM q""")(
    lambda s, d: rounded(stats.friedman(V.values(s, d)).select("feature", "n", "stat"), "stat")
)
def _conditions(s: SparkSession, d: str) -> DataFrame:
    """Mean and greatest event value of a user by event type: types are conditions, users subjects."""
    e = V.read(s, d, "events").groupBy(F.col("user_id").alias("subject"), F.col("event_type").alias("grp")).agg(F.avg("value").alias("mean"), F.max("value").alias("most"))
    return e.select("subject", "grp", F.explode(F.map_from_arrays(F.array(F.lit("mean"), F.lit("most")), F.array("mean", "most"))).alias("feature", "value"))


CONDITIONS = """cd AS (SELECT user_id AS subject, event_type AS grp, unnest(['mean', 'most']) AS feature, unnest([avg(value), max(value)]) AS value FROM events GROUP BY 1, 2),
ck AS (SELECT *, (SELECT count(DISTINCT grp) FROM cd) AS k, count(*) OVER (PARTITION BY feature, subject) AS c FROM cd), cf AS (SELECT feature, subject, grp, value, k FROM ck WHERE c = k),
cs AS (SELECT x.feature, x.k, x.grp AS gi, y.grp AS gj, count(*) AS n, covar_samp(x.value, y.value) AS c, avg(x.value) AS mi FROM cf x JOIN cf y USING (feature, subject) GROUP BY ALL),
cc AS (SELECT *, c - avg(c) OVER (PARTITION BY feature, gi) - avg(c) OVER (PARTITION BY feature, gj) + avg(c) OVER (PARTITION BY feature) AS z, avg(mi) OVER (PARTITION BY feature) AS m FROM cs),
ce AS (SELECT feature, any_value(n) AS n, CAST(any_value(k) AS INTEGER) AS k, any_value(n) * sum((mi - m) ** 2) FILTER (gi = gj) / (any_value(k) - 1) AS ms, sum(z) FILTER (gi = gj) / (any_value(k) - 1) AS me,
  sum(z) FILTER (gi = gj) ** 2 / ((any_value(k) - 1) * sum(z * z)) AS gg FROM cc GROUP BY feature),
q AS (SELECT feature, n, k, ms / me AS stat, CAST(k - 1 AS DOUBLE) AS df1, CAST((k - 1) * (n - 1) AS DOUBLE) AS df2, gg, least(1.0, (n * (k - 1) * gg - 2) / ((k - 1) * (n - 1 - (k - 1) * gg))) AS hf,
  ms / me * (k - 1) / (ms / me * (k - 1) + (k - 1) * (n - 1)) AS eta FROM ce)"""
# tails of five groups have closed forms: F with 4 and d degrees, chi-square with 4
P_F4 = "pow(df2 / (df2 + 4 * stat), df2 / 2) * (1 + df2 / 2 * (1 - df2 / (df2 + 4 * stat))) AS p"
P_CHI4 = "exp(-stat / 2) * (1 + stat / 2) AS p"
_MODEL_P = ("stat", "p")
query("repeated_anova", f"WITH {CONDITIONS}, qp AS (SELECT *, {P_F4} FROM q) SELECT feature, n, k, df1, df2, {r6('stat', 'p', 'gg', 'hf', 'eta')} FROM qp")(
    lambda s, d: rounded(designs.repeated_anova(_conditions(s, d)).select("feature", "n", "k", "df1", "df2", "stat", "p", "gg", "hf", "eta"), "stat", "p", "gg", "hf", "eta")
)
query("one_way_p", f"""WITH {CONDITIONS}, og AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM cd GROUP BY 1, 2), oa AS (SELECT *, sum(n * m) OVER (PARTITION BY feature) / sum(n) OVER (PARTITION BY feature) AS am FROM og),
oq AS (SELECT feature, (sum(n * (m - am) ** 2) / 4) / (sum(n * v) / (sum(n) - 5)) AS stat, CAST(sum(n) - 5 AS DOUBLE) AS df2 FROM oa GROUP BY 1), op AS (SELECT *, {P_F4} FROM oq) SELECT feature, df2, {r6('stat', 'p')} FROM op""")(
    lambda s, d: rounded(compare.tested(_conditions(s, d), "one_way_anova", "", "").select("feature", "df2", "stat", "p"), *_MODEL_P)
)
_MR = "rank() OVER (PARTITION BY {0} ORDER BY value) + (count(*) OVER (PARTITION BY {0}, value) - 1) / 2.0 AS r"
query("kruskal_p", f"""WITH {CONDITIONS}, kr AS (SELECT *, {_MR.format('feature')} FROM cd), kt AS (SELECT feature, sum(t ** 3 - t) AS ties, sum(t) AS n FROM (SELECT feature, value, count(*) AS t FROM kr GROUP BY 1, 2) GROUP BY 1),
kg AS (SELECT feature, sum(q) AS q FROM (SELECT feature, grp, sum(r) ** 2 / count(*) AS q FROM kr GROUP BY 1, 2) GROUP BY 1), kq AS (SELECT feature, (12 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - ties / (n ** 3 - n)) AS stat FROM kg JOIN kt USING (feature)),
kp AS (SELECT *, {P_CHI4} FROM kq) SELECT feature, {r6('stat', 'p')} FROM kp""")(lambda s, d: rounded(compare.tested(_conditions(s, d), "kruskal_wallis", "", "").select("feature", "stat", "p"), *_MODEL_P))
query("friedman_p", f"""WITH {CONDITIONS}, fr AS (SELECT *, {_MR.format('feature, subject')} FROM cf), fs AS (SELECT feature, n, sum(s * s) AS s FROM (SELECT feature, grp, sum(r) AS s, count(*) AS n FROM fr GROUP BY 1, 2) GROUP BY 1, 2),
ft AS (SELECT feature, sum(t ** 3 - t) AS ties FROM (SELECT feature, subject, value, count(*) AS t FROM fr GROUP BY 1, 2, 3) GROUP BY 1), fq AS (SELECT feature, n, (12.0 / (n * 30.0) * s - 18.0 * n) / (1 - ties / (n * 120.0)) AS stat FROM fs JOIN ft USING (feature)),
fp AS (SELECT *, {P_CHI4} FROM fq) SELECT feature, n, {r6('stat', 'p')} FROM fp""")(lambda s, d: rounded(compare.tested(_conditions(s, d), "friedman", "", "").select("feature", "n", "stat", "p"), *_MODEL_P))
query("bootstrap")(lambda s, d: rounded(designs.bootstrap(V.trial_values(s, d), "a", "b"), "diff", "se", "ci_low", "ci_high", "p"))
query("bootstrap_difference", f"""WITH q AS (SELECT event_type AS feature, count(value) FILTER (user_id % 2 = 0) AS n1, count(value) FILTER (user_id % 2 = 1) AS n2,
  avg(value) FILTER (user_id % 2 = 1) - avg(value) FILTER (user_id % 2 = 0) AS diff FROM events GROUP BY 1) SELECT feature, n1, n2, {r6('diff')} FROM q""")(
    lambda s, d: rounded(designs.bootstrap(V.trial_values(s, d), "a", "b", 20).select("feature", "n1", "n2", "diff"), "diff")
)
query("permuted_clusters")(lambda s, d: rounded(designs.permuted_clusters(V.presence(s, d), "a", "b", 1000, threshold=1.0), "mass", "p"))
CELLS = f"""{EPO}, st AS (SELECT DISTINCT label AS state FROM seg WHERE label IS NOT NULL), pr AS (SELECT trial, CASE WHEN trial % 2 = 0 THEN 'a' ELSE 'b' END AS grp, t_ms, state, CASE WHEN label = state THEN 1.0::DOUBLE ELSE 0.0 END AS v FROM epo, st),
cl AS (SELECT t_ms, state, count(*) AS n, sum(v * v) AS q, count(*) FILTER (grp = 'a') AS n1, count(*) FILTER (grp = 'b') AS n2, coalesce(sum(v) FILTER (grp = 'a'), 0) AS s1, coalesce(sum(v) FILTER (grp = 'b'), 0) AS s2 FROM pr GROUP BY 1, 2),
ct AS (SELECT t_ms, state, CASE WHEN n1 > 0 AND n2 > 0 AND n > 2 THEN CASE WHEN q - s1 * s1 / n1 - s2 * s2 / n2 > 1e-12 * q THEN (s1 / n1 - s2 / n2) / sqrt((q - s1 * s1 / n1 - s2 * s2 / n2) / (n - 2) * (1.0 / n1 + 1.0 / n2)) ELSE 0.0 END ELSE 0.0 END AS stat FROM cl)"""
query("cluster_cells", f"WITH {CELLS} SELECT t_ms, state, {r6('stat')} FROM ct")(
    lambda s, d: rounded(designs.cell_tests(V.presence(s, d), "a", "b", 1).where("perm = 0").select("t_ms", "state", "stat"), "stat")
)
query("cluster_masses", f"""WITH RECURSIVE {CELLS}, on_ AS (SELECT *, dense_rank() OVER (ORDER BY t_ms) AS ti, dense_rank() OVER (ORDER BY state) AS si FROM ct), cn AS (SELECT *, ti * 100 + si AS id, sign(stat) AS sg FROM on_ WHERE abs(stat) > 1.0),
ed AS (SELECT x.id AS a, y.id AS b FROM cn x JOIN cn y ON x.sg = y.sg AND abs(x.ti - y.ti) + abs(x.si - y.si) = 1),
rc AS (SELECT id AS a, id AS b FROM cn UNION SELECT rc.a, ed.b FROM rc JOIN ed ON rc.b = ed.a), rt AS (SELECT a AS id, min(b) AS root FROM rc GROUP BY 1),
q AS (SELECT min(t_ms) AS start_ms, max(t_ms) AS end_ms, string_agg(DISTINCT state, ',' ORDER BY state) AS states, count(*) AS cells, sum(stat) AS mass FROM cn JOIN rt USING (id) GROUP BY root) SELECT start_ms, end_ms, states, cells, {r6('mass')} FROM q""")(
    lambda s, d: rounded(designs.permuted_clusters(V.presence(s, d), "a", "b", 1, threshold=1.0).select("start_ms", "end_ms", "states", "cells", "mass"), "mass")
)
query("gee_gamma")(lambda s, d: rounded(stats.gee(V.values(s, d), "a", "b", family="gamma"), "coef", "se", "p"))
query("surrogate_ratios")(lambda s, d: rounded(features.surrogate_ratios(V.segmentation(s, d), 100), "mean", "sd"))
_plain = lambda name: ORACLES[name].replace(r6("value"), "value")
VAR = ", ".join(f"""{c}_l AS (SELECT *, value - lag(value) OVER (PARTITION BY recording_id, state ORDER BY window_ix) AS dv FROM ({_plain(f'sliding_{n}')})),
{c}_v AS (SELECT recording_id, state, stddev_samp(value) AS sd, sqrt(avg(dv * dv)) AS rmssd FROM {c}_l GROUP BY 1, 2)""" for c, n in (("dur", "duration"), ("cov", "coverage"), ("occ", "occurrence")))
VAR += ", q AS (" + " UNION ALL ".join(f"SELECT recording_id, state, '{c.upper()}_{n}' AS feature, {n.lower()} AS value FROM {c}_v" for c in ("dur", "cov", "occ") for n in ("SD", "RMSSD")) + ")"
query("window_variability", f"WITH {VAR} SELECT recording_id, state, feature, {r6('value')} FROM q")(lambda s, d: rounded(features.window_variability(V.segmentation(s, d), FS, 20 / FS), "value"))
_VT = [f"{c}_{n}_{x}" for c in ("COV", "DUR", "OCC") for n in ("SD", "RMSSD") for x in STATES]
query("variability_table", f"WITH {VAR} SELECT recording_id, " + ", ".join(f"round(max(value) FILTER (feature || '_' || state = '{c}'), 6) + 0.0 AS {c}" for c in _VT) + " FROM q GROUP BY 1")(
    lambda s, d: rounded(S.variability_table(features.window_variability(V.segmentation(s, d), FS, 20 / FS), _VT), *_VT)
)
_PARTS = {"COV": "coverage", "OCC": "occurrence", "DUR": "duration_geometric", "MMD": "duration_geometric", "TP": "transition_probability"}
REG = [f"SELECT recording_id, '{c}' AS feature, state, {'state_to' if c == 'TP' else 'NULL'} AS state_to, NULL::DOUBLE AS t_ms, value FROM ({ORACLES[n]})" for c, n in _PARTS.items()]
REG += [f"SELECT recording_id, 'ER', NULL, NULL, NULL, rate FROM ({ORACLES['entropy_rate']})", f"SELECT recording_id, 'ERR', 'EntropyClass' || class, NULL, NULL, value FROM ({ORACLES['entropy_class_share']})"]
REG += [f"SELECT recording_id, 'LZC', NULL, NULL, NULL, value FROM ({ORACLES['lempel_ziv']})"]
query("feature_registry", " UNION ALL ".join(REG))(lambda s, d: rounded(features.features(V.segmentation(s, d), FS, ("COV", "OCC", "DUR", "MMD", "TP", "ER", "ERR", "LZC")), "value"))



def _stretches(rows: str, codes: Sequence[str]) -> str:
    """The SQL of several features with other rows (recording_id, sample_ix, label) as the segmentation."""
    parts = [p for p in REG if any(f"'{c}'" in p.split(" FROM (", 1)[0] for c in codes)]
    return " UNION ALL ".join(parts).replace(SEG, rows)


_AROUND = ("COV", "OCC", "DUR", "TP", "ER", "ERR", "LZC")
_BOUNDS = "CASE WHEN recording_id LIKE '%pre' THEN -200.0::DOUBLE ELSE 0.0::DOUBLE END AS start_ms, CASE WHEN recording_id LIKE '%pre' THEN 0.0::DOUBLE ELSE 200.0::DOUBLE END AS end_ms"
_RAW = f"""{EPO.replace('seg AS', 'raw AS', 1).replace('FROM seg', 'FROM raw')}, stretches AS (SELECT *, CASE WHEN t_ms >= -200 AND t_ms < 0 THEN 'pre' WHEN t_ms >= 0 AND t_ms < 200 THEN 'post' END AS window_type FROM epo)"""
_TRIALS = f"{_RAW}, seg AS (SELECT trial || '/' || window_type AS recording_id, row_number() OVER (PARTITION BY trial, window_type ORDER BY t_ms) - 1 AS sample_ix, label FROM stretches WHERE window_type IS NOT NULL)"
_POOLED = f"{_RAW}, seg AS (SELECT window_type AS recording_id, row_number() OVER (PARTITION BY window_type ORDER BY trial, t_ms) - 1 AS sample_ix, label FROM stretches WHERE window_type IS NOT NULL)"
query(
    "trial_features_all",
    f"""SELECT CAST(split_part(recording_id, '/', 1) AS BIGINT) AS trial, split_part(recording_id, '/', 2) AS window_type, {_BOUNDS}, feature, state, state_to, value
FROM ({_stretches(_TRIALS, _AROUND)}) q""",
)(lambda s, d: rounded(around.trial_features(V.epochs(s, d), FS, _AROUND, (-200, 0), (0, 200), ()), "value"))
query(
    "pooled_features_all",
    f"""SELECT recording_id AS window_type, {_BOUNDS}, (SELECT count(DISTINCT user_id) FROM events) AS n_trials, feature, state, state_to, value
FROM ({_stretches(_POOLED, _AROUND[:-1])}) q""",
)(lambda s, d: rounded(around.pooled_features(V.epochs(s, d), FS, _AROUND[:-1], (-200, 0), (0, 200), ()), "value"))
_EVENTS = f"""{EW.replace('seg AS', 'raw AS', 1).replace('FROM seg', 'FROM raw')}, seg AS (SELECT recording_id || '/' || event_ix AS recording_id,
  row_number() OVER (PARTITION BY recording_id, event_ix ORDER BY sample_ix) - 1 AS sample_ix, label FROM raw JOIN ew USING (recording_id) WHERE sample_ix / 250.0 >= start_s AND (end_s IS NULL OR sample_ix / 250.0 < end_s))"""
query(
    "event_features_all",
    f"""WITH {EW} SELECT recording_id, event_ix, ew.description, {r6('ew.start_s', 'ew.end_s')}, feature, state, state_to, value
FROM (SELECT CAST(split_part(recording_id, '/', 1) AS BIGINT) AS recording_id, CAST(split_part(recording_id, '/', 2) AS INTEGER) AS event_ix, * EXCLUDE (recording_id) FROM ({_stretches(_EVENTS, _AROUND[:4])})) q JOIN ew USING (recording_id, event_ix)""",
)(lambda s, d: rounded(around.event_features(V.segmentation(s, d).withColumn("t_s", F.col("sample_ix") / FS), events.event_windows(V.annotations(s, d), ["purchase"]), FS, _AROUND[:4]), "start_s", "end_s", "value"))


# --- joins, names, channels -----------------------------------------------------------------------------------------------------------

FILES = """nm AS (SELECT 'sub-' || lpad(c_custkey::VARCHAR, 9, '0') || '_task-rest' || c || '_trial1' AS name FROM customer, (SELECT unnest(['_Pre', '_Post']) AS c) WHERE NOT (c_acctbal < 0 AND c = '_Post'))"""
query("subject_id", f"WITH {FILES}, q AS (SELECT name, ltrim(regexp_extract(name, 'sub-(\\d+)', 1), '0') AS n FROM nm) SELECT name, CASE WHEN length(n) < 2 THEN lpad(n, 2, '0') ELSE n END AS subject FROM q")(
    lambda s, d: V.file_names(s, d).select("name", N.subject_id(F.col("name")).alias("subject"))
)
query("base_filename", f"WITH {FILES} SELECT name, regexp_replace(name, '_task-rest_(Pre|Post)_trial1', '') AS base FROM nm")(lambda s, d: V.file_names(s, d).select("name", N.base_filename(F.col("name")).alias("base")))
query("condition_pairs", f"WITH {FILES}, b AS (SELECT name, regexp_replace(name, '_(Pre|Post)', '') AS base, contains(name, 'Pre') AS pre FROM nm) SELECT base, max(name) FILTER (pre) AS first, max(name) FILTER (NOT pre) AS second FROM b GROUP BY 1 HAVING count(*) = 2")(
    lambda s, d: joins.condition_pairs(V.file_names(s, d), "Pre", "Post")
)
query("file_pairs", f"WITH {FILES}, b AS (SELECT name, replace(replace(replace(name, '_Pre', '_*'), '_Post', '_*'), '-', '_') AS base, contains(name, 'Pre') AS pre FROM nm) SELECT base, max(name) FILTER (pre) AS first, max(name) FILTER (NOT pre) AS second FROM b GROUP BY 1 HAVING count(*) = 2")(
    lambda s, d: joins.file_pairs(V.file_names(s, d), "Pre", "Post")
)
FOUND = "'{}' AS strategy, '{}' AS component, '{}' AS first_condition, '{}' AS second_condition"
query("condition_by_subject", f"WITH {FILES}, q AS (SELECT ltrim(regexp_extract(name, 'sub-(\\d+)', 1), '0') AS n, name FROM nm) SELECT {FOUND.format('subject', 'condition', 'post', 'pre')}, CASE WHEN length(n) < 2 THEN lpad(n, 2, '0') ELSE n END AS base, min(name) AS first, max(name) AS second FROM q GROUP BY n HAVING count(*) = 2")(
    lambda s, d: conditions.varying_condition(V.file_names(s, d))
)
query("condition_by_component", f"WITH n AS (SELECT s_suppkey AS k, unnest(CASE WHEN s_acctbal < 0 THEN [1] ELSE [1, 2] END) AS c FROM supplier) SELECT {FOUND.format('component', 'condition', 'cond1', 'cond2')}, 'run:run-' || CASE WHEN k < 10 THEN '0' ELSE '' END || k AS base, 'run-' || k || '_cond1' AS first, 'run-' || k || '_cond2' AS second FROM n GROUP BY k HAVING count(*) = 2")(
    lambda s, d: conditions.varying_condition(V.pairs_of_names(s, d, "supplier", "s", "run-", ("_cond1", "_cond2")))
)
query("condition_by_delimiter", f"WITH n AS (SELECT c_custkey AS k, unnest(CASE WHEN c_acctbal < 0 THEN [1] ELSE [1, 2] END) AS c FROM customer) SELECT {FOUND.format('delimiter', '_', 'left', 'right')}, 'man' || k || ' * hand' AS base, 'man' || k || '_left_hand' AS first, 'man' || k || '_right_hand' AS second FROM n GROUP BY k HAVING count(*) = 2")(
    lambda s, d: conditions.varying_condition(V.pairs_of_names(s, d, "customer", "c", "man", ("_left_hand", "_right_hand")))
)
query("matched_subjects", f"WITH {VALUES} SELECT DISTINCT subject FROM vals WHERE grp = 'a' AND feature = 'error' AND subject IN (SELECT subject FROM vals WHERE grp = 'b' AND feature = 'signup')")(
    lambda s, d: joins.matched_subjects(V.values(s, d).where("grp = 'a' and feature = 'error'"), V.values(s, d).where("grp = 'b' and feature = 'signup'"))
)
query("missing_states", f"WITH {SEG}, a AS (SELECT DISTINCT r.recording_id, l.label FROM (SELECT DISTINCT recording_id FROM seg) r, (SELECT DISTINCT label FROM seg WHERE label IS NOT NULL) l), w AS (SELECT DISTINCT recording_id, label FROM seg WHERE value > 200) SELECT * FROM a ANTI JOIN w USING (recording_id, label)")(
    lambda s, d: joins.missing(
        V.segmentation(s, d).select("recording_id").distinct().join(V.segmentation(s, d).where("label is not null").select("label").distinct(), how="cross"),
        V.segmentation(s, d).where("value > 200").select("recording_id", "label"),
        ["recording_id", "label"],
    )
)
query("feature_full_merge", f"WITH {VALUES}, a AS (SELECT feature, subject, value AS x FROM vals WHERE grp = 'a'), b AS (SELECT feature, subject, value AS y FROM vals WHERE grp = 'b'), q AS (SELECT * FROM a FULL JOIN b USING (feature, subject)) SELECT feature, subject, {r6('x', 'y')} FROM q")(
    lambda s, d: rounded(joins.merge_common(V.values(s, d).where("grp = 'a'").select("feature", "subject", F.col("value").alias("x")), V.values(s, d).where("grp = 'b'").select("feature", "subject", F.col("value").alias("y"))), "x", "y")
)
query("common_column_union", "SELECT c_custkey AS id, c_acctbal AS bal, 'c' AS study FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 's' FROM supplier")(
    lambda s, d: joins.stack_common(
        {
            "c": V.read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), "c_mktsegment"),
            "s": V.read(s, d, "supplier").select("s_name", F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal")),
        }
    )
)
CH = "ch AS (SELECT p_partkey % 10 AS recording_id, p_partkey AS channel_ix, CASE WHEN p_size % 2 = 0 THEN 'CH' ELSE 'Ch' END || CAST(floor(sqrt(p_partkey)) AS BIGINT) AS channel, p_size > 45 AS is_bad, p_brand AS montage FROM part)"
query("channel_consistency", f"WITH {CH}, o AS (SELECT *, row_number() OVER (PARTITION BY lower(channel) ORDER BY recording_id, channel_ix) AS i FROM ch) SELECT max(channel) FILTER (i = 1) AS channel, count(DISTINCT recording_id) AS files, count(DISTINCT recording_id) = (SELECT count(DISTINCT recording_id) FROM ch) AS consistent FROM o GROUP BY lower(channel)")(
    lambda s, d: joins.channel_consistency(V.channels(s, d))
)
query("bad_union", f"WITH {CH} SELECT montage, array_to_string(list_sort(list(DISTINCT channel)), ',') AS bads FROM ch WHERE is_bad GROUP BY 1")(
    lambda s, d: joins.union_of_bads(V.channels(s, d)).withColumn("bads", F.array_join("bads", ","))
)
query("auxiliary_channels", "SELECT DISTINCT p_name AS channel, (" + " OR ".join(f"contains(upper(p_name), '{x}')" for x in N.AUXILIARY) + ") AS auxiliary FROM part")(
    lambda s, d: V.read(s, d, "part").select(F.col("p_name").alias("channel"), N.is_auxiliary(F.col("p_name")).alias("auxiliary")).distinct()
)
query("event_match", "SELECT DISTINCT event_type AS name, contains(lower(event_type), 'up') OR contains('up', lower(event_type)) AS partial FROM events")(
    lambda s, d: V.read(s, d, "events").select(F.col("event_type").alias("name"), N.event_matches(F.col("event_type"), F.lit("UP"), "partial").alias("partial")).distinct()
)
query("neighbour_channels", """WITH p AS (SELECT 'm' || (p_partkey // 32) AS m, p_partkey::INTEGER AS k, p_partkey::DOUBLE % 7 AS x, p_partkey::DOUBLE * 0.37 % 3 AS y, p_partkey::DOUBLE * p_partkey % 11 * 0.1 AS z FROM part),
d AS (SELECT a.m, a.k, b.k AS j, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM p a JOIN p b ON a.m = b.m AND a.k <> b.k), r AS (SELECT *, row_number() OVER w AS rank, lead(d) OVER w - d AS st FROM d WINDOW w AS (PARTITION BY k ORDER BY d, j)),
u AS (SELECT *, avg(st) FILTER (rank <= 3) OVER (PARTITION BY k) AS us FROM r), c AS (SELECT *, min(rank) FILTER (st > 2 * us AND rank >= 3) OVER (PARTITION BY k) AS cut FROM u)
SELECT m AS montage, k AS channel_ix, j AS neighbour_ix, rank::INTEGER AS rank FROM c WHERE rank <= least(8, coalesce(cut, 8))""")(lambda s, d: signal.neighbours(V.positions(s, d)))

# --- signals and sources ----------------------------------------------------------------------------------------------------------------------


def _series_of(s: SparkSession, d: str) -> DataFrame:
    return V.segmentation(s, d).select(F.col("recording_id").cast("string").alias("recording_id"), F.lit("v").alias("channel"), "sample_ix", F.col("value").alias("x"))


# Fourier sums, term by term
SERIES = f"{SEG}, se AS (SELECT CAST(recording_id AS VARCHAR) AS recording_id, sample_ix AS t, value AS x, count(*) OVER (PARTITION BY recording_id) AS n FROM seg)"
FOURIER = "f AS (SELECT recording_id, any_value(n) AS n, k, sum(x * cos(2 * pi() * k * t / n)) AS re, -sum(x * sin(2 * pi() * k * t / n)) AS im FROM (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM {source}) GROUP BY recording_id, k)"
query("resample", f"""WITH {SERIES}, {FOURIER.format(source='se')}, g AS (SELECT *, CAST(round_even(n * 0.5, 0) AS BIGINT) AS m FROM f), h AS (SELECT *, unnest(range(0, m)) AS j FROM g WHERE k <= m // 2),
q AS (SELECT recording_id, 'v' AS channel, j AS sample_ix, sum(CASE WHEN k = 0 THEN re WHEN 2 * k = m THEN re * cos(pi() * j) ELSE 2 * (re * cos(2 * pi() * k * j / m) - im * sin(2 * pi() * k * j / m)) END) / any_value(n) AS x FROM h GROUP BY 1, 3) SELECT recording_id, channel, sample_ix, {r6('x')} FROM q""")(
    lambda s, d: rounded(signal.resample(_series_of(s, d), FS, 125.0), "x")
)
query("band_pass", f"""WITH {SERIES}, p AS (SELECT recording_id, t, x, n, first_value(x) OVER w AS x0, last_value(x) OVER w AS x1 FROM se WINDOW w AS (PARTITION BY recording_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
y AS (SELECT recording_id, t + n - 1 AS t, x, 3 * n - 2 AS n FROM p UNION ALL SELECT recording_id, n - 1 - t, 2 * x0 - x, 3 * n - 2 FROM p WHERE t > 0 UNION ALL SELECT recording_id, 3 * n - 3 - t, 2 * x1 - x, 3 * n - 2 FROM p WHERE t < n - 1),
{FOURIER.format(source='y')}, a AS (SELECT *, k * 250.0 / n AS hz FROM f), g AS (SELECT *, (0.5 - 0.5 * cos(pi() * greatest(0, least(1, (hz - 5) + 0.5)))) * (0.5 - 0.5 * cos(pi() * greatest(0, least(1, (60 - hz) + 0.5)))) AS gain FROM a),
h AS (SELECT *, unnest(range(0, (n + 2) // 3)) AS j FROM g WHERE gain <> 0),
i AS (SELECT recording_id, j AS sample_ix, sum(gain * CASE WHEN k = 0 THEN re WHEN 2 * k = n THEN re * cos(pi() * (j + (n + 2) // 3 - 1)) ELSE 2 * (re * cos(2 * pi() * k * (j + (n + 2) // 3 - 1) / n) - im * sin(2 * pi() * k * (j + (n + 2) // 3 - 1) / n)) END) / any_value(n) AS x FROM h GROUP BY 1, 2),
q AS (SELECT e.recording_id, 'v' AS channel, e.t AS sample_ix, coalesce(i.x, 0) AS x FROM se e LEFT JOIN i ON i.recording_id = e.recording_id AND i.sample_ix = e.t) SELECT recording_id, channel, sample_ix, {r6('x')} FROM q""")(
    lambda s, d: rounded(signal.band_pass(_series_of(s, d), FS, 5.0, 60.0), "x")
)
TAPS = """ta AS (SELECT k, k - 206 AS m, 0.54 - 0.46 * cos(2 * pi() * k / 412) AS w FROM range(413) r(k)),
tb AS (SELECT k, m, w * CASE WHEN m = 0 THEN 2 * (67.5 - 4.0) / 250 ELSE (sin(2 * pi() * 67.5 * m / 250) - sin(2 * pi() * 4.0 * m / 250)) / (pi() * m) END AS h FROM ta),
tap AS (SELECT k, m, h / (SELECT sum(h * cos(2 * pi() * 35.75 * m / 250)) FROM tb) AS h FROM tb)"""
query("fir_filter", f"""WITH {SERIES}, {TAPS}, p AS (SELECT recording_id, t, x, n, first_value(x) OVER w AS x0, last_value(x) OVER w AS x1 FROM se WINDOW w AS (PARTITION BY recording_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
y AS (SELECT recording_id, t, x FROM p UNION ALL SELECT recording_id, -t, 2 * x0 - x FROM p WHERE t > 0 UNION ALL SELECT recording_id, 2 * (n - 1) - t, 2 * x1 - x FROM p WHERE t < n - 1),
q AS (SELECT e.recording_id, 'v' AS channel, e.t AS sample_ix, sum(y.x * tap.h) AS x FROM se e JOIN y ON y.recording_id = e.recording_id AND abs(y.t - e.t) <= 206 JOIN tap ON tap.m = y.t - e.t GROUP BY 1, 2, 3) SELECT recording_id, channel, sample_ix, {r6('x')} FROM q""")(
    lambda s, d: rounded(signal.band_filter(_series_of(s, d), FS, 5.0, 60.0, "fir", chunk=64), "x")
)
query("iir_filter")(lambda s, d: rounded(signal.band_filter(_series_of(s, d), FS, 5.0, 60.0, "iir", chunk=64), "x"))
query("spatial_smooth", f"""WITH {TOPO}, q AS (SELECT sample_ix, CAST(i - 1 AS INTEGER) AS pos, CASE WHEN i = 1 THEN (x[1] + x[2]) / 2 WHEN i = 64 THEN x[64] WHEN i % 2 = 0 THEN (x[i - 1] + x[i] + x[i + 1]) / 3 ELSE x[i] END AS value
  FROM (SELECT sample_ix, x, unnest(range(1, 65)) AS i FROM topo)) SELECT sample_ix, pos, {r6('value')} FROM q""")(
    lambda s, d: _each(signal.spatial_smooth(V.topographies(s, d), {0: [1], **{i: [i - 1, i + 1] for i in range(1, 63, 2)}}, 64))
)
query("noisy_channels", f"""WITH {SEG}, cs AS (SELECT recording_id % 5 AS recording_id, recording_id AS channel, ln(stddev_pop(value) + 1e-30) AS s FROM seg GROUP BY 1, 2), cm AS (SELECT *, median(s) OVER (PARTITION BY recording_id) AS m FROM cs),
ca AS (SELECT *, median(abs(s - m)) OVER (PARTITION BY recording_id) AS a FROM cm), q AS (SELECT recording_id, channel, coalesce((s - m) / nullif(1.4826 * a, 0), 0) AS z FROM ca) SELECT recording_id, channel, {r6('z')}, abs(z) > 5 AS is_bad FROM q""")(
    lambda s, d: rounded(signal.noisy_channels(V.segmentation(s, d).select((F.col("recording_id") % 5).alias("recording_id"), F.col("recording_id").alias("channel"), F.col("value").alias("x"))), "z")
)
query("mean_source_by_label", f"WITH {TOPO}, e AS (SELECT state0, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(x) AS v FROM topo), q AS (SELECT 'S' || state0 AS label, pos, avg(v) AS value FROM e GROUP BY 1, 2) SELECT label, pos, {r6('value')} FROM q")(
    lambda s, d: rounded(inverse.mean_by_label(V.topographies(s, d).select(F.concat(F.lit("S"), F.col("state0")).alias("label"), F.col("topo").alias("src"))), "value")
)
query("group_source_average", f"WITH {TOPO}, e AS (SELECT state0, CAST(generate_subscripts(x, 1) - 1 AS INTEGER) AS pos, unnest(list_transform(x, lambda v: (v - list_min(x)) / (list_max(x) - list_min(x)))) AS v FROM topo), q AS (SELECT state0 AS label, pos, avg(v) AS value FROM e GROUP BY 1, 2) SELECT label, pos, {r6('value')} FROM q")(
    lambda s, d: rounded(inverse.group_average(V.topographies(s, d).select(F.col("state0").alias("label"), F.col("topo").alias("src"))), "value")
)


def _inverse(s: SparkSession, d: str, method: str) -> np.ndarray:
    return inverse.inverse_operator(inverse.leadfield_of(V.leadfield(s, d)), method)


query("localised_sources")(lambda s, d: inverse.localise(V.topographies(s, d), _inverse(s, d, "dspm")).select("sample_ix", "src"))
query("localised_eloreta")(lambda s, d: inverse.localise(V.topographies(s, d), _inverse(s, d, "eloreta")).select("sample_ix", "src"))
query("localised_sparse")(lambda s, d: inverse.localise_sparse(V.topographies(s, d), inverse.leadfield_of(V.leadfield(s, d))).select("sample_ix", "src"))


def _source_weights(s: SparkSession, d: str) -> np.ndarray:
    rows = inverse.localise(inverse.state_weights(V.topographies(s, d), _t(s, d)), _inverse(s, d, "mne"))
    return inverse.regress_sources(rows, 10, 20)


@query("source_regression")
def _regression(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(i, j, float(x)) for i, r in enumerate(_source_weights(s, d)) for j, x in enumerate(r)], "state int, source int, value double")


query("source_permutation")(lambda s, d: inverse.permutation_z(s, _source_weights(s, d)))
