"""Rates, mixtures and whole jobs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hotspan.functions.tail import Mixture
from hotspan.functions.vectors import fuse_vectors
from hotspan.operators.mixture import fit_mixture, fit_mixture_auto, mixture_policy
from hotspan.operators.rate import add_rate, fit_rate, predict_rate, rate_baseline
from hotspan.operators.scan import sample_scores
from hotspan.operators.segments import join_features
from hotspan.plans.hotspots import HotspotConfig, run_hotspots
from hotspan.plans.training import TrainingConfig, fit_and_predict
from hotspan.session import stage_path, stage_table
from hotspan.sources.writers import write_stage
from hotspan.workload.fields import MIXTURE, tail_sql
from hotspan.workload.registry import query
from hotspan.workload.scans import SELECT_SQL, candidates, recursive
from hotspan.workload.stats import _SAMPLES_SQL, stats_sql
from hotspan.workload.tables import DAY, HOUR, cte, labels, rated, segment_rows, table, typed_events


@query(
    "G6_rate_baseline",
    cte("rated") + 'SELECT chrom, start, "end", obs AS y, round(lam, 6) AS lam_pred FROM rated',
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rate_baseline(labels(spark, sf)).select(
        "chrom", "start", "end", "y", F.round("lam_pred", 6).alias("lam_pred")
    )


@query(
    "G5_predict_rate",
    cte("seg") + """SELECT seg_id, chrom, start, "end", round(sum(lam * kb) OVER w / sum(kb) OVER w, 6) AS lam_pred,
  y AS obs_count, round(y * ln(lam) - lam * kb, 6) AS bin_loglike FROM seg
  WINDOW w AS (PARTITION BY seg_id ORDER BY off ROWS 1 PRECEDING)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = predict_rate(segment_rows(spark, sf), roll_width=2)
    return out.withColumns({c: F.round(c, 6) for c in ("lam_pred", "bin_loglike")})


def _feature_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled bins; features are a daily and a weekly rhythm and the bin's vector.

    The vectors are those of ``embeddings``, numbered along the label that
    stands for the sequence; bins without one have a zero vector.
    """
    vectors = table(spark, sf, "embeddings").select(
        F.concat(F.lit("chr"), F.col("label") + 1).alias("chrom"),
        (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("bigint").alias("w_idx"),
        F.col("embedding").alias("feat"))
    hour = F.floor(F.col("start") / HOUR)
    day = 2 * 3.141592653589793 * (hour % 24) / 24.0
    week = 2 * 3.141592653589793 * (hour % 168) / 168.0
    bins = labels(spark, sf).select(
        "chrom", hour.alias("w_idx"), "start", "end", "y",
        F.array(F.sin(day), F.cos(day), F.sin(week), F.cos(week)).alias("cls"),
        F.lit(HOUR / 1000.0).alias("kb"),
    )
    features = F.concat("cls", F.col("feat").cast("array<double>")).alias("features")
    return join_features(bins, vectors).select("chrom", "w_idx", "start", "end", "y", features, "kb")


_HOURS_SQL = cte("lab") + """, g AS (SELECT start // 3600 % 24 AS hour, sum(y) / sum(CAST(3.6 AS DOUBLE)) AS lam FROM lab GROUP BY 1)
SELECT chrom, lab.start, lab."end", y, round(greatest(lam, 1e-9), 5) AS lam FROM lab JOIN g ON g.hour = lab.start // 3600 % 24"""


@query("G4_fit_rate_hours", _HOURS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """With one column an hour of the day and no penalty, the rate is that hour's mean."""
    # every pass of the fit reads it again
    hours = stage_table(_hour_of_day(_feature_bins(spark, sf)), "hours")
    rated_hours = add_rate(fit_rate(hours, reg=0.0, solver="lbfgs"), hours)
    return rated_hours.select("chrom", "start", "end", "y", F.round("lam", 5).alias("lam"))


def _hour_of_day(rows: DataFrame) -> DataFrame:
    hour = F.floor(F.col("start") / HOUR) % 24
    return rows.withColumn("features", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: (i == hour).cast("double")))


@query(
    "G5_predict_rate_fitted",
    cte("seg") + """, g AS (SELECT start // 3600 % 24 AS hour, sum(y) / sum(kb) AS fitted FROM seg GROUP BY 1),
f AS (SELECT seg.*, greatest(fitted, 1e-9) AS fit FROM seg JOIN g ON g.hour = seg.start // 3600 % 24)
SELECT seg_id, chrom, start, "end", round(sum(fit * kb) OVER w / sum(kb) OVER w, 5) AS lam_pred,
  y AS obs_count, round(y * ln(fit) - fit * kb, 5) AS bin_loglike FROM f
  WINDOW w AS (PARTITION BY seg_id ORDER BY off ROWS 1 PRECEDING)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """A model fitted on the bins and applied to their segments, rolled over two bins."""
    bins = stage_table(_hour_of_day(rated(spark, sf).withColumnRenamed("obs", "y")), "hours")
    model = fit_rate(bins, reg=0.0, solver="lbfgs")
    out = predict_rate(add_rate(model, _hour_of_day(segment_rows(spark, sf).drop("lam"))), roll_width=2)
    return out.withColumns({c: F.round(c, 5) for c in ("lam_pred", "bin_loglike")})


@query("G4_fit_rate")
def _(spark: SparkSession, sf: str) -> DataFrame:
    bins = _feature_bins(spark, sf)
    return add_rate(fit_rate(bins), bins).select("chrom", "w_idx", "start", "end", "y", "lam")


# Every step of the fit keeps the first two moments of the sample.
_MOMENTS_SQL = cte("cand") + """, z AS (SELECT ln(1 + llr / sqrt(len_bp / CAST(1000 AS DOUBLE))) AS z FROM cand WHERE llr > 0)
SELECT round(avg(z), 3) AS first_moment, round(avg(z * z), 3) AS second_moment FROM z"""


def _moments(spark: SparkSession, mixture: Mixture) -> DataFrame:
    """The moments of a mixture, as a row."""
    parts = F.array(*[
        F.struct(F.lit(w).alias("w"), F.lit(mu).alias("mu"), F.lit(s).alias("sig"))
        for w, mu, s in zip(mixture.w, mixture.mu, mixture.sig)
    ])
    table = spark.range(1).select(F.inline(parts))
    return table.agg(
        F.round(F.sum(F.col("w") * F.col("mu")), 3).alias("first_moment"),
        F.round(F.sum(F.col("w") * (F.col("sig") * F.col("sig") + F.col("mu") * F.col("mu"))), 3).alias("second_moment"),
    )


@query("G1_fit_mixture", _MOMENTS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _moments(spark, fit_mixture(sample_scores(candidates(spark, sf), 1.1), keep_spikes=True))


@query("G2_fit_mixture_auto", _MOMENTS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The operator's own sizes and starts: every step of the fit is a job of its own."""
    return _moments(spark, fit_mixture_auto(sample_scores(candidates(spark, sf), 1.1), keep_spikes=True))


@query("G3_mixture_policy", _MOMENTS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _moments(spark, mixture_policy(sample_scores(candidates(spark, sf), 1.1), keep_spikes=True))


@query("G3_mixture_policy_auto", _MOMENTS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _moments(spark, mixture_policy(sample_scores(candidates(spark, sf), 1.1), auto=True, keep_spikes=True))


# The moments are the same for any number of components or steps; the components are not.
def _components(spark: SparkSession, mixture: Mixture) -> DataFrame:
    """The components of a mixture, one row each."""
    rows = [(mixture.k, i, *map(float, x)) for i, x in enumerate(zip(mixture.w, mixture.mu, mixture.sig))]
    return spark.createDataFrame(rows, "k int, component int, w double, mu double, sig double")


@query("G1_fit_mixture_components")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _components(spark, fit_mixture(sample_scores(candidates(spark, sf), 1.1), keep_spikes=True))


@query("G2_fit_mixture_auto_components")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _components(spark, fit_mixture_auto(sample_scores(candidates(spark, sf), 1.1), keep_spikes=True))


@query("G3_mixture_policy_components")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _components(spark, mixture_policy(sample_scores(candidates(spark, sf), 1.1), keep_spikes=True))


@query("G3_mixture_policy_auto_components")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _components(spark, mixture_policy(sample_scores(candidates(spark, sf), 1.1), auto=True, keep_spikes=True))


def _steps_sql(sizes: range, steps: int) -> str:
    """The joint fit in SQL: a fixed number of steps from the plain quantiles, all sizes together."""
    quantiles = " UNION ALL ".join(
        f"SELECT {k} AS k, {j} AS j, quantile_cont(z, CAST({(j + 0.5) / k!r} AS DOUBLE)) AS mu FROM x" for k in sizes for j in range(k))
    sql = cte("cand") + f""", x AS (SELECT round(ln(1 + llr / sqrt(len_bp / CAST(1000 AS DOUBLE))) / 1e-4) * 1e-4 AS z FROM cand WHERE llr > 1e-6),
h AS (SELECT z, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY 1),
t AS (SELECT sum(n) AS n, sqrt(sum(n * z * z) / sum(n) - (sum(n * z) / sum(n)) * (sum(n * z) / sum(n))) AS sd FROM h),
q AS ({quantiles}),
p0 AS (SELECT k, j, CAST(1 AS DOUBLE) / k AS w, mu, (SELECT sd FROM t) / k AS sig FROM q)"""
    for i in range(steps):
        sql += f""",
e{i} AS (SELECT k, j, z, n, ln(w) - ln(sig) - 0.5 * ((z - mu) / sig) * ((z - mu) / sig) - 0.5 * ln(2 * pi()) AS lp FROM h, p{i}),
d{i} AS (SELECT *, exp(lp - top) AS d FROM (SELECT *, max(lp) OVER (PARTITION BY k, z) AS top FROM e{i})),
r{i} AS (SELECT *, sum(d) OVER (PARTITION BY k, z) AS a FROM d{i}),
m{i} AS (SELECT k, j, sum(n * d / a) AS s0, sum(n * d / a * z) AS s1, sum(n * d / a * z * z) AS s2 FROM r{i} GROUP BY 1, 2),
p{i + 1} AS (SELECT k, j, s0 / (SELECT n FROM t) AS w, s1 / s0 AS mu, sqrt(greatest(s2 / s0 - (s1 / s0) * (s1 / s0), 1e-6)) AS sig FROM m{i})"""
    last = steps - 1
    return sql + f""",
l AS (SELECT k, -2 * sum(CASE WHEN j = 0 THEN n * (ln(a) + top) ELSE 0 END) + (3 * k - 1) * ln((SELECT n FROM t)) AS bic FROM r{last} GROUP BY k),
b AS (SELECT arg_min(k, bic) AS k FROM l)
SELECT p.k, CAST(row_number() OVER (ORDER BY mu, sig) - 1 AS INTEGER) AS component, round(w, 5) AS w, round(mu, 5) AS mu, round(sig, 5) AS sig
FROM p{steps} p JOIN b USING (k)"""


def _rounded(components: DataFrame) -> DataFrame:
    return components.withColumns({c: F.round(c, 5) for c in ("w", "mu", "sig")})


@query("G1_fit_mixture_steps", _steps_sql(range(3, 4), 5))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The components after five steps from the plain start."""
    scores = sample_scores(candidates(spark, sf), 1.1)
    return _rounded(_components(spark, fit_mixture(scores, 3, max_iter=5, tol=-math.inf, keep_spikes=True)))


@query("G2_fit_mixture_auto_steps", _steps_sql(range(1, 5), 4))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Four joint steps of the sizes 1 to 4, and the components of the size with the least BIC."""
    scores = sample_scores(candidates(spark, sf), 1.1)
    return _rounded(_components(spark, fit_mixture_auto(scores, 1, 4, n_init=1, max_iter=4, tol=-math.inf, keep_spikes=True)))


@query("G3_mixture_policy_steps", _steps_sql(range(3, 4), 4))
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The policy's fixed branch after four steps."""
    scores = sample_scores(candidates(spark, sf), 1.1)
    return _rounded(_components(spark, mixture_policy(scores, max_iter=4, tol=-math.inf, keep_spikes=True)))


# --- whole jobs --------------------------------------------------------------------

def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Each bin twice, as overlapping segments give it, around its rate."""
    base = rated(spark, sf).select(
        "chrom", "start", "end", F.col("lam").alias("lam_pred"), F.col("obs").alias("obs_count")
    )
    return base.withColumn("lam_pred", F.explode(F.array(F.col("lam_pred") * 0.75, F.col("lam_pred") * 1.25)))


_WEIGHT = f"llr * -({tail_sql('llr / sqrt(len_bp / CAST(1000 AS DOUBLE))')}) / ln(10)"
_RESULT_SQL = (
    recursive(cte("cand")) + SELECT_SQL.format(weight=f"round(({_WEIGHT}) * 1073741824) / 1073741824")
    + f""", iv0 AS (SELECT c.chrom, c.start_bp, c.end_bp, c.len_bp, c.llr, c.y, c.e,
    exp({tail_sql('c.llr / sqrt(c.len_bp / CAST(1000 AS DOUBLE))')}) AS p FROM sel s JOIN cand c
    ON c.chrom = s.chrom AND c.start_bp = s.start_bp AND c.end_bp = s.end_bp),
up AS (SELECT p, sum(count(*)) OVER (ORDER BY p) AS upto, sum(count(*)) OVER () AS m FROM iv0 GROUP BY p),
qv AS (SELECT p, min(m * p / upto) OVER (ORDER BY p DESC) AS q FROM up)"""
)
_INTERVALS_SQL = _RESULT_SQL + """, iv AS (SELECT i.chrom, start_bp, end_bp, len_bp, round(llr, 5) AS "LLR_raw", y AS obs_sum,
  round(e, 6) AS exp_sum, round(i.p, 5) AS p_post, round(least(q, 1), 5) AS fdr FROM iv0 i JOIN qv ON qv.p = i.p)
"""
_HOTSPOTS_SQL = (
    _INTERVALS_SQL
    + """, pt AS (SELECT event_id, i.chrom, start_bp, end_bp, pos, event_type, sample
  FROM ev JOIN iv i ON ev.chrom = i.chrom AND pos BETWEEN start_bp AND end_bp)"""
    + _SAMPLES_SQL[_SAMPLES_SQL.index(", ps AS"):]
    + stats_sql("iv").replace("SELECT v.*", 'SELECT v.chrom, v.start_bp AS start, v.end_bp AS "end", v.len_bp, v."LLR_raw", '
                              "v.obs_sum, v.exp_sum, v.p_post, v.fdr", 1)
)


@query("E1_run_hotspots", _HOTSPOTS_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, select, correct and annotate, with a fixed mixture and BH."""
    cfg = HotspotConfig(max_bp=DAY, mixture=MIXTURE, fdr_method="bh")
    events = typed_events(spark, sf).select("chrom", "pos", "event_type", "sample")
    out = run_hotspots(predictions(spark, sf), events, cfg).drop("fdr_post")
    digits = {"LLR_raw": 5, "exp_sum": 6, "p_post": 5, "fdr": 5, "gini_junc": 6, "frac_TRA": 6}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("E1_run_hotspots_fitted")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the mixture and the share of true nulls estimated."""
    events = typed_events(spark, sf).select("chrom", "pos", "event_type", "sample")
    cfg = HotspotConfig(max_bp=DAY, sample_frac=0.05)
    return run_hotspots(predictions(spark, sf), events, cfg)


@query("E3_fit_and_predict")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cfg = TrainingConfig(segment_lengths=(12, 24), overlap=0.5)
    return fit_and_predict(_feature_bins(spark, sf).drop("kb"), cfg).predictions


@query("E3_training_history")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The objective of every round on training and validation segments."""
    cfg = TrainingConfig(segment_lengths=(12, 24), overlap=0.5)
    return fit_and_predict(_feature_bins(spark, sf).drop("kb"), cfg).history


@query("E3_training_history_resampled")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Four rounds; from the second on segments are drawn and exchange runs."""
    cfg = TrainingConfig(segment_lengths=(12, 24), overlap=0.5, rounds=4, resample_from=2, cutmix_p=0.2)
    return fit_and_predict(_feature_bins(spark, sf).drop("kb"), cfg).history


@query("E4_job")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The command line on written predictions; reads back what it wrote."""
    from hotspan.plans.job import run

    base = stage_path(spark, "job")
    write_stage(predictions(spark, sf), f"{base}/predictions")
    typed_events(spark, sf).drop("event_id", "value").write.csv(f"{base}/events", header=True)
    run(spark, [
        "score", "--predictions", f"{base}/predictions", "--events", f"{base}/events", "--out", f"{base}/out",
        "--max-bp", str(DAY), "--sample-frac", "0.05",
    ])
    return spark.read.parquet(f"{base}/out/final_result")


@query("E4_job_train")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The command line from bins, vectors and events to predictions, with its defaults; reads back what it wrote."""
    from hotspan.plans.job import run

    base = stage_path(spark, "job")
    bins = _feature_bins(spark, sf)
    cls = F.slice("features", 1, 4).cast("array<float>").alias("cls")
    feat = F.slice("features", 5, F.size("features")).cast("array<float>").alias("feat")
    write_stage(bins.select("chrom", "w_idx", "start", "end", cls, F.lit(0.0).alias("y")), f"{base}/bins")
    write_stage(bins.select("chrom", "w_idx", feat), f"{base}/features")
    typed_events(spark, sf).drop("event_id", "value").withColumnRenamed("pos", "start").write.csv(f"{base}/events", header=True)
    run(spark, [
        "train", "--bins", f"{base}/bins", "--features", f"{base}/features", "--events", f"{base}/events",
        "--out", f"{base}/out", "--no-score",
    ])
    return spark.read.parquet(f"{base}/out/predictions")
