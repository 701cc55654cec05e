"""Interval annotation, losses, residuals and robust scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspan.operators import annotate as an
from hotspan.operators import robust as rb
from hotspan.session import stage_table
from hotspan.workload.registry import query
from hotspan.workload.tables import cte, rated, segment_rows, spans, typed_events

KEYS = ["chrom", "start_bp", "end_bp"]


def points(spark: SparkSession, sf: str) -> DataFrame:
    return typed_events(spark, sf).select("event_id", "chrom", "pos", "event_type", "sample")


def groups(spark: SparkSession, sf: str) -> DataFrame:
    return an.event_groups(points(spark, sf), spans(spark, sf), tile_bp=86_401)


_PAIRS_SQL = cte("ev", "iv") + """, pt AS (SELECT event_id, i.chrom, start_bp, end_bp, pos, event_type, sample
  FROM ev JOIN iv i ON ev.chrom = i.chrom AND pos BETWEEN start_bp AND end_bp)"""
_SAMPLES_SQL = _PAIRS_SQL + """, ps AS (SELECT chrom, start_bp, end_bp, sample, count(*) AS x FROM pt GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY chrom, start_bp, end_bp ORDER BY x) AS r,
  count(*) OVER (PARTITION BY chrom, start_bp, end_bp) AS n, sum(x) OVER (PARTITION BY chrom, start_bp, end_bp) AS s FROM ps),
gi AS (SELECT chrom, start_bp, end_bp, CAST(sum((2 * r - n - 1) * x) AS DOUBLE) / (any_value(n) * any_value(s)) AS g,
  any_value(n) + 1 - 2 * CAST(sum((n + 1 - r) * x) AS DOUBLE) / any_value(s) / any_value(n) AS gc FROM rk GROUP BY ALL)
"""


@query("J6_points_in_intervals", _PAIRS_SQL + " SELECT * FROM pt")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return an.points_in_intervals(points(spark, sf), spans(spark, sf), tile_bp=86_401)


@query("J6_points_in_intervals_asof", _PAIRS_SQL + " SELECT * FROM pt")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The same for intervals that do not overlap, by one ordered stream."""
    return an.points_in_disjoint_intervals(points(spark, sf), spans(spark, sf))


@query(
    "J7_bins_in_intervals",
    cte("grid", "iv") + 'SELECT g.chrom, g.start, g."end", start_bp, end_bp FROM grid g JOIN iv '
    'ON iv.chrom = g.chrom AND g.start >= start_bp AND g."end" <= end_bp',
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from hotspan.workload.tables import grid

    return an.bins_in_intervals(grid(spark, sf), spans(spark, sf), tile_bp=50_000)


_OBS_EXP_SQL = (
    cte("rated", "iv") + 'SELECT iv.chrom, start_bp, end_bp, sum(obs) AS obs_sum, round(sum(lam * kb), 6) AS exp_sum '
    'FROM rated g JOIN iv ON iv.chrom = g.chrom AND g.start >= start_bp AND g."end" <= end_bp GROUP BY ALL'
)


@query("A15_interval_sums", _OBS_EXP_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The same totals by differences of running sums."""
    return an.interval_sums(rated(spark, sf), spans(spark, sf), 7 * 86_400).withColumn("exp_sum", F.round("exp_sum", 6))


@query("A15_interval_obs_exp", _OBS_EXP_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return an.interval_obs_exp(rated(spark, sf), spans(spark, sf)).withColumn("exp_sum", F.round("exp_sum", 6))


@query(
    "A16_event_counts",
    _PAIRS_SQL + " SELECT chrom, start_bp, end_bp, count(*) AS n_evt_all, count(DISTINCT sample) AS n_samp_all,"
    " count(DISTINCT event_type) AS event_type_diversity FROM pt GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return an.event_counts(groups(spark, sf))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "A17_events_by_type",
    _PAIRS_SQL + " SELECT chrom, start_bp, end_bp, "
    + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_evt_{t}" for t in _TYPES) + " FROM pt GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return an.events_by_type(groups(spark, sf), list(_TYPES))


@query(
    "A17_types_as_map",
    _PAIRS_SQL + " SELECT chrom, start_bp, end_bp, event_type, count(*) AS n_evt, count(DISTINCT sample) AS n_samp"
    " FROM pt GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    maps = an.types_as_map(groups(spark, sf))
    long = maps.select(*KEYS, F.explode("n_evt").alias("event_type", "n_evt"), "n_samp")
    return long.withColumn("n_samp", F.element_at("n_samp", F.col("event_type")))


@query(
    "A18_samples_by_type",
    _PAIRS_SQL + " SELECT chrom, start_bp, end_bp, "
    + ", ".join(f"count(DISTINCT sample) FILTER (event_type = '{t}') AS n_samp_{t}" for t in _TYPES)
    + " FROM pt GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return an.samples_by_type(groups(spark, sf), an.event_types(groups(spark, sf)))


@query(
    "A19_per_sample_spread",
    _SAMPLES_SQL + "SELECT chrom, start_bp, end_bp, max(x) AS max_junc_per_sample,"
    " CAST(median(x) AS DOUBLE) AS median_junc_per_sample FROM ps GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return an.per_sample_spread(groups(spark, sf))


@query("A20_gini", _SAMPLES_SQL + "SELECT chrom, start_bp, end_bp, round(least(greatest(g, 0), 1), 6) AS gini_junc FROM gi")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return an.gini(groups(spark, sf)).withColumn("gini_junc", F.round("gini_junc", 6))


@query("A20_gini_compat", _SAMPLES_SQL + "SELECT chrom, start_bp, end_bp, round(least(greatest(gc, 0), 1), 6) AS gini_junc FROM gi")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return an.gini(groups(spark, sf), compat=True).withColumn("gini_junc", F.round("gini_junc", 6))


@query(
    "A21_type_fraction",
    _PAIRS_SQL + " SELECT chrom, start_bp, end_bp, round(avg(CAST(contains(event_type, 'ic') AS INTEGER)), 6) AS frac"
    " FROM pt GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return an.type_fraction(groups(spark, sf), "ic", "frac").withColumn("frac", F.round("frac", 6))


def stats_sql(intervals: str, pattern: str = "tra") -> str:
    """The statistics columns of ``attach_event_stats`` from pt / ps / gi."""
    kinds = "".join(
        f", coalesce(e.n_evt_{t}, 0) AS n_evt_{t}, coalesce(e.n_samp_{t}, 0) AS n_samp_{t}" for t in _TYPES
    )
    inner = "".join(
        f", count(*) FILTER (event_type = '{t}') AS n_evt_{t},"
        f" count(DISTINCT sample) FILTER (event_type = '{t}') AS n_samp_{t}" for t in _TYPES
    )
    return f"""SELECT v.*, coalesce(e.n, 0) AS n_evt_all, coalesce(e.s, 0) AS n_samp_all,
  coalesce(m.mx, 0) AS max_junc_per_sample, coalesce(m.md, 0) AS median_junc_per_sample,
  round(coalesce(least(greatest(g.g, 0), 1), 0), 6) AS gini_junc, coalesce(e.d, 0) AS event_type_diversity,
  round(coalesce(e.f, 0), 6) AS "frac_TRA"{kinds}
FROM {intervals} v
LEFT JOIN (SELECT chrom, start_bp, end_bp, count(*) AS n, count(DISTINCT sample) AS s, count(DISTINCT event_type) AS d,
    avg(CAST(contains(event_type, '{pattern}') AS INTEGER)) AS f{inner} FROM pt GROUP BY ALL) e
  ON e.chrom = v.chrom AND e.start_bp = v.start_bp AND e.end_bp = v.end_bp
LEFT JOIN (SELECT chrom, start_bp, end_bp, max(x) AS mx, CAST(median(x) AS DOUBLE) AS md FROM ps GROUP BY ALL) m
  ON m.chrom = v.chrom AND m.start_bp = v.start_bp AND m.end_bp = v.end_bp
LEFT JOIN gi g ON g.chrom = v.chrom AND g.start_bp = v.start_bp AND g.end_bp = v.end_bp"""


@query("J9_attach_event_stats", _SAMPLES_SQL + stats_sql("iv", "ic"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    inside = stage_table(groups(spark, sf), "events_inside")
    out = an.attach_event_stats(spans(spark, sf), inside, pattern="ic")
    return out.withColumns({c: F.round(c, 6) for c in ("gini_junc", "frac_TRA")})


# --- segments -------------------------------------------------------------------

_NLL_SQL = cte("seg") + """, ll AS (SELECT seg_id, sum(lam * kb - y * ln(lam)) AS nll, sum(kb) AS kb,
  avg(y - lam * kb) AS residual, sum(y) AS y, sum(lam * kb) AS mu FROM seg GROUP BY 1),
iq AS (SELECT quantile_cont(residual, CAST(0.75 AS DOUBLE)) - quantile_cont(residual, CAST(0.25 AS DOUBLE)) AS iqr,
  median(residual) AS med FROM ll),
md AS (SELECT CAST(1.4826 AS DOUBLE) * median(abs(residual - (SELECT med FROM iq))) AS mad FROM ll),
hw AS (SELECT *, CASE WHEN abs(residual) <= (SELECT iqr FROM iq) THEN 1
  ELSE (SELECT iqr FROM iq) / (abs(residual) + 1e-9) END AS w FROM ll)
"""


def rows(spark: SparkSession, sf: str) -> DataFrame:
    return segment_rows(spark, sf)


def _one(spark: SparkSession, value: float, name: str) -> DataFrame:
    return spark.range(1).select(F.round(F.lit(float(value)), 6).alias(name))


@query("A7_segment_nll", _NLL_SQL + "SELECT seg_id, round(nll, 6) AS nll, round(kb, 6) AS kb FROM ll")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rb.segment_nll(rows(spark, sf)).select("seg_id", F.round("nll", 6).alias("nll"), F.round("kb", 6).alias("kb"))


@query("A7_mean_nll", _NLL_SQL + "SELECT round(avg(nll), 6) AS nll FROM ll")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rb.mean_nll(rows(spark, sf)).select(F.round("nll", 6).alias("nll"))


@query(
    "A8_weighted_nll",
    _NLL_SQL + "SELECT round(sum(coalesce(h.w, 1) * l.nll / l.kb * 30) / sum(coalesce(h.w, 1)), 6) AS loss "
    "FROM ll l LEFT JOIN (SELECT * FROM hw WHERE residual < 0) h ON h.seg_id = l.seg_id",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    segs = rows(spark, sf)
    weights = rb.huber_weights(rb.segment_residual(segs), factor=1.0).where(F.col("residual") < 0)
    return rb.weighted_nll(segs, weights).select(F.round("loss", 6).alias("loss"))


@query(
    "J10_lookup_weights",
    _NLL_SQL + "SELECT l.seg_id, round(coalesce(h.w, 1), 6) AS w FROM ll l LEFT JOIN "
    "(SELECT * FROM hw WHERE residual < 0) h ON h.seg_id = l.seg_id",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    residuals = rb.segment_residual(rows(spark, sf))
    known = rb.huber_weights(residuals, factor=1.0).where(F.col("residual") < 0)
    return rb.lookup_weights(residuals.select("seg_id"), known).withColumn("w", F.round("w", 6))


@query("A9_segment_residual", _NLL_SQL + "SELECT seg_id, round(residual, 6) AS residual FROM ll")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rb.segment_residual(rows(spark, sf)).withColumn("residual", F.round("residual", 6))


@query("A10_mad_scale", _NLL_SQL + "SELECT round(mad, 6) AS mad FROM md")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _one(spark, rb.mad_scale(rb.segment_residual(rows(spark, sf)), "residual"), "mad")


@query("A11_iqr_scale", _NLL_SQL + "SELECT round(iqr, 6) AS iqr FROM iq")
def _(spark: SparkSession, sf: str) -> DataFrame:
    # the blockwise route, as for more values than one task should hold
    return _one(spark, rb.iqr_scale(rb.segment_residual(rows(spark, sf)), "residual", rows_per_block=50), "iqr")


@query("A12_huber_weights", _NLL_SQL + "SELECT seg_id, round(residual, 6) AS residual, round(w, 6) AS w FROM hw")
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = rb.huber_weights(rb.segment_residual(rows(spark, sf)), factor=1.0)
    return out.select("seg_id", F.round("residual", 6).alias("residual"), F.round("w", 6).alias("w"))


@query(
    "A13_calibrate_scale",
    _NLL_SQL + """, c AS (SELECT seg_id, y, mu, CASE WHEN abs(residual) <= (SELECT iqr FROM iq) THEN 1
  ELSE (SELECT iqr FROM iq) / (abs(residual) + 1e-8) END AS w FROM ll)
SELECT round(sum(w * y) / sum(w * mu / 2), 6) AS c_new, round(sum(w * y), 5) AS num, round(sum(w * mu / 2), 5) AS den FROM c""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = rb.calibrate_scale(rows(spark, sf), c=2.0, factor=1.0)
    return out.select(
        F.round("c_new", 6).alias("c_new"), F.round("num", 5).alias("num"), F.round("den", 5).alias("den")
    )


@query(
    "A14_robust_objective",
    _NLL_SQL + """, h AS (SELECT *, CASE WHEN abs(residual) <= 3 * (SELECT mad FROM md) THEN 1
  ELSE 3 * (SELECT mad FROM md) / (abs(residual) + 1e-9) END AS v FROM ll)
SELECT round(sum(v * nll / kb * 30) / sum(v), 6) AS objective FROM h""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rb.robust_objective(rows(spark, sf), use_mad=True).select(F.round("objective", 6).alias("objective"))
