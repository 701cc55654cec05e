"""Scanning, selecting and correcting for many tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspan.functions.numeric import length_kb
from hotspan.operators import fdr as fd
from hotspan.operators.scan import (
    POSITIVE,
    per_bin,
    prefix_sums,
    sample_scores,
    scan_pairs,
    scan_partitions,
    scan_summary,
    selection_summary,
)
from hotspan.operators.select import islands, predecessor, select_intervals
from hotspan.plans.hotspots import HotspotConfig, with_scores
from hotspan.session import stage_table
from hotspan.workload.fields import MIXTURE, tail_sql
from hotspan.workload.grids import _md5_unit, md5_unit_sql
from hotspan.workload.registry import query
from hotspan.workload.tables import DAY, HOUR, cte, grid, rated, segment_rows, spans, table, typed_events

CFG = HotspotConfig(max_bp=DAY, mixture=MIXTURE)


def bins(spark: SparkSession, sf: str) -> DataFrame:
    return stage_table(rated(spark, sf), "rated")


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    base = bins(spark, sf)
    pairs = scan_pairs(base, DAY, partitions=scan_partitions(base, DAY))
    return pairs.where(F.col("LLR_raw") > POSITIVE)


@query(
    "A1_per_bin",
    cte("seg") + """, p AS (SELECT * FROM seg UNION ALL SELECT chrom, start, "end", seg_id, off, y, kb, lam * 3 FROM seg)
SELECT chrom, start, "end", round(avg(lam), 6) AS lam_pred, max(y) AS obs_count FROM p GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    once = segment_rows(spark, sf).select(
        "chrom", "start", "end", F.col("lam").alias("lam_pred"), F.col("y").alias("obs_count")
    )
    twice = once.withColumn("lam_pred", F.explode(F.array("lam_pred", F.col("lam_pred") * 3)))
    return per_bin(twice).withColumn("lam_pred", F.round("lam_pred", 6))


@query(
    "A6_prefix_sums",
    cte("psum") + "SELECT chrom, start, co AS cum_obs, round(cm, 6) AS cum_exp, co - obs AS pre_obs, "
    "round(cm - lam * kb, 6) AS pre_exp FROM psum",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    # blocks of a day: sums cross many borders
    out = prefix_sums(rated(spark, sf), block_bp=DAY)
    return out.select(
        "chrom", "start", "cum_obs", F.round("cum_exp", 6).alias("cum_exp"), "pre_obs",
        F.round("pre_exp", 6).alias("pre_exp"),
    )


_CAND_COLS = "chrom, start_bp, end_bp, len_bp, y AS obs, round(e, 6) AS exp, round(llr, 6) AS \"LLR_raw\""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        "chrom", "start_bp", "end_bp", "len_bp", "obs", F.round("exp", 6).alias("exp"),
        F.round("LLR_raw", 6).alias("LLR_raw"),
    )


@query("J4_scan_pairs", cte("cand") + f"SELECT {_CAND_COLS} FROM cand")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(candidates(spark, sf))


@query(
    "J4_scan_pairs_tiled",
    cte("cand") + f""", f AS (SELECT chrom, min(start) AS lo FROM grid GROUP BY 1),
t AS (SELECT cand.*, (start_bp + 3599 - lo) // 90000 AS khi,
    greatest(CAST(ceil((end_bp - 3599 - lo - 99999) / CAST(90000 AS DOUBLE)) AS BIGINT), 0) AS klo
  FROM cand JOIN f ON f.chrom = cand.chrom)
SELECT {_CAND_COLS} FROM t WHERE khi >= klo""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles that overlap by less than the span: some pairs share no tile."""
    return _rounded(scan_pairs(bins(spark, sf), DAY, tiles=(100_000, 10_000)).where(F.col("LLR_raw") > POSITIVE))


@query("S18_filter_lengths", cte("cand") + f"SELECT {_CAND_COLS} FROM cand WHERE len_bp >= 14400 AND end_bp - start_bp <= 43200")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(scan_pairs(bins(spark, sf), DAY // 2, 4 * HOUR).where(F.col("LLR_raw") > POSITIVE))


@query(
    "A22_scan_summary",
    cte("psum") + """, p AS (SELECT a.chrom, b.co - a.co + a.obs AS y, b.cm - a.cm + a.lam * a.kb AS e
  FROM psum a JOIN psum b ON a.chrom = b.chrom AND a.start <= b.start AND b."end" - a.start <= 86400),
l AS (SELECT chrom, CASE WHEN y > e THEN y * ln((y + 1) / (e + 1)) + (1 - (y + 1) / (e + 1)) * e END AS llr FROM p)
SELECT chrom, count(*) FILTER (llr > 1e-6) AS n_pos, count(*) - count(*) FILTER (llr > 1e-6) AS n_zero FROM l GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return scan_summary(scan_pairs(bins(spark, sf), DAY, keep_all=True)).select("chrom", "n_pos", "n_zero")


@query(
    "N13_sample_scores",
    cte("cand") + f"""SELECT round(llr / sqrt(len_bp / CAST(1000 AS DOUBLE)), 6) AS score FROM cand
  WHERE {md5_unit_sql("chrom || ':' || start_bp || ':' || end_bp")} < CAST(0.05 AS DOUBLE)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = _md5_unit(F.concat_ws(":", "chrom", F.col("start_bp").cast("string"), F.col("end_bp").cast("string")))
    return sample_scores(candidates(spark, sf), 0.05, key=key).select(F.round("score", 6).alias("score"))


@query(
    "S14_scored_candidates",
    cte("cand") + f""", n AS (SELECT *, len_bp / CAST(1000 AS DOUBLE) AS kb, llr / sqrt(len_bp / CAST(1000 AS DOUBLE)) AS norm FROM cand),
p AS (SELECT *, {tail_sql('norm')} AS lp FROM n)
SELECT chrom, start_bp, end_bp, round(exp(lp), 5) AS p_val, round(-lp / ln(10), 5) AS neglog10_p,
  round(llr * -lp / ln(10), 4) AS "LLR_weighted" FROM p""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    scored = with_scores(candidates(spark, sf), MIXTURE, CFG)
    return scored.select(
        "chrom", "start_bp", "end_bp", F.round("p_val", 5).alias("p_val"),
        F.round("neglog10_p", 5).alias("neglog10_p"), F.round("LLR_weighted", 4).alias("LLR_weighted"),
    )


# Weights that are exact in binary, so that ties are ties in every engine.
def tied_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).withColumn("LLR_weighted", F.ceil(F.col("LLR_raw") * 64) / 64.0)


# The plain walk as a recursion over the hours of each sequence: ``best[h]`` is
# the best weight of hours before h, ``took[h]`` the start of the interval that
# last improved it (0 if none) and is found again when walking back.
SELECT_SQL = """, wt AS (
  SELECT c.chrom, (start_bp - lo) // 3600 AS i, (end_bp + 1 - lo) // 3600 AS j, {weight} AS w
  FROM cand c JOIN (SELECT chrom, min(start) AS lo FROM grid GROUP BY 1) f ON f.chrom = c.chrom),
ends AS (SELECT chrom, j, list(i ORDER BY i) AS i, list(w ORDER BY i) AS w FROM wt GROUP BY ALL),
hours AS (SELECT chrom, unnest(range(1, count(*) + 1)) AS j FROM grid GROUP BY chrom),
steps AS (SELECT h.chrom, h.j, coalesce(e.i, []) AS i, coalesce(e.w, []) AS w
  FROM hours h LEFT JOIN ends e ON e.chrom = h.chrom AND e.j = h.j),
walk AS (
  SELECT DISTINCT chrom, CAST(0 AS BIGINT) AS j, [CAST(0 AS DOUBLE)] AS best, [CAST(-1 AS BIGINT)] AS took FROM steps
  UNION ALL
  SELECT chrom, j, list_append(best, greatest(best[-1], coalesce(top, 0))),
    list_append(took, CASE WHEN top > best[-1] THEN i[list_position(total, top)] ELSE -1 END)
  FROM (SELECT *, list_max(total) AS top FROM (
    SELECT s.chrom, s.j, k.best, k.took, s.i,
      list_transform(s.i, lambda x, n: s.w[n] + k.best[x + 1]) AS total
    FROM walk k JOIN steps s ON s.chrom = k.chrom AND s.j = k.j + 1))),
done AS (SELECT w.chrom, w.took, w.j FROM walk w JOIN (SELECT chrom, count(*) AS n FROM grid GROUP BY 1) g
  ON g.chrom = w.chrom AND g.n = w.j),
back AS (
  SELECT chrom, took, j AS pos, CAST(-1 AS BIGINT) AS s, CAST(-1 AS BIGINT) AS e FROM done
  UNION ALL
  SELECT chrom, took, CASE WHEN took[pos + 1] >= 0 THEN took[pos + 1] ELSE pos - 1 END,
    CASE WHEN took[pos + 1] >= 0 THEN took[pos + 1] ELSE -1 END, CASE WHEN took[pos + 1] >= 0 THEN pos ELSE -1 END
  FROM back WHERE pos > 0),
sel AS (SELECT b.chrom, lo + s * 3600 AS start_bp, lo + e * 3600 - 1 AS end_bp FROM back b
  JOIN (SELECT chrom, min(start) AS lo FROM grid GROUP BY 1) f ON f.chrom = b.chrom WHERE s >= 0)
"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "N6_select_intervals",
    recursive(cte("cand")) + SELECT_SQL.format(weight="ceil(llr * 64) / CAST(64 AS DOUBLE)")
    + 'SELECT s.chrom, s.start_bp, s.end_bp, ceil(c.llr * 64) / CAST(64 AS DOUBLE) AS weight, round(c.llr, 6) AS "LLR_raw"'
    " FROM sel s JOIN cand c ON c.chrom = s.chrom AND c.start_bp = s.start_bp AND c.end_bp = s.end_bp",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return select_intervals(
        tied_intervals(spark, sf), max_span=DAY, carry=["LLR_raw"], bucket=("bucket", DAY + 1)
    ).withColumn("LLR_raw", F.round("LLR_raw", 6))


@query(
    "A22_selection_summary",
    recursive(cte("cand")) + SELECT_SQL.format(weight="ceil(llr * 64) / CAST(64 AS DOUBLE)")
    + "SELECT c.chrom, c.n AS n_candidates, coalesce(s.n, 0) AS n_selected FROM (SELECT chrom, count(*) AS n FROM cand GROUP BY 1) c"
    " LEFT JOIN (SELECT chrom, count(*) AS n FROM sel GROUP BY 1) s ON s.chrom = c.chrom",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pairs = tied_intervals(spark, sf)
    chosen = select_intervals(pairs, max_span=DAY, bucket=("bucket", DAY + 1))
    return selection_summary(pairs, chosen)


# Intervals of order lines: a supplier group, start by ship day, length by quantity.
def line_intervals(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint")
    start = day * 1000 + F.col("l_partkey") % 1000
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("chr"), F.col("l_suppkey")).alias("chrom"),
        start.alias("start_bp"), (start + F.col("l_quantity").cast("bigint") * 40).alias("end_bp"),
    )


_LINES_SQL = """WITH li AS (
  SELECT l_orderkey, l_linenumber, 'chr' || l_suppkey AS chrom,
         date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 1000 + l_partkey % 1000 AS start_bp,
         date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) * 1000 + l_partkey % 1000
           + CAST(l_quantity AS BIGINT) * 40 AS end_bp FROM lineitem)
"""


@query(
    "N7_islands",
    _LINES_SQL + """, m AS (SELECT *, max(end_bp) OVER (PARTITION BY chrom ORDER BY start_bp, end_bp
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM li),
n AS (SELECT *, CASE WHEN far + 500 < start_bp THEN 1 ELSE 0 END AS opens FROM m)
SELECT l_orderkey, l_linenumber, chrom, start_bp, end_bp, CAST(sum(opens) OVER (PARTITION BY chrom
  ORDER BY start_bp, end_bp ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM n""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = islands(line_intervals(spark, sf), gap_bp=500, block_bp=100_000)
    return out.select("l_orderkey", "l_linenumber", "chrom", "start_bp", "end_bp", "island")


@query(
    "J8_predecessor",
    _LINES_SQL + """, u AS (
  SELECT chrom, end_bp + 201 AS pos, 0 AS kind, start_bp AS s, end_bp AS e, NULL AS k, NULL AS n FROM li
  UNION ALL SELECT chrom, start_bp, 1, NULL, NULL, l_orderkey, l_linenumber FROM li),
w AS (SELECT *, max(CASE WHEN kind = 0 THEN {'e': e, 's': s} END) OVER (PARTITION BY chrom ORDER BY pos, kind
  ROWS UNBOUNDED PRECEDING) AS p FROM u)
SELECT k AS l_orderkey, n AS l_linenumber, chrom, pos AS start_bp, p.s AS pred_start, p.e AS pred_end FROM w WHERE kind = 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = predecessor(line_intervals(spark, sf), gap_bp=200, block_bp=100_000)
    return out.select("l_orderkey", "l_linenumber", "chrom", "start_bp", "pred_start", "pred_end")


# --- p-values ------------------------------------------------------------------

def p_values(spark: SparkSession, sf: str) -> DataFrame:
    """One p per order line; ties are common, p = 1 most of all, and some are missing."""
    p = F.least(F.col("l_extendedprice") * F.col("l_discount") * F.col("l_linenumber") / 20_000.0, F.lit(1.0))
    kind = F.col("l_orderkey") % 97
    p = F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit(float("nan"))).otherwise(p)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", p.alias("p"))


_P_SQL = """WITH pv AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 < 2 THEN 1
    ELSE least(l_extendedprice * l_discount * l_linenumber / CAST(20000 AS DOUBLE), 1) END AS p FROM lineitem),
c AS (SELECT p, count(*) AS n FROM pv GROUP BY 1),
k AS (SELECT p, n, sum(n) OVER (ORDER BY p) AS upto, sum(n) OVER () AS m FROM c),
q AS (SELECT p, n, upto, m, min(m * p / upto) OVER (ORDER BY p DESC) AS q FROM k)
"""


@query(
    "N8_bh_qvalues",
    _P_SQL + "SELECT l_orderkey, l_linenumber, round(pv.p, 9) AS p, round(least(q, 1), 9) AS q FROM pv JOIN q ON q.p = pv.p",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fd.bh_qvalues(p_values(spark, sf)).select(
        "l_orderkey", "l_linenumber", F.round(fd.clean_p("p"), 9).alias("p"), F.round("q", 9).alias("q")
    )


@query(
    "N9_storey_qvalues",
    _P_SQL + "SELECT l_orderkey, l_linenumber, round(pv.p, 9) AS p, round(least(q * CAST(0.4 AS DOUBLE), 1), 12) AS q "
    "FROM pv JOIN q ON q.p = pv.p",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fd.storey_qvalues(p_values(spark, sf), 0.4).select(
        "l_orderkey", "l_linenumber", F.round(fd.clean_p("p"), 9).alias("p"), F.round("q", 12).alias("q")
    )


_GRID_SQL = _P_SQL + """, g AS (SELECT CAST(0.05 AS DOUBLE) + i * CAST(0.01 AS DOUBLE) AS lam FROM range(91) t(i)),
z AS (SELECT lam, least(greatest((SELECT sum(n) FROM c WHERE c.p > lam) / (SELECT sum(n) FROM c)
    / greatest(1 - lam, 1e-12), CAST(0.01 AS DOUBLE)), 1) AS pi0 FROM g)
"""


@query("N10_pi0_grid", _GRID_SQL + 'SELECT round(lam, 6) AS "lambda", round(coalesce(pi0, 0.01), 6) AS pi0 FROM z')
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fd.pi0_grid(p_values(spark, sf)).select(
        F.round("lambda", 6).alias("lambda"), F.round("pi0", 6).alias("pi0")
    )


_CLOSED_SQL = _GRID_SQL + """, a AS (SELECT lam, pi0, (SELECT sum(n) FROM c WHERE c.p > lam) / (SELECT sum(n) FROM c) AS f,
    (SELECT sum(n) FROM c) AS m, (SELECT min(pi0) FROM z) AS least_pi0 FROM z),
e AS (SELECT lam, pi0, f * (1 - f) / m / pow(1 - lam, 2) + pow(f / (1 - lam) - least_pi0, 2) AS mse FROM a)
"""


@query("N11_pi0_closed_form", _CLOSED_SQL + 'SELECT round(lam, 6) AS "lambda", round(pi0, 6) AS pi0, round(mse, 9) AS mse FROM e')
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fd.pi0_mse(p_values(spark, sf), closed_form=True).select(
        F.round("lambda", 6).alias("lambda"), F.round("pi0", 6).alias("pi0"), F.round("mse", 9).alias("mse")
    )


# The resamples of N11: a cell's draws are a binomial share of those left, from
# the last cell down, by inverse distribution from md5 numbers.
_DRAWN_SQL = recursive(_GRID_SQL) + """, gi AS (SELECT CAST(row_number() OVER (ORDER BY lam) AS INTEGER) AS i, lam, pi0 FROM z),
hist AS (SELECT (SELECT count(*) FROM gi WHERE lam < c.p) AS i, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1),
cells AS (SELECT t.i, coalesce(hist.n, 0) AS n, CAST(sum(coalesce(hist.n, 0)) OVER (ORDER BY t.i) AS BIGINT) AS upto
  FROM range(92) t(i) LEFT JOIN hist ON hist.i = t.i),
chain AS (
  SELECT b, CAST(92 AS BIGINT) AS i, (SELECT max(upto) FROM cells) AS rest FROM range(200) t(b)
  UNION ALL
  SELECT b, i, CAST(rest - (any_value(low) + count(*) FILTER (cum < u * total)) AS BIGINT) AS rest FROM (
    SELECT *, sum(term) OVER (PARTITION BY b ORDER BY k) AS cum, sum(term) OVER (PARTITION BY b) AS total FROM (
      SELECT *, CASE WHEN low = high THEN 1 ELSE exp(lgamma(rest + 1) - lgamma(k + 1) - lgamma(rest - k + 1)
        + k * ln(share) + (rest - k) * ln(1 - share)) END AS term FROM (
        SELECT *, unnest(range(low, high + 1)) AS k FROM (
          SELECT *, CASE WHEN rest = 0 OR share <= 0 THEN 0 WHEN share >= 1 THEN rest
              ELSE CAST(greatest(0, floor(rest * share - reach)) AS BIGINT) END AS low,
            CASE WHEN rest = 0 OR share <= 0 THEN 0 WHEN share >= 1 THEN rest
              ELSE CAST(least(rest, ceil(rest * share + reach)) AS BIGINT) END AS high FROM (
            SELECT *, CAST(10 AS DOUBLE) * sqrt(rest * share * (1 - share)) + 30 AS reach FROM (
              SELECT chain.b, cells.i, chain.rest,
                CASE WHEN cells.upto = 0 THEN CAST(0 AS DOUBLE) ELSE cells.n / CAST(cells.upto AS DOUBLE) END AS share,
                CAST('0x' || substr(md5('7:' || chain.b || ':' || cells.i), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
              FROM chain JOIN cells ON cells.i = chain.i - 1 WHERE chain.i > 1))))))
  GROUP BY b, i, rest),
err AS (SELECT gi.lam, gi.pi0, avg(pow(least(greatest((m - rest) / CAST(m AS DOUBLE) / greatest(1 - lam, 1e-12), CAST(0.01 AS DOUBLE)), 1)
    - (SELECT min(pi0) FROM z), 2)) AS mse
  FROM chain JOIN gi USING (i), (SELECT max(upto) AS m FROM cells) GROUP BY 1, 2),
best AS (SELECT lam, pi0 FROM err ORDER BY round(mse, 14), lam LIMIT 1)
"""


@query("N11_pi0_bootstrap", _DRAWN_SQL + 'SELECT round(lam, 6) AS "lambda", round(pi0, 9) AS pi0 FROM best')
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fd.pi0_bootstrap(p_values(spark, sf), replicates=200, seed=7).select(
        F.round("lambda", 6).alias("lambda"), F.round("pi0", 9).alias("pi0"))


@query("N11_pi0_resampled", _DRAWN_SQL + 'SELECT round(lam, 6) AS "lambda", round(pi0, 9) AS pi0, round(mse, 9) AS mse FROM err')
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The error of every grid point over the resamples."""
    return fd.pi0_mse(p_values(spark, sf), replicates=200, seed=7).select(
        F.round("lambda", 6).alias("lambda"), F.round("pi0", 9).alias("pi0"), F.round("mse", 9).alias("mse"))


@query(
    "N12_fdr",
    _CLOSED_SQL + ", b AS (SELECT pi0 FROM e ORDER BY mse, lam LIMIT 1) "
    "SELECT l_orderkey, l_linenumber, round(pv.p, 9) AS p, round(least(q * (SELECT pi0 FROM b), 1), 7) AS fdr FROM pv JOIN q ON q.p = pv.p",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    p = p_values(spark, sf)
    pi0 = fd.pi0_bootstrap(p, closed_form=True).first()["pi0"]
    return fd.fdr(p, "storey", pi0=pi0).select(
        "l_orderkey", "l_linenumber", F.round(fd.clean_p("p"), 9).alias("p"), F.round("fdr", 7).alias("fdr")
    )


@query(
    "N12_fdr_bootstrap",
    _DRAWN_SQL + "SELECT l_orderkey, l_linenumber, round(pv.p, 9) AS p, "
    "round(least(q * (SELECT pi0 FROM best), 1), 7) AS fdr FROM pv JOIN q ON q.p = pv.p",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fd.fdr(p_values(spark, sf), "storey", replicates=200, seed=7).select(
        "l_orderkey", "l_linenumber", F.round(fd.clean_p("p"), 9).alias("p"), F.round("fdr", 7).alias("fdr"))


@query(
    "N17_qq_table",
    _P_SQL + """, r AS (SELECT row_number() OVER (ORDER BY p) AS rank, count(*) OVER () AS m, p FROM pv)
SELECT rank, round(-log10((rank - CAST(0.5 AS DOUBLE)) / m), 6) AS expected, round(-log10(greatest(p, 1e-300)), 6) AS observed FROM r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return fd.qq_table(p_values(spark, sf)).select(
        "rank", F.round("expected", 6).alias("expected"), F.round("observed", 6).alias("observed")
    )


@query(
    "N17_qq_table_thinned",
    _P_SQL + """, r AS (SELECT row_number() OVER (ORDER BY p) AS rank, count(*) OVER () AS m, p FROM pv),
kept AS (SELECT DISTINCT CAST(ceil(pow(CAST(10 AS DOUBLE), i / CAST(20 AS DOUBLE)) - 1e-9) AS BIGINT) AS rank FROM range(0, 200) t(i))
SELECT rank, round(-log10((rank - CAST(0.5 AS DOUBLE)) / m), 6) AS expected, round(-log10(greatest(p, 1e-300)), 6) AS observed
FROM r WHERE rank = m OR rank IN (SELECT rank FROM kept)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Twenty points a decade, as many as a plot can show."""
    return fd.qq_table(p_values(spark, sf), per_decade=20).select(
        "rank", F.round("expected", 6).alias("expected"), F.round("observed", 6).alias("observed")
    )
