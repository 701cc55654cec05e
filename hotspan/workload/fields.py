"""Readers, writers and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspan import functions as fn
from hotspan.functions.names import chrom_sort_key, norm_chrom
from hotspan.functions.numeric import (
    interval_length,
    length_kb,
    point_position,
    sanitize_count,
    sanitize_rate,
    to_int_strict,
)
from hotspan.functions.tail import Mixture
from hotspan.operators.columns import (
    MIN_HIT_RATE,
    guess_sample_column,
    profile_text_columns,
    resolve_columns,
)
from hotspan.operators.quality import canonical_only, canonical_report, finite_report, first_nonfinite
from hotspan.plans.hotspots import HotspotConfig, run_hotspots
from hotspan.session import stage_path
from hotspan.sources import readers, writers
from hotspan.workload.registry import query
from hotspan.workload.tables import DAY, cte, rated, table, typed_events

def _spelled() -> Column:
    """Three spellings of each sequence name, by event."""
    kind = F.col("event_id") % 3
    return (
        F.when(kind == 0, F.substring("chrom", 4, 9)).when(kind == 1, F.upper("chrom"))
        .otherwise(F.concat(F.lit(" "), "chrom", F.lit(" ")))
    )


_CANON_SQL = (
    "chrom IN (" + ", ".join(f"'{c}'" for c in fn.CANONICAL) + ")"
)


@query("R1_read_points", cte("ok") + f"SELECT chrom, pos + 5 AS pos, sample FROM ok WHERE {_CANON_SQL}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "points_csv")
    typed_events(spark, sf).select(
        _spelled().alias("Chromosome"), F.col("pos").alias("Start"), (F.col("pos") + 11).alias("End"),
        F.col("sample").alias("Donor"), F.col("filter").alias("FILTER"),
    ).write.csv(path, header=True)
    return readers.read_points(spark, path)


@query(
    "R2_read_typed_points",
    cte("ev") + "SELECT chrom, pos, CASE event_type WHEN 'error' THEN 'bad' ELSE event_type END AS event_type,"
    " sample FROM ev",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "points_tsv")
    typed_events(spark, sf).select(
        F.col("chrom").alias("seqnames"), F.col("pos").alias("bp"),
        F.concat(F.upper("event_type"), F.lit(";extra")).alias("svType"), F.col("sample").alias("Tumour"),
        F.lit(".").alias("filter"),
    ).write.csv(path, header=True, sep="\t")
    return readers.read_typed_points(spark, path, aliases={"error": "bad"})


@query(
    "R3_resolve_columns",
    cte("ev") + 'SELECT chrom, pos AS start, pos AS "end", event_type, sample, filter FROM ev',
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    odd = typed_events(spark, sf).select(
        F.col("chrom").alias("SeqNames"), F.col("pos").alias("POS"), F.col("event_type").alias("SvClass"),
        F.col("sample").alias("Donor_ID"), F.col("filter").alias("Filter"),
    )
    return resolve_columns(odd, typed=True)


@query(
    "R4_guess_sample_column",
    """WITH t AS (
  SELECT 'run_' || user_id || CASE WHEN value > 30 THEN '.vcf' ELSE '.txt' END AS origin,
         event_type AS kind, props AS note FROM events),
p AS (
  SELECT 'origin' AS "column", origin AS v FROM t UNION ALL SELECT 'kind', kind FROM t
  UNION ALL SELECT 'note', note FROM t),
r AS (
  SELECT "column", avg(CAST(regexp_matches(v, '(?i)(purple|\\.vcf|cpct|wide|obc)') AS DOUBLE)) AS hit_rate,
         count(DISTINCT v) AS n_distinct FROM p GROUP BY 1)
SELECT "column", round(hit_rate, 6) AS hit_rate, n_distinct,
       hit_rate > CAST(0.2 AS DOUBLE) AS sample_like, "column" = 'origin' AS chosen FROM r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = table(spark, sf, "events").select(
        F.concat(F.lit("run_"), "user_id", F.when(F.col("value") > 30, ".vcf").otherwise(".txt")).alias("origin"),
        F.col("event_type").alias("kind"), F.col("props").alias("note"),
    )
    return profile_text_columns(texts).select(
        "column", F.round("hit_rate", 6).alias("hit_rate"), "n_distinct",
        (F.col("hit_rate") > MIN_HIT_RATE).alias("sample_like"),
        (F.col("column") == guess_sample_column(texts)).alias("chosen"),
    )


_PRED_SQL = cte("rated") + """SELECT chrom, start, "end", round(lam, 6) AS lam_pred, obs AS obs_count,
  round(obs * ln(greatest(lam, 1e-9)) - lam * kb, 6) AS bin_loglike FROM rated"""


def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return rated(spark, sf).select(
        "chrom", "start", "end", F.col("lam").alias("lam_pred"), F.col("obs").alias("obs_count"),
        fn.bin_loglike("obs", "lam", "kb").alias("bin_loglike"),
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in ("lam_pred", "bin_loglike")})


@query("R5_read_predictions", _PRED_SQL)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "predictions.csv")
    _predictions(spark, sf).write.csv(path, header=True)
    return _rounded(readers.read_predictions(spark, path))


def embedding_bins(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("chr"), F.col("label") + 1).alias("chrom"), F.col("vec_id").alias("w_idx"),
        (F.col("vec_id") * 1000).alias("start"), (F.col("vec_id") * 1000 + 999).alias("end"),
        F.col("embedding").alias("cls"),
    )


def embedding_features(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the bins whose first component is positive."""
    bins = embedding_bins(spark, sf)
    return bins.where(F.element_at("cls", 1) > 0).select("chrom", "w_idx", F.reverse("cls").alias("feat"))


@query(
    "R6_read_bins_features",
    """SELECT 'chr' || (label + 1) AS chrom, vec_id AS w_idx, vec_id * 1000 AS start, vec_id * 1000 + 999 AS "end",
  round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total,
  CASE WHEN embedding[1] > 0 THEN CAST(round(CAST(embedding[64] AS DOUBLE), 6) AS DOUBLE) END AS first_feat
  FROM embeddings""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    base = stage_path(spark, "inputs")
    embedding_bins(spark, sf).write.parquet(f"{base}/bins")
    embedding_features(spark, sf).write.parquet(f"{base}/features")
    bins, features = readers.read_bins_features(spark, f"{base}/bins", f"{base}/features")
    total = F.aggregate("cls", F.lit(0.0), lambda a, x: a + x)
    return bins.join(features, ["chrom", "w_idx"], "left").select(
        "chrom", "w_idx", "start", "end", F.round(total, 6).alias("total"),
        F.round(F.element_at("feat", 1).cast("double"), 6).alias("first_feat"),
    )


@query(
    "W1_write_predictions",
    cte("rated") + """SELECT chrom, start, "end", round(lam, 6) AS lam_pred, obs AS obs_count,
  round(obs * ln(greatest(lam, 1e-9)) - lam * kb, 6) AS bin_loglike, s AS split FROM rated,
  LATERAL (SELECT unnest([CASE WHEN start % 864000 < 777600 THEN 'train' ELSE 'val' END, 'all']) AS s)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "split_predictions")
    part = F.when(F.col("start") % (10 * DAY) < 9 * DAY, "train").otherwise("val")
    rows = _predictions(spark, sf).withColumn("split", F.explode(F.array(part, F.lit("all"))))
    writers.write_predictions(rows, path)
    return _rounded(spark.read.parquet(path)).select(*rows.columns)


@query("W2_write_stage_tables", cte("rated") + 'SELECT chrom, start, "end", round(lam, 6) AS lam_pred, obs AS obs_count FROM rated')
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = stage_path(spark, "stage.csv")
    writers.write_stage(
        _predictions(spark, sf).drop("bin_loglike"), path, "csv", order=["chrom", "start"]
    )
    return readers.read_predictions(spark, path).withColumn("lam_pred", F.round("lam_pred", 6))


@query(
    "W3_empty_result",
    """SELECT CAST('' AS VARCHAR) AS chrom, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS "end",
  CAST(0 AS BIGINT) AS len_bp, CAST(0 AS DOUBLE) AS "LLR_raw", CAST(0 AS DOUBLE) AS obs_sum,
  CAST(0 AS DOUBLE) AS exp_sum, CAST(0 AS DOUBLE) AS p_post, CAST(0 AS DOUBLE) AS fdr_post,
  CAST(0 AS DOUBLE) AS fdr FROM events WHERE false""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job on rates so high that no interval has an excess."""
    calm = _predictions(spark, sf).withColumn("lam_pred", F.col("lam_pred") * 1e6)
    cfg = HotspotConfig(max_bp=DAY, mixture=Mixture((1.0,), (0.0,), (0.5,)), fdr_method="bh")
    return run_hotspots(calm, None, cfg).select(*writers.empty_result(spark).columns)


def _dirty(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_id") % 7
    return table(spark, sf, "events").select(
        "event_id",
        F.when(kind == 1, F.lit(float("nan"))).when(kind == 2, F.lit(float("inf")))
        .when(kind == 3, F.lit(float("-inf"))).when(kind == 4, F.lit(None).cast("double"))
        .when(kind == 5, -F.col("value")).otherwise(F.col("value")).alias("x"),
    )


_DIRTY_SQL = """WITH d AS (
  SELECT event_id, CASE event_id % 7 WHEN 1 THEN CAST('nan' AS DOUBLE) WHEN 2 THEN CAST('inf' AS DOUBLE)
    WHEN 3 THEN CAST('-inf' AS DOUBLE) WHEN 4 THEN NULL WHEN 5 THEN -value ELSE value END AS x FROM events),
g AS (SELECT *, CASE WHEN x IS NOT NULL AND NOT isnan(x) AND NOT isinf(x) THEN x END AS ok FROM d)
"""


@query(
    "S1_sanitize",
    _DIRTY_SQL + """SELECT event_id,
  CASE WHEN ok IS NOT NULL THEN least(greatest(ok, 1e-10), 1e8) WHEN isinf(x) AND x > 0 THEN 1e8 ELSE 1e-10 END AS rate,
  CASE WHEN ok IS NOT NULL THEN greatest(ok, 0) ELSE CAST(0 AS DOUBLE) END AS n FROM g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _dirty(spark, sf).select("event_id", sanitize_rate("x").alias("rate"), sanitize_count("x").alias("n"))


@query(
    "S2_finite_report",
    _DIRTY_SQL + """SELECT 'x' AS "column", count(*) AS n, count(*) FILTER (x IS NULL) AS n_null,
  count(*) FILTER (isnan(x)) AS n_nan, count(*) FILTER (isinf(x)) AS n_inf,
  min(ok) AS "min", max(ok) AS "max", round(avg(ok), 6) AS mean FROM g""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return finite_report(_dirty(spark, sf), ["x"]).withColumn("mean", F.round("mean", 6))


@query(
    "S2_first_nonfinite",
    _DIRTY_SQL + "SELECT event_id FROM g WHERE ok IS NULL ORDER BY event_id LIMIT 10",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return first_nonfinite(_dirty(spark, sf), "x", ["event_id"]).select("event_id")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    kind, n = F.col("event_id") % 8, F.col("user_id") % 40
    return table(spark, sf, "events").select(
        "event_id",
        F.when(kind == 0, n.cast("string")).when(kind == 1, F.concat(F.lit(" CHR"), n))
        .when(kind == 2, F.lit("chrx")).when(kind == 3, F.lit("MT ")).when(kind == 4, F.concat(F.lit("chr"), n, F.lit("_random")))
        .when(kind == 5, F.concat(F.lit("GL"), n)).when(kind == 6, F.lit("Chr_Un")).otherwise(F.lit("y")).alias("raw"),
    )


_NAMES_SQL = """WITH r AS (
  SELECT event_id, CASE event_id % 8 WHEN 0 THEN CAST(user_id % 40 AS VARCHAR) WHEN 1 THEN ' CHR' || (user_id % 40)
    WHEN 2 THEN 'chrx' WHEN 3 THEN 'MT ' WHEN 4 THEN 'chr' || (user_id % 40) || '_random'
    WHEN 5 THEN 'GL' || (user_id % 40) WHEN 6 THEN 'Chr_Un' ELSE 'y' END AS raw FROM events),
s AS (SELECT *, trim(raw) AS t, upper(regexp_extract(trim(raw), '(?i)^(?:chr)?([0-9]+|x|y|mt?)$', 1)) AS b FROM r),
n AS (SELECT event_id, raw, CASE WHEN b IN ('M', 'MT') THEN 'chrM' WHEN b <> '' THEN 'chr' || b
    WHEN lower(t) LIKE 'chr%' THEN t ELSE 'chr' || t END AS chrom FROM s)
"""


@query("S3_norm_chrom", _NAMES_SQL + "SELECT event_id, chrom FROM n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("event_id", norm_chrom("raw").alias("chrom"))


@query(
    "S4_chrom_sort_key",
    _NAMES_SQL + """, k AS (SELECT event_id, regexp_replace(lower(chrom), '^chr', '') AS c FROM n)
SELECT event_id, CASE WHEN regexp_full_match(c, '[0-9]+') THEN 0 WHEN c = 'x' THEN 1 WHEN c = 'y' THEN 2
    WHEN c IN ('m', 'mt') THEN 3 ELSE 4 END AS kind,
  coalesce(TRY_CAST(CASE WHEN regexp_full_match(c, '[0-9]+') THEN c END AS BIGINT), 0) AS number,
  CASE WHEN regexp_full_match(c, '[0-9]+') OR c IN ('x', 'y', 'm', 'mt') THEN '' ELSE c END AS "text" FROM k""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    key = chrom_sort_key(norm_chrom("raw"))
    return _names(spark, sf).select("event_id", key.alias("k")).select("event_id", "k.*")


@query("S5_canonical_only", _NAMES_SQL + f"SELECT event_id, chrom FROM n WHERE {_CANON_SQL}")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_only(_names(spark, sf).select("event_id", norm_chrom("raw").alias("chrom")))


@query(
    "S5_canonical_report",
    _NAMES_SQL + f"SELECT count(*) FILTER ({_CANON_SQL}) AS kept, count(*) FILTER (NOT ({_CANON_SQL})) AS dropped FROM n",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return canonical_report(_names(spark, sf).select(norm_chrom("raw").alias("chrom")))


_FILTERS = ("PASS", ".", "q10;pass", "LowQ", None)


@query(
    "S6_pass_filter",
    """WITH f AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'PASS' WHEN 1 THEN '.' WHEN 2 THEN 'q10;pass'
  WHEN 3 THEN 'LowQ' END AS f FROM events)
SELECT event_id, coalesce(upper(f) = '.' OR contains(upper(f), 'PASS'), false) AS keep FROM f""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    picked = F.element_at(F.array(*[F.lit(f) for f in _FILTERS]), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", fn.pass_filter(picked).alias("keep"))


@query(
    "S7_point_position",
    "SELECT l_orderkey, l_linenumber, CAST(floor((l_partkey - 500 + l_suppkey - 300) / 2) AS BIGINT) AS mid, "
    "l_partkey - 500 AS first FROM lineitem",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    start, end = F.col("l_partkey") - 500, F.col("l_suppkey") - 300
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", point_position(start, end).alias("mid"),
        point_position(start, end, use_midpoint=False).alias("first"),
    )


@query(
    "S8_to_int_strict",
    """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_partkey WHEN 1 THEN l_partkey * 1000
  ELSE CAST(trunc(l_extendedprice) AS BIGINT) END AS n FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("l_linenumber") % 3
    text = (
        F.when(kind == 0, F.col("l_partkey").cast("string"))
        .when(kind == 1, F.concat("l_partkey", F.lit("e3")))
        .otherwise(F.col("l_extendedprice").cast("string"))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", to_int_strict(text).alias("n"))


@query(
    "S9_norm_event_type",
    """WITH t AS (SELECT l_orderkey, l_linenumber, lower(trim(CASE l_linenumber WHEN 1 THEN 'BND' WHEN 2 THEN 'DUP;INV'
    WHEN 3 THEN ' Deletion ' WHEN 4 THEN 'foo' WHEN 5 THEN 'Translocation;x' WHEN 6 THEN 'T' ELSE l_returnflag || ';' END)) AS t
  FROM lineitem), f AS (SELECT *, split_part(t, ';', 1) AS f FROM t)
SELECT l_orderkey, l_linenumber, CASE f WHEN 'duplication' THEN 'dup' WHEN 'deletion' THEN 'del' WHEN 'inversion' THEN 'inv'
  WHEN 'translocation' THEN 'tra' WHEN 'bnd' THEN 'tra' WHEN 't' THEN 'tra' ELSE f END AS event_type FROM f""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    texts = {1: "BND", 2: "DUP;INV", 3: " Deletion ", 4: "foo", 5: "Translocation;x", 6: "T"}
    raw = F.concat("l_returnflag", F.lit(";"))
    for n, t in texts.items():
        raw = F.when(F.col("l_linenumber") == n, t).otherwise(raw)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.norm_event_type(raw).alias("event_type"))


@query(
    "S10_interval_length",
    """SELECT l_orderkey, l_linenumber, greatest(l_partkey - l_suppkey + 1, 1) AS len_bp,
  greatest(greatest(l_partkey - l_suppkey + 1, 1) / CAST(1000 AS DOUBLE), 1e-8) AS kb FROM lineitem""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    length = interval_length("l_suppkey", "l_partkey")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", length.alias("len_bp"), length_kb(length).alias("kb")
    )


# Observed, expected and length taken from order lines.
_SCORED_SQL = """WITH b AS (
  SELECT l_orderkey, l_linenumber, l_quantity AS y, l_tax * 500 AS e, l_extendedprice / 1000 AS kb FROM lineitem),
s AS (SELECT *, CASE WHEN y > e AND e > 1e-12 THEN y * ln((y + 1) / (e + 1)) + (1 - (y + 1) / (e + 1)) * e END AS llr FROM b),
n AS (SELECT *, llr / greatest(sqrt(kb), 1e-8) AS norm FROM s)
"""


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("y"), (F.col("l_tax") * 500).alias("e"),
        (F.col("l_extendedprice") / 1000).alias("kb"),
    ).withColumn("llr", fn.llr_poisson("y", "e")).withColumn("norm", fn.llr_norm("llr", "kb"))


@query("S11_llr_poisson", _SCORED_SQL + "SELECT l_orderkey, l_linenumber, y, e, round(llr, 6) AS llr FROM n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", "y", "e", F.round("llr", 6).alias("llr"))


@query("S12_llr_norm", _SCORED_SQL + "SELECT l_orderkey, l_linenumber, y, kb, round(norm, 6) AS norm FROM n")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", "y", "kb", F.round("norm", 6).alias("norm"))


MIXTURE = Mixture((0.5, 0.3, 0.2), (0.3, 0.8, 1.4), (0.25, 0.3, 0.5))


def tail_sql(score: str, mixture: Mixture = MIXTURE) -> str:
    """SQL for ln P(score or more) under the mixture, as one expression."""
    from hotspan.functions.tail import ERFC_COEFFICIENTS

    def number(x: float) -> str:
        return f"CAST({x!r} AS DOUBLE)"

    parts = []
    for w, mu, sig in zip(mixture.w, mixture.mu, mixture.sig):
        z = f"((ln(1 + greatest({score}, 0)) - {number(mu)}) / {number(sig)})"
        u = f"(abs({z}) / sqrt(CAST(2 AS DOUBLE)))"
        t = f"(1 / (1 + {number(0.5)} * {u}))"
        poly = number(ERFC_COEFFICIENTS[-1])
        for c in reversed(ERFC_COEFFICIENTS[:-1]):
            poly = f"({poly} * {t} + {number(c)})"
        log_erfc = f"(ln({t}) - {u} * {u} + {poly})"
        sf = f"CASE WHEN {z} >= 0 THEN exp({log_erfc}) / 2 ELSE 1 - exp({log_erfc}) / 2 END"
        parts.append(f"{number(w)} * ({sf})")
    return f"ln({' + '.join(parts)})"


@query(
    "S13_mixture_tail",
    _SCORED_SQL + f", p AS (SELECT *, {tail_sql('norm')} AS lp FROM n) "
    "SELECT l_orderkey, l_linenumber, y, round(norm, 6) AS norm, round(CASE WHEN llr IS NULL THEN 0 ELSE -lp / ln(10) END, 5) AS neglog10_p,"
    " round(CASE WHEN llr IS NULL THEN 1 ELSE exp(lp) END, 5) AS p FROM p",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    out = fn.mixture_tail(_scored(spark, sf), "norm", MIXTURE)
    return out.select(
        "l_orderkey", "l_linenumber", "y", F.round("norm", 6).alias("norm"),
        F.round("neglog10_p", 5).alias("neglog10_p"), F.round("p_val", 5).alias("p"),
    )


@query(
    "S14_interval_weight",
    _SCORED_SQL + "SELECT l_orderkey, l_linenumber, y, coalesce(round(llr * pow(CASE WHEN llr > 0 THEN l_linenumber / CAST(2 AS DOUBLE)"
    " ELSE 0 END, CAST(1.5 AS DOUBLE)) * pow(kb, CAST(0.5 AS DOUBLE)), 6), 0) AS weight FROM n",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    weight = fn.interval_weight("llr", F.col("l_linenumber") / 2.0, "kb", beta=1.5, gamma=0.5)
    return _scored(spark, sf).select("l_orderkey", "l_linenumber", "y", F.round(weight, 6).alias("weight"))


@query(
    "S15_bin_loglike",
    _SCORED_SQL + "SELECT l_orderkey, l_linenumber, y, round(y * ln(least(greatest(e, 1e-9), 1e4))"
    " - least(greatest(e, 1e-9), 1e4) * kb, 6) AS ll FROM n",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(
        "l_orderkey", "l_linenumber", "y", F.round(fn.bin_loglike("y", "e", "kb"), 6).alias("ll")
    )


@query(
    "S16_huber_weight",
    _SCORED_SQL + "SELECT l_orderkey, l_linenumber, y, round(CASE WHEN abs(y - e) <= 12 THEN 1"
    " ELSE 12 / (abs(y - e) + 1e-9) END, 6) AS w FROM n",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _scored(spark, sf).select(
        "l_orderkey", "l_linenumber", "y", F.round(fn.huber_weight(F.col("y") - F.col("e"), 12.0), 6).alias("w")
    )


@query(
    "S17_chrom_id",
    _NAMES_SQL + "SELECT event_id, CAST(greatest(coalesce(list_position(["
    + ", ".join(f"'{c}'" for c in fn.CANONICAL) + "], chrom), 0) - 1, 0) AS INTEGER) AS id FROM n",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).select("event_id", fn.chrom_id(norm_chrom("raw")).alias("id"))
