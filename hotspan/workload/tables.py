"""The roles of the data model, derived from the driver's tables.

``*_SQL`` is the same derivation as a common table expression. A sequence is
a group of 30 users, so the number of sequences grows with the tables; a
position is a whole second since 2024-01-01; a bin is one hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspan.operators.rate import rate_baseline
from hotspan.plans.labels import build_labels

HOUR = 3600
DAY = 86_400


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seconds(col: str) -> Column:
    gap = f"({col} - timestamp_ntz'2024-01-01 00:00:00')"
    return F.expr(
        f"CAST(EXTRACT(DAY FROM {gap}) * 86400L + EXTRACT(HOUR FROM {gap}) * 3600L"
        f" + EXTRACT(MINUTE FROM {gap}) * 60L + FLOOR(EXTRACT(SECOND FROM {gap})) AS BIGINT)"
    )


def typed_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("chr"), F.floor(F.col("user_id") / 30) + 1).alias("chrom"),
        seconds("ts").alias("pos"),
        "event_type",
        F.col("user_id").cast("string").alias("sample"),
        F.when(F.col("value") <= 200, "PASS").otherwise("LOWQ").alias("filter"),
        "value",
    )


EV_SQL = """ev AS (
  SELECT event_id, 'chr' || (1 + user_id // 30) AS chrom,
         epoch_us(ts) // 1000000 - 1704067200 AS pos, event_type,
         CAST(user_id AS VARCHAR) AS sample,
         CASE WHEN value <= 200 THEN 'PASS' ELSE 'LOWQ' END AS filter, value
  FROM events)"""


def passed(spark: SparkSession, sf: str) -> DataFrame:
    return typed_events(spark, sf).where(F.col("filter") == "PASS")


OK_SQL = "ok AS (SELECT * FROM ev WHERE filter = 'PASS')"


def grid(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.floor(F.col("pos") / HOUR) * HOUR
    ends = typed_events(spark, sf).groupBy("chrom").agg(F.min(hour).alias("lo"), F.max(hour).alias("hi"))
    return ends.select(
        "chrom", F.explode(F.sequence("lo", "hi", F.lit(HOUR).cast("bigint"))).alias("start")
    ).withColumn("end", F.col("start") + (HOUR - 1))


GRID_SQL = """grid AS (
  SELECT chrom, s AS start, s + 3599 AS "end" FROM (
    SELECT chrom, unnest(range(min(pos) // 3600 * 3600, max(pos) // 3600 * 3600 + 1, 3600)) AS s
    FROM ev GROUP BY chrom))"""


def indexed_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The grid with w_idx, the hour number."""
    return grid(spark, sf).withColumn("w_idx", F.floor(F.col("start") / HOUR))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return build_labels(grid(spark, sf), passed(spark, sf), HOUR, 0)


LAB_SQL = """lab AS (
  SELECT g.chrom, g.start, g."end", CAST(coalesce(n, 0) AS DOUBLE) AS y
  FROM grid g LEFT JOIN (
    SELECT chrom, pos // 3600 * 3600 AS start, count(DISTINCT sample) AS n FROM ok GROUP BY ALL) e
  ON e.chrom = g.chrom AND e.start = g.start)"""


def rated(spark: SparkSession, sf: str) -> DataFrame:
    """Bins with the constant rate of their sequence: lam, obs, kb."""
    return rate_baseline(labels(spark, sf)).select(
        "chrom", "start", "end", F.col("lam_pred").alias("lam"), F.col("y").alias("obs"),
        F.lit(HOUR / 1000.0).alias("kb"),
    )


RATED_SQL = """rated AS (
  SELECT chrom, start, "end", y AS obs, CAST(3.6 AS DOUBLE) AS kb,
         sum(y) OVER (PARTITION BY chrom) / (count(*) OVER (PARTITION BY chrom) * CAST(3.6 AS DOUBLE)) AS lam
  FROM lab)"""


def segment_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(segment, bin) rows of 24-hour segments: seg_id, off, y, lam, kb.

    A segment is a day; its id is text order of (chrom, day) independent of
    the segmenting operator. The rate rises and falls over the day.
    """
    day = F.floor(F.col("start") / DAY)
    off = F.floor(F.col("start") % DAY / HOUR)
    return rated(spark, sf).select(
        "chrom", "start", "end", F.concat_ws(":", "chrom", day.cast("string")).alias("seg_id"),
        off.alias("off"), F.col("obs").alias("y"),
        (F.col("lam") * (0.5 + (off % 12) / 12.0)).alias("lam"), "kb",
    )


SEG_SQL = """seg AS (
  SELECT chrom, start, "end", chrom || ':' || (start // 86400) AS seg_id,
         start % 86400 // 3600 AS off, obs AS y, kb,
         lam * (CAST(0.5 AS DOUBLE) + (start % 86400 // 3600 % 12) / CAST(12 AS DOUBLE)) AS lam
  FROM rated)"""


def cte(*names: str) -> str:
    """``WITH`` clause of the named derivations and all they need."""
    parts = {
        "ev": EV_SQL, "ok": OK_SQL, "grid": GRID_SQL, "lab": LAB_SQL, "rated": RATED_SQL, "seg": SEG_SQL,
        "psum": PSUM_SQL, "cand": CAND_SQL, "iv": IV_SQL,
    }
    needs = {
        "ok": ["ev"], "grid": ["ev"], "lab": ["ok", "grid"], "rated": ["lab"], "seg": ["rated"],
        "psum": ["rated"], "cand": ["psum"], "iv": ["grid"],
    }
    done: list[str] = []

    def add(name: str) -> None:
        for need in needs.get(name, []):
            add(need)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(parts[n] for n in done) + "\n"


PSUM_SQL = """psum AS (
  SELECT *, sum(obs) OVER w AS co, sum(lam * kb) OVER w AS cm FROM rated
  WINDOW w AS (PARTITION BY chrom ORDER BY start ROWS UNBOUNDED PRECEDING))"""

LLR = "(y * ln((y + 1) / (e + 1)) + (1 - (y + 1) / (e + 1)) * e)"

CAND_SQL = f"""cand AS (
  SELECT * FROM (
    SELECT *, CASE WHEN y > e AND e > 1e-12 THEN {LLR} END AS llr FROM (
      SELECT a.chrom, a.start AS start_bp, b."end" AS end_bp, b."end" - a.start + 1 AS len_bp,
             b.co - a.co + a.obs AS y, b.cm - a.cm + a.lam * a.kb AS e
      FROM psum a JOIN psum b ON a.chrom = b.chrom AND a.start <= b.start AND b."end" - a.start <= 86400))
  WHERE llr > 1e-6)"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    """Non-overlapping intervals: six hours of each day of each sequence, from
    an hour that depends on the sequence."""
    days = grid(spark, sf).groupBy("chrom", F.floor(F.col("start") / DAY).alias("day")).agg(F.count(F.lit(1)))
    first = (F.col("day") * DAY + (F.length("chrom") + 2) * HOUR).alias("start_bp")
    return days.select("chrom", first).withColumn("end_bp", F.col("start_bp") + (6 * HOUR - 1))


IV_SQL = """iv AS (
  SELECT chrom, d * 86400 + (length(chrom) + 2) * 3600 AS start_bp,
         d * 86400 + (length(chrom) + 2) * 3600 + 21599 AS end_bp
  FROM (SELECT DISTINCT chrom, start // 86400 AS d FROM grid))"""
