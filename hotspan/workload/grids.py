"""Grids, labels, segments, smoothing and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hotspan.functions.vectors import fuse_vectors
from hotspan.operators import grid as gr
from hotspan.operators import segments as sg
from hotspan.operators.scan import chunk_windows
from hotspan.operators.smooth import presmooth, rolling_rate
from hotspan.plans.labels import build_labels
from hotspan.workload.fields import embedding_bins, embedding_features
from hotspan.workload.registry import query
from hotspan.workload.tables import (
    DAY,
    HOUR,
    cte,
    grid,
    indexed_grid,
    labels,
    passed,
    rated,
    segment_rows,
    table,
    typed_events,
)


def _vector_sums(col: Column | str) -> list[Column]:
    v = F.transform(F.col(col) if isinstance(col, str) else col, lambda x: x.cast("double"))
    weighted = F.aggregate(
        F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x
    )
    return [F.size(v).cast("bigint").alias("width"), F.round(weighted, 5).alias("checksum")]


def checksum_sql(vec: str) -> str:
    return f"round(list_sum(list_transform({vec}, lambda x, i: CAST(x AS DOUBLE) * i)), 5)"


@query(
    "J1_join_features",
    f"""SELECT 'chr' || (label + 1) AS chrom, vec_id AS w_idx, CAST(64 AS BIGINT) AS width,
  CASE WHEN embedding[1] > 0 THEN {checksum_sql('list_reverse(embedding)')} ELSE CAST(0 AS DOUBLE) END AS checksum
  FROM embeddings""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    joined = sg.join_features(embedding_bins(spark, sf), embedding_features(spark, sf))
    return joined.select("chrom", "w_idx", *_vector_sums("feat"))


@query(
    "J2_assign_points_to_grid",
    cte("ok", "grid") + 'SELECT event_id, g.chrom, g.start, g."end" FROM ok JOIN grid g '
    "ON g.chrom = ok.chrom AND g.start = pos // 3600 * 3600",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    placed = gr.assign_points_to_grid(passed(spark, sf), grid(spark, sf))
    return placed.select("event_id", "chrom", "start", "end")


@query("J3_attach_labels", cte("lab") + "SELECT * FROM lab")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return labels(spark, sf)


@query(
    "J3_unmatched_bins",
    cte("lab") + "SELECT count(*) FILTER (y = 0) AS n_zero, count(*) AS n FROM lab",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return gr.unmatched_bins(labels(spark, sf))


@query(
    "J5_chunk_windows",
    cte("grid") + """, f AS (SELECT chrom, min(start) AS lo, max("end") AS hi FROM grid GROUP BY 1),
t AS (SELECT chrom, lo, unnest(range((hi - lo) // 72000 + 1)) AS tile FROM f)
SELECT g.chrom, g.start, g."end", tile, lo + tile * 72000 AS tile_start FROM grid g JOIN t ON t.chrom = g.chrom
  AND g."end" >= lo + tile * 72000 AND g.start <= lo + tile * 72000 + 99999""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return chunk_windows(grid(spark, sf), 100_000, 28_000)


@query(
    "A2_bin_labels",
    cte("ok", "grid") + 'SELECT g.chrom, g.start, g."end", count(DISTINCT sample) AS y FROM ok JOIN grid g '
    "ON g.chrom = ok.chrom AND g.start = pos // 3600 * 3600 GROUP BY ALL",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return gr.bin_labels(passed(spark, sf), grid(spark, sf))


@query(
    "A2_order_line_labels",
    """SELECT 'chr' || (1 + l_suppkey % 24) AS chrom, (epoch_us(l_shipdate) // 1000000 // 604800) * 604800 AS start,
  (epoch_us(l_shipdate) // 1000000 // 604800) * 604800 + 604799 AS "end", count(DISTINCT l_partkey) AS y
  FROM lineitem GROUP BY ALL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct parts per supplier group and week, on the largest table."""
    week = 604_800
    days = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date"))
    points = table(spark, sf, "lineitem").select(
        F.concat(F.lit("chr"), F.col("l_suppkey") % 24 + 1).alias("chrom"),
        (days.cast("bigint") * DAY).alias("pos"),
        F.col("l_partkey").alias("sample"),
    )
    weeks = points.select(
        "chrom", (F.floor(F.col("pos") / week) * week).alias("start"),
    ).distinct().withColumn("end", F.col("start") + week - 1)
    return gr.bin_labels(points, weeks, week, 0)


@query(
    "A3_infer_grid",
    """WITH b AS (SELECT l_partkey * 10 + l_linenumber AS start, l_linenumber + floor(l_quantity / 5) AS len FROM lineitem),
s AS (SELECT CAST(len AS BIGINT) AS len, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, len LIMIT 1),
a AS (SELECT start % (SELECT len FROM s) AS o, count(*) AS n FROM b GROUP BY 1 ORDER BY n DESC, o LIMIT 1)
SELECT len AS bin_size, o AS anchor FROM s, a""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("l_partkey") * 10 + F.col("l_linenumber")
    length = F.col("l_linenumber") + F.floor(F.col("l_quantity") / 5)
    bins = table(spark, sf, "lineitem").select(start.alias("start"), (start + length - 1).alias("end"))
    return gr.infer_grid(bins)


@query("A5_distinct_grid", cte("ev") + 'SELECT DISTINCT chrom, pos // 3600 * 3600 AS start, pos // 3600 * 3600 + 3599 AS "end" FROM ev')
def _(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.floor(F.col("pos") / HOUR) * HOUR
    spelled = F.when(F.col("event_id") % 2 == 0, F.substring("chrom", 4, 9)).otherwise(F.upper("chrom"))
    bins = typed_events(spark, sf).select(
        spelled.alias("chrom"), hour.alias("start"), (hour + HOUR - 1).alias("end")
    )
    return gr.distinct_grid(bins)


@query("E2_build_labels", cte("lab") + "SELECT * FROM lab")
def _(spark: SparkSession, sf: str) -> DataFrame:
    """As J3, with the width and offset of the grid read from the bins."""
    return build_labels(grid(spark, sf), passed(spark, sf))


# --- segments ----------------------------------------------------------------

_SEGMENTS_SQL = cte("grid") + """, o AS (
  SELECT *, start // 3600 AS w_idx, row_number() OVER (PARTITION BY chrom ORDER BY start) - 1 AS rn,
         count(*) OVER (PARTITION BY chrom) AS n, CAST(chrom[4:] AS BIGINT) AS num FROM grid),
l AS (SELECT * FROM (VALUES (10, 7, 0), (25, 17, 1)) v(len, step, i)),
k AS (SELECT chrom, num, len, step, i, unnest(range({made})) AS k FROM (SELECT DISTINCT chrom, num, n FROM o), l),
d AS (SELECT *, row_number() OVER (ORDER BY i, num, k) - 1 AS seg_id FROM k),
segs AS (SELECT o.chrom, o.start, o."end", o.w_idx, len AS seg_len, k * step AS seg_start, rn - k * step AS off, seg_id
  FROM o JOIN d ON d.chrom = o.chrom AND rn >= k * step AND rn < k * step + len)
"""
_ALL = _SEGMENTS_SQL.format(made="CAST(ceil(n / step) AS BIGINT)")
_FULL = _SEGMENTS_SQL.format(made="greatest((n - len) // step + 1, 0)")


def _segments(spark: SparkSession, sf: str, discard: bool = False) -> DataFrame:
    return sg.make_segments(indexed_grid(spark, sf), [10, 25], 0.3, discard)


def _long(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in ("seg_len", "seg_start", "off", "seg_id")})


_SEG_COLS = 'chrom, start, "end", w_idx, CAST(seg_len AS BIGINT) AS seg_len, CAST(seg_start AS BIGINT) AS seg_start, off, seg_id'


@query("N1_make_segments", _ALL + f"SELECT {_SEG_COLS} FROM segs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_segments(spark, sf))


@query("N1_make_segments_full_only", _FULL + f"SELECT {_SEG_COLS} FROM segs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _long(_segments(spark, sf, discard=True))


@query(
    "A4_pack_segments",
    _ALL + """, p AS (SELECT seg_id, chrom, count(*) AS n_bins, min(start) AS first, max("end") AS last,
  sum(start * (off + 1)) AS weighted FROM segs GROUP BY ALL)
SELECT seg_id, chrom, n_bins, first, last, CAST(weighted AS BIGINT) AS weighted, CAST(25 AS BIGINT) AS width,
  n_bins AS n_valid, round(n_bins * CAST(3.6 AS DOUBLE), 6) AS kb FROM p""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    packed = sg.pack_segments(_segments(spark, sf), {"start": zero, "end": zero}, pad=True)
    used = F.slice("start", F.lit(1), F.col("n_bins"))
    weighted = F.aggregate(F.transform(used, lambda x, i: x * (i + 1)), zero, lambda a, x: a + x)
    return packed.select(
        "seg_id", "chrom", F.col("n_bins").cast("bigint").alias("n_bins"), F.element_at("start", 1).alias("first"),
        F.element_at("end", F.col("n_bins")).alias("last"), weighted.alias("weighted"),
        F.size("start").cast("bigint").alias("width"),
        F.size(F.filter("mask", lambda m: m)).cast("bigint").alias("n_valid"),
        F.round(F.aggregate("length_kb", F.lit(0.0), lambda a, x: a + x), 6).alias("kb"),
    )


def _md5_unit(text: Column) -> Column:
    """A number in [0, 1) from a digest that any engine computes."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def md5_unit_sql(text: str) -> str:
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE))"


@query(
    "N14_split_train_val",
    _ALL + f""", ids AS (SELECT DISTINCT seg_id, chrom FROM segs),
r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY {md5_unit_sql('CAST(seg_id AS VARCHAR)')}, seg_id) AS rn,
  count(*) OVER (PARTITION BY chrom) AS n FROM ids)
SELECT seg_id, chrom, CASE WHEN rn <= floor(CAST(0.9 AS DOUBLE) * n) THEN 'train' ELSE 'val' END AS split FROM r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ids = _segments(spark, sf).where(F.col("off") == 0).select("seg_id", "chrom")
    return sg.split_train_val(ids, order=_md5_unit(F.col("seg_id").cast("string")))


@query(
    "N14_split_by_bin",
    cte("grid") + f"""SELECT chrom, start, "end", start // 3600 AS w_idx,
  CASE WHEN {md5_unit_sql("'42:' || chrom || ':' || (start // 86400)")} < CAST(0.9 AS DOUBLE) THEN 'train' ELSE 'val' END AS split FROM grid""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sg.split_by_bin(indexed_grid(spark, sf), block=24)


def _residuals(spark: SparkSession, sf: str) -> DataFrame:
    return segment_rows(spark, sf).groupBy("seg_id").agg(
        F.avg(F.col("y") - F.col("lam") * F.col("kb")).alias("residual"), F.sum("kb").alias("len_kb")
    )


@query(
    "N15_sampler_weights",
    cte("seg") + """, r AS (SELECT seg_id, avg(y - lam * kb) AS res, sum(kb) AS len_kb FROM seg GROUP BY 1),
w AS (SELECT *, exp(-abs(res) / (CAST(0.5 AS DOUBLE) + 1e-8)) * pow(greatest(len_kb, 1e-8), CAST(0.7 AS DOUBLE)) AS w FROM r)
SELECT seg_id, round(w / sum(w) OVER (), 9) AS p FROM w""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return sg.sampler_weights(_residuals(spark, sf), tau=0.5).select("seg_id", F.round("p", 9).alias("p"))


_DRAWN_SQL = cte("seg") + f""", r AS (SELECT seg_id, avg(y - lam * kb) AS res, sum(kb) AS len_kb FROM seg GROUP BY 1),
w AS (SELECT *, exp(-abs(res) / (CAST(0.5 AS DOUBLE) + 1e-8)) * pow(greatest(len_kb, 1e-8), CAST(0.7 AS DOUBLE)) AS w FROM r),
p AS (SELECT seg_id, CAST(floor(w / (SELECT sum(w) FROM w) * 4503599627370496) AS BIGINT) AS w, {md5_unit_sql("'42:' || seg_id")} AS u FROM w),
c AS (SELECT *, sum(w) OVER (ORDER BY u, seg_id ROWS UNBOUNDED PRECEDING) - w AS low FROM p WHERE w > 0),
d AS (SELECT floor({md5_unit_sql("'42:draw:' || i")} * (SELECT CAST(sum(w) AS DOUBLE) FROM c)) AS at
  FROM range(0, (SELECT count(*) FROM r)) t(i)),
n AS (SELECT seg_id, count(*) AS n_drawn FROM c JOIN d ON d.at >= c.low AND d.at < c.low + c.w GROUP BY 1)
"""


@query("N15_residual_sampler", _DRAWN_SQL + "SELECT seg_id, round(res, 6) AS residual, round(len_kb, 6) AS len_kb, n_drawn FROM r JOIN n USING (seg_id)")
def _(spark: SparkSession, sf: str) -> DataFrame:
    drawn = sg.residual_sampler(_residuals(spark, sf), tau=0.5, per_block=40)
    return drawn.withColumns({c: F.round(c, 6) for c in ("residual", "len_kb")})


_CUT = "CAST(floor({unit} * {n}) AS BIGINT)"
_CUTMIX_SQL = _ALL + f""", cm_k AS (SELECT seg_id, chrom, count(*) AS n_bins, list(start ORDER BY off) AS s, list("end" ORDER BY off) AS e FROM segs GROUP BY 1, 2),
cm_o AS (SELECT *, row_number() OVER (ORDER BY {md5_unit_sql("'42:' || seg_id")}, seg_id) - 1 AS rn FROM cm_k),
cm_b AS (SELECT *, rn // 16 AS batch, rn % 16 AS place FROM cm_o),
cm_w AS (SELECT *, CASE place WHEN 0 THEN lead(s) OVER v WHEN 1 THEN lag(s) OVER v END AS s2,
  CASE place WHEN 0 THEN lead(e) OVER v WHEN 1 THEN lag(e) OVER v END AS e2 FROM cm_b WINDOW v AS (PARTITION BY batch ORDER BY place)),
cm_l AS (SELECT *, s2 IS NOT NULL AND {md5_unit_sql("'43:' || batch")} < CAST(0.5 AS DOUBLE) AS mixed, least(len(s), len(s2)) AS short FROM cm_w),
cm_c AS (SELECT *, 1 + {_CUT.format(unit=md5_unit_sql("'44:' || batch"), n="greatest(short // 2, 1)")} AS cut FROM cm_l),
cm_a AS (SELECT *, {_CUT.format(unit=md5_unit_sql("'45:' || batch"), n="(short - cut + 1)")} AS lo FROM cm_c)
"""


def _swapped_sql(own: str, other: str) -> str:
    cut = lambda of, low, high: f"list_slice({of}, {low}, {high})"
    head, tail = cut(own, "1", "lo"), cut(own, "lo + cut + 1", f"len({own})")
    run = f"list_concat(list_concat({head}, {cut(other, 'lo + 1', 'lo + cut')}), {tail})"
    return f"array_to_string(CASE WHEN mixed THEN {run} ELSE {own} END, ',')"


@query(
    "N16_cutmix_pairs",
    _CUTMIX_SQL + f"""SELECT seg_id, chrom, CAST(n_bins AS INTEGER) AS n_bins, {_swapped_sql('s', 's2')} AS start, {_swapped_sql('e', 'e2')} AS "end", mixed FROM cm_a""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    packed = sg.pack_segments(_segments(spark, sf), {"start": zero, "end": zero})
    mixed = sg.cutmix_pairs(packed, ["start", "end"], probability=0.5)
    return mixed.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("start", "end")})


@query(
    "N2_rolling_rate",
    cte("seg") + """SELECT seg_id, off, sum(y) OVER w AS y, round(sum(kb) OVER w, 6) AS kb,
  round(sum(lam * kb) OVER w / sum(kb) OVER w, 6) AS lam FROM seg
  WINDOW w AS (PARTITION BY seg_id ORDER BY off ROWS 2 PRECEDING)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return rolling_rate(segment_rows(spark, sf), 3).select(
        "seg_id", "off", "y", F.round("kb", 6).alias("kb"), F.round("lam", 6).alias("lam")
    )


@query(
    "N3_presmooth",
    cte("rated") + """, v AS (SELECT *, lam * (1 + start // 3600 % 5) AS l FROM rated)
SELECT chrom, start, sum(obs) OVER w AS obs, round(sum(l * kb) OVER w / sum(kb) OVER w, 6) AS lam FROM v
  WINDOW w AS (PARTITION BY chrom ORDER BY start ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    varied = rated(spark, sf).withColumn("lam", F.col("lam") * (1 + F.floor(F.col("start") / HOUR) % 5))
    # small tiles, so that frames cross their borders
    return presmooth(varied, 4, tile=100).select("chrom", "start", "obs", F.round("lam", 6).alias("lam"))


@query(
    "N5_natural_sort",
    cte("lab") + """SELECT chrom, row_number() OVER (ORDER BY CAST(chrom[4:] AS BIGINT)) AS place, n
  FROM (SELECT chrom, count(*) AS n FROM lab GROUP BY 1)""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    from hotspan.functions.names import chrom_sort_key

    per_seq = labels(spark, sf).groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))
    return per_seq.select(
        "chrom", F.row_number().over(Window.orderBy(chrom_sort_key("chrom"))).cast("bigint").alias("place"), "n"
    )


@query(
    "U1_union_all",
    cte("ev") + "SELECT chrom, pos, sample FROM ev WHERE filter = 'PASS' UNION ALL "
    "SELECT chrom, pos, sample FROM ev WHERE event_type = 'click'",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["chrom", "pos", "sample"]
    clicks = typed_events(spark, sf).where(F.col("event_type") == "click").select(*cols)
    return passed(spark, sf).select(*cols).unionByName(clicks)


@query("U2_dedupe", cte("ev") + "SELECT DISTINCT chrom, pos // 3600 AS hour, sample, event_type FROM ev")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return typed_events(spark, sf).select(
        "chrom", F.floor(F.col("pos") / HOUR).alias("hour"), "sample", "event_type"
    ).dropDuplicates(["chrom", "hour", "sample", "event_type"])


@query(
    "G7_fuse_vectors",
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS a,
    list_transform(list_reverse(embedding), lambda x: CAST(x AS DOUBLE)) AS b FROM embeddings),
m AS (SELECT *, list_sum(a) / 64 AS ma, list_sum(list_transform(a, lambda x: x * x)) / 64 AS qa FROM v),
s AS (SELECT vec_id, a, b, ma, sqrt(greatest(qa - ma * ma, 0) + 1e-5) AS sd FROM m)
SELECT vec_id, CAST(64 AS BIGINT) AS width,
  round(list_sum(list_transform(range(1, 65), lambda i: i * ((a[i] - ma) / sd + (b[i] - ma) / sd))), 5) AS checksum FROM s""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    fused = fuse_vectors("embedding", F.reverse("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", fused.alias("v")).select("vec_id", *_vector_sums("v"))
