"""What lies inside selected intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotspan.functions.numeric import sanitize
from hotspan.operators.ordered import running
from hotspan.session import stage_table

INTERVAL = ["chrom", "start_bp", "end_bp"]
TILE_BP = 100_001
SALTS = 8
STAT_DEFAULTS = {
    "n_evt_all": "bigint",
    "n_samp_all": "bigint",
    "max_junc_per_sample": "bigint",
    "median_junc_per_sample": "double",
    "gini_junc": "double",
    "event_type_diversity": "bigint",
    "frac_TRA": "double",
}


def _tiled_intervals(intervals: DataFrame, tile_bp: int, salts: int) -> DataFrame:
    """Each distinct interval once per tile it touches and per salt."""
    low = F.floor(F.col("start_bp") / tile_bp)
    high = F.floor(F.col("end_bp") / tile_bp)
    return (
        intervals.select(*INTERVAL)
        .distinct()
        .withColumn("_tile", F.explode(F.sequence(low, high)))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, tile_bp: int = TILE_BP, salts: int = SALTS
) -> DataFrame:
    """Pairs of a point and an interval with start_bp <= pos <= end_bp.

    An equi-join on (chrom, tile, salt): a point lies in one tile and takes one
    salt, an interval is copied to the tiles it covers (two at most when it is
    no longer than a tile) and to every salt. A tile that holds a large share
    of the points is thus split over ``salts`` tasks. No side is broadcast by
    hand; at run time Spark does so where the measured size allows.
    """
    keyed = points.withColumns({
        "_tile": F.floor(F.col("pos") / tile_bp),
        "_salt": F.pmod(F.xxhash64(*points.columns), F.lit(salts)).cast("int"),
    })
    return (
        keyed.join(_tiled_intervals(intervals, tile_bp, salts), ["chrom", "_tile", "_salt"])
        .where((F.col("start_bp") <= F.col("pos")) & (F.col("pos") <= F.col("end_bp")))
        .drop("_tile", "_salt")
    )


def points_in_disjoint_intervals(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """As ``points_in_intervals``, for intervals that do not overlap: an as-of join.

    Points and intervals are one stream, dealt out by ranges of (chrom,
    position) and sorted there, and the last interval is carried along it. A
    range's first points may lie in an interval of an earlier range: those
    wait for the last interval of the ranges before, one row for each range.
    No side is copied, whatever the length of the intervals, and a position
    that many points share is spread over ranges by a hash. Points without
    sequence or position lie in none.
    """
    plain = intervals.select(*INTERVAL).distinct().select(
        F.col("chrom"), F.col("start_bp").cast("bigint").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("bigint").alias("_h"),
        F.col("end_bp").cast("bigint").alias("_e"))
    row = F.struct(*points.columns)
    asks = points.where(F.col("chrom").isNotNull() & F.col("pos").isNotNull()).select(
        F.col("chrom"), F.col("pos").cast("bigint").alias("_at"), F.lit(1).alias("_kind"), F.xxhash64(*points.columns).alias("_h"),
        F.lit(None).cast("bigint").alias("_e"), row.alias("_row"))
    stream = plain.where(F.col("chrom").isNotNull()).withColumn("_row", F.lit(None).cast(asks.schema["_row"].dataType)).unionByName(asks)
    order = ["chrom", "_at", "_kind", "_h"]
    # a point's row, the interval it meets in its range, and one row more for each range: its last interval
    names = ["_part", "_row", "chrom", "_at", "start_bp", "end_bp", "_state"]
    schema = T.StructType([
        T.StructField("_part", T.IntegerType()), T.StructField("_row", asks.schema["_row"].dataType), T.StructField("chrom", T.StringType()),
        T.StructField("_at", T.LongType()), T.StructField("start_bp", T.LongType()), T.StructField("end_bp", T.LongType()),
        T.StructField("_state", T.IntegerType())])
    met, waits, last = 0, 1, 2

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, row_type = TaskContext.get().partitionId(), None, None
        for batch in batches:
            chrom, n = batch.column(0), batch.num_rows
            row_type = batch.column(5).type
            at = batch.column(1).to_numpy(zero_copy_only=False)
            opens = batch.column(2).to_numpy(zero_copy_only=False) == 0
            ends = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
            of = np.maximum.accumulate(np.where(opens, np.arange(n), -1)) if n else np.zeros(0, np.int64)
            code = chrom.dictionary_encode()
            seen = code.dictionary.to_pylist()
            code = code.indices.to_numpy(zero_copy_only=False)
            start, end = np.where(of >= 0, at[of], held[1] if held else 0), np.where(of >= 0, ends[of], held[2] if held else 0)
            before = seen.index(held[0]) if held and held[0] in seen else -1
            same = np.where(of >= 0, code[of] == code, code == before)
            open_yet = (of < 0) & (held is None)
            keep = np.flatnonzero(~opens & (open_yet | (same & (at <= end))))
            state = np.where(open_yet, waits, met)[keep].astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(keep), part, np.int32)), batch.column(5).take(pa.array(keep)), chrom.take(pa.array(keep)),
                pa.array(at[keep], pa.int64()), pa.array(start[keep], pa.int64()), pa.array(end[keep], pa.int64()), pa.array(state)], names)
            if opens.any():
                i = int(of[-1])
                held = chrom[i].as_py(), int(at[i]), int(ends[i])
        if row_type is not None:
            chrom, start, end = held or (None, None, None)
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.nulls(1, row_type), pa.array([chrom], pa.string()), pa.array([start], pa.int64()),
                pa.array([start], pa.int64()), pa.array([end], pa.int64()), pa.array([last], pa.int32())], names)

    dealt = stream.select(*order, "_e", "_row").repartitionByRange(*order).sortWithinPartitions(*order)
    found = stage_table(dealt.mapInArrow(carry, schema), "asof")
    interval = F.when(F.col("start_bp").isNotNull(), F.struct(F.col("chrom").alias("c"), F.col("start_bp").alias("s"), F.col("end_bp").alias("e")))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = found.where(F.col("_state") == last).select("_part", F.last(interval, ignorenulls=True).over(before).alias("_held"))
    waiting = found.where(F.col("_state") == waits).join(ranges, "_part").where(
        (F.col("_held.c") == F.col("chrom")) & (F.col("_at") <= F.col("_held.e")))
    inside = found.where(F.col("_state") == met).select("_row.*", "start_bp", "end_bp")
    return inside.unionByName(waiting.select("_row.*", F.col("_held.s").alias("start_bp"), F.col("_held.e").alias("end_bp")))


def bins_in_intervals(
    bins: DataFrame, intervals: DataFrame, tile_bp: int = TILE_BP, salts: int = 1
) -> DataFrame:
    """Pairs of a bin and an interval that contains it (start >= start_bp and
    end <= end_bp); the bin is placed by its start."""
    keyed = bins.withColumns({
        "_tile": F.floor(F.col("start") / tile_bp),
        "_salt": F.pmod(F.xxhash64("chrom", "start", "end"), F.lit(salts)).cast("int"),
    })
    return (
        keyed.join(_tiled_intervals(intervals, tile_bp, salts), ["chrom", "_tile", "_salt"])
        .where((F.col("start") >= F.col("start_bp")) & (F.col("end") <= F.col("end_bp")))
        .drop("_tile", "_salt")
    )


def interval_obs_exp(bins: DataFrame, intervals: DataFrame, tile_bp: int = TILE_BP) -> DataFrame:
    """Observed and expected totals of the unsmoothed bins inside each
    interval; ``bins`` as given by scan_input."""
    return (
        bins_in_intervals(bins, intervals, tile_bp)
        .groupBy(*INTERVAL)
        .agg(
            sanitize(F.sum("obs")).alias("obs_sum"),
            sanitize(F.sum(F.col("lam") * F.col("kb"))).alias("exp_sum"),
        )
    )


#: Sums of bins are whole numbers of this part, so that their differences are exact.
PART = 1 << 30


def interval_sums(bins: DataFrame, intervals: DataFrame, block_bp: int = 10_000_000) -> DataFrame:
    """As ``interval_obs_exp`` by differences of running sums: no join of bins
    with intervals, and work that does not depend on the intervals' lengths.

    For bins that do not overlap, the total of those inside [s, e] is that of
    the bins that end by e less that of the bins that start before s. Both are
    looked up in one stream for each side, of bin places and asked places,
    with running sums block by block. Totals are rounded to 2^-30. Intervals
    may overlap or repeat (a repeated one has one row).
    """
    asked = intervals.select(*INTERVAL).distinct()
    sums = ["_n", "_obs", "_exp"]
    whole = lambda c: F.round(c * float(PART)).cast("decimal(38,0)")
    measured = bins.select(
        "chrom", "start", "end", F.lit(1).cast("decimal(38,0)").alias("_n"), whole(F.col("obs")).alias("_obs"),
        whole(F.col("lam") * F.col("kb")).alias("_exp"))
    none = [F.lit(None).cast("decimal(38,0)").alias(c) for c in sums]
    nobody = [F.lit(None).cast("bigint").alias(c) for c in INTERVAL[1:]]

    def side(sign: int, at: str, ask: str, turn: int) -> DataFrame:
        """Bin places have turn 1 among equal positions, asked ones 0 (those before) or 2 (those up to)."""
        places = measured.select("chrom", F.col(at).cast("bigint").alias("_at"), F.lit(1).alias("_turn"), *sums, *nobody)
        return places.unionByName(asked.select(
            "chrom", F.col(ask).cast("bigint").alias("_at"), F.lit(turn).alias("_turn"), *none, *INTERVAL[1:]
        )).withColumn("_sign", F.lit(sign))

    stream = side(1, "end", "end_bp", 2).unionByName(side(-1, "start", "start_bp", 0))
    stream = stream.withColumn("_blk", F.floor(F.col("_at") / block_bp))
    summed = running(
        stream, ["chrom", "_sign"], "_blk", ["_at", "_turn"],
        {f"{c}_upto": ("sum", F.coalesce(c, F.lit(0).cast("decimal(38,0)"))) for c in sums})
    signed = lambda c: F.sum(F.col(f"{c}_upto") * F.col("_sign"))
    totals = summed.where(F.col("_turn") != 1).groupBy(*INTERVAL).agg(*[signed(c).alias(c) for c in sums])
    back = lambda c: sanitize(F.col(c).cast("double") / float(PART))
    return totals.where(F.col("_n") > 0).select(*INTERVAL, back("_obs").alias("obs_sum"), back("_exp").alias("exp_sum"))


def event_groups(
    points: DataFrame, intervals: DataFrame, tile_bp: int = TILE_BP, salts: int = SALTS
) -> DataFrame:
    """Events per (interval, type, sample).

    Equal events are counted before the join and the pairs are counted again
    before the shuffle to the interval, so a crowded interval stays spread
    over its types and samples.
    """
    counted = points.groupBy("chrom", "pos", F.lower("event_type").alias("event_type"), "sample").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        points_in_intervals(counted, intervals, tile_bp, salts)
        .groupBy(*INTERVAL, "event_type", "sample")
        .agg(F.sum("n").alias("n"))
    )


def event_counts(groups: DataFrame) -> DataFrame:
    """Events, distinct samples and distinct types per interval."""
    return groups.groupBy(*INTERVAL).agg(
        F.sum("n").alias("n_evt_all"),
        F.count_distinct("sample").alias("n_samp_all"),
        F.count_distinct("event_type").alias("event_type_diversity"),
    )


def _pivot(groups: DataFrame, prefix: str, types: list[str], value: Column) -> DataFrame:
    out = groups.groupBy(*INTERVAL).pivot("event_type", types).agg(value)
    return out.select(
        *INTERVAL, *[F.coalesce(F.col(f"`{t}`"), F.lit(0)).cast("bigint").alias(prefix + t) for t in types]
    )


def event_types(groups: DataFrame) -> list[str]:
    """Distinct types in order, for results with a column for each type. With
    more types than a table can have columns, use ``types_as_map``."""
    return sorted(r["event_type"] for r in groups.select("event_type").distinct().collect())


def events_by_type(groups: DataFrame, types: list[str]) -> DataFrame:
    """``n_evt_<type>`` per interval."""
    return _pivot(groups, "n_evt_", types, F.sum("n"))


def samples_by_type(groups: DataFrame, types: list[str]) -> DataFrame:
    """``n_samp_<type>`` per interval: distinct samples with that type."""
    return _pivot(groups, "n_samp_", types, F.count(F.lit(1)))


def types_as_map(groups: DataFrame) -> DataFrame:
    """Events and samples by type as two maps per interval."""
    by_type = groups.groupBy(*INTERVAL, "event_type").agg(
        F.sum("n").alias("n_evt"), F.count(F.lit(1)).alias("n_samp")
    )
    def as_map(value: str):
        return F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", value))))
    return by_type.groupBy(*INTERVAL).agg(as_map("n_evt").alias("n_evt"), as_map("n_samp").alias("n_samp"))


def _count_histogram(groups: DataFrame) -> DataFrame:
    """Per interval and event count x: how many samples have x events.

    An interval with N events has at most sqrt(2 N) different counts, so what
    follows per interval stays small however many samples there are.
    """
    return (
        groups.groupBy(*INTERVAL, "sample").agg(F.sum("n").alias("x"))
        .groupBy(*INTERVAL, "x").agg(F.count(F.lit(1)).alias("m"))
    )


def _ranked_histogram(groups: DataFrame) -> DataFrame:
    """``_count_histogram`` with r, the number of samples with fewer events."""
    w = Window.partitionBy(*INTERVAL).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    return _count_histogram(groups).where(F.col("x") > 0).withColumn("r", F.coalesce(F.sum("m").over(w), F.lit(0)))


_MEDIAN = "median_junc_per_sample"


def _sample_sums(ranked: DataFrame) -> DataFrame:
    x, m, r = F.col("x").cast("double"), F.col("m"), F.col("r")
    return ranked.groupBy(*INTERVAL).agg(
        F.sum(F.col("x") * m).alias("n_evt_all"),
        F.sum(m).alias("n_samp_all"),
        F.max("x").alias("max_junc_per_sample"),
        F.percentile("x", 0.5, m).alias(_MEDIAN),
        # sums over the m equal values at ranks r + 1 .. r + m
        F.sum(x * m * (2 * r + m)).alias("_ranks"),
    )


def _gini(compat: bool) -> Column:
    n, s, ranks = F.col("n_samp_all"), F.col("n_evt_all"), F.col("_ranks")
    if compat:
        # sum of running shares = sum of (n + 1 - rank) * x / s
        shares = (n + 1) - (ranks / s + 1) / 2
        value = n + 1.0 - 2.0 * shares / n
    else:
        value = ranks / (n.cast("double") * s) - 1.0
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def per_sample_spread(groups: DataFrame) -> DataFrame:
    """Maximum and exact median of events per sample."""
    return _count_histogram(groups).groupBy(*INTERVAL).agg(
        F.max("x").alias("max_junc_per_sample"),
        F.percentile("x", 0.5, F.col("m")).alias(_MEDIAN),
    )


def gini(groups: DataFrame, compat: bool = False) -> DataFrame:
    """Concentration of the events over the samples of each interval.

    ``compat`` gives another published variant, which divides only the summed
    shares by the number of samples and is then clamped to [0, 1].
    """
    sums = _sample_sums(_ranked_histogram(groups))
    return sums.select(*INTERVAL, _gini(compat).alias("gini_junc"))


def sample_stats(groups: DataFrame, compat: bool = False) -> DataFrame:
    """All statistics over the samples of each interval, from one histogram."""
    sums = _sample_sums(_ranked_histogram(groups))
    return sums.withColumn("gini_junc", _gini(compat)).drop("_ranks")


def type_stats(groups: DataFrame, types: list[str], dedup_sample: bool = True, pattern: str = "tra") -> DataFrame:
    """All statistics over the types of each interval, from one count per type."""
    by_type = groups.groupBy(*INTERVAL, "event_type").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("samples")
    )
    def of(t: str, value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("event_type") == t, F.col(value))), F.lit(0))
    hits = F.sum(F.when(F.col("event_type").contains(pattern), F.col("n")).otherwise(0))
    return by_type.groupBy(*INTERVAL).agg(
        F.count(F.lit(1)).alias("event_type_diversity"),
        (hits / F.sum("n")).alias("frac_TRA"),
        *[of(t, "n").alias(f"n_evt_{t}") for t in types],
        *[of(t, "samples").alias(f"n_samp_{t}") for t in types if dedup_sample],
    )


def type_fraction(groups: DataFrame, pattern: str = "tra", name: str = "frac_TRA") -> DataFrame:
    """Share of events whose type contains ``pattern``."""
    hits = F.sum(F.when(F.col("event_type").contains(pattern), F.col("n")).otherwise(0))
    return groups.groupBy(*INTERVAL).agg((hits / F.sum("n")).alias(name))


def attach_event_stats(
    results: DataFrame,
    groups: DataFrame | None,
    types: list[str] | None = None,
    dedup_sample: bool = True,
    gini_compat: bool = False,
    pattern: str = "tra",
    types_as: str = "columns",
) -> DataFrame:
    """Join all statistics to the intervals, 0 where there are no events.

    The statistics share one shuffle key, so their joins need no further
    exchange of the summaries. ``types_as`` is ``columns`` (the given types,
    or all of them) or ``map``, which gives the maps ``n_evt`` and ``n_samp``
    and takes any number of types.
    """
    if groups is None:
        return results.withColumns({n: F.lit(0).cast(t) for n, t in STAT_DEFAULTS.items()})
    if types_as == "map":
        plain = attach_event_stats(results, groups, [], dedup_sample, gini_compat, pattern)
        maps = types_as_map(groups)
        names = ["n_evt", "n_samp"] if dedup_sample else ["n_evt"]
        none = F.create_map().cast("map<string,bigint>")
        return plain.join(maps.select(*INTERVAL, *names), INTERVAL, "left").select(
            *plain.columns, *[F.coalesce(n, none).alias(n) for n in names])
    types = event_types(groups) if types is None else types
    tables = [
        sample_stats(groups, gini_compat),
        # a type called "all" would take the name of the total
        type_stats(groups, [t for t in types if t != "all"], dedup_sample, pattern),
    ]
    out = results
    for table in tables:
        out = out.join(table, INTERVAL, "left")
    typed = {f"n_evt_{t}": "bigint" for t in types}
    if dedup_sample:
        typed |= {f"n_samp_{t}": "bigint" for t in types}
    stats = STAT_DEFAULTS | {n: t for n, t in typed.items() if n not in STAT_DEFAULTS}
    return out.select(
        *results.columns,
        *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast(t).alias(n) for n, t in stats.items()],
    )
