"""Overlapping runs of consecutive bins, and what training does with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hotspan.functions.names import chrom_sort_key
from hotspan.operators.ordered import join_per_key, md5_unit, row_index, running, tasks_for
from hotspan.session import stage_table

INDEX_BLOCK = 1 << 16


def join_features(bins: DataFrame, features: DataFrame, width: int | None = None) -> DataFrame:
    """Add ``feat`` by (chrom, w_idx); a bin without features gets zeros.

    ``width`` is the length of the vectors. If it is not given, all vectors
    must have one length, which is checked.
    """
    if width is None:
        size = F.when(F.size("feat") > 0, F.size("feat"))
        row = features.agg(F.min(size).alias("low"), F.max(size).alias("high")).first()
        if row["low"] != row["high"]:
            raise ValueError(f"vectors have from {row['low']} to {row['high']} numbers")
        width = row["low"] or 0
    zeros = F.array_repeat(F.lit(0.0).cast("float"), width)
    return bins.join(features.select("chrom", "w_idx", "feat"), ["chrom", "w_idx"], "left").withColumn(
        "feat", F.coalesce("feat", zeros)
    )


def make_segments(
    bins: DataFrame,
    lengths: list[int],
    overlap: float = 0.0,
    discard_leftover: bool = False,
) -> DataFrame:
    """One row per (segment, bin): the bins of each sequence, in w_idx order,
    cut into runs of each length that start every ``length * (1 - overlap)``.

    Adds seg_len, seg_start (index of the first bin), off (place in the
    sequence, start). Short runs at the end stay unless discarded.

    The bins of each sequence are counted first and written, one row each;
    the number of tasks follows the copies that this count promises.
    """
    # the count comes from the bins, not from the numbered rows: no second shuffle of them
    counts = stage_table(bins.groupBy("chrom").agg(F.count(F.lit(1)).alias("_n")), "counts")
    plan = [(length, max(1, int(length * (1.0 - overlap)))) for length in lengths]
    copies = sum(max(1, -(-length // step)) for length, step in plan)
    tasks = tasks_for(copies * (counts.agg(F.sum("_n")).first()[0] or 0))
    blocked = bins.withColumn("_blk", F.floor(F.col("w_idx") / INDEX_BLOCK)).repartition(tasks, "chrom", "_blk")
    numbered = row_index(blocked, ["chrom"], "_blk", ["w_idx"], "_rn").drop("_blk")

    shape = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(ln).alias("len"), F.lit(st).alias("step"))
        for i, (ln, st) in enumerate(plan)
    ]))
    n, ln, step = F.col("_n"), F.col("_s.len"), F.col("_s.step")
    if discard_leftover:
        made = F.when(n >= ln, F.floor((n - ln) / step) + 1).otherwise(0)
    else:
        made = F.ceil(n / step)
    # one row per (length, sequence): small, so one task may number them
    order = chrom_sort_key("chrom")
    sizes = counts.select("chrom", shape.alias("_s"), "_n").select(
        "chrom", F.col("_s.i").alias("_i"), made.cast("bigint").alias("_made")
    )
    offsets = running(
        sizes.withColumn("_key", order), [], "_i", ["_key", "chrom"], {"_upto": ("sum", F.col("_made"))}
    ).select("chrom", "_i", "_made", (F.col("_upto") - F.col("_made")).alias("_first"))

    rn = F.col("_rn")
    first = F.greatest(F.ceil((rn - ln + 1) / step), F.lit(0)).cast("bigint")
    last = F.floor(rn / step).cast("bigint")
    # with step > length some bins lie between two runs
    copied = (
        numbered.withColumn("_s", shape)
        .where(first <= last)
        .withColumn("_k", F.explode(F.sequence(first, last)))
        .withColumn("_i", F.col("_s.i"))
    )
    placed = join_per_key(copied, offsets, ["chrom", "_i"], F.xxhash64("w_idx")).where(
        F.col("_k") < F.col("_made")
    )
    return placed.select(
        *bins.columns,
        ln.alias("seg_len"),
        (F.col("_k") * step).alias("seg_start"),
        (rn - F.col("_k") * step).alias("off"),
        (F.col("_first") + F.col("_k")).alias("seg_id"),
    )


def _padded(arr: Column, width: Column, fill: Column) -> Column:
    return F.concat(arr, F.array_repeat(fill, (width - F.size(arr)).cast("int")))


def pack_segments(
    rows: DataFrame,
    arrays: dict[str, Column],
    pad: bool = False,
    unit: float = 1000.0,
) -> DataFrame:
    """Arrays per segment, ordered by ``off``.

    ``arrays`` maps each array to the padding value of its items. A segment
    has a bounded number of rows, so the lists are bounded too. With ``pad``
    the arrays take the length of the longest segment and ``mask`` and
    ``length_kb`` (0 on padding) are added; start and end must be present.
    Runs one aggregate: the number of rows, which sets that of the tasks, and
    the longest segment.
    """
    names = list(arrays)
    per_segment = rows.groupBy("seg_id").agg(F.count(F.lit(1)).alias("n"))
    size = per_segment.agg(F.sum("n").alias("rows"), F.max("n").alias("longest")).first()
    # collected lists are as large as their rows, so they are not made before the shuffle
    packed = (
        rows.select("seg_id", "chrom", "off", *names).repartition(tasks_for(size["rows"] or 0), "seg_id", "chrom")
        .groupBy("seg_id", "chrom")
        .agg(F.array_sort(F.collect_list(F.struct("off", *names))).alias("_rows"))
        .select(
            "seg_id",
            "chrom",
            *[F.col("_rows").getField(n).alias(n) for n in names],
            F.size("_rows").alias("n_bins"),
        )
    )
    if not pad:
        return packed
    kb = F.zip_with(
        "start", "end", lambda s, e: F.greatest(e - s + 1, F.lit(0)) / F.lit(float(unit))
    )
    return (
        packed.withColumn("_w", F.lit(size["longest"]).cast("bigint"))
        .withColumn("length_kb", _padded(kb, F.col("_w"), F.lit(0.0)))
        .withColumn(
            "mask",
            F.transform(F.sequence(F.lit(1), F.col("_w").cast("int")), lambda i: i <= F.col("n_bins")),
        )
        .withColumns({n: _padded(F.col(n), F.col("_w"), fill) for n, fill in arrays.items()})
        .drop("_w")
    )


def _by_hash_order(df: DataFrame, keys: list[str], order: Column, tie: list[str]) -> DataFrame:
    """Number the rows of each key in a shuffled order given by ``order`` in [0, 1)."""
    cut = df.withColumn("_u", order).withColumn("_blk", F.floor(F.col("_u") * 4096).cast("int"))
    return row_index(cut, keys, "_blk", ["_u", *tie], "_rn").drop("_u", "_blk")


def split_train_val(
    segments: DataFrame,
    frac: float = 0.9,
    seed: int = 42,
    order: Column | None = None,
) -> DataFrame:
    """Add ``split``: in a shuffled order, the first int(frac * n) segments of
    each sequence are ``train``, the others ``val``. One row per segment.

    ``order`` replaces the shuffled order by a number in [0, 1).
    """
    key = md5_unit("seg_id", seed=seed) if order is None else order
    counts = segments.groupBy("chrom").agg(F.count(F.lit(1)).alias("_n"))
    ranked = _by_hash_order(segments, ["chrom"], key, ["seg_id"])
    return join_per_key(ranked, counts, ["chrom"], F.xxhash64("seg_id")).select(
        *segments.columns,
        F.when(F.col("_rn") < F.floor(F.lit(float(frac)) * F.col("_n")), "train").otherwise("val").alias("split"),
    )


def split_by_bin(bins: DataFrame, frac: float = 0.9, block: int = 100, seed: int = 42) -> DataFrame:
    """Split whole runs of ``block`` bins, so that overlapping segments do not
    carry the same bin into both parts."""
    unit = md5_unit("chrom", F.floor(F.col("w_idx") / block), seed=seed)
    return bins.withColumn("split", F.when(unit < frac, "train").otherwise("val"))


def sampler_weights(
    segments: DataFrame, tau: float, alpha: float = 0.7, beta: float = 1.0
) -> DataFrame:
    """Add ``p``, the chance of a segment in one draw: lower for a large
    residual, higher for a long segment; equal chances if that degenerates.

    Needs columns residual and len_kb.
    """
    weight = F.exp(-F.lit(float(beta)) * F.abs("residual") / F.lit(tau + 1e-8)) * F.pow(
        F.greatest("len_kb", F.lit(1e-8)), F.lit(float(alpha))
    )
    weighted = segments.withColumn("_w", weight)
    finite = ~F.isnan("_w") & (F.col("_w") != float("inf"))
    check = weighted.agg(
        F.struct(
            F.sum(F.when(finite, F.col("_w"))).alias("total"),
            F.count(F.lit(1)).alias("n"),
            F.count_if(~F.coalesce(finite, F.lit(False))).alias("bad"),
        ).alias("s")
    ).scalar()
    return (
        weighted.withColumn("_s", check)
        .withColumn(
            "p",
            F.when((F.col("_s.bad") == 0) & (F.col("_s.total") > 0), F.col("_w") / F.col("_s.total"))
            .otherwise(F.lit(1.0) / F.col("_s.n")),
        )
        .drop("_w", "_s")
    )


#: Chances are whole numbers of this many parts, so that their sums are exact in any order.
PARTS = 1 << 52
#: Segments and draws of one block, about.
DRAWS_PER_BLOCK = 100_000


def residual_sampler(
    segments: DataFrame,
    tau: float,
    alpha: float = 0.7,
    beta: float = 1.0,
    seed: int = 42,
    n_draws: int | None = None,
    per_block: int = DRAWS_PER_BLOCK,
) -> DataFrame:
    """Draw segments with replacement by ``sampler_weights``; as many draws as
    segments. Adds ``n_drawn`` and keeps the segments drawn at least once.

    By inverse cumulative weight: segments in a shuffled order cover the line
    from 0 to the total, each with a piece as long as its chance; draw i falls
    on a place made from seed and i and takes the segment there. Pieces and
    draws are merged in blocks of the line, so that neither side is held by
    one task. Segments and ``seg_id`` one to one; a chance below 2^-52 is none.
    """
    weighted = sampler_weights(segments, tau, alpha, beta).select(
        "seg_id", F.floor(F.col("p") * float(PARTS)).cast("bigint").alias("_w"), md5_unit("seg_id", seed=seed).alias("_u"))
    weighted = stage_table(weighted.where(F.col("_w") > 0), "chances")
    row = weighted.agg(F.coalesce(F.sum("_w"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n")).first()
    n = segments.count() if n_draws is None else n_draws
    if not row["n"]:
        return segments.withColumn("n_drawn", F.lit(0).cast("bigint")).limit(0)
    blocks = max(1, -(-(row["n"] + n) // per_block))
    shuffled = weighted.withColumn("_blk", F.floor(F.col("_u") * blocks).cast("int"))
    placed = running(shuffled, [], "_blk", ["_u", "seg_id"], {"_upto": ("sum", F.col("_w"))})
    pieces = placed.select((F.col("_upto") - F.col("_w")).alias("_at"), F.lit(0).alias("_kind"), "seg_id")
    total = F.lit(float(row["total"]))
    draws = weighted.sparkSession.range(n).select(
        F.floor(md5_unit(F.lit("draw"), "id", seed=seed) * total).cast("bigint").alias("_at"), F.lit(1).alias("_kind"),
        F.lit(None).cast(segments.schema["seg_id"].dataType).alias("seg_id"))
    line = pieces.unionByName(draws).withColumn("_blk", F.floor(F.col("_at") / total * blocks).cast("int"))
    start = F.when(F.col("_kind") == 0, F.struct(F.col("_at"), F.col("seg_id")))
    found = running(line, [], "_blk", ["_at", "_kind"], {"_last": ("max", start)}).where(F.col("_kind") == 1)
    counts = found.groupBy(F.col("_last.seg_id").alias("seg_id")).agg(F.count(F.lit(1)).alias("n_drawn"))
    return segments.join(counts, "seg_id").select(*segments.columns, "n_drawn")


def _batches(segments: DataFrame, batch_size: int, seed: int) -> DataFrame:
    """Add ``_batch`` and ``_place``: segments in a shuffled order, ``batch_size`` together."""
    ranked = _by_hash_order(segments, [], md5_unit("seg_id", seed=seed), ["seg_id"])
    return ranked.withColumns({
        "_batch": F.floor(F.col("_rn") / batch_size),
        "_place": F.col("_rn") % batch_size,
    }).drop("_rn")


def _with_run(paired: DataFrame, probability: float, seed: int) -> DataFrame:
    """Add ``_mix``, ``_cut`` and ``_at``: whether the batch is mixed, and the
    length and place of the run, at most half of the shorter one (``_len``)."""
    return (
        paired.withColumn("_mix", F.col("_other").isNotNull() & (md5_unit("_batch", seed=seed + 1) < probability))
        .withColumn(
            "_cut",
            1 + F.floor(md5_unit("_batch", seed=seed + 2) * F.greatest(F.floor(F.col("_len") / 2), F.lit(1))),
        )
        .withColumn("_at", F.floor(md5_unit("_batch", seed=seed + 3) * (F.col("_len") - F.col("_cut") + 1)))
    )


def swapped_runs(sizes: DataFrame, probability: float = 0.2, batch_size: int = 16, seed: int = 42) -> DataFrame:
    """(seg_id, other, at, cut): the runs that ``cutmix_pairs`` exchanges, one
    row for each segment that gives one away, without the segments themselves.

    ``sizes`` has seg_id and n_bins, one row per segment. Row ``off`` of
    segment seg_id with at <= off < at + cut goes to segment ``other``.
    """
    w = Window.partitionBy("_batch").orderBy("_place")
    here = F.struct("seg_id", "n_bins")
    other = F.when(F.col("_place") == 0, F.lead(here).over(w)).when(F.col("_place") == 1, F.lag(here).over(w))
    paired = _batches(sizes.select("seg_id", "n_bins"), batch_size, seed).withColumn("_other", other)
    placed = _with_run(paired.withColumn("_len", F.least("n_bins", "_other.n_bins")), probability, seed)
    return placed.where("_mix").select(
        "seg_id", F.col("_other.seg_id").alias("other"), F.col("_at").alias("at"), F.col("_cut").alias("cut"))


def cutmix_pairs(
    packed: DataFrame,
    arrays: list[str],
    probability: float = 0.2,
    batch_size: int = 16,
    seed: int = 42,
) -> DataFrame:
    """Exchange a random run between two segments of a batch.

    Segments fall into batches in a shuffled order. A batch is mixed with the
    given probability: its first two segments swap a run of at most half of
    the shorter one, the same run in all ``arrays``. New rows are returned;
    the input is not changed.
    """
    batched = _batches(packed, batch_size, seed)
    lengths = F.size(F.col(arrays[0]))
    # a batch has batch_size rows, so the window stays small
    w = Window.partitionBy("_batch").orderBy("_place")
    other = F.when(
        F.col("_place") == 0, F.lead(F.struct(*arrays)).over(w)
    ).when(F.col("_place") == 1, F.lag(F.struct(*arrays)).over(w))
    mixed = batched.withColumn("_other", other)
    shorter = F.least(lengths, F.size(F.col(f"_other.{arrays[0]}")))
    mixed = _with_run(mixed.withColumn("_len", shorter), probability, seed)
    at, size = F.col("_at").cast("int"), F.col("_cut").cast("int")

    def swapped(name: str) -> Column:
        own, theirs = F.col(name), F.col(f"_other.{name}")
        joined = F.concat(
            F.slice(own, F.lit(1), at),
            F.slice(theirs, at + 1, size),
            F.slice(own, at + size + 1, F.size(own)),
        )
        return F.when(F.col("_mix"), joined).otherwise(own)

    return mixed.select(
        *[c for c in packed.columns if c not in arrays],
        *[swapped(n).alias(n) for n in arrays],
        F.coalesce("_mix", F.lit(False)).alias("mixed"),
    )
