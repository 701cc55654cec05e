"""Choosing the heaviest set of intervals that do not overlap.

The textbook solution walks over all intervals of a sequence in order of
their end. Here a sequence is cut into blocks, and an interval belongs to the
block it starts in:

1. each block turns into a table ``gain[i, j]``: the best weight between
   entering free at its i-th place and leaving free at its j-th exit. Places
   are the block's starts and its border; exits are the border and the ends
   beyond it. The end of an interval that passes over whole blocks is a place
   and an exit of each of them, so no block has to be as wide as the longest
   interval;
2. tables of neighbours combine (max-plus product) in groups of ``FAN``,
   level by level, and the values on entry run back down the same levels;
3. each block then knows, for every place where its successor may begin, where
   its own choice begins; these maps combine backwards in the same way;
4. each block picks its intervals.

No task ever sees more than one block, or ``FAN`` tables of one level.

Weights are rounded to multiples of 2^-30, which makes their sums exact: the
result does not depend on the blocks. Among equal totals the choice is that
of the plain walk: smallest end first, then smallest start.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hotspan.operators.ordered import running, tasks_for
from hotspan.session import stage_table

FAN = 64
GRAIN = float(1 << 30)
BIG = 1 << 62
#: Cells that the pruning of a block holds at once.
STRIP_CELLS = 1_000_000
COLUMNS = 256
BLOCKS_PER_TASK = 5_000
#: An interval of this weight or more is never left out for others.
MOST_WEIGHT = float(1 << 32)


# --- one block -------------------------------------------------------------

def _undominated(s: np.ndarray, e: np.ndarray, w: np.ndarray) -> np.ndarray:
    """False where an interval contains a strictly heavier one: replacing it
    by that one always gains, so it is in no best set."""
    starts, i = np.unique(s, return_inverse=True)
    ends, j = np.unique(e, return_inverse=True)
    order = np.argsort(-i, kind="stable")
    strip = max(1, STRIP_CELLS // len(ends))
    later, keep, at = np.full(len(ends), -np.inf), np.zeros(len(s), bool), 0
    for top in range(len(starts), 0, -strip):  # from the last starts to the first
        low = max(0, top - strip)
        stop = at + int(np.searchsorted(-i[order[at:]], -low, side="right"))
        rows, at = order[at:stop], stop
        heaviest = np.full((top - low, len(ends)), -np.inf)
        np.maximum.at(heaviest, (i[rows] - low, j[rows]), w[rows])
        inside = np.maximum(np.maximum.accumulate(heaviest[::-1], axis=0)[::-1], later)
        later = inside[0]
        keep[rows] = np.maximum.accumulate(inside, axis=1)[i[rows] - low, j[rows]] <= w[rows]
    return keep


def _gain(s: np.ndarray, u: np.ndarray, w: np.ndarray, border: int, passing: np.ndarray):
    """Entries, exits and the best weight between them. ``u`` is the first
    position free after an interval; rows are in order of (u, s). ``passing``
    holds such positions beyond the border of intervals from earlier blocks."""
    starts, first = np.unique(s, return_inverse=True)
    late = np.r_[border, passing]
    nodes, begin = np.unique(u, return_index=True)
    stop = np.append(begin[1:], len(u))
    before = np.searchsorted(nodes, s, side="right")
    outs = np.union1d(late, nodes[nodes > border])
    rows = np.searchsorted(nodes, outs, side="right")
    parts = []
    for lo in range(0, len(starts), COLUMNS):
        entry = np.arange(lo, min(lo + COLUMNS, len(starts)))
        best = np.zeros((len(nodes) + 1, len(entry)))
        for k in range(len(nodes)):
            rng = slice(begin[k], stop[k])
            total = w[rng, None] + best[before[rng]]
            total[entry[None, :] > first[rng, None]] = -np.inf
            np.maximum(best[k], total.max(axis=0), out=best[k + 1])
        parts.append(best[rows].T)
    parts.append(np.where(outs[None, :] >= late[:, None], 0.0, -np.inf))  # entered after all starts
    return np.r_[starts, late], outs, np.concatenate(parts)


class _Walk:
    """Best totals of one block, given the totals on entry."""

    def __init__(self, s, u, w, at, val):
        self.s = s
        self.coords = np.unique(np.concatenate([at, u]))
        here = np.searchsorted(self.coords, u)
        before = np.searchsorted(self.coords, s, side="right") - 1
        entry = dict(zip(np.searchsorted(self.coords, at).tolist(), val.tolist()))
        best = np.full(len(self.coords), -np.inf)
        self.found = np.zeros(len(self.coords), np.int64)
        self.pick = np.full(len(self.coords), -1, np.int64)
        j, n = 0, len(u)
        for k in range(len(self.coords)):
            top, found = (best[k - 1], self.found[k - 1]) if k else (-np.inf, 0)
            if entry.get(k, -np.inf) > top:
                top, found = entry[k], k
            while j < n and here[j] == k:
                total = w[j] + best[before[j]]
                if total > top:
                    top, found, self.pick[k] = total, k, j
                j += 1
            best[k], self.found[k] = top, found

    def chosen(self, limit: int) -> list[int]:
        """Picked intervals, last one first, when all must be free at ``limit``."""
        out = []
        while True:
            k = int(np.searchsorted(self.coords, limit, side="right")) - 1
            j = int(self.pick[self.found[k]]) if k >= 0 else -1
            if j < 0:
                return out
            out.append(j)
            limit = int(self.s[j])


# --- combining blocks ------------------------------------------------------

def _table(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ins, outs = np.asarray(row.ins), np.asarray(row.outs)
    return ins, outs, np.asarray(row.gain).reshape(len(ins), len(outs))


def _at_entries(ins: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which exit of the block before is the last one free at each entry."""
    return np.searchsorted(at, ins, side="right") - 1


def _join_gains(a, b):
    ins, at, left = a
    ins2, outs, right = b
    left = left[:, _at_entries(ins2, at)]
    both = left[:, :1] + right[:1]
    for j in range(1, left.shape[1]):
        np.maximum(both, left[:, j:j + 1] + right[j:j + 1], out=both)
    return ins, outs, both - both[0, 0]


def _combine_gains(pdf: pd.DataFrame) -> dict:
    rows = [_table(r) for r in pdf.sort_values("blk").itertuples()]
    total = rows[0]
    for row in rows[1:]:
        total = _join_gains(total, row)
    return {"ins": total[0], "outs": total[1], "gain": total[2].ravel()}


def _entry_values(pdf: pd.DataFrame, seeded: bool) -> list[dict]:
    rows = list(pdf.sort_values("blk").itertuples())
    at, val = np.array([-BIG]), np.array([0.0])
    if seeded:
        at, val = np.asarray(rows[0].seed_at), np.asarray(rows[0].seed_val)
    out = []
    for row in rows:
        out.append({"blk": row.blk, "at": at, "val": val})
        ins, outs, gain = _table(row)
        total = (val[_at_entries(ins, at)][:, None] + gain).max(axis=0)
        at, val = outs, total - total[0]
    return out


def _step_back(outs, begins, limit):
    """Where the choice of a block begins when its successor begins at ``limit``."""
    return np.asarray(begins)[np.searchsorted(np.asarray(outs), limit, side="right") - 1]


def _combine_begins(pdf: pd.DataFrame) -> dict:
    rows = list(pdf.sort_values("blk", ascending=False).itertuples())
    begins = np.asarray(rows[0].begins)
    for row in rows[1:]:
        begins = _step_back(row.outs, row.begins, begins)
    return {"outs": np.asarray(rows[0].outs), "begins": begins}


def _limits(pdf: pd.DataFrame, seeded: bool) -> list[dict]:
    rows = list(pdf.sort_values("blk", ascending=False).itertuples())
    limit = int(rows[0].seed_limit) if seeded else BIG
    out = []
    for row in rows:
        out.append({"blk": row.blk, "limit": limit})
        limit = int(_step_back(row.outs, row.begins, limit))
    return out


def _sweep(
    table: DataFrame,
    span: int,
    fan: int,
    fields: str,
    combine: Callable[[pd.DataFrame], dict],
    state: list[str],
    state_fields: str,
    spread: Callable[[pd.DataFrame, bool], list[dict]],
) -> DataFrame:
    """State of every block: up the levels with ``combine``, down with ``spread``."""
    def up(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"chrom": pdf["chrom"].iloc[0], "blk": pdf["grp"].iloc[0], **combine(pdf)}
        return pd.DataFrame({k: [v] for k, v in row.items()})

    def down(seeded: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = spread(pdf, seeded)
            return pd.DataFrame({
                "chrom": pdf["chrom"].iloc[0], **{c: [r[c] for r in rows] for c in ["blk", *state]}
            })
        return run

    grouped = F.floor(F.col("blk") / fan).alias("grp")
    levels = [table]
    while span > fan:
        lower = levels[-1].select("*", grouped)
        upper = lower.groupBy("chrom", "grp").applyInPandas(up, f"chrom string, blk bigint, {fields}")
        levels.append(stage_table(upper, "level"))
        span = (span - 2 + fan) // fan + 1
    out = f"chrom string, blk bigint, {state_fields}"
    current = levels[-1].groupBy("chrom").applyInPandas(down(False), out)
    for lower in reversed(levels[:-1]):
        seeds = current.select("chrom", F.col("blk").alias("grp"), *[F.col(c).alias(f"seed_{c}") for c in state])
        joined = lower.select("*", grouped).join(seeds, ["chrom", "grp"])
        current = joined.groupBy("chrom", "grp").applyInPandas(down(True), out)
    return current


# --- the operator ----------------------------------------------------------

def _block_width(intervals: DataFrame, gap_bp: int) -> int:
    """Twice the mean span, or the longest span if that is less: intervals pass
    over half as many whole blocks as there are intervals at most, whatever the
    longest one is."""
    span = F.greatest(F.col("end_bp") - F.col("start_bp"), F.lit(0))
    row = intervals.agg(F.max(span).alias("most"), F.avg(span).alias("mean")).first()
    return int(min(row["most"] or 0, 2 * math.ceil(row["mean"] or 0))) + gap_bp


def _passing(blocked: DataFrame, width: int, gap_bp: int) -> DataFrame:
    """(chrom, blk, free): the first free places after intervals that reach over
    the whole next block, in their own block and in all that they pass over.

    An interval is left out when the heaviest intervals that lie within the
    blocks it passes over are heavier together: they can always take its
    place. Their total is one difference of running totals.
    """
    w, free = F.col("w"), F.col("end_bp") + (gap_bp + 1)
    units = F.greatest(F.floor(F.least(w, F.lit(MOST_WEIGHT)) * GRAIN + 0.5), F.lit(1))
    used = blocked.where((w > 0) & ~F.isnan(w)).select(
        "chrom", "blk", free.alias("free"), (F.ceil(free / width) - 2).alias("last"),
        units.cast("decimal(38,0)").alias("units"), (w >= MOST_WEIGHT).alias("sure"))
    far = stage_table(
        used.where(F.col("last") > F.col("blk")).groupBy("chrom", "blk", "free", "last")
        .agg(F.max("units").alias("units"), F.max("sure").alias("sure")), "far")
    # free at the border of its block: one of each block go together
    tops = used.where(F.col("free") <= (F.col("blk") + 1) * width).groupBy("chrom", "blk").agg(F.max("units").alias("top"))
    stream = tops.select("chrom", F.col("blk").alias("at"), F.lit(0).alias("turn"), "top")
    for turn, at in ((1, "blk"), (2, "last")):
        asked = far.select("chrom", F.col(at).alias("at"), F.lit(turn).alias("turn"), "blk", "free", "last", "units", "sure")
        stream = stream.unionByName(asked, allowMissingColumns=True)
    stream = stream.withColumn("part", F.floor(F.col("at") / BLOCKS_PER_TASK))
    here = F.coalesce("top", F.lit(0).cast("decimal(38,0)"))
    summed = running(stream, ["chrom"], "part", ["at", "turn"], {"upto": ("sum", here)}).where("turn > 0")
    inner = F.sum(F.when(F.col("turn") == 2, F.col("upto")).otherwise(-F.col("upto")))
    kept = summed.groupBy("chrom", "blk", "free", "last").agg(
        F.max("units").alias("units"), F.max("sure").alias("sure"), inner.alias("inner")
    ).where(F.col("sure") | (F.col("inner") <= F.col("units")))
    return kept.select("chrom", F.explode(F.sequence("blk", "last")).alias("blk"), "free").distinct()


def select_intervals(
    intervals: DataFrame,
    weight: str = "LLR_weighted",
    gap_bp: int = 0,
    max_span: int | None = None,
    carry: list[str] | None = None,
    bucket: tuple[str, int] | None = None,
    block_bp: int | None = None,
    fan: int = FAN,
) -> DataFrame:
    """The set of intervals per sequence with the largest total weight in which
    each ends more than ``gap_bp`` before the next starts.

    ``max_span`` bounds end_bp - start_bp if that is known, which makes blocks
    as wide as that; otherwise blocks are ``block_bp`` wide, or follow the mean
    span, and may be narrower than an interval. ``bucket`` = (column, width)
    names an existing cut of start_bp to reuse when it is wide enough, which
    saves a shuffle of the intervals. Numeric columns in ``carry`` come along.
    Rows without a positive weight are never chosen.
    """
    carry = carry or []
    if gap_bp < 0:
        raise ValueError("the gap cannot be negative")
    need = None if max_span is None else max_span + gap_bp
    if bucket and need is not None and bucket[1] >= need and block_bp is None:
        column, width = bucket
        blocked = intervals.withColumnRenamed(column, "blk")
    else:
        if need is None and block_bp is None:
            width = max(_block_width(intervals, gap_bp), 1)
        else:
            width = max(need or 0, block_bp or 1, 1)
        blocked = intervals.withColumn("blk", F.floor(F.col("start_bp") / width))
    blocked = blocked.select(
        "chrom", "blk", "start_bp", "end_bp", F.col(weight).cast("double").alias("w"),
        *[F.col(c).cast("double") for c in carry],
    )
    if need is None:
        # one more row for each place that an interval passes, without a weight
        blocked = blocked.withColumn("free", F.lit(None).cast("bigint")).unionByName(
            _passing(blocked, width, gap_bp), allowMissingColumns=True)

    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    packed_schema = pa.schema([
        ("chrom", pa.string()), ("blk", pa.int64()), ("s", longs), ("e", longs), ("w", doubles),
        ("ins", longs), ("outs", longs), ("gain", doubles), *[(f"c{i}", doubles) for i in range(len(carry))],
    ])

    def pack(rows: pa.Table) -> pa.Table:
        # weights are tested here and not in a Spark filter: pushed down, the
        # filter would repeat the whole expression of the weight
        s, e, w = (rows.column(c).to_numpy() for c in ("start_bp", "end_bp", "w"))
        use = np.flatnonzero(w > 0)
        if not len(use):
            return packed_schema.empty_table()
        blk, passing = rows.column("blk")[0].as_py(), np.zeros(0, np.int64)
        if need is None:
            passing = np.unique(rows.column("free").drop_null().to_numpy())
            s, e = (np.where(w > 0, x, 0).astype(np.int64) for x in (s, e))
            free = e[use] + gap_bp + 1
            use = use[(free <= (blk + 2) * width) | np.isin(free, passing)]
            if not len(use):
                return packed_schema.empty_table()
        w = np.maximum(np.floor(w * GRAIN + 0.5), 1.0) / GRAIN
        use = use[_undominated(s[use], e[use], w[use])]
        use = use[np.lexsort((s[use], e[use]))]
        s, e, w = s[use], e[use], w[use]
        ins, outs, gain = _gain(s, e + gap_bp + 1, w, (blk + 1) * width, passing)
        extra = [rows.column(c).to_numpy()[use] for c in carry]
        return pa.Table.from_arrays(
            [pa.array([rows.column("chrom")[0].as_py()]), pa.array([blk], pa.int64()),
             *[pa.array([v], f.type) for v, f in
               zip([s, e, w, ins, outs, gain.ravel(), *extra], list(packed_schema)[2:])]],
            schema=packed_schema,
        )

    carried = "".join(f", c{i} array<double>" for i in range(len(carry)))
    packed = stage_table(
        blocked.groupBy("chrom", "blk").applyInArrow(
            pack,
            "chrom string, blk bigint, s array<bigint>, e array<bigint>, w array<double>, "
            f"ins array<bigint>, outs array<bigint>, gain array<double>{carried}",
        ),
        "blocks",
    )
    extent = packed.groupBy("chrom").agg(
        (F.max("blk") - F.min("blk") + 1).alias("span"), F.count(F.lit(1)).alias("n")
    ).agg(F.max("span").alias("span"), F.sum("n").alias("n")).first()
    span = extent["span"] or 0
    cores = intervals.sparkSession.sparkContext.defaultParallelism
    tasks = max(cores, math.ceil((extent["n"] or 0) / BLOCKS_PER_TASK))
    entries = _sweep(
        packed.select("chrom", "blk", "ins", "outs", "gain"), span, fan,
        "ins array<bigint>, outs array<bigint>, gain array<double>", _combine_gains,
        ["at", "val"], "at array<bigint>, val array<double>", _entry_values,
    )
    # a block is few bytes but much work, so the number of tasks is set here
    ready = stage_table(
        packed.drop("ins", "gain").join(entries, ["chrom", "blk"]).repartition(tasks, "chrom", "blk"), "ready"
    )

    def walk(row) -> _Walk:
        s, e = np.asarray(row.s), np.asarray(row.e)
        return _Walk(s, e + gap_bp + 1, np.asarray(row.w), np.asarray(row.at), np.asarray(row.val))

    def begins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples():
                best = walk(row)
                picks = [best.chosen(int(x)) for x in row.outs]
                # without a choice the block before has to be free at the same exit
                rows.append([int(best.s[p[-1]]) if p else int(x) for p, x in zip(picks, row.outs)])
            yield pd.DataFrame({"chrom": pdf["chrom"], "blk": pdf["blk"], "outs": pdf["outs"], "begins": rows})

    fields = "outs array<bigint>, begins array<bigint>"
    maps = ready.select("chrom", "blk", "s", "e", "w", "at", "val", "outs").mapInPandas(
        begins, f"chrom string, blk bigint, {fields}"
    )
    if span > fan:
        maps = stage_table(maps, "begins")
    limits = _sweep(
        maps, span, fan, fields, _combine_begins, ["limit"], "limit bigint", _limits
    )

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source = {"start_bp": "s", "end_bp": "e", "weight": "w", **{c: f"c{i}" for i, c in enumerate(carry)}}
        for pdf in batches:
            picks = [(row, walk(row).chosen(int(row.limit))) for row in pdf.itertuples()]
            if not picks:
                continue
            yield pd.DataFrame({
                "chrom": np.repeat(pdf["chrom"].to_numpy(), [len(p) for _, p in picks]),
                **{name: np.concatenate([np.asarray(getattr(row, c))[p] for row, p in picks])
                   for name, c in source.items()},
            })

    out = "chrom string, start_bp bigint, end_bp bigint, weight double" + "".join(
        f", `{c}` double" for c in carry
    )
    return ready.join(limits, ["chrom", "blk"]).mapInPandas(choose, out)


# --- islands and predecessors ----------------------------------------------

def islands(intervals: DataFrame, gap_bp: int = 0, block_bp: int = 10_000_000) -> DataFrame:
    """Add ``island``: the number, from 0 along each sequence, of the group of
    intervals linked by overlap (or a distance of at most ``gap_bp``).

    Only the furthest end per start matters, so the intervals are first
    reduced to one row per start.
    """
    reach = (
        intervals.groupBy("chrom", "start_bp").agg(F.max("end_bp").alias("reach"))
        .withColumn("_blk", F.floor(F.col("start_bp") / block_bp))
    )
    seen = running(
        reach, ["chrom"], "_blk", ["start_bp"], {"_far": ("max", F.col("reach"))}, inclusive=False
    )
    opened = seen.withColumn(
        "_new", (F.col("_far").isNotNull() & (F.col("_far") + gap_bp < F.col("start_bp"))).cast("bigint")
    )
    numbered = running(opened, ["chrom"], "_blk", ["start_bp"], {"island": ("sum", F.col("_new"))})
    return intervals.join(numbered.select("chrom", "start_bp", "island"), ["chrom", "start_bp"])


def predecessor(intervals: DataFrame, gap_bp: int = 0, block_bp: int = 1_000_000) -> DataFrame:
    """Add pred_start and pred_end: of the intervals with end + gap < start,
    the last in order of (end, start); null if there is none.

    Ends and starts are merged into one ordered stream per sequence, and the
    latest end is carried along it block by block. The intervals are counted
    first: the number of tasks follows them.
    """
    tasks = tasks_for(2 * intervals.count())
    ends = intervals.select("chrom", "end_bp", "start_bp").repartition(tasks, "chrom", "end_bp").groupBy(
        "chrom", "end_bp").agg(F.max("start_bp").alias("s")).select(
        "chrom", (F.col("end_bp") + gap_bp + 1).alias("at"), F.lit(0).alias("kind"),
        F.struct(F.col("end_bp").alias("e"), F.col("s")).alias("last"),
    )
    asks = intervals.select("chrom", F.col("start_bp").alias("at")).repartition(tasks, "chrom", "at").distinct().select(
        "chrom", "at", F.lit(1).alias("kind"), F.lit(None).cast(T.StructType([
            T.StructField("e", T.LongType()), T.StructField("s", T.LongType())])).alias("last"),
    )
    stream = ends.unionByName(asks).withColumn("_blk", F.floor(F.col("at") / block_bp))
    dealt = stream.repartition(tasks, "chrom", "_blk")
    carried = running(dealt, ["chrom"], "_blk", ["at", "kind"], {"found": ("max", F.col("last"))})
    answers = carried.where(F.col("kind") == 1).select(
        "chrom", F.col("at").alias("start_bp"), F.col("found.s").alias("pred_start"), F.col("found.e").alias("pred_end")
    )
    keys = ["chrom", "start_bp"]
    return intervals.repartition(tasks, *keys).join(answers.repartition(tasks, *keys), keys)
