import bisect
import contextlib
import io
import itertools
import random
import re

import numpy as np
import pandas as pd
import pytest

from hotspan.operators import select as sl
from hotspan.operators.select import GRAIN, islands, predecessor, select_intervals


def plain_walk(intervals, gap):
    """The textbook solution over one sequence."""
    rows = sorted(intervals, key=lambda t: (t[1], t[0]))
    ends = [e for _, e, _ in rows]
    best, taken, before = [0.0], [], []
    for s, _, w in rows:
        k = bisect.bisect_left(ends, s - gap)
        before.append(k)
        taken.append(w + best[k] > best[-1])
        best.append(max(best[-1], w + best[k]))
    out, i = [], len(rows)
    while i:
        if taken[i - 1]:
            out.append(rows[i - 1][:2])
            i = before[i - 1]
        else:
            i -= 1
    return sorted(out), best[-1]


def rounded(w):
    return max(float(int(w * GRAIN + 0.5)), 1.0) / GRAIN


def random_sequences(seed, n):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        length, span = rng.choice([50, 300, 1000]), rng.choice([3, 10, 30])
        intervals = {}
        for _ in range(rng.randint(1, 120)):
            s = rng.randint(0, length)
            # whole weights make ties common
            intervals[(s, s + rng.randint(0, span))] = float(rng.randint(1, 6)) if c % 2 else rng.random() * 5
        out[f"chr{c}"] = [(s, e, w) for (s, e), w in intervals.items()]
    return out


def frame(spark, sequences):
    rows = [(c, s, e, w) for c, ivs in sequences.items() for s, e, w in ivs]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["chrom", "start_bp", "end_bp", "LLR_weighted"]))


@pytest.mark.parametrize("gap,block,fan", [(0, None, 64), (2, 50, 3), (0, None, 2), (5, 5000, 64), (1, 7, 8)])
def test_equals_plain_walk(spark, gap, block, fan):
    sequences = random_sequences(1, 24)
    got = select_intervals(frame(spark, sequences), gap_bp=gap, block_bp=block, fan=fan).toPandas()
    for c, ivs in sequences.items():
        want, total = plain_walk([(s, e, rounded(w)) for s, e, w in ivs], gap)
        mine = got[got.chrom == c]
        assert sorted(zip(mine.start_bp, mine.end_bp)) == want
        assert mine.weight.sum() == pytest.approx(total)


def test_equals_all_subsets(spark):
    rng = random.Random(5)
    sequences = {
        f"chr{c}": [(s := rng.randint(0, 30), s + rng.randint(0, 8), rng.random()) for _ in range(9)]
        for c in range(12)
    }
    got = select_intervals(frame(spark, sequences), gap_bp=1).toPandas()
    for c, ivs in sequences.items():
        best = 0.0
        for size in range(len(ivs) + 1):
            for subset in itertools.combinations(sorted(ivs), size):
                if all(a[1] + 1 < b[0] for a, b in zip(subset, subset[1:])):
                    best = max(best, sum(w for _, _, w in subset))
        mine = got[got.chrom == c].sort_values("start_bp")
        assert mine.weight.sum() == pytest.approx(best)
        assert all(e + 1 < s for e, s in zip(mine.end_bp, mine.start_bp[1:]))


def with_long_rows(seed, n):
    """Sequences of short intervals and a few that reach over many of them or over all."""
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        intervals = {(s := rng.randint(0, 400), s + rng.randint(0, 6)): float(rng.randint(1, 4)) for _ in range(80)}
        for _ in range(rng.randint(1, 12)):
            s, e = sorted(rng.sample(range(420), 2))
            # light, heavy and equal to what lies inside
            inside = plain_walk([(a, b, w) for (a, b), w in intervals.items() if s <= a and b <= e], 0)[1]
            intervals[(s, e)] = max(1.0, inside + rng.choice([-20.0, -1.0, 0.0, 0.0, 1.0, 3.0, 30.0]))
        intervals[(0, 430)] = float(rng.choice([1, 60, 400]))
        out[f"chr{c}"] = [(s, e, w) for (s, e), w in intervals.items()]
    return out


@pytest.mark.parametrize("gap,block,fan", [(0, None, 64), (2, 8, 6)])
def test_intervals_longer_than_blocks(spark, gap, block, fan):
    sequences = with_long_rows(11, 20)
    got = select_intervals(frame(spark, sequences), gap_bp=gap, block_bp=block, fan=fan).toPandas()
    for c, ivs in sequences.items():
        want, total = plain_walk(ivs, gap)
        mine = got[got.chrom == c]
        assert mine.weight.sum() == pytest.approx(total)
        assert sorted(zip(mine.start_bp, mine.end_bp)) == want


def test_one_long_interval_leaves_the_blocks_small(spark):
    from hotspan.operators import select

    rows = [("a", 10 * i, 10 * i + 8, 1.0) for i in range(5000)]
    whole = ("a", 0, 60_000, 40.0)
    names = "chrom string, start_bp bigint, end_bp bigint, LLR_weighted double"
    df = spark.createDataFrame([*rows, whole], names)
    width = select._block_width(df, 0)
    assert width < 100
    assert select_intervals(df).count() == 5000
    blocked = df.selectExpr("chrom", f"floor(start_bp / {width}) AS blk", "start_bp", "end_bp", "LLR_weighted AS w")
    assert select._passing(blocked, width, 0).count() == 0  # lighter than what it covers
    heavy = spark.createDataFrame([*rows, (*whole[:3], 5000.5)], names)
    assert [tuple(r) for r in select_intervals(heavy).collect()] == [("a", 0, 60_000, 5000.5)]


def test_known_case_and_carried_columns(spark):
    df = spark.createDataFrame(
        [("a", 1, 10, 5.0, 7.0), ("a", 5, 15, 6.0, 8.0), ("a", 16, 20, 3.0, 9.0), ("a", 30, 40, 0.0, 1.0)],
        "chrom string, start_bp bigint, end_bp bigint, LLR_weighted double, note double",
    )
    def run(gap):
        rows = select_intervals(df, gap_bp=gap, carry=["note"]).orderBy("start_bp").collect()
        return [(r.start_bp, r.end_bp, r.weight, r.note) for r in rows]
    assert run(0) == [(5, 15, 6.0, 8.0), (16, 20, 3.0, 9.0)]
    assert run(1) == [(1, 10, 5.0, 7.0), (16, 20, 3.0, 9.0)]


def test_nothing_to_select(spark):
    df = spark.createDataFrame([("a", 1, 2, 0.0)], "chrom string, start_bp bigint, end_bp bigint, LLR_weighted double")
    assert select_intervals(df).count() == 0
    assert select_intervals(df.limit(0)).count() == 0


@pytest.mark.parametrize("gap", [0, 3])
def test_islands(spark, gap):
    sequences = random_sequences(3, 8)
    got = islands(frame(spark, sequences), gap, block_bp=40).toPandas()
    for c, ivs in sequences.items():
        want, number, far = {}, -1, None
        for s, e, _ in sorted(ivs):
            if far is None or far + gap < s:
                number += 1
            far = e if far is None else max(far, e)
            want[(s, e)] = number
        mine = got[got.chrom == c]
        assert dict(zip(zip(mine.start_bp, mine.end_bp), mine.island)) == want


@pytest.mark.parametrize("gap", [0, 4])
def test_predecessor(spark, gap):
    sequences = random_sequences(4, 8)
    got = predecessor(frame(spark, sequences), gap, block_bp=25).toPandas()
    for c, ivs in sequences.items():
        for r in got[got.chrom == c].itertuples():
            before = [(e, s) for s, e, _ in ivs if e + gap < r.start_bp]
            if before:
                assert (r.pred_end, r.pred_start) == max(before)
            else:
                assert pd.isna(r.pred_end) and pd.isna(r.pred_start)


def test_pruning_is_the_same_in_strips(monkeypatch):
    from hotspan.operators import select

    rng = np.random.default_rng(8)
    s = rng.integers(0, 60, 400)
    e, w = s + rng.integers(1, 40, 400), rng.random(400).round(1)
    want = [not ((s >= a) & (e <= b) & (w > c)).any() for a, b, c in zip(s, e, w)]
    assert select._undominated(s, e, w).tolist() == want
    monkeypatch.setattr(select, "STRIP_CELLS", 150)
    assert select._undominated(s, e, w).tolist() == want


def test_tasks_of_predecessor_follow_the_intervals(spark, monkeypatch):
    monkeypatch.setattr(sl, "tasks_for", lambda rows: -(-rows // 10))
    rows = [("a", 5 * i, 5 * i + 3) for i in range(100)]
    found = predecessor(spark.createDataFrame(rows, "chrom string, start_bp long, end_bp long"))
    with contextlib.redirect_stdout(io.StringIO()) as out:
        found.explain()
    widths = re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", out.getvalue())
    assert widths and set(widths) == {"20"}
    assert {r["start_bp"]: r["pred_end"] for r in found.collect()} == {5 * i: 5 * i - 2 if i else None for i in range(100)}
