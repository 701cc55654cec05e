import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hotspan.operators.scan import (
    chunk_windows,
    per_bin,
    prefix_sums,
    sample_scores,
    scan_input,
    scan_partitions,
    scan_pairs,
    scan_summary,
)


def random_bins(seed, sequences=4, n=60, regular=False):
    rng = random.Random(seed)
    rows = []
    for c in range(sequences):
        at = rng.randint(0, 50)
        for _ in range(n):
            size = 10 if regular else rng.randint(3, 15)
            rows.append((f"chr{c}", at, at + size - 1, rng.random(), float(rng.randint(0, 3)), size / 1000))
            at += size + (0 if regular else rng.choice([0, 0, 4, 40]))
    return rows


def as_frame(spark, rows):
    return spark.createDataFrame(
        pd.DataFrame(rows, columns=["chrom", "start", "end", "lam", "obs", "kb"])
    ).withColumn("lam", F.col("lam") * 100)


def nested_loop(rows, max_bp, min_bp=0):
    out = {}
    for c in {r[0] for r in rows}:
        seq = sorted(r for r in rows if r[0] == c)
        for i in range(len(seq)):
            y = e = 0.0
            for j in range(i, len(seq)):
                y += seq[j][4]
                e += seq[j][3] * 100 * seq[j][5]
                span = seq[j][2] - seq[i][1]
                if span <= max_bp and span + 1 >= min_bp and y > e and e > 1e-12:
                    a = (y + 1) / (e + 1)
                    out[(c, seq[i][1], seq[j][2])] = y * math.log(a) + (1 - a) * e
    return out


@pytest.mark.parametrize("max_bp,min_bp,parts", [(60, 0, None), (200, 25, 3), (7, 0, None), (5000, 0, 5)])
def test_equals_nested_loop(spark, max_bp, min_bp, parts):
    rows = random_bins(7)
    got = scan_pairs(as_frame(spark, rows), max_bp, min_bp, partitions=parts).toPandas()
    want = nested_loop(rows, max_bp, min_bp)
    mine = {(r.chrom, r.start_bp, r.end_bp): r.LLR_raw for r in got.itertuples()}
    assert len(mine) == len(got)
    assert mine.keys() == want.keys()
    assert all(mine[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def tiles_of(seq, width, overlap):
    at, out = seq[0][1], []
    while at <= max(r[2] for r in seq):
        out.append({r[1] for r in seq if r[2] >= at and r[1] <= at + width - 1})
        at += width - overlap
    return out


@pytest.mark.parametrize("width,overlap", [(300, 80), (100, 20)])
def test_tiles(spark, width, overlap):
    rows = random_bins(8, regular=True)
    bins, max_bp = as_frame(spark, rows), 80
    full = scan_pairs(bins, max_bp).select("chrom", "start_bp", "end_bp").toPandas()
    tiled = scan_pairs(bins, max_bp, tiles=(width, overlap)).select("chrom", "start_bp", "end_bp").toPandas()
    copies = scan_pairs(bins, max_bp, tiles=(width, overlap), repeat=True).groupBy(
        "chrom", "start_bp", "end_bp").count().toPandas()
    want = {}
    for c in {r[0] for r in rows}:
        seq = sorted(r for r in rows if r[0] == c)
        for tile in tiles_of(seq, width, overlap):
            for r in full[full.chrom == c].itertuples():
                if r.start_bp in tile and r.end_bp - 9 in tile:
                    key = (c, r.start_bp, r.end_bp)
                    want[key] = want.get(key, 0) + 1
    assert {tuple(r) for r in tiled.itertuples(index=False)} == set(want)
    assert {(r.chrom, r.start_bp, r.end_bp): r.count for r in copies.itertuples(index=False)}.keys() == want.keys()
    assert dict(zip(zip(copies.chrom, copies.start_bp, copies.end_bp), copies["count"])) == want
    if overlap >= max_bp:
        assert len(tiled) == len(full)
    else:
        assert len(tiled) < len(full)


def test_chunk_windows(spark):
    rows = random_bins(9)
    got = chunk_windows(as_frame(spark, rows), 100, 30).toPandas()
    for c in {r[0] for r in rows}:
        seq = sorted(r for r in rows if r[0] == c)
        for k, tile in enumerate(tiles_of(seq, 100, 30)):
            assert set(got[(got.chrom == c) & (got.tile == k)].start) == tile
    with pytest.raises(ValueError):
        chunk_windows(as_frame(spark, rows), 100, 100)


def test_prefix_sums_cross_blocks(spark):
    rows = random_bins(10)
    got = prefix_sums(as_frame(spark, rows), block_bp=70).toPandas()
    for c in {r[0] for r in rows}:
        mine = got[got.chrom == c].sort_values("start")
        assert mine.cum_obs.to_numpy() == pytest.approx(np.cumsum(mine.obs.to_numpy()))
        mu = (mine.lam * mine.kb).to_numpy()
        assert mine.pre_exp.to_numpy() + mu == pytest.approx(np.cumsum(mu))


def test_per_bin_skips_missing(spark):
    nan = math.nan
    df = spark.createDataFrame(
        [("a", 1, 9, 2.0, None, 3), ("a", 1, 9, nan, 4.0, 1), ("a", 1, 9, 4.0, 4.0, 2), ("b", 1, 9, 1.0, nan, 1)],
        "chrom string, start bigint, end bigint, lam_pred double, obs_count double, line int",
    )
    for order in (None, "line"):
        rows = {r.chrom: (r.lam_pred, r.obs_count) for r in per_bin(df, order).collect()}
        assert rows == {"a": (3.0, 4.0), "b": (1.0, None)}
    clean = {r.chrom: (r.lam, r.obs, r.kb) for r in scan_input(per_bin(df)).collect()}
    assert clean["b"] == (1.0, 0.0, 0.009)


def test_sampling_is_repeatable(spark):
    pairs = scan_pairs(as_frame(spark, random_bins(11, n=200)), 200)
    one, two = (sorted(r.score for r in sample_scores(pairs, 0.2, seed=3).collect()) for _ in range(2))
    total = scan_summary(pairs).agg(F.sum("n_pos")).first()[0]
    assert one == two
    assert 0.1 * total < len(one) < 0.3 * total


def test_plan_is_an_equi_join(spark):
    # from a file, so that the plan is that of a real table
    bins = as_frame(spark, random_bins(12))
    path = spark.sparkContext.getCheckpointDir() + "/plan_bins"
    bins.write.mode("overwrite").parquet(path)
    source = spark.read.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scan_pairs(source, 60, partitions=scan_partitions(source, 60))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "SortMergeJoin [chrom" in plan
