import math

import pytest
from pyspark.sql import functions as F

from hotspan import functions as fn
from hotspan.functions.tail import Mixture, mixture_tail
from hotspan.functions.vectors import layer_norm


def column(spark, values, kind, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_norm_chrom(spark):
    raw = [" 1", "CHRx", "mt", "chr11_random", "GL0001", "chr01", "Chr_Un", "\tm\n", None]
    want = ["chr1", "chrX", "chrM", "chr11_random", "chrGL0001", "chr01", "Chr_Un", "chrM", None]
    assert column(spark, raw, "string", fn.norm_chrom("x")) == want


def test_chrom_order_and_id(spark):
    names = ["chrY", "chr10", "chrUn", "chr2", "chrM", "chrX", "GL1"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    ordered = [r.c for r in df.orderBy(fn.chrom_sort_key("c")).collect()]
    assert ordered == ["chr2", "chr10", "chrX", "chrY", "chrM", "GL1", "chrUn"]
    ids = {r.c: r.i for r in df.select("c", fn.chrom_id("c").alias("i")).collect()}
    assert ids == {"chr2": 1, "chr10": 9, "chrX": 22, "chrY": 23, "chrM": 0, "chrUn": 0, "GL1": 0}


def test_pass_filter(spark):
    raw = ["PASS", ".", "q10;pass", "LowQ", None]
    assert column(spark, raw, "string", fn.pass_filter("x")) == [True, True, True, False, False]


def test_norm_event_type(spark):
    raw = ["BND", "DUP;INV", " Deletion ", "foo", "T", "inversion"]
    assert column(spark, raw, "string", fn.norm_event_type("x")) == ["tra", "dup", "del", "foo", "tra", "inv"]


def test_to_int_strict(spark):
    raw = ["12", "1e3", "7.9", "-7.9", "9007199254740993"]
    assert column(spark, raw, "string", fn.to_int_strict("x")) == [12, 1000, 7, -7, 9007199254740993]
    for bad in ("x1", "", None, "nan"):
        with pytest.raises(Exception, match="not a number"):
            column(spark, [bad], "string", fn.to_int_strict("x"))


def test_positions_and_lengths(spark):
    df = spark.createDataFrame([(1, 4), (-4, -3), (5, 3)], "s bigint, e bigint")
    rows = df.select(
        fn.point_position("s", "e"), fn.interval_length("s", "e"), fn.length_kb(fn.interval_length("s", "e"))
    ).collect()
    assert [tuple(r) for r in rows] == [(2, 4, 0.004), (-4, 2, 0.002), (4, 1, 0.001)]


def test_sanitize(spark):
    inf = math.inf
    assert column(spark, [math.nan, inf, -inf, None, -1.0, 5.0], "double", fn.sanitize_rate("x")) == [
        1e-10, 1e8, 1e-10, 1e-10, 1e-10, 5.0]
    assert column(spark, [math.nan, inf, -inf, None, -1.0, 2e12], "double", fn.sanitize_count("x")) == [
        0, 0, 0, 0, 0, 1e12]


def test_llr(spark):
    df = spark.createDataFrame([(3.0, 1.0), (1.0, 0.5), (1.0, 1.0), (1.0, 0.0)], "y double, e double")
    got = [r[0] for r in df.select(fn.llr_poisson("y", "e")).collect()]
    assert got[0] == pytest.approx(1.0794415417)
    assert got[1] == pytest.approx(0.1210154058)
    assert got[2:] == [None, None]


def test_huber(spark):
    got = column(spark, [1.0, -4.0, math.nan], "double", fn.huber_weight("x", 2.0))
    assert got == [1.0, pytest.approx(0.5), 0.0]


def test_mixture_tail(spark):
    mix = Mixture((0.6, 0.4), (0.2, 1.5), (0.3, 0.5))
    scores = [-1.0, 0.0, 0.1, 1.0, 10.0, 1e4, 1e9]
    df = spark.createDataFrame([(s,) for s in scores], "score double")
    for row in mixture_tail(df, "score", mix).collect():
        z = math.log1p(max(row.score, 0.0))
        p = sum(w * 0.5 * math.erfc((z - m) / s / math.sqrt(2)) for w, m, s in zip(mix.w, mix.mu, mix.sig))
        if p > 1e-290:
            assert row.p_val == pytest.approx(p, rel=2e-7)
            assert row.neglog10_p == pytest.approx(-math.log10(p), abs=1e-6)
        else:
            assert row.p_val == pytest.approx(1e-300, rel=1e-6) or row.p_val >= 1e-300
            assert row.neglog10_p <= 300.0 + 1e-9


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [3.0, 3.0, 6.0])], "a array<double>, b array<double>")
    row = df.select(layer_norm("a").alias("n"), fn.fuse_vectors("a", "b").alias("f")).first()
    sd = math.sqrt(2 / 3 + 1e-5)
    assert row.n == pytest.approx([-1 / sd, 0, 1 / sd])
    assert row.f == pytest.approx([-1 / sd - 1 / math.sqrt(2 + 1e-5), -1 / math.sqrt(2 + 1e-5), 1 / sd + 2 / math.sqrt(2 + 1e-5)])


def test_interval_weight(spark):
    df = spark.createDataFrame([(2.0, 3.0, 4.0), (0.0, 3.0, 4.0), (1.0, math.inf, 4.0)], "l double, n double, k double")
    got = [r[0] for r in df.select(fn.interval_weight("l", "n", "k", 2.0, 0.5)).collect()]
    assert got == [36.0, 0.0, 0.0]
    assert [r[0] for r in df.select(fn.interval_weight("l", "n", "k", 0.0)).collect()] == [2.0, 0.0, 1.0]
