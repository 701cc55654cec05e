import pytest

from hotspan.operators.columns import guess_sample_column, resolve_columns
from hotspan.operators.quality import canonical_report, finite_report, first_nonfinite
from hotspan.sources import readers, writers


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_points_from_csv(spark, tmp_path):
    path = write(tmp_path / "e.csv", "﻿Chr,START,End,Sample_ID,Filter\n1,10,13,a,PASS\nX,7,7,b,LowQ\nGL1,5,5,c,.\nmt,1e2,100,d,x;pass\n")
    rows = [tuple(r) for r in readers.read_points(spark, path).collect()]
    assert rows == [("chr1", 11, "a")]
    wide = readers.read_points(spark, path, canonical=False, require_pass=False, use_midpoint=False).collect()
    assert sorted(tuple(r) for r in wide) == [("chr1", 10, "a"), ("chrGL1", 5, "c"), ("chrM", 100, "d"), ("chrX", 7, "b")]


def test_typed_points_from_tsv(spark, tmp_path):
    path = write(tmp_path / "e.tsv", "seqnames\tpos\t svclass \tDonor\n2\t10\tBND;x\ta\nchr2\t12\tduplication\tb\n")
    rows = sorted(tuple(r) for r in readers.read_typed_points(spark, path).collect())
    assert rows == [("chr2", 10, "tra", "a"), ("chr2", 12, "dup", "b")]


def test_malformed_number_fails(spark, tmp_path):
    path = write(tmp_path / "e.csv", "chrom,pos,sample\n1,x9,a\n")
    with pytest.raises(Exception, match="not a number"):
        readers.read_points(spark, path).collect()


def test_missing_column(spark):
    df = spark.createDataFrame([("1", "s")], "chrom string, sample string")
    with pytest.raises(KeyError, match="start"):
        resolve_columns(df)


def test_guess_sample(spark):
    named = spark.createDataFrame([("x", "y")], "note string, VCF string")
    assert guess_sample_column(named) == "VCF"
    hits = spark.createDataFrame(
        [("u1", "a.vcf", "run_CPCT"), ("u2", "a", "wide7"), ("u3", None, "z")], "id string, f1 string, f2 string"
    )
    assert guess_sample_column(hits) == "f2"
    varied = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", None, 3)], "p string, q string, n int")
    assert guess_sample_column(varied) == "q"
    assert guess_sample_column(varied, approx=True) == "q"
    with pytest.raises(KeyError):
        guess_sample_column(spark.createDataFrame([(1,)], "n int"))


def test_predictions_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [("chr1", 1, 9, 0.5, 1.0, -0.25, s) for s in ("train", "val", "all")],
        readers.PREDICTION_SCHEMA + ", split string",
    )
    for fmt in ("parquet", "csv"):
        path = str(tmp_path / fmt)
        writers.write_predictions(df, path, fmt)
        back = readers.read_predictions(spark, f"{path}/split=all", fmt)
        assert [tuple(r) for r in back.collect()] == [("chr1", 1, 9, 0.5, 1.0, -0.25)]
    with pytest.raises(ValueError, match="lacks"):
        readers.check_predictions(df.drop("lam_pred"))


def test_score_reads_the_csv_that_train_wrote(spark, tmp_path):
    from hotspan.plans.job import run

    rows = [("chr1", i * 100 + 1, i * 100 + 100, 0.5 + i % 3, float(i % 7), 0.0, "all") for i in range(60)]
    path = str(tmp_path / "predictions")
    writers.write_predictions(spark.createDataFrame(rows, readers.PREDICTION_SCHEMA + ", split string"), path, "csv")
    run(spark, ["score", "--predictions", f"{path}/split=all", "--format", "csv", "--out", str(tmp_path / "out"),
                "--max-bp", "500", "--gmm-k", "1", "--sample-frac", "1.0", "--fdr-method", "bh"])
    assert "fdr" in spark.read.csv(str(tmp_path / "out/final_result"), header=True).columns


def test_empty_result(spark):
    assert writers.empty_result(spark).columns == [
        "chrom", "start", "end", "len_bp", "LLR_raw", "obs_sum", "exp_sum", "p_post", "fdr_post", "fdr"]


def test_quality(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(i, x) for i, x in enumerate([1.0, nan, inf, -inf, None, 3.0])], "i int, x double")
    row = finite_report(df, ["x", "i"]).where("column = 'x'").first()
    assert tuple(row) == ("x", 6, 1, 1, 2, 1.0, 3.0, 2.0)
    assert [r.i for r in first_nonfinite(df, "x", ["i"], 3).collect()] == [1, 2, 3]
    names = spark.createDataFrame([("chr1",), ("chrM",), (None,)], "chrom string")
    assert tuple(canonical_report(names).first()) == (1, 2)


@pytest.mark.parametrize("midpoint", [True, False])
def test_dropped_rows_are_parsed_too(spark, tmp_path, midpoint):
    path = tmp_path / "events.csv"
    path.write_text("chrom,start,end,sample,filter\n1,10,20,a,PASS\n1,oops,20,b,LowQ\n")
    with pytest.raises(Exception, match="not a number"):
        readers.read_points(spark, str(path), use_midpoint=midpoint).collect()
    path.write_text("chrom,start,end,sample,filter\n1,10,20,a,PASS\n1,10,oops,b,LowQ\n")
    with pytest.raises(Exception, match="not a number"):
        readers.read_points(spark, str(path), use_midpoint=midpoint).collect()
    path.write_text("chrom,start,end,sample,filter\n1,10,20,a,PASS\n1,1e3,20,b,LowQ\n")
    assert [tuple(r) for r in readers.read_points(spark, str(path), use_midpoint=midpoint).collect()] == [("chr1", 15 if midpoint else 10, "a")]
