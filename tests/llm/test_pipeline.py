import pytest

from hotspan.session import stage_table


def test_stages_on_odd_rows(spark, docs, tmp_path):
    import corpus_pipeline

    sf = str(tmp_path)
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage_table(stage(spark, now, sf), "t")
        counts.append(now.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == before.columns
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2]
    assert {r["doc_id"] for r in now.collect()} <= {r["doc_id"] for r in docs.collect()}


def test_stages_on_an_empty_table(spark, none, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = none
    for _, stage in corpus_pipeline.STAGES:
        now = stage_table(stage(spark, now, str(tmp_path)), "t")
    assert now.count() == 0


def test_queries_are_registered():
    contract = pytest.importorskip("__spark_entry__")
    names = contract.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
