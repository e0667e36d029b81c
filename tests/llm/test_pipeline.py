import corpus_pipeline
from quillbase.llm import common


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mixing", "sentencepiece"]
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"test-{name}")
        ids = [r["doc_id"] for r in docs.select("doc_id").collect()]
        assert set(ids) <= before and ids
        if name != "sentencepiece":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "near_dedup":
            assert len(ids) == len(set(ids))
        before = set(ids)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} == set(docs.columns)
