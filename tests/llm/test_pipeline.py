"""The pipeline stage by stage, each judged on its own input, at the smallest scale."""

import corpus_pipeline
from panelspark.llm import jaccard, linededup, quality
from panelspark.llm.decontaminate import contamination, is_contaminated
from panelspark.llm.store import materialise

SF = "/root/testdata/sf0.001"


def test_stages_apply_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialise(stage(spark, before, SF), "t")
        assert after.columns == docs.columns
        ids = {r["doc_id"] for r in after.select("doc_id").collect()}
        if name == "quality rules":
            assert ids == {r["doc_id"] for r in quality.quality_digest(before).where("kept").collect()}
        elif name == "line dedup":
            want = {r["doc_id"]: r["kept_sha256"] for r in linededup.line_digest(before).collect()}
            assert {r["doc_id"]: r["h"] for r in after.selectExpr("doc_id", "sha2(text, 256) h").collect()} == want
        elif name == "n-gram Jaccard join":
            assert ids == {r["doc_id"] for r in jaccard.jaccard_components(before).where("doc_id = component_id").collect()}
        else:
            bench = spark.read.parquet(f"{SF}/benchmark.parquet")
            assert ids == {r["doc_id"] for r in contamination(before, bench).where(~is_contaminated(50)).collect()}
        before = after
    mixed = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert len(mixed) == before.count() and all(r["release"] <= r["slot"] < r["deadline"] for r in mixed)


def test_empty_documents_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
