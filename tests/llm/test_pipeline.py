import corpus_pipeline
from pulsewright.llm import packing, pii, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == columns, name
        assert 0 < kept.count() <= before.count()
        assert kept.filter("n_chars <> length(text)").count() == 0
    field = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.judge(docs, field).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} <= good
    groups = [r.component_id for r in simhash.near_duplicates(corpus_pipeline.line_dedup(spark, docs.filter(docs.doc_id.isin(*good)), SF)).collect()]
    assert kept.count() == len(set(groups))
    assert not [r for r in kept.collect() if pii.base_spans(r.text)]
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}
    used = {}
    for r in packed:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048


def test_pipeline_over_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for d in (docs, no_docs.select(*docs.columns)):
        for _, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, SF)
        d.count()
    assert packing.pieces_of(2049, 2048) == [(0, 1), (1, 2048)]
