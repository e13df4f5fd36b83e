"""The pipeline's stages one after the other, on the small table."""

from __future__ import annotations

import corpus_pipeline
from prefspark.llm import decontam, neardup, secrets, subword
from prefspark.llm.common import saved

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, out = docs.columns, {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = saved(stage(spark, before, SMALL))
        out[name] = (before, after)
        if name != "sentencepiece":
            assert after.columns == columns and after.schema == before.schema
        before = after
    before, after = out["near_dedup"]
    texts = {r.doc_id: r.text for r in before.collect()}
    want = neardup.brute_force(texts)
    assert {r.doc_id for r in after.collect()} == {d for d, c in want.items() if d == c}
    before, after = out["decontamination"]
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    was = {r.doc_id: r for r in decontam.scan(before, items).collect()}
    now = {r.doc_id: r for r in decontam.scan(after, items).collect()}
    assert not any(r.spans for r in now.values())
    assert all(d in now for d, r in was.items() if not r.spans)
    _, after = out["secrets"]
    assert not any(s.kind != "random" for r in secrets.scan(after, limits={}).collect() for s in r.spans)
    before, after = out["sentencepiece"]
    texts, vocab = {r.doc_id: r.text for r in before.collect()}, subword.vocabulary()
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(subword.decode(r.ids, vocab) == texts[r.doc_id] for r in rows)


def test_run_gives_the_last_stages_rows(spark):
    assert corpus_pipeline.run(spark, SMALL).columns[:3] == ["doc_id", "sample", "ids"]


def test_empty_table_passes(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = saved(stage(spark, docs, SMALL))
    assert docs.count() == 0
