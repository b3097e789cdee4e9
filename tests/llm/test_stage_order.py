"""Benchmark passages go before near copies are looked for."""

import random

import corpus_pipeline
from causeway.llm import near_copies, simhash_dedup


def test_a_document_with_a_passage_does_not_stand_for_its_clean_near_copy(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    passage = [f"p{i}" for i in range(20)]
    texts = [" ".join([*words[:200], *middle, *words[200:]]) for middle in (passage, [f"q{i}" for i in range(20)])]
    a, b = (set(near_copies.shingles(t.encode()).tolist()) for t in texts)
    assert len(a & b) >= 0.8 * len(a | b)
    one, two = (simhash_dedup.fingerprint(t.encode()) & (1 << 64) - 1 for t in texts)
    assert (one ^ two).bit_count() > simhash_dedup.MAX_BITS
    spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [2]
