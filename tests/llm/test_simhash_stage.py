"""The pipeline's SimHash stage is the operator: one document of each of its components, before near copies are looked for."""

import random

import corpus_pipeline
from causeway.llm import simhash_dedup

SCHEMA = "doc_id long, text string, kept string, n long"


def test_stage_keeps_the_first_of_each_component(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(300))) for i in range(30)]
    for i in range(60):  # one word changed, or none
        words = docs[i % 30][1].split()
        if i % 3:
            words[rng.randrange(300)] = f"new{i}"
        docs.append((100 + i, " ".join(words)))
    docs += [(None, docs[0][1]), (None, docs[0][1]), (5, docs[5][1]), (200, None), (201, " \n")]
    frame = spark.createDataFrame([(d, t, "", 0) for d, t in docs], SCHEMA)
    prints = {d: simhash_dedup.fingerprint((t or "").encode()) & (1 << 64) - 1 for d, t in docs if d is not None}
    of = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if of[a] != of[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                old, new = max(of[a], of[b]), min(of[a], of[b])
                of = {d: new if c == old else c for d, c in of.items()}
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert stages.index("line_dedup") < stages.index("simhash_dedup") < stages.index("near_copies")
    out = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, frame, "")
    assert out.columns == frame.columns
    got = [r.doc_id for r in out.collect()]
    assert sorted(d for d in got if d is not None) == sorted(d for d in of if of[d] == d) and got.count(None) == 2
    assert 30 < len(of) - len(set(of.values()))
