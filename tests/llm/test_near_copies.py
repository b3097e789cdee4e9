"""Near copies of the pipeline's stage against exact Jaccard on 5-word shingles."""

import random

import pytest

import corpus_pipeline
from causeway.llm import near_copies

SCHEMA = "doc_id long, text string, kept string, n long"


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def exact_groups(docs):
    of = {d: d for d, _ in docs}
    sets = {d: grams(t) for d, t in docs}
    ids = sorted(of)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if of[a] != of[b] and 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(of[a], of[b]), min(of[a], of[b])
                of = {d: new if c == old else c for d, c in of.items()}
    return of


def planted():
    rng = random.Random(6)
    docs = [(i, " ".join(f"t{rng.randrange(3000)}" for _ in range(200))) for i in range(40)]
    for i in range(200):  # one to six words changed: about 0.95 to 0.74
        words = docs[i % 40][1].split()
        for at in rng.sample(range(200), 1 + i % 6):
            words[at] = f"New{i}"
        docs.append((100 + i, " ".join(words)))
    return docs + [(400, None), (401, " \n"), (402, "One two"), (403, "one TWO"), (404, docs[2][1])]


@pytest.mark.parametrize("rounds", [(), (near_copies.BANDS,), near_copies.ROUNDS])
def test_groups_equal_exact_jaccard(spark, rounds):
    docs = planted()
    want = exact_groups(docs)
    rows = near_copies.groups(spark.createDataFrame([(d, t, "", 0) for d, t in docs], SCHEMA).repartition(3), rounds).collect()
    assert {r.doc_id: r.component_id for r in rows} == want


def test_stage_keeps_one_of_planted_near_copies(spark):
    docs = [(d, t) for d, t in planted() if d < 400]
    kept = {r.doc_id for r in corpus_pipeline.distinct(spark, spark.createDataFrame([(d, t, "", 0) for d, t in docs], SCHEMA), "").collect()}
    want = exact_groups(docs)
    gone = {d for d in want if want[d] != d}
    assert len(gone) == 140 and kept == set(want) - gone


def test_near_copies_of_nothing_and_null_ids(spark):
    assert near_copies.groups(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = near_copies.keep_one(spark.createDataFrame([(1, "a b c d", "", 0), (2, "a b c d", "", 0), (None, "a b c d", "", 0)], SCHEMA)).collect()
    assert sorted((r.doc_id or 0) for r in rows) == [0, 1]
