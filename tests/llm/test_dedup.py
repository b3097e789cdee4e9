"""Substring, line and SimHash dedup against brute force, odd rows included."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
import xxhash

from causeway.llm import line_dedup, simhash_dedup, substring_dedup

SCHEMA = "doc_id long, text string, kept string, n long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def passages(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [[rng.choice(words) for _ in range(n)] for n in (19, 20, 26, 60, 300)]
    docs = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(4)):
            text += [rng.choice(words) for _ in range(rng.randrange(30))] + rng.choice(shared)
        docs.append((i, " ".join(text)))
    docs += [(100, None), (101, ""), (102, " \t "), (103, docs[5][1]), (104, docs[5][1]), (105, "la " * 90), (106, "a b c " * 30)]
    return docs


@pytest.mark.parametrize("most", [substring_dedup.BUCKET, 2])
def test_substring_dedup_equals_brute_force(spark, most):
    docs = passages()
    first, want = {}, {}
    for d, text in sorted(docs):
        words = WORD.findall(text or "")
        gone = set()
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in first:
                gone.update(range(s, s + 20))
            first.setdefault(w, (d, s))
        want[d] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(d, t, "x", 1) for d, t in docs], SCHEMA).repartition(5), most=most).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == want
    assert len(rows) == len(docs)


def test_packed_words_end_where_they_should():
    spelt = [substring_dedup.spelt(w) for w in (b"x" * 254, b"y" * 255, b"\xff" * 3, b"z" * 70_000)]
    coded = [substring_dedup.short_word(0), *spelt[:2], substring_dedup.short_word(200), *spelt[2:], substring_dedup.short_word(99_999)]
    assert substring_dedup.ends_of(b"".join(coded)) == [sum(map(len, coded[: i + 1])) for i in range(7)]


def test_short_words_differ_and_are_told_by_their_first_byte():
    forms = [substring_dedup.short_word(i) for i in (*range(26_000), *range(353_000, 353_500))]
    known = [f for f in forms if f]
    assert len(set(known)) == len(known) and forms[-1] is None
    assert all(len(f) == substring_dedup.SIZES[f[0]] for f in known)


def test_substring_dedup_of_long_words(spark):
    text = " ".join(chr(97 + i) * 30_000 for i in range(25))
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(1, text, "", 0), (2, "own " + text, "", 0)], SCHEMA)).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_removed, r.kept) for r in rows] == [(25, 0, text), (26, 25, "own")]


def test_substring_dedup_of_nothing_and_null_ids(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = substring_dedup.remove_repeats(spark.createDataFrame([(None, "a " * 50, "", 0)] * 2, SCHEMA)).collect()
    assert [r.n_words for r in rows] == [50, 50]


WHITE = " \t\n\x0b\x0c\r"


def brute_lines(docs, min_words):
    """Lines of every document that lie in a long enough run that starts earlier."""
    every = {d: [(i, x.strip(WHITE)) for i, x in enumerate((t or "").split("\n")) if x.strip(WHITE)] for d, t in docs}
    starts = [(d, p) for d in sorted(every) for p in range(len(every[d]))]
    gone = defaultdict(set)
    for n, (d, p) in enumerate(starts):
        for e, q in starts[:n]:
            k = 0
            while p + k < len(every[d]) and q + k < len(every[e]) and every[d][p + k][1] == every[e][q + k][1]:
                k += 1
            if k and sum(len(every[d][p + i][1].split()) for i in range(k)) >= min_words:
                gone[d].update(range(p, p + k))
    return {d: len(gone[d]) for d in every}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(8)
    lines = [" ".join(f"x{rng.randrange(99)}" for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice([*lines, "", f"own {i} {rng.random()}"]) for _ in range(rng.randrange(12)))) for i in range(25)]
    docs += [(50, None), (51, ""), (52, "\n\n"), (53, docs[3][1]), (54, "same line of ten words is here again and again\n" * 40)]
    out = line_dedup.remove_repeats(spark.createDataFrame([(d, t, "k", 2) for d, t in docs], SCHEMA).repartition(3)).collect()
    assert {r.doc_id: r.n_removed for r in out} == brute_lines(docs, line_dedup.MIN_WORDS)
    assert out[0].asDict().keys() == {"doc_id", "text", "kept", "n", "n_removed"}


def test_line_dedup_of_nothing_and_null_ids(spark):
    assert line_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    text = "one two three four five six seven eight nine ten\n" * 2
    rows = line_dedup.remove_repeats(spark.createDataFrame([(None, text, "", 0), (None, text, "", 0)], SCHEMA)).collect()
    assert [(r.text, r.n_removed) for r in rows] == [(text, 0)] * 2


def slow_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(fps, bits):
    up = {d: d for d in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_simhash_equals_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(f"t{rng.randrange(500)}" for _ in range(120))) for i in range(40)]
    for i in range(60):
        base = rng.choice(docs)[1].split()
        base[rng.randrange(len(base))] = "Other"
        docs.append((100 + i, " ".join(base)))
    docs += [(300, None), (301, ""), (302, "One two"), (303, "one TWO"), (304, docs[2][1])]
    rows = simhash_dedup.near_duplicates(spark.createDataFrame([(d, t, "", 0) for d, t in docs], SCHEMA)).collect()
    fps = {d: slow_fingerprint(t) for d, t in docs}
    assert {r.doc_id: r.fp % (1 << 64) for r in rows} == fps
    assert {r.doc_id: r.component_id for r in rows} == components(fps, 3)


def test_simhash_of_a_very_long_text():
    rng = random.Random(7)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(100_000))
    assert simhash_dedup.fingerprint(text.encode()) % (1 << 64) == slow_fingerprint(text)


def test_simhash_of_nothing(spark):
    assert simhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("bits", [1, 3])
def test_threshold_plans_lose_no_pair(spark, bits):
    rng = random.Random(bits)
    values = [rng.getrandbits(64) for _ in range(30)]
    for v in values[:30]:
        x = v
        for b in rng.sample(range(64), rng.randrange(6)):
            x ^= 1 << b
        values.append(x)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    import numpy as np

    plan = simhash_dedup.plan_parts(simhash_dedup.bit_counts(nodes), np.array(values, np.int64), len(values), bits)
    assert sum(t + 1 for _, t in plan) == bits + 1
    found = {(r.a, r.b) for r in simhash_dedup.links(nodes, plan, bits).collect()}
    assert found == {(a, b) for a in values for b in values if a < b and ((a ^ b) % (1 << 64)).bit_count() <= bits}


def test_digest_columns(spark):
    from causeway.llm import queries

    rows = queries.op2_substring_dedup(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200
    assert all(re.fullmatch("[0-9a-f]{64}", r.kept_sha256) for r in rows)
    assert any(r.kept_sha256 != hashlib.sha256(b"").hexdigest() for r in rows)
