"""Terms that give rare values away, and where they are taken out."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from causeway.llm import pii

DOCS = "doc_id long, text string"


def added(spark, docs):
    return {r.doc_id: {s.value for s in r.added} for r in pii.find(spark.createDataFrame(docs, DOCS)).collect()}


def filler(at, n):
    return [(at + i, "mail today of agent number and so on") for i in range(n)]


def test_a_value_of_one_document_is_estimated(spark):
    got = added(spark, [(1, "mail ann@home.org of agent Quillon today"), *filler(10, 60)])
    assert got[1] == {"Quillon"} and not any(got[d] for d in got if d != 1)


def test_told_terms_go_wherever_they_stand_and_pairs_count_by_document(spark):
    docs = [(0, "mail bob@home.org of agent Zarquon today")]
    docs += [(1 + i, "mail of agent Zarquon today\nmail bob@home.org today") for i in range(3)]
    docs += [(8, "of agent Zarquon today")]
    got = added(spark, [*docs, *filler(10, 195)])
    n, n_e, n_t = 200, 4, 5
    # By lines only one of the four common documents would count, which is too little.
    share = lambda n_et: math.log(((n_et + n_e / n) / (n_t + 1)) * n / n_e) / math.log(n / n_e)
    assert share(4) > pii.DISCLOSURE > share(1)
    assert [got[d] for d in (0, 1, 2, 3, 8)] == [{"Zarquon"}] * 5 and not got[10]


def test_long_runs_and_many_matches_take_linear_time(spark):
    texts = ["a" * 300_000 + " @", "7" * 300_000 + ".", "1." * 100_000, "+1" + " " * 200_000, "a@b.c " * 20_000, "a@b.c_d@e.f@g.h 1.2.3.4.5.6.7.8 1.2.3.4" + "5" * 50]
    start = time.monotonic()
    rows = {r.i: r.base for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.base_spans(F.col("t")).alias("base")).collect()}
    assert time.monotonic() - start < 60
    assert [len(rows[i]) for i in range(5)] == [0, 0, 25_000, 0, 20_000]
    assert all(s.end - s.start == 5 and s.start == 6 * i for i, s in enumerate(rows[4]))
    for i in (2, 5):
        want = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", texts[i])]
        assert [(s.start, s.end) for s in rows[i] if s.kind == "email"] == want


def test_running_values(spark):
    rng = random.Random(1)
    for n in (0, 1, 127, 128, 129, 1000):
        values = [rng.choice([None, rng.randrange(9)]) for _ in range(n)]
        row = spark.createDataFrame([(values, [v or 0 for v in values])], "m array<int>, s array<int>").select(
            pii.running(F.col("m"), lambda a, x: F.greatest(a, x)).alias("m"), pii.running(F.col("s"), lambda a, x: a + x).alias("s")
        ).first()
        seen = [max((v for v in values[: i + 1] if v is not None), default=None) for i in range(n)]
        assert row.m == seen and row.s == [sum(v or 0 for v in values[: i + 1]) for i in range(n)]


def test_few_and_many_terms_give_the_same_spans(spark):
    text = "a.b \\\\E+x (c a.b\\ta.bc \\Q [d] \\\\E+x"
    row = spark.createDataFrame([(text, ["(c", "[d]", "\\\\E+x", "\\\\Q", "a.b"])], "t string, w array<string>")
    few, many = row.select(pii.few_spans(F.col("t"), F.col("w")), pii.told_spans(F.col("t"), F.col("w"))).first()
    assert few == many and len(few) == 5


def slow_terms(docs):
    """Spans of kind term by the docstring's formula, one document at a time."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    base = {i: slow_base(t) for i, (_, t) in enumerate(docs)}
    held = {i: {t[a:b] for a, b in base[i]} for i, (_, t) in enumerate(docs)}
    words = {i: set(word.findall(t)) for i, (_, t) in enumerate(docs)}
    n, told = max(len(docs), 2), set()
    for e in set().union(*held.values()):
        mine = [i for i in held if e in held[i]]
        share = len(mine) / n
        beside = {w for i in mine for line in docs[i][1].split("\n") if e in line for w in word.findall(line)}
        for w in beside:
            n_et, n_t = sum(w in words[i] for i in mine), sum(w in words[i] for i in words)
            given = (n_et + pii.PRIOR * share) / (n_t + pii.PRIOR)
            if e not in w and share < 1 and math.log(given / share) / -math.log(share) >= pii.DISCLOSURE - 1e-12:
                told.add(w)
    return [[(m.start(), m.end()) for m in word.finditer(t) if m[0] in told and not any(a < m.end() and m.start() < b for a, b in base[i])] for i, (_, t) in enumerate(docs)]


def slow_base(t):
    return [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]


@pytest.mark.parametrize(("few", "broadcast_bytes"), [(pii.FEW, pii.BROADCAST_BYTES), (0, 0)])
def test_disclosure_equals_brute_force(spark, few, broadcast_bytes):
    rng = random.Random(2)
    docs = []
    for i in range(150):
        text = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", f"rare{rng.randrange(60)}", "\n"]) for _ in range(rng.randrange(25)))
        if rng.random() < 0.4:
            who = rng.randrange(12)
            text += f" u{who}@site.org name{who} {'name%d' % who if rng.random() < 0.5 else ''} \nname{who} x"
        docs.append((i, text))
    got = pii.find(spark.createDataFrame(docs, DOCS), few, broadcast_bytes).orderBy("doc_id").collect()
    want = slow_terms(docs)
    assert [[(s.start, s.end) for s in r.added] for r in got] == want
    assert sum(map(len, want)) > 20


def test_overlapping_spans_go_as_one(spark):
    docs = [(1, "call +49 1.2.3.4 now"), (2, "x 4111 1111 1111 1111 y")]
    got = {r.doc_id: r.text for r in pii.sanitise(pii.find(spark.createDataFrame(docs, DOCS))).collect()}
    assert got == {1: "call +49 [IP] now", 2: "x [CARD] y"}


def test_a_long_list_of_values_takes_time_by_its_lines(spark):
    n = 40_000
    text = "\n".join(f"name{i} other user{i}@site.org" for i in range(n))
    start = time.monotonic()
    got = added(spark, [(1, text), *filler(10, 60)])
    assert time.monotonic() - start < 90
    assert got[1] >= {f"name{i}" for i in range(0, n, 997)} and not got[10]
