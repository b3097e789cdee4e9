"""Spelling variants against plain Python: counts, near words, forms and roots."""

import re
import zlib
from collections import Counter

import pytest

from causeway.llm import spelling
from causeway.llm._common import Tables
from causeway.llm.queries import op12_spelling_variants

SF = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")
SMALL = {c: c + 32 for c in range(65, 91)}


def plain_words(docs):
    n = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def plain_variants(known):
    """{word: (form, root, n, n_near, form_n)}, near words by all deletions."""
    spots = {}
    for w in known:
        for i in range(len(w)):
            spots.setdefault((len(w), w[:i] + w[i + 1 :], i), []).append(w)
    near = {w: set() for w in known}
    for same in spots.values():
        for w in same:
            near[w].update(x for x in same if x != w)
    for w in known:
        for x in {w[:i] + w[i + 1 :] for i in range(len(w))} & set(known):
            near[w].add(x)
            near[x].add(w)
    form = {}
    for w, some in near.items():
        best = min(some, key=lambda x: (-known[x], x), default=None)
        form[w] = best if best is not None and known[best] >= 5 * known[w] else None
    out = {}
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, known[w], len(near[w]), form[w] and known[form[w]])
    return out


def result(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_the_query_equals_plain_python(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = plain_variants(plain_words(docs))
    assert result(op12_spelling_variants(spark, SF)) == want and any(v[0] for v in want.values())


@pytest.mark.parametrize("block", [2, 16])
def test_subdivided_blocks_lose_and_double_nothing(spark, block):
    import random

    rnd = random.Random(5)
    some = {"".join(rnd.choice("abé") for _ in range(rnd.randrange(1, 9))) for _ in range(900)}
    some |= {"prefixprefix" + "".join(rnd.choice("xyz") for _ in range(rnd.randrange(1, 6))) for _ in range(300)}
    some |= {"".join(rnd.choice("xyz") for _ in range(rnd.randrange(1, 6))) + "endend" for _ in range(300)}
    some |= {"z" * n for n in range(1, 40)} | {"q" * 3000, "q" * 3001, "q" * 1500 + "r" + "q" * 1499}
    known = {w: rnd.randrange(1, 50) for w in some}
    frame = spark.createDataFrame(list(known.items()), "word string, n long")
    tables = Tables(spark, "test")
    pairs = [(r.word, r.near) for r in spelling.near_pairs(tables.put(frame), tables, block).collect()]
    short = {w for w in some if len(w) < 100}
    want = {(u, v) for u in short for v in short if u != v and abs(len(u) - len(v)) <= 1 and spelling.one_edit(*sorted((u, v), key=len))}
    q = sorted(w for w in some if len(w) >= 100)
    assert spelling.one_edit("q" * 3000, "q" * 3001) and len(q) == 3
    want |= {(u, v) for u, v in (("q" * 3000, "q" * 3001), ("q" * 3000, "q" * 1500 + "r" + "q" * 1499))} | {(v, u) for u, v in (("q" * 3000, "q" * 3001), ("q" * 3000, "q" * 1500 + "r" + "q" * 1499))}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_one_edit_is_the_edit_distance():
    words = ["", "a", "b", "ab", "ba", "aab", "aba", "abb", "abab"]

    def distance(u, v):
        row = list(range(len(v) + 1))
        for i, a in enumerate(u, 1):
            before, row[0] = row[0], i
            for j, b in enumerate(v, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != b))
        return row[-1]

    for u in words:
        for v in words:
            if len(u) <= len(v):
                assert spelling.one_edit(u, v) == (distance(u, v) == 1)


def test_odd_rows(spark):
    text = "Spelling spelling speling spellinG " * 3 + "MÜLLER mÜller ÀÀÀÀÀÀ "
    rows = [(1, text * 4, "x"), (1, text, "y"), (None, text, None), (2, None, "z"), (3, "", "z"), (4, "a" * 300_000 + " 12 \U0001f600 letters" + " letters" * 9, "z"), (5, "中letters中", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    got = result(spelling.variants(docs))
    assert got == plain_variants(plain_words([r[:2] for r in rows]))
    assert got["speling"][0] == got["speling"][1] == "spelling" or got["speling"][2] * 5 > got["spelling"][2]
    assert result(spelling.variants(docs.limit(0))) == {}


def test_forms_are_followed_to_the_last(spark):
    counts = {"abcdefg": 5, "abcdef": 25, "abcde": 125, "abcd": 625, "abc": 3125, "zzz": 1}
    rows = [(w, f) for w, f in zip(list(counts), list(counts)[1:5], strict=False)]
    tables = Tables(spark, "test")
    got = {r.word: r.root for r in spelling._followed(spark.createDataFrame(rows, "word string, form string"), tables).collect()}
    assert got == {w: "abc" for w in list(counts)[:4]}
    text = " ".join((w + " ") * n for w, n in (("colours", 6), ("colour", 40), ("coloor", 5), ("color", 300), ("colourss", 5)))
    found = result(spelling.variants(spark.createDataFrame([(7, text)], "doc_id long, text string")))
    assert found == plain_variants(plain_words([(7, text)]))
