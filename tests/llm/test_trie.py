"""The prefix trie against plain Python: shared beginnings, equal conversations, long ones, odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from causeway.llm import prefix_trie
from causeway.llm._common import Tables

SCHEMA = "conv_id long, turn long, role string, text string, depth string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def symbol(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]


def rebuilt(rows, lend):
    turns = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            turns.setdefault(c, []).append(((t is not None, t or 0), symbol(role or "", text or ""), role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(some, key=lambda x: x[:2])] for c, some in turns.items()}
    if not lend:
        return turns
    h = lambda c: zlib.crc32(str(c).encode()) % 4
    return {c: turns.get(c - c % 20, [])[: h(c)] + some[h(c) :] for c, some in turns.items()}


def plain(rows, lend=False):
    members, ends, kids = {}, {}, {}
    for c, turns in rebuilt(rows, lend).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(turns[: d - 1]), set()).add(tuple(turns[:d]))
        ends.setdefault(tuple(turns), []).append(c)
    leaves, saved = {}, {}
    for key in sorted(members, key=len, reverse=True):
        own = (len(members[key]) - 1) * len(WORD.findall(key[-1][1])) if key else 0
        leaves[key] = sum(leaves[k] for k in kids.get(key, ())) or 1
        saved[key] = own + sum(saved[k] for k in kids.get(key, ()))
    sha = lambda key: hashlib.sha256(",".join(map(str, sorted(ends.get(key, [])))).encode()).hexdigest()
    return sorted((min(m), len(k), -1 if not k else min(members[k[:-1]]), len(m), len(kids.get(k, ())), leaves[k], saved[k], sha(k)) for k, m in members.items())


def ours(spark, rows, lend=False):
    tables = Tables(spark, "test")
    given = spark.createDataFrame(rows, SCHEMA)
    turns = tables.put(prefix_trie.symbols(given, tables))
    if lend:
        turns = tables.put(prefix_trie.with_lent_turns(turns))
    nodes = prefix_trie.with_ends(*prefix_trie.trie(turns, given.where("conv_id is not null").select("conv_id").distinct()))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if x is None else x for x in r) for r in nodes.select(*names).collect())


def some(rnd, n, texts):
    rows = []
    for c in range(n):
        rows += [(c, t, rnd.choice(["user", "assistant"]) if t % 2 else "user", rnd.choice(texts), "x") for t in range(rnd.randrange(0, 5))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("lend", [False, True])
def test_equals_plain_python(spark, lend):
    rnd = random.Random(1)
    rows = some(rnd, 70, ["a", "b b", "", " c \t d", None])
    rows += [(c, t, "user", f"same {t}", "x") for c in (200, 8191, 8192, 70000, 201) for t in range(3)]  # equal, over two spans of ids
    rows += [(300, t, "user", f"long {t}", "x") for t in range(150)]
    assert ours(spark, rows, lend) == plain(rows, lend)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "gone", "x"), (1, None, None, None, None), (1, 3, "user", "b", "x"), (1, 3, "user", "a", "x"), (1, 3, "user", "a", "x"),
        (2, None, "", "", "x"), (-7, 0, "user", "w " * 100_000, "x"), (3, 0, "1:user", "x", "x"), (4, 0, "1", ":userx", "x"),
    ]
    assert ours(spark, rows) == plain(rows)
    assert ours(spark, rows[:1]) == []


def test_a_conversation_in_many_parts(spark):
    """One with most of all turns is numbered over several partitions, and its copy is the same sequence."""
    rows = [(c, t, "user", f"{t}", "x") for c in (5, 9) for t in range(600)] + [(7, 0, "user", "0", "x")]
    assert ours(spark, rows) == plain(rows)
