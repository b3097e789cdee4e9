"""Parallel scans against the plain folds: frontiers near the wrap, entries cut anywhere."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.functions import words as W
from causeway.operators import entries, graph, scan
from causeway.streaming import reader


def folded(clocks):
    state = -1
    for c in clocks:
        state = scan.supersede(state, c)
    return state


def random_clocks(rnd, n):
    zone = lambda: rnd.choice([rnd.randrange(65532, 65536), rnd.randrange(0, 4), rnd.randrange(4, 65532)])
    return [zone() << 16 | rnd.randrange(0, 4) for _ in range(n)]


def test_functions_of_blocks_compose_to_the_fold():
    rnd = random.Random(3)
    for _ in range(3000):
        clocks = random_clocks(rnd, rnd.randrange(1, 12))
        cut = sorted(rnd.sample(range(len(clocks) + 1), min(2, len(clocks))))
        whole = scan._clock_state()
        for part in (clocks[: cut[0]], clocks[cut[0] : cut[-1]], clocks[cut[-1] :]):
            f = scan._clock_state()
            for c in part:
                scan._clock_step(f, (c,))
            scan._compose_step(whole, tuple(f))
        assert whole[1] == folded(clocks)
        for state in random_clocks(rnd, 3):
            want = state
            for c in clocks:
                want = scan.supersede(want, c)
            assert scan.applied(whole, state) == want


def test_one_pair_with_all_rows_is_many_tasks(spark):
    rnd = random.Random(4)
    n, block = 6000, 256
    clocks = random_clocks(rnd, n)
    rows = [(1, 2, i, c >> 16, c & 65535) for i, c in enumerate(clocks)] + [(1, 3, i, 5, i) for i in range(9)] + [(4, 2, 0, 65535, 1), (4, 2, 300, 1, 1), (4, 2, 90000, 65533, 7)]
    frame = spark.createDataFrame(rows, "probe_id long, neighbor_id long, pos long, epoch long, ticks long")
    last = folded(clocks)
    got = {tuple(r) for r in graph.frontier(frame, block).collect()}
    assert got == {(1, 2, last >> 16, last & 65535), (1, 3, 5, 8), (4, 2, 65533, 7)}
    # No key of the first level holds more than a block of the hot pair's rows.
    most = frame.groupBy("probe_id", "neighbor_id", F.expr(f"pos div {block}")).count().agg(F.max("count")).first()[0]
    assert most <= block < n / 8
    assert graph.frontier(frame.limit(0)).count() == 0


def log_of(rnd, n):
    out = []
    for _ in range(n):
        ns, x = rnd.randrange(1 << 61), rnd.randrange(1 << 32)
        time = [0xE0000000 | ns >> 32, ns & 0xFFFFFFFF] if rnd.random() < 0.4 else []
        head = rnd.choice([[rnd.randrange(1, 99)], [0x40000000 | 7, x], [0x80000000 | 9, x]] + ([] if time else [[0xC0000000 | ns >> 32, x]]))
        out += [*time, *head]
    return out


def plain(chunks):
    """Rows of the sequential reader."""
    out = []
    for probe in {c[0] for c in chunks}:
        at, held = 0, []
        for start, words in sorted((c[1], c[2]) for c in chunks if c[0] == probe):
            if start + len(words) <= at:
                continue
            at, held, lost, found = reader.advance(at, held, start, words)
            if lost:
                out.append((probe, start, lost, *[None] * 7))
            out += [(probe, pos, 0, *e) for pos, e in found]
    return sorted(out, key=str)


def test_functions_of_chunks_are_those_of_the_words():
    rnd = random.Random(5)
    pool = [1, 2, 0x40000007, 0x80000009, 0xC0000001, 0xE0000001, 0xFFFFFFFF, 0]
    for _ in range(4000):
        words = np.array([rnd.choice(pool) for _ in range(rnd.randrange(0, 9))], np.int64)
        code = scan.transfer(words)
        for state in range(4):
            want = state
            for w in words.tolist():
                want = {0: 2 if w >> 29 == 7 else 1 if w >> 30 else 0, 1: 0, 2: 3, 3: 1 if w >> 30 else 0}[want]
            assert scan.after(code, state) == want, (words, state)
        cut = rnd.randrange(len(words) + 1)
        assert scan.then(scan.transfer(words[:cut]), scan.transfer(words[cut:])) == code


@pytest.mark.parametrize("block", [16, 1 << 16])
def test_chunks_cut_anywhere_give_the_whole_logs_entries(spark, block):
    rnd = random.Random(6)
    chunks = []
    for probe in range(1, 5):
        log = log_of(rnd, 300)
        at = 0
        while at < len(log):
            n = rnd.choice([1, 1, 2, 3, 5, 40])
            chunks.append((probe, at, log[at : at + n]))
            at += n
        whole = {(e["word_off"], e["kind"], e["time_ns"]) for e in entries.parse(spark.createDataFrame([(probe, log)], "p long, words array<long>"), ["p"]).collect()}
        mine = spark.createDataFrame([c for c in chunks if c[0] == probe], "probe_id long, start long, words array<long>")
        assert {(r.word_pos, r.kind, r.time_ns) for r in scan.parse_chunks(mine, block).collect()} == whole
    frame = spark.createDataFrame(chunks, "probe_id long, start long, words array<long>").repartition(5)
    assert sorted((tuple(r) for r in scan.parse_chunks(frame, block).collect()), key=str) == plain(chunks)


def test_gaps_overlaps_repeats_and_odd_rows(spark):
    rnd = random.Random(7)
    chunks = []
    for probe in range(1, 7):
        log = log_of(rnd, 120)
        at = rnd.choice([0, 3])
        while at < len(log):
            n = rnd.choice([1, 2, 7])
            back = rnd.choice([0, 0, 0, 2, 9])
            if rnd.random() > 0.15:
                chunks.append((probe, max(0, at - back), log[max(0, at - back) : at + n]))
            at += n
    # Of chunks with one start only the longest counts.
    longest = {}
    for p, s, w in chunks:
        if len(w) > len(longest.get((p, s), [])):
            longest[p, s] = w
    chunks = [(p, s, w) for (p, s), w in longest.items()]
    rows = [*chunks, chunks[0], (None, 0, [1]), (1, None, [1]), (2, 0, []), (3, 1, None), (9, 4, [])]
    frame = spark.createDataFrame(rows, "probe_id long, start long, words array<long>").withColumn("entry", F.lit("x"))
    got = sorted((tuple(r) for r in scan.parse_chunks(frame, 32).collect()), key=str)
    assert got == plain([*chunks, (9, 4, [])]) and any(r[2] for r in got)
    assert scan.parse_chunks(frame.limit(0)).count() == 0


def test_internal_ids_are_read_across_borders(spark):
    code = W.INTERNAL_EVENTS["items_missed"]
    frame = spark.createDataFrame([(1, 0, [0x40000000 | code]), (1, 1, [12, 0xE0000000]), (1, 3, [5]), (1, 4, [0x40000003]), (1, 5, [1])], "probe_id long, start long, words array<long>")
    got = sorted((r.word_pos, r.event_id, r.payload_raw, r.time_ns) for r in scan.parse_chunks(frame).collect())
    assert got == [(0, code, 12, None), (2, 3, 1, 5)]
