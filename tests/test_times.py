"""Restarts, interactions with something in between, and wall clocks, against plain Python."""

import random

from causeway.functions import words as W
from causeway.operators import entries, graph, timeline, wallclock

TOLD = W.INTERNAL_EVENTS["num_clocks_overflowed"]
ME = 7


def clock(probe, ticks):
    return [0x80000000 | probe, ticks]


def marked(spark, reports):
    frame = spark.createDataFrame([(ME, n, log) for n, log in reports], "probe_id long, seq_num long, words array<long>")
    rows = graph.marked_interactions(entries.parse(frame, ["probe_id", "seq_num"])).collect()
    return sorted((r.src_clock, r.dst_clock, r.adjacent) for r in rows)


def test_every_own_event_may_stand_between_both_clocks(spark):
    own = [code for name, code in W.INTERNAL_EVENTS.items() if name != "items_missed"]
    log, want = [], []
    for i, code in enumerate([None, *own], 1):
        log += clock(ME, i) + ([] if code is None else [code]) + clock(9, 100 + i)
        want.append((100 + i, i, code is None))
    log += clock(ME, 50) + [0x40000000 | W.INTERNAL_EVENTS["items_missed"], 3, own[0], own[1]] + clock(9, 150)
    assert marked(spark, [(0, log)]) == sorted([*want, (150, 50, False)])


def test_broken_interactions_and_borders(spark):
    got = marked(spark, [
        (0, [*clock(9, 1), *clock(ME, 1), 5, *clock(9, 2), *clock(ME, 2)]),  # no own clock; an event between; cut behind it
        (1, [TOLD, *clock(9, 3), *clock(9, 4), *clock(ME, 3), TOLD]),  # goes on; a second foreign clock; cut with an own event
        (2, [*clock(9, 5), *clock(ME, 4)]),
        (4, clock(9, 6)),  # report 3 is missing
    ])
    assert got == [(1, None, None), (2, None, None), (3, 2, False), (4, None, None), (5, 3, False), (6, None, None)]
    assert marked(spark, [(0, [5])]) == []


def test_previous_and_restarts_do_not_depend_on_blocks(spark):
    rnd = random.Random(1)
    rows = []
    for probe in range(1, 5):
        n = seq = epoch = 0
        while n < 80:
            n += rnd.randrange(1, 3)
            if rnd.random() < 0.15:
                seq, epoch = 0, epoch + 1
            rows.append((probe, n, seq, epoch))
            seq += rnd.randrange(1, 3)
    frame = spark.createDataFrame(rows, "probe_id long, nth long, seq_num long, epoch long")
    from pyspark.sql import functions as F

    for block in (8, 1 << 16):
        got = timeline.previous(frame, "probe_id", "nth", F.col("seq_num"), "was", block).collect()
        before = {}
        for r in sorted(got, key=lambda r: (r.probe_id, r.nth)):
            assert r.was == before.get(r.probe_id)
            before[r.probe_id] = r.seq_num
    told = timeline.report_restarts(frame)
    want, state = {}, {}
    for p, n, s, e in rows:
        last, no = state.get(p, (None, 0))
        no += last is not None and s < last
        state[p] = (s, no)
        want[p, n] = no
    assert {(r.probe_id, r.nth): r.restart_no for r in told.collect()} == want
    ranges = timeline.restart_ranges(told)
    asks = spark.createDataFrame([(p, n + 1, "x") for p, n, _, _ in rows] + [(1, 0, "first"), (99, 5, "no such probe")], "probe_id long, nth long, restart string")
    got = {(r.probe_id, r.nth): r.restart_no for r in timeline.at_restart(asks, ranges).collect()}
    assert got[1, 0] is None and got[99, 5] is None
    for p, n, _, _ in rows:
        assert got[p, n + 1] == want.get((p, n + 1), want[p, n])


def test_times_close_to_each_other_and_denied_edges(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(1, 6), rnd.randrange(3), rnd.randrange(2000), i) for i in range(400)]
    heads = spark.createDataFrame([(p, 0, (p - 1) % 3, 1) for p in range(1, 6)], "probe_id long, seq_num long, wall_clock_id long, time_resolution long")
    timed = wallclock.timed(spark.createDataFrame([(p, 0, c, t, i) for p, c, t, i in rows] + [(1, 0, 0, None, 999)], "probe_id long, seq_num long, clock_at long, time_ns long, id long"), heads)
    domain = lambda p: (p - 1) % 3 or -p
    got = {(r.id_a, r.id_b): r.apart_ns for r in wallclock.close_pairs(timed, 7).collect()}
    want = {(i, j): u - t for p, _, t, i in rows for q, _, u, j in rows if p != q and domain(p) == domain(q) and 0 <= u - t <= 7 and (u > t or i < j)}
    assert got == want and len(got) > 30
    edges = [(d, dc, s, sc) for d in range(1, 6) for s in range(1, 6) if d != s for dc in range(3) for sc in range(3)]
    told = wallclock.contradictions(spark.createDataFrame(edges, "dst_probe long, dst_clock long, src_probe long, src_clock long"), timed).collect()
    at = lambda p, c: [t for q, k, t, _ in rows if (q, k) == (p, c)]
    denied = {e for e in edges if domain(e[0]) == domain(e[2]) and at(*e[:2]) and at(*e[2:]) and max(at(*e[2:])) > min(at(*e[:2])) + 2}
    assert {tuple(r)[:4] for r in told} == denied and denied
