"""The causal index against a search along edges, and what is asked of it."""

import random

import pytest

from causeway.operators import order

SCHEMA = "src_probe long, src_ticks long, dst_probe long, dst_ticks long"


def reached(edges, probe, ticks):
    """{probe: first ticks} that the segment happens before or is."""
    at, todo = {probe: ticks}, [(probe, ticks)]
    while todo:
        p, t = todo.pop()
        for s, st, d, dt in edges:
            if s == p and st >= t and dt < at.get(d, 1 << 60):
                at[d] = dt
                todo.append((d, dt))
    return at


def graph(seed, probes, steps, hot=0.0):
    """Messages in an order of time, some of them heard late, so that a later snapshot can be heard first."""
    rnd, ticks, edges, sent = random.Random(seed), dict.fromkeys(range(1, probes + 1), 0), [], []
    for _ in range(steps):
        a = 1 if rnd.random() < hot else rnd.randrange(1, probes + 1)
        sent.append((a, ticks[a]))
        ticks[a] += 1
        if rnd.random() < 0.7:
            s, st = sent[rnd.randrange(max(0, len(sent) - 8), len(sent))]
            b = rnd.randrange(1, probes + 1)
            if b != s:
                ticks[b] += 1
                edges.append((s, st, b, ticks[b]))
    return edges, ticks


@pytest.mark.parametrize(("seed", "probes", "hot"), [(1, 6, 0.0), (2, 3, 0.0), (3, 12, 0.5)])
def test_relations_and_reach_equal_a_search(spark, seed, probes, hot):
    edges, ticks = graph(seed, probes, 150, hot)
    index = order.causal_index(spark.createDataFrame([*edges, *edges[:5], (None, 1, 2, 3), (1, 5, 1, 6)], SCHEMA))
    after = {(p, t): reached(edges, p, t) for p, n in ticks.items() for t in range(n + 1)}
    rnd = random.Random(seed)
    pairs = [(*rnd.choice(list(after)), *rnd.choice(list(after))) for _ in range(1000)]
    frame = spark.createDataFrame(pairs, "probe_a long, ticks_a long, probe_b long, ticks_b long")

    def relation(pa, ta, pb, tb):
        if (pa, ta) == (pb, tb):
            return "same"
        if after[pa, ta].get(pb, 1 << 60) <= tb:
            return "before"
        return "after" if after[pb, tb].get(pa, 1 << 60) <= ta else "concurrent"

    got = sorted(tuple(r) for r in order.relations(index, frame).collect())
    assert got == sorted((*p, relation(*p)) for p in pairs)
    assert len({r[-1] for r in got}) >= 3
    asked = spark.createDataFrame(list(after), "probe_id long, ticks long")
    assert {(r.probe_id, r.ticks): r.n_heard or 0 for r in order.reach(index, asked).collect()} == {k: len(v) - 1 for k, v in after.items()}
    steps = sorted(tuple(r) for r in index.select("probe_id", "known_probe", "ticks", "known_ticks").collect())
    for a, b in zip(steps, steps[1:], strict=False):
        assert a[:2] != b[:2] or (a[2] < b[2] and a[3] < b[3])


def test_rounds_follow_hops_and_are_logged(spark, caplog):
    chain = [(p, 0, p + 1, 1) for p in range(1, 5)]
    # Each hop is heard before the next one is sent.
    edges = [(s, st if s == 1 else 1, d, dt) for s, st, d, dt in chain]
    with caplog.at_level("INFO", logger="causeway.operators.order"):
        index = order.causal_index(spark.createDataFrame(edges, SCHEMA))
    assert "after 4 rounds" in caplog.text
    assert {(r.known_probe, r.known_ticks) for r in index.where("probe_id = 5").collect()} == {(1, 0), (2, 1), (3, 1), (4, 1)}


def test_contradictions_end_and_empty_graphs_are_concurrent(spark):
    loop = spark.createDataFrame([(1, 3, 2, 2), (2, 4, 1, 1)], SCHEMA)
    pairs = spark.createDataFrame([(1, 2, 2, 3, "x"), (1, 4, 2, 1, "y"), (1, 1, 1, 2, "z")], "probe_a long, ticks_a long, probe_b long, ticks_b long, relation_of string")
    got = {r.relation_of: r.relation for r in order.relations(order.causal_index(loop), pairs).collect()}
    assert got == {"x": "both", "y": "after", "z": "before"}
    none = order.causal_index(loop.limit(0))
    assert [r.relation for r in order.relations(none, pairs).orderBy("relation_of").collect()] == ["concurrent", "concurrent", "before"]
