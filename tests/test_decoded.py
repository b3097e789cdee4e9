"""Decoded logs with the recorder's own events, losses and splits; files, ids, clocks of a probe's own, and the reader."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.functions import words as W
from causeway.operators import decoded, entries, graph, timeline
from causeway.sources import wire
from causeway.streaming import reader

ME, OTHER = 7, 9


def clock(probe, epoch, ticks):
    return [0x80000000 | probe, epoch << 16 | ticks]


def told(name, payload=None):
    code = W.INTERNAL_EVENTS[name]
    return [code] if payload is None else [0x40000000 | code, payload]


INIT = [*clock(ME, 0, 0), *told("probe_initialised")]


def rows_of(spark, reports):
    """[(clock, event_count, meaning or event_id or kind)] by report."""
    frame = spark.createDataFrame([(ME, n, [(ME, *own)] if own else [], log) for n, own, log in reports], "probe_id long, seq_num long, frontier array<struct<probe_id:long,epoch:int,ticks:int>>, words array<long>")
    parsed = entries.parse(frame.select("probe_id", "seq_num", "words"), ["probe_id", "seq_num"])
    out = {}
    for r in decoded.timeline(frame.drop("words"), parsed).orderBy("seq_num", "entry_idx").collect():
        at = None if r.clock_at is None else (r.clock_at >> 16, r.clock_at & 65535)
        out.setdefault(r.seq_num, []).append((at, r.event_count, r.meaning or r.event_id or r.kind))
    return out


def test_a_fresh_probe_counts_its_own_start(spark):
    got = rows_of(spark, [(0, (0, 0), [*INIT, *told("invalid_next_epoch"), 5, *clock(ME, 0, 1), 6])])
    zero, one = (0, 0), (0, 1)
    assert got[0] == [(zero, 0, "clock"), (zero, 1, "probe_initialised"), (zero, 2, "invalid_next_epoch"), (zero, 3, 5), (one, 0, "clock"), (one, 1, 6)]


def test_counts_go_on_across_reports_until_a_loss(spark):
    got = rows_of(spark, [
        (0, (0, 0), [*INIT, 5]), (1, (0, 0), [6, 6]), (2, (0, 0), [*told("produced_report"), 6]), (4, (0, 0), [8]), (5, (0, 0), [8, *clock(ME, 0, 1), 8]),
        (6, (0, 1), [*told("items_missed", 30), 9]), (7, (0, 1), [9]), (8, None, told("insufficient_report_buffer")), (9, (0, 1), [*clock(ME, 0, 2), 9]), (10, (0, 2), []), (11, (0, 2), [9]),
    ])
    zero, one, two = (0, 0), (0, 1), (0, 2)
    assert got[1] == [(zero, 3, 6), (zero, 4, 6)] and got[2] == [(zero, 5, "produced_report"), (zero, 6, 6)]
    assert got[4] == [(zero, None, 8)]  # report 3 is missing
    assert got[5] == [(zero, None, 8), (one, 0, "clock"), (one, 1, 8)]
    assert [x[1:] for x in got[6]] == [(None, "items_missed"), (None, 9)] and got[7] == [(one, None, 9)]
    assert got[8][0][2] == "insufficient_report_buffer"
    assert got[9] == [(two, 0, "clock"), (two, 1, 9)] and got[11] == [(two, 2, 9)]


@pytest.mark.parametrize("split", [None, 1, 2])
def test_an_overflow_opens_the_segment_that_it_announces(spark, split):
    announced = [told("clock_overflowed", 4), told("invalid_next_epoch"), [*clock(ME, 4, 1)], [5]]
    before, after = (0, 65535), (4, 1)
    logs = [[*INIT, *clock(ME, *before), 5, *sum(announced[:split], [])], sum(announced[split:], []) if split else []]
    got = rows_of(spark, [(0, (0, 0), logs[0]), *([(1, before, logs[1])] if split else [])])
    flat = got[0] + got.get(1, [])
    assert flat[2:] == [(before, 0, "clock"), (before, 1, 5), (after, 1, "clock_overflowed"), (after, 2, "invalid_next_epoch"), (after, 2, "clock"), (after, 3, 5)]


def test_timeline_of_random_logs_does_not_hang_on_how_they_are_cut(spark):
    rng = random.Random(3)
    pieces, ticks = [INIT[:2], INIT[2:]], 0
    for _ in range(300):
        if rng.random() < 0.2:
            ticks += 1
            pieces.append([*clock(ME, 0, ticks), *(clock(OTHER, 0, 5) if rng.random() < 0.5 else [])])
        else:
            pieces.append(rng.choice([[3], [0x40000004, 1], [0xE0000000, 1, 3], [0xC0000000, 2], told("num_clocks_overflowed")]))
    reports, log, own, seen = [], [], 0, 0
    for p in pieces:
        log += p
        seen = p[1] & 65535 if p[0] == 0x80000000 | ME else seen
        if rng.random() < 0.3:
            reports.append((len(reports), (0, own), log))
            log, own = [], seen
    whole = rows_of(spark, [(0, (0, 0), sum((r[2] for r in reports), []))])[0]
    assert sum(rows_of(spark, reports).values(), []) == whole


def test_interactions_see_past_an_overflow_between_both_clocks(spark):
    log = [*INIT, *clock(ME, 0, 1), *told("num_clocks_overflowed"), *clock(OTHER, 3, 4), *clock(ME, 0, 2), 5, *clock(OTHER, 3, 5), *clock(ME, 0, 3), *clock(ME, 0, 4)]
    parsed = entries.parse(spark.createDataFrame([(ME, 0, log)], "probe_id long, seq_num long, words array<long>"), ["probe_id", "seq_num"])
    assert [tuple(r) for r in graph.interactions_of(parsed).collect()] == [(ME, 1, OTHER, 3 << 16 | 4)]


def test_malformed_and_orphaned_words(spark):
    logs = [[0, 5], [0x40000000, 5, 6], [0xE0000000, 1], [0xE0000001, 2, 0xE0000000, 3, 5], [0x80000001], [5, 0xE0000000, 9]]
    parsed = entries.parse(spark.createDataFrame([(i, log) for i, log in enumerate(logs)], "i int, words array<long>"), ["i"]).orderBy("i", "entry_idx").collect()
    assert [(r.i, r.kind, r.event_id, r.payload_raw, r.n_words) for r in parsed] == [
        (0, "event", None, None, 1), (0, "event", 5, None, 1), (1, "event_payload", None, 5, 2), (1, "event", 6, None, 1), (3, "time", None, None, 4), (3, "event", 5, None, 1), (5, "event", 5, None, 1),
    ]


def test_all_logs_of_a_batch_parse_like_one_by_one(spark):
    rng = random.Random(8)
    words = [0, 1, 5, 0x40000000, 0x40000009, 0x80000003, 0xC0000001, 0xE0000002, 0xFFFFFFFF, 0x7FFFFFFF]
    logs = [[rng.choice(words) for _ in range(rng.randrange(40))] for _ in range(400)] + [None, [], [0xE0000000] * 4099]
    got = {}
    for r in entries.parse(spark.createDataFrame(list(enumerate(logs)), "i int, words array<long>").repartition(3), ["i"]).orderBy("i", "entry_idx").collect():
        got.setdefault(r.i, []).append((r.entry_idx, r.word_off, r.n_words, r.kind, r.event_id, r.payload_raw, r.clock_probe_id, r.clock_word, r.time_ns))
    for i, log in enumerate(logs):
        want, off = [], 0
        for k, e in enumerate(entries.entries_of(log or [])[0]):
            want.append((k, off, *e))
            off += e[0]
        assert got.get(i, []) == want


def test_report_files_and_manifests_end_to_end(spark, tmp_path):
    golden = bytes.fromhex("5450524d01000000020000000800000000000000" "00ff000000010002000300000001000000020000000300000004000000050000000600000007000000")
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.report").write_bytes(golden)
    (tmp_path / "r" / "b.report").write_bytes(golden[:40])
    (tmp_path / "r" / "c.report").write_bytes(golden + b"more")
    rows = wire.read_reports(spark, f"{tmp_path}/r").orderBy("path").collect()
    a = rows[0]
    assert (a.probe_id, a.clock_word, a.seq_num, a.persistent_epoch, a.time_resolution, a.wall_clock_id, a.error) == (1, 2, 8, False, 255, 1, None)
    assert [tuple(c) for c in a.frontier] == [(1, 0, 2), (3, 0, 4)] and a.words == [5, 6, 7] == rows[2].words
    assert (rows[1].error, rows[1].words) == ("IncompletePayload", None)
    (tmp_path / "events.csv").write_text("id,name,description,tags,severity,type_hint\n5,sampled,\"took {}, fine\",producer;EXPECTATION,3,u8\n6,bad,,failure,9,\n")
    manifest = wire.read_manifest(spark, f"{tmp_path}/events.csv")
    seen = spark.createDataFrame([(5, 0), (5, 1), (6, None)], "event_id long, payload_raw long")
    assert sorted(tuple(r) for r in graph.expectations(seen, manifest).collect()) == [(5, "sampled", 2, 1, 0), (6, "bad", 0, 0, 1)]


def test_snapshots_are_checked(spark):
    raw = [bytes.fromhex("010000000200030004000500"), bytes(12), bytes(11), bytes.fromhex("0100000002000300040005ff")]
    got = [r.s for r in spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(raw)], "i int, b binary").select("i", wire.decoded_snapshot(F.col("b")).alias("s")).orderBy("i").collect()]
    assert [(s.probe_id, s.epoch, s.ticks, s.reserved, s.error) for s in got[:2]] == [(1, 3, 2, "04000500", None), (0, 0, 0, "00000000", "InvalidProbeId")]
    assert got[2].error == "MissingBytes" and got[3].reserved == "040005ff"


@pytest.mark.parametrize("kind", ["tinyint", "smallint", "int", "bigint", "decimal(38,0)", "string"])
def test_ids_of_any_width(spark, kind):
    values = [-1, 0, 1, 127] + ([W.MAX_ID - 256, W.MAX_ID - 255, W.MAX_ID, W.MAX_ID + 1] if kind in ("int", "bigint", "decimal(38,0)", "string") else []) + ([10**30] if kind in ("decimal(38,0)", "string") else [])
    rows = spark.createDataFrame([(str(v),) for v in values], "v string").select("v", F.col("v").cast(kind).alias("x")).select("v", W.probe_id(F.col("x")).alias("p"), W.event_id(F.col("x"), False).alias("e")).collect()
    for r in rows:
        v = int(r.v)
        assert r.p == (v if 1 <= v <= W.MAX_ID else None) and r.e == (v if 1 <= v <= W.MAX_USER_EVENT else None)


def test_reader_equals_a_parse_of_what_arrived():
    rng = random.Random(5)
    for _ in range(200):
        log = [w for _ in range(rng.randrange(1, 12)) for w in rng.choice([[1], [0x40000002, 9], [0xE0000000, 4, 1], [0xE0000000, 4, 0x40000002, 8], clock(ME, 0, 3)])]
        bounds = {0}
        for e in entries.entries_of(log)[0]:
            bounds.add(max(bounds) + e[0])
        at, held, out, lost, sent = 0, [], [], 0, 0
        while sent < len(log):
            start, end = max(0, sent - rng.randrange(3)), min(len(log), sent + rng.randrange(1, 5))
            skip = [b for b in bounds if b > sent]
            if rng.random() < 0.2 and skip:  # a gap up to where an entry starts
                start, end = min(skip), min(len(log), min(skip) + 3)
            at, held, more, found = reader.advance(at, held, start, log[start:end])
            out += found
            lost += more
            sent = max(sent, end)
        assert sum(e[0] for _, e in out) + lost + len(held) == len(log)
        assert all(entries.entry_at(log, p) == e for p, e in out)


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_instants_do_not_hang_on_blocks(spark, block):
    rng = random.Random(2)
    script = [(rng.randrange(3), pos, rng.choice(["event", "event", "event", "produce", "merge"])) for pos in range(300)]
    ticks, counts, want = {}, {}, {}
    for probe, pos, op in script:
        if op == "event":
            counts[probe] = counts.get(probe, 0) + 1
        else:
            ticks[probe], counts[probe] = ticks.get(probe, 0) + 1, 0
        want[pos] = (ticks.get(probe, 0), counts[probe])
    rows = timeline.instants(spark.createDataFrame(script, "probe_id long, pos long, op string"), block).collect()
    assert {r.pos: (r.ticks, r.event_count) for r in rows} == want
