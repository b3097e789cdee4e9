"""Streams over micro-batches against the batch operators over what has arrived."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.functions import words as W
from causeway.operators import decoded, entries, graph, scan, timeline
from causeway.streaming import live, reader

ME = 7
REPORTS = "probe_id long, seq_num long, frontier array<struct<probe_id:long,epoch:int,ticks:int>>, words array<long>"


class Runs:
    """A stream of files, one micro-batch after the other."""

    def __init__(self, spark, tmp_path, schema, make, mode="append"):
        self.spark, self.at, self.schema, self.make, self.mode = spark, tmp_path, schema, make, mode
        self.rows = []

    def put(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.at}/in")
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.at}/in")
        got = []
        query = self.make(stream).writeStream.outputMode(self.mode).foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", f"{self.at}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
        self.rows += got
        return got


def log_of(rnd, n):
    out = []
    for _ in range(n):
        ns, x = rnd.randrange(1 << 61), rnd.randrange(1 << 32)
        out += rnd.choice([[rnd.randrange(1, 99)], [0x40000000 | 7, x], [0x80000000 | 9, x], [0xE0000000 | ns >> 32, ns & 0xFFFFFFFF, 0x40000003, x], [0xE0000000 | ns >> 32, ns & 0xFFFFFFFF, 5]])
    return out


def chunks_of(rnd, probe, log, lost=()):
    at, out = 0, []
    while at < len(log):
        n = rnd.choice([1, 2, 5, 9])
        out.append((probe, at, log[at : at + n]))
        at += n
    return [c for i, c in enumerate(out) if i not in lost]


def test_shuffled_chunks_give_the_batch_result_and_loss_waits_for_its_timer(spark, tmp_path):
    rnd = random.Random(1)
    chunks = chunks_of(rnd, 1, log_of(rnd, 40)) + chunks_of(rnd, 2, log_of(rnd, 40), lost=(3, 4, 9))
    schema = "probe_id long, start long, words array<long>, sent_at timestamp"
    runs = Runs(spark, tmp_path, schema, lambda s: reader.read_entries(s.withWatermark("sent_at", "0 seconds"), "10 minutes"))
    order = chunks[:]
    rnd.shuffle(order)
    when = lambda minute: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minute))

    def at(minute, rows):
        frame = spark.createDataFrame(rows, "probe_id long, start long, words array<long>").withColumn("sent_at", when(minute))
        return [tuple(r) for r in frame.collect()]

    third = len(order) // 3
    for run in range(3):
        runs.put(at(run, order[run * third : (run + 1) * third if run < 2 else None]))
    early = list(runs.rows)
    assert not any(r.missed for r in early)
    want = sorted((tuple(r) for r in scan.parse_chunks(spark.createDataFrame(chunks, "probe_id long, start long, words array<long>")).collect()), key=str)
    assert {tuple(r) for r in early if r.probe_id == 1} == {r for r in want if r[0] == 1}
    runs.put(at(5, [(3, 0, [1])]))
    assert not any(r.missed for r in runs.rows)  # the timer has not run out
    runs.put(at(30, [(3, 1, [1])]))
    got = sorted((tuple(r) for r in runs.rows if r.probe_id != 3), key=str)
    assert got == want and sum(r[2] > 0 for r in got) == 2


def told(name, payload=None):
    code = W.INTERNAL_EVENTS[name]
    return [code] if payload is None else [0x40000000 | code, payload]


def clock(probe, epoch, ticks):
    return [0x80000000 | probe, epoch << 16 | ticks]


def report_set(rnd, probe, n):
    """Reports with clocks, foreign clocks, overflows at their ends, misses, empty ones."""
    out, ticks, epoch = [], 0, 0
    head = []
    for seq in range(n):
        own = (epoch, ticks)
        words, head = head, []
        for _ in range(rnd.randrange(0, 6)):
            kind = rnd.randrange(6)
            if kind == 0:
                ticks += 1
                words += clock(probe, epoch, ticks)
            elif kind == 1:
                words += clock(9, 1, rnd.randrange(9))
            elif kind == 2 and rnd.random() < 0.3:
                words += told("items_missed", 3)
            else:
                words += [rnd.randrange(1, 9)]
        if rnd.random() < 0.25:
            epoch, ticks = epoch + 1, 1
            over = told("clock_overflowed", epoch) + (told("invalid_next_epoch") if rnd.random() < 0.5 else [])
            if rnd.random() < 0.5:
                words, head = words + over, clock(probe, epoch, 1)
            else:
                words += over + clock(probe, epoch, 1)
        out.append((probe, seq, [(probe, *own)] if rnd.random() < 0.9 else [], words))
    return out


def batch(spark, reports):
    frame = spark.createDataFrame(reports, REPORTS)
    rows = decoded.timeline(frame.drop("words"), entries.parse(frame.select("probe_id", "seq_num", "words"), ["probe_id", "seq_num"]))
    return sorted((tuple(r) for r in rows.select(*live._NAMES).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reports_are_placed_one_by_one_as_all_at_once(spark, seed):
    rnd = random.Random(seed)
    kept = [r for probe in range(1, 30) for r in report_set(rnd, probe, 8) if rnd.random() > 0.15]
    out = []
    for probe in {r[0] for r in kept}:
        state = live.START
        for p, seq, front, words in (r for r in kept if r[0] == probe):
            rows, state = live.placed(p, seq, front[0][1] << 16 | front[0][2] if front else None, words, state)
            out += rows
    assert sorted(out, key=str) == batch(spark, kept)


def test_live_timeline_equals_the_batch_at_every_border(spark, tmp_path):
    rnd = random.Random(4)
    reports = [r for probe in range(1, 6) for r in report_set(rnd, probe, 6)]
    runs = Runs(spark, tmp_path, REPORTS, live.timeline)
    arrived = []
    for lo in (0, 2, 4):
        some = [r for r in reports if lo <= r[1] < lo + 2 and (r[0] != 3 or r[1] != 2)]
        rnd.shuffle(some)
        arrived += some
        runs.put([*some, some[0]])
        assert sorted((tuple(r) for r in runs.rows), key=str) == batch(spark, arrived)
    assert any(r.event_count is None for r in runs.rows)


def test_live_frontier_never_goes_back(spark, tmp_path):
    rnd = random.Random(5)
    zone = lambda: rnd.choice([rnd.randrange(65532, 65536), rnd.randrange(0, 4), rnd.randrange(4, 99)])
    schema = "probe_id long, neighbor_id long, pos long, epoch long, ticks long"
    rows = [(rnd.randrange(1, 4), rnd.randrange(1, 4), i, zone(), rnd.randrange(3)) for i in range(90)]
    runs = Runs(spark, tmp_path, schema, live.frontier, "update")
    now, stale = {}, 0
    for run in range(3):
        some = rows[30 * run : 30 * run + 30]
        rnd.shuffle(some)
        changed = {(r.probe_id, r.neighbor_id): (r.epoch, r.ticks) for r in runs.put(some)}
        stale += len({r[:2] for r in some}) - len(changed)
        now |= changed
        want = {(r.probe_id, r.neighbor_id): (r.epoch, r.ticks) for r in graph.frontier(spark.createDataFrame(rows[: 30 * run + 30], schema)).collect()}
        assert now == want


def test_late_and_repeated_reports_give_the_batch_gaps(spark, tmp_path):
    rnd = random.Random(6)
    every = [(p, n) for p in range(1, 5) for n in range(25) if rnd.random() > 0.2]
    late = every + rnd.sample(every, 20)
    rnd.shuffle(late)
    runs = Runs(spark, tmp_path, "probe_id long, seq_num long", live.report_changes)
    for run in range(3):
        runs.put(late[run * 30 : run * 30 + 30 if run < 2 else None])
        so_far = spark.createDataFrame(late[: run * 30 + 30 if run < 2 else None], "probe_id long, seq_num long")
        want = sorted(tuple(r) for r in timeline.report_gaps(so_far).select("probe_id", "seq_num", "missing").collect())
        changes = spark.createDataFrame(runs.rows, live.CHANGES)
        assert sorted((r.probe_id, r.seq_num, r.missing) for r in live.open_gaps(changes).collect()) == want
    through = [(r.probe_id, r.seq_num) for r in runs.rows if r.kind == "report"]
    assert sorted(through) == sorted(every)


def test_intervals_merge():
    rnd = random.Random(7)
    for _ in range(300):
        order = rnd.sample(range(12), 9)
        held, gaps = [], {}
        for n in order:
            held, opened, closed = live.joined(held, n)
            for g in closed:
                if g[1]:
                    del gaps[g]
            gaps |= dict.fromkeys(opened)
            seen = sorted(order[: order.index(n) + 1])
            assert sorted(x for lo, hi in held for x in range(lo, hi + 1)) == seen
            assert all(a[1] + 1 < b[0] for a, b in zip(held, held[1:], strict=False))
            assert set(gaps) == {(b, b - a - 1) for a, b in zip([-1, *seen], seen, strict=False) if b - a > 1}


