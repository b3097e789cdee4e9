"""Timelines, frontiers and gaps while reports arrive: the batch operators' results at every border of micro-batches.

All state is RocksDB's. A probe's timeline needs a few numbers between reports: the last report's number, the clock of its
segment, the events counted in it, whether that count is known, and whether an overflow has announced the next clock. A
frontier is a map from neighbours to clocks with a conditional update. What of a probe's reports has come is kept as
intervals of numbers, of which there is one more than there are gaps. As in `reader`, a key of the state is a bucket of probes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from causeway.functions import words as W
from causeway.operators.decoded import OUTSIDE
from causeway.operators.entries import FIELDS, entries_of
from causeway.operators.scan import supersede
from causeway.streaming.reader import _NONE, Kept, Pieces, Timed, bucket_of, with_rocksdb

_EVENTS = {code: name for name, code in W.INTERNAL_EVENTS.items()}
TIMELINE = f"probe_id long, seq_num long, entry_idx int, {FIELDS}, clock_at long, event_count long, meaning string"
_NAMES = [f.split()[0] for f in TIMELINE.split(", ")]
_TYPES = [{"long": "Int64", "int": "Int32", "string": "object"}[f.split()[1]] for f in TIMELINE.split(", ")]

#: What goes from report to report: number of the last one, whether it told of a clock at its end, the last clock that it
#: opened (-1: none), whether the count of events is known, and the count.
START = (-1, False, -1, True, 0)
#: Rows of a frame that is put out before its micro-batch ends.
PENDING_ROWS = 1 << 16


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.array(list(c), dtype=k) for n, c, k in zip(_NAMES, zip(*rows, strict=True), _TYPES, strict=True)})


def placed(probe: int, seq: int, own: int | None, words: list[int], state: tuple) -> tuple[list[tuple], tuple]:
    """(rows of one report's entries with clock_at, event_count and meaning, the state behind it), by the rules of
    `decoded.timeline`; own is the packed clock of the probe in the report's frontier."""
    last_seq, was_told, was_last, known, carried = state
    entries, _ = entries_of(words)
    names = [_EVENTS.get(e[2]) if e[2] is not None else None for e in entries]
    told = missed = False
    n, base, clock, first = 0, 0, None, None
    marks = []
    for i, (e, name) in enumerate(zip(entries, names, strict=True)):
        before = names[i - 1] if i else None
        two = names[i - 2] if i > 1 else None
        announced = before == "clock_overflowed" or (before == "invalid_next_epoch" and two == "clock_overflowed")
        is_own = e[1] == "clock" and e[4] == probe
        if is_own and (i == 0 or (i == 1 and before == "invalid_next_epoch")):
            first = e[5] if first is None else max(first, e[5])
        counts = int(e[1] != "clock" and name not in OUTSIDE)
        n += counts
        opens = ((e[3] or 0) & 0xFFFF) * 65536 + 1 if name == "clock_overflowed" else e[5] if is_own and not announced else None
        if opens is not None:
            clock, base = opens, n - counts
        missed |= name == "items_missed"
        told = name == "clock_overflowed" or (name == "invalid_next_epoch" and announced)
        marks.append((clock, n, base))
    lost = last_seq != seq - 1 or missed
    goes_on = not lost and was_told and first is not None and first == was_last
    carry = carried if known and not lost else None
    rows = []
    for i, (e, name, (at, upto, since)) in enumerate(zip(entries, names, marks, strict=True)):
        if at is None or (goes_on and at == first):
            count = None if carry is None else carry + upto
        else:
            count = upto - since
        where = at if at is not None else was_last if carry is not None and was_told and was_last >= 0 else own
        rows.append((probe, seq, i, *e, where, count, name))
    if clock is not None and not (goes_on and clock == first):
        known, carried = True, n - base
    elif lost:
        known, carried = False, 0
    else:
        carried += n
    return rows, (seq, told, -1 if clock is None else clock, known, carried)


class LiveTimeline(StatefulProcessor):
    """Reports (probe_id, seq_num, own, words[, deadline]) in order of seq_num, early ones waiting, into timeline rows."""

    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = Kept(handle, "place", "probe long", "seq long, told boolean, last long, known boolean, n long, waiting array<struct<seq:long,deadline:long,own:long,n:int,piece:long,offset:int>>")
        self.early = Pieces(handle, "early")
        self.timed = Timed(handle)

    def _open(self) -> None:
        #: Of each probe: its state, a heap of the numbers that wait, and their deadlines, own clocks, sizes and places.
        self.states: dict[int, list] = {}
        self.rows: list[tuple] = []
        self.places.open()
        self.early.open()

    def _load(self, probes: Iterable[int]) -> None:
        for (probe,), row in self.places.get((p,) for p in probes):
            known = {w[0]: w[1:] for w in row[5]} if row is not None else {}
            starts = list(known)
            heapify(starts)
            self.states[probe] = [tuple(row[:5]) if row is not None else START, starts, known]

    def _place(self, probe: int, state: list, seq: int, own: int | None, words: list[int]) -> None:
        rows, state[0] = placed(probe, seq, own, words, state[0])
        self.rows += rows

    def _flush(self, least: int = 1) -> Iterator[pd.DataFrame]:
        if len(self.rows) >= least:
            rows, self.rows = self.rows, []
            yield _frame(rows)

    def _go(self, probe: int, state: list, upto: int | None) -> Iterator[pd.DataFrame]:
        seqs, known = state[1], state[2]
        due = max((seq for seq, (deadline, *_) in known.items() if deadline <= upto), default=-1) if upto is not None else -1
        while seqs and (seqs[0] <= state[0][0] + 1 or seqs[0] <= due):
            seq = heappop(seqs)
            _, own, n, piece, offset = known.pop(seq)
            self._place(probe, state, seq, own, self.early.take(piece, offset, n).tolist())
            yield from self._flush(PENDING_ROWS)

    def _save(self, waited: Iterable[int]) -> None:
        for probe, (state, _, known) in self.states.items():
            self.places.put((probe,), (*state, [(seq, *known[seq]) for seq in sorted(known)]))
        self.places.close()
        self.early.close()
        if self.wait_ms is not None:
            self.timed.set({p: min((d for d, *_ in self.states[p][2].values()), default=_NONE) for p in waited})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._open()
        timers, waited = set(), set()
        for frame in rows:
            owns = [None if pd.isna(x) else int(x) for x in frame["own"]]
            deadlines = map(int, frame["deadline"]) if self.wait_ms is not None else [0] * len(frame)
            reports = sorted(zip(frame["probe_id"].tolist(), frame["seq_num"].tolist(), owns, frame["words"], deadlines, strict=True), key=lambda r: r[:2])
            self._load({r[0] for r in reports})
            waited.update(p for p in {r[0] for r in reports} if self.states[p][2])
            for probe, seq, own, words, deadline in reports:
                state = self.states[probe]
                if seq <= state[0][0] or seq in state[2]:
                    continue  # come before, or too late
                words = np.asarray(words, np.int64)
                if seq == state[0][0] + 1:
                    self._place(probe, state, seq, own, words.tolist())
                    if state[1]:
                        yield from self._go(probe, state, None)
                    yield from self._flush(PENDING_ROWS)
                    continue
                heappush(state[1], seq)
                state[2][seq] = (deadline, own, len(words), *self.early.put(words))
                waited.add(probe)
                timers.add(deadline)
            yield from self._flush()
        if self.wait_ms is None:
            for probe in sorted(waited):
                yield from self._go(probe, self.states[probe], _NONE)
            yield from self._flush()
        else:
            for deadline in timers:
                self.handle.registerTimer(deadline)
        self._save(waited)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        probes = self.timed.due(upto)
        if not probes:
            return
        self._open()
        self._load(probes)
        for probe in sorted(probes):
            yield from self._go(probe, self.states[probe], upto)
        yield from self._flush()
        self._save(probes)

    def close(self) -> None:
        pass


def timeline(reports: DataFrame, wait: str | None = None, sent: str = "sent_at") -> DataFrame:
    """The rows of `decoded.timeline` of a stream of decoded reports (probe_id, seq_num, frontier, words), as they arrive.

    Reports that come again are left out. One that comes before its turn waits until those before it have come, or until the
    watermark on `sent` has passed its time by wait; without wait, until the end of its micro-batch. What is missing then is
    lost: the count of events is unknown up to the next clock, and a report that comes even later is left out.
    """
    with_rocksdb(reports.sparkSession)
    self_clock = F.filter("frontier", lambda c: c["probe_id"] == F.col("probe_id"))
    own = F.when(F.size(self_clock) > 0, F.element_at(self_clock, 1)["epoch"].cast("long") * 65536 + F.element_at(self_clock, 1)["ticks"]).alias("own")
    longs = [F.col(c).cast("long").alias(c) for c in ("probe_id", "seq_num")]
    rows = reports.where("probe_id is not null and seq_num is not null and words is not null")
    if wait is None:
        return rows.select(*longs, own, "words").withColumn("bucket", bucket_of("probe_id")).groupBy("bucket").transformWithStateInPandas(LiveTimeline(None), TIMELINE, "Append", "None")
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    rows = rows.select(*longs, own, "words", sent, (F.unix_millis(sent) + wait_ms).alias("deadline"))
    return rows.withColumn("bucket", bucket_of("probe_id")).groupBy("bucket").transformWithStateInPandas(LiveTimeline(wait_ms), TIMELINE, "Append", "EventTime")


class LiveFrontier(StatefulProcessor):
    """A probe's latest clock of each neighbour; rows of the neighbours whose clock has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = Kept(handle, "latest", "probe long, neighbor_id long", "clock long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        had: dict[tuple, int] = {}
        now: dict[tuple, int] = {}
        self.latest.open()
        for frame in rows:
            clocks = sorted(zip(*(frame[c].tolist() for c in ("pos", "probe_id", "neighbor_id", "clock")), strict=True))
            for pair, row in self.latest.get((probe, neighbour) for _, probe, neighbour, _ in clocks):
                now[pair] = had[pair] = -1 if row is None else row[0]
            for _, probe, neighbour, clock in clocks:
                now[probe, neighbour] = supersede(now[probe, neighbour], clock)
        changed = sorted(p for p in now if now[p] != had[p])
        for pair in changed:
            self.latest.put(pair, (now[pair],))
        self.latest.close()
        if changed:
            clocks = np.array([now[p] for p in changed])
            probes, neighbours = zip(*changed, strict=True)
            yield pd.DataFrame({"probe_id": probes, "neighbor_id": neighbours, "epoch": clocks >> 16, "ticks": clocks & 65535})

    def close(self) -> None:
        pass


def frontier(clocks: DataFrame) -> DataFrame:
    """(probe_id, neighbor_id, epoch, ticks) of a stream of (probe_id, neighbor_id, pos, epoch, ticks): the neighbours whose latest
    clock a micro-batch has changed; a stale clock changes nothing. Micro-batches follow pos, within one the rows are sorted."""
    with_rocksdb(clocks.sparkSession)
    rows = clocks.dropna(subset=["probe_id", "neighbor_id", "pos", "epoch", "ticks"]).select(*(F.col(c).cast("long").alias(c) for c in ("probe_id", "neighbor_id", "pos")), (F.col("epoch").cast("long") * 65536 + F.col("ticks")).alias("clock"))
    return rows.withColumn("bucket", bucket_of("probe_id")).groupBy("bucket").transformWithStateInPandas(LiveFrontier(), "probe_id long, neighbor_id long, epoch long, ticks long", "Update", "None")


def joined(intervals: list[tuple[int, int]], n: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """(intervals with n, gaps that open, gaps that close) of sorted intervals from 0 on that lack n; a gap is (the number
    behind it, numbers missing)."""
    at = bisect_right(intervals, (n, n))
    before = intervals[at - 1][1] if at else -1
    behind = intervals[at][0] if at < len(intervals) else None
    opened, closed = [], []
    if n - before > 1:
        opened.append((n, n - before - 1))
    if behind is not None:
        closed.append((behind, behind - before - 1))
        if behind - n > 1:
            opened.append((behind, behind - n - 1))
    low = intervals.pop(at - 1)[0] if at and before == n - 1 else n
    at = bisect_right(intervals, (low, low))
    high = intervals.pop(at)[1] if behind == n + 1 else n
    intervals.insert(at, (low, high))
    return intervals, opened, closed


CHANGES = "probe_id long, epoch long, seq_num long, kind string, missing long, change int"


class ReportGate(StatefulProcessor):
    """Lets each report through once and tells how gaps change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = Kept(handle, "seen", "probe long, epoch long", "intervals array<struct<lo:long,hi:long>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every: dict[tuple, list] = {}
        self.seen.open()
        for frame in rows:
            reports = list(zip(*(frame[c].tolist() for c in ("probe_id", "epoch", "seq_num")), strict=True))
            for start, row in self.seen.get((probe, epoch) for probe, epoch, _ in reports):
                every[start] = [tuple(x) for x in row[0]] if row is not None else []
            out = []
            for probe, epoch, n in reports:
                held = every[probe, epoch]
                at = bisect_right(held, (n, 1 << 62))
                if at and held[at - 1][1] >= n:
                    continue
                every[probe, epoch], opened, closed = joined(held, n)
                out.append((probe, epoch, n, "report", None, 1))
                out += [(probe, epoch, seq, "gap", missing, 1) for seq, missing in opened] + [(probe, epoch, seq, "gap", missing, -1) for seq, missing in closed if missing]
            if out:
                probes, epochs, seqs, kinds, missing, change = zip(*out, strict=True)
                yield pd.DataFrame({"probe_id": pd.array(probes, "Int64"), "epoch": pd.array(epochs, "Int64"), "seq_num": seqs, "kind": kinds, "missing": pd.array(missing, "Int64"), "change": np.array(change, np.int32)})
        for start, held in every.items():
            self.seen.put(start, (held,))
        self.seen.close()

    def close(self) -> None:
        pass


def report_changes(reports: DataFrame) -> DataFrame:
    """What a stream of reports (probe_id, seq_num, and epoch where restarts are tracked) changes, to be summed up.

    Rows (probe_id, epoch, seq_num, kind, missing, change): a report once, however often it comes; a gap of so many reports
    before seq_num that opens (1) or closes (-1). `open_gaps` of all rows so far are the gaps of all reports so far.
    """
    with_rocksdb(reports.sparkSession)
    epoch = F.coalesce(F.col("epoch").cast("long"), F.lit(0)) if "epoch" in reports.columns else F.lit(0).cast("long")
    rows = reports.where("probe_id is not null and seq_num >= 0").select(F.col("probe_id").cast("long").alias("probe_id"), epoch.alias("epoch"), F.col("seq_num").cast("long").alias("seq_num"))
    return rows.withColumn("bucket", bucket_of("probe_id")).groupBy("bucket").transformWithStateInPandas(ReportGate(), CHANGES, "Append", "None")


def open_gaps(changes: DataFrame) -> DataFrame:
    """(probe_id, epoch, seq_num, missing) of the gaps that are open after all these changes."""
    total = changes.where("kind = 'gap'").groupBy("probe_id", "epoch", "seq_num", "missing").agg(F.sum("change").alias("n"))
    return total.where("n > 0").drop("n")
