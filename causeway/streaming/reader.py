"""Incremental reading of probe logs: whole entries out, partial ones kept for the next chunk, losses counted.

A chunk (probe_id, start, words) carries the words from position start on. Chunks of a probe may overlap what was read
(it is skipped) or leave a gap: the gap's words, and those of an entry that was begun before it, are missed.

State lives in RocksDB: how far a probe has been read, with the words of an entry that is not whole yet and the starts of the
chunks that wait; those chunks; and the first deadline among them. A chunk that closes a gap lets the waiting ones go on, and a
gap counts as lost only when the timer of the chunk behind it runs out.

A call of a processor has a price, so have each tiny frame and each call of the state. Probes are therefore dealt over BUCKETS
keys, whose state has pages with the rows of many probes, and what a micro-batch's frame brings for all probes of a bucket is
parsed at once. Early chunks go into the state in pieces of PIECE words and are parsed in parts of PENDING words, so that a probe
with very many of them needs no more memory.
"""

from __future__ import annotations

import pickle
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from causeway.operators.entries import FIELDS, columns_of, entries_of, places_of

SCHEMA = f"probe_id long, word_pos long, missed long, {FIELDS}"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_KINDS = ["Int64", "Int64", "Int64", "Int32", "object", *["Int64"] * 5]
_NONE = 1 << 62
#: Keys of the state, each with the rows of many probes; fixed for the life of a stream. Words that are parsed at once.
BUCKETS, PENDING = 1024, 1 << 20
#: Rows of a page of a bucket's map at most, on average; fixed as well. Words of a piece, and of the pieces in memory.
PAGE, PIECE, HELD = 256, 1 << 16, 1 << 21
_64 = (1 << 64) - 1
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_rocksdb(spark: SparkSession) -> None:
    """State of transformWithState is kept in RocksDB; it must be set before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def advance(at: int, held: list[int], start: int, words: list[int]) -> tuple[int, list[int], int, list[tuple]]:
    """(next position, words held back, words missed, [(position, entry)]) after one more chunk; one entry after the other."""
    lost = 0
    if start > at:
        lost, held, at = start - at + len(held), [], start
    fresh = words[at - start :]
    first = at - len(held)
    whole, rest = entries_of(held + fresh)
    out = []
    for e in whole:
        out.append((first, e))
        first += e[0]
    return at + len(fresh), rest, lost, out


def bucket_of(probe: Column | str) -> Column:
    return F.pmod(F.xxhash64(probe), F.lit(BUCKETS).cast("long")).alias("bucket")


class Kept:
    """Rows of a bucket's map, in pages by a hash of their keys: a call brings or puts a page of about PAGE rows, not one row.

    The number of pages follows that of the rows, which are never removed, and pages are split one by one: a bucket of very many
    rows is neither read nor written whole.
    """

    def __init__(self, handle: StatefulProcessorHandle, name: str, key: str, value: str):
        self.map, self.count = handle.getMapState(name, "page long", "rows binary"), handle.getValueState(f"n_{name}", "n long")
        self.form = f"{key}: {value}"

    @staticmethod
    def pages_of(n: int) -> int:
        return 1 << (n // PAGE).bit_length()

    @staticmethod
    def hash_of(key: tuple) -> int:
        h = 0
        for x in key:
            h = (h ^ (x & _64)) * 0x9E3779B97F4A7C15 & _64
            h ^= h >> 32
        return h

    def open(self) -> None:
        row = self.count.get()
        self.n = self.had = row[0] if row else 0
        self.asked: set[tuple] = set()
        self.pages: dict[int, dict[tuple, tuple]] = {}
        self.changed: set[int] = set()
        self.mask = self.pages_of(self.had) - 1

    def _page(self, number: int) -> dict[tuple, tuple]:
        rows = self.pages.get(number)
        if rows is None:
            rows = self.pages[number] = self._read(number) if self.had else {}
        return rows

    def _read(self, number: int) -> dict[tuple, tuple]:
        form, rows = pickle.loads(self.map.getValue((number,))[0])
        if form != self.form:
            raise ValueError(f"the state holds {form}, not {self.form}")
        return rows

    def _write(self, number: int, rows: dict[tuple, tuple]) -> None:
        self.map.updateValue((number,), (pickle.dumps((self.form, rows), 5),))

    def get(self, keys: Iterable[tuple]) -> Iterator[tuple[tuple, tuple | None]]:
        """(key, row or None) of the keys that have not been asked for since `open`."""
        new = set(keys) - self.asked
        self.asked |= new
        for k in new:
            yield k, self._page(self.hash_of(k) & self.mask).get(k)

    def put(self, key: tuple, row: tuple) -> None:
        """key has been asked for."""
        number = self.hash_of(key) & self.mask
        rows = self._page(number)
        self.n += key not in rows
        rows[key] = row
        self.changed.add(number)

    def close(self) -> None:
        pages = self.pages_of(self.n)
        if pages == self.mask + 1:
            for number in self.changed:
                self._write(number, self.pages[number])
        else:
            for number in range(self.mask + 1):
                rows = self.pages.pop(number, None)
                if rows is None:
                    rows = self._read(number) if self.had else {}
                parts: dict[int, dict] = {at: {} for at in range(number, pages, self.mask + 1)}
                for k, row in rows.items():
                    parts[self.hash_of(k) & (pages - 1)][k] = row
                for at, part in parts.items():
                    self._write(at, part)
        if self.n != self.had:
            self.count.update((self.n,))


class Pieces:
    """Words that wait, in pieces of about PIECE of them as they came: a call brings or puts a piece, not one chunk. A piece goes
    when none of its chunks waits any more; about HELD words of pieces are in memory."""

    def __init__(self, handle: StatefulProcessorHandle, name: str):
        self.map, self.index = handle.getMapState(name, "piece long", "words binary"), handle.getValueState(f"n_{name}", "waiting binary")

    def open(self) -> None:
        row = self.index.get()
        #: Chunks of each piece that wait.
        self.waiting: dict[int, int] = pickle.loads(row[0]) if row else {}
        self.read: OrderedDict[int, np.ndarray] = OrderedDict()
        self.n_read = 0
        self.changed = False
        self._begin()

    def _begin(self) -> None:
        self.piece, self.parts, self.offsets, self.size = max(self.waiting, default=-1) + 1, [], {}, 0

    def put(self, words: np.ndarray) -> tuple[int, int]:
        """Where the words of a chunk wait: (piece, offset)."""
        at = (self.piece, self.size)
        self.offsets[self.size] = len(self.parts)
        self.parts.append(words)
        self.size += max(len(words), 1)  # a chunk of no words has a place, too
        self.waiting[self.piece] = self.waiting.get(self.piece, 0) + 1
        self.changed = True
        if self.size >= PIECE:
            self._write()
        return at

    def _write(self) -> None:
        if self.piece in self.waiting:
            words = np.concatenate([np.asarray(p, np.int64) if len(p) else np.zeros(1, np.int64) for p in self.parts])
            self.map.updateValue((self.piece,), (words.tobytes(),))
        self._begin()

    def drop(self, piece: int) -> None:
        """One chunk of the piece waits no more."""
        self.changed = True
        self.waiting[piece] -= 1
        if not self.waiting[piece]:
            del self.waiting[piece]
            if piece == self.piece:
                self._begin()
            else:
                self.n_read -= len(self.read.pop(piece, ()))
                self.map.removeKey((piece,))

    def take(self, piece: int, offset: int, n: int) -> np.ndarray:
        if piece == self.piece:
            words = self.parts[self.offsets[offset]]
        else:
            if piece not in self.read:
                self.read[piece] = np.frombuffer(self.map.getValue((piece,))[0], np.int64)
                self.n_read += len(self.read[piece])
                while self.n_read > HELD and len(self.read) > 1:
                    self.n_read -= len(self.read.popitem(last=False)[1])
            self.read.move_to_end(piece)
            # A copy: what is left of a piece in memory must not hang on a few words of it.
            words = self.read[piece][offset : offset + n].copy()
        self.drop(piece)
        return words

    def close(self) -> None:
        if self.parts:
            self._write()
        if self.changed:
            self.index.update((pickle.dumps(self.waiting, 5),)) if self.waiting else self.index.clear()


class Timed:
    """The first deadline of each probe of a bucket that waits, all in one row, and the least of them: timers beyond the first
    that finds work are a lookup."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.waits, self.least = handle.getValueState("waits", "deadlines binary"), handle.getValueState("least", "deadline long")

    def _every(self) -> dict[int, int]:
        row = self.waits.get()
        return dict(np.frombuffer(row[0], np.int64).reshape(-1, 2).tolist()) if row else {}

    def set(self, deadlines: dict[int, int]) -> None:
        """Of each probe that waits, its first deadline; of the bucket, what comes first."""
        if not deadlines:
            return
        every = self._every() | deadlines
        every = {probe: deadline for probe, deadline in every.items() if deadline < _NONE}
        if every:
            self.waits.update((np.array(list(every.items()), np.int64).tobytes(),))
            self.least.update((min(every.values()),))
        else:
            self.waits.clear()
            self.least.clear()

    def due(self, upto: int) -> list[int]:
        """Probes whose first deadline has passed; `set` tells what becomes of them."""
        least = self.least.get()
        return [probe for probe, deadline in self._every().items() if deadline <= upto] if least and least[0] <= upto else []


def _nullable(c: pa.Array, kind: str) -> pd.api.extensions.ExtensionArray | np.ndarray:
    """Column by column: a frame of whole rows would turn long integers beside nulls into doubles."""
    if kind == "object":
        return c.to_numpy(zero_copy_only=False)
    values = c.fill_null(0).to_numpy(zero_copy_only=False).astype(kind.lower())
    return pd.arrays.IntegerArray(values, c.is_null().to_numpy(zero_copy_only=False))


class Run:
    """Words of a probe without a gap, from `first` on; before them gap words are missing, and what `prior` has left."""

    __slots__ = ("probe", "first", "parts", "gap", "prior", "rest")

    def __init__(self, probe: int, first: int, parts: list[np.ndarray], gap: int = 0, prior: Run | None = None):
        self.probe, self.first, self.parts, self.gap, self.prior, self.rest = probe, first, parts, gap, prior, None


def frame_of(runs: list[Run]) -> pd.DataFrame | None:
    """Rows of the whole entries in the runs and of what was lost before them; each run keeps its rest."""
    sizes = np.array([sum(map(len, r.parts)) for r in runs], np.int64)
    begins = np.cumsum(sizes) - sizes
    w = np.concatenate([np.zeros(0, np.int64), *(p for r in runs for p in r.parts)])
    at, size = places_of(w, begins, sizes)
    # An empty run begins where the next one does; the last that begins there holds the entries.
    row = np.searchsorted(begins, at, side="right") - 1
    ends = begins.copy()
    if len(at):
        np.maximum.at(ends, row, at + size)
    for r, begin, end, n in zip(runs, begins.tolist(), ends.tolist(), sizes.tolist(), strict=True):
        r.rest = w[end : begin + n].copy()
    lost = [(r.probe, r.first, r.gap + len(r.prior.rest)) for r in runs if r.gap]
    if not len(at) and not lost:
        return None
    probes, firsts = np.array([r.probe for r in runs], np.int64), np.array([r.first for r in runs], np.int64)
    none = len(lost)
    gone = list(zip(*lost, strict=True)) if lost else [[], [], []]
    places = [np.concatenate([np.array(gone[0], np.int64), probes[row]]), np.concatenate([np.array(gone[1], np.int64), (firsts - begins)[row] + at]), np.concatenate([np.array(gone[2], np.int64), np.zeros(len(at), np.int64)])]
    fields = [pa.concat_arrays([pa.nulls(none, c.type), c]) for c in columns_of(w, at, size)]
    return pd.DataFrame({n: _nullable(c, k) for n, c, k in zip(_NAMES, [*map(pa.array, places), *fields], _KINDS, strict=True)})


class EntryReader(StatefulProcessor):
    """Folds chunks (probe_id, start, words[, deadline]) into entries; wait_ms None: a gap is lost at the end of a micro-batch."""

    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = Kept(handle, "place", "probe long", "at long, held array<long>, waiting array<struct<start:long,deadline:long,n:int,piece:long,offset:int>>")
        self.early = Pieces(handle, "early")
        self.timed = Timed(handle)

    def _open(self) -> None:
        #: Of each probe: how far it is read, the run at its end, a heap of the starts that wait, their deadlines, sizes and places.
        self.states: dict[int, list] = {}
        self.pending: list[Run] = []
        self.n_pending = 0
        self.places.open()
        self.early.open()

    def _load(self, probes: Iterable[int]) -> None:
        for (probe,), row in self.places.get((p,) for p in probes):
            at, held, waiting = row if row is not None else (0, [], [])
            held = np.array(held, np.int64)
            known = {w[0]: w[1:] for w in waiting}
            run = Run(probe, at - len(held), [])
            run.rest = held
            starts = list(known)
            heapify(starts)
            self.states[probe] = [at, run, starts, known]

    def _fold(self, probe: int, state: list, start: int, words: np.ndarray) -> None:
        """One more chunk, with the loss before it."""
        at, run = state[0], state[1]
        lost = max(start - at, 0)
        if lost or run.rest is not None:
            # A run that is parsed already is left behind, and what it has left heads the next one.
            run = Run(probe, start, [], lost, run) if lost else Run(probe, at - len(run.rest), [run.rest])
            self.pending.append(run)
            state[1], at = run, max(at, start)
        fresh = words[at - start :]
        run.parts.append(fresh)
        state[0] = at + len(fresh)
        self.n_pending += len(fresh)

    def _flush(self) -> Iterator[pd.DataFrame]:
        runs, self.pending, self.n_pending = self.pending, [], 0
        if runs:
            out = frame_of(runs)
            for r in runs:
                r.prior = None
            if out is not None:
                yield out

    def _drain(self, probe: int, state: list, upto: int | None) -> Iterator[pd.DataFrame]:
        """Waiting chunks whose turn has come, or whose deadline has passed; all that lie before such a one go with it."""
        starts, known = state[2], state[3]
        last = max((start for start, (deadline, *_) in known.items() if deadline <= upto), default=-1) if upto is not None else -1
        while starts and (starts[0] <= state[0] or starts[0] <= last):
            start = heappop(starts)
            _, n, piece, offset = known.pop(start)
            words = self.early.take(piece, offset, n)
            if start + len(words) > state[0] or start > state[0]:
                self._fold(probe, state, start, words)
            if self.n_pending >= PENDING:
                yield from self._flush()

    def _save(self, waited: Iterable[int]) -> None:
        for probe, (at, run, _, known) in self.states.items():
            self.places.put((probe,), (at, run.rest.tolist(), [(start, *known[start]) for start in sorted(known)]))
        self.places.close()
        self.early.close()
        if self.wait_ms is not None:
            self.timed.set({p: min((d for d, *_ in self.states[p][3].values()), default=_NONE) for p in waited})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self._open()
        timers, waited = set(), set()
        for frame in rows:
            deadlines = map(int, frame["deadline"]) if self.wait_ms is not None else [0] * len(frame)
            chunks = list(zip(frame["probe_id"].tolist(), frame["start"].tolist(), frame["words"], deadlines, strict=True))
            chunks.sort(key=lambda c: (c[0], c[1], len(c[2])))
            self._load({c[0] for c in chunks})
            waited.update(p for p in {c[0] for c in chunks} if self.states[p][3])
            for probe, start, words, deadline in chunks:
                state, n = self.states[probe], len(words)
                if start + n <= state[0]:
                    continue
                if start > state[0]:
                    known = state[3].get(start)
                    if known is None or known[1] < n:
                        if known is None:
                            heappush(state[2], start)
                            waited.add(probe)
                        else:
                            self.early.drop(known[2])
                        state[3][start] = (deadline if known is None else known[0], n, *self.early.put(np.asarray(words, np.int64)))
                    timers.add(deadline)
                    continue
                self._fold(probe, state, start, np.asarray(words, np.int64))
                if state[2]:
                    yield from self._drain(probe, state, None)
                if self.n_pending >= PENDING:
                    yield from self._flush()
            yield from self._flush()
        if self.wait_ms is None:
            for probe in sorted(waited):
                yield from self._drain(probe, self.states[probe], _NONE)
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
            yield from self._drain(probe, self.states[probe], upto)
        yield from self._flush()
        self._save(probes)

    def close(self) -> None:
        pass


def read_entries(chunks: DataFrame, wait: str | None = None, sent: str = "sent_at") -> DataFrame:
    """(probe_id, word_pos, missed, entry fields) of a stream of chunks; a row with a null kind tells of missed words.

    Without wait, what is missing at the end of a micro-batch is lost. With wait ("10 minutes"), the stream bears a watermark
    on its timestamp `sent`, and a gap is lost when the watermark has passed the time of a chunk behind it by so much. A chunk
    of no words tells that its probe has got so far; rows with a null take no part.
    """
    with_rocksdb(chunks.sparkSession)
    longs = [F.col(c).cast("long").alias(c) for c in ("probe_id", "start")]
    rows = chunks.where("probe_id is not null and start is not null and words is not null")
    if wait is None:
        rows, wait_ms, mode = rows.select(*longs, "words"), None, "None"
    else:
        wait_ms, mode = int(pd.Timedelta(wait).total_seconds() * 1000), "EventTime"
        rows = rows.select(*longs, "words", sent, (F.unix_millis(sent) + wait_ms).alias("deadline"))
    return rows.withColumn("bucket", bucket_of("probe_id")).groupBy("bucket").transformWithStateInPandas(EntryReader(wait_ms), SCHEMA, "Append", mode)
