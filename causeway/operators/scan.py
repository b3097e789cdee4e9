"""Folds that are no aggregates, as parallel scans: blocks of a long sequence are summarised as functions of what they start
with, and summaries are composed level by level, so that one key with most rows is spread over many tasks.

Two such folds are here. The frontier's: a clock supersedes another by a rule that is no order across the wrap of epochs.
And the parser's: what a word is hangs on the words before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions import clocks as C
from causeway.operators.entries import FIELDS, parse, places_of
from causeway.operators.tables import drop, shared_path, written
from causeway.operators.timeline import running

#: Positions of a block of rows, and summaries that are composed at once.
BLOCK, WIDE = 1 << 16, 256


def _streamed(rows: DataFrame, keys: list[str], order: str, step: Callable, state: Callable, schema: str, out: Callable) -> DataFrame:
    """Rows of each key in order, folded into a state that starts anew with each key; out(state) makes the key's row.

    Rows go by one at a time, with one state in memory.
    """
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int64()] * len(names)
    width = len(keys)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, done = None, None, []
        for b in source:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:width] != at:
                    if at is not None:
                        done.append((*at, *out(now)))
                    at, now = row[:width], state()
                step(now, row[width + 1 :])
            if len(done) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
                done = []
        if at is not None:
            done.append((*at, *out(now)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

    rest = [c for c in rows.columns if c not in keys and c != order]
    dealt = rows.select(*keys, order, *rest).repartition(*keys).sortWithinPartitions(*keys, order)
    return dealt.mapInArrow(run, schema)


# --- frontier ----------------------------------------------------------------------------------------------------------
# Clocks are packed, epoch * 65536 + ticks. Three zones of epochs matter: high (from NEAR_MAX on), low (up to NEAR_MIN) and
# between. A sequence of clocks acts on a state by two cases. A state that is not high: the first high clock takes over,
# whatever the state was, and what follows is known; without one the result is the greatest of state and clocks. A high state:
# the first low clock takes over; without one the result is the greatest of the state and the high clocks. So a function is
# (fixed or not, value) for either case.

_HIGH, _LOW = C.NEAR_MAX << 16, (C.NEAR_MIN << 16) + C.TOP


def supersede(state: int, clock: int) -> int:
    """The later of two packed clocks, by the rule of frontiers."""
    return clock if clock > state or (state >= _HIGH and clock <= _LOW) else state


def _clock_state() -> list:
    return [0, -1, 0, -1]  # fixed?, value for states that are not high; the same for high ones


def _clock_step(now: list, row: tuple) -> None:
    (clock,) = row
    if now[0]:
        now[1] = supersede(now[1], clock)
    elif clock >= _HIGH:
        now[0], now[1] = 1, clock
    else:
        now[1] = max(now[1], clock)
    if now[2]:
        now[3] = supersede(now[3], clock)
    elif clock <= _LOW:
        now[2], now[3] = 1, clock
    elif clock >= _HIGH:
        now[3] = max(now[3], clock)


def applied(f: list | tuple, state: int) -> int:
    """What the clocks of a function make of a state; -1 stands for none yet."""
    fixed, value = f[:2] if state < _HIGH else f[2:]
    return value if fixed else max(state, value)


def _compose_step(now: list, f: tuple) -> None:
    """Appends a block's function."""
    for at, high in ((0, False), (2, True)):
        if now[at]:
            now[at + 1] = applied(f, now[at + 1])
        elif f[at]:
            now[at], now[at + 1] = 1, f[at + 1]
        else:
            now[at + 1] = max(now[at + 1], f[at + 1])


def frontier_scan(clocks: DataFrame, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """(probe_id, neighbor_id, epoch, ticks) of clocks folded by pos, in blocks of positions; rows of one position are folded in
    no certain order, rows with nulls take no part."""
    pair = ["probe_id", "neighbor_id"]
    root = shared_path(clocks.sparkSession, "frontier")
    part = F.call_function("div", F.col("pos"), F.lit(block).cast("long"))
    rows = clocks.dropna(subset=[*pair, "pos", "epoch", "ticks"]).select(*pair, part.alias("part"), "pos", C.pack(F.col("epoch"), F.col("ticks")).alias("clock"))
    schema = "probe_id long, neighbor_id long, part long, plain_fixed long, plain long, high_fixed long, high long"
    found, n = written(_streamed(rows, [*pair, "part"], "pos", _clock_step, _clock_state, schema, tuple), f"{root}/0"), 0
    while found.groupBy(*pair).count().where("count > 1").limit(1).count():
        n += 1
        up = found.withColumn("up", F.call_function("div", F.col("part"), F.lit(wide).cast("long")))
        up = up.select(*pair, "up", "part", "plain_fixed", "plain", "high_fixed", "high")
        found = written(_streamed(up, [*pair, "up"], "part", _compose_step, _clock_state, schema, tuple), f"{root}/{n}")
        drop(clocks.sparkSession, f"{root}/{n - 1}")
    # There was no clock before the first: its state is less than all and not high.
    return found.select(*pair, F.shiftright("plain", 16).alias("epoch"), F.col("plain").bitwiseAND(F.lit(C.TOP).cast("long")).alias("ticks"))


# --- entries across borders --------------------------------------------------------------------------------------------
# A word is read in one of four states: an entry starts with it (0), it is an entry's last (1), it is the low word of a paired
# time (2), or it heads what such a time belongs to (3). A chunk of words is a function from the state that it starts in to
# the one that it ends in, two bits for each start. From any state but 0 a chunk reaches state 0 within three words.

_KEEP = 0b11_10_01_00  # of no words: every state stays


def after(code: int, state: int) -> int:
    return code >> (2 * state) & 3


def then(first: int, second: int) -> int:
    """The function of one chunk and another one behind it."""
    return sum(after(second, after(first, s)) << (2 * s) for s in range(4))


def _table() -> np.ndarray:
    """then of all pairs of functions."""
    every = np.arange(256)
    return sum(((every[None] >> 2 * (every[:, None] >> 2 * s & 3)) & 3) << 2 * s for s in range(4)).astype(np.uint8)


_THEN = _table()


def transfers(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The functions of chunks whose words lie one behind the other: neighbours in a chunk are composed until one is left."""
    tag = words >> 30
    # From state 0 a word leads to 0, 1 or 2; from 1 to 0; from 2 to 3; from 3 to 0 or 1.
    codes = (np.where(tag == 0, 0, np.where(words >> 29 == 7, 2, 1)) | 3 << 4 | (tag != 0) << 6).astype(np.uint8)
    out = np.full(len(sizes), _KEEP, np.int64)
    some = sizes > 0
    sizes = sizes[some]
    while len(sizes) and sizes.max() > 1:
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        left = np.flatnonzero(place % 2 == 0)
        paired = place[left] + 1 < np.repeat(sizes, (sizes + 1) // 2)
        both = left[paired]
        less = codes[left]
        less[paired] = _THEN[codes[both], codes[both + 1]]
        codes, sizes = less, (sizes + 1) // 2
    out[some] = codes
    return out


def transfer(words: np.ndarray) -> int:
    """The function of a chunk."""
    return int(transfers(words, np.array([len(words)]))[0])


def borders(words: np.ndarray, sizes: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) of chunks whose words lie one behind the other: words before first end an entry begun before, those from
    last on begin one that goes on behind the chunk; all between are whole entries."""
    begins = np.cumsum(sizes) - sizes
    # Where a paired time's low word is first, what it belongs to comes next; that has one word more unless it is an event.
    head = np.minimum(begins + (states == 2), len(words) - 1)
    more = (words[head] >> 30 != 0).astype(np.int64) if len(words) else np.zeros(len(sizes), np.int64)
    first = np.minimum(np.select([states == 1, states == 2, states == 3], [np.ones_like(more), 2 + more, 1 + more], 0), sizes)
    left = sizes - first
    kept = np.arange(len(words)) - np.repeat(begins, sizes) >= np.repeat(first, sizes)
    begins = np.cumsum(left) - left
    at, size = places_of(words[kept], begins, left)
    row = np.searchsorted(begins, at, side="right") - 1  # empty chunks begin where the next does
    last = first.copy()
    np.maximum.at(last, row, first[row] + at + size - begins[row])
    return first, last


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of all chunks, how many each has)"""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def states(rows: DataFrame, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """(probe_id, at, state): the state that each of the rows (probe_id, at, code) starts in, its probe's first one in 0.

    Blocks are composed, and their own states found in the same way; each block's rows then follow from its state.
    """
    part = F.call_function("div", F.col("at"), F.lit(block).cast("long"))
    rows = rows.select("probe_id", part.alias("part"), "at", "code")
    top = rows.agg(F.max("at")).first()[0]
    if top is None or top < block:
        begun = rows.withColumn("state", F.lit(0).cast("long"))
    else:
        def compose(now, row):
            now[0] = then(now[0], row[0])

        root = shared_path(rows.sparkSession, "states")
        blocks = written(_streamed(rows, ["probe_id", "part"], "at", compose, lambda: [_KEEP], "probe_id long, at long, code long", tuple), root)
        begun = rows.join(states(blocks, wide, wide).select("probe_id", F.col("at").alias("part"), "state"), ["probe_id", "part"])

    def run(source):
        key, now = None, 0
        for b in source:
            out = []
            for probe, place, code, state in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                group = (probe, place // block)
                if group != key:
                    key, now = group, state
                out.append(now)
                now = after(code, now)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.int64())], names=["probe_id", "at", "state"])

    dealt = begun.select("probe_id", "part", "at", "code", "state").repartition("probe_id", "part").sortWithinPartitions("probe_id", "part", "at")
    return dealt.mapInArrow(run, "probe_id long, at long, state long")


def _chunks(chunks: DataFrame, root: str) -> DataFrame:
    """(probe_id, start, words, lost): chunks without what earlier ones have brought already, and the words missing before."""
    size = F.size("words")
    longest = chunks.where("probe_id is not null and start is not null and words is not null").groupBy("probe_id", "start").agg(F.max(F.struct(size.alias("n"), "words")).alias("c"))
    rows = written(longest.select("probe_id", "start", F.col("c.words").alias("words")), f"{root}/chunks")
    says = rows.select("probe_id", (2 * F.col("start") + 1).alias("at"), (F.col("start") + F.size("words")).alias("upto"), F.lit(None).cast("long").alias("asks"))
    asks = rows.select("probe_id", (2 * F.col("start")).alias("at"), F.lit(None).cast("long").alias("upto"), F.col("start").alias("asks"))
    known = running(says.unionByName(asks), "probe_id", "at", F.col("upto"), "had", "max").where("asks is not null")
    known = known.select("probe_id", F.col("asks").alias("start"), F.coalesce("had", F.lit(0)).alias("had"))
    rows = rows.join(known, ["probe_id", "start"])
    skip = F.greatest(F.col("had") - F.col("start"), F.lit(0)).cast("int")
    fresh = rows.where((skip < F.size("words")) | (F.col("start") > F.col("had"))).select("probe_id", (F.col("start") + skip).alias("start"), F.slice("words", skip + 1, F.size("words")).alias("words"), F.greatest(F.col("start") - F.col("had"), F.lit(0)).alias("lost"))
    return written(fresh, f"{root}/fresh")


def parse_chunks(chunks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(probe_id, word_pos, missed, entry fields) of logs that are cut into chunks (probe_id, start, words) anywhere, within
    entries too; the same rows as the streaming reader's, all chunks at once and each in its own task.

    Chunks may overlap or come again; of those with one start the longest counts. Where words are missing a row with a null
    kind tells how many, with those of an entry that was begun before; the chunk behind starts anew. A partial entry at the
    end of a log is left out. A chunk of no words tells that its probe has got so far; rows with a null take no part.
    """
    spark = chunks.sparkSession
    root = shared_path(spark, "entries")
    fresh = _chunks(chunks.select(F.col("probe_id").cast("long").alias("probe_id"), F.col("start").cast("long").alias("start"), "words"), root)

    def code(source):
        for b in source:
            codes = transfers(*_flat(b.column(2)))
            # Behind missing words a chunk starts anew, in whatever state these were left.
            codes = np.where(b.column(3).to_numpy(zero_copy_only=False) > 0, (codes & 3) * 0b01_01_01_01, codes)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.int64())], names=["probe_id", "at", "code"])

    coded = written(fresh.mapInArrow(code, "probe_id long, at long, code long"), f"{root}/codes")
    begun = states(coded, block).withColumnRenamed("at", "start")
    rows = fresh.join(begun, ["probe_id", "start"])

    def split(source):
        """Words in three parts: what ends an earlier entry, whole entries, what begins one."""
        for b in source:
            state, lost = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            first, last = borders(*_flat(b.column(2)), np.where(lost > 0, 0, state))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(first, pa.int32()), pa.array(last, pa.int32())], names=["probe_id", "start", "words", "first", "last"])

    parts = rows.select("probe_id", "start", "words", "state", "lost").mapInArrow(split, "probe_id long, start long, words array<long>, first int, last int")
    parts = written(parts, f"{root}/parts")
    inside = parse(parts.where("last > first").select("probe_id", F.col("start").alias("from"), "first", F.slice("words", F.col("first") + 1, F.col("last") - F.col("first")).alias("words")), ["probe_id", "from", "first"])
    fields = [f.split()[0] for f in FIELDS.split(", ")]
    none = F.lit(0).cast("long").alias("missed")
    whole = inside.select("probe_id", (F.col("from") + F.col("first") + F.col("word_off")).alias("word_pos"), none, *fields)
    # Words at borders, a few a chunk, come together by where their entry was begun.
    border = parts.where("first > 0 or last < size(words)").select("probe_id", "start", "last", F.posexplode("words").alias("i", "word"), "first").where("i < first or i >= last")
    border = border.select("probe_id", (F.col("start") + F.col("i")).alias("pos"), "word", F.when((F.col("i") == F.col("last")) & (F.col("i") >= F.col("first")), F.col("start") + F.col("i")).alias("begun"))
    border = running(border, "probe_id", "pos", F.col("begun"), "entry", "max").where("entry is not null")
    joined = written(border.groupBy("probe_id", "entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]).alias("words")), f"{root}/border")
    over = written(parse(joined, ["probe_id", "entry"]).select("probe_id", F.col("entry").alias("word_pos"), none, *fields), f"{root}/over")
    begun_only = joined.join(over.select("probe_id", F.col("word_pos").alias("entry")), ["probe_id", "entry"], "left_anti").select("probe_id", (F.col("entry") + F.size("words")).alias("upto"), F.size("words").cast("long").alias("held"))
    gaps = fresh.where("lost > 0").select("probe_id", "start", "lost", (F.col("start") - F.col("lost")).alias("upto")).join(begun_only, ["probe_id", "upto"], "left")
    missed = gaps.select("probe_id", F.col("start").alias("word_pos"), (F.col("lost") + F.coalesce("held", F.lit(0))).alias("missed"), *(F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in FIELDS.split(", ")))
    return whole.unionByName(over).unionByName(missed)
