"""Words to whole entries. A word's role hangs on the one before, so a report's words stay one row until they are parsed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: (words of the entry, kind, event_id, payload_raw, clock_probe_id, clock_word, time_ns)
Entry = tuple
FIELDS = "n_words int, kind string, event_id long, payload_raw long, clock_probe_id long, clock_word long, time_ns long"


def entry_at(words: list[int], i: int) -> Entry | None:
    """The whole entry that starts at a place; None if words are missing. A paired time needs what it times behind it.

    An id of 0 is none: such an event keeps its place with a null event_id.
    """
    start, ns, left = i, None, len(words) - i
    if words[i] >> 29 == 7:
        if left < 3:
            return None
        ns, i = (words[i] & 0x1FFFFFFF) << 32 | words[i + 1], i + 2
    head = words[i]
    tag = head >> 30
    if tag == 0:
        return i + 1 - start, "event", head or None, None, None, None, ns
    if i + 1 >= len(words):
        return None
    size, low = i + 2 - start, words[i + 1]
    if tag == 1:
        return size, "event_payload", head & 0x3FFFFFFF or None, low, None, None, ns
    if tag == 2:
        return size, "clock", None, None, head & 0x7FFFFFFF, low, ns
    return size, "time", None, None, None, None, (head & 0x1FFFFFFF) << 32 | low


def entries_of(words: list[int]) -> tuple[list[Entry], list[int]]:
    """(entries, the words at the end that are not a whole entry yet)."""
    out, i = [], 0
    while i < len(words):
        e = entry_at(words, i)
        if e is None:
            break
        out.append(e)
        i += e[0]
    return out, words[i:]


#: Bytes of the logs that a task parses at once.
BATCH_BYTES = 4 << 20
KINDS = pa.array(["event", "event_payload", "clock", "time"])


def places_of(w: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words of the whole entries, their sizes) in logs that lie one behind the other in w.

    Each word tells how long an entry would be that starts with it; the starts are then what is reached from the logs'
    beginnings, found by doubling the number of entries that a jump passes over.
    """
    n = len(w)
    ends = np.repeat(begins + sizes, sizes)
    here = np.arange(n)
    timed = w >> 29 == 7
    head = np.minimum(here + 2 * timed, n - 1)
    size = 2 * timed + np.where(w[head] >> 30 == 0, 1, 2)
    last = here + size
    size[(last > ends) | (timed & (here + 2 >= ends))] = 0
    jump = np.append(np.where((size > 0) & (last < ends), last, n), n)
    reached = np.zeros(n + 1, bool)
    reached[begins[sizes > 0]] = True
    for _ in range(int(sizes.max(initial=0)).bit_length()):
        reached[jump[np.flatnonzero(reached)]] = True
        jump = jump[jump]
    at = np.flatnonzero(reached[:n] & (size > 0))
    return at, size[at]


def columns_of(w: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[pa.Array]:
    """The columns of FIELDS of the entries at these places."""
    timed = w[at] >> 29 == 7
    head = at + 2 * timed
    low = w[np.minimum(head + 1, len(w) - 1)] if len(w) else head
    tag, given = w[head] >> 30, w[head]
    event = np.where(tag == 0, given, given & 0x3FFFFFFF)
    ns = np.where(tag == 3, (given & 0x1FFFFFFF) << 32 | low, (w[at] & 0x1FFFFFFF) << 32 | w[np.minimum(at + 1, max(len(w) - 1, 0))])
    some = lambda values, there: pa.array(values, pa.int64(), mask=~there)
    return [pa.array(size.astype(np.int32)), KINDS.take(pa.array(tag)), some(event, (tag < 2) & (event > 0)), some(low, tag == 1), some(given & 0x7FFFFFFF, tag == 2), some(low, tag == 2), some(ns, timed | (tag == 3))]


def parse(reports: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """(*keys, entry_idx, word_off, n_words, kind, ...) of the entries in each row's words; an orphan at the end is left out."""
    reports.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = reports.select(*keys, words)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + f", entry_idx int, word_off int, {FIELDS}"
    names = [*keys, "entry_idx", "word_off", *(f.split()[0] for f in FIELDS.split(", "))]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            log = b.column(len(keys))
            w = log.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(w):
                continue
            sizes = log.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            begins = np.cumsum(sizes) - sizes
            at, size = places_of(w, begins, sizes)
            row = np.searchsorted(begins, at, side="right") - 1  # empty logs begin where the next does
            first = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
            nth = np.arange(len(row)) - np.maximum.accumulate(np.where(first, np.arange(len(row)), 0))
            places = [pa.array(nth.astype(np.int32)), pa.array((at - begins[row]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(pa.array(row)) for i in range(len(keys))), *places, *columns_of(w, at, size)], names=names)

    return rows.mapInArrow(run, schema)
