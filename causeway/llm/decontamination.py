"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edit verification.

Items and texts are sequences of words: A-Z lower-cased, ASCII punctuation taken out, split at ASCII white space. A
document contains an item of L words if some stretch of its words is within floor(0.2 L) word edits of the item (a
similarity of 0.8; items under five words must match exactly). Items are the stated query set: they are dealt in blocks
of a bounded size, and each block is held against all documents.

For each length among a block's items, every window of that many words is a candidate if it holds enough of the
block's words and of the word pairs of items of that length: each edit spoils one word and at most two pairs, so the
test loses nothing. A window then
takes several random walks of Chakraborty, Goldenberg and Koucky: the walk copies the current word, and a random bit of
step and word decides whether to move on, which turns few edits into few differing places. Samples of places are the
LSH keys; a window that shares a key with an item of its length is verified with a bit-parallel edit distance over the
words around it. WALKS x SAMPLES keys bring the chance of missing a window at the limit of edits under 1 in 100; passages
have several such windows.

Nulls and odd rows: a null text has no words; items that are null or have no words match nothing; a null doc_id keeps
its matches, but cannot be named by them, so `keep_clean` keeps rows without a doc_id; rows that repeat a doc_id report
their matches each, and go together; equal items are reported each; extra columns are ignored; an empty benchmark gives no
matches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import batches, bounded_batches, octets

#: Word edits allowed, as a share of the item's words.
EDITS = 0.2
WALKS, SAMPLES, PLACES = 6, 6, 2
#: Text bytes of a block of items; what a block's index takes on an executor is a small multiple of it.
BLOCK_BYTES = 4 << 20
STRIDE = 4
# A-Z lowered, and the ASCII punctuation that is taken out.
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER, _MARKS).split()


def allowed(length: int, edits: float = EDITS) -> int:
    return int(length * edits + 1e-9) if length >= 5 else 0


class Walks:
    """CGK walks over rows of word codes, and their sampled keys, for windows of one length."""

    def __init__(self, length: int, seed: int = 11, walks: int = WALKS, samples: int = SAMPLES, places: int = PLACES):
        rng = np.random.default_rng([seed, length])
        # A copy stops after 2 L steps: later places compare only what lies beyond both windows.
        self.length, self.steps = length, 2 * length
        self.salts = rng.integers(1, 1 << 62, (walks, self.steps), dtype=np.uint64)
        self.at = [[np.sort(rng.choice(self.steps, min(places, self.steps), replace=False)) for _ in range(samples)] for _ in range(walks)]
        self.mix = rng.integers(1, 1 << 62, places, dtype=np.uint64) | np.uint64(1)

    def keys(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For each sample of each walk, a key of every row. Code 0 stands for any word that no item holds."""
        n = len(rows)
        padded = np.concatenate((rows, np.full((n, 1), 0xFFFFFFFF, rows.dtype)), axis=1).astype(np.uint64)
        every = np.arange(n)
        for salts, samples in zip(self.salts, self.at, strict=True):
            out, i = np.empty((self.steps, n), np.uint64), np.zeros(n, np.int64)
            for j in range(self.steps):
                c = padded[every, np.minimum(i, self.length)]
                out[j] = c
                h = (c + salts[j]) * np.uint64(0x9E3779B97F4A7C15)
                i += ((h >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
            for at in samples:
                key = np.zeros(n, np.uint64)
                for m, a in zip(self.mix, at, strict=False):
                    key = (key ^ out[a]) * m
                    key ^= key >> np.uint64(31)
                yield key


def masks_of(item: list) -> dict:
    """For each word of an item, the places where it stands, as bits."""
    out: dict = {}
    for i, w in enumerate(item):
        out[w] = out.get(w, 0) | 1 << i
    return out


def edit_match(item: list[bytes], masks: dict[bytes, int], words: list[bytes], from_first: bool = False) -> tuple[int, int]:
    """(distance, end) of the stretch of words nearest to the item, at any start or from the first word on; bit-parallel, over words."""
    length = len(item)
    top, full = 1 << (length - 1), (1 << length) - 1
    plus, minus, d = full, 0, length
    best = (length, 0)
    for end, w in enumerate(words, 1):
        eq = masks.get(w, 0)
        same = eq | minus
        x = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(x | plus)), plus & x
        if up & top:
            d += 1
        elif down & top:
            d -= 1
        up, down = (up << 1 | from_first) & full, (down << 1) & full
        plus, minus = down | (full & ~(same | up)), up & same
        if d < best[0]:
            best = (d, end)
    return best


class Index:
    """One block of items, as it is shared with the executors."""

    def __init__(self, items: list[tuple[int, list[bytes]]], edits: float = EDITS):
        self.items, self.edits = items, edits
        self.code = {w: i for i, w in enumerate(dict.fromkeys(w for _, x in items for w in x), 1)}
        coded = [np.array([self.code[w] for w in x], np.uint32) for _, x in items]
        self.pairs = np.unique(np.concatenate([x[:-1].astype(np.uint64) << np.uint64(32) | x[1:] for x in coded] or [np.empty(0, np.uint64)]))
        self.masks = [masks_of(x) for _, x in items]
        by = defaultdict(list)
        for i, x in enumerate(coded):
            by[len(x)].append(i)
        self.lengths = {}
        for length, members in sorted(by.items()):
            walks = Walks(length)
            tables = []
            for keys in walks.keys(np.stack([coded[i] for i in members])):
                table = defaultdict(list)
                for k, i in zip(keys.tolist(), members, strict=True):
                    table[k].append(i)
                tables.append((np.array(sorted(table), np.uint64), dict(table)))
            pairs = np.unique(np.concatenate([x[:-1].astype(np.uint64) << np.uint64(32) | x[1:] for x in (coded[i] for i in members)]))
            self.lengths[length] = (walks, tables, np.searchsorted(self.pairs, pairs))
        self.gap = max((allowed(n, edits) for n in self.lengths), default=0) + 1

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(start, item) pairs of windows over the codes of a batch that share an LSH key with an item."""
        known = np.concatenate(([0], np.cumsum(codes > 0, dtype=np.int32)))
        pair = codes[:-1].astype(np.uint64) << np.uint64(32) | codes[1:]
        hit = np.zeros(len(pair), bool)
        which = np.empty(0, np.int64)
        both = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0))
        if len(both) and len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair[both]), len(self.pairs) - 1)
            hit[both] = same = self.pairs[at] == pair[both]
            which = at[same]
        paired = np.concatenate(([0], np.cumsum(hit, dtype=np.int32)))
        phases = [np.ascontiguousarray(paired[r::STRIDE]) for r in range(STRIDE)]
        for length, (walks, tables, own) in self.lengths.items():
            if len(codes) < length:
                continue
            t = allowed(length, self.edits)
            need = length - 1 - 2 * t
            if need >= 2 * STRIDE:
                # Counts at every fourth start, less what three steps can change, leave few starts to look at.
                tail = phases[(length - 1) % STRIDE][(length - 1) // STRIDE :]
                coarse = np.flatnonzero(tail - phases[0][: len(tail)] >= need - STRIDE + 1)
                starts = (coarse[:, None] * STRIDE + np.arange(1 - STRIDE, STRIDE)).ravel()
                starts = np.unique(starts[(starts >= 0) & (starts + length <= len(codes))])
            else:
                starts = np.arange(len(codes) - length + 1)
            starts = starts[(known[starts + length] - known[starts] >= length - t) & (paired[starts + length - 1] - paired[starts] >= need)]
            # Of the pairs in a window, those of items of this length: `paired` numbers the hits up to a place.
            mine = np.zeros(len(self.pairs), bool)
            mine[own] = True
            count = np.concatenate(([0], np.cumsum(mine[which], dtype=np.int32)))
            starts = starts[count[paired[starts + length - 1]] - count[paired[starts]] >= need]
            for a in range(0, len(starts), 1 << 16):
                some = starts[a : a + (1 << 16)]
                found = set()
                for keys, (have, table) in zip(walks.keys(codes[some[:, None] + np.arange(length)]), tables, strict=True):
                    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
                    for i in np.flatnonzero(have[at] == keys).tolist():
                        found.update((int(some[i]), x) for x in table[int(keys[i])])
                yield from found

    def matches(self, texts: list[list[bytes]]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, begin, end, distance): the nearest stretch for each item that a text contains."""
        get = self.code.get
        flat, begins = [], []
        for words in texts:
            begins.append(len(flat))
            flat += [get(w, 0) for w in words]
            flat += [0] * self.gap
        bounds = np.array([*begins, len(flat)], np.int64)
        by = defaultdict(list)
        for start, item in self.candidates(np.array(flat, np.uint32)):
            k = int(np.searchsorted(bounds, start, side="right")) - 1
            by[k, item].append(start - begins[k])
        out = []
        for (k, item), starts in by.items():
            words, target = texts[k], self.items[item][1]
            length, t = len(target), allowed(len(target), self.edits)
            best, seen = None, -1
            for s in sorted(starts):
                if s < seen:  # the stretch looked at last covers this window
                    continue
                low = max(0, s - t)
                region = words[low : s + 2 * length + t]
                seen = s + length
                d, end = edit_match(target, self.masks[item], region)
                if d <= t and (best is None or d < best[0]):
                    best = (d, low + end)
                    if d == 0:
                        break
            if best:
                d, end = best
                # Backwards from its end, the stretch is the shortest that is as near.
                back = words[max(0, end - length - t) : end][::-1]
                out.append((k, item, end - edit_match(target[::-1], masks_of(target[::-1]), back, True)[1], end, d))
        return out


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items (item_id, words) in blocks of bounded size; they stream through the driver, never as a whole."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    for item, text in rows.toLocalIterator():
        words = words_of(text.encode())
        if words:
            if block and size + len(text) > block_bytes:
                yield block
                block, size = [], 0
            block.append((item, words))
            size += len(text)
    if block:
        yield block


SCHEMA = "doc_id long, item_id long, begin_word int, end_word int, edits int"


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, begin_word, end_word, edits) of every item that a document contains, at its nearest stretch."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for block in blocks(benchmark):
        shared = spark.sparkContext.broadcast(Index(block, edits))

        def run(source, shared=shared):
            index = shared.value
            for b in batches(source):
                ids = b.column(0).to_pylist()
                found = index.matches([words_of(t) for t in octets(b.column(1))])
                rows = [(ids[k], index.items[i][0], begin, end, d) for k, i, begin, end, d in found]
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "begin_word", "end_word", "edits"])

        part = texts.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose documents contain no item."""
    bad = contaminated(docs, benchmark).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, docs.doc_id.cast("long") == bad.bad_id, "left_anti")
