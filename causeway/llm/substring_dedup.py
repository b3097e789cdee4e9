"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is k consecutive words. Every window has a minimiser, the least hash among its m-word grams; consecutive
windows with the same minimiser travel as one packed string (a super-k-mer) to the minimiser's bucket. Words that a sample
of texts holds are packed as one to three bytes by their frequency, others are spelt out. Equal windows have equal minimisers, so they meet in one
bucket, where the windows of the strings are sorted and every occurrence but the first is marked. Marked ranges go back
to their documents, whose words are then cut.

Copies are folded before the shuffle: of equal packed strings within a block of a task only the first travels, the
others are known to be later and leave as ranges, dealt by document and place. So a passage that a third of all documents
share sends one string a block, not one a copy. Of a bucket that holds more strings than a worker sorts at once, every
window leaves as a digest; these are counted by Spark, digest by digest.

Nulls and odd rows: a null text has no words. Rows with a null doc_id take no part and keep all words. Rows that repeat
a doc_id stand at the same place: neither is earlier than the other, and ranges found for one hold for both, clipped to
its words. Extra columns are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import Tables, batches, bounded_batches, octets, split_join

WINDOW = 20
#: Words of a minimiser gram. Four words seldom recur outside repeated passages, so no bucket grows hot by chance.
GRAM = 4
#: Windows of one packed string at most; bounds a row in texts that repeat themselves.
LONGEST = 200  # under 256: see _pack
#: Packed strings of a task, and their bytes, among which equal ones are folded.
FOLD, FOLD_BYTES = 400_000, 96 << 20
#: Bits of a bucket's number; minimisers that share it meet for nothing, which costs a little time and no result.
BUCKET_BITS = 44
#: About as many windows are sorted at once.
SORT = 300_000
#: Strings of a bucket, and their bytes, that are sorted by one worker; the windows of a larger bucket are counted by Spark.
BUCKET, BUCKET_BYTES = 50_000, 24 << 20

#: Texts at most, and bytes of each, whose words are packed short; which they are changes bytes on the way, never results.
#: They are sought among one in SOUGHT documents, so that they are spread over the table.
SAMPLE_TEXTS, SAMPLE_BYTES, SOUGHT = 2000, 4000, 16
#: The first byte of a short word tells its bytes: below ONE it is the only one, below TWO there is another, then two more.
#: SPELT begins a word that is spelt out.
ONE, TWO, SPELT = 150, 250, 0xFF
SIZES = [1] * ONE + [2] * (TWO - ONE) + [3] * (SPELT - TWO)

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _windowed_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width consecutive values, by doubling."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def super_kmers(words: list[bytes], k: int = WINDOW, m: int = GRAM):
    """(minimiser, first window, windows, flag) of every maximal stretch of windows that share a minimiser.

    The flag is set where the minimiser stands more than once in the stretch: only then can it hold a window twice.
    """
    n = len(words) - k + 1
    if n <= 0:
        return ()
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    g = np.zeros(len(h) - m + 1, np.uint64)
    for i in range(m):
        g = (g ^ h[i : len(h) - m + 1 + i]) * _A
        g ^= g >> np.uint64(29)
    g = ((g * _B) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    least = _windowed_min(g, k - m + 1)
    cuts = np.flatnonzero(np.diff(least)) + 1
    starts = np.concatenate(([0], cuts))
    ends = np.concatenate((cuts, [n]))
    repeats = bool((np.diff(np.sort(g)) == 0).any())
    out = []
    for v, s, e in zip(least[starts].tolist(), starts.tolist(), ends.tolist(), strict=True):
        flag = int(repeats and np.count_nonzero(g[s : e + k - m] == v) > 1)
        while e - s > LONGEST:
            out.append((v, s, LONGEST, flag))
            s += LONGEST
        out.append((v, s, e - s, flag))
    return out


def short_word(i: int) -> bytes | None:
    """The packed form of the i-th most frequent word; none beyond what three bytes hold."""
    if i < ONE:
        return bytes((i,))
    if (i := i - ONE) < (TWO - ONE) << 8:
        return bytes((ONE + (i >> 8), i & 255))
    if (i := i - ((TWO - ONE) << 8)) < (SPELT - TWO) << 16:
        return bytes((TWO + (i >> 16), i >> 8 & 255, i & 255))
    return None


def short_words(docs: DataFrame) -> dict[bytes, bytes]:
    """Short forms for the words of a bounded sample of texts."""
    some = docs.where((F.length("text") > 0) & (F.pmod(F.xxhash64("doc_id"), F.lit(SOUGHT)) == 0))
    rows = some.select(F.substring("text", 1, SAMPLE_BYTES).alias("t")).limit(SAMPLE_TEXTS).collect()
    counts = Counter(w for r in rows for w in r.t.encode().split())
    return {w: form for i, (w, _) in enumerate(counts.most_common()) if (form := short_word(i))}


def spelt(word: bytes) -> bytes:
    """A word that is not short: a mark, its length, its bytes."""
    n = len(word)
    return bytes((SPELT, n)) + word if n < SPELT else bytes((SPELT, SPELT)) + n.to_bytes(8, "big") + word


def ends_of(packed: bytes) -> list[int]:
    """Where each word of a packed string ends."""
    out, at, size = [], 0, len(packed)
    while at < size:
        lead = packed[at]
        if lead < SPELT:
            at += SIZES[lead]
        elif (n := packed[at + 1]) < SPELT:
            at += 2 + n
        else:
            at += 10 + int.from_bytes(packed[at + 2 : at + 10], "big")
        out.append(at)
    return out


def _pack(source, k: int, m: int, short: dict[bytes, bytes]):
    """Rows (bucket, doc_id, start, packed): packed strings, start being twice the first window plus the flag.

    Where packed is a single byte, the windows are known to be later: it is their number, start the first of them.
    """
    held: dict[bytes, tuple[int, int, int, int]] = {}
    early: list[tuple[int, int, int]] = []
    size = 0
    get = short.get

    def rows():
        nonlocal size
        spread = (1 << BUCKET_BITS) - 1
        rank = [(b, d, 2 * s + f, p) for p, (d, s, b, f) in held.items()]
        rank += [((d * 0x9E3779B97F4A7C15 + s * 0xC2B2AE3D27D4EB4F >> 7) & spread, d, s, bytes((n,))) for d, s, n in early]
        held.clear()
        early.clear()
        size = 0
        cols = list(zip(*rank, strict=True)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["bucket", "doc_id", "start", "packed"])

    for b in batches(source):
        for doc, text in zip(b.column(0).to_pylist(), octets(b.column(1)), strict=True):
            words = text.split()
            found = super_kmers(words, k, m)
            if not found:
                continue
            coded = [get(w) or spelt(w) for w in words]
            flat = b"".join(coded)
            at = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)), out=at[1:])
            at = at.tolist()
            for v, s, n, flag in found:
                packed = flat[at[s] : at[s + n + k - 1]]
                old = held.get(packed)
                if old is None:
                    held[packed] = (doc, s, v, flag)
                    size += len(packed)
                elif old[:2] < (doc, s):
                    early.append((doc, s, n))
                elif old[:2] > (doc, s):
                    early.append((old[0], old[1], n))
                    held[packed] = (doc, s, v, flag)
                if size >= FOLD_BYTES:  # also within one long text
                    yield rows()
            if len(held) + len(early) >= FOLD:
                yield rows()
    yield rows()


def _windows(rows: list[tuple[int, int, bytes]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(128-bit digests, doc_ids, starts) of the windows of packed strings (doc_id, start, packed)."""
    digests, docs, starts = [], array("q"), array("q")
    digest = xxhash.xxh3_128_digest
    for doc, start, packed in rows:
        ends = ends_of(packed)
        n = len(ends) - k + 1
        digests.append(b"".join([digest(packed[a:b]) for a, b in zip([0, *ends[: n - 1]], ends[k - 1 :], strict=True)]))
        docs.extend([doc] * n)
        starts.extend(range(start, start + n))
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2), np.array(docs, np.int64), np.array(starts, np.int64)


def _mark(rows: list[tuple[int, int, bytes]], k: int):
    """(doc_id, start, end) word ranges of later windows among the packed strings (doc_id, start, packed) of some buckets.

    Sorting digests by place puts the first occurrence at the front.
    """
    if not rows:
        return
    d, docs, starts = _windows(rows, k)
    order = np.lexsort((starts, docs, d[:, 1], d[:, 0]))
    d, docs, starts = d[order], docs[order], starts[order]
    fresh = np.concatenate(([True], (d[1:] != d[:-1]).any(1)))
    lead = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    later = np.flatnonzero((docs > docs[lead]) | (docs == docs[lead]) & (starts > starts[lead]))
    docs, starts = docs[later], starts[later]
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    if len(docs):
        cut = np.flatnonzero((np.diff(docs) != 0) | (np.diff(starts) > k)) + 1
        a, b = np.concatenate(([0], cut)), np.concatenate((cut, [len(docs)])) - 1
        yield from zip(docs[a].tolist(), starts[a].tolist(), (starts[b] + k).tolist(), strict=True)


FOUND = "doc_id long, begin long, end long, hi long, lo long"


def _ranges(source, k: int, most: int = BUCKET):
    """Rows sorted by bucket: ranges of later windows; of buckets beyond the limits, every window (begin) and its digest.

    A string alone in its bucket holds no repeats unless it is flagged.
    """
    names = ["doc_id", "begin", "end", "hi", "lo"]
    out: list[tuple[int, int, int]] = []
    block: list[tuple[int, int, bytes]] = []
    group: list[tuple[int, int, bytes]] = []
    now, flagged, size, weight, large = None, 0, 0, 0, False

    def flush():
        cols = [*(list(zip(*out, strict=True)) or [()] * 3), [None] * len(out), [None] * len(out)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

    def opened():
        """The windows of the group as they are."""
        for at in range(0, len(group), 2000):
            d, docs, starts = _windows(group[at : at + 2000], k)
            yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(starts), pa.nulls(len(docs), pa.int64()), pa.array(np.ascontiguousarray(d[:, 0])), pa.array(np.ascontiguousarray(d[:, 1]))], names=names)

    for b in batches(source):
        for bucket, doc, start, packed in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if len(packed) == 1:
                out.append((doc, start, start + packed[0] + k - 1))
                continue
            if bucket != now:
                if large:
                    yield from opened()
                elif flagged or len(group) > 1:
                    block += group
                    if size >= SORT:
                        out += _mark(block, k)
                        block, size = [], 0
                group, now, flagged, weight, large = [], bucket, 0, 0, False
            group.append((doc, start >> 1, packed))
            flagged |= start & 1
            weight += len(packed)
            size += (len(group) > 1) * (len(packed) // 8)
            if len(group) >= most or weight >= BUCKET_BYTES:
                yield from opened()
                group, weight, large = [], 0, True
        if len(out) >= 50_000:
            yield flush()
    if large:
        yield from opened()
    elif flagged or len(group) > 1:
        block += group
    out += _mark(block, k)
    yield flush()


def repeated_ranges(docs: DataFrame, tables: Tables, k: int = WINDOW, m: int = GRAM, most: int = BUCKET) -> DataFrame:
    """(doc_id, begin, end): word ranges, end exclusive, covered by windows that also start earlier; they may overlap."""
    bounded_batches(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    short = short_words(named)
    packed = named.mapInArrow(lambda source: _pack(source, k, m, short), "bucket long, doc_id long, start long, packed binary")
    met = packed.repartition("bucket").sortWithinPartitions("bucket")
    found = tables.put(met.mapInArrow(lambda source: _ranges(source, k, most), FOUND))
    ranges, windows = found.where("hi is null").select("doc_id", "begin", "end"), found.where("hi is not null").drop("end")
    if windows.isEmpty():
        return ranges
    place = F.struct("doc_id", "begin")
    first = windows.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = split_join(windows, first, ["hi", "lo"], "n", windows.count(), ["doc_id", "begin"]).where(place > F.col("first"))
    return ranges.unionByName(later.select("doc_id", "begin", (F.col("begin") + k).alias("end")))


def _cut(source):
    for b in batches(source):
        counts, removed, kept = [], [], []
        for text, cuts in zip(octets(b.column(1)), b.column(2).to_pylist(), strict=True):
            words = text.split()
            n = len(words)
            if cuts:
                left, at = [], 0
                for c in sorted((c["begin"], c["end"]) for c in cuts):
                    left += words[at : max(at, c[0])]
                    at = max(at, c[1])
                words = left + words[at:]
            counts.append(n)
            removed.append(n - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = GRAM, most: int = BUCKET) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): one row a document, kept holds the words left, joined by one space."""
    tables = Tables(docs.sparkSession, "windows")
    found = repeated_ranges(docs, tables, k, m, most)
    cuts = tables.put(found.groupBy("doc_id").agg(F.collect_list(F.struct("begin", "end")).alias("cuts")))
    # The strings' shuffle is of no more use; a collection on the driver lets Spark delete its files now, not later.
    docs.sparkSession._jvm.System.gc()
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.join(cuts, "doc_id", "left").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string")
