"""Spelling variants: words one edit apart, from a forward and a reversed sorted dictionary.

Two words are near if one inserted, deleted or replaced code point makes one the other. The shorter has l code points and
one edit leaves its first or its last floor(l / 2) as they are, so near words stand together in the dictionary sorted from
the front or in that sorted from the back: in a block (l, front, back) of words of l and l + 1 code points that begin and
end alike. The dictionaries are dealt by ranges of such keys and scanned block by block. Blocks of more than BLOCK words are
subdivided first: of what a block leaves open, one edit again leaves the first or the last half as it is, which gives two
finer keys. A block that leaves one code point open has no more words than the alphabet and its pairs have, so that this
ends. A pair found by its front is not looked for by its back: rows carry from which common prefix on the other side has it.

Words of a block are compared with each other where they are few, else by what is left of them without one code point; both
cost a bounded time a word. Only near pairs are emitted, of which a word has as many as there are edits of it at most.

`words` counts the words of whole texts. A word's form is the near word of largest n, if that is RATIO times the word's own
at least; its root is the last of the forms that follow on each other, found by doubling.

Nulls and odd rows: a null text has no words; a null doc_id is counted with an empty id before the colon; rows that repeat a
doc_id are counted each; of near words of equal n the smallest in code-point order is the form; extra columns are ignored; no
documents, no words.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import Tables, batches, bounded_batches, split_join

#: Code points and occurrences from which a result is a word.
LEAST_LETTERS, LEAST_COUNT = 6, 5
#: One in so many runs of a document loses a code point.
NOISE = 199
#: How many times as frequent as a word its form is, at least.
RATIO = 5
#: Words of a block from which it is subdivided.
BLOCK = 512
#: Distinct words that a task counts before it passes them on.
HELD = 1 << 17
# Latin-1 letters as they are but for A-Z, which become small; all else is a space. U+00C0 to U+00FF is one range.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs(text: str) -> list[bytes]:
    """The maximal runs of letters, in Latin-1, A-Z as small letters."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _noisy(run: bytes, doc: bytes, noise: int) -> bytes:
    """The run, or what is left of it without one letter where the checksum of document and run says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(doc))
    return run if h % noise else run[: h % len(run)] + run[h % len(run) + 1 :]


def words(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, noise: int = NOISE) -> DataFrame:
    """(word, n): the words of whole texts and their occurrences."""
    bounded_batches(docs.sparkSession)

    def run(source):
        held = Counter()
        for b in batches(source):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                head = b"%s:" % ("" if doc is None else str(doc)).encode()
                for word, n in Counter(runs(text or "")).items():
                    if len(word) >= least_letters and len(word := _noisy(word, head, noise)) >= least_letters:
                        held[word] += n
                if len(held) > HELD:
                    yield table(held)
                    held = Counter()
        if held:
            yield table(held)

    def table(held):
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# --- near pairs --------------------------------------------------------------------------------------------------------


def _blocks(known: DataFrame) -> DataFrame:
    """(l, front, back, skip, word, n) of words in the forward and the reversed dictionary.

    A pair of the block that begins with `skip` equal code points at least is found elsewhere.
    """
    keys = []
    for less in (0, 1):
        size = F.length("word") - less
        half = F.floor(size / 2).cast("int")
        tail = F.expr(f"right(word, int(floor((length(word) - {less}) / 2)))")
        keys += [F.struct(size.alias("l"), F.expr(f"left(word, int(floor((length(word) - {less}) / 2)))").alias("front"), F.lit("").alias("back"), F.col("l0").alias("skip")), F.struct(size.alias("l"), F.lit("").alias("front"), tail.alias("back"), half.alias("skip"))]
    return known.withColumn("l0", F.length("word") + 1).select(F.explode(F.array(*keys)).alias("k"), "word", "n").select("k.*", "word", "n")


def _finer(rows: DataFrame) -> DataFrame:
    """Rows of blocks with the keys of both of their parts."""
    a, b, size = F.length("front"), F.length("back"), F.length("word")
    half = F.floor((F.col("l") - a - b) / 2).cast("int")
    left, tail = F.substring("word", F.lit(1), a + half), F.substring("word", size - b - half + 1, b + half)
    by_front = F.struct(left.alias("front"), "back", "skip")
    by_back = F.struct("front", tail.alias("back"), F.least("skip", a + half).alias("skip"))
    # What begins alike up to `skip` is found elsewhere, and so is the whole part that does.
    parts = F.when(a + half < F.col("skip"), F.array(by_front, by_back)).otherwise(F.array(by_back))
    return rows.select("l", F.explode(parts).alias("k"), "word", "n").select("l", "k.*", "word", "n")


def one_edit(u: str, v: str) -> bool:
    """u, not longer than v, becomes v by one edit."""
    if len(v) - len(u) > 1 or u == v:
        return False
    lo, hi = 0, len(u)
    while lo < hi:  # the common prefix, by halves
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if u[:mid] == v[:mid] else (lo, mid - 1)
    return u[lo + 1 :] == v[lo + 1 :] if len(u) == len(v) else u[lo:] == v[lo + 1 :]


def near_in_block(short: list[str], long: list[str], front: int, back: int) -> Iterator[tuple[str, str]]:
    """Near pairs of distinct words of l and l + 1 code points that have so many first and last ones in common."""
    size = len(short[0]) if short else 0
    both = len(short) + len(long)
    if both <= 4 * (size - front - back + 1):
        yield from ((u, v) for u, v in combinations(short, 2) if one_edit(u, v))
        yield from ((u, v) for u in short for v in long if one_edit(u, v))
        return
    there = set(short)
    for v in long:
        for u in {v[:i] + v[i + 1 :] for i in range(front, len(v) - back)} & there:
            yield u, v
    for i in range(front, size - back):
        alike = defaultdict(list)
        for u in short:
            alike[u[:i] + u[i + 1 :]].append(u)
        for some in alike.values():
            if len(some) > 1:
                yield from combinations(some, 2)


def _scan(rows: DataFrame) -> DataFrame:
    """(word, n, near, near_n), each pair both ways, of whole blocks."""

    def run(source):
        at, held, out = None, {}, []
        for b in batches(source):
            for l, front, back, skip, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):  # noqa: E741
                if (l, front, back) != at:
                    if at:
                        out += pairs(at, limit, held)
                    at, limit, held = (l, front, back), skip, {}
                    if len(out) > 8192:
                        yield table(out)
                        out = []
                held[word] = n
        if at:
            out += pairs(at, limit, held)
        if out:
            yield table(out)

    def pairs(at, skip, held):
        l, front, back = at  # noqa: E741
        short, long = [w for w in held if len(w) == l], [w for w in held if len(w) > l]
        out = []
        for u, v in near_in_block(short, long, len(front), len(back)):
            if skip > l or u[:skip] != v[:skip]:
                out += [(u, held[u], v, held[v]), (v, held[v], u, held[u])]
        return out

    def table(out):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["word", "n", "near", "near_n"])

    key = ["l", "front", "back"]
    dealt = rows.repartitionByRange(*key).sortWithinPartitions(*key)
    return dealt.select(*key, "skip", "word", "n").mapInArrow(run, "word string, n long, near string, near_n long")


def near_pairs(known: DataFrame, tables: Tables, block: int = BLOCK) -> DataFrame:
    """(word, n, near, near_n) of distinct words (word, n): every near pair, both ways, once."""
    rows, found = tables.put(_blocks(known)), None
    key = ["l", "front", "back"]
    while True:
        total = rows.count()
        # A block without words of l code points has no pair of its own.
        sizes = rows.groupBy(*key).agg(F.count("*").alias("size"), F.min(F.length("word")).alias("least")).where("size > 1 and least = l")
        held = tables.put(split_join(rows, sizes.withColumn("many", F.col("size")).drop("least"), key, "size", total, ["word"]))
        open_ = F.col("l") - F.length("front") - F.length("back")
        large = (F.col("many") > block) & (open_ > 1)
        more = _scan(held.where(~large).drop("many"))
        found = more if found is None else found.unionByName(more)
        tables.drop(rows)
        rows = tables.put(_finer(held.where(large).drop("many")))
        if rows.isEmpty():
            return found


def _followed(forms: DataFrame, tables: Tables) -> DataFrame:
    """(word, root) of words that have a form (word, form): forms followed to the last, in twice as long steps each round."""
    now = tables.put(forms.select("word", F.col("form").alias("root")))
    total = now.count()
    while True:
        steps = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        pull = now.groupBy("root").agg(F.count("*").alias("n"))
        moves = tables.put(split_join(now, steps.join(pull, "root"), ["root"], "n", total, ["word"]).select("word", "next"))
        if moves.isEmpty():
            return now
        after = tables.put(now.join(moves, "word", "left").select("word", F.coalesce("next", "root").alias("root")))
        tables.drop(now, moves)
        now = after


def variants(docs: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text)."""
    tables = Tables(docs.sparkSession, "spelling")
    known = tables.put(words(docs))
    pairs = near_pairs(known, tables, block)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    of = known.join(best, "word", "left")
    has = -F.col("best.less") >= ratio * F.col("n")
    of = tables.put(of.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")))
    roots = _followed(of.where("form is not null"), tables)
    return of.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
