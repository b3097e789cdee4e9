"""Near copies for the pipeline: documents whose sets of 5-word shingles have a Jaccard similarity of SIMILARITY or more.

A SimHash of 64 bits cannot find these pairs cheaply: at 0.8 two fingerprints differ in about ten bits, and a pigeonhole
index of so wide a radius brings a share of all pairs. Candidates are documents that agree in a band of MinHash values;
a pair at 0.8 agrees in one of the BANDS bands with a chance of 0.9996, more similar ones more often. Each candidate is
verified on the whole sets, which are made again from the texts of candidates only. In a bucket all are compared with one
node, its centre; what is in one group by then needs no comparison. The first rounds take few bands, so that a large family
of copies is one group before most of its buckets are looked at. After some such rounds the pairs of a bucket that are still
in different groups are compared in full, so that none is left out: first by bitmaps of their sets, which rule out only what
cannot reach the similarity, then by the sets.

Nulls and odd rows: a null text counts as empty; texts of fewer than five words are one shingle; equal sets are one node,
that of no words included; a null doc_id keeps its row and is never the smallest doc_id unless no other is there. Extra
columns pass through. Empty input, empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import Tables, batches, bounded_batches, connected_components, octets, one_a_group, split_join

SHINGLE = 5
#: Least Jaccard similarity, as a fraction so that the comparison is exact.
SIMILARITY = (4, 5)
#: BANDS keys of ROWS MinHash values each.
BANDS, ROWS = 20, 5
#: Words of 64 bits of a set's bitmap.
BITS = 8
#: Rounds in which buckets are compared with one centre each, by the number of bands that take part: what few bands bring
#: together needs no comparison in the others.
ROUNDS = (2, BANDS)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the runs of SHINGLE A-Z lower-cased words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(g, 7) for g in grams]), np.uint64))


def _signer():
    rng = np.random.default_rng(11)
    odd = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64)

    def sign(grams: np.ndarray) -> list[int]:
        """One key a band, its number mixed in; a set without shingles has none."""
        if not len(grams):
            return []
        least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 512):
            np.minimum(least, (grams[at : at + 512, None] * odd + add).min(0), out=least)
        return [int.from_bytes(xxhash.xxh64_digest(least[b * ROWS : (b + 1) * ROWS].tobytes(), b), "big", signed=True) for b in range(BANDS)]

    return sign


def _bits(grams: np.ndarray) -> list[int]:
    """A bitmap of the set, as BITS signed 64-bit numbers."""
    at = (grams >> np.uint64(20)) % np.uint64(64 * BITS)
    bits = np.zeros(64 * BITS, np.uint8)
    bits[at.astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _node(grams: np.ndarray) -> int:
    return int.from_bytes(xxhash.xxh64_digest(grams.tobytes(), 3), "big", signed=True)


def prints(docs: DataFrame) -> DataFrame:
    """(doc_id, node, size, keys, bits) of every row: node names the set of shingles, keys its bands, bits its bitmap."""
    bounded_batches(docs.sparkSession)

    def run(source):
        sign = _signer()
        for b in batches(source):
            grams = [shingles(t) for t in octets(b.column(1))]
            cols = [b.column(0), pa.array(map(_node, grams), pa.int64()), pa.array([len(g) for g in grams], pa.int64()), pa.array([sign(g) for g in grams], pa.list_(pa.int64())), pa.array([_bits(g) for g in grams], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "node", "size", "keys", "bits"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, node long, size long, keys array<long>, bits array<long>")


def texts_of(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(node, text) of the known nodes, one text each."""

    def run(source):
        for b in batches(source):
            raw = octets(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([_node(shingles(t)) for t in raw], pa.int64()), pa.array(raw, pa.binary())], names=["node", "text"])

    named = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "node long, text binary")
    return named.join(known, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))


def _may(a: str, b: str):
    """No pair whose sizes differ by more can reach SIMILARITY."""
    return F.least(a, b) * SIMILARITY[1] >= F.greatest(a, b) * SIMILARITY[0]


def _alike(a: str, b: str, m: str, n: str):
    """Bitmaps (of m and n shingles) that leave SIMILARITY possible: each differing bit is a shingle of one set alone, and sets
    that reach it have (m + n) * (1 - s) / (1 + s) such shingles at most."""
    apart = sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(BITS)), F.lit(0))
    top, bottom = SIMILARITY
    return apart * (bottom + top) <= (F.col(m) + F.col(n)) * (bottom - top)


def verified(pairs: DataFrame, texts: DataFrame, total: int) -> DataFrame:
    """The pairs (a, b), a written table of total rows, whose sets reach SIMILARITY; texts: (node, text). A node that is in very many pairs
    should be a."""

    def run(source):
        last, held = None, np.empty(0, np.uint64)
        for batch in batches(source):
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if x != last:
                    last, held = x, shingles(x)
                other = shingles(y)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(both * SIMILARITY[1] >= (len(held) + len(other) - both) * SIMILARITY[0])
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    counts = pairs.groupBy("a").agg(F.count("*").alias("n"))
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("x")).join(counts, "a")
    leaves = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return split_join(leaves, one, ["a"], "n", total, ["b"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def groups(docs: DataFrame, rounds: tuple[int, ...] = ROUNDS) -> DataFrame:
    """(doc_id, component_id) of every row: component_id is the smallest doc_id that links reach, itself included."""
    tables = Tables(docs.sparkSession, "copies")
    rows = tables.put(prints(docs))
    nodes = tables.put(rows.groupBy("node").agg(F.min("doc_id").alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys"), F.first("bits").alias("bits")))
    total = BANDS * nodes.count()
    dealt = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = dealt.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = tables.put(split_join(dealt, shared, ["key"], "n", total, ["node"]).select("band", "key", "node", "size"))
    texts = tables.put(texts_of(docs, held.select("node").distinct()))
    near, path = None, f"{tables.root}/near"
    of = tables.put(held.select("node").distinct().withColumn("group", F.col("node")))
    for turn, bands in enumerate((*rounds, BANDS)):
        bucket = held.where(F.col("band") < bands).join(of, "node")
        mixed = bucket.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.count("*").alias("n"), (F.min if turn % 2 else F.max)(F.struct("group", "node", "size")).alias("centre")).where("lo <> hi")
        bucket = split_join(bucket, mixed.select("key", "n", "centre"), ["key"], "n", total, ["node"])
        if turn < len(rounds):
            near_centre = (F.col("centre.group") != F.col("group")) & _may("size", "centre.size")
            pairs = bucket.where(near_centre).select(F.col("centre.node").alias("a"), F.col("node").alias("b"))
        else:
            bucket = tables.put(bucket.drop("centre").join(nodes.select("node", "bits", "keys"), "node"))
            one = bucket.select("key", F.col("node").alias("a"), F.col("size").alias("m"), F.col("group").alias("g"), F.col("bits").alias("p"), F.col("keys").alias("x"), "band")
            two = bucket.select("key", F.col("node").alias("b"), F.col("size").alias("n"), F.col("group").alias("h"), F.col("bits").alias("q"), F.col("keys").alias("y"))
            # A pair counts in the first band that it shares; all of them are here.
            earlier = F.exists(F.zip_with(F.slice("x", F.lit(1), F.col("band")), F.slice("y", F.lit(1), F.col("band")), lambda x, y: x == y), lambda e: e)
            pairs = one.join(two, "key").where((F.col("a") < F.col("b")) & (F.col("g") != F.col("h")) & _may("m", "n") & _alike("p", "q", "m", "n") & ~earlier).select("a", "b")
        pairs = tables.put(pairs.distinct())
        if not (n := pairs.count()):
            continue
        # One table of links, so that no plan grows with the rounds.
        verified(pairs, texts, n).write.mode("append").parquet(path)
        near = docs.sparkSession.read.schema("a long, b long").parquet(path)
        tables.drop(pairs)
        ways = near.unionByName(near.select(F.col("a").alias("b"), F.col("b").alias("a"))).select(F.col("b").alias("node"), F.col("a").alias("to"))
        # Nodes near one centre are in one group, and groups with a node in common grow together; whole components are only
        # made at the end.
        hubs = of.select(F.col("node").alias("to"), "group").join(ways.groupBy("to").agg(F.count("*").alias("n")), "to")
        least = split_join(ways, hubs, ["to"], "n", 2 * total, ["node"]).groupBy("node").agg(F.min("group").alias("least"))
        after = tables.put(of.join(least, "node", "left").select("node", F.least("least", "group").alias("group")))
        tables.drop(of)
        of = after
    tables.drop(texts)
    of = None if near is None else connected_components(tables, near)
    named = nodes.select("node", "first", F.col("node").alias("component")) if of is None else nodes.join(of, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    named = tables.put(named)
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("node", "component_id")
    return rows.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, once each; rows without a doc_id stay."""
    return one_a_group(docs, groups(docs))
