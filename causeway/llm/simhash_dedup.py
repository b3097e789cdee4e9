"""SimHash near-duplicates with a generalised pigeonhole index.

Documents become 64-bit fingerprints of 3-word shingles. Fingerprints that differ in few bits are found without
comparing all pairs: correlated bits are grouped into parts, a dynamic programme gives each part its own threshold by
the candidates it is expected to bring, every fingerprint is indexed by the parts' values and probes the values within
the threshold, and a hit is verified on the whole fingerprint.

Nulls and odd rows: a null text counts as empty; texts without words have fingerprint 0 and link like any other; equal
fingerprints are one node; a null doc_id keeps its row, with the component of its fingerprint, and is never the
smallest doc_id unless no other is there. Extra columns are ignored. Empty input gives an empty result.
"""

from __future__ import annotations

import itertools
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm._common import Tables, batches, bounded_batches, connected_components, octets, one_a_group

BITS = 64
SHINGLE = 3
MAX_BITS = 3
#: Fingerprints from which the planner estimates candidate counts; the plan changes cost, never results.
PLAN_SAMPLE = 3000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of A-Z lower-cased words."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(g, 42) for g in grams])
    hashes = np.frombuffer(raw, np.uint8).reshape(-1, 8)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 255):  # sums of so many bits fit a byte
        ones += np.add.reduce(np.unpackbits(hashes[at : at + 255], axis=1), axis=0, dtype=np.uint8)
    packed = np.packbits(2 * ones > len(hashes)).tobytes()
    return int.from_bytes(packed, "big", signed=True)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) of every row."""
    bounded_batches(docs.sparkSession)

    def run(source):
        for b in batches(source):
            fp = [fingerprint(t) for t in octets(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype(">i8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]  # column i: bit i


def bit_counts(nodes: DataFrame) -> np.ndarray:
    """64 x 64 counts of bits set together over all fingerprints; each task sends one matrix."""

    def run(source):
        total = np.zeros((BITS, BITS))
        for b in batches(source):
            x = _bits(np.asarray(b.column(0))).astype(np.float32)
            total += x.T @ x
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "n"])

    out = np.zeros((BITS, BITS))
    for r in nodes.select("fp").mapInArrow(run, "i long, j long, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.i, r.j] = r.n
    return out


def group_bits(counts: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Equal parts that each hold bits which go together: a part starts at the freest bit of highest variance and grows by correlation."""
    p = np.diag(counts) / max(n, 1)
    cov = counts / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs(cov / np.outer(sd, sd))
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = (BITS * (k + 1)) // parts - (BITS * k) // parts
        part = [max(free, key=lambda b: (sd[b], -b))]
        free.discard(part[0])
        while len(part) < width:
            nxt = max(free, key=lambda b: (corr[b, part].mean(), -b))
            part.append(nxt)
            free.discard(nxt)
        out.append(sorted(part))
    return out


def allocate(costs: list[list[float]], budget: int) -> list[int]:
    """Thresholds t_p >= -1 with sum(t_p + 1) = budget at the least total cost; costs[p][t + 1]."""
    best = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, ts) in best.items():
            for share in range(min(budget - used, len(row) - 1) + 1):
                got = (cost + row[share], [*ts, share - 1])
                if used + share not in nxt or got[0] < nxt[used + share][0]:
                    nxt[used + share] = got
        best = nxt
    return best[budget][1]


def plan_parts(counts: np.ndarray, sample: np.ndarray, n: int, max_bits: int = MAX_BITS) -> list[tuple[list[int], int]]:
    """[(bits, threshold)] of the cheapest plan over 2 to max_bits + 1 parts; parts with threshold -1 are left out."""
    x = _bits(sample).astype(np.int16)
    pairs = max(len(x) * (len(x) - 1) / 2, 1)
    best = None
    for m in range(2, max_bits + 2):
        groups, costs = group_bits(counts, n, m), []
        for g in groups:
            v = x[:, g].astype(np.float32)
            ones = v.sum(1)
            apart = ones[:, None] + ones[None] - 2 * v @ v.T
            row = [0.0]
            for t in range(max_bits + 1):
                near = ((apart <= t).sum() - len(x)) / 2 / pairs
                keys = sum(comb(len(g), i) for i in range(t + 1))
                row.append(max(near, keys / 2.0 ** len(g)) * n * n / 2 + 2.0 * n * (keys + 1))
            costs.append(row)
        ts = allocate(costs, max_bits + 1)
        cost = sum(c[t + 1] for c, t in zip(costs, ts, strict=True))
        if best is None or cost < best[0]:
            best = (cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0])
    return best[1]


def _mask(bits) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >= 1 << 63 else m


def links(nodes: DataFrame, plan: list[tuple[list[int], int]], max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: fingerprints within max_bits, by exact lookup of every value within a part's threshold.

    A pair is sent once a part at most; the verification is on all 64 bits.
    """
    index, probe = [], []
    for k, (bits, t) in enumerate(plan):
        value = F.col("fp").bitwiseAND(F.lit(_mask(bits)))
        index.append(F.struct(F.lit(k).alias("part"), value.alias("value")))
        for r in range(t + 1):
            probe += [F.struct(F.lit(k).alias("part"), value.bitwiseXOR(F.lit(_mask(c))).alias("value")) for c in itertools.combinations(bits, r)]
    left = nodes.select(F.col("fp").alias("a"), F.explode(F.array(*index)).alias("key"))
    right = nodes.select(F.col("fp").alias("b"), F.explode(F.array(*probe)).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    cols = [F.col("key.part").alias("part"), F.col("key.value").alias("value")]
    return left.select("a", *cols).join(right.select("b", *cols), ["part", "value"]).where(near).select("a", "b")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach, itself included."""
    spark = docs.sparkSession
    tables = Tables(spark, "simhash")
    prints = tables.put(fingerprints(docs))
    nodes = tables.put(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    n = nodes.count()
    # The sample is a bounded number of fingerprints; it only steers the plan.
    some = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, -(-n // PLAN_SAMPLE)))) == 0).limit(2 * PLAN_SAMPLE)
    sample = np.array([r.fp for r in some.collect()], np.int64)
    plan = plan_parts(bit_counts(nodes), sample, n, max_bits) if n > 1 else []
    if plan:
        found = tables.put(links(nodes, plan, max_bits))
        of = connected_components(tables, found)
        nodes = nodes.join(of, nodes.fp == of.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
        nodes = tables.put(nodes)
        least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
        nodes = nodes.join(least, "component").select("fp", "component_id")
    else:
        nodes = nodes.select("fp", F.col("first").alias("component_id"))
    return prints.join(nodes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component, once each; rows without a doc_id stay."""
    return one_a_group(docs, near_duplicates(docs, max_bits))
