"""Language-model scores by context-tree weighting over binary-decomposed bytes, beside a word-unigram base.

Every byte is eight binary decisions; each decision has its own context tree over the DEPTH bytes before it, taken as
they are. Nodes hold zeros and ones counted over the whole training corpus, give Krichevsky-Trofimov estimates, and are
mixed over all depths by their weighted probabilities. What is gathered has no bound but the corpus: every context that
occurs is a node.

Counts are of grams, a byte behind its context with the nearest byte first, so that sorted grams hold each context's
subtree in one stretch. Texts are dealt into blocks; a block's distinct grams and words travel once, packed and sorted,
to the part of the model that owns them. A part owns all contexts that end in certain two bytes: it sums the counts,
weighs its trees from the deepest nodes up, and hands on what depth one needs, a table of at most 256 x 255 nodes that
the driver finishes. Then each part mixes from the top down, and answers the blocks' requests; answers meet the texts of
their block. Nothing but the table of depth one is collected or broadcast; a part holds its own nodes, a block its texts.

Nulls and odd rows: a null text counts as empty (one end token); a null doc_id is never held out; repeated rows count
and score each on its own. Extra columns are ignored. Without training rows N and V are 0, and scores stay finite. A
text starts as if DEPTH zero bytes stood before it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import log, log10, pi

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import Tables, batches, bounded_batches, octets

#: Bytes of context; at most six.
DEPTH = 5
#: Text bytes of a block, whose distinct grams a task holds, and of a stretch that is turned into grams at once.
BLOCK_BYTES, STRETCH = 16 << 20, 1 << 20
#: Text bytes for each part of the model; there are as many parts at most as two bytes can name.
PART_BYTES, MOST_PARTS = 16 << 20, 1 << 16
#: Distinct grams that a part of the model adds up at once.
HELD = 2_000_000
#: Stands for the end of a text among the words; no word holds a space.
END = b" "


def _held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 7 == 2, F.lit(False))


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers as planes of bytes; of ascending ones the steps are packed."""
    if ascending:
        values = np.diff(values, prepend=values.dtype.type(0))
    size = values.dtype.itemsize
    return _squeeze(values.view(np.uint8).reshape(-1, size).T.tobytes())


def unpack(raw: bytes, kind, ascending: bool = False) -> np.ndarray:
    size = np.dtype(kind).itemsize
    values = np.ascontiguousarray(np.frombuffer(_expand(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if ascending else values


def stretches(texts: list[bytes], depth: int, size: int = STRETCH) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """([(text, grams)], grams) of stretches of texts, none much longer than size; long texts are cut with their context."""
    blank = bytes(depth)
    held: list[tuple[int, int]] = []
    parts: list[bytes] = []
    have = 0

    def grams() -> np.ndarray:
        a = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
        g = a[depth:].copy()
        for k in range(1, depth + 1):
            g |= a[depth - k : len(a) - k] << np.uint64(8 * (depth + 1 - k))
        keep = np.ones(len(a), bool)
        starts = np.cumsum([0, *(n + depth for _, n in held)])[:-1]
        keep[(starts[:, None] + np.arange(depth)).ravel()] = False
        return g[keep[depth:]]

    for i, text in enumerate(texts):
        for at in range(0, len(text), size):
            piece = text[at : at + size]
            held.append((i, len(piece)))
            parts += [text[at - depth : at] if at >= depth else (blank + text[:at])[-depth:], piece]
            have += len(piece)
            if have >= size:
                yield held, grams()
                held, parts, have = [], [], 0
    if held:
        yield held, grams()


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys start."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = _runs(k)
    return k[at], np.add.reduceat(n, at) if len(at) else n


def part_of(grams: np.ndarray, parts: int, depth: int) -> np.ndarray:
    """The part of the model that owns a gram, by the two bytes nearest to its end."""
    pair = grams >> np.uint64(8 * (depth - 1))
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % parts


ROWS = "part int, block long, row long, doc_id long, held_out boolean, text binary, keys binary, counts binary"
_ROWS = {"part": pa.int32(), "block": pa.int64(), "row": pa.int64(), "doc_id": pa.int64(), "held_out": pa.bool_(), "text": pa.binary(), "keys": pa.binary(), "counts": pa.binary()}


def _batch(kinds: dict, n: int, **columns) -> pa.RecordBatch:
    def column(c, t):
        if c not in columns:
            return pa.nulls(n, t)
        return columns[c] if isinstance(columns[c], pa.Array) else pa.array(columns[c], t)

    return pa.RecordBatch.from_arrays([column(c, t) for c, t in kinds.items()], names=list(kinds))


def _gather(source, parts: int, depth: int):
    """The texts with their blocks, and for each block what it asks of each part: even parts own grams, odd ones words.

    Counts are of training texts; what only held-out texts hold asks with a count of 0.
    """
    task = TaskContext.get().partitionId()
    keys: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    words: Counter = Counter()
    block = row = size = 0

    def flush():
        nonlocal keys, counts, block, size
        out = []
        if keys:
            k, n = add_up(keys, counts)
            k, n = add_up([k >> np.uint64(1)], [np.where(k & np.uint64(1), 0, n)])
            owner = part_of(k, parts, depth)
            order = np.argsort(owner, kind="stable")
            k, n, owner = k[order], n[order], owner[order]
            for a, b in zip(at := _runs(owner), [*at[1:], len(k)], strict=True):
                out.append((2 * int(owner[a]), pack(k[a:b], True), pack(n[a:b])))
        dealt: dict[int, list[bytes]] = {}
        for w in words:
            dealt.setdefault(xxhash.xxh3_64_intdigest(w) % parts, []).append(w)
        for p, some in dealt.items():
            out.append((2 * p + 1, _squeeze(b"\n".join(some)), pack(np.array([words[w] for w in some], np.int64))))
        words.clear()
        number = task << 24 | block
        keys, counts, block, size = [], [], block + 1, 0
        for at in range(0, len(out), 64):
            some = out[at : at + 64]
            p, k, n = zip(*some, strict=True)
            yield _batch(_ROWS, len(some), part=p, block=[number] * len(some), keys=k, counts=n)

    for b in batches(source):
        held = b.column(1).to_pylist()
        texts = [t.lower() for t in octets(b.column(2))]
        n = len(texts)
        yield _batch(_ROWS, n, block=[task << 24 | block] * n, row=[task << 40 | row + i for i in range(n)], doc_id=b.column(0), held_out=held, text=texts)
        row += n
        for flag in (False, True):
            mine = [t for t, h in zip(texts, held, strict=True) if h == flag]
            for t in mine:
                if flag:
                    for w in t.split():
                        words.setdefault(w, 0)
                else:
                    words.update(t.split())
            words[END] += 0 if flag else len(mine)
            for _, g in stretches(mine, depth):
                g <<= np.uint64(1)
                g |= np.uint64(flag)
                g.sort()
                at = _runs(g)
                keys.append(g[at])
                counts.append(np.diff(at, append=len(g)))
        size += sum(map(len, texts))
        if len(keys) > 64:
            k, c = add_up(keys, counts)
            keys, counts = [k], [c]
        if size >= BLOCK_BYTES:
            yield from flush()
    yield from flush()


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, eight steps up; x > 0."""
    low = x
    for i in range(1, 8):
        low = low * (x + i)
    y = x + 8
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - np.log(low)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    # Far beyond any count of eight bytes the product in _log_gamma stays finite.
    zeros, ones = zeros.astype(np.float64), ones.astype(np.float64)
    return np.where(zeros + ones > 0, _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1) - log(pi), 0.0)


class Trees:
    """The nodes of depths 2 to depth of one part, weighed from the deepest up.

    At each depth and each of the eight levels of a byte, `nodes` holds the sorted numbers of nodes: the context, then the
    bits decided so far.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray, depth: int):
        self.grams, self.depth = grams, depth
        keys, n = {depth: grams}, {depth: counts}
        for d in range(depth - 1, 1, -1):  # a shorter context drops the byte farthest back
            longer = keys[d + 1]
            keys[d], n[d] = add_up([longer >> np.uint64(16) << np.uint64(8) | longer & np.uint64(255)], [n[d + 1]])
        self.keys, self.n = keys, n
        self.nodes: dict[tuple[int, int], np.ndarray] = {}
        self.stop: dict[tuple[int, int], np.ndarray] = {}
        self.one: dict[tuple[int, int], np.ndarray] = {}
        self.up: dict[tuple[int, int], np.ndarray] = {}
        #: Sums of the weights of depth 2 for the nodes of depth 1, by byte * 256 + node.
        self.sums = np.zeros(1 << 16)
        for j in range(8):
            below = None
            for d in range(depth, 1, -1):
                number = keys[d] >> np.uint64(8 - j)
                at = _runs(number)
                nodes = number[at]
                bit = keys[d] >> np.uint64(7 - j) & np.uint64(1)
                ones = np.add.reduceat(n[d] * bit.astype(np.int64), at) if len(at) else n[d]
                zeros = (np.add.reduceat(n[d], at) if len(at) else n[d]) - ones
                own = log_kt(zeros, ones)
                self.nodes[d, j] = nodes
                self.one[d, j] = (ones + 0.5) / (zeros + ones + 1)
                if d == depth:
                    weight, self.stop[d, j] = own, np.ones(len(own))
                else:
                    up = np.searchsorted(nodes, self.above(self.nodes[d + 1, j], j))
                    self.up[d + 1, j] = up
                    weight = np.logaddexp(own, np.bincount(up, below, len(nodes))) - log(2)
                    self.stop[d, j] = np.exp(own - log(2) - weight)
                below = weight
            self.up[2, j] = first = self.first(self.nodes[2, j], j)
            self.sums += np.bincount(first, below, 1 << 16)

    @staticmethod
    def above(nodes: np.ndarray, j: int) -> np.ndarray:
        """The numbers of nodes with the context one byte shorter."""
        return nodes >> np.uint64(8 + j) << np.uint64(j) | nodes & np.uint64((1 << j) - 1)

    @staticmethod
    def first(nodes: np.ndarray, j: int) -> np.ndarray:
        """Of nodes of depth 2, the place of the node above in a table of depth 1."""
        return ((nodes >> np.uint64(8 + j)) * np.uint64(256) + np.uint64(1 << j) + (nodes & np.uint64((1 << j) - 1))).astype(np.int64)

    def counts(self) -> np.ndarray:
        """Bytes behind each last byte, by last byte * 256 + byte."""
        k = self.keys[2]
        return np.bincount((k >> np.uint64(16) << np.uint64(8) | k & np.uint64(255)).astype(np.int64), self.n[2], 1 << 16)

    def mix(self, mixed: np.ndarray, share: np.ndarray) -> None:
        """Mixes downwards from the table of depth 1; then `guess` holds, of every node, the chance of a one if no deeper
        node is known, and `lengths` log10 of the chance of each gram."""
        self.guess = {}
        self.lengths = np.zeros(len(self.grams))
        for j in range(8):
            m, s = mixed, share
            for d in range(2, self.depth + 1):
                up, stop = self.up[d, j], self.stop[d, j]
                m = m[up] + s[up] * stop * self.one[d, j]
                s = s[up] * (1 - stop)
                self.guess[d, j] = m + 0.5 * s
            number = self.grams >> np.uint64(8 - j)
            at = _runs(number)
            one = np.repeat(self.guess[self.depth, j], np.diff(at, append=len(number)))
            bit = self.grams >> np.uint64(7 - j) & np.uint64(1)
            self.lengths += np.log10(np.where(bit == 1, one, 1 - one))

    def ask(self, grams: np.ndarray, mixed: np.ndarray, share: np.ndarray) -> np.ndarray:
        """log10 of the chance of each gram's byte after its context."""
        out = np.empty(len(grams))
        at = np.minimum(np.searchsorted(self.grams, grams), max(len(self.grams) - 1, 0))
        known = self.grams[at] == grams if len(self.grams) else np.zeros(len(grams), bool)
        out[known] = self.lengths[at[known]]
        rest = grams[~known]
        total = np.zeros(len(rest))
        for j in range(8):
            bits = (rest & np.uint64(255)) >> np.uint64(8 - j)
            last = (rest >> np.uint64(8 * self.depth)).astype(np.int64) * 256 + (1 << j) + bits.astype(np.int64)
            one = mixed[last] + 0.5 * share[last]
            for d in range(2, self.depth + 1):
                nodes = self.nodes[d, j]
                if not len(nodes):
                    break
                mine = rest >> np.uint64(8 * (self.depth - d + 1)) << np.uint64(j) | bits
                at = np.minimum(np.searchsorted(nodes, mine), len(nodes) - 1)
                one = np.where(nodes[at] == mine, self.guess[d, j][at], one)
            bit = rest >> np.uint64(7 - j) & np.uint64(1)
            total += np.log10(np.where(bit == 1, one, 1 - one))
        out[~known] = total
        return out


def top(counts: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(mixed, share) of depths 0 and 1, by last byte * 256 + node: what both give of the chance of a one, and what is left
    to deeper nodes."""
    counts, sums = counts.reshape(256, 256), sums.reshape(256, 256)
    mixed, share = np.zeros((256, 256)), np.ones((256, 256))
    for j in range(8):
        here = slice(1 << j, 2 << j)
        bits = counts.reshape(256, 1 << j, 2, -1).sum(3)
        zeros, ones = bits[:, :, 0], bits[:, :, 1]
        own = log_kt(zeros, ones)
        weight = np.logaddexp(own, sums[:, here]) - log(2)
        stop = np.exp(own - log(2) - weight)
        zero, one = zeros.sum(0), ones.sum(0)
        root = log_kt(zero, one)
        first = np.exp(root - np.logaddexp(root, weight.sum(0)))
        mixed[:, here] = first * (one + 0.5) / (zero + one + 1) + (1 - first) * stop * (ones + 0.5) / (zeros + ones + 1)
        share[:, here] = (1 - first) * (1 - stop)
    return mixed.ravel(), share.ravel()


_MODEL = {"part": pa.int32(), "keys": pa.binary(), "counts": pa.binary(), "what": pa.int32(), "at": pa.int64(), "x": pa.float64()}
MODEL = "part int, keys binary, counts binary, what int, at long, x double"
#: What the summary rows of a part add up: counts and weights for depth 1, tokens and distinct words.
COUNTS, SUMS, TOKENS, DISTINCT = range(4)


def _add_part(part: int, pieces: list[tuple[bytes, bytes]], depth: int):
    """The rows of one part of the model: its counts, and its share of what all parts add up."""
    if part % 2:
        words: Counter = Counter()
        for k, c in pieces:
            for w, n in zip(_expand(k).split(b"\n"), unpack(c, np.int64).tolist(), strict=True):
                if n:
                    words[w] += n
        if words:
            yield _batch(_MODEL, 1, part=[part], keys=[_squeeze(b"\n".join(words))], counts=[pack(np.array(list(words.values()), np.int64))])
            yield _batch(_MODEL, 2, what=[TOKENS, DISTINCT], at=[0, 0], x=[float(sum(words.values())), float(len(words))])
        return
    keys, counts, have = [], [], 0
    for k, c in pieces:
        k, c = unpack(k, np.uint64, True), unpack(c, np.int64)
        keys.append(k[c > 0])
        counts.append(c[c > 0])
        have += len(keys[-1])
        if have > HELD and len(keys) > 1:
            k, c = add_up(keys, counts)
            keys, counts, have = [k], [c], 0
    k, n = add_up(keys, counts)
    if len(k):
        yield _batch(_MODEL, 1, part=[part], keys=[pack(k, True)], counts=[pack(n)])
        trees = Trees(k, n, depth)
        for what, values in ((COUNTS, trees.counts()), (SUMS, trees.sums)):
            at = np.flatnonzero(values)
            yield _batch(_MODEL, len(at), what=[what] * len(at), at=at, x=values[at])


def _by(source, key: int):
    """(key, rows) of batches that are sorted by the column key, rows being read as they come."""
    rows = (r for b in batches(source) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    row = next(rows, None)
    while row is not None:
        now, done = row[key], False

        def group(row=row, now=now):
            nonlocal nxt, done
            while row is not None and row[key] == now:
                yield row
                row = next(rows, None)
            nxt, done = row, True

        nxt, of = None, group()
        yield now, of
        for _ in of:
            pass
        row = nxt


def train(docs: DataFrame, tables: Tables, depth: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """(texts and requests of blocks, parts of the model)."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    rows = tables.put(texts.mapInArrow(lambda source: _gather(source, parts, depth), ROWS))

    def merge(source):
        for part, of in _by(source, 0):
            yield from _add_part(part, ((r[1], r[2]) for r in of), depth)

    asked = rows.where("part is not null").select("part", "keys", "counts").repartition(parts, "part").sortWithinPartitions("part")
    return rows, tables.put(asked.mapInArrow(merge, MODEL))


def _answers(source, depth: int, mixed: np.ndarray, share: np.ndarray):
    """(block, part, keys, values): log10 chances of a block's grams, counts of its words."""
    none = np.empty(0, np.uint64)
    kinds = {"block": pa.int64(), "part": pa.int32(), "keys": pa.binary(), "counts": pa.binary()}
    for part, of in _by(source, 0):
        known = trees = None
        for _, block, keys, counts in of:
            if part % 2:
                words = _expand(keys).split(b"\n")
                if block < 0:
                    known = dict(zip(words, unpack(counts, np.int64).tolist(), strict=True))
                    continue
                get = (known or {}).get
                values = pack(np.array([get(w, 0) for w in words], np.int64))
            else:
                grams = unpack(keys, np.uint64, True)
                if block < 0 or trees is None:
                    trees = Trees(*((grams, unpack(counts, np.int64)) if block < 0 else (none, np.empty(0, np.int64))), depth)
                    trees.mix(mixed, share)
                    if block < 0:
                        continue
                values = pack(trees.ask(grams, mixed, share).astype(np.float32))
            yield _batch(kinds, 1, block=[block], part=[part], keys=[keys], counts=[values])


class Lookup:
    """Values of sorted distinct grams: most are found at the place their hash gives, the others by binary search."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        at = self._place(keys)
        self.at = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.at[at] = np.arange(len(keys), dtype=np.int32)
        self.keys, self.values = keys, values
        self.lost = np.flatnonzero(self.at[at] != np.arange(len(keys)))

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = self.at[self._place(grams)]
        other = np.flatnonzero(self.keys[at] != grams)
        if len(other):
            at[other] = self.lost[np.searchsorted(self.keys[self.lost], grams[other])]
        return self.values[at]


def _scores(source, depth: int, floor: float):
    """Rows sorted by block, the answers before the texts."""
    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    now = lookup = None
    keys: list[np.ndarray] = []
    values: list[np.ndarray] = []
    gain: dict[bytes, float] = {}
    for b in batches(source):
        blocks, parts, rows = (b.column(i).to_pylist() for i in range(3))
        texts: list[int] = []

        def flush():
            nonlocal lookup
            if lookup is None:
                k, v = np.concatenate([np.empty(0, np.uint64), *keys]), np.concatenate([np.empty(0, np.float32), *values])
                order = np.argsort(k)
                lookup = Lookup(k[order], v[order])
                keys.clear()
                values.clear()
            raw = octets(b.column(5).take(pa.array(texts)))
            own = np.zeros(len(raw))
            for held, grams in stretches(raw, depth):
                at = np.cumsum([0, *(n for _, n in held)])[:-1]
                np.add.at(own, [i for i, _ in held], np.add.reduceat(lookup(grams).astype(np.float64), at))
            tokens, known, base = [], [], []
            for t in raw:
                words = t.split()
                words.append(END)
                found = [g for g in map(gain.get, words) if g is not None]
                tokens.append(len(words))
                known.append(len(found))
                base.append(sum(found) - len(words) * floor)
            ids = pa.array(texts)
            return _batch(kinds, len(raw), doc_id=b.column(3).take(ids), held_out=b.column(4).take(ids), n_tokens=tokens, n_known=known, base_score=base, score=own)

        for i, (block, part, row) in enumerate(zip(blocks, parts, rows, strict=True)):
            if block != now:
                if texts:
                    yield flush()
                    texts.clear()
                now, lookup = block, None
                keys.clear()
                values.clear()
                gain.clear()
            if row is not None:
                texts.append(i)
            elif part % 2:
                counts = unpack(b.column(7)[i].as_py(), np.int64).tolist()
                gain.update((w, log10(c + 1)) for w, c in zip(_expand(b.column(6)[i].as_py()).split(b"\n"), counts, strict=True) if c)
            else:
                keys.append(unpack(b.column(6)[i].as_py(), np.uint64, True))
                values.append(unpack(b.column(7)[i].as_py(), np.float32))
        if texts:
            yield flush()


def score(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    tables = Tables(docs.sparkSession, "lm")
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0))).first()[0]
    parts = min(max(4, -(-size // PART_BYTES)), MOST_PARTS)
    rows, model = train(docs, tables, depth, parts)
    summary = np.zeros((4, 1 << 16))
    for r in model.where("what is not null").groupBy("what", "at").agg(F.sum("x").alias("x")).collect():  # at most 2^17 rows, whatever the corpus
        summary[r.what, r["at"]] = r.x
    mixed, share = top(summary[COUNTS], summary[SUMS])
    total, distinct = int(summary[TOKENS, 0]), int(summary[DISTINCT, 0])
    floor = log10(total + distinct + 1)

    known = model.where("part is not null").select("part", F.lit(-1).cast("long").alias("block"), "keys", "counts")
    asked = known.unionByName(rows.where("part is not null").select("part", "block", "keys", F.lit(None).cast("binary").alias("counts")))
    asked = asked.repartition(parts, "part").sortWithinPartitions("part", "block")
    answers = asked.mapInArrow(lambda source: _answers(source, depth, mixed, share), "block long, part int, keys binary, counts binary")
    both = rows.where("part is null").unionByName(answers, allowMissingColumns=True)
    both = both.select("block", "part", "row", "doc_id", "held_out", "text", "keys", "counts")
    met = both.repartition(max(4, -(-size // BLOCK_BYTES)), "block").sortWithinPartitions("block", F.asc_nulls_first("row"))
    out = met.mapInArrow(lambda source: _scores(source, depth, floor), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
