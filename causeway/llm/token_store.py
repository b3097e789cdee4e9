"""Token ids of texts in compressed binary files: Re-Pair grammars, readable from any place.

`write` encodes texts with a tokenizer file of the tokenizers library, appends an end id to each document and writes the
ids of all documents in ascending doc_id order, as files of blocks. A block's ids are compressed by Re-Pair: the pairs of
neighbouring symbols that occur most often are replaced by new symbols, again and again, until few pairs occur LEAST times
or the symbols no longer fit 16 bits. Each round replaces many pairs at once; where two of them overlap, the more frequent
one wins and the other waits for the next round. The block keeps the rules and the length that each expands to, so that a
range of ids is decoded from the symbols that cover it alone (`read_range`).

File layout, little-endian: MAGIC; blocks; a footer of the documents' ids, null marks and first places, and of the blocks'
byte offsets and first places; eight numbers of 8 bytes that end the file. A block: five numbers (ids, alphabet, rules,
symbols, bytes of a symbol), alphabet (u32), rules (pairs of u32), expansion lengths (u32), symbols (u16 or u32).

Texts are dealt by ranges of doc_id and each task writes its files in order; the manifest, which Spark commits, lists the
files, and attempts that were not committed leave files that no manifest lists. A task holds one block of ids, and one text:
texts are cut into pieces where the tokenizer's own rule cuts them, and pieces seen before are not encoded again; a new word
with marks behind it is put together from both. The ids of a batch of texts are put together from its distinct pieces. A
document's place among all ids comes from running sums over the manifest.

Nulls and odd rows: a null text counts as empty and has the end id alone; rows with a null doc_id come first, rows that
repeat a doc_id follow each other by a hash of the text, then the text; extra columns are ignored; no documents, no files.
"""

from __future__ import annotations

import json
import os
import posixpath
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import batches, bounded_batches
from causeway.operators.timeline import running

MAGIC = b"CWREPAIR"
#: Ids of one block, and ids from which a file ends with the document.
BLOCK_IDS, FILE_IDS = 1 << 20, 1 << 24
#: Occurrences from which a pair is replaced, rounds at most, and pairs of one round at most.
LEAST, ROUNDS, PER_ROUND = 4, 10, 4096
#: A round that shortens the sequence by less than this share is the last.
GAIN = 0.02
END_ID = 0
#: Bytes, about, of the pieces that a worker remembers, and what one takes besides its characters.
CACHE, ENTRY = 256 << 20, 150
#: New pieces that the library gets as one text: it takes longer over the pieces of longer ones.
LEARNED = 128
READ_TASKS = 4096
#: Symbols that fit 16 bits; ids up to which a table numbers them.
_FEW, _TABLE = 1 << 16, 1 << 22


# --- grammar -----------------------------------------------------------------------------------------------------------


def _frequent(left: np.ndarray, right: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the most frequent pairs, at most `most`, best first; a key is two 16-bit symbols."""
    keys = np.sort(left << np.uint32(16) | right)
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.append(at, len(keys)))
    some = np.flatnonzero(counts >= LEAST)
    if len(some) > most:
        some = some[np.argpartition(counts[some], -most)[-most:]]
    some = some[np.argsort(-counts[some], kind="stable")]
    return keys[at[some]], counts[some]


def _round(seq: np.ndarray, first: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(shorter sequence, rules): pairs replaced by symbols from `first` on."""
    left, right = seq[:-1], seq[1:]
    keys, _ = _frequent(left, right, most)
    none = (seq, np.zeros((0, 2), np.uint32))
    if not len(keys):
        return none
    # Ranks by a table of hashes; of two pairs with one hash the less frequent waits for another round.
    spread = lambda key: (key ^ key >> np.uint32(15)) * np.uint32(2654435761) >> np.uint32(14)
    rank_at = np.full(1 << 18, len(keys), np.uint16)
    rank_at[spread(keys[::-1])] = np.arange(len(keys))[::-1]
    known = np.append(keys, keys[-1])
    starts = np.zeros(first, bool)
    starts[keys >> np.uint32(16)] = True
    place = np.flatnonzero(starts[left])
    key = left[place] << np.uint32(16) | right[place]
    rank = rank_at[spread(key)]
    found = (known[rank] == key) & (rank < len(keys))
    place, rank = place[found], rank[found]
    if not len(place):
        return none
    # Places that overlap: the better rank is taken; in a run of one symbol every other place.
    joins = np.append(place[1:] == place[:-1] + 1, False)
    after = np.where(joins, np.append(rank[1:], 0), len(keys))
    joined = np.concatenate(([False], joins[:-1]))
    before = np.where(joined, np.concatenate(([0], rank[:-1])), len(keys))
    nth = np.arange(len(place))
    run = nth - np.maximum.accumulate(np.where(joined & (before == rank), 0, nth))
    taken = (run % 2 == 0) & ((rank < before) | (run > 0)) & (rank <= after)
    used = np.bincount(rank[taken], minlength=len(keys))
    taken &= used[rank] >= 2
    number = np.cumsum(used >= 2) - 1
    out = seq.copy()
    at = place[taken]
    out[at] = first + number[rank[taken]]
    stays = np.ones(len(seq), bool)
    stays[at + 1] = False
    rules = keys[used >= 2]
    return out[stays], np.stack([rules >> np.uint32(16), rules & np.uint32(0xFFFF)], 1)


def compress(ids: np.ndarray) -> bytes:
    """One block."""
    alphabet = np.unique(ids)
    first, top = len(alphabet), int(alphabet[-1]) + 1 if len(alphabet) else 0
    if top <= _TABLE:
        number = np.zeros(top, np.uint32)
        number[alphabet] = np.arange(first)
        seq = number[ids]
    else:
        seq = np.searchsorted(alphabet, ids).astype(np.uint32)
    rules = []
    room = max(_FEW - first, 0)
    for _ in range(ROUNDS):
        if len(seq) < 2 or not room:
            break
        shorter, more = _round(seq, first, min(room, PER_ROUND))
        if not len(more):
            break
        rules.append(more)
        first, room = first + len(more), room - len(more)
        gain = len(seq) - len(shorter)
        seq = shorter
        if gain < GAIN * len(seq):
            break
    every = np.concatenate([np.zeros((0, 2), np.uint32), *rules])
    lengths = np.ones(first, np.uint32)
    at = len(alphabet)
    for some in rules:
        lengths[at : at + len(some)] = lengths[some[:, 0]] + lengths[some[:, 1]]
        at += len(some)
    width = 2 if first <= _FEW else 4
    head = np.array([len(ids), len(alphabet), len(every), len(seq), width], "<u8")
    return b"".join([head.tobytes(), alphabet.astype("<u4").tobytes(), every.astype("<u4").tobytes(), lengths[len(alphabet) :].astype("<u4").tobytes(), seq.astype(f"<u{width}").tobytes()])


def expand(block: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of a block from start to stop, made from the symbols that cover them."""
    n_ids, n_terms, n_rules, n_symbols, width = (int(x) for x in np.frombuffer(block, "<u8", 5))
    at = 40
    alphabet = np.frombuffer(block, "<u4", n_terms, at)
    rules = np.frombuffer(block, "<u4", 2 * n_rules, at := at + 4 * n_terms).reshape(-1, 2)
    lengths = np.concatenate([np.ones(n_terms, np.int64), np.frombuffer(block, "<u4", n_rules, at := at + 8 * n_rules).astype(np.int64)])
    seq = np.frombuffer(block, f"<u{width}", n_symbols, at + 4 * n_rules).astype(np.int64)
    stop = n_ids if stop is None else min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, np.uint32)
    skipped = 0
    if start or stop < n_ids:
        ends = np.cumsum(lengths[seq])
        lo, hi = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
        skipped, seq = int(ends[lo] - lengths[seq[lo]]), seq[lo : hi + 1]
    while len(deep := np.flatnonzero(seq >= n_terms)):
        pair = rules[seq[deep] - n_terms]
        place = deep + np.arange(len(deep))
        longer = np.empty(len(seq) + len(deep), np.int64)
        rest = np.ones(len(longer), bool)
        rest[place] = rest[place + 1] = False
        longer[place], longer[place + 1] = pair[:, 0], pair[:, 1]
        longer[rest] = seq[seq < n_terms]
        seq = longer
    return alphabet[seq[start - skipped : stop - skipped]]


# --- files -------------------------------------------------------------------------------------------------------------


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


class Writer:
    """One file: documents go in one by one, blocks are written as they fill."""

    def __init__(self, uri: str):
        self.uri = uri
        system, at = _open(uri)
        self.out = system.open_output_stream(at, compression=None)
        self.at = self.out.write(MAGIC)
        self.docs, self.starts, self.blocks = [], [0], []
        self.held, self.n_held = [], 0

    @property
    def n_ids(self) -> int:
        return self.starts[-1]

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.n_ids + len(ids))
        while len(ids):
            part, ids = ids[: BLOCK_IDS - self.n_held], ids[BLOCK_IDS - self.n_held :]
            self.held.append(part)
            self.n_held += len(part)
            if self.n_held == BLOCK_IDS:
                self._flush(self.n_ids - len(ids))

    def _flush(self, upto: int) -> None:
        if self.n_held:
            self.blocks.append((self.at, upto - self.n_held))
            self.at += self.out.write(compress(np.concatenate(self.held)))
            self.held, self.n_held = [], 0

    def close(self) -> int:
        """Bytes of the file."""
        self._flush(self.n_ids)
        known = np.array([0 if d is None else d for d in self.docs], "<i8")
        nulls = np.array([d is None for d in self.docs], "u1")
        offsets, firsts = np.array(self.blocks, "<u8").reshape(-1, 2).T
        foot = known.tobytes() + nulls.tobytes() + np.array(self.starts, "<u8").tobytes() + offsets.tobytes() + firsts.tobytes()
        tail = np.array([len(self.docs), len(self.blocks), self.n_ids, self.at, len(foot), 0, 0, 1], "<u8")
        size = self.at + self.out.write(foot) + self.out.write(tail.tobytes())
        self.out.close()
        return size


class Reader:
    """One file: its documents, and any range of its ids."""

    def __init__(self, uri: str):
        system, at = _open(uri)
        self.file = system.open_input_file(at)
        size = self.file.size()
        n_docs, n_blocks, self.n_ids, foot, n_foot, *_ = (int(x) for x in np.frombuffer(self.file.read_at(64, size - 64), "<u8"))
        raw = self.file.read_at(n_foot, foot)
        nulls = np.frombuffer(raw, "u1", n_docs, 8 * n_docs)
        self.docs = [None if gone else d for d, gone in zip(np.frombuffer(raw, "<i8", n_docs).tolist(), nulls.tolist(), strict=True)]
        self.starts = np.frombuffer(raw, "<u8", n_docs + 1, 9 * n_docs).astype(np.int64)
        at = 9 * n_docs + 8 * (n_docs + 1)
        self.offsets = np.append(np.frombuffer(raw, "<u8", n_blocks, at).astype(np.int64), foot)
        self.firsts = np.append(np.frombuffer(raw, "<u8", n_blocks, at + 8 * n_blocks).astype(np.int64), self.n_ids)
        self._block = (-1, None)

    def close(self) -> None:
        self.file.close()

    def _ids(self, n: int, start: int, stop: int) -> np.ndarray:
        return expand(self.file.read_at(int(self.offsets[n + 1] - self.offsets[n]), int(self.offsets[n])), start, stop)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids from start to stop, counted in the file; only the blocks that hold them are read."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.zeros(0, np.uint32)
        lo, hi = int(np.searchsorted(self.firsts, start, "right")) - 1, int(np.searchsorted(self.firsts, stop, "left"))
        return np.concatenate([self._ids(n, max(start - int(self.firsts[n]), 0), stop - int(self.firsts[n])) for n in range(lo, hi)])

    def __iter__(self) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, start, ids as little-endian 32-bit numbers) of every document; each block is decoded once."""
        held, first, n = np.zeros(0, np.uint32), 0, 0
        for doc, start, stop in zip(self.docs, self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            parts = [held[start - first : stop - first]]
            while first + len(held) < stop:
                first, held = first + len(held), self._ids(n, 0, BLOCK_IDS)
                n += 1
                parts.append(held[: stop - first])
            yield doc, start, np.concatenate(parts).astype("<u4").tobytes()


# --- encoding ----------------------------------------------------------------------------------------------------------

#: A space between two characters that are not white space begins a piece: no token of a byte-level tokenizer reaches
#: across it, and what stands before and after it has no part in how a piece is cut further.
_CUT = re.compile(r" (?=\S)(?<=\S )")
#: ASCII that is no letter, digit or white space; the first character beyond the Latin blocks.
_MARKS, _BEYOND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "\u0250"
_tokenizers: dict = {}


def _byte_names() -> dict[int, str]:
    """The characters by which byte-level tokenizers name the bytes that do not stand for themselves."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in own)}


def _cuts_plainly(tokenizer) -> bool:
    """Whether the tokenizer cuts by the byte-level rule alone, merges each run by itself, and has no added token in words with marks behind."""
    from tokenizers import models

    model, rule = tokenizer.model, tokenizer.pre_tokenizer and json.loads(tokenizer.pre_tokenizer.__getstate__())
    by_rule = isinstance(rule, dict) and rule.get("type") == "ByteLevel" and rule.get("use_regex", True) and not rule.get("add_prefix_space")
    merges = isinstance(model, models.BPE) and not (model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix)
    whole = tokenizer.normalizer is None and tokenizer.truncation is None and tokenizer.padding is None
    inside = lambda x: any(a in _MARKS and b.isalpha() for a, b in zip(x, x[1:], strict=False))
    return bool(by_rule and merges and whole) and all(inside(t.content) and not t.normalized for t in tokenizer.get_added_tokens_decoder().values())


class _Encoder:
    """What a worker knows of a tokenizer file: the library's tokenizer, its tokens' sizes, and the ids of pieces seen before."""

    def __init__(self, model: str):
        # One task has one core: threads that the library wakes for each call would only spin beside it.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.sizes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.sizes[i] = len(token)  # one character a byte
        self.plain, self.names = _cuts_plainly(self.tokenizer), _byte_names()
        self.known, self.marks, self.held = {}, {}, 0

    def _ids(self, texts: list[str]) -> np.ndarray:
        return np.array([i for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], "<u4")

    def _merge(self, known: dict, runs: list[str], before: str) -> None:
        """Encodes runs that the tokenizer's rule keeps whole, with the named bytes before each."""
        merge, names, ids, ends = self.tokenizer.model.tokenize, self.names, [], []
        for run in runs:
            # ASCII that is no white space stands for itself.
            ids += [t.id for t in merge(before + (run if run.isascii() else run.encode().decode("latin-1").translate(names)))]
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        known.update(zip(runs, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=False))
        self.held += ENTRY * len(runs) + len(raw)

    def _learn(self, pieces: list[str]) -> None:
        """Encodes pieces, with the space before each.

        The byte-level rule keeps Latin letters whole, and the marks behind them: such pieces are put together from both, of
        which most are known. Other pieces the library gets as texts.
        """
        if not self.plain:
            self._learn_whole(pieces)
            return
        known, marks = self.known, self.marks
        alone, whole, made, words, tails = [], [], [], [], []
        for p in pieces:
            word = p.rstrip(_MARKS)
            if not word.isalpha() or not (word.isascii() or max(word) < _BEYOND):
                whole.append(p)
            elif len(word) == len(p):
                alone.append(p)
            else:
                made.append(p)
                words.append(word)
                tails.append(p[len(word) :])
        self._merge(known, alone, self.names[32])
        self._merge(known, [w for w in dict.fromkeys(words) if w not in known], self.names[32])
        self._merge(marks, [t for t in dict.fromkeys(tails) if t not in marks], "")
        for p, word, tail in zip(made, words, tails, strict=True):
            known[p] = known[word] + marks[tail]
            self.held += ENTRY + 5 * len(p)
        self._learn_whole(whole)

    def _learn_whole(self, pieces: list[str]) -> None:
        """Encodes pieces, with the space before each, and tells from the tokens' bytes where each one ends."""
        for at in range(0, len(pieces), 65536):
            some = pieces[at : at + 65536]
            ids = self._ids([" " + " ".join(some[i : i + LEARNED]) for i in range(0, len(some), LEARNED)])
            ends = np.cumsum([len(p) + 1 if p.isascii() else len(p.encode()) + 1 for p in some])
            cuts = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends, "left") + 4).tolist()
            raw = ids.tobytes()
            self.known.update(zip(some, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=False))
            self.held += ENTRY * len(some) + int(ends[-1])

    def _make_room(self) -> None:
        if self.held > CACHE:
            self.known.clear()
            self.marks.clear()
            self.held = 0

    def _first(self, piece: str) -> bytes:
        """What a text begins with has no space before it; the mark keeps it apart from such pieces."""
        if (start := self.known.get((piece,))) is None:
            start = self.known[(piece,)] = self._ids([piece]).tobytes()
            self.held += ENTRY + len(piece) + len(start)
        return start

    def __call__(self, text: str) -> np.ndarray:
        """The ids of a text, as the library's encode gives them without special tokens added."""
        if not text:
            return np.zeros(0, np.uint32)
        first, *pieces = _CUT.split(text)
        parts = list(map(self.known.get, pieces))
        if None in parts:
            self._make_room()
            self._learn([p for p in dict.fromkeys(pieces) if p not in self.known])
            parts = list(map(self.known.__getitem__, pieces))
        return np.frombuffer(self._first(first) + b"".join(parts), "<u4")

    def rows(self, texts: pa.Array, end_id: int) -> list[np.ndarray]:
        """The ids of each text with the end id behind them.

        All texts are cut at every space at once, and each distinct piece of them is looked up once. A text in which other
        white space, or another space, lies next to a space is cut and encoded by itself.
        """
        if not len(texts):
            return []
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        cut = pc.split_pattern(texts, " ")
        begins = np.concatenate(([0], np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False))))[:-1]
        flat = cut.flatten().dictionary_encode()
        piece, words = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32), flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        heads = np.array([not p or p[0].isspace() for p in words], bool)[piece]
        tails = np.array([not p or p[-1].isspace() for p in words], bool)[piece]
        heads[begins] = False
        bad = np.concatenate(([False], tails[:-1]))
        bad[begins] = False
        bad |= heads
        odd = np.logical_or.reduceat(bad, begins)
        # Of odd texts the first piece stands for all, the others for nothing; number len(words) is nothing.
        if odd.any():
            piece[np.repeat(odd, np.diff(np.append(begins, len(piece))))] = len(words)
        firsts = piece[begins].tolist()
        piece[begins] = len(words)
        asked = np.flatnonzero(np.bincount(piece, minlength=len(words) + 1)[:-1]).tolist()
        self._make_room()
        parts = [b""] * (len(words) + 1)
        new = []
        for i, ids in zip(asked, map(self.known.get, map(words.__getitem__, asked)), strict=True):
            if ids is None:
                new.append(i)
            else:
                parts[i] = ids
        self._learn([words[i] for i in new])
        for i in new:
            parts[i] = self.known[words[i]]
        for i, n in enumerate(firsts):
            parts.append(self(texts[i].as_py()).tobytes() if odd[i] else self._first(words[n]) if words[n] else b"")
        piece[begins] = len(words) + 1 + np.arange(len(begins))
        sizes = np.array(list(map(len, parts)), np.int64) // 4
        every, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        here = sizes[piece]
        upto = np.cumsum(here)
        ids = np.repeat(starts[piece] - upto + here, here)
        ids += np.arange(len(ids))
        ids = every[ids]
        stops = upto[np.append(begins[1:], len(piece)) - 1].tolist()
        end = np.array([end_id], np.uint32)
        return [np.concatenate([ids[a:b], end]) for a, b in zip([0, *stops], stops, strict=False)]


def _encoder(model: str) -> _Encoder:
    if model not in _tokenizers:
        _tokenizers[model] = _Encoder(model)
    return _tokenizers[model]


def write(docs: DataFrame, folder: str, model: str, end_id: int = END_ID) -> DataFrame:
    """Writes the ids of docs (doc_id, text) under folder; gives the manifest (part, nth, path, docs, ids, bytes), which must
    be kept once. Files in order of (part, nth) hold documents in ascending order.

    model: a byte-level tokenizer file of the tokenizers library, at a path that executors see.
    """
    bounded_batches(docs.sparkSession)

    def run(source):
        task = TaskContext.get()
        encoder = _encoder(model)
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        file, nth = None, 0

        def closed():
            name = posixpath.basename(file.uri)
            return pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "nth": pa.array([nth], pa.int64()), "path": [f"{folder}/{name}"], "docs": [len(file.docs)], "ids": [file.n_ids], "bytes": [file.close()]})

        for b in batches(source):
            for doc, ids in zip(b.column(0).to_pylist(), encoder.rows(b.column(1), end_id), strict=True):
                if file is None:
                    file = Writer(f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{nth:04d}.repair")
                file.add(doc, ids)
                if file.n_ids >= FILE_IDS:
                    yield closed()
                    file, nth = None, nth + 1
        if file is not None:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text")
    return dealt.select("doc_id", "text").mapInArrow(run, "part long, nth long, path string, docs long, ids long, bytes long")


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document in the listed files: start counts the ids of all documents before it, ids are
    little-endian 32-bit numbers in one binary value."""

    def run(source):
        for b in batches(source):
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                file = Reader(path)
                rows, size = [], 0
                for doc, start, ids in file:
                    rows.append((doc, before + start, ids))
                    size += len(ids) + 64
                    if size > 4 << 20:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)
                file.close()

    def table(rows):
        docs, starts, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

    placed = manifest.select("path", "ids", (F.col("part") * (1 << 20) + F.col("nth")).alias("at"), F.lit(0).alias("all"))
    placed = running(placed, "all", "at", F.col("ids"), "upto", block=1 << 26).select("path", (F.col("upto") - F.col("ids")).alias("before"))
    # A given number of partitions, which Spark does not fold together: paths are few bytes, what they name is not.
    return placed.repartition(min(max(manifest.count(), 1), READ_TASKS)).mapInArrow(run, "doc_id long, start long, ids binary")


def read_range(manifest: DataFrame, start: int, stop: int) -> np.ndarray:
    """The ids from start to stop among those of all documents, which must fit the driver: from the files and blocks that
    hold them."""
    parts, before = [], 0
    for row in manifest.orderBy("part", "nth").select("path", "ids").toLocalIterator():
        if before < stop and before + row.ids > start:
            file = Reader(row.path)
            parts.append(file.range(max(start - before, 0), stop - before))
            file.close()
        before += row.ids
    return np.concatenate([np.zeros(0, np.uint32), *parts])
