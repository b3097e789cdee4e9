"""SentencePiece BPE encoding with byte offsets, and decoding.

The normaliser replaces, from left to right, the longest prefix that the model's compiled character map holds and records,
for each normalised byte, the original byte it came from; all models go through it, those with an empty map too. A pattern
over the map's first two bytes finds where a prefix may start, so that what lies between is taken over in one piece.
Pieces are then cut from the normalised text and projected back, so every id carries the span of original bytes it stands
for; spans follow each other and cover the text but for white space that the model drops at its end.

Normalised text is cut by the library's merges with its own normaliser switched off; vocabularies without byte pieces,
whose unknown characters have no fixed size, are cut by `Codec.merge`.

Nulls and odd rows: a null text counts as empty and has no ids; bytes that are no UTF-8 become U+FFFD; repeated rows are
encoded alike; extra columns are ignored. Only BPE models with the usual white-space prefix are read; others are refused.
"""

from __future__ import annotations

import heapq
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm._common import batches, bounded_batches, octets

SPACE = "▁"


class CharMap:
    """The compiled character map: a double-array trie of byte prefixes and the strings that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :] if blob else b""
        self.start = self._start() if self.units else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _children(self, node: int) -> dict[int, int]:
        """Byte to unit of the ways out of a node."""
        at = ((b, node ^ b) for b in range(1, 256))
        return {b: self.units[i] for b, i in at if i < len(self.units) and self.units[i] & 0x800000FF == b}

    def _start(self) -> re.Pattern:
        """Where a prefix may start: a byte that is one, or a byte and one that may follow it."""
        one, two = [], {}
        root = self._offset(self.units[0])
        for b, unit in self._children(root).items():
            if unit >> 8 & 1:
                one.append(b)
            else:
                after = tuple(self._children(root ^ b ^ self._offset(unit)))
                two.setdefault(after, []).append(b)
        some = lambda bs: b"[" + b"".join(re.escape(bytes([b])) for b in bs) + b"]"
        return re.compile(b"|".join(([some(one)] if one else []) + [some(bs) + b"(?=" + some(after) + b")" for after, bs in two.items()]), re.DOTALL)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest prefix of text[at:] in the map."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = (i + 1 - at, self.strings[value : self.strings.index(b"\0", value)])
        return found

    def replacements(self, text: bytes) -> list[tuple[int, int, bytes]]:
        """(place, length, replacement) of all that is replaced, from left to right."""
        out, at = [], 0
        while self.start and (m := self.start.search(text, at)):
            at = m.start()
            if hit := self.longest(text, at):
                out.append((at, *hit))
                at += hit[0]
            else:
                at += 1
                while at < len(text) and text[at] & 0xC0 == 0x80:
                    at += 1
        return out


def _original_ends(text: bytes, ends: np.ndarray) -> np.ndarray:
    """Byte ends in a text with U+FFFD for what is no UTF-8, as ends in the text itself."""
    places, at = [0], 0
    while at < len(text):
        try:
            text[at:].decode()
            good, bad = len(text), len(text)
        except UnicodeDecodeError as e:
            good, bad = at + e.start, at + e.end
        places += [*range(at + 1, good + 1), *[bad] * (3 * (bad > good))]
        at = max(bad, good)
    return np.array(places, np.int32)[ends]


class Codec:
    """One model, read once a worker."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with white space as prefix is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.sizes = np.array([1 if p.type == pb.ModelProto.SentencePiece.BYTE else len(p.piece.encode()) for p in model.pieces], np.int32)
        self.surfaces = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        for b in range(256 if model.trainer_spec.byte_fallback else 0):
            self.surfaces[self.library.piece_to_id(f"<0x{b:02X}>")] = bytes([b])
        spec = model.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        kind = pb.ModelProto.SentencePiece
        self.pieces = {p.piece: (p.score, i) for i, p in enumerate(model.pieces) if p.type in (kind.NORMAL, kind.USER_DEFINED)}
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if model.trainer_spec.byte_fallback else None
        self.unknown = self.library.unk_id()
        # The same vocabulary without a normaliser of its own cuts text that is already normalised.
        model.normalizer_spec.add_dummy_prefix = model.normalizer_spec.remove_extra_whitespaces = False
        model.normalizer_spec.precompiled_charsmap = b""
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString()) if self.bytes else None

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """The normalised text with its spaces as they are, and the original byte of each byte and of the end.

        None: the bytes are the text's own, but for a space in front where the model wants one.
        """
        hits = self.map.replacements(text)
        if not hits and not self.squeeze:
            return (b" " + text if self.dummy and text else text), None
        here = np.arange(len(text) + 1, dtype=np.int32)
        raw, origin, upto = [], [], 0
        for at, size, new in hits:
            raw += [text[upto:at], new]
            origin += [here[upto:at], np.full(len(new), at, np.int32)]
            upto = at + size
        flat, came = b"".join([*raw, text[upto:]]), np.concatenate([*origin, here[upto:]])
        if self.squeeze:
            # At the end a mark of the text's own goes like a space.
            last = len(flat)
            while last and (flat[last - 1] == 32 or (self.escape and flat.endswith(SPACE.encode(), max(0, last - 3), last))):
                last -= 1 if flat[last - 1] == 32 else 3
            solid = np.frombuffer(flat, np.uint8)[:last] != 32
            keep = solid.copy()
            keep[1:] |= solid[:-1]
            flat, came = np.frombuffer(flat, np.uint8)[:last][keep].tobytes(), np.append(came[:last][keep], came[last])
        if self.dummy and flat:
            flat, came = b" " + flat, np.append(came[:1], came)
        return flat, came

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the original byte where it starts."""
        flat, came = self._plain(text)
        if came is None:
            came = np.maximum(np.arange(len(flat) + 1) - (len(flat) - len(text)), 0)
        if not self.escape:
            return flat, came
        wide = np.where(np.frombuffer(flat + b"x", np.uint8) == 32, 3, 1)
        return flat.replace(b" ", SPACE.encode()), np.repeat(came, wide)

    def merge(self, text: str) -> tuple[list[int], list[int]]:
        """Ids and byte lengths of the BPE pieces of a normalised text: the best scored pair first, the leftmost of equals."""
        part: list[str | None] = list(text)
        left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int):
            if a >= 0 and b >= 0:
                joined = part[a] + part[b]
                if (known := self.pieces.get(joined)) is not None:
                    heapq.heappush(heap, (-known[0], a, b, joined))

        for i in range(len(part) - 1):
            offer(i, i + 1)
        while heap:
            _, a, b, joined = heapq.heappop(heap)
            if part[a] is None or part[b] is None or right[a] != b or part[a] + part[b] != joined:
                continue
            part[a], part[b] = joined, None
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        ids, sizes, unknown = [], [], False
        for p in part:
            if p is None:
                continue
            known, raw = self.pieces.get(p), p.encode()
            if known is None and self.bytes:
                ids += [self.bytes[b] for b in raw]
                sizes += [1] * len(raw)
            elif known is None and unknown:
                sizes[-1] += len(raw)
            else:
                ids.append(self.unknown if known is None else known[1])
                sizes.append(len(raw))
            unknown = known is None
        return ids, sizes

    def cut(self, flat: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a normalised text and the normalised bytes that each takes."""
        if self.cutter:
            ids = np.array(self.cutter.encode(flat), np.int32)
            return ids, self.sizes[ids]
        ids, sizes = self.merge(flat)
        return np.array(ids, np.int32), np.array(sizes, np.int32)

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the id at i stands for original bytes ends[i - 1] to ends[i]."""
        none = np.empty(0, np.int32)
        flat, came = self._plain(text)
        if not flat:
            return none, none
        try:
            ids, sizes = self.cut((flat.replace(b" ", SPACE.encode()) if self.escape else flat).decode())
        except UnicodeDecodeError:  # no text that Spark makes of characters
            ids, ends = self.encode(text.decode("utf-8", "replace").encode())
            return ids, _original_ends(text, ends)
        ends = np.cumsum(sizes)
        if self.escape:  # back to where a space is one byte: two less for every mark before
            spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
            ends -= 2 * np.searchsorted(spaces + 2 * np.arange(len(spaces)), ends)
        return ids, (ends - (len(flat) - len(text)) if came is None else came[ends]).astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)

    def rebuild(self, ids: np.ndarray) -> str:
        """decode for ids of valid text: the pieces' surfaces without the first mark; others go to the library."""
        if self.bytes and self.dummy and not self.squeeze and not self.map.units:
            try:
                return b"".join(map(self.surfaces.__getitem__, ids.tolist()))[1:].decode()
            except UnicodeDecodeError:
                pass
        return self.library.decode(ids.tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int32), pa.int32()))


def encode(docs: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, ids, ends, decoded) of every row; ends are the exclusive byte ends of the ids' spans in the original text.

    decoded is what the library's decode gives for the ids. The model's path must be readable on every executor.
    """
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(source):
        c = codec(model)
        for b in batches(source):
            got = [c.encode(t) for t in octets(b.column(1))]
            decoded = [c.rebuild(ids) if len(ids) else "" for ids, _ in got]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([g[0] for g in got]), _lists([g[1] for g in got]), pa.array(decoded, pa.string())], names=[key, "ids", "ends", "decoded"])

    return docs.select(key, F.col("text").cast("string")).mapInArrow(run, f"{key} {kind}, ids array<int>, ends array<int>, decoded string")


def decode(encoded: DataFrame, model: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids); null ids decode to the empty text."""
    kind = dict(encoded.dtypes)[key]

    def run(source):
        c = codec(model)
        for b in batches(source):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x) if x else "" for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")
