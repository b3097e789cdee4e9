"""The character map, the normaliser's alignment and the merges, for models with and without a map."""

import random

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from causeway.llm import queries, sentencepiece_codec

TEXTS = [
    "", " ", "   ", "one two", "  one   two  ", "ﬁne ﬂow", "Ａｂｃ　ｄ", "é äo", "①½ ㌔ ㍿", "a b​c　", "tab\tline\nend\r\n",
    "\u0000x\u0007", "日本語 ﾃｽﾄ ｶﾞ", "한국어 한", "😀 né", "▁ mark", "¨ acute´ x", "ẛ̣", "…—", "x" * 300,
]
ALPHABET = list("abc  é̈ﬁＡ　①ｶﾞ하日é😀\n\t▁")


def rule(name):
    proto = pb.ModelProto()
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=name).serialized_model_proto())
    return proto.normalizer_spec.precompiled_charsmap


def model(tmp_path, charmap=b"", squeeze=False, dummy=True, bytes_too=True):
    proto = pb.ModelProto()
    with open(queries.piece_model(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.precompiled_charsmap = charmap
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    proto.normalizer_spec.add_dummy_prefix = dummy
    if not bytes_too:
        proto.trainer_spec.byte_fallback = False
        for p in proto.pieces:
            if p.type == pb.ModelProto.SentencePiece.BYTE:
                p.type = pb.ModelProto.SentencePiece.CONTROL
    path = tmp_path / "m.model"
    path.write_bytes(proto.SerializeToString())
    return str(path)


def texts(seed):
    rng = random.Random(seed)
    return TEXTS + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(1, 40))) for _ in range(150)]


@pytest.mark.parametrize("name", ["nmt_nfkc", "nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize(("squeeze", "dummy"), [(True, True), (False, True), (True, False)])
def test_mapped_models_equal_the_library(tmp_path, name, squeeze, dummy):
    path = model(tmp_path, rule(name), squeeze, dummy)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    assert own.map.units
    for t in texts(1):
        raw = t.encode()
        ids, ends = own.encode(raw)
        assert ids.tolist() == library.encode(t), t
        assert own.rebuild(ids) == library.decode(ids.tolist()) if len(ids) else True
        assert len(ends) == len(ids) and all(a <= b for a, b in zip([0, *ends], ends)) and (not len(ends) or ends[-1] <= len(raw))


def test_alignment_of_replaced_prefixes(tmp_path):
    own = sentencepiece_codec.Codec(model(tmp_path, rule("nmt_nfkc"), True))
    raw = "ﬁ  é ".encode()
    flat, came = own.normalise(raw)
    assert flat.decode() == "▁fi▁é"
    # The mark and both letters come from the ligature; of two spaces the first stands; the accent's letter is one unit.
    assert came.tolist() == [0, 0, 0, 0, 0, 3, 3, 3, 5, 5, 8]
    assert own.map.longest("éx".encode(), 0) == (3, "é".encode()) and own.map.longest(b"ex", 0) is None


def test_replacements_equal_a_walk_over_all_places(tmp_path):
    own = sentencepiece_codec.Codec(model(tmp_path, rule("nmt_nfkc_cf")))
    for t in texts(2):
        raw, at, want = t.encode(), 0, []
        while at < len(raw):
            hit = own.map.longest(raw, at)
            if hit:
                want.append((at, *hit))
            at += hit[0] if hit else len(raw[at:].decode()[0].encode())
        assert own.map.replacements(raw) == want


@pytest.mark.parametrize("charmap", ["", "nmt_nfkc"])
def test_own_merges_equal_the_library(tmp_path, charmap):
    path = model(tmp_path, rule(charmap) if charmap else b"", bool(charmap), bytes_too=False)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.Codec(path)
    assert own.cutter is None
    for t in [*texts(3), "the quick brown fox, unmistakably", "ø ж 中 unknown 𐍈𐍉 end"]:
        ids, ends = own.encode(t.encode())
        assert ids.tolist() == library.encode(t), t
        assert len(ends) == len(ids)


def test_identity_spans_are_the_pieces_bytes():
    own = sentencepiece_codec.codec(queries.piece_model())
    for t in texts(4):
        raw = t.encode()
        ids, ends = own.encode(raw)
        at = 0
        for i, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
            want = own.surfaces[ids[i]] if i or not own.surfaces[ids[0]].startswith(b" ") else own.surfaces[ids[0]][1:]
            assert raw[a:b].replace("▁".encode(), b" ") == want
            at = b
        assert at == len(raw)


def test_bytes_that_are_no_text():
    own = sentencepiece_codec.codec(queries.piece_model())
    raw = b"ab\xff\xfe c\xe3\x81"
    ids, ends = own.encode(raw)
    assert own.decode(ids.tolist()) == raw.decode("utf-8", "replace") and ends[-1] == len(raw) and list(ends) == sorted(ends)
