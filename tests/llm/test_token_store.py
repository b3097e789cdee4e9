"""Token files: the library's ids, grammars that expand to what they were made of, ranges, order and odd rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from causeway.llm import token_store
from causeway.llm._common import Tables
from causeway.llm.queries import byte_model, op13_repair_store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(byte_model())


def test_grammars_expand_to_their_ids():
    rng = np.random.default_rng(1)
    cases = [rng.integers(0, a, n).astype(np.uint32) * 7 for n, a in ((0, 5), (1, 5), (2, 1), (3, 1), (7, 1), (10, 2), (1000, 2), (5000, 1), (60_000, 3), (90_000, 70_000))]
    cases.append(np.tile(rng.integers(0, 500, 100), 80).astype(np.uint32))
    cases.append(np.array([1 << 31, (1 << 32) - 1] * 50, np.uint32))
    for ids in cases:
        block = token_store.compress(ids)
        assert (token_store.expand(block) == ids).all()
        for _ in range(30):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2))
            assert (token_store.expand(block, a, b) == ids[a:b]).all()
    assert len(token_store.compress(cases[-2])) < 4 * 8000 / 4


def test_the_encoder_is_the_library(library):
    encode = token_store._encoder(byte_model())
    rnd = random.Random(3)
    alphabet = list("ab '\n\t.,!12²é́  \x1c\x85中\U0001f389'sS  ") + ["<|endoftext|>", " x", " y", "don't"]
    for _ in range(3000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30)))
        assert encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_rows_at_once_are_the_library(library, monkeypatch):
    rnd = random.Random(4)
    alphabet = list("ab '\n\t.,!12²é́  \x1c\x85中\U0001f389'sS  ") + ["<|endoftext|>", " x", " y", "don't", " a", " b", " word"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(30))) for _ in range(3000)] + ["x\n", "y x\n z", None, "", " ", "a", "a b", " a", "a "]
    for cache in (token_store.CACHE, 0):
        monkeypatch.setattr(token_store, "CACHE", cache)
        encoder = token_store._Encoder(byte_model())
        for at in range(0, len(texts), 700):
            some = texts[at : at + 700]
            got = encoder.rows(pa.array(some, pa.string()), 7)
            assert [g.tolist() for g in got] == [[*library.encode(t or "", add_special_tokens=False).ids, 7] for t in some]
    assert encoder.rows(pa.array([], pa.string()), 7) == []


def test_a_batch_looks_each_distinct_piece_up_once():
    class Counted(dict):
        asked = 0

        def __getitem__(self, key):
            Counted.asked += 1
            return super().__getitem__(key)

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    encoder = token_store._Encoder(byte_model())
    encoder.known = Counted()
    encoder.rows(pa.array(["and the one of the others, " * 100 + "end"] * 50, pa.string()), 0)
    assert 0 < Counted.asked < 100


def test_the_query_equals_the_library(spark, library):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op13_repair_store(spark, SF).collect()}
    at = 0
    for doc, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[doc] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_odd_rows_ranges_and_blocks(spark, library, monkeypatch):
    texts = [(5, "five five"), (3, None), (None, "no id"), (4, ""), (9, "word " * 30_000 + "x" * 50_000), (3, "three again"), (8, "\n\n ")]
    rows = [(d, t, "clash", b"x") for d, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, path binary")
    tables = Tables(spark, "test")
    manifest = tables.put(token_store.write(docs, f"{tables.root}/files", byte_model()))
    got = sorted(((r.start, r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in token_store.read(manifest).collect()), key=lambda r: r[0])
    assert [r[1] for r in got] == [None, 3, 3, 4, 5, 8, 9]
    every = [i for r in got for i in r[2]]
    assert [r[0] for r in got] == np.cumsum([0, *(len(r[2]) for r in got)])[:-1].tolist()
    assert sorted(tuple(r[2]) for r in got) == sorted((*library.encode(t or "", add_special_tokens=False).ids, 0) for _, t in texts)
    for a, b in ((0, 1), (3, 40), (10, 20_000), (len(every) - 5, len(every) + 9), (7, 7)):
        assert token_store.read_range(manifest, a, b).tolist() == every[a:b]
    assert token_store.read(tables.put(token_store.write(docs.limit(0), f"{tables.root}/none", byte_model()))).count() == 0


def test_files_of_several_blocks(tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK_IDS", 100)
    rng = np.random.default_rng(2)
    docs = [(None if i == 0 else i, rng.integers(0, 9, n).astype(np.uint32)) for i, n in enumerate([3, 0, 250, 100, 1, 47, 400])]
    file = token_store.Writer(str(tmp_path / "a.repair"))
    for d, ids in docs:
        file.add(d, ids)
    assert file.close() == (tmp_path / "a.repair").stat().st_size
    read = token_store.Reader(str(tmp_path / "a.repair"))
    assert [(d, np.frombuffer(ids, "<u4").tolist()) for d, _, ids in read] == [(d, ids.tolist()) for d, ids in docs]
    every = np.concatenate([ids for _, ids in docs])
    for _ in range(50):
        a, b = sorted(rng.integers(0, len(every) + 1, 2))
        assert (read.range(int(a), int(b)) == every[a:b]).all()
    read.close()
