"""New words with marks behind them are put together from words and marks, with the library's ids."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import AddedToken, Tokenizer

from causeway.llm.token_store import _Encoder

MODEL = public_tokenizers.path("byte_bpe_50k.json")


def test_words_with_marks_are_the_librarys(tmp_path):
    rng = random.Random(3)
    letters = ["a", "b", "Z", "é", "ß", "ö", "ª", "µ", "×", "ÿ", "ɏ", "ɐ", "ж", "漢", "1", "²", "'", "s", "ll", "_", "́", "\n", "\t", "\x00"]
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8))) + "".join(rng.choice(".,!'\"$_|<>-") for _ in range(rng.randrange(4)))
    texts = [" ".join(word() for _ in range(rng.randrange(30))) for _ in range(3000)] + ["a <|endoftext|> b<|endoftext|>, c<| d", "x word' s it's 's' don't. END", ""]
    odd = Tokenizer.from_file(MODEL)
    odd.add_tokens([AddedToken("END"), AddedToken("aZ")])
    odd.save(f"{tmp_path}/odd.json")
    for model, plain in ((MODEL, True), (f"{tmp_path}/odd.json", False)):
        encoder, library = _Encoder(model), Tokenizer.from_file(model)
        assert encoder.plain == plain
        got = encoder.rows(pa.array(texts), 0)
        assert all(np.array_equal(g, [*e.ids, 0]) for g, e in zip(got, library.encode_batch(texts, add_special_tokens=False), strict=True))


def test_a_known_word_is_not_encoded_again_for_its_marks():
    encoder = _Encoder(MODEL)
    encoder.rows(pa.array(["x strange word"]), 0)
    encoder._ids = None
    got = encoder.rows(pa.array(["x strange, word... strange!"]), 0)[0].tolist()
    assert got == [*Tokenizer.from_file(MODEL).encode("x strange, word... strange!", add_special_tokens=False).ids, 0]
