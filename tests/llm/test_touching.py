"""Latin-1 characters beside full stops and commas: ids as the tokenizers library gives them."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keepsake.llm import tokens


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_marks_beside_every_latin_1_character(name):
    own = tokens.encoder(name)
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    every = [chr(i) for i in range(256)]
    texts = [f"x{a}{mark}{b}y" for mark in ".," for a in every for b in every]
    texts += [f"x {mark}{a} y{a}{mark}" for mark in ".," for a in every]
    want = whole.encode_batch_fast(texts, add_special_tokens=False)
    import numpy as np

    for t, got, w in zip(texts, own.batch(texts), want, strict=True):
        assert np.frombuffer(got, "<u2").tolist() == w.ids, (t, w.tokens)
