"""The encoder against the tokenizers library on random whole texts, and the packing against its own decoder."""

import random

import numpy as np
import pytest

from attestor.llm import simple8b

PIECES = [
    "a", "the", "Hello", "world", "don't", "it's", "x'", "'s", "'", "-", "--", "...", ".", ",", "1", "23", "4.5", "é", "Éoi", "ß", "日本", "😀", " ", "  ", "\n", "\n\n", " \n", "\t", "\r\n", " ", "　",
    "\0", "\1", "_", "(a)", "[b]", "<|endoftext|>", "a_b", "e-mail@x.org", "ǅ", "ʰ", "é", "​", "²", "½", "Ⅷ", "’", "“q”",
]


def test_encoder_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library, rng = simple8b.Encoder(path), Tokenizer.from_file(path), random.Random(5)
    library.encode_special_tokens = True
    texts = ["".join(rng.choice(PIECES) + (" " if rng.random() < 0.5 else "") for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    texts += ["", " ", "\n", " a", "a ", "\na", "a\n", "a\n b", "a \nb", "a\n\nb"]
    for at in range(0, len(texts), 256):
        own = texts[at : at + 256]
        for text, got, want in zip(own, encoder.encode(own), library.encode_batch_fast(own, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, text


@pytest.mark.parametrize("most", [2, 50, 5000, 60_000, 2**40])
def test_words_decode_to_their_ids(most):
    rng = np.random.default_rng(most)
    for n in (0, 1, 7, 1023, 1024, 1025, 5000):
        ids = rng.integers(0, most, n).astype(np.uint64)
        ids[rng.random(n) < 0.01] = np.uint64(2**63)
        words, blocks = simple8b.encode(ids)
        assert (simple8b.decode(words, n) == ids).all() and len(blocks) == -(-n // simple8b.BLOCK)
