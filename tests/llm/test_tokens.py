"""Words that the tokenizer takes whole, and what it remembers of them."""

from __future__ import annotations

import random

from panelcraft.llm import bpe


def test_letters_and_signs_equal_library():
    """Chunks of letters alone skip the pattern; ids, pieces and decimal text stay those of the library."""
    from tokenizers import Tokenizer

    path = bpe.vocabulary_path()
    library, rng = Tokenizer.from_file(path), random.Random(9)
    letters = "aetsdlmvrÄßüéçİΣσſªᵃʰﬁǅẞ中ไक가ʼnıK"
    signs = "'.,!1²①़́͏​𝔸😀"
    texts = ["İ", "ΑΣ", "'S", "l'été", "THE", "ǅ Ǆ", "K Å", "a\x1cb c", "<|endoftext|>abc<|startoftext|>"]
    texts += [" ".join("".join(rng.choice(letters if rng.random() < 0.9 else signs) for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    own = bpe.BpeTokenizer(bpe.BpeVocabulary(path))
    assert own.v.letters_stay_whole
    for _ in range(2):  # new, then remembered
        for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
            ids = own.ids(text)
            assert ids == want.ids and own.decimal(ids) == " ".join(map(str, want.ids))
            assert own.decode(ids).decode("utf-8", "replace") == library.decode(want.ids, skip_special_tokens=False)
    own.v.letters_stay_whole = False
    own.clear()
    assert all(own.ids(t) == e.ids for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True))
    assert own.ids(None) == [] and own.decode([]) == b"" and own.decimal([]) == ""
    assert all(type(v) is bytes for v in (*own.values(), *own.encoder.cache.values()))  # four bytes an id, no second form
