"""Merging many words at once gives what merging one at a time gives."""

import random

import public_tokenizers

from emberkeep.llm.lexicon_bpe import WordBpe


def test_words_merge_together_as_alone():
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        bpe = WordBpe(f.read())
    rng = random.Random(6)
    letters = "etaoinshrdlu.,'é漢😀"
    words = ["".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 9, 20, 47, 60]))).encode() for _ in range(3_000)]
    words += [b"a", b"", b"aaaaaaaaaaaaaaaa", b"ababababab", "the".encode(), bytes([255, 254])]
    got = bpe.merge_all(words)
    for word, ids in zip(words, got):
        assert list(memoryview(ids).cast("I")) == (bpe.merge(word) if word else [])
    assert bpe.merge_all([]) == []
