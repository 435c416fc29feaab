"""Batch tokens equal the tokenizer's, text by text; hashes follow the bytes alone."""

import random

import numpy as np
import public_tokenizers
import pytest
from blendscope.llm.textvec import Encoder, Texts, chunks

ALPHABET = ["a", " ", "  ", "\n", "\t", "é", "'s", "1", "%%", "　", "ß", "日", "́", "\x0b", "\x85", "\U0001f600", "Σ", ",", "A"]


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_ids_equal_the_tokenizer(name, spaced):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", " a", "a ", "x   y", "<|endoftext|> z", "don't  stop,now"]
    encoder = Encoder(public_tokenizers.path(name), spaced)
    for _ in range(2):  # with and without known words
        ids, counts = encoder.encode(texts)
        want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        parts = np.split(ids, np.cumsum(counts)[:-1])
        assert [p.tolist() for p in parts] == want


def test_forgetting_words_changes_no_ids(monkeypatch):
    monkeypatch.setattr("blendscope.llm.textvec.KEPT_WORDS", 5)
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    texts = ["one two three four", "five six seven eight nine ten eleven", "one two"]
    for text in texts * 2:
        assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_hashes_follow_bytes():
    texts = Texts(["same word same", "word", None])
    starts, ends = texts.words()
    h = texts.hashes(starts, ends)
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    assert texts.owner(starts).tolist() == [0, 0, 0, 1]


def test_chunks_cover_all_rows():
    texts = ["a" * 10, None, "b" * 30, "", "c"]
    assert [t for _, part in chunks(texts, 12) for t in part] == texts
    assert [first for first, _ in chunks(texts, 12)] == [0, 3]
