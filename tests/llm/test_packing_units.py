"""Token ids by units are those of the tokenizer, and units that came before are not encoded again."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sparkloom.llm import packing

WORD = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    *"aBzZéÉÿßÀ×÷Øøªºµ0123456789.,;:!?-_|%$&*()[]{}/\\\"#@~^`+=<>'",
    *" \n\t\r\x0b\x0c\x00\x1c\x1f\x7f\x85\xa0 　​﻿",
    *("́", "̧", "İ", "Σ", "ς", "語", "한", "가", "Ω", "ﬁ", "²", "½", "٣", "🙂", "é".encode().decode(), "é"),
    *("'s", "'S", "'re", "don't", "word", "The", "the.", "Señor", "ciónas,", "%%%", "</w>", "w>", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b", "x" * 200),
]


def coder():
    with open(WORD, encoding="utf-8") as f:
        return packing.WordIds(f.read())


def test_ids_are_those_of_whole_texts():
    rng, tokenizer, made = random.Random(7), Tokenizer.from_file(WORD), coder()
    texts = ["", " ", "\n\t", *PARTS, *("".join(rng.choices(PARTS, k=rng.randrange(1, 40))) for _ in range(3000))]
    for a in range(0, len(texts), 500):
        some = texts[a : a + 500]
        want = [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]
        got = [np.frombuffer(b, "<u4").tolist() for b in made.encode(some)]
        assert [(t, g) for t, g in zip(some, got, strict=True)] == [(t, w) for t, w in zip(some, want, strict=True)]


def test_a_full_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(packing, "KEEP", 10)
    rng, tokenizer, made = random.Random(3), Tokenizer.from_file(WORD), coder()
    for _ in range(30):
        some = [" ".join(rng.choices(PARTS, k=12)) for _ in range(4)]
        assert [np.frombuffer(b, "<u4").tolist() for b in made.encode(some)] == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]
        assert len(made.names) <= 15


class Counting:
    def __init__(self, inner):
        self.__dict__.update(inner=inner, sent=0)

    def __getattr__(self, name):
        return getattr(self.inner, name)

    def __setattr__(self, name, value):
        setattr(self.inner, name, value)

    def encode_batch_fast(self, texts, **options):
        self.__dict__["sent"] += sum(len(t.split()) for t in texts)
        return self.inner.encode_batch_fast(texts, **options)


def test_units_of_earlier_blocks_are_not_encoded_again():
    made, rng = coder(), random.Random(5)
    made.tokenizer = Counting(made.tokenizer)
    words = sorted({"".join(rng.choices("abcdefghij", k=9)) for _ in range(90_000)})
    blocks = [words[a::3] for a in range(3)]
    for block in (*blocks, [w.capitalize() + "." for w in blocks[0]], [f"({w}%%%" for w in blocks[1]]):
        made.encode([" ".join(block)])
    assert made.tokenizer.sent <= len(words) + 3
