"""Token ids from chunks cut in columns, against the tokenizer on whole texts."""

import random

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from palimpsest.llm import packing
from palimpsest.llm.queries import tokenizer_path

#: Letters that compose, case that does not come back, contractions, added tokens, white
#: space of all kinds, digits and signs of other scripts.
SIGNS = [
    *"aAhHtTiIsSkKwW0129.,;:!?'\"-_<>|=&#$%()*/~^`+ÀÉÜßÿ×÷ÞðŁžΣσςİıſ中文カが½٣क한ǅ“”…—😀",
    *[" "] * 12, *"\n\n\t\r\x0b\x0c\x00\x1c\x85\xa0\xad 　​﻿",
    *["̀", "́", "̇", "̈", "̊", "̌", "̱", "̸", "K", "ᄀ", "ᅡ", "ﬁ"],
    *["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'T", "'ll", "'RE", "the", "The", "über", "ÜBER", "don't"],
]


def test_odd_characters_tokenize_like_whole_texts():
    rng = random.Random(5)
    texts = ["H̱ ẖ W̊.", "É́t", "<|endoftext|>Ab<|ENDOFTEXT|>", "3.5'5''s!'s", "\xc3", "≠≮"]
    for _ in range(3000):
        texts.append("".join(rng.choices(rng.sample(SIGNS, rng.randrange(2, len(SIGNS))), k=rng.choice([1, 2, 4, 9, 40]))))
    tokenizer = Tokenizer.from_file(tokenizer_path())
    whole = [np.array([*e.ids, 0], "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    words, few = packing.WordIds(tokenizer_path()), packing.WordIds(tokenizer_path(), 30)
    assert words.of(texts) == whole
    assert [ids for i in range(0, len(texts), 100) for ids in few.of(texts[i : i + 100])] == whole
    part = pa.array(["before", *texts, None, "behind"]).slice(1, len(texts) + 1)
    assert words.of(part) == [*whole, bytes(4)]


def test_forms_of_a_word_are_encoded_once():
    words = packing.WordIds(tokenizer_path())
    words.of(["Zug zug. ZUG, zug\n", "Über über;zug! ÜBER"])
    assert set(words.known) - {""} == {"zug", "über", ".", ",", ";", "!"}


def test_a_full_table_keeps_what_is_in_use():
    words = packing.WordIds(tokenizer_path(), 4)
    words.of(["one two three"])
    words.of(["two four five six"])
    assert set(words.known) - {""} == {"two", "four", "five", "six"}
    assert packing.WordIds(tokenizer_path()).of([]) == []
