"""Token counts against the vocabulary's own library."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

from firespark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a", "a" * 999, "aaab" * 40, "Hello, world! It's 12345 o'clock's", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>",
    " \t\n x  \r\n\x1c\x85 y", "émigré naïve 漢字かな交じり文 🙂🙂👩‍👩‍👧", "​﻿|endoftext|", "don't we'LL I'm you're" * 5,
]


def test_counts_equal_the_library(make_docs):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("abcé \n12'<|>大") for _ in range(rng.randrange(300))) for _ in range(200)]
    expected = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    rows = list(enumerate(texts)) + [(-1, None), (-1, None), (None, "null id")]
    got = tokens.token_counts(make_docs(rows).withColumnRenamed("lang", "n_tokens"), PATH, limit=50).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.id is None or r.id < 0:
            assert (r.n_bytes, r.n_tokens) == ((0, 0) if r.id == -1 else (7, len(library.encode("null id").ids)))
        else:
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.id].encode()), expected[r.id], expected[r.id] > 50)


def test_long_piece_and_forgotten_memory():
    library = Tokenizer.from_file(PATH)
    counter = tokens.Counter(tokens.load_merges(PATH), remembered=10)
    texts = ["".join(random.Random(i).choice("abcdefgh") for _ in range(5000)) for i in range(4)]
    for _ in range(2):
        assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_empty_table(make_docs):
    assert tokens.token_counts(make_docs([]), PATH).count() == 0
