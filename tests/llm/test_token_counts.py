from __future__ import annotations

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.helpers import MIDDLE, ODD, clashing, documents, empty, odd
from veilscan.llm import registry, token_counts

PATH = registry.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PATH)


def count(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, counter, text):
    assert counter.count(text) == count(library, text)


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab e' \n\t12é,.!'sx<|endoftext|>ß\u00a0"), max_size=40))
def test_every_prefix(library, counter, text):
    assert counter.prefix_counts(text) == [count(library, text[:i]) for i in range(len(text) + 1)]


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("abcde fgh ' \n12é,."), max_size=60), st.integers(0, 25))
def test_truncation(library, counter, text, limit):
    end = counter.truncation(text, limit)
    assert count(library, text[:end]) <= limit
    assert end == max(i for i in range(len(text) + 1) if count(library, text[:i]) <= limit)


def test_special_strings_and_odd_texts(library, counter):
    texts = [t for _, t, *_ in ODD] + ["<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endo", " " * 50 + "x", "\n\n  x", "don't we'll 'S", "x" * 3000, "日本語テキスト", "e\u0301"]
    assert counter.count_all(texts) == [count(library, t) for t in texts]
    assert counter.count_all(texts, characters=1) == counter.count_all(texts)


def test_bounds_change_nothing(library):
    small = token_counts.PrefixCounter(PATH)
    small.MAX_WORDS, small.MAX_PAIRS = 10, 10
    rng = random.Random(4)
    texts = [" ".join("".join(rng.choices("etaoinshr", k=rng.randrange(1, 12))) for _ in range(30)) for _ in range(40)]
    assert small.count_all(texts, 500) == [count(library, t) for t in texts]


def test_query_equals_library(spark, library):
    texts = {r["doc_id"]: r["text"] for r in documents(spark, MIDDLE).collect()}
    rows = registry.op6_token_counts(spark, MIDDLE).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = count(library, texts[r["doc_id"]])
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 1024)


def test_odd_rows(spark, library):
    rows = token_counts.count_tokens(clashing(odd(spark)), PATH).collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows) == sorted((i or 0, count(library, t)) for i, t, *_ in ODD)
    assert token_counts.count_tokens(empty(spark), PATH).count() == 0
    tables = {r["doc_id"]: r["counts"] for r in token_counts.prefix_tables(odd(spark).where("doc_id in (1, 5)"), PATH).collect()}
    assert tables[1] == [0] and tables[5][-1] == count(library, ODD[4][1])


def test_prefixes_of_long_white_space_and_of_special_strings(library, counter):
    """White space costs no more than other text; a special string that is cut short belongs to what it follows."""
    for text in ("!<|endoftext|>x", "a <|endoftext|><|endoftext|>", "it's<|endoftext|> !<|endoftext|>", "  \n<|endoftext|>", "<|endoftext|>", "one two three<|endoftext|>< four"):
        truth = [count(library, text[:i]) for i in range(len(text) + 1)]
        assert counter.prefix_counts(text) == truth
        for limit in range(8):
            assert counter.truncation(text, limit) == max(i for i, n in enumerate(truth) if n <= limit)
    text = "one" + " " * 30_000 + "two\n" + "\n\t " * 10_000 + "don't" + " " * 5
    began = time.perf_counter()
    counts = counter.prefix_counts(text)
    assert time.perf_counter() - began < 20 and len(counts) == len(text) + 1
    for i in [0, 1, 3, 4, 5, 100, 30_002, 30_003, 30_004, 30_006, 30_007, 45_001, 60_007, 60_008, 60_011, len(text) - 3, len(text)]:
        assert counts[i] == count(library, text[:i]), i
    for limit in (1, 2, 50, counts[-1] - 1, counts[-1]):
        assert counter.truncation(text, limit) == max(i for i, n in enumerate(counts) if n <= limit)
