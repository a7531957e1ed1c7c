import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm.bpe import PATTERN, PairTree, count_tokens, encode_corpus, encoder


@pytest.fixture(scope="module")
def own():
    return encoder("byte_bpe_50k")


@pytest.fixture(scope="module")
def reference(own):
    return tiktoken.Encoding("check", pat_str=PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_tree_root_is_the_smallest():
    r = random.Random(1)
    for n in (1, 2, 3, 17):
        keys = [r.randrange(100) for _ in range(n)]
        tree = PairTree(list(keys), 1 << 60)
        for _ in range(50):
            i = r.randrange(n)
            keys[i] = r.choice([r.randrange(100), 1 << 60])
            tree.put(i, keys[i])
            assert tree.node[1] == min(keys)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_any_text(own, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert own.encode(text) == reference.encode_ordinary(text)
    assert own.count(text) == len(own.encode(text))


def test_long_runs(own, reference):
    r = random.Random(2)
    for text in ("a" * 30_000, " " * 5_000, "".join(r.choice("abcdef0123") for _ in range(40_000)), "日本" * 3_000, "<|endoftext|> x"):
        assert own.encode(text) == reference.encode_ordinary(text)


def test_multilingual_ranks():
    e = encoder("byte_bpe_multi_50k")
    reference = tiktoken.Encoding("multi", pat_str=PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    assert e.encode("नमस्ते, wie geht's?") == reference.encode_ordinary("नमस्ते, wie geht's?")


def test_corpus(spark, reference):
    texts = [None, "", "  \n", "Refund of ₹500 for ORD5713", "Refund of ₹500 for ORD5713", "x" * 20_000]
    df = spark.createDataFrame([(i, t, "extra", [1]) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in encode_corpus(df).collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(df, ["doc_id"]).collect()} == {i: len(x) for i, x in got.items()}
    assert encode_corpus(df.limit(0)).count() == 0
