"""Token counts and packing against the library and the packing's own rules."""

import zlib
from math import ceil

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from convolens.llm import packing, token_counts
from convolens.llm.tokens import ByteCounter, WordIds, vocabulary

BYTES, WORDS = vocabulary("byte_bpe_50k.json"), vocabulary("word_bpe_49k.json")
TEXTS = [
    None, "", " ", "a  b\n\n c<|endoftext|> x 　y  ", "naïve ΑΣ İx 12.5 don't  ",
    "<|startoftext|>hi", " lead\ttab\x1cq\x85r", "it's 'Round 'll x's", "été \U0001f600\U0001f600", "x" * 3000,
    "word " * 4000, "\n\n  \n" * 50, "A b c", " ok", "12345 67", "Straße GÜN ǅ",
]


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_memories_equal_the_library(libraries):
    counter, words = ByteCounter(BYTES), WordIds(WORDS)
    for text in TEXTS * 2:
        assert counter.count(text or "") == len(ids(libraries[0], text))
        assert words.ids(text or "") == np.array(ids(libraries[1], text), dtype="<u4").tobytes()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t'.aAbs1<|>")), max_size=40))
def test_memories_equal_the_library_on_any_text(text):
    byte, word = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    assert ByteCounter(BYTES).count(text) == len(ids(byte, text))
    assert WordIds(WORDS).ids(text) == np.array(ids(word, text), dtype="<u4").tobytes()


def test_counts_of_spliced_documents(spark, libraries):
    rng = np.random.default_rng(1)
    mixed = "".join(rng.choice(["the ", "don't", " ", "\n", "xé", "12", "<|endoftext|>", "'", "re"], 4000))
    texts = TEXTS + [mixed, mixed, "z" * 20_000, mixed + "q" * 9000 + mixed]
    df = spark.createDataFrame(
        [(i if i else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string, _tag int"
    )
    got = token_counts.count_tokens(df, BYTES, chunk=512, overlap=64).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id or 0] or ""
        n = len(ids(libraries[0], text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 1024)
    assert token_counts.count_tokens(df.limit(0), BYTES).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_packing(spark, libraries):
    texts = TEXTS + TEXTS
    df = spark.createDataFrame([(i % 20, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    rows = packing.pack_documents(df, WORDS, capacity=64).collect()
    n = check_packing(rows, 64)
    want = []
    for i, t in enumerate(texts):
        whole = [*ids(libraries[1], t), 1]
        for piece, at in enumerate(range(0, len(whole), 64)):
            part = whole[at : at + 64]
            want.append((i % 20, piece, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    assert n <= 1.05 * ceil(sum(w[3] for w in want) / 64) + 1
    assert packing.pack_documents(df.limit(0), WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=120), st.integers(1, 9))
def test_plans_hold_every_rank_once(lengths, groups):
    values, counts = np.unique(np.array(lengths, dtype=np.int64), return_counts=True)
    plan = packing.Plan(values[::-1], counts[::-1], 50, groups, 8)
    order = np.sort(np.array(lengths, dtype=np.int64))[::-1]
    at = plan.sequence(np.arange(len(order))) if lengths else np.array([], dtype=np.int64)
    used = np.bincount(at, weights=order, minlength=plan.sequences) if lengths else np.zeros(0)
    assert len(used) == plan.sequences and (used <= 50).all() and (used > 0).all()


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(2)
    lengths = np.clip(rng.lognormal(6.5, 1.0, 20_000).astype(np.int64), 1, 4096)
    values, counts = np.unique(lengths, return_counts=True)
    plan = packing.Plan(values[::-1], counts[::-1], 4096, packing.GROUPS, packing.SMALL)
    assert plan.sequences <= 1.005 * ceil(lengths.sum() / 4096)
