"""BPE against the public tokenizers library."""

import random

import pytest
from tokenizers import Tokenizer

from stratalens.llm import bpe, queries

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return bpe.WordBpe(PATH)


def same(ours, theirs, texts):
    ids, offsets = ours.encode_batch(texts)
    decoded = ours.decode_batch(ids, offsets)
    for i, t in enumerate(texts):
        want = theirs.encode(t, add_special_tokens=False).ids
        assert ids[offsets[i] : offsets[i + 1]].tolist() == want, ascii(t)
        assert decoded[i] == theirs.decode(want, skip_special_tokens=False), ascii(t)


def test_characters(ours, theirs):
    """All letters up to U+2FFF that both sides' Unicode versions know, alone and doubled in a word."""
    import unicodedata

    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in range(0x3000) if unicodedata.category(chr(c)) not in ("Cn", "Cs") and unicodedata.category(chr(c)) != "Mn" and c not in (0x1C89, 0x1C8A, 0x88F, 0xC5C, 0xCDC)]
    same(ours, theirs, texts)


def test_random_texts(ours, theirs):
    rnd = random.Random(4)
    parts = [*"aaabbethe'strevELmdΣσİ 　\t\x1c\x85é́!!1²\0", "<|endoftext|>", "<|startoftext|>", "<|", "aaaa", "don't", "we've"]
    same(ours, theirs, ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)])


def test_long_and_small(ours, theirs):
    same(ours, theirs, ["", " ", "a", "ab" * 20_000, "the cat " * 5_000, "x" * 999])


def test_forgetting_words_changes_nothing(theirs):
    small = bpe.WordBpe(PATH)
    small.KNOWN = 3
    same(small, theirs, ["one two three four", "five six", "seven eight nine ten eleven", "one two"])


def test_leftmost_merges_without_monotone_lists(theirs):
    slow = bpe.WordBpe(PATH)
    assert slow.monotone
    slow.monotone = False
    same(slow, theirs, ["banana bandana aaaaaaa mississippi abababab"])


def test_frame(spark, theirs):
    rows = [(1, "Hello hello", "x"), (None, None, "y"), (1, "Hello hello", "z"), (2, "", "")]
    got = bpe.bpe_encode(spark.createDataFrame(rows, "doc_id long, text string, ids string"), PATH).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in got) == [(0, 0, ""), (1, 2, "hello</w> hello</w>"), (1, 2, "hello</w> hello</w>"), (2, 0, "")]
    assert bpe.bpe_encode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_query(spark, smallest, theirs):
    import hashlib

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{smallest}/documents.parquet").collect()}
    for r in queries.op1_bpe(spark, smallest).collect():
        ids = theirs.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()
