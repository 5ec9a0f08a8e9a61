"""Exact agreement with two independent encoders, round trips, dirty rows."""

import base64
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.llm import bpe

PATH = f"{bpe.FOLDER}/{bpe.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary(PATH))


@pytest.fixture(scope="module")
def judge():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(encoder):
    h, keys = encoder.hashed, encoder.vocabulary
    assert sorted(h.slots) == list(range(len(keys)))
    assert all(h.index(k) == i for i, k in enumerate(keys))
    small = bpe.PerfectHash([b"a"])
    assert small.index(b"a") == 0 and small.index(b"zzz") == 0


def test_documents(spark, data, encoder, judge):
    df = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}
    texts = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    assert got == {k: judge.encode_ordinary(t) if t else [] for k, t in texts.items()}
    for k, t in texts.items():
        assert b"".join(encoder.vocabulary[i] for i in got[k]).decode() == (t or "")


def test_other_library(encoder):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for s in ("Hello  world's\n\n x", "<|endoftext|> ok", "naïve ﷽ 𝔘 犬が12½", "a　b​c", "I'LL we'll"):
        assert encoder.encode(s) == t.encode(s, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeiou 's\t\n\r\x1c\x85\xa0　'lrd12½")), max_size=40))
def test_any_text(encoder, judge, text):
    assert encoder.encode(text) == judge.encode_ordinary(text)


def test_long_texts(encoder, judge, monkeypatch):
    rng = random.Random(1)
    word = "".join(rng.choice("abc") for _ in range(30_000))
    assert encoder.encode(word) == judge.encode_ordinary(word)
    text = " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    want = judge.encode_ordinary(text)
    monkeypatch.setattr(bpe, "GROUP", 100)  # in groups, with the kept pre-tokens dropped now and then
    monkeypatch.setattr(bpe, "KEPT", 50)
    assert encoder.encode(text) == want


def test_dirty_rows(spark):
    rows = [(1, None), (2, ""), (3, "hi"), (3, "hi"), (None, "hi"), (4, " "), (5, "x" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text as ids", "1 as tokens")
    got = [(r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df).collect()]
    assert len(got) == 7 and got.count((3, [5303])) == 2 and (None, [5303]) in got
    assert (1, []) in got and (2, []) in got and (4, [220]) in got
    assert bpe.encode_corpus(df.limit(0)).count() == 0
