import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voltsheaf.llm import packing as P


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def verify(rows, texts, theirs, window=P.WINDOW):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for doc_id, text in texts.items():
        ids = theirs.encode(text or "", add_special_tokens=False).ids + [1]
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: no padding at all


def test_coder_matches_the_library(theirs):
    rng = random.Random(5)
    letters = "abcXYZ éß'’ 0123  \n\t.,!?-_<|>Σ日本語한\x1c\x85\xa0🙂"
    texts = ["", " ", "  ", "a  b", "a \n b\n \nc", "<|endoftext|>", "don't we'll", " a", "a ", "\n ", "x" * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(400)]
    for text, got in zip(texts, P.byte_coder("byte_bpe_50k.json").encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_encoded_once(monkeypatch):
    coder = P.ByteCoder(public_tokenizers.path("byte_bpe_50k.json"))
    seen, encode = [], coder.bpe.encode
    monkeypatch.setattr(coder.bpe, "encode", lambda words: seen.extend(words) or encode(words))
    names = ["Anna", "Boris", "Clara", "Dmitri", "Élise"]
    for a in names:  # the words meet in ever new chunks between spaces
        coder.encode([f"x {a}.\n{b}!{a} {b}" for b in names])
    assert len(seen) == len(set(seen)) and b"Anna" in seen and " Élise".encode() in seen


@pytest.mark.parametrize("block, kept", [(1 << 22, 0), (7, 1_000_000), (13, 40)])
def test_cut_texts_and_full_cache(theirs, monkeypatch, block, kept):
    monkeypatch.setattr(P, "BLOCK_CHARS", block, raising=False)
    monkeypatch.setattr(P, "KEPT_WORDS", kept, raising=False)
    rng = random.Random(block + kept)
    parts = [" ", " ", "\n", "\t ", "'", "'s", "'re", "'ll", "'S", "s", "word", "été", "日本", "١٢", "Ⅷ", "²", "!?", "\x1c", "\u3000", "\u0301", "🙂", "<|", "|>", "<|endoftext|>", "<|endof", "text|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    coder = P.ByteCoder(public_tokenizers.path("byte_bpe_50k.json"))
    for _ in range(2):  # the second time with what is kept of the first
        for text, got in zip(texts, coder.encode(texts)):
            assert np.frombuffer(got, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids, repr(text)


def test_documents(spark, sf_small, theirs):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").repartition(5)
    verify(P.pack(docs).collect(), dict(docs.select("doc_id", "text").collect()), theirs)


def test_merge_rounds(spark, theirs, monkeypatch):
    monkeypatch.setattr(P, "MERGE", 2)
    texts = {i: "word " * (i * 7 % 40) for i in range(60)} | {60: None, 61: ""}
    docs = spark.createDataFrame([(k, v, 1) for k, v in texts.items()], "doc_id long, text string, start int").repartition(7)
    verify(P.pack(docs, window=64, open_windows=3).collect(), texts, theirs, 64)
    assert P.pack(docs.limit(0)).collect() == []
