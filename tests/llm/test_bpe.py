import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from voltsheaf.llm import bpe


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def odd_texts():
    rng = random.Random(3)
    letters = "abcXYZ éèß'’ 0123 \n\t.,!?-_<|>Σς İ日本語한글́\x1c\x85 🙂ﬁ"
    yield from ["", " ", "don't we'll I'M o'clock's", "<|endoftext|>a<|startoftext|>", "<|end", "Á é", "ΑΣ ΣΑΣ", "x" * 3000, "ab12" * 700, "a\x1cb"]
    for _ in range(300):
        yield "".join(rng.choice(letters) for _ in range(rng.randint(1, 120)))


def test_matches_the_library(theirs):
    coder = bpe.word_end_coder("word_bpe_49k.json")
    texts = list(odd_texts())
    for text, got in zip(texts, coder.encode(texts)):
        want = theirs.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want, text
        assert coder.decode(got).decode() == theirs.decode(want, skip_special_tokens=False)


def test_documents(spark, sf_small, theirs):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    texts = dict(docs.select("doc_id", "text").collect())
    got = bpe.encode_and_decode(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_null_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (None, "", 6), (1, "the", 7), (1, "the", 7)], "doc_id long, text string, ids long")
    rows = bpe.encode_and_decode(docs, keep_ids=True).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 1, 1]
    assert bpe.encode_and_decode(docs.limit(0)).collect() == []


def test_words_around_the_long_word_bound(theirs):
    rng = random.Random(9)
    coder = bpe.word_end_coder("word_bpe_49k.json")
    texts = ["".join(rng.choice("etaoinsrhld") for _ in range(n)) for n in (bpe.LONG_WORD - 1, bpe.LONG_WORD, bpe.LONG_WORD + 1, 5 * bpe.LONG_WORD)]
    for text, got in zip(texts, coder.encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_only_short_chunks_are_kept():
    coder = bpe.word_end_coder("word_bpe_49k.json")
    coder.encode(["short " + "q" * 500])
    assert "short" in coder.known and max(map(len, coder.known)) <= bpe.CACHE_CHARS
