import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from tests.llm.test_near_dedup import classes
from tests.llm.test_secrets import brute as base_spans
from voltsheaf.llm import langid


def test_stages_against_brute_force(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    junk = spark.createDataFrame([(10**6, "### 12 34 !!", None, "src", 12), (10**6 + 1, None, None, "src", 0)], docs.schema)
    docs = docs.unionByName(junk)
    state, rows = docs, None
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in state.collect()}
        stage(spark, state, sf_small).write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert after.columns == docs.columns
            rows = {r.doc_id: r for r in after.collect()}
        if name == "language_id":
            lettered = {i for i, r in before.items() if any(c.isalpha() for c in r.text or "")}
            assert set(rows) <= lettered and len(rows) >= 0.97 * len(lettered)
            assert all(rows[i] == before[i] for i in rows)
        elif name == "exact_dedup":
            last = {}
            for i in sorted(before):
                last[before[i].text] = i
            assert set(rows) == set(last.values())
        elif name == "near_dedup":
            assert set(rows) == {c[0] for c in classes([(i, r.text) for i, r in before.items()])}
        elif name == "secret_scan":
            assert set(rows) == set(before)
            for i, r in before.items():
                if base_spans(r.text):
                    assert "[secret]" in rows[i].text and not base_spans(rows[i].text) and rows[i].n_chars == len(rows[i].text)
        state = after
    theirs = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in state.collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(rows)
    for i, r in rows.items():
        ids = theirs.encode(r.text, add_special_tokens=False).ids + [1]
        for p in pieces[i]:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
        assert sum(p.length for p in pieces[i]) == len(ids)


def test_run_and_empty_tables(spark, sf_small, tmp_path):
    assert P.run(spark, sf_small).count() > 0
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf_small) if docs.columns[0] == "doc_id" else docs
    assert docs.collect() == []
