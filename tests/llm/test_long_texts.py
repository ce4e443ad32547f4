"""Very long texts, null ids, repeated rows and extra columns with clashing names, for each operator and the pipeline."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_near_dedup import bag, jaccard
from voltsheaf.llm import bpe, exact_dedup, fingerprints, langid, near_dedup, packing, secrets, suffix_dedup

CLASHES = ("row", "node", "sha", "band", "k", "kept", "start", "run", "place", "cls", "sig", "bands", "target", "gram", "found", "ids", "task", "best", "n", "doc", "text_sha256", "row_", "a", "b")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    long = [rng.choice(words) for _ in range(200_000)]  # some 1.2 MB
    near = list(long)
    for i in range(0, len(near), 400):  # a change for each 400 words: likeness 0.975
        near[i] = "changed"
    short = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(3)]
    secret = " password=abcdefgh12345"
    return [(1, " ".join(long)), (2, " ".join(near) + secret), (3, " ".join(long)), (4, short[0]), (4, short[0]), (5, short[1]), (None, short[2]), (None, short[2]), (6, None), (7, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return df.withColumns({c: F.lit("x") for c in CLASHES}).withColumns({"lang": F.lit("xx"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})


def test_secrets(docs, rows):
    got = [(r.doc_id, r.n_assign) for r in secrets.scan(docs).collect()]
    assert len(got) == len(rows) and [r for r in got if r[1]] == [(2, 1)]


def test_bpe_and_packing(docs, rows):
    assert bpe.encode_and_decode(docs).count() == len(rows)
    pieces = packing.pack(docs).collect()
    assert sum(r.length for r in pieces) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens * (2 if r.doc_id in (4, None) else 1) for r in pieces}.values())


def test_exact_dedup(docs):
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs).collect()}
    assert got[1].keep_id == 3 and got[1].group_size == 2 and got[2].group_size == 1 and got[6].keep_id == 7
    pieces = {(r.doc_id, r.fp1, r.fp2) for r in exact_dedup.fingerprints(docs, piece_chars=1000).collect()}
    assert pieces == {(r.doc_id, r.fp1, r.fp2) for r in exact_dedup.fingerprints(docs).collect()}


def test_language_id(docs, rows):
    got = langid.identify(docs).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got if r.doc_id in (6, 7)} == {"und"} and {r.lang_pred for r in got if r.doc_id in (1, 2, 4)} == {"xx"}


def test_fingerprints(docs, rows):
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect() if r.doc_id in (1, 2, 3)}
    assert got[1].fingerprint == got[3].fingerprint
    want = jaccard(bag(rows[2][1]), bag(rows[1][1]))
    assert abs(got[3].near_next - want) < 0.1 and abs(got[1].near_edited - 2 / 3) < 0.15  # the next text is short


def test_suffixes(docs, rows):
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[1].n_removed == got[1].n_bytes and got[5].n_removed == 0 and 0.99 < got[2].n_removed / got[2].n_bytes < 1


def test_near_dedup(docs, rows):
    got = near_dedup.near_groups(docs).collect()
    classes = {r.doc_id: (r.class_id, r.group_size) for r in got}
    assert len(got) == len(rows) and classes[1] == classes[2] == classes[3] == (1, 3) and classes[4] == (4, 2) and classes[5] == (5, 1) and classes[None] == (None, 2) and classes[7] == (6, 2)
    assert sum(r.kept for r in got) == 5


def test_pipeline_stages(spark, docs):
    state = docs
    for name, stage in P.STAGES[:-1]:
        state = stage(spark, state, "")
        assert state.columns == docs.columns, name
    kept = state.select("doc_id", "text", "sha").collect()
    assert sorted((r.doc_id or 0) for r in kept) in ([0, 2, 4, 5], [0, 3, 4, 5]) and {r.sha for r in kept} == {"x"}
    assert P.STAGES[-1][1](spark, state, "").count() > 0
