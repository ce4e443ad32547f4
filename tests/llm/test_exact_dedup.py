import hashlib
from collections import defaultdict

import numpy as np
import pytest

from voltsheaf.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def as_rows(df):
    return sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect())


def test_fingerprints_compose():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 256, 5000).astype(np.uint8)
    cut = 1777
    both = X.polynomial(raw, np.array([0, 5000]))[0].tolist()
    a, b = X.polynomial(raw, np.array([0, cut, 5000])).tolist()
    assert both == [(a[k] * pow(X.BASES[k], 5000 - cut, X.MODULUS) + b[k]) % X.MODULUS for k in (0, 1)]
    value = 0
    for x in raw.tolist():
        value = (value * X.BASES[0] + x) % X.MODULUS
    assert value == both[0]


@pytest.mark.parametrize("modulus,piece", [(X.MODULUS, X.PIECE_CHARS), (X.MODULUS, 7), (3, X.PIECE_CHARS), (2, 11)])
def test_small(spark, modulus, piece):
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, None), (5, ""), (6, "ab"), (7, "ba"), (8, "é" * 3000), (9, "é" * 3000), (10, "x" * 50), (11, "x" * 49 + "y"), (12, "\0a"), (13, "a\0")]
    docs = spark.createDataFrame([(*r, 0, "q") for r in rows], "doc_id long, text string, fp1 int, kept string")
    got = X.exact_groups(docs, modulus, piece)
    assert as_rows(got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got.collect())


def test_repeated_rows_and_nulls(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, None)], "doc_id long, text string")
    got = X.exact_groups(docs).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 4
    assert sorted((r.doc_id or 0, r.text or "") for r in X.drop_copies(docs).collect()) == [(0, ""), (0, "c"), (1, "a"), (1, "b")]
    assert X.exact_groups(docs.limit(0)).collect() == []
    assert X.drop_copies(docs.limit(0)).collect() == []


def test_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert as_rows(X.exact_groups(docs)) == brute(rows)
    left = X.drop_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted({b[1] for b in brute(rows)})


def test_rows_keep_their_names_when_planned_anew(spark, sf_small):
    """The files of a table may be split in another way between the call and the read of its result."""
    from voltsheaf.llm.near_dedup import near_groups
    from voltsheaf.llm.suffix_dedup import without_repeats

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    docs = docs.unionByName(docs.withColumn("doc_id", docs.doc_id + 10**6)).repartition(7)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    n_texts = len({t or "" for _, t in rows})
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.minPartitionNum", "spark.sql.files.maxPartitionBytes")}

    def plan(n, size):
        spark.conf.set("spark.sql.files.minPartitionNum", n)
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)

    try:
        found = {}
        for name, f in (("exact", X.exact_groups), ("near", near_groups), ("suffix", without_repeats), ("drop", X.drop_copies)):
            plan("1", "128m")
            df = f(docs)
            plan("40", "4k")
            found[name] = df.collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r.kept for r in found["exact"]) == n_texts == len(found["drop"])
    assert sum(r.kept for r in found["near"]) == len({r.class_id for r in found["near"]}) if "class_id" in found["near"][0] else True
    again = without_repeats(docs).collect()
    key = lambda r: (r.doc_id, r.n_removed, r.kept_sha256)
    assert sorted(map(key, found["suffix"])) == sorted(map(key, again))
