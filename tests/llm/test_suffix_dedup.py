import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from voltsheaf.llm import suffix_dedup as X


def brute(rows, length=X.LENGTH):
    raws = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if count[r[k : k + length]] > 1:
                gone[k : k + length] = True
        edge = np.diff(np.r_[0, gone.astype(int), 0])
        kept = bytes(np.frombuffer(r, np.uint8)[~gone])
        out.append((i, len(r), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_merge_is_sorted_with_common_prefixes():
    rng = random.Random(1)
    for _ in range(50):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 7))]
        coded = [X.front_coded(r) for r in runs]
        assert [X.decoded(*c) for c in coded] == runs
        out = [(runs[k][i], lcp) for k, i, lcp in X.merged(runs, [c[0] for c in coded])]
        assert [s for s, _ in out] == sorted(s for r in runs for s in r)
        for (a, _), (b, lcp) in zip(out, out[1:]):
            assert lcp == X.common(a, b, 0)


@pytest.mark.parametrize("hot", [X.HOT, 3])
def test_small(spark, hot):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 7)))
    shared = [" ".join(word() for _ in range(k)) for k in (40, 60, 90, 150)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 6)):
            s = rng.choice(shared)
            cut = rng.randint(0, len(s) // 2)
            parts.append(rng.choice([s, s[cut:], s[: len(s) - cut], " ".join(word() for _ in range(60)), "x" * 150]))
        rows.append((i, " ".join(parts)))
    rows += [(100, None), (101, ""), (102, "z" * 700), (103, rows[0][1]), (104, "q" * 200), (105, "q" * 200), (106, "w" * 199), (107, "w" * 199), (None, rows[3][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int").repartition(5)
    assert got(X.without_repeats(docs, hot)) == brute(rows)


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(X, "SEGMENT", 700)
    rng = random.Random(9)
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(2))
    rows = [(1, a), (2, b[:1000] + a[500:2600] + b[1000:]), (3, a[2900:] + b[2000:])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(X.without_repeats(docs)) == brute(rows)
    assert X.without_repeats(docs.limit(0)).collect() == []
    kept = {r.doc_id: r.kept for r in X.without_repeats(docs, keep_text=True).collect()}
    assert all(hashlib.sha256(kept[r[0]]).hexdigest() == r[4] for r in brute(rows))


def test_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert got(X.without_repeats(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
