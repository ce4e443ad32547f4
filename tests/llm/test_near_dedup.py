import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from voltsheaf.llm import near_dedup as X


def bag(t):
    w = (t or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(p, q):
    return sum((p & q).values()) / max(1, sum((p | q).values()))


def classes(rows):
    """Connected components by brute force over all pairs that share a shingle."""
    bags = [bag(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    at, same = defaultdict(list), {}
    for i, (_, t) in enumerate(rows):
        if (t or "") in same:
            parent[find(i)] = find(same[t or ""])
        same.setdefault(t or "", i)
        for g in bags[i]:
            at[g].append(i)
    for i, j in {(i, j) for k in at.values() for i in k for j in k if i < j}:
        if find(i) != find(j) and jaccard(bags[i], bags[j]) >= X.THRESHOLD:
            parent[find(i)] = find(j)
    out = defaultdict(list)
    for i, (k, _) in enumerate(rows):
        out[find(i)].append(k)
    return sorted(sorted(v) for v in out.values())


def got_classes(df):
    out = defaultdict(list)
    rows = df.collect()
    for r in rows:
        out[r.class_id].append(r.doc_id)
    for r in rows:
        assert r.class_id == min(out[r.class_id]) and r.group_size == len(out[r.class_id]) and r.kept == (r.doc_id == r.class_id)
    return sorted(sorted(v) for v in out.values())


def test_collision_rate_is_weighted_jaccard():
    rng = np.random.default_rng(6)
    errors = []
    for k in range(40):
        words = [f"w{x}" for x in rng.integers(0, 500, 60)]
        a = words * int(rng.integers(1, 8))
        b = words * int(rng.integers(1, 8)) + [f"v{x}" for x in rng.integers(0, 500, int(rng.integers(0, 90)))]
        s = X.bag_min_hash([" ".join(a), " ".join(b)], 512)
        want = jaccard(bag(" ".join(a)), bag(" ".join(b)))
        errors.append(float((s[0] == s[1]).mean()) - want)
        assert abs(X.overlap(*X.bags([" ".join(a), " ".join(b)])) - want) < 1e-12
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_chain_and_hot_group(spark):
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows, text = [], list(base)
    for i in range(25):  # a chain: neighbours are near, its ends are not
        rows.append((i, " ".join(text)))
        text[5 * i % 120] = f"c{i}"
    for i in range(100, 160):  # many edits of one text
        t = [f"h{k}" for k in range(200)]
        for k in rng.sample(range(200), 2):
            t[k] = f"x{rng.random()}"
        rows.append((i, " ".join(t)))
    rows += [(200, None), (201, ""), (202, " "), (203, "a b"), (204, "a b"), (205, "a  b"), (206, "b a")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, node string").repartition(4)
    assert got_classes(X.near_groups(docs)) == classes(rows)
    assert X.near_groups(docs.limit(0)).collect() == []


def test_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = classes(rows)
    assert got_classes(X.near_groups(docs)) == want
    left = X.drop_near_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(w[0] for w in want)


@pytest.mark.parametrize("chars", [X.BLOCK_CHARS, 0])
def test_group_just_below_the_threshold(spark, monkeypatch, chars):
    """Most pairs of the group have a likeness of 0.7 to 0.8, some a little more: no link is lost, and pairs make no rows."""
    monkeypatch.setattr(X, "BLOCK_CHARS", chars)
    monkeypatch.setattr(X, "BLOCK", 16)
    seen = []
    inner = X.verified
    monkeypatch.setattr(X, "verified", lambda pairs, *a: seen.append(pairs.count()) or inner(pairs, *a))
    rng = random.Random(4)
    rows = []
    for i in range(150):
        t = [f"h{k}" for k in range(200)]
        for k in rng.sample(range(200), rng.choice((3, 3, 4))):
            t[k] = f"x{rng.random()}"
        rows.append((i, " ".join(t)))
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, sure string").repartition(4)
    assert got_classes(X.near_groups(docs)) == classes(rows)
    assert seen[0] <= 2 * len(rows) and seen[1] <= 8 * len(rows) and (sum(seen[2:]) == 0) == (chars > 0)
