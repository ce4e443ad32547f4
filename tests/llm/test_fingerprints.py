import hashlib
from collections import Counter

import numpy as np

from voltsheaf.llm import fingerprints as X


def jaccard(a, b):
    def terms(t):
        w = t.split()
        return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()

    p, q = terms(a), terms(b)
    return sum((p & q).values()) / max(1, sum((p | q).values()))


def test_collision_rate_is_generalised_jaccard():
    rng = np.random.default_rng(4)
    errors = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 4000, 600)]
        words = words[:200] * int(rng.integers(1, 4)) + words[200:]
        other = words[: int(len(words) * rng.uniform(0.3, 1))] + [f"v{x}" for x in rng.integers(0, 4000, 200)]
        a, b = " ".join(words), " ".join(other)
        s = X.signatures([a, b], 256)
        errors.append(float((s[0] == s[1]).mean()) - jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_heavy_terms_count_by_their_weight():
    for k in range(4):
        one = " ".join(f"s{k}" for _ in range(1004))  # one shingle of weight 1000
        a, b = (one + " " + " ".join(f"{side}{k}.{i}" for i in range(20)) for side in "ab")
        line = " ".join(f"l{k}.{i}" for i in range(20)) + " "
        c, d = (line * 100 + " ".join(f"{side}{k}.{i}" for i in range(300)) for side in "cd")
        for x, y in ((a, b), (c, d)):
            s = X.signatures([x, y], 1024)
            assert abs(float((s[0] == s[1]).mean()) - jaccard(x, y)) < 0.06


def test_draws_have_the_named_laws():
    term = X.mix64(np.arange(200_000, dtype=np.uint64))
    for sample in (0, 1, 126, 127):
        r, c, v = X.draws(term, np.full(len(term), sample))
        for x in (r, c):
            assert abs(x.mean() - 2) < 0.02 and abs(x.var() - 2) < 0.06
            cdf = np.sort(1 - (1 + x) * np.exp(-x))
            assert np.abs(cdf - np.arange(len(x)) / len(x)).max() < 0.006
        assert np.abs(np.sort(v) - np.arange(len(v)) / len(v)).max() < 0.006 and v.min() > 0
        assert np.abs(np.corrcoef([r, c, v]) - np.eye(3)).max() < 0.012
    other = [X.draws(term, np.full(len(term), k))[0] for k in (0, 1)]
    assert abs(np.corrcoef(other)[0, 1]) < 0.012


def test_values_of_a_weight_are_exponential():
    """a of a term of weight w is Exp(w), and y, what t stands for, never exceeds w."""
    term = X.mix64(np.arange(100_000, dtype=np.uint64))
    for w in (1, 2, 7, 1000):
        r, c, v = X.draws(term, np.full(len(term), 3))
        log_a, _ = X.values(term, np.full(len(term), w), np.full(len(term), 3))
        assert abs(np.exp(log_a).mean() * w - 1) < 0.02
        y = np.exp(r * (np.floor(np.log(w) / r + 1 - v) - 1 + v))
        assert (y <= w * (1 + 1e-9)).all()


def test_bounds_lose_no_sample(monkeypatch):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, k, n)) for n in (1, 3, 5, 9, 40, 300, 2000) for k in (2, 3, 9, 5000)] + ["a b " * 300]
    got = X.signatures(texts)
    monkeypatch.setattr(X, "TERMS", 64)
    monkeypatch.setattr(X, "WORDS", 64)
    assert (X.signatures(texts) == got).all()
    for t, s in zip(texts, got):
        h, _, w = X.weighted(*X.shingles(*X.word_hashes([t])))
        for k in range(X.BINS):
            value, name = X.values(h, w, np.full(len(h), k))
            assert s[k] == (int(X.mix64(name[[value.argmin()]])[0]) >> 48) | 1


def test_similarity_of_weights_up_to_a_thousand():
    """Bias and spread of the collision rate for terms of any weights."""
    rng = np.random.default_rng(12)
    h = X.mix64(np.arange(3000, dtype=np.uint64)).reshape(100, 30)
    errors, law = [], []
    for term in h:
        a, b = (np.exp(rng.uniform(0, np.log(1000), 30)).astype(np.int64) for _ in "ab")
        b = np.where(rng.random(30) < 0.5, a, b)
        name = np.zeros((2, 1024), np.uint64)
        X.sampled(np.r_[term, term], np.repeat([0, 1], 30), np.r_[a, b], np.full((2, 1024), np.inf), name)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append((name[0] == name[1]).mean() - true)
        law.append(true * (1 - true) / 1024)
    assert abs(np.mean(errors)) < 0.005 and np.std(errors) < 0.02
    assert 0.7 < np.std(errors) / np.sqrt(np.mean(law)) < 1.3


def test_equal_short_and_empty_texts():
    s = X.signatures(["", " ", "a b", "a b", "b a", "a b c d e f"])
    assert (s[0] == 0).all() and (s[1] == 0).all() and (s[2] == s[3]).all() and not (s[2] == s[4]).all()


def test_edited(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: -r.doc_id)
    got = {r.doc_id: r for r in X.edited_fingerprints(docs).collect()}
    assert len(got) == len(rows)
    plain = {r.doc_id: r.fingerprint for r in X.fingerprint(docs).collect()}
    errors = []
    for r, after in zip(rows, rows[1:] + rows[:1]):
        k = len(r.text) // 3
        edited = r.text[: len(r.text) - k] + after.text[:k]
        g = got[r.doc_id]
        assert g.n_chars == len(r.text) and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.fingerprint == plain[r.doc_id]
        errors += [g.near_edited - jaccard(r.text, edited), g.near_next - jaccard(r.text, after.text)]
    assert np.abs(errors).max() < 0.2 and abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_nulls_repeats_and_one_row(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "abc def", 0), (2, "abc def", 0), (None, "x y z", 0)], "doc_id long, text string, run int")
    got = X.edited_fingerprints(docs).collect()
    assert sorted(r.n_chars for r in got) == [0, 5, 7, 7]
    one = X.edited_fingerprints(docs.filter("doc_id is null")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"x y x").hexdigest()
    assert X.edited_fingerprints(docs.limit(0)).collect() == []
