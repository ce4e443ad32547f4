import hashlib
import random
import re

import numpy as np

from voltsheaf.llm import secrets as X

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def verify(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        joined = ",".join(f"{X.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3)), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert joined == ",".join(s for s in r.spans.split(",") if not s.startswith("random"))


def test_documents(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    verify(X.scan(docs).collect(), dict(docs.select("doc_id", "text").collect()))


def test_odd_texts(spark):
    rng = random.Random(2)
    parts = ["password", "Secret", "token", "API_KEY", "apikey", '"', "'", " ", ":", "=", "é🙂", "abcdefgh", "abc", "AKIA", "ABCDEFGHIJ12", "0123456789abcdef", "\n", "-", "x"]
    texts = {i: "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for i in range(400)}
    texts |= {1000: None, 1001: "", 1002: "secret: token : abcdefghij", 1003: "f" * 31, 1004: "AKIAAKIA" + "Z" * 9}
    docs = spark.createDataFrame([(k, v, "z") for k, v in texts.items()], "doc_id long, text string, found string")
    verify(X.scan(docs).collect(), texts)
    assert X.scan(docs.limit(0)).collect() == []


def test_battery(spark):
    rng = np.random.default_rng(7)
    letters = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    secrets = {i: "".join(rng.choice(letters, 44)) for i in range(200)}
    words = ["getUserName", "handler", "configuration", "version", "internationalisation", "2024", "release", "module", "test", "error"]
    names = {1000 + i: "_".join(rng.choice(words, 4)) + "_" + str(int(rng.integers(10, 99))) for i in range(1000)}
    docs = spark.createDataFrame([(k, f"see {v} é here") for k, v in (secrets | names).items()], "doc_id long, text string")
    got = {r.doc_id: r for r in X.scan(docs).collect()}
    found = [k for k in secrets if got[k].n_random == 1]
    wrong = [k for k in names if got[k].n_random]
    assert len(found) > 170 and len(wrong) <= 0.1 * len(found)
    assert got[found[0]].spans == f"random:4:{4 + 44}"


def test_redact(spark):
    docs = spark.createDataFrame([(1, "é password=abcdefgh1 end", 9, 1), (2, None, None, 1), (3, "token: " + "0123456789abcdef" * 2 + "!", 40, 1)], "doc_id long, text string, n_chars long, found int")
    rows = {r.doc_id: r for r in X.redact(docs).collect()}
    assert rows[1].text == "é [secret] end" and rows[1].n_chars == 14 and rows[2].text is None and rows[3].text == "[secret]!"


def test_recall_where_secrets_are_rare(spark):
    """Some 0.1 % of the tokens of a length class are keys, the rest are names of written words."""
    rng = np.random.default_rng(11)
    words = ["user", "handler", "configuration", "version", "cluster", "release", "module", "index", "error", "payment", "service", "gateway", "staging", "eu", "west", "backup", "daily", "report", "image", "cache"]
    alphabets = {"base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}
    keys = [(name, n, "".join(rng.choice(list(letters), n))) for name, letters in alphabets.items() for n in (40, 64) for _ in range(12)]
    names = []
    for i in range(30_000):
        w = [str(x) for x in rng.choice(words, 4 + i % 4)] + [str(rng.integers(1, 2030))]
        names.append("_".join(w) if i % 3 == 0 else "-".join(w) if i % 3 == 1 else "".join(x.capitalize() for x in w))
    texts = dict(enumerate(["see " + k[2] for k in keys] + ["see " + n for n in names]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    found = {r.doc_id for r in X.scan(docs).filter("n_random > 0").collect()}
    wrong = [i for i in found if i >= len(keys)]
    for name, least in (("base62", 0.8), ("base36", 0.8), ("base32", 0.4)):
        mine = [i for i, k in enumerate(keys) if k[0] == name]
        assert sum(i in found for i in mine) >= least * len(mine), name
    assert len(wrong) <= 0.1 * len(found)


def test_keys_after_signs(spark):
    """Keys in query strings, environment files, JSON and quotes are found where they begin; "=" is padding at the end alone."""
    rng = np.random.default_rng(13)
    letters = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    words = ["user", "handler", "configuration", "version", "cluster", "release", "module", "index", "error", "payment"]
    ways = {"SIG=": "\n", "export DB_CREDENTIAL=": "", "https://a.example/b?sig=": "&page=2", '{"k":"': '"}', "x = '": "'", "é=\"": '"', "a: ": "==", "k==": "="}
    texts, want = {}, {}
    for before, after in ways.items():
        for _ in range(25):
            i = len(texts)
            texts[i] = before + "".join(rng.choice(letters, 40)) + after
            want[i] = f"random:{len(before)}:{len(before) + 40 + (len(after) if after.startswith('=') else 0)}"
    for i in range(2000):
        texts[10_000 + i] = "NAME=" + "_".join(str(x) for x in rng.choice(words, 4)) + "_" + str(rng.integers(10, 99))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.spans for r in X.scan(docs).collect()}
    for k in range(len(ways)):
        mine = range(k * 25, k * 25 + 25)
        assert sum(got[i] == want[i] for i in mine) >= 0.8 * 25, list(ways)[k]
    found = sum(got[i] != "" for i in want)
    assert sum(got[i] != "" for i in texts if i >= 10_000) <= 0.1 * found


def test_redact_many_spans(spark):
    """Texts of more spans than a block of blocks holds, beside overlaps and spans at both ends, against a plain replacement."""
    rng = random.Random(3)
    rows = [(1, "".join(("é" * (i % 3)) + "%032x" % rng.getrandbits(128) + "; " for i in range(17_000)))]
    rows += [(2 + i, "".join(rng.choice(["token=", "0123456789abcdef" * 2, "AKIAABCDEFGHIJ12", " ", "🙂", "-"]) for _ in range(n))) for i, n in enumerate((1, 2, 5, 130, 400))]
    got = {r.doc_id: r.text for r in X.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        out, at = [], 0
        for a, _, b in brute(text):
            if a >= at:
                out.append(text[at:a])
            at = max(at, b)
        assert got[i] == "[secret]".join([*out, text[at:]]), i


def test_many_spans_in_one_text(spark):
    rng = np.random.default_rng(5)
    letters = list("0123456789abcdef")
    text = " ".join("".join(rng.choice(letters, 32)) + ("" if i % 3 else "=Z/" * 9) for i in range(3000))
    docs = spark.createDataFrame([(1, text), (2, "é" * 300 + " token=abcdefgh1"), (3, "0" * 200_000)], "doc_id long, text string")
    verify(X.scan(docs).collect(), {r.doc_id: r.text for r in docs.collect()})
