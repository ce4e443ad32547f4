import hashlib
import zlib
from collections import defaultdict

import pytest

from voltsheaf.llm import conversation_trie as T


def brute(rows):
    """The trie of (conv_id, turn, role, text) rows, from whole prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, len(text.encode())))
    first = lambda c: c - (abs(c) % 5) * (1 if c >= 0 else -1)
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        turns.sort()
        head = sorted(own.get(first(c), []))[:h]
        paths[c] = [t[2:] for t in head + turns[h:]]
    nodes = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes[tuple(path[:d])].append(c)
    kids = defaultdict(set)
    for p in nodes:
        if p:
            kids[p[:-1]].add(p)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(members) if len(paths[c]) == len(p))
        saved = sum((len(nodes[q]) - 1) * (q[-1][1] if q else 0) for q in under)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert {t for _, t in df.dtypes[:-1]} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=str)


def made(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, digest string")


@pytest.mark.parametrize("most_bytes", [T.BROADCAST_BYTES, 0])
def test_hot_prefixes_and_copies(spark, most_bytes):
    """Copies of one long conversation, a very common first turn, a family without its first, and ids below 0."""
    rows = []
    for c in list(range(-8, 40)) + list(range(101, 105)) + list(range(1000, 1003)):
        kind = c % 7
        n = 12 if kind < 3 else (0 if kind == 3 else c % 4 + 1)
        rows += [(c, t, "user" if t % 2 == 0 else None, "hello" if t == 0 else f"turn {t} é" if kind < 3 else f"{c % 3} {t}") for t in range(n)]
    assert as_rows(T.trie(made(spark, rows), most_bytes)) == brute(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(0, None, None, None), (0, None, "a", ""), (0, 1, "a", "b"), (0, 1, "a", "b"), (0, 1, "ab", ""), (1, 5, "u", "x"), (1, None, "u", "y"), (None, 1, "u", "lost"), (7, 1, "u", "x" * 100_000), (8, 1, "u", "x" * 100_000), (9, 0, "a", "b")]
    assert as_rows(T.trie(made(spark, rows))) == brute(rows)
    assert as_rows(T.trie(made(spark, rows).limit(0))) == []
    assert as_rows(T.trie(made(spark, [(None, 1, "u", "x")]))) == []


def test_one_conversation_over_all_ranges(spark):
    """A conversation longer than a range: its numbers go on over the ranges."""
    rows = [(5, t, "u", f"t{t % 50}") for t in range(3000)] + [(6, t, "u", "z") for t in range(20)]
    got = T.numbered(made(spark, rows)).collect()
    assert sorted(r.number for r in got if r.conv_id == 5) == list(range(3000))
    found = {r.number: r.digest for r in got if r.conv_id == 5}
    assert all(bytes(found[i]) == hashlib.sha256(f"1:ut{i % 50}".encode()).digest() for i in range(3000))
    nodes = as_rows(T.trie(made(spark, rows)))
    shared = min(zlib.crc32(b"6") % 9, 3000)
    assert len(nodes) == 3001 + 20 - shared and max(r[1] for r in nodes) == 3000


def test_digests_of_many_ids(spark):
    """Ids of one node in many pieces are digested in order."""
    n = 3 * T.PIECE_IDS + 5
    rows = spark.range(n).selectExpr("0L AS depth", "id % 2 AS node", "id * 3 AS conv_id")
    got = {r.node: r.ends_sha256 for r in T.ends(rows).collect()}
    assert got == {k: hashlib.sha256(",".join(str(3 * i) for i in range(k, n, 2)).encode()).hexdigest() for k in (0, 1)}
