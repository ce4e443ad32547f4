"""Removal of repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A byte goes if some 200-byte string over it also starts anywhere else in the corpus, in the same
document or another.  Sorting a suffix from every byte would exchange some 190 bytes for each byte
of input, so suffixes start at anchors: of the 101 grams of 100 bytes in a 200-byte window the one
of least hash (the leftmost of equals).  Equal windows have their anchor at the same place, so
only anchors whose gram occurs twice can lie in repeated windows, and only those are exchanged.

* Every task sorts the suffixes at its candidate anchors (200 bytes to the right, and the 100 bytes
  to the left of each) into runs, front-coded: what a suffix shares with the one before is not sent.
* A target gets all runs of its grams and merges them with a loser tree that keeps, for every run's
  head, the length of its common prefix with the last output, so that known prefixes are never
  compared again; the merge gives the common prefixes of neighbours for nothing.
* A window that starts t bytes left of its anchor is repeated if a neighbour in the sorted order
  shares 200 - t bytes to the right and t to the left: intervals of the common prefixes, found for
  all t together.

A gram that occurs more than HOT times would make one target's work grow without bound.  Its windows
are dealt out by longer keys, RANGE of the t at a time: windows with t from lo to hi agree in 200 - hi
bytes to the right and lo to the left, so these bytes name the target.  And of suffixes that agree in
all their bytes a task sends one alone, since the windows of all of them are known to be repeated.  So
what meets in a target is one suffix a task, or suffixes that share less than a window.

Texts are compared in UTF-8; null counts as empty.  Texts that occur on several rows are worked on
once: from 200 bytes on they go whole.  Nothing depends on the ids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf.llm.common import arrow_map, as_batch, mix64, sized_broadcast, slices, utf8_parts, written

LENGTH, GRAM = 200, 100
SPAN = LENGTH - GRAM  # the most bytes a window starts left of its anchor
HOT, RANGE = 4000, 25
SEGMENT = 1 << 20
RUN_BYTES, TARGET_BYTES = 32 << 20, 8 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n (base is odd)."""
    size = 1 << max(10, (n - 1).bit_length())
    if (base, size) not in _powers:
        both = []
        for b in (base, pow(base, -1, 2**64)):
            row = np.full(size, b, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        _powers[base, size] = (both[0], both[1])
    return _powers[base, size]


def window_hashes(raw: np.ndarray, width: int, base: int = _BASE) -> np.ndarray:
    """Hash of raw[i : i + width] for every i."""
    n = len(raw)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return mix64((total[width:] - total[:-width]) * down[: n - width + 1])


def anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of concatenated texts of at most 2 * SEGMENT bytes in all: gram hash, place of the anchor, and
    first and last start of the windows it stands for."""
    h = window_hashes(raw, GRAM)
    n = len(raw) - LENGTH + 1
    if n <= 0:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    low = np.uint64((1 << 22) - 1)
    v = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN + 1:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    rest = SPAN + 1 - width
    if rest:
        v = np.minimum(v[:-rest], v[rest:])
    at = (v[:n] & low).astype(np.int64)
    start = np.arange(n)
    valid = start + LENGTH <= ends[np.searchsorted(ends, start, side="right")]
    start, at = start[valid], at[valid]
    if not len(at):
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    last = np.r_[new[1:], len(at)] - 1
    return h[at[new]], at[new], start[new], start[last]


def segments(offsets: np.ndarray):
    """Groups of (row, from, to) byte ranges of at most about SEGMENT bytes; a longer text comes in
    ranges that overlap by a window less one byte, so that each window is in exactly one."""
    group, held = [], 0
    for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        at = a
        while b - at >= LENGTH:
            stop = min(b, at + SEGMENT)
            group.append((i, at, stop))
            held += stop - at
            if held >= SEGMENT:
                yield group
                group, held = [], 0
            if stop == b:
                break
            at = stop - LENGTH + 1
    if group:
        yield group


def packed_anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, gram and place of each anchor; a place is (byte << 14 | least t << 7 | greatest t), t being
    how far left of the anchor a window starts."""
    rows, grams, places = [], [], []
    for group in segments(offsets):
        ends = np.cumsum([b - a for _, a, b in group])
        g, at, first, last = anchors(np.concatenate([raw[a:b] for _, a, b in group]), ends)
        k = np.searchsorted(ends, at, side="right")
        row, begin = np.array([x[0] for x in group]), np.array([x[1] for x in group])
        byte = at - (ends - np.array([b - a for _, a, b in group]))[k] + begin[k] - offsets[row[k]]
        rows.append(row[k])
        grams.append(g)
        places.append(byte << 14 | (at - last) << 7 | (at - first))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(grams), np.concatenate(places)


def scanned(docs: DataFrame) -> DataFrame:
    """sha, n_bytes, grams, places: one row per row of docs."""
    schema = pa.schema([("sha", pa.string()), ("n_bytes", pa.int64()), ("grams", pa.list_(pa.int64())), ("places", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches, 1 << 22, "text"):
            raw, offsets = utf8_parts(batch.column("text"))
            row, gram, place = packed_anchors(raw, offsets)
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.view(np.int64))) for x in (gram, place)]
            yield as_batch({"sha": batch.column("sha"), "n_bytes": np.diff(offsets), "grams": lists[0], "places": lists[1]}, schema)

    return arrow_map(docs.select("sha", "text"), run, "sha string, n_bytes long, grams array<long>, places array<long>")


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, of which ``at`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    low, high = at, n  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


RUN = pa.schema([("target", pa.int32()), ("lcp", pa.binary()), ("tail", pa.binary()), ("tails", pa.binary()), ("left_lcp", pa.binary()), ("left_tail", pa.binary()), ("lefts", pa.binary()), ("near", pa.binary()), ("far", pa.binary()), ("rows", pa.binary()), ("bytes", pa.binary()), ("known", pa.binary())])
RUN_DDL = "target int, lcp binary, tail binary, tails binary, left_lcp binary, left_tail binary, lefts binary, near binary, far binary, rows binary, bytes binary, known binary"


def front_coded(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Common prefix with the one before, length of the rest, and the rests."""
    lcp, size, tails, last = bytearray(), bytearray(), [], b""
    for s in strings:
        k = common(last, s, 0)
        lcp.append(k)
        size.append(len(s) - k)
        tails.append(s[k:])
        last = s
    return bytes(lcp), bytes(size), b"".join(tails)


def decoded(lcp: bytes, size: bytes, tails: bytes) -> list[bytes]:
    out, at, last = [], 0, b""
    for k, n in zip(lcp, size):
        last = last[:k] + tails[at : at + n]
        at += n
        out.append(last)
    return out


def sorted_run(target: int, entries: list[tuple]) -> dict:
    """entries: (right, reversed left, near t, far t, row, byte), sorted and front-coded.

    Of entries with equal bytes and t one stays; the spans of all of them are repeated: known.
    """
    entries.sort()
    one, known = entries[:1], []
    for last, e in zip(entries, entries[1:]):
        if e[:4] == last[:4]:
            if last is one[-1]:
                known.append(last)
            known.append(e)
        else:
            one.append(e)
    lcp, size, tails = front_coded([e[0] for e in one])
    left_lcp, left_size, lefts = front_coded([e[1] for e in one])
    return {
        "target": target, "lcp": lcp, "tail": size, "tails": tails, "left_lcp": left_lcp, "left_tail": left_size, "lefts": lefts,
        "near": bytes(e[2] for e in one), "far": bytes(e[3] for e in one),
        "rows": np.array([e[4] for e in one], "<i8").tobytes(), "bytes": np.array([e[5] for e in one], "<i8").tobytes(),
        "known": np.array([(e[4], e[5] - e[3], e[5] - e[2] + LENGTH) for e in known], "<i8").tobytes(),
    }


def hot_keys(gram: int, right: bytes, left: bytes, near: int, far: int):
    """(key, near, far) of each range of t that a suffix of a hot gram has windows in; left is reversed."""
    for lo in range(0, SPAN, RANGE):
        hi = SPAN if lo + RANGE >= SPAN else lo + RANGE - 1
        if max(near, lo) <= min(far, hi):
            key = hashlib.blake2b(b"%d %d " % (gram, lo) + right[: LENGTH - hi] + left[:lo], digest_size=8).digest()
            yield int.from_bytes(key, "little"), max(near, lo), min(far, hi)


def suffix_runs(texts: DataFrame, targets: int, hot: int = HOT) -> DataFrame:
    """Sorted front-coded runs of the suffixes at candidate anchors: a run for each task and target.

    texts: row, text, cands (gram, place, n: how often the gram occurs).
    """

    def run(batches):
        held: dict[int, list] = {}
        size = 0
        for batch in slices(batches, 1 << 22, "text"):
            raw, offsets = utf8_parts(batch.column("text"))
            whole = raw.tobytes()
            for i, (row, cands) in enumerate(zip(batch.column("row").to_pylist(), batch.column("cands").to_pylist())):
                a, b = int(offsets[i]), int(offsets[i + 1])
                for c in cands:
                    place = c["place"]
                    at = a + (place >> 14)
                    right, left = whole[at : min(b, at + LENGTH)], whole[max(a, at - SPAN) : at][::-1]
                    near, far = place >> 7 & 127, place & 127
                    for key, low, high in [(c["gram"], near, far)] if c["n"] <= hot else hot_keys(c["gram"], right, left, near, far):
                        held.setdefault(key % targets, []).append((right, left, low, high, row, place >> 14))
                        size += LENGTH + SPAN
            if size > RUN_BYTES:
                yield pa.RecordBatch.from_pylist([sorted_run(t, e) for t, e in held.items()], RUN)
                held, size = {}, 0
        if held:
            yield pa.RecordBatch.from_pylist([sorted_run(t, e) for t, e in held.items()], RUN)

    return arrow_map(texts.select("row", "text", "cands"), run, RUN_DDL)


def merged(runs: list[list[bytes]], lcps: list[bytes]):
    """(run, place, common prefix with the one before) of all strings of sorted runs, in order.

    A loser tree over the heads of the runs; each loser keeps the common prefix of its head with
    the string that beat it, so a comparison starts after what both are known to share.
    """
    k = 1
    while k < len(runs):
        k *= 2
    place = [0] * k
    heads: list[bytes | None] = [r[0] if r else None for r in runs] + [None] * (k - len(runs))
    known = [0] * k  # common prefix of each run's head with the last output, or with what beat it

    def play(x: int, y: int) -> tuple[int, int]:
        """Winner and loser; known[loser] becomes its common prefix with the winner."""
        a, b = heads[x], heads[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        h = common(a, b, known[x])
        first = len(a) == h or (len(b) > h and a[h] < b[h])
        if not first or (a == b and x > y):
            x, y = y, x
        known[y] = h
        return x, y

    losers = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    top = build(1)
    while heads[top] is not None:
        yield top, place[top], known[top]
        place[top] += 1
        if place[top] < len(runs[top]):
            heads[top], known[top] = runs[top][place[top]], lcps[top][place[top]]
        else:
            heads[top] = None
        node = (top + k) // 2
        while node:
            top, losers[node] = play(top, losers[node])
            node //= 2


def repeated(lcp: np.ndarray, lefts: list[bytes], near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For sorted suffixes with common prefixes lcp: which windows (n, SPAN + 1), by t, occur twice."""
    n = len(lcp)
    left = np.zeros((n, SPAN), np.uint8)
    size = np.fromiter(map(len, lefts), np.int64, n)
    left[np.arange(SPAN) < size[:, None]] = np.frombuffer(b"".join(lefts), np.uint8)
    order = np.argsort(left.view(f"V{SPAN}").ravel(), kind="stable")
    ranked = left[order]
    differs = ranked[1:] != ranked[:-1]
    left_lcp = np.r_[0, np.where(differs.any(1), differs.argmax(1), SPAN)] if n > 1 else np.zeros(1, np.int64)
    found = np.zeros((n, SPAN + 1), bool)
    class_ = np.empty(n, np.int64)
    for t in range(SPAN + 1):
        live = np.flatnonzero((near <= t) & (t <= far))
        if len(live) < 2:
            continue
        group = np.cumsum(lcp < LENGTH - t)
        class_[order] = np.cumsum(left_lcp < t)
        key = group[live] * np.int64(n + 1) + class_[live]
        rank = np.argsort(key, kind="stable")
        same = key[rank][1:] == key[rank][:-1]
        hit = np.zeros(len(live), bool)
        hit[rank[1:][same]] = True
        hit[rank[:-1][same]] = True
        found[live[hit], t] = True
    return found


def spans_of(found: np.ndarray, rows: np.ndarray, byte: np.ndarray) -> dict[str, np.ndarray]:
    """Bytes that the repeated windows of each suffix cover, as (row, start, stop)."""
    edge = np.diff(np.pad(found.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    i, least = np.nonzero(edge == 1)
    _, past = np.nonzero(edge == -1)
    return {"row": rows[i], "start": byte[i] - (past - 1), "stop": byte[i] - least + LENGTH}


SPAN_SCHEMA = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])
SPAN_DDL = "row long, start long, stop long"
MERGE_BLOCK = 100_000


def merged_spans(runs: DataFrame, targets: int) -> DataFrame:
    """Merge the runs of each target and give the spans that repeated windows cover."""

    def judge(block: list) -> pa.RecordBatch:
        lcp, lefts, near, far, rows, byte = map(list, zip(*block))
        lcp[0] = 0
        found = repeated(np.array(lcp), lefts, np.array(near), np.array(far))
        return as_batch(spans_of(found, np.array(rows), np.array(byte)), SPAN_SCHEMA)

    def merge(held: list[dict]):
        known = np.frombuffer(b"".join([r["known"] for r in held]), "<i8").reshape(-1, 3)
        yield as_batch({"row": known[:, 0], "start": known[:, 1], "stop": known[:, 2]}, SPAN_SCHEMA)
        coded = [[decoded(r["lcp"], r["tail"], r["tails"]), r["lcp"], decoded(r["left_lcp"], r["left_tail"], r["lefts"]), r["near"], r["far"], np.frombuffer(r["rows"], "<i8").tolist(), np.frombuffer(r["bytes"], "<i8").tolist()] for r in held]
        block: list = []
        for k, i, lcp in merged([c[0] for c in coded], [c[1] for c in coded]):
            # a block ends where neighbours share less than a gram, so no repeated window is cut
            if len(block) >= MERGE_BLOCK and lcp < GRAM:
                yield judge(block)
                block = []
            _, _, lefts, near, far, rows, byte = coded[k]
            block.append((lcp, lefts[i], near[i], far[i], rows[i], byte[i]))
        if block:
            yield judge(block)

    def run(batches):
        target, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["target"] != target and held:
                    yield from merge(held)
                    held = []
                target = r["target"]
                held.append(r)
        if held:
            yield from merge(held)

    return arrow_map(runs.repartition(targets, "target").sortWithinPartitions("target"), run, SPAN_DDL)


def without_repeats(docs: DataFrame, hot: int = HOT, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes): a row per row.

    Texts are shuffled only where a candidate or removed passage lies in them; their keys are
    broadcast while few, else joined.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    # numbered before they are written: numbers taken at each read would follow how the files are split then
    table = written(scanned(source).withColumn("row", F.monotonically_increasing_id()), "anchors")
    shas = table.groupBy("sha").agg(F.min("row").alias("first"), F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n")).filter("n > 1").checkpoint()
    copies = table.select("row", "sha").join(sized_broadcast(shas.select("sha", "first")), "sha").filter("row <> first").select("row")
    single = table.join(sized_broadcast(copies.checkpoint()), "row", "left_anti")
    grams = single.select("row", F.explode(F.arrays_zip(F.col("grams").alias("gram"), F.col("places").alias("place"))).alias("x")).select("row", "x.gram", "x.place")
    twice = grams.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").checkpoint()
    cands = written(grams.join(twice, "gram").groupBy("row").agg(F.collect_list(F.struct("gram", "place", "n")).alias("cands")).join(table.select("row", "sha"), "row"), "candidates")
    picked = source.select("sha", "text").join(sized_broadcast(cands.select("sha")), "sha", "left_semi").dropDuplicates(["sha"])
    texts = picked.join(cands, "sha")

    n = cands.select(F.sum(F.size("cands"))).first()[0]
    if n:
        targets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * (LENGTH + SPAN) // TARGET_BYTES))
        spans = merged_spans(suffix_runs(texts, targets, hot), targets)
    else:
        spans = docs.sparkSession.createDataFrame([], SPAN_DDL)
    whole = sized_broadcast(shas.filter(F.col("n_bytes") >= LENGTH).select("sha"))
    covered = written(spans.groupBy("row").agg(F.collect_list(F.struct("start", "stop")).alias("spans")).join(table.select("row", "sha"), "row").join(whole, "sha", "left_anti").select("sha", "spans"), "spans")

    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
    schema = pa.schema(fields if keep_text else fields[:-1])
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text

    def cut(batches):
        for batch in slices(batches, 1 << 23, "text"):
            out: dict[str, list] = {f.name: [] for f in schema}
            for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                raw, at, n_spans, left = text.encode(), 0, 0, []
                reach = -1
                for a, b in sorted((s["start"], s["stop"]) for s in found):
                    if a > reach:
                        left.append(raw[at:a])
                        n_spans += 1
                    reach = at = max(reach, b)
                left.append(raw[at:])
                kept = b"".join(left)
                row = {"doc_id": doc_id, "n_bytes": len(raw), "n_removed": len(raw) - len(kept), "n_spans": n_spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept}
                for name in out:
                    out[name].append(row[name])
            yield as_batch(out, schema)

    size = F.octet_length("text").cast("long")
    keys = sized_broadcast(covered.select("sha"))
    gone = source.join(whole, "sha", "left_semi").select("doc_id", size.alias("n_bytes"), size.alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"), *[F.lit("").cast("binary").alias("kept")] * keep_text)
    rest = source.join(whole, "sha", "left_anti")
    clean = rest.join(keys, "sha", "left_anti").select("doc_id", size.alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), *[F.col("text").cast("binary").alias("kept")] * keep_text)
    hit = arrow_map(rest.join(keys, "sha", "left_semi").join(covered, "sha").select("doc_id", "text", "spans"), cut, ddl)
    return clean.unionByName(gone).unionByName(hit)
