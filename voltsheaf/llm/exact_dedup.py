"""Exact dedup by composable polynomial fingerprints.

A text's UTF-8 bytes are the coefficients of a polynomial, taken at two points modulo 2^31 - 1.
Fingerprints of neighbouring chunks combine as ``h(ab) = h(a) * base ** len(b) + h(b)``: inside a
task chunk by chunk, and across tasks for huge documents, whose pieces are hashed in parallel.
Documents of equal fingerprint and length are then compared chunk by chunk, and a group whose
chunks differ (a collision) is split by the texts themselves.

Null text counts as empty; empty texts are one group.  Of equal texts the row with the largest
doc_id stays; among repeated rows of that doc_id exactly one is marked kept.  A null doc_id is
smaller than any other.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf.llm.common import arrow_map, as_batch, sized_broadcast, slices, temporary, utf8_parts, written

MODULUS = 2**31 - 1
BASES = (1_566_083_941, 911_382_323)
CHUNK = 1024
#: Characters of a piece: longer documents are hashed in pieces by several tasks.
PIECE_CHARS = 1 << 20
KEY = ["fp1", "fp2", "n_bytes"]


def powers(base: int, n: int, modulus: int) -> np.ndarray:
    """base**(n-1), ..., base, 1 modulo modulus."""
    out = [1]
    for _ in range(n - 1):
        out.append(out[-1] * base % modulus)
    return np.array(out[::-1], np.float64)


def polynomial(raw: np.ndarray, offsets: np.ndarray, modulus: int = MODULUS) -> np.ndarray:
    """Both fingerprints of each of the byte strings, an (n, 2) array.

    Chunks hold CHUNK bytes, the first of a string fewer (zeros in front leave the value as it is).
    A chunk's sum stays below 255 * 2**31 * 1024 < 2**53, so float64 products are exact.
    """
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // CHUNK))
    ends = np.cumsum(count)
    table = np.stack([powers(b % modulus, CHUNK, modulus) for b in BASES], 1)
    padded = np.zeros(int(ends[-1]) * CHUNK if len(ends) else 0, np.uint8)
    for a, b, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), (ends * CHUNK).tolist()):
        padded[e - (b - a) : e] = raw[a:b]
    rows = padded.reshape(-1, CHUNK)
    chunk = np.concatenate([np.zeros((0, 2))] + [rows[i : i + 2048].astype(np.float64) @ table for i in range(0, len(rows), 2048)])
    chunk = (chunk.astype(np.int64) % modulus).tolist()
    shift = [pow(b, CHUNK, modulus) for b in BASES]
    out, at = [], 0
    for n in count.tolist():
        out.append([reduce(lambda h, c, k=k: (h * shift[k] + c[k]) % modulus, chunk[at : at + n], 0) for k in (0, 1)])
        at += n
    return np.array(out, np.int64).reshape(-1, 2)


def fingerprints(docs: DataFrame, modulus: int = MODULUS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, fp1, fp2, n_bytes, text_sha256: one row per row of docs, in one narrow pass.

    Only documents of more than piece_chars characters are cut, dealt out and combined again.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("n_bytes", pa.int64()), ("text_sha256", pa.string())])
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches):
        for batch in slices(batches, 1 << 23, "text"):
            raw, offsets = utf8_parts(batch.column("text"))
            fp = polynomial(raw, offsets, modulus)
            view = memoryview(np.ascontiguousarray(raw))
            at = offsets.tolist()
            yield as_batch({"doc_id": batch.column("doc_id"), "fp1": fp[:, 0], "fp2": fp[:, 1], "n_bytes": np.diff(offsets), "text_sha256": [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at, at[1:])]}, schema)

    piece_schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("piece", pa.int32()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("n_bytes", pa.int64()), ("shift1", pa.int64()), ("shift2", pa.int64())])

    def pieces(batches):
        for batch in slices(batches, 1 << 23, "text"):
            raw, offsets = utf8_parts(batch.column("text"))
            fp = polynomial(raw, offsets, modulus)
            size = np.diff(offsets)
            yield as_batch({"doc_id": batch.column("doc_id"), "text_sha256": batch.column("text_sha256"), "piece": batch.column("piece"), "fp1": fp[:, 0], "fp2": fp[:, 1], "n_bytes": size, "shift1": [pow(BASES[0], n, modulus) for n in size.tolist()], "shift2": [pow(BASES[1], n, modulus) for n in size.tolist()]}, piece_schema)

    small = arrow_map(texts.filter(F.length("text") <= piece_chars), whole, "doc_id long, fp1 long, fp2 long, n_bytes long, text_sha256 string")
    cut = (
        texts.filter(F.length("text") > piece_chars)
        .select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text", F.explode(F.expr(f"sequence(0, cast((length(text) - 1) div {piece_chars} as int))")).alias("piece"))
        .select("doc_id", "text_sha256", "piece", F.expr(f"substring(text, piece * {piece_chars} + 1, {piece_chars})").alias("text"))
        .repartition("doc_id", "text_sha256", "piece")
    )
    hashed = arrow_map(cut, pieces, "doc_id long, text_sha256 string, piece int, fp1 long, fp2 long, n_bytes long, shift1 long, shift2 long")
    # repeated rows give each piece as many times: the pieces are combined once and the row repeated
    one = hashed.groupBy("doc_id", "text_sha256", "piece").agg(*[F.first(c).alias(c) for c in ("fp1", "fp2", "n_bytes", "shift1", "shift2")], F.count("*").alias("copies"))
    ordered = one.groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_list(F.struct("piece", "fp1", "fp2", "n_bytes", "shift1", "shift2"))).alias("p"), F.max("copies").alias("copies"))

    def combine(k):
        return F.aggregate("p", F.lit(0).cast("long"), lambda h, x: (h * x[f"shift{k}"] + x[f"fp{k}"]) % F.lit(modulus))

    huge = ordered.select(
        "doc_id", combine(1).alias("fp1"), combine(2).alias("fp2"), F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["n_bytes"]).alias("n_bytes"), "text_sha256", F.explode(F.expr("sequence(1L, copies)")).alias("copy")
    ).drop("copy")
    return small.unionByName(huge)


def collided(docs: DataFrame, rows: DataFrame, groups: DataFrame, chunk_chars: int = 1 << 16) -> DataFrame:
    """Keys of groups whose texts differ in some chunk, by a streaming comparison.

    Chunks meet by (key, chunk number); only the smallest and largest text of each is held, which
    combines on the map side, so a group of any size needs no more than that.
    """
    members = sized_broadcast(rows.join(sized_broadcast(groups.select(*KEY)), KEY, "left_semi").select("doc_id", "text_sha256", *KEY).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("text_sha256", F.sha2("text", 256))
    chunks = (
        texts.join(members, F.expr("true") & texts.doc_id.eqNullSafe(members.doc_id) & (texts.text_sha256 == members.text_sha256))
        .select(*KEY, "text", F.explode(F.expr(f"sequence(0, cast(length(text) div {chunk_chars} as int))")).alias("chunk"))
        .select(*KEY, "chunk", F.expr(f"substring(text, chunk * {chunk_chars} + 1, {chunk_chars})").alias("part"))
    )
    return chunks.groupBy(*KEY, "chunk").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select(*KEY).distinct()


def exact_groups(docs: DataFrame, modulus: int = MODULUS, piece_chars: int = PIECE_CHARS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Only fingerprints are shuffled for grouping; the texts of groups of two and more are read
    again for the comparison, found through their ids (broadcast if few, else joined).
    """
    # numbered before they are written: numbers taken at each read would follow how the files are split then
    rows = written(fingerprints(docs, modulus, piece_chars).withColumn("row", F.monotonically_increasing_id()), "fingerprints")
    best = F.max(F.struct("doc_id", "row")).alias("best")
    groups = rows.groupBy(*KEY).agg(best, F.count("*").alias("group_size")).filter("group_size > 1").checkpoint()
    clash = collided(docs, rows, groups).checkpoint()
    if clash.isEmpty():
        keyed = rows.withColumn("exact", F.lit("").cast("binary"))
        found = groups.withColumn("exact", F.lit("").cast("binary"))
    else:
        inside = rows.join(sized_broadcast(clash), KEY, "left_semi")
        # only texts of groups that collide are shuffled
        those = sized_broadcast(written(inside.select("doc_id", "text_sha256").distinct(), "collided-rows"))
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("exact")).withColumn("text_sha256", F.sha2("exact", 256))
        texts = texts.join(those, texts.doc_id.eqNullSafe(those.doc_id) & (texts.text_sha256 == those.text_sha256), "left_semi").distinct()
        inside = inside.join(texts, inside.doc_id.eqNullSafe(texts.doc_id) & (inside.text_sha256 == texts.text_sha256)).select(inside["*"], F.col("exact").cast("binary").alias("exact"))
        keyed = rows.join(sized_broadcast(clash), KEY, "left_anti").withColumn("exact", F.lit("").cast("binary")).unionByName(inside)
        split = inside.groupBy(*KEY, "exact").agg(best, F.count("*").alias("group_size")).filter("group_size > 1")
        found = groups.join(sized_broadcast(clash), KEY, "left_anti").withColumn("exact", F.lit("").cast("binary")).unionByName(split)
    found = sized_broadcast(found)
    return keyed.join(found, [*KEY, "exact"], "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("best").isNull() | (F.col("best.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def keep_marked(docs: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows of docs that judge(docs) (doc_id, text_sha256, kept: a row for each) marks kept.

    Rows leave by an anti-join on the ids to drop.  Where ids occur on several rows, rows are met by
    id and text and reduced to one each.
    """
    with temporary(docs.sparkSession):
        verdict = written(judge(docs).select("doc_id", F.unhex("text_sha256").alias("sha"), "kept"), "verdict", outlast=True)
    several = verdict.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null").limit(1)
    if several.isEmpty():
        gone = sized_broadcast(verdict.filter(~F.col("kept")).select("doc_id"))
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    hashed = docs.withColumn("__sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    kept = verdict.filter("kept").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__kept_sha"))
    left = hashed.join(kept, hashed.doc_id.eqNullSafe(F.col("__id")) & (F.col("__sha") == F.col("__kept_sha")), "left_semi")
    return left.dropDuplicates(["doc_id", "__sha"]).select(*docs.columns)


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without all but one row of each group of equal texts; the columns stay as they are."""
    return keep_marked(docs, exact_groups)
