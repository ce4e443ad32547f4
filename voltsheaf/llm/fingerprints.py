"""Document fingerprints by consistent weighted sampling.

The terms of a text are its five-word shingles, weighted by how often they occur.  For each term and
each of the BINS samples there are draws r and c from Gamma(2, 1) and beta, uniform on (0, 1), that
depend on the term and the sample alone.  A term of weight w has t = floor(ln w / r + beta),
y = exp(r (t - beta)), at most w, and the value a = c / (y exp(r)); a sample of a text is the pair
(term, t) with the least a.  Two texts thus have the same sample with a probability equal to the
generalised Jaccard similarity of their terms, the sum of the lesser weights by that of the greater.

All terms take part in all samples.  The first 16 bits of c, and of r and beta together, name a cell,
and a table by cell and weight bounds ln a from below, once for texts side by side that share the term; only where the bound is under the least value
known are the draws computed in full, so most logarithms are saved and no sample changes.

Texts of fewer than five words have one shingle of all their words; texts without words (null,
empty or white space) have the fingerprint of no terms, like each other and unlike all others.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltsheaf.llm.common import arrow_map, as_batch, mix64, slices

SHINGLE = 5
BINS = 128
#: Words of texts taken together, and terms whose bounds are in one array.
WORDS = TERMS = 1 << 13
#: Bytes of texts that are hashed together.
PIECE = 1 << 22
#: Weights that have a table of bounds; the few terms of a greater one are computed in full.
TABLED = 32
#: Of the 16 bits that name a cell of r and 1 - beta, those of r; cells of c at zero without a bound.
R_BITS, OPEN = 9, 8
#: Rows of one ordered run; ids for the cut points are a bounded sample.
RUN_ROWS, MOST_RUNS, SAMPLE = 256, 20_000, 100_000
LEAST = -(2**63)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts one after another, and the number of each text."""
    words = [t.split() for t in texts]
    flat = [w for ws in words for w in ws]
    codes = pd.util.hash_array(np.array(flat, object), categorize=True) if flat else np.zeros(0, np.uint64)
    return codes, np.array([len(w) for w in words], np.int64)


def shingles(codes: np.ndarray, counts: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text and the row each belongs to.

    A text with fewer words than a shingle has one of them all; one without words has none.
    """
    n = len(codes)
    ends = np.cumsum(counts)
    starts = ends - counts
    out_h, out_row = [], []
    if n >= width:
        h = np.zeros(n - width + 1, np.uint64)
        for k in range(width):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - width + 1 + k])
        row = np.repeat(np.arange(len(counts)), counts)
        same = row[: n - width + 1] == row[width - 1 :]
        out_h.append(h[same])
        out_row.append(row[: n - width + 1][same])
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        h = []
        for i in short.tolist():
            v = np.full(1, counts[i], np.uint64)
            for c in codes[starts[i] : ends[i]]:
                v = mix64(v * np.uint64(0x9E3779B97F4A7C15) + c)
            h.append(v[0])
        out_h.append(np.array(h, np.uint64))
        out_row.append(short)
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_h), np.concatenate(out_row)


def weighted(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text by row, their rows and how often each occurs."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
    return h[first], row[first], np.diff(np.r_[first, len(h)])


def gamma_quantile(u: np.ndarray) -> np.ndarray:
    """Quantiles of Gamma(2, 1): c with (1 + c) exp(-c) = 1 - u, by Newton steps from above."""
    want = -np.log1p(-u)
    c = want + np.sqrt(2 * want)
    for _ in range(4):
        c = c - (c - np.log1p(c) - want) * (1 + c) / np.maximum(c, 1e-300)
    return c


@functools.lru_cache(1)
def bounds() -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds of ln c by cell, and upper ones of ln y + r by weight and cell; where there is none, +inf and -inf.

    They leave 1e-4 for rounding to single precision.
    """
    c = np.r_[np.full(OPEN, np.inf), np.log(gamma_quantile(np.arange(OPEN, 1 << 16) / 65536.0))]
    cells, steps = 1 << R_BITS, 1 << 16 - R_BITS
    edge = np.r_[1e-300, gamma_quantile(np.arange(1, cells) / cells), np.inf]
    low_r, high_r = edge[:-1, None], edge[1:, None]
    v = np.arange(steps + 1) / steps  # 1 - beta, never 0
    low_v, high_v = np.maximum(v[None, :-1], 1e-12), v[None, 1:]
    scale = []
    for w in np.log(np.arange(1, TABLED + 1)):
        t = np.floor(w / low_r + 1 - low_v)
        scale.append(np.where(np.isfinite(high_r), np.minimum(high_r * (t + high_v), w + high_r), -np.inf).ravel())
    return (c - 1e-4).astype(np.float32), np.stack(scale).astype(np.float32)


def halves(term: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Bits of two samples of each term: 16 that name the cell of c and 16 for r and 1 - beta, low ones first."""
    return mix64(term + (pair.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def draws(term: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, c and 1 - beta of each term in a sample."""
    x = halves(term, sample >> 1) >> (sample.astype(np.uint64) & np.uint64(1)) * np.uint64(32)
    more = mix64(x + term + sample.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def uniform(cell: np.ndarray, cell_bits: int, shift: int) -> np.ndarray:
        rest = (more >> np.uint64(shift)) & np.uint64(2**21 - 1)
        return ((cell & np.uint64(2**cell_bits - 1)) + (rest + 0.5) * 2.0**-21) * 2.0**-cell_bits

    c = uniform(x, 16, 0)
    r = uniform(x >> np.uint64(32 - R_BITS), R_BITS, 21)
    return gamma_quantile(r), gamma_quantile(c), uniform(x >> np.uint64(16), 16 - R_BITS, 42)


def values(term: np.ndarray, weight: np.ndarray, sample: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln a and the name of (term, t) of each term of a weight in a sample."""
    r, c, v = draws(term, sample)
    t = np.floor(np.log(weight) / r + 1 - v)
    return np.log(c) - r * (t + v), mix64(term + t.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def marked(mask: np.ndarray) -> np.ndarray:
    """Places of the few set entries of a mask, eight looked at together."""
    mask = mask.reshape(-1)
    if len(mask) % 8:
        return np.flatnonzero(mask)
    near = (np.flatnonzero(mask.view(np.uint64))[:, None] * 8 + np.arange(8)).reshape(-1)
    return near[mask[near]]


def bounded(term: np.ndarray, weight: np.ndarray, bins: int) -> np.ndarray:
    """Lower bounds of ln a, a (terms, bins) array; +inf where there is none."""
    log_c, scale = bounds()
    cell = halves(term[:, None], np.arange((bins + 1) // 2)).view("<u2").reshape(len(term), -1, 2)[:, :bins]
    out = log_c.take(cell[..., 0].astype(np.intp), mode="clip")
    out -= scale[0].take(cell[..., 1].astype(np.intp), mode="clip")
    for k in np.unique(weight[weight > 1]).tolist():
        same = np.flatnonzero(weight == k)
        out[same] = log_c[cell[same, :, 0]] - scale[k - 1][cell[same, :, 1]] if k <= TABLED else np.inf
    return out


def sampled(term: np.ndarray, row: np.ndarray, weight: np.ndarray, least: np.ndarray, name: np.ndarray) -> None:
    """Enter terms, ordered by row, into the (rows, bins) least values and the names of who has them.

    Where there are many, a range of hashes is taken at a time, so that texts alike share bounds.
    """
    bins = least.shape[1]
    flat, names = least.reshape(-1), name.reshape(-1)
    ranges = -(-len(term) // TERMS)
    of = ((term >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    order = np.argsort(of, kind="stable")
    for picked in np.split(order, np.searchsorted(of[order], np.arange(1, ranges))):
        if not len(picked):
            continue
        h, r, w = term[picked], row[picked], weight[picked]
        by = np.lexsort((w, h))
        new = np.r_[True, (h[by[1:]] != h[by[:-1]]) | (w[by[1:]] != w[by[:-1]])]
        place = np.empty(len(h), np.int64)
        place[by] = np.cumsum(new) - 1
        bound = bounded(h[by[new]], w[by[new]], bins).take(place, axis=0)
        first = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        part = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(r)]))

        def settle(at: np.ndarray) -> None:
            i, k = at // bins, at % bins
            value, who = values(h[i], w[i], k)
            slot = r[i] * bins + k
            np.minimum.at(flat, slot, value)
            won = value == flat[slot]
            names[slot[won]] = who[won]

        # those of the least bound first: they are close to the least value, and rule out most others
        low = np.stack([rows.min(axis=0) for rows in np.split(bound, first[1:])])
        lead = marked(bound == np.where(low <= least[r[first]], low, np.nan).astype(np.float32).take(part, axis=0))
        settle(lead)
        bound.reshape(-1)[lead] = np.nan
        limit = least[r[first]].astype(np.float32).take(part, axis=0)
        settle(marked((bound <= limit) | (bound == np.inf)))


def signatures(texts: list[str], bins: int = BINS) -> np.ndarray:
    """One 16-bit name for each sample of each text, an (n, bins) array; 0 throughout: no terms."""
    out = np.zeros((len(texts), bins), np.uint16)
    codes, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    start = 0
    while start < len(texts):
        before = ends[start] - counts[start]
        stop = max(min(start + 2, len(texts)), int(np.searchsorted(ends, before + WORDS, side="right")))
        h, row = shingles(codes[before : ends[stop - 1]], counts[start:stop])
        if len(h):
            least, name = np.full((stop - start, bins), np.inf), np.zeros((stop - start, bins), np.uint64)
            h, row, weight = weighted(h, row)
            sampled(h, row, weight, least, name)
            some = np.isfinite(least[:, 0])
            out[start:stop][some] = (mix64(name[some]) >> np.uint64(48)).astype(np.uint16) | np.uint16(1)
        start = stop
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row."""
    return (a == b).mean(axis=1)


def hexed(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def fingerprint(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """doc_id and fingerprint of every text, in one narrow pass."""
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in batches:
            yield as_batch({"doc_id": batch.column("doc_id"), "fingerprint": hexed(signatures(batch.column("text").to_pylist(), bins))}, schema)

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, fingerprint string")


def ordered_runs(docs: DataFrame) -> DataFrame:
    """Rows in runs by descending id, each run in one task and closed by the first row of the next.

    Columns: run, guest (the borrowed row, which ends the run), doc_id, place (doc_id with null as
    the least), text.  The cut points come from a bounded sample of ids and decide balance alone.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)).alias("place"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    runs = max(1, min(MOST_RUNS, n // RUN_ROWS))
    picked = rows.select("place").sample(min(1.0, SAMPLE / max(n, 1)), 17) if n > SAMPLE else rows.select("place")
    ids = np.sort(np.array([r[0] for r in picked.collect()], np.int64))
    cuts = np.unique(ids[[len(ids) * i // runs for i in range(1, runs)]]) if len(ids) and runs > 1 else np.zeros(0, np.int64)

    @F.pandas_udf(T.IntegerType())
    def run_of(place: pd.Series) -> pd.Series:
        return pd.Series((len(cuts) - np.searchsorted(cuts, place.to_numpy(np.int64), side="right")).astype(np.int32))

    # the first id of each run, at most MOST_RUNS rows; each is lent to the run before it
    tops = sorted((r.run, r.top) for r in rows.select(run_of("place").alias("run"), "place").groupBy("run").agg(F.max("place").alias("top")).collect())
    lent = spark.createDataFrame([(tops[i - 1][0], tops[i][1]) for i in range(len(tops))], "run int, place long")
    guests = rows.join(F.broadcast(lent), "place").select("run", F.lit(True).alias("guest"), "doc_id", "place", "text")
    own = rows.select(run_of("place").alias("run"), F.lit(False).alias("guest"), "doc_id", "place", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return own.unionByName(guests).repartition(parts, "run").sortWithinPartitions("run", "guest", F.desc("place"), "text")


def edited_fingerprints(docs: DataFrame, bins: int = BINS) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many, or
    all, of the next document by descending id (ties: by text; a null id comes last; the last is
    followed by the first, a single document by itself).  The texts are shuffled once.
    """
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
    )

    def run(batches):
        held, carried = None, np.zeros((1, bins), np.uint16)  # (run, doc_id, text, place) still without its next row
        for batch in slices(batches, PIECE, "text"):
            runs, guests = batch.column("run").to_pylist(), batch.column("guest").to_pylist()
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            signed, pairs = [], []  # a text stands beside its edited one, whose terms are mostly the same
            for i in range(len(texts)):
                follows = held is not None and held[0] == runs[i]
                if follows:
                    k = len(held[2]) // 3
                    pairs.append((held, len(signed), len(signed) + 1))
                    signed.append(held[2][: len(held[2]) - k] + texts[i][:k])
                signed.append(texts[i])
                held = None if guests[i] else (runs[i], ids[i], texts[i], len(signed) - 1)
            found = np.vstack([signatures(signed, bins), carried])
            if held is not None:
                carried, held = found[[held[3]]], (*held[:3], -1)
            if not pairs:
                continue
            mine, changed, after = (found[[at(p) for p in pairs]] for at in (lambda p: p[0][3], lambda p: p[1], lambda p: p[2]))
            yield as_batch(
                {
                    "doc_id": [p[0][1] for p in pairs],
                    "n_chars": [len(p[0][2]) for p in pairs],
                    "edited_sha256": [hashlib.sha256(signed[p[1]].encode()).hexdigest() for p in pairs],
                    "fingerprint": hexed(mine),
                    "edited_fingerprint": hexed(changed),
                    "near_edited": likeness(mine, changed),
                    "near_next": likeness(mine, after),
                },
                schema,
            )

    return arrow_map(ordered_runs(docs).select("run", "guest", "doc_id", "text"), run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
