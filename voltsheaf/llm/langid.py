"""Language identification by language-bitmask n-gram filters.

Training finds the character n-grams that are typical of each language: those whose share there is
at least TYPICAL of their largest share anywhere.  A Bloom filter a language would hold them; here
the filters are bit-sliced, so that a slot holds one bit for each language, and the AND of an
n-gram's slots gives all languages that contain it at once.  A text counts, for each language, the
n-grams that its filter contains; the counts are corrected for the filter's false positives and
for how much of the language's own training text its filter covers, and the largest decides.

Only texts and non-null languages of documents outside the held-out quarter are learnt from, at
most about SAMPLE_DOCS documents a language (a stated bound on labelled rows, by a hash of id and
text).  Every typical n-gram that its language's sample holds LEAST_COUNT times enters the filter
(fewer times, down to one, for a language whose sample has less than 3,000 n-grams), and the filter
has BITS_EACH slots for each n-gram of the language with most, so its false-positive rate does not
depend on how much was kept and its size is bounded by the sample.

Null texts and texts without a letter are ``und`` with score 0; a text of no known n-gram is the
language with most training documents, with score 0.  Ties go to the language that sorts first.
Without training rows every text is ``und``.  A text of over PIECE characters is counted in pieces,
cut at white space if possible, so that a task's memory is bounded; the end of a piece is carried
into the next one, so that the n-grams over a cut are counted as well.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltsheaf.llm.common import arrow_map, as_batch, mix64, slices, temporary, written

ORDERS = (2, 3, 4)
SAMPLE_DOCS, LEAST_COUNT = 2000, 3
TYPICAL = 0.5
#: Slots an n-gram sets, and slots of filter for each n-gram.
HASHES, BITS_EACH = 3, 10
#: Characters counted in one piece, and bytes of texts counted together: some 150 bytes of memory each.
PIECE, BATCH_BYTES = 1 << 20, 1 << 20
UND = "und"


@functools.cache
def letter_table() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)])


def grams(texts: list[str], head: np.ndarray | None = None, more: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts and the row of each; which rows have a letter; and the end of the last text.

    Texts are lower-cased and all that is no letter becomes a single space.  head: the end of what the
    first text continues; more: the last text goes on.
    """
    lower = [t.lower() for t in texts]
    parts = [np.frombuffer(((" " if i or head is None else "") + t + ("" if more and i == len(lower) - 1 else " ")).encode("utf-32-le", "surrogatepass"), np.uint32) for i, t in enumerate(lower)]
    old = 0
    if head is not None and parts:
        parts[0], old = np.concatenate([head, parts[0]]), len(head)
    code = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    letter = letter_table()[code]
    has = np.zeros(len(parts), bool)
    has[row[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    keep[1:] |= row[1:] != row[:-1]  # and one before the first
    keep[:1] = True
    code, row = np.where(letter, code, 32)[keep].astype(np.uint64), row[keep]
    tail = code[row == len(parts) - 1][1 - max(ORDERS) :].astype(np.uint32)
    out_h, out_row = [], []
    for n in ORDERS:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x1F83D9ABFB41BD6B) + code[k : k + m]
        same = row[:m] == row[n - 1 :]
        same[: max(0, old - n + 1)] = False  # counted with what came before
        out_h.append(mix64(h[same]))
        out_row.append(row[:m][same])
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), has, tail
    return np.concatenate(out_h), np.concatenate(out_row), has, tail


def pieces(texts: list[str | None], size: int = PIECE):
    """The texts in lists of at most about ``size`` characters, with the number of the text of each part,
    and whether the last part's text goes on in the next list."""
    owner: list[int] = []
    part: list[str] = []
    held = 0
    for i, text in enumerate(texts):
        at = 0
        text = text or ""
        while at < len(text) or not at:
            stop = min(len(text), at + size - held) if len(text) - at > size else len(text)
            if stop < len(text):
                stop = max(text.rfind(" ", at, stop) + 1, text.rfind("\n", at, stop) + 1) or stop
            owner.append(i)
            part.append(text[at:stop])
            held += stop - at
            at = max(stop, 1)
            if held >= size or at < len(text):
                yield np.array(owner), part, at < len(text)
                owner, part, held = [], [], 0
    if part:
        yield np.array(owner), part, False


def all_grams(texts: list[str | None], size: int = PIECE):
    """Hashes of the n-grams of whole texts and the number of the text of each, in lists; and which texts of a list have a letter."""
    head = None
    for owner, part, more in pieces(texts, size):
        h, row, some, tail = grams(part, head, more)
        head = tail if more else None
        has = np.zeros(len(texts), bool)
        has[owner[some]] = True
        yield h, owner[row], has


def slots_of(h: np.ndarray, turn: int, slots: int) -> np.ndarray:
    return (mix64(h + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) % 2**64)) & np.uint64(slots - 1)).astype(np.int64)


class Filters:
    """The fitted filters: (slots, words of 64 bits), the languages, and each one's covered share."""

    def __init__(self, languages: list[str], slots: np.ndarray, covered: np.ndarray, common: int) -> None:
        self.languages, self.slots, self.covered, self.common = languages, slots, covered, common
        fill = np.array([self.bit(slots, k).mean() if len(slots) else 0.0 for k in range(len(languages))])
        self.false_positive = np.minimum(fill**HASHES, 0.99)

    @staticmethod
    def bit(masks: np.ndarray, k: int) -> np.ndarray:
        return (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score (its share of all languages' evidence), fit (how much of the text it covers)
        and whether the text has a letter."""
        n, known = len(texts), len(self.languages)
        total, hits, has = np.zeros(n), np.zeros((n, known)), np.zeros(n, bool)
        for h, row, some in all_grams(texts):
            has |= some
            if not known:
                continue
            masks = self.slots[slots_of(h, 0, len(self.slots))]
            for turn in range(1, HASHES):
                masks &= self.slots[slots_of(h, turn, len(self.slots))]
            total += np.bincount(row, minlength=n)
            for k in range(known):
                hits[:, k] += np.bincount(row[self.bit(masks, k).astype(bool)], minlength=n)
        if not known:
            return [UND] * n, np.zeros(n), np.zeros(n), has
        real = np.maximum(0, hits - total[:, None] * self.false_positive) / (1 - self.false_positive)
        share = real / np.maximum(total, 1)[:, None] / np.maximum(self.covered, 1e-9)
        best = share.argmax(1)
        top, all_of = share[np.arange(n), best], share.sum(1)
        best = np.where(top > 0, best, self.common)
        score = np.where(has & (all_of > 0), top / np.maximum(all_of, 1e-12), 0.0)
        return [self.languages[b] if ok else UND for b, ok in zip(best.tolist(), has.tolist())], np.minimum(score, 1.0), np.where(has, np.minimum(top, 1.0), 0.0), has


def held_out(doc_id: Column) -> Column:
    """The quarter of documents that training never sees; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Filters:
    """Fit on labelled documents outside the held-out quarter.

    n-gram counts shuffle pre-aggregated; what comes to the driver is at most the filter's slots.
    """
    with temporary(docs.sparkSession):
        return fitted(docs, sample_docs)


def fitted(docs: DataFrame, sample_docs: int) -> Filters:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    seen = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(seen)
    if not languages:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0), 0)
    number = F.create_map(*[F.lit(x) for k, name in enumerate(languages) for x in (name, k)])
    odds = F.create_map(*[F.lit(x) for name in languages for x in (name, min(1.0, sample_docs / seen[name]))])
    picked = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < odds[F.col("lang")] * 1_000_000).select("text", number[F.col("lang")].alias("k"))
    schema = pa.schema([("k", pa.int32()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in slices(batches, BATCH_BYTES, "text"):
            code = np.array(batch.column("k").to_pylist(), np.int32)
            for h, row, _ in all_grams(batch.column("text").to_pylist()):
                k = code[row]
                for one in np.unique(k):
                    gram, n = np.unique(h[k == one], return_counts=True)
                    yield as_batch({"k": np.full(len(gram), one, np.int32), "gram": gram.view(np.int64), "n": n}, schema)

    counts = written(arrow_map(picked, count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")), "n-grams")
    totals = {r.k: r.n for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return Filters([], np.zeros((1, 1), np.uint64), np.zeros(0), 0)

    def of_language(values: dict[int, float]) -> Column:
        return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])[F.col("k")]

    # an n-gram meets itself once for each language that has it
    shares = counts.withColumn("p", F.col("n") / of_language(totals))
    shares = shares.groupBy("gram").agg(F.max("p").alias("most"), F.collect_list(F.struct("k", "n", "p")).alias("x")).select("gram", "most", F.inline("x"))
    least = {k: min(LEAST_COUNT, max(1, n // 1000)) for k, n in totals.items()}
    typical = written(shares.filter((F.col("n") >= of_language(least)) & (F.col("p") >= TYPICAL * F.col("most"))).select("k", "gram", "p"), "typical-n-grams")
    kept = typical.groupBy("k").agg(F.sum("p").alias("covered"), F.count("*").alias("n")).collect()
    covered = np.zeros(len(languages))
    for r in kept:
        covered[r.k] = r.covered
    slots = 1 << 10
    while slots < max((r.n for r in kept), default=0) * BITS_EACH:
        slots *= 2
    words = -(-len(languages) // 64)
    table = np.zeros((slots, words), np.uint64)
    slot_schema = pa.schema([("slot", pa.int64()), ("word", pa.int32()), ("mask", pa.int64())])

    def place(batches):
        for batch in batches:
            h = np.array(batch.column("gram").to_pylist(), np.int64).view(np.uint64)
            k = np.array(batch.column("k").to_pylist(), np.int64)
            mask = (np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64)
            for turn in range(HASHES):
                yield as_batch({"slot": slots_of(h, turn, slots), "word": (k // 64).astype(np.int32), "mask": mask}, slot_schema)

    filled = arrow_map(typical.select("k", "gram"), place, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    got = filled.toArrow()
    table[got["slot"].to_numpy(), got["word"].to_numpy()] = got["mask"].to_numpy().view(np.uint64)
    return Filters(languages, table, covered, max(range(len(languages)), key=lambda k: (seen[languages[k]], -k)))


def identify(docs: DataFrame, filters: Filters | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, fit: one row per document, in one narrow pass over whole texts."""
    model = docs.sparkSession.sparkContext.broadcast(filters or fit(docs))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("fit", pa.float64())])

    def run(batches):
        for batch in slices(batches, BATCH_BYTES, "text"):
            lang, score, close, _ = model.value.predict(batch.column("text").to_pylist())
            yield as_batch({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": lang, "score": score, "fit": close}, schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, fit double")


def keep_identified(docs: DataFrame, least_fit: float = 0.05, filters: Filters | None = None) -> DataFrame:
    """docs without those of no language: no letter, or nearly no n-gram of any learnt language.

    The columns stay as they are.  Without learnt languages nothing can be told, and only texts
    without a letter go.
    """
    model = docs.sparkSession.sparkContext.broadcast(filters or fit(docs))
    names = docs.columns
    place = names.index("text")

    def run(batches):
        for batch in slices(batches, BATCH_BYTES, "text"):
            _, _, close, has = model.value.predict(batch.column(place).to_pylist())
            yield batch.filter(pa.array(has & (close >= least_fit) if model.value.languages else has))

    return arrow_map(docs, run, docs.schema)
