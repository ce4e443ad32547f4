"""Packing of tokenised documents into sequences: bounded-space online best fit.

Every task keeps at most OPEN_WINDOWS open windows.  A document first fills whole windows; what is
left goes to the open window with the least room that holds it.  Where none does, a new window is
opened while the bound allows; at the bound the fullest window is topped up with a cut of the
document and emitted, and the rest of the document is placed in the freed space.  So no window
that a task emits has padding.  What the tasks leave open is merged in rounds: the leftovers of
MERGE tasks at a time are strung together and cut into full windows, until one rest under a window
is left, which is cut at powers of two, lengths that need no padding.

A document's tokens are its ids and the end id.  Null or empty text has the end id alone.  Repeated
rows are packed as often as they occur; a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf.llm.bpe import SPACE, RankBpe, resolve
from voltsheaf.llm.common import arrow_map, as_batch, slices, written

WINDOW = 2048
OPEN_WINDOWS = 16
MERGE = 64
#: Sequence ids: the task (or merged group) above, the count within it below.
TASK_SHIFT = 32
#: Classes of characters in the word pattern.
LETTER, NUMBER, BLANK = 1, 2, 3
#: Characters that are cut into words at once; a longer text is cut before white space.
BLOCK_CHARS = 1 << 22
#: Words a worker keeps with their ids, and the most bytes of such a word.
KEPT_WORDS, KEPT_BYTES = 300_000, 32

PIECE = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
        ("task", pa.int64()),
    ]
)
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, task long"
DIGEST = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@functools.cache
def char_classes() -> np.ndarray:
    """The class of each code point: a letter, a number, white space or (0) anything else."""
    every = np.concatenate([np.arange(0xD800, dtype="<u4"), np.arange(0xE000, 0x110000, dtype="<u4")]).tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, f"[{SPACE}]+")):
        for m in regex.finditer(pattern, every):
            out[ord(every[m.start()]) : ord(every[m.end() - 1]) + 1] = kind
    return out


def word_starts(chars: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Marks the characters at which the vocabulary's word pattern begins a match.

    The pattern: 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    chars: code points of texts strung together; first: marks where a text begins.
    """
    kind = char_classes()[chars]
    new = first.copy()
    new[1:] |= kind[1:] != kind[:-1]
    # of white space before a word the last character stands alone, and a space goes with the word
    last = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~first[1:])
    new[last] = True
    new[last[chars[last] == ord(" ")] + 1] = False
    # an apostrophe that begins a match takes one of the endings with it, and a match begins after them
    at = np.flatnonzero((chars == ord("'")) & new)
    for ending in ("s", "t", "re", "ve", "m", "ll", "d"):
        n = len(ending)
        has = at[at + n < len(chars)]
        for i, letter in enumerate(ending, 1):
            has = has[(chars[has + i] == ord(letter)) & ~first[has + i]]
        new[has + 1] = False
        after = has + n + 1
        new[after[after < len(chars)]] = True
    return new


class ByteCoder:
    """Ids of the byte-level vocabulary.

    The texts of a batch are cut into words at once, and each different word is encoded once while
    it is kept.  ``known`` has the places of kept words in ``start`` and ``size``, which say where
    their ids lie in ``ids``; behind these stand the words of the batch at hand that are not kept.
    """

    def __init__(self, path: str) -> None:
        self.bpe = RankBpe(path)
        special = self.bpe.special
        self.known = {s.encode(): i for i, s in enumerate(special)}
        self.used = len(special)
        self.start, self.size, self.ids = np.arange(self.used), np.ones(self.used, np.int64), np.array([*special.values()], "<u4")
        self.specials = re.compile("|".join(map(re.escape, special)))
        self.cut = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")  # a word begins here whatever follows

    def encode(self, texts: list[str]) -> list[bytes]:
        out = self.block([t if len(t) <= BLOCK_CHARS else "" for t in texts])
        for i, t in enumerate(texts):
            if len(t) > BLOCK_CHARS:
                out[i] = self.encode_long(t)
        return out

    def encode_long(self, text: str) -> bytes:
        got, at = [], 0
        while at < len(text):
            m = self.cut.search(text, at + BLOCK_CHARS)
            stop = m.start() if m else len(text)
            got += self.block([text[at:stop]])
            at = stop
        return b"".join(got)

    def block(self, texts: list[str]) -> list[bytes]:
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        data = np.frombuffer(joined.encode(), np.uint8)
        chars = data if len(data) == len(joined) else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        first = np.zeros(len(chars) + 1, bool)
        first[0] = first[ends] = True
        # a special token is a word of its own, and what stands around it are texts of their own
        special = [(end - len(t) + m.start(), end - len(t) + m.end()) for t, end in zip(texts, ends.tolist()) if "<|" in t for m in self.specials.finditer(t)]
        for a, b in special:
            first[a] = first[b] = True
        starts = word_starts(chars, first[:-1])
        for a, b in special:
            starts[a + 1 : b] = False
        word = np.searchsorted(np.flatnonzero(starts), ends)  # the first word after each text
        if chars is not data:
            at = np.zeros(len(data), bool)
            at[(data & 0xC0) != 0x80] = starts
            starts = at
        offsets = np.append(np.flatnonzero(starts), len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        place = self.places(words.dictionary.to_pylist())[words.indices.to_numpy()]
        size = self.size[place]
        after = np.cumsum(size)
        blob = self.ids[np.repeat(self.start[place] - after + size, size) + np.arange(after[-1])].tobytes()
        stops = [0, *(np.append(0, after)[word] * 4).tolist()]
        return [blob[a:b] for a, b in zip(stops, stops[1:])]

    def places(self, words: list[bytes]) -> np.ndarray:
        """The places of different words, which hold until the next call."""
        get = self.known.get
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(out < 0)
        if not len(new):
            return out
        fresh = [words[i] for i in new.tolist()]
        length = np.fromiter(map(len, fresh), np.int64, len(fresh))
        order = np.argsort(length, kind="stable")
        new, fresh = new[order], [fresh[i] for i in order.tolist()]
        coded = self.bpe.encode(fresh)
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        count, most = len(self.known), len(self.known) + len(fresh)
        self.start, self.size = grown(self.start, most), grown(self.size, most)
        self.ids = grown(self.ids, self.used + int(size.sum()))
        self.size[count:most] = size
        self.start[count:most] = self.used + np.cumsum(size) - size
        flat = np.frombuffer(b"".join(coded), "<u4")
        self.ids[self.used : self.used + len(flat)] = flat
        out[new] = np.arange(count, most)
        keep = min(int((length <= KEPT_BYTES).sum()), max(0, KEPT_WORDS - count))
        self.known.update(zip(fresh[:keep], range(count, count + keep)))
        self.used += int(size[:keep].sum())
        return out


def grown(array: np.ndarray, least: int) -> np.ndarray:
    """array, or with half as much room again as is needed a copy that holds ``least`` values."""
    if len(array) >= least:
        return array
    out = np.zeros(least + least // 2, array.dtype)
    out[: len(array)] = array
    return out


@functools.lru_cache(maxsize=2)
def byte_coder(name: str) -> ByteCoder:
    return ByteCoder(resolve(name))


class Packer:
    """The open windows of one task; pieces of emitted windows gather in ``out``.

    A piece is [doc_id, start, ids (bytes), doc_tokens]; windows hold pieces and their fill.
    """

    def __init__(self, task: int, window: int = WINDOW, most: int = OPEN_WINDOWS) -> None:
        self.task, self.window, self.most = task, window, most
        self.open: list[list] = []  # [fill, pieces]
        self.count = 0
        self.out: dict[str, list] = {f.name: [] for f in PIECE}

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, start = len(ids) // 4, 0
        while total - start >= self.window:
            self.emit([self.window, [(doc_id, start, ids[4 * start : 4 * (start + self.window)], total)]])
            start += self.window
        while start < total:
            need = total - start
            fits = [w for w in self.open if self.window - w[0] >= need]
            if fits:
                best = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.most:
                best = [0, []]
                self.open.append(best)
            else:
                best = max(self.open, key=lambda w: w[0])
            n = min(need, self.window - best[0])
            best[1].append((doc_id, start, ids[4 * start : 4 * (start + n)], total))
            best[0] += n
            start += n
            if best[0] == self.window:
                self.open.remove(best)
                self.emit(best)

    def emit(self, window: list, leftover: bool = False) -> None:
        offset, sequence = 0, self.task << TASK_SHIFT | self.count
        self.count += 1
        for doc_id, start, ids, total in window[1]:
            n = len(ids) // 4
            row = (doc_id, start, n, zlib.crc32(ids), total, None if leftover else sequence, offset, ids if leftover else None, self.task)
            for name, value in zip(self.out, row):
                self.out[name].append(value)
            offset += n

    def leave(self) -> None:
        for window in self.open:
            self.emit(window, leftover=True)
        self.open = []

    def take(self) -> pa.RecordBatch:
        out, self.out = self.out, {f.name: [] for f in PIECE}
        return as_batch(out, PIECE)


def tokenised_pieces(docs: DataFrame, vocabulary: str, end_id: int, window: int, most: int) -> DataFrame:
    """Pieces of full windows, and with ids those that each task leaves open."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext

        coder, packer = byte_coder(vocabulary), Packer(TaskContext.get().partitionId(), window, most)
        for batch in slices(batches, 1 << 22, "text"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text").to_pylist())):
                packer.add(doc_id, ids + end)
            yield packer.take()
        packer.leave()
        yield packer.take()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return arrow_map(source, run, PIECE_DDL)


def merged(pieces: DataFrame, task_base: int, window: int, last: bool) -> DataFrame:
    """Leftover pieces of each task group strung together and cut into full windows.

    The rest of a group stays open; in the last round it is cut at powers of two.  A group has the
    open windows of at most MERGE tasks, so it is small whatever the input.
    """

    def run(key, table):
        group = key[0].as_py()
        packer = Packer(task_base + group, window, 1)
        table = table.sort_by([("task", "ascending"), ("doc_id", "ascending"), ("start", "ascending")])
        for doc_id, start, ids, total in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens"))):
            at, n = 0, len(ids) // 4
            while at < n:
                if not packer.open:
                    packer.open.append([0, []])
                held = packer.open[0]
                k = min(n - at, window - held[0])
                held[1].append((doc_id, start + at, ids[4 * at : 4 * (at + k)], total))
                held[0] += k
                at += k
                if held[0] == window:
                    packer.open = []
                    packer.emit(held)
        if last and packer.open:
            rest, pieces_left = packer.open[0]
            packer.open = []
            while rest:
                size = 1 << (rest.bit_length() - 1)
                taken, room = [], size
                while room:
                    doc_id, start, ids, total = pieces_left[0]
                    k = min(room, len(ids) // 4)
                    taken.append((doc_id, start, ids[: 4 * k], total))
                    room -= k
                    if 4 * k == len(ids):
                        pieces_left.pop(0)
                    else:
                        pieces_left[0] = (doc_id, start + k, ids[4 * k :], total)
                packer.emit([size, taken])
                rest -= size
        packer.leave()
        return pa.Table.from_batches([packer.take()], PIECE)

    return pieces.withColumn("group", F.expr(f"task div {MERGE}") if not last else F.lit(0).cast("long")).groupBy("group").applyInArrow(run, PIECE_DDL)


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, window: int = WINDOW, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    Each token lies in exactly one piece, sequence offsets have no gaps.  Texts are not shuffled;
    only the open windows of the tasks are, MERGE tasks to a group.
    """
    first = written(tokenised_pieces(docs, vocabulary, end_id, window, open_windows), "pieces")
    done = [first.filter("sequence_id is not null")]
    left = first.filter("sequence_id is null")
    top = left.agg(F.max("task")).first()[0]
    base = 1 << 24
    while top is not None:
        last = top < MERGE
        step = written(merged(left, base, window, last), "merged-pieces")
        done.append(step.filter("sequence_id is not null"))
        if last:
            break
        left = step.filter("sequence_id is null").withColumn("task", F.col("task") - base)
        base += 1 << 24
        top = left.agg(F.max("task")).first()[0]
    out = done[0].select(*DIGEST)
    for part in done[1:]:
        out = out.unionByName(part.select(*DIGEST))
    return out
