"""BPE encoding and decoding by a contiguous rank array.

A short word is a row of symbol ids with the rank of each adjacent pair beside it.  Every step
scans the ranks for the minimum, deletes that boundary, and refreshes the two neighbouring ranks.
Many words of like length are stepped together as rows of one numpy matrix; ids of frequent words
are kept in a bounded cache.

Null text counts as empty and gives no ids.  Very long words (over LONG_WORD bytes) take a heap of
ranks, since repeated scans of a long array would be quadratic; the merges are the same.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf.llm.common import arrow_map, as_batch, slices

NO_RANK = np.int32(2**31 - 1)
LONG_WORD = 1024
#: Chunks a worker keeps with their ids, and the most characters of such a chunk: 260 MB at most.
#: Longer chunks, and once that is full all others, are encoded in each batch anew.
CACHE_WORDS, CACHE_CHARS = 600_000, 32
#: White space as Unicode has it, which is less than str.split() takes.
SPACE = "\t-\r \x85\xa0  -     　"


@functools.cache
def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def resolve(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class RankBpe:
    """Merges of one vocabulary file; encodes many words (bytes) at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.uint32)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = 19
        self.keys = np.full(1 << self.bits, 0xFFFFFFFF, np.uint32)
        self.ranks = np.full(1 << self.bits, NO_RANK, np.int32)
        self.made = np.zeros(1 << self.bits, np.int32)
        for rank, (k, s, m) in enumerate(zip(key.tolist(), self._slot(key).tolist(), made.tolist())):
            while self.keys[s] != 0xFFFFFFFF and self.keys[s] != k:
                s = (s + 1) & ((1 << self.bits) - 1)
            if self.keys[s] != k:
                self.keys[s], self.ranks[s], self.made[s] = k, rank, m
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            self.strings[i] = token.encode()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of the pairs in the merge table; a slot without rank where no merge exists."""
        key = left.astype(np.uint32) << np.uint32(16) | right.astype(np.uint32)
        slot = self._slot(key)
        miss = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] != 0xFFFFFFFF))
        while len(miss):
            slot[miss] = (slot[miss] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slot[miss]]
            miss = miss[(at != key[miss]) & (at != 0xFFFFFFFF)]
        return slot

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        order = order[size[order] > 0]
        at = 0
        while at < len(order):
            if size[order[at]] > LONG_WORD:
                out[order[at]] = self.encode_long(words[order[at]])
                at += 1
                continue
            wide = int(size[order[at]])
            stop = min(len(order), at + max(64, 65536 // wide))
            limit = min(LONG_WORD, wide + 2 + wide // 4)
            stop = at + int(np.searchsorted(size[order[at:stop]], limit, side="right"))
            self._rows(words, order[at:stop], size[order[at:stop]], out)
            at = stop
        return out

    def _rows(self, words: list[bytes], rows: np.ndarray, size: np.ndarray, out: list[bytes]) -> None:
        n, wide = len(rows), int(size[-1])
        flat = np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8)
        col = np.arange(wide)
        inside = col < size[:, None]
        raw = np.zeros((n, wide), np.uint8)
        raw[inside] = flat
        ids = self.first[raw]
        ids[np.arange(n), size - 1] = self.last[raw[np.arange(n), size - 1]]
        ranks = np.full((n, wide), NO_RANK, np.int32)  # of the pair (i, i + 1)
        if wide > 1:
            pair = inside[:, 1:]
            found = self.ranks[self.find(ids[:, :-1][pair], ids[:, 1:][pair])]
            ranks[:, :-1][pair] = found
        left, who = size.copy(), np.arange(n)
        done_ids, done_left = np.zeros((n, wide), np.int32), size.copy()
        while len(who):
            k = np.arange(len(who))
            m = ranks.argmin(axis=1)
            live = ranks[k, m] != NO_RANK
            if not live.all():
                stopped = ~live
                done_ids[who[stopped], : ids.shape[1]] = ids[stopped]
                done_left[who[stopped]] = left[stopped]
                ids, ranks, left, who, m = ids[live], ranks[live], left[live], who[live], m[live]
                if not len(who):
                    break
                k = np.arange(len(who))
            merged = self.made[self.find(ids[k, m], ids[k, m + 1])]
            take = np.arange(ids.shape[1]) + (np.arange(ids.shape[1]) > m[:, None])
            np.minimum(take, ids.shape[1] - 1, out=take)
            ids = np.take_along_axis(ids, take, 1)
            ranks = np.take_along_axis(ranks, take, 1)
            ids[k, m] = merged
            left -= 1
            ranks[k, left - 1] = NO_RANK
            ranks[k, m] = NO_RANK
            after = np.flatnonzero(m + 1 < left)
            ranks[after, m[after]] = self.ranks[self.find(merged[after], ids[after, m[after] + 1])]
            before = np.flatnonzero(m > 0)
            ranks[before, m[before] - 1] = self.ranks[self.find(ids[before, m[before] - 1], merged[before])]
            wide = int(left.max())
            if wide < ids.shape[1]:
                ids, ranks = ids[:, :wide], ranks[:, :wide]
        blob = done_ids[np.arange(done_ids.shape[1]) < done_left[:, None]].astype("<u4").tobytes()
        ends = (np.cumsum(done_left) * 4).tolist()
        start = 0
        for i, end in zip(rows.tolist(), ends):
            out[i] = blob[start:end]
            start = end

    def encode_long(self, word: bytes) -> bytes:
        """The same merges for one long word, with a heap of (rank, place) and links to neighbours."""
        raw = np.frombuffer(word, np.uint8)
        ids = self.first[raw].tolist()
        ids[-1] = int(self.last[raw[-1]])
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        found = self.ranks[self.find(np.array(ids[:-1]), np.array(ids[1:]))].tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(found) if r != NO_RANK]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            slot = self.find(np.array([ids[i]]), np.array([ids[j]]))[0]
            if self.ranks[slot] != NO_RANK:
                heapq.heappush(heap, (int(self.ranks[slot]), i, ids[i], ids[j]))

        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = int(self.made[self.find(np.array([a]), np.array([b]))[0]])
            alive[j] = False
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return np.array([x for x, ok in zip(ids, alive) if ok], "<u4").tobytes()


class _Known(dict):
    """Ids of words: those kept, then those of the batch at hand."""

    fresh: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        return self.fresh[word]


class ChunkCoder:
    """Ids of texts cut into chunks between spaces, each chunk encoded once while it is kept."""

    def __init__(self, bpe: RankBpe, words: regex.Pattern) -> None:
        self.bpe, self.words, self.known = bpe, words, _Known()

    def learn(self, chunks: set[str]) -> None:
        new = chunks.difference(self.known)
        parts, single = {}, set()
        for c in new:
            if c.isalpha():
                parts[c] = p = (c,)
            elif c[:-1].isalpha() and c[-1] in ".,":
                parts[c] = p = (c[:-1], c[-1])
            else:
                parts[c] = p = self.words.findall(c)
            single.update(p)
        order = list(single)
        ids = dict(zip(order, self.bpe.encode([w.encode() for w in order])))
        got = {c: ids[p[0]] if len(p) == 1 else b"".join([ids[w] for w in p]) for c, p in parts.items()}
        self.known.fresh = got
        if len(self.known) + len(got) <= CACHE_WORDS:
            if max(map(len, got), default=0) > CACHE_CHARS:
                got = {c: x for c, x in got.items() if len(c) <= CACHE_CHARS}
            self.known.update(got)

    def join(self, chunked: list[list[str]]) -> list[bytes]:
        self.learn(set().union(*chunked) if chunked else set())
        get = self.known.__getitem__
        return [b"".join(map(get, chunks)) for chunks in chunked]


class WordEndCoder(ChunkCoder):
    """The lower-casing vocabulary with word ends: white space is dropped, so chunks are independent."""

    def __init__(self, path: str) -> None:
        super().__init__(RankBpe(path), regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"))
        self.specials = re.compile("(" + "|".join(map(re.escape, self.bpe.special)) + ")")

    @staticmethod
    def chunks(text: str) -> list[str]:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower case letter by letter: no final sigma
        return text.lower().replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = self.join([self.chunks(t) if "<|" not in t else [] for t in texts])
        for i, text in enumerate(texts):
            if "<|" in text:
                got = []
                for part in self.specials.split(text):
                    if part in self.bpe.special:
                        got.append(np.array([self.bpe.special[part]], "<u4").tobytes())
                    else:
                        got += self.join([self.chunks(part)])
                plain[i] = b"".join(got)
        return plain

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the token strings joined by spaces: this vocabulary names no decoder."""
        return b" ".join(map(self.bpe.strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def word_end_coder(name: str) -> WordEndCoder:
    return WordEndCoder(resolve(name))


def encode_and_decode(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", text: str = "text", id_column: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded.

    Null or empty text: no tokens, digests of the empty string.  Repeated rows give repeated rows;
    a null id stays null.  The work is one narrow pass: no shuffle.
    """
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += [pa.field("ids", pa.binary()), pa.field("decoded", pa.string())]
        ddl += ", ids binary, decoded string"
    schema = pa.schema(fields)

    def run(batches):
        coder = word_end_coder(vocabulary)
        for batch in slices(batches, 1 << 22, "text"):
            ids = coder.encode(batch.column("text").to_pylist())
            out = {"doc_id": batch.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids]}
            decoded = [coder.decode(x) for x in ids]
            out |= {"decoded_sha256": [hashlib.sha256(x).hexdigest() for x in decoded], "ids": ids}
            if keep_ids:
                out["decoded"] = [x.decode() for x in decoded]
            yield as_batch(out, schema)

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return arrow_map(source, run, ddl)
