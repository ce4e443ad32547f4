"""MinHash near-dedup by BagMinHash.

The multiset of a text's five-word shingles is hashed by Poisson processes over its discretised
weights.  The weight axis of a shingle is cut into strips [0, 1), [1, 2), [2, 4), [4, 8) and so on;
each strip has a process whose rate is its length, whose points fall to one of SIZE components and
to a height within the strip.  A shingle of weight w takes the points below w: all those of whole
strips, and of the strip that w cuts those of lesser height.  Each component keeps its first point;
a process stops once its next point lies beyond all components.  Two texts agree in a component
with a probability equal to their weighted Jaccard similarity, the multiset overlap.

The first BANDED components are banded.  A text that shares buckets with many is central; each text
is first compared with the most and the least central of the centres of its buckets, and the links
found make classes, in groups of copies of one original nearly all of them.  Where a bucket still
holds several classes, its texts outside its commonest class are set against all of it, block by
block by their signatures, and verified against those of other classes that agree with them best:
TOP of them in the first round, and in the last all that may reach the threshold, by when few are
left.  In that round the blocks carry their texts and only links leave them, so that a group whose
texts are all a little less alike than the threshold makes no rows of pairs (pairs with a text of
over BLOCK_CHARS go on as rows).  All links are verified on the multisets of the whole texts.  Equal
texts are taken together first.  Classes are connected components.

Null text counts as empty; texts without words are only near texts equal to them.  Texts of fewer
than five words have one shingle of all their words.  A null doc_id is smaller than any other.
A text is hashed in one piece, some 100 bytes of a worker's memory for each of its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltsheaf.llm.common import arrow_map, as_batch, mix64, sized_broadcast, slices, temporary, written
from voltsheaf.llm.fingerprints import shingles, word_hashes

SIZE, BANDED, ROWS = 512, 128, 4
THRESHOLD = 0.8
#: Pairs of texts whose signatures, of four bits a component, estimate less are below the threshold
#: (4 deviations of 0.0184).
ESTIMATE = 0.726
BLOCK, BLOCK_CHARS = 256, 16_384
#: Points drawn in one array.
POINTS = 1 << 18
#: Rounds: how many bands they look at, and how many texts of other classes each text is verified
#: against; the last looks at all bands and takes all texts.
TURNS = ((8, 4), (BANDED // ROWS, None))


def weighted(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and weight of each distinct shingle of each text."""
    h, row = shingles(*word_hashes(texts))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]) if len(h) else np.zeros(0, np.int64)
    return row[first], h[first], np.diff(np.r_[first, len(h)])


def bag_min_hash(texts: list[str], size: int = SIZE) -> np.ndarray:
    """First points of the components, an (n, size) array of doubles; infinite without shingles."""
    row, h, weight = weighted(texts)
    least = np.full(len(texts) * size, np.inf)
    strips = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)  # strips that reach below w
    item = np.repeat(np.arange(len(h)), strips)
    strip = np.arange(len(item)) - np.repeat(np.cumsum(strips) - strips, strips)
    floor = np.where(strip > 0, 2.0 ** np.maximum(strip - 1, 0), 0.0)
    length = np.maximum(floor, 1.0)
    seed = mix64(h[item] + strip.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    row, weight, since = row[item], weight[item].astype(np.float64), np.zeros(len(item))
    done, more = 0, 1  # points of each process drawn so far, and at the next turn: texts of few shingles need many
    while len(seed):
        turn = np.arange(done + 1, done + more + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for at in range(0, len(seed), step := max(1, POINTS // more)):
            part = slice(at, at + step)
            a = mix64(seed[part, None] + turn)
            gap = np.log(((a >> np.uint64(11)) + 0.5) * 2.0**-53) / (-size * length[part, None])
            gap[:, 0] += since[part]
            x = np.cumsum(gap, axis=1)
            since[part] = x[:, -1]
            b = mix64(a)
            low = floor[part, None] + ((b >> np.uint64(16)) * 2.0**-48) * length[part, None] < weight[part, None]
            slot = row[part, None] * size + ((b & np.uint64(0xFFFF)) % np.uint64(size)).astype(np.int64)
            won = low & (x < least[slot])
            np.minimum.at(least, slot[won], x[won])
        live = since < least.reshape(-1, size).max(1)[row]
        seed, since, row, weight, floor, length = seed[live], since[live], row[live], weight[live], floor[live], length[live]
        done, more = done + more, 2 * more
    return least.reshape(-1, size)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Multiset overlap of two texts, given as hashes and weights: the sum of least weights over the sum of greatest."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes and weights of the shingles of each text."""
    row, h, w = weighted(texts)
    ends = np.searchsorted(row, np.arange(len(texts) + 1))
    return [(h[i:j], w[i:j]) for i, j in zip(ends.tolist(), ends[1:].tolist())]


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number for each row), sha, bands (null without words), sig (4 bits a component)."""
    schema = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("sha", pa.binary()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())])

    def run(batches):
        for batch in slices(batches, 1 << 21, "text"):
            least = bag_min_hash(batch.column("text").to_pylist())
            bits = mix64(np.ascontiguousarray(least).view(np.uint64))
            band = np.zeros((len(least), BANDED // ROWS), np.uint64)
            for k in range(ROWS):
                band = mix64(band * np.uint64(0x9E3779B97F4A7C15) + bits[:, k:BANDED:ROWS] + np.arange(BANDED // ROWS, dtype=np.uint64))
            some = np.isfinite(least[:, 0])
            four = (bits & np.uint64(15)).astype(np.uint8)
            sig = four[:, 0::2] | four[:, 1::2] << 4
            ends = pa.array(np.r_[0, np.cumsum(some * band.shape[1])], pa.int32(), mask=np.r_[~some, False])
            bands = pa.ListArray.from_arrays(ends, pa.array(band[some].view(np.int64).ravel()))
            yield as_batch({"doc_id": batch.column("doc_id"), "row": batch.column("row"), "sha": batch.column("sha"), "bands": bands, "sig": [s.tobytes() for s in sig]}, schema)

    rows = keyed(docs).withColumn("row", F.monotonically_increasing_id())
    return arrow_map(rows.select("doc_id", "row", "sha", "text"), run, "doc_id long, row long, sha binary, bands array<long>, sig binary")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and sha, the digest of the text that tells equal texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumn("sha", F.unhex(F.sha2("text", 256)))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of edges (a, b).

    Rounds of large-star and small-star steps, each a grouped minimum and a join; a component's
    links never meet in one task, and edges become stars in a logarithmic number of rounds.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    with temporary(edges.sparkSession):
        edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
        last = state(edges)
        while last[0]:
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            large = written(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large-star")
            low = large.groupBy("a").agg(F.min("b").alias("m"))
            edges = written(large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "small-star")
            now = state(edges)
            if now == last:
                break
            last = now
        found = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        return written(found, "components", outlast=True)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """a, b, near: whether the multisets of the two texts overlap by the threshold."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("near", pa.bool_())])

    def run(batches):
        for batch in slices(slices(batches, 1 << 22, "x"), 1 << 22, "y"):
            a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
            texts = dict(zip(a, x)) | dict(zip(b, y))  # each text of a batch is hashed once
            bag = dict(zip(texts, bags(list(texts.values()))))
            near = [overlap(bag[i], bag[j]) >= threshold for i, j in zip(a, b)]
            yield as_batch({"a": batch.column("a"), "b": batch.column("b"), "near": near}, schema)

    first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
    both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return written(arrow_map(both.select("a", "b", "x", "y"), run, "a long, b long, near boolean"), "verified")


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures: equal fours of bits, less those equal by chance."""
    x = one ^ many
    x |= x >> np.uint64(2)
    differ = np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x1111111111111111)).sum(1)
    return (1 - differ / SIZE - 1 / 16) / (15 / 16)


def stars(members: DataFrame, sigs: DataFrame) -> DataFrame:
    """a, b: each text with the most and the least central centre of its buckets, where signatures allow it.

    members: band, node, k (the bucket's size).  How many texts one shares its buckets with tells how
    central it is; the centre of a bucket is its most central text (ties: the largest node).
    """
    central = members.groupBy("node").agg(F.sum("k").alias("pop"))
    centres = members.select("band", "node").join(central, "node").groupBy("band").agg(F.max(F.struct("pop", "node")).alias("c"))
    two = members.select("band", "node").join(sized_broadcast(written(centres, "centres")), "band").groupBy("node").agg(F.max("c").alias("most"), F.min("c").alias("least"))
    pairs = two.select(F.col("node").alias("a"), F.explode(F.array_distinct(F.array("most.node", "least.node"))).alias("b")).filter("a <> b")
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in ("x", "y"))
            yield batch.filter(pa.array(estimates(x, y) >= ESTIMATE)).select(["a", "b"]).cast(schema)

    both = pairs.join(sigs.select(F.col("node").alias("a"), F.col("sig").alias("x")), "a").join(sigs.select(F.col("node").alias("b"), F.col("sig").alias("y")), "b")
    return arrow_map(both.select("a", "b", "x", "y"), run, "a long, b long")


def block_pairs(members: DataFrame, sigs: DataFrame, top: int | None, texts: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, sure: pairs of different classes in one bucket whose signatures agree enough.

    members: band, j (which band), node, cls; sigs: node, sig, bands; texts: node, text.  In each
    bucket the texts outside its commonest class are set against all, BLOCK by BLOCK, so that pairs
    are never rows before their signatures are compared; each such text gives its ``top`` best
    partners, or all.  With texts, pairs of short texts are verified at once and only links are given
    (sure).  A pair counts in the first bucket that it shares alone.  Signatures and texts travel only
    to buckets of several classes.
    """
    split = members.groupBy("band", "cls").agg(F.count("*").alias("k"))
    shape = split.groupBy("band").agg(F.max(F.struct("k", "cls")).alias("top"), F.sum("k").alias("n"), F.count("*").alias("classes")).filter("classes > 1")
    shape = written(shape.select("band", F.col("top.cls").alias("common"), "n", (F.col("n") - F.col("top.k")).alias("others")), "buckets-of-classes")
    carried = sigs.withColumn("text", F.lit(None).cast("string")) if texts is None else sigs.join(texts.filter(F.length("text") <= BLOCK_CHARS), "node", "left")
    placed = members.join(sized_broadcast(shape), "band").join(carried, "node")
    # of the bands before j, 31 bits each
    low = F.transform(F.slice("bands", F.lit(1), F.col("j")), lambda b: b.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    placed = placed.select("band", "j", "common", "n", "others", F.struct("node", "cls", "sig", low.alias("bands"), "text").alias("m"))
    # a block of texts is one row: blocks of a bucket meet, never texts

    def blocks(rows: DataFrame, size: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("m.node"), F.ceil(F.col(size) / BLOCK).cast("long"))
        return rows.groupBy("band", "j", block.alias("block")).agg(F.collect_list("m").alias(name)).drop("block")

    asked = blocks(placed.filter("m.cls <> common"), "others", "x").drop("j")
    schema = pa.schema([("q", pa.int64()), ("p", pa.int64()), ("est", pa.float64()), ("sure", pa.bool_())])

    def side(rows: list[dict]) -> tuple[np.ndarray, ...]:
        sig = np.frombuffer(b"".join([m["sig"] for m in rows]), np.uint64).reshape(len(rows), -1)
        return (sig, *(np.array([m[c] for m in rows]) for c in ("cls", "node", "bands")))

    def linked(pairs: list[tuple[int, int, float]], text: dict[int, str | None]) -> list[tuple[int, int, float, bool]]:
        """Pairs with whether they are sure to be links; those of short texts that are no links go."""
        short = {i for q, p, _ in pairs if text[q] is not None and text[p] is not None for i in (q, p)}
        bag = dict(zip(short, bags([text[i] for i in short])))
        found = [(q, p, est, q in bag and p in bag) for q, p, est in pairs]
        return [f for f in found if not f[3] or overlap(bag[f[0]], bag[f[1]]) >= threshold]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                j, x, y = (batch.column(c)[i].as_py() for c in ("j", "x", "y"))
                pairs: list[tuple[int, int, float]] = []
                (sx, cx, nx, bx), (sy, cy, ny, by) = side(x), side(y)
                for k in range(len(nx)):
                    est = estimates(sx[k], sy)
                    hit = np.flatnonzero((est >= ESTIMATE) & (cy != cx[k]))
                    if j:
                        hit = hit[(by[hit] != bx[k]).all(1)]
                    if top is not None and len(hit) > top:
                        hit = hit[np.argpartition(-est[hit], top)[:top]]
                    pairs += [(int(nx[k]), p, e) for p, e in zip(ny[hit].tolist(), est[hit].tolist())]
                if pairs:
                    rows = linked(pairs, {m["node"]: m["text"] for m in (*x, *y)})
                    yield as_batch(dict(zip(schema.names, zip(*rows) if rows else ([], [], [], []))), schema)

    pairs = arrow_map(asked.join(blocks(placed, "n", "y"), "band").select("j", "x", "y"), run, "q long, p long, est double, sure boolean")
    if top is not None:
        pairs = pairs.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("est"), "p"))).filter(F.col("place") <= top)
    return pairs.groupBy(F.greatest("q", "p").alias("a"), F.least("q", "p").alias("b")).agg(F.max("sure").alias("sure"))


def near_groups(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), group_size, kept, text_sha256: one row per row.

    One row of each class is kept, a row of class_id.
    """
    spark = docs.sparkSession
    rows = written(signed(docs), "bag-min-hash")
    with temporary(spark):
        # equal texts are one node, the least of their rows
        same = written(rows.groupBy("sha").agg(F.min("row").alias("node"), F.min(F.struct("doc_id", "row")).alias("best"), F.count("*").alias("n")).filter("n > 1"), "equal-texts")
        copies = written(rows.select("sha", "row").join(sized_broadcast(same.select("sha", "node")), "sha").filter("row <> node").select(F.col("row").alias("node")), "copies")
        nodes = rows.withColumnRenamed("row", "node").join(sized_broadcast(copies), "node", "left_anti")
        banded = nodes.select("node", F.posexplode("bands").alias("j", "band"))
        buckets = written(banded.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1"), "buckets")
        members = written(banded.join(sized_broadcast(buckets), "band"), "members")
        needed = sized_broadcast(written(members.select("node").distinct(), "needed"))
        chosen = nodes.join(needed, "node", "left_semi")
        sigs = chosen.select("node", "sig", "bands")
        wanted = sized_broadcast(written(chosen.select("node", "sha", F.col("doc_id").alias("id")), "wanted"))
        source = keyed(docs)
        found = source.join(wanted, (source.sha == wanted.sha) & source.doc_id.eqNullSafe(F.col("id"))).select("node", "text")
        texts = written(found.dropDuplicates(["node"]), "texts")

        tried = verified(written(stars(members, sigs), "stars"), texts, threshold)
        label = components(tried.filter("near"))
        for bands, top in TURNS:
            inside = members.filter(F.col("j") < bands).select("band", "j", "node").join(label, "node", "left").select("band", "j", "node", F.coalesce("root", "node").alias("cls"))
            found = written(block_pairs(inside, sigs, top, None if top else texts, threshold).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
            if found.isEmpty():
                continue
            seen = verified(found.filter("not sure").select("a", "b"), texts, threshold)
            tried = tried.unionByName(seen)
            links = found.filter("sure").select("a", "b").unionByName(seen.filter("near").select("a", "b"))
            label = components(links.unionByName(label.select(F.col("node").alias("a"), F.col("root").alias("b"))))

        # of each class of several rows: whose it is, and what they know of it
        linked = label.join(nodes.select("node", "sha", F.struct("doc_id", F.col("node").alias("row")).alias("own")), "node")
        alone = same.join(label.select("node"), "node", "left_anti").select("sha", F.col("node").alias("root"), "best", "n")
        known = linked.join(same.select("node", "best", "n"), "node", "left").select("sha", "root", F.coalesce("best", "own").alias("best"), F.coalesce("n", F.lit(1).cast("long")).alias("n"))
        whole = written(known.unionByName(alone), "classes")
        groups = whole.groupBy("root").agg(F.min("best").alias("first"), F.sum("n").alias("group_size"))
        table = written(whole.select("sha", "root").join(groups, "root").select("sha", "first", "group_size"), "groups", outlast=True)
    return rows.join(sized_broadcast(table), "sha", "left").select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (F.col("first").isNull() | (F.col("first.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each class; the columns stay as they are."""
    from voltsheaf.llm.exact_dedup import keep_marked

    return keep_marked(docs, near_groups)
