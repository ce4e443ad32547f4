"""The prefix trie of conversations, built level by level.

Turns become digests of (role, text) with their size, and are numbered within their conversation by
prefix counts over ranges of the order, so that a conversation may hold a third of all rows.  Then,
depth by depth, live conversations meet their next turn and are grouped by (parent node, turn); the
least conv_id of a group names the child.  A conversation alone in its node leaves the loop: the rest
of it is a chain.  So the rounds are as many as the deepest prefix that two conversations share.
Children's leaves and savings go up by a join for each level, from the deepest.

A group may hold any share of the conversations: groups are counted on the map side, and what
conversations learn of their group comes from a broadcast of the shared groups where they are few,
else of the at most HOT largest ones, with a shuffled join for the rest.  The ids that end at a node
are sorted by ranges, joined to strings there, and digested in order, a piece of text at a time; the
digest is sequential by nature, so the pieces of one node end in one task, which holds one of them.

Turns are in the order of turn, a null one first; turns of equal number are in the order of their
digests.  Null roles and texts are empty.  Rows without a conv_id belong to no conversation and are
left out.  Repeated rows are turns of their own.  An empty table has no nodes.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltsheaf.llm.common import arrow_map, as_batch, sized_broadcast, temporary, written

#: Conversations come in families of this many, by their id; a member begins as the family's first.
FAMILY = 5
#: A member takes fewer than this many turns of the family's first.
SHARED = 9
#: Groups of over 1/HOT of a level's conversations are broadcast.
HOT = 500
#: Ids in a piece of text that is digested at a time.
PIECE_IDS = 8192
BROADCAST_BYTES = 48 << 20
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, number (from 0), digest, bytes: the turns in their order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes")
    )
    # repeated rows are equal in all columns: a number of their own lets ranges part them
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("tie").asc()]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    schema = pa.schema([("conv_id", pa.int64()), ("range", pa.int32()), ("place", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int64())])

    def run(batches):
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            head = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
            size = np.diff(np.r_[head, len(ids)])
            place = np.arange(len(ids)) - np.repeat(head, size)
            if ids[0] == last:
                place[: size[0]] += seen
            last, seen = ids[-1], int(place[-1]) + 1
            yield as_batch({"conv_id": batch.column("conv_id"), "range": batch.column("range"), "place": place, "digest": batch.column("digest"), "bytes": batch.column("bytes")}, schema)

    placed = written(arrow_map(ranged.select("conv_id", "range", "digest", "bytes"), run, "conv_id long, range int, place long, digest binary, bytes long"), "placed")
    counts = placed.groupBy("conv_id", "range").agg(F.count("*").alias("n"))
    cut = counts.groupBy("conv_id").agg(F.count("*").alias("ranges")).filter("ranges > 1").select("conv_id")  # at most one for each edge of a range
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = counts.join(F.broadcast(cut), "conv_id").select("conv_id", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(written(offsets, "offsets")), ["conv_id", "range"], "left").select("conv_id", (F.col("place") + F.coalesce("offset", F.lit(0))).alias("number"), "digest", "bytes")


def taken(conv_id: Column) -> Column:
    """How many turns a conversation takes from its family's first."""
    return F.crc32(conv_id.cast("string").cast("binary")) % SHARED


def family(conv_id: Column) -> Column:
    return conv_id - conv_id % FAMILY


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: conv_id, depth (from 1), digest, bytes of every turn; and conv_id, length.

    A turn is in one of two parts: own turns after the first h, and turns of the family's first
    before h.  A conversation's length is known from the two counts.
    """
    own = written(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    first = own.select(F.col("conv_id").alias("first_id"), F.col("n").alias("n_first"))
    h = taken(F.col("conv_id"))
    sized = own.join(first, family(F.col("conv_id")) == F.col("first_id"), "left").select("conv_id", "n", F.least(h, F.coalesce("n_first", F.lit(0))).alias("head"), h.alias("h"))
    sized = sized.withColumn("head", F.when(F.col("conv_id") == family(F.col("conv_id")), F.least("h", "n")).otherwise(F.col("head")))
    sizes = written(sized.select("conv_id", "h", "head", (F.col("head") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")), "lengths")
    moved = sized_broadcast(sizes.filter("head < h").select("conv_id", "head"), BROADCAST_BYTES)
    rest = turns.filter(F.col("number") >= h).join(moved, "conv_id", "left").select("conv_id", (F.coalesce("head", h) + F.col("number") - h + 1).alias("depth"), "digest", "bytes")
    heads = turns.filter((F.col("number") < SHARED - 1) & (F.col("conv_id") % FAMILY == 0))
    members = heads.withColumn("member", F.explode(F.sequence(F.col("conv_id") - (FAMILY - 1), F.col("conv_id") + (FAMILY - 1)))).filter((family(F.col("member")) == F.col("conv_id")) & (F.col("number") < taken(F.col("member"))))
    members = members.select(F.col("member").alias("conv_id"), (F.col("number") + 1).alias("depth"), "digest", "bytes").join(own.select("conv_id"), "conv_id", "left_semi")
    both = rest.unionByName(members)
    # files in ranges of depth: a level reads its own
    return written(both.repartitionByRange("depth", "conv_id").sortWithinPartitions("depth", "conv_id"), "turns"), sizes.select("conv_id", "length")


def with_group(rows: DataFrame, groups: DataFrame, keys: list[str], most_bytes: int) -> DataFrame:
    """rows (n of them in a group) joined to their group (keys, child, n), whatever the groups' sizes."""
    facts = groups.agg(F.count("*").alias("groups"), F.sum("n").alias("n")).first()
    narrow = groups.select(*keys, "child", "n")
    if facts["groups"] * 160 <= most_bytes:
        return rows.join(F.broadcast(narrow), keys)
    is_hot = F.col("n") * HOT > facts["n"]
    hot = narrow.filter(is_hot)  # fewer than HOT groups
    met = rows.join(F.broadcast(hot), keys, "left")
    rest = met.filter("child is null").select(*rows.columns).join(narrow.filter(~is_hot), keys)
    return met.filter("child is not null").unionByName(rest)


def ends(rows: DataFrame) -> DataFrame:
    """depth, node, ends_sha256 of rows (depth, node, conv_id): the digest of the ids, in order, comma-joined."""
    order = ["depth", "node", "conv_id"]
    schema = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("first_id", pa.int64()), ("ids", pa.string())])

    def pieces(batches):
        for batch in batches:
            depth, node, ids = (batch.column(c).to_numpy() for c in order)
            head = np.r_[True, (depth[1:] != depth[:-1]) | (node[1:] != node[:-1])] if len(ids) else np.zeros(0, bool)
            cut = np.flatnonzero(head).tolist()
            for a, b in zip(cut, [*cut[1:], len(ids)]):
                at = range(a, b, PIECE_IDS)
                yield as_batch({"depth": [int(depth[a])] * len(at), "node": [int(node[a])] * len(at), "first_id": [int(ids[i]) for i in at], "ids": [",".join(map(str, ids[i : min(i + PIECE_IDS, b)].tolist())) for i in at]}, schema)

    texts = arrow_map(rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), pieces, "depth long, node long, first_id long, ids string")
    out = pa.schema([("depth", pa.int64()), ("node", pa.int64()), ("ends_sha256", pa.string())])

    def digests(batches):
        key, digest = None, None
        for batch in batches:
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids"))):
                if (depth, node) == key:
                    digest.update(b"," + ids.encode())
                    continue
                if key is not None:
                    yield as_batch({"depth": [key[0]], "node": [key[1]], "ends_sha256": [digest.hexdigest()]}, out)
                key, digest = (depth, node), hashlib.sha256(ids.encode())
        if key is not None:
            yield as_batch({"depth": [key[0]], "node": [key[1]], "ends_sha256": [digest.hexdigest()]}, out)

    return arrow_map(texts.repartition("depth", "node").sortWithinPartitions("depth", "node", "first_id").select("depth", "node", "ids"), digests, "depth long, node long, ends_sha256 string")


def chains(alone: DataFrame) -> DataFrame:
    """The nodes of conversations that share none of their further turns: conv_id, parent, start (the first such depth), length."""
    block = 4096
    spread = alone.withColumn("b", F.explode(F.expr(f"sequence(0L, (length - start) div {block})")))
    deep = spread.withColumn("depth", F.explode(F.expr(f"sequence(start + b * {block}, least(length, start + b * {block} + {block - 1}))")))
    last = F.col("depth") == F.col("length")
    return deep.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )


def trie(conversations: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per node."""
    with temporary(conversations.sparkSession):
        turns, lengths = rebuilt(numbered(conversations))
        root = written(lengths.agg(F.min("conv_id").alias("child"), F.count("*").alias("n")).filter("n > 0").select("child", "n", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes")), "root")
        # level by level: steps are live conversations with their next turn, groups are the nodes they come to
        live = lengths.crossJoin(F.broadcast(root.select(F.col("child").alias("parent"))))  # one row
        ended = [live.filter("length = 0").select(F.lit(0).cast("long").alias("depth"), F.col("parent").alias("node"), "conv_id")]
        levels, alone, depth = [root], [], 0
        while True:
            depth += 1
            now = turns.filter(F.col("depth") == depth).select("conv_id", "digest", "bytes")
            steps = written(live.filter(F.col("length") >= depth).join(now, "conv_id").select("conv_id", "parent", "digest", "bytes", "length"), "steps")
            groups = steps.groupBy("parent", "digest").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.first("bytes").alias("bytes"), F.max("length").alias("length")).withColumn("depth", F.lit(depth).cast("long"))
            groups = written(groups, "groups")
            alone.append(groups.filter("n = 1").select(F.col("child").alias("conv_id"), "parent", F.col("depth").alias("start"), "length"))
            shared = groups.filter("n > 1").drop("length")
            if shared.isEmpty():
                break
            levels.append(shared)
            live = with_group(steps.select("conv_id", "parent", "digest", "length"), shared, ["parent", "digest"], most_bytes).select("conv_id", F.col("child").alias("parent"), "length")
            ended.append(live.filter(F.col("length") == depth).select(F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("node"), "conv_id"))
        single = written(reduce(DataFrame.unionByName, alone), "alone")
        digests = written(ends(reduce(DataFrame.unionByName, ended)), "ends")
        # and back: what the children have goes to their parents
        tops = written(single.groupBy(F.col("start").alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("tops")), "tops")
        done, below = [], None
        for level, nodes in reversed(list(enumerate(levels))):
            own = nodes.join(tops.filter(F.col("depth") == level + 1).select(F.col("node").alias("child"), "tops"), "child", "left").withColumn("tops", F.coalesce("tops", F.lit(0)))
            if below is not None:
                sums = below.groupBy(F.col("parent").alias("child")).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
                own = own.join(sums, "child", "left")
            else:
                own = own.withColumns({c: F.lit(0).cast("long") for c in "cls"})
            c, n_leaves, s = (F.coalesce(x, F.lit(0)) for x in "cls")
            children = F.col("tops") + c
            own = own.select("child", "depth", "parent", "n", children.alias("n_children"), F.when(children == 0, 1).otherwise(F.col("tops") + n_leaves).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("bytes") + s).alias("saved_tokens"))
            below = written(own, "rolled")
            done.append(below)
        nodes = reduce(DataFrame.unionByName, done)
        of = digests.withColumnsRenamed({"depth": "__depth"})
        nodes = nodes.join(of, (nodes.child == of.node) & (nodes.depth == F.col("__depth")), "left")
        shared = nodes.select(F.col("child").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))
        return written(shared.unionByName(chains(single)), "trie", outlast=True)
