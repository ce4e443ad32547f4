"""Centroid clustering of integer vectors by Exponion search.

Every vector keeps its centroid, an upper bound on the distance to it and a lower bound on the
distance to any other.  When centroids move, the bounds move by as much, and a vector whose upper
bound stays below the lower one (or below half the distance from its centroid to the nearest other)
is not compared at all.  The others scan only the centroids in a ball around their current one: with
``u`` the exact distance to it and ``s`` its distance to the nearest other centroid, a nearer or
second nearest centroid lies within ``2 u + s``, found in the sorted list of distances between
centroids.  The radius is inclusive and bounds are widened by more than their rounding, so that
ties are always scanned; distances are compared as exact integers and the smaller number wins.

A round is one narrow pass: vectors and their bounds are read, searched and written again for the
next round (the table before goes), and each batch adds the sums of the vectors that changed their
cluster, which alone pass the driver, k times the number of components in all.  Nothing is shuffled
by cluster, so a cluster may hold all rows.

Vectors of another length, or with a null or non-finite component, are left out, and so are those
with a scaled component beyond +-2^27, whose distances do not fit 64 bits.  A null vec_id is kept and
hashed as an empty one.  Repeated rows are vectors of their own.  With fewer vectors than k there
are as many centroids as vectors; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltsheaf.llm.common import arrow_map, as_batch, delete, temporary, written, written_at

#: Largest scaled component: 64 squares of a difference of two such stay below 2^63.
MOST = 1 << 27
#: More than the rounding of a bound in a round, relative.
SLACK = 1e-9
STATE = "vec_id long, parts binary, cluster int, upper double, lower double, delta binary"
SCHEMA = pa.schema([("vec_id", pa.int64()), ("parts", pa.binary()), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()), ("delta", pa.binary())])


def scaled(vectors: DataFrame, column: str, components: int, scale: int) -> DataFrame:
    """vec_id, parts: the valid vectors as integers, 32 bits each."""
    x = F.transform(column, lambda v: F.floor(v.cast("double") * scale))
    fits = F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) * scale < MOST))
    rows = vectors.filter(F.col(column).isNotNull() & (F.size(column) == components)).filter(fits).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    schema = pa.schema([("vec_id", pa.int64()), ("parts", pa.binary())])

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype("<i4")
                yield as_batch({"vec_id": batch.column("vec_id"), "parts": packed(x.tobytes(), batch.num_rows)}, schema)

    return arrow_map(rows, pack, "vec_id long, parts binary")


def packed(raw: bytes, n: int) -> pa.Array:
    """raw cut into n equal binaries."""
    ends = np.arange(n + 1, dtype=np.int32) * (len(raw) // max(n, 1))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)])


def unpacked(column: pa.Array, components: int) -> np.ndarray:
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], "<i4")[ends[0] // 4 : ends[-1] // 4].reshape(-1, components)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x from rows of c, as 64-bit integers."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if top * top * 4 * max(1, x.shape[1]) < 1 << 53:  # then every float64 sum below is an exact integer
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, row in enumerate(c):
        d = x.astype(np.int64) - row
        out[:, j] = (d * d).sum(1)
    return out


class Centroids:
    """Centroids with what a round of the search needs: drifts and sorted distances between them."""

    def __init__(self, now: np.ndarray, before: np.ndarray | None):
        self.now = now
        k = len(now)
        between = np.sqrt(squared(now, now).astype(np.float64))
        self.order = np.argsort(between, axis=1, kind="stable")
        self.away = np.take_along_axis(between, self.order, 1)
        np.fill_diagonal(between, np.inf)
        self.nearest = between.min(1) if k > 1 else np.full(k, np.inf)
        self.drift = np.zeros(k) if before is None else np.array([np.sqrt(float(squared(a[None], b[None])[0, 0])) for a, b in zip(now, before)])
        others = np.where(np.eye(k, dtype=bool), 0.0, self.drift[None, :])
        self.others = others.max(1)

    def search(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Moves vectors to their nearest centroids, in place; returns how many centroids were compared."""
        upper += self.drift[cluster]
        upper *= 1 + SLACK
        lower -= self.others[cluster] + SLACK * (np.abs(lower) + self.others[cluster])
        safe = np.maximum(lower, self.nearest[cluster] / 2 * (1 - SLACK))
        todo = np.flatnonzero(upper >= safe)
        held, compared = cluster[todo], len(todo)
        for a in np.unique(held):
            mine = todo[held == a]
            d = squared(x[mine], self.now[a : a + 1])[:, 0]
            upper[mine] = np.sqrt(d.astype(np.float64))
            mine = mine[upper[mine] * (1 + SLACK) >= safe[mine]]
            radius = (2 * upper[mine] + self.nearest[a]) * (1 + SLACK)
            ball = np.searchsorted(self.away[a], radius, side="right")
            for m in np.unique(ball):
                rows = mine[ball == m]
                near = np.sort(self.order[a, :m])  # by number: the first of equal distances wins
                d = squared(x[rows], self.now[near])
                compared += d.size
                best = d.argmin(1)
                at = np.arange(len(rows))
                cluster[rows] = near[best]
                upper[rows] = np.sqrt(d[at, best].astype(np.float64))
                d[at, best] = np.iinfo(np.int64).max
                # the ball holds the second nearest centroid too; its edge bounds what it leaves out
                lower[rows] = np.sqrt(d.min(1).astype(np.float64)) if m > 1 else 1e300
        return compared


def assigned(table: DataFrame, centroids: Centroids, components: int) -> DataFrame:
    """table after a round; the last row of each batch carries the change of counts and sums, if any."""
    k = len(centroids.now)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unpacked(batch.column("parts"), components)
            old = batch.column("cluster").to_numpy(zero_copy_only=False)
            new = np.maximum(old, 0)
            upper, lower = batch.column("upper").to_numpy(zero_copy_only=False).copy(), batch.column("lower").to_numpy(zero_copy_only=False).copy()
            centroids.search(x, new, upper, lower)
            moved = np.flatnonzero(new != old)
            delta = [None] * batch.num_rows
            if len(moved):
                change = np.zeros((k, components + 1), np.int64)
                rows = np.concatenate([np.ones((len(moved), 1), np.int64), x[moved].astype(np.int64)], 1)
                np.add.at(change, new[moved], rows)
                left = old[moved] >= 0
                np.subtract.at(change, old[moved][left], rows[left])
                delta[-1] = change.astype("<i8").tobytes()
            yield as_batch({"vec_id": batch.column("vec_id"), "parts": batch.column("parts"), "cluster": new.astype(np.int32), "upper": upper, "lower": lower, "delta": pa.array(delta, pa.binary())}, SCHEMA)

    return arrow_map(table.select(*SCHEMA.names), run, STATE)


def changes(table: DataFrame, k: int, components: int) -> np.ndarray:
    """The sum of the changes of all batches, k rows of a count and sums; added up in tasks, exactly."""

    def run(batches):
        total = np.zeros(k * (components + 1), object)
        for batch in batches:
            for raw in batch.column("delta").to_pylist():
                total += np.frombuffer(raw, "<i8").astype(object)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(total)), pa.int32()), "n": pa.array([str(v) for v in total], pa.string())})

    parts = arrow_map(table.filter("delta is not null").select("delta"), run, "at int, n string")
    sums = parts.groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()  # k * (components + 1) rows
    out = np.zeros(k * (components + 1), object)
    for r in sums:
        out[r["at"]] = int(r["n"])
    return out.reshape(k, components + 1)


def starts(vectors: DataFrame, k: int, components: int) -> np.ndarray:
    """The k vectors of least sha256 of ``3:<vec_id>``, ties by their components."""
    key = F.sha2(F.concat(F.lit("3:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(key.alias("key"), "parts").orderBy("key", "parts").limit(k).collect()  # k rows
    return np.array([np.frombuffer(r["parts"], "<i4") for r in rows], np.int64).reshape(-1, components)


def clusters(vectors: DataFrame, column: str = "embedding", components: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: one row per valid vector."""
    spark = vectors.sparkSession
    with temporary(spark):
        table = written(scaled(vectors, column, components, scale), "vectors")
        now = starts(table, k, components)
        k = len(now)
        first = table.select("vec_id", "parts", F.lit(-1).alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(0.0).alias("lower"), F.lit(None).cast("binary").alias("delta"))
        before, totals = None, np.zeros((k, components + 1), object)
        state, earlier = first, None
        for _ in range(rounds if k else 0):
            state, path = written_at(assigned(state, Centroids(now, before), components), "round")
            if earlier is not None:
                delete(spark, earlier)
            earlier = path
            totals = totals + changes(state, k, components)
            before = now
            now = np.array([[int(v) // int(row[0]) for v in row[1:]] if row[0] else c.tolist() for row, c in zip(totals, now)], np.int64).reshape(k, components)
        state = assigned(state, Centroids(now, before), components) if k else first
        final = written(with_distances(state, now, components), "clusters", outlast=True)
    names = ", ".join(f"({j}, '{hashlib.sha256(','.join(map(str, c.tolist())).encode()).hexdigest()}')" for j, c in enumerate(now)) or "(0, '')"
    shas = spark.sql(f"SELECT * FROM VALUES {names} AS t(cluster, centroid_sha256)")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = final.groupBy("cluster").agg(exact.alias("s"))  # k rows
    whole = sums.agg(F.expr("try_cast(sum(s) AS bigint)").alias("inertia"))  # one row
    per = sums.select("cluster", F.expr("try_cast(s AS bigint)").alias("cluster_inertia")).join(F.broadcast(shas), "cluster").crossJoin(F.broadcast(whole))
    return final.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def with_distances(table: DataFrame, now: np.ndarray, components: int) -> DataFrame:
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, cluster = unpacked(batch.column("parts"), components), batch.column("cluster").to_numpy(zero_copy_only=False)
                d = np.zeros(len(x), np.int64)
                for a in np.unique(cluster):
                    d[cluster == a] = squared(x[cluster == a], now[a : a + 1])[:, 0]
                yield as_batch({"vec_id": batch.column("vec_id"), "cluster": batch.column("cluster"), "distance": d}, schema)

    return arrow_map(table.select("parts", "vec_id", "cluster"), run, "vec_id long, cluster int, distance long")
