"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch: long documents then stay within tens of MB of a Python worker.
ARROW_ROWS, ARROW_BYTES = 1000, 32 << 20
#: A key table of at most this many bytes is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 48 << 20
#: Bytes that a value of a type takes in a broadcast relation; strings and binaries are keys of up to 64 bytes.
WIDTHS = {"boolean": 8, "int": 8, "bigint": 8, "double": 8, "string": 80, "binary": 48}
#: Paths written since each temporary() block that is open began, the innermost last.
_open_blocks: ContextVar[tuple[list[str], ...]] = ContextVar("open_blocks", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    Where the session names none, a local master gets a folder of its own; on a cluster that is an
    error, since what executors write to their own disks cannot be read back by others.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="voltsheaf-")
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/voltsheaf/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, outlast: bool = False) -> DataFrame:
    """df as a table in the shared folder: it survives lost executors and is computed once.

    Inside a temporary() block it goes with the block, or if it is to outlast it, with the block
    around that one; outside it stays until the folder is cleaned.
    """
    return written_at(df, name, outlast)[0]


def written_at(df: DataFrame, name: str, outlast: bool = False) -> tuple[DataFrame, str]:
    """As written(), with the path of the table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    blocks = _open_blocks.get()
    if len(blocks) > outlast:
        blocks[-2 if outlast else -1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Deletes at its end the tables that were written inside; what lasts must not read them."""
    mine: list[str] = []
    token = _open_blocks.set((*_open_blocks.get(), mine))
    try:
        yield
    finally:
        _open_blocks.reset(token)
        for path in mine:
            delete(spark, path)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by rows and bytes, unless the session already asks for smaller ones."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(key, None) or 0)
        if not now.isdigit() or not 0 < int(now) <= most:  # 0 and below: no bound
            spark.conf.set(key, str(most))


def row_bytes(df: DataFrame) -> int:
    """About what a row of a table of flat keys takes in a broadcast relation."""
    return 64 + sum(sum(WIDTHS.get(g.dataType.simpleString(), 48) for g in f.dataType.fields) if f.dataType.typeName() == "struct" else WIDTHS.get(f.dataType.simpleString(), 48) for f in df.schema.fields)


def sized_broadcast(keys: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """keys with a broadcast hint if it takes at most ``most_bytes``, else as it is (a shuffled join)."""
    most = most_bytes // row_bytes(keys)
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with bounded batches; fn takes and gives an iterator of record batches."""
    small_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n+1 offsets of its values; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (wrapping arithmetic on uint64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)


def slices(batches: Iterator[pa.RecordBatch], most_bytes: int, column: str) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that a string column holds at most about ``most_bytes`` in each."""
    for batch in batches:
        _, offsets = utf8_parts(batch.column(batch.schema.get_field_index(column)))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(offsets, offsets[start] + most_bytes, side="right")) - 1
            stop = min(max(stop, start + 1), batch.num_rows)
            yield batch.slice(start, stop - start)
            start = stop
