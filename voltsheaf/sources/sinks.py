"""Tables that are written again and again by key: a repeated run replaces its own rows and no others.

A table is a folder of commits.  A commit writes its rows and the keys it speaks for under a name of
its own, and exists from the moment its entry in the log is created, a single small file whose
creation fails if its number is taken.  Of each key the rows of the last commit that speaks for it
count.  So a job that fails leaves nothing to see, a reader that began earlier goes on reading the
commits that it found, and two writers at once both land, one after the other.

Rows of a commit lie in ranges of the keys, so a reader of few subjects skips most files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def history(spark: SparkSession, path: str) -> list[dict]:
    """The commits in their order: number, commit, run."""
    place, fs = _files(spark, f"{path}/log")
    if not fs.exists(place):
        return []
    names = sorted(f.getPath().getName() for f in fs.listStatus(place))
    out = []
    for name in names:
        if not name.endswith(".json"):
            continue
        at, commit, run = name[: -len(".json")].split("~")
        out.append({"number": int(at), "commit": commit, "run": run})
    return out


def replace_keys(df: DataFrame, path: str, keys: list[str], run: str, spoken_for: DataFrame | None = None) -> int:
    """Write df so that its rows replace all earlier ones of the same keys; returns the commit's number.

    spoken_for (the key columns): keys that the run covers, also those it found no rows for, whose old
    rows go too.  Without it, they are the keys of df.  A null is a key like any other.
    """
    spark = df.sparkSession
    if not run or any(c in run for c in "~/"):
        raise ValueError("a run has a name without ~ and /")
    commit = uuid.uuid4().hex
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.parquet(f"{path}/rows/{commit}")
    written = spark.read.schema(df.schema).parquet(f"{path}/rows/{commit}").select(*keys)
    covered = written if spoken_for is None else written.unionByName(spoken_for.select(*keys))
    covered.distinct().write.parquet(f"{path}/keys/{commit}")
    number = max((h["number"] for h in history(spark, path)), default=0) + 1
    while True:
        place, fs = _files(spark, f"{path}/log/{number:012d}~{commit}~{run}.json")
        taken = any(h["number"] == number for h in history(spark, path))
        # the number is claimed by a file that can be created once
        claim, _ = _files(spark, f"{path}/claims/{number:012d}")
        if not taken and fs.createNewFile(claim):
            break
        number += 1
    out = fs.create(place, False)
    out.write(bytearray(json.dumps({"number": number, "run": run}).encode()))
    out.close()
    return number


def current(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """The rows that count, as of the commits that are in the log now."""
    commits = history(spark, path)
    if not commits:
        return spark.createDataFrame([], schema)
    kind = spark.createDataFrame([], schema).schema
    names = ", ".join(f"`{k}` {kind[k].dataType.simpleString()}" for k in keys)

    def of(part: str, ddl) -> DataFrame:
        rows = spark.read.schema(ddl).parquet(*[f"{path}/{part}/{c['commit']}" for c in commits])
        commit = F.regexp_extract(F.col("_metadata.file_path"), f"/{part}/([0-9a-f]{{32}})/", 1)
        return rows.select("*", commit.alias("__commit"))

    order = spark.createDataFrame([(c["commit"], c["number"]) for c in commits], "__commit string, __number long")
    keyed = of("keys", names).join(F.broadcast(order), "__commit")
    last = keyed.groupBy(*keys).agg(F.max_by("__commit", "__number").alias("__last")).withColumnsRenamed({k: f"__k_{k}" for k in keys})
    rows = of("rows", kind)
    same = rows["__commit"] == last["__last"]
    for k in keys:
        same = same & rows[k].eqNullSafe(last[f"__k_{k}"])
    return rows.join(last, same, "left_semi").select(*kind.names)


def vacuum(spark: SparkSession, path: str) -> int:
    """Delete the rows of commits that are not in the log (failed runs); returns how many went.

    Only for when no writer is at work: a commit is not in the log before its end.
    """
    known, gone = {c["commit"] for c in history(spark, path)}, 0
    for part in ("rows", "keys"):
        place, fs = _files(spark, f"{path}/{part}")
        if fs.exists(place):
            for f in fs.listStatus(place):
                if f.getPath().getName() not in known:
                    fs.delete(f.getPath(), True)
                    gone += part == "rows"
    return gone
