"""File trees and structured files: recordings, layouts, channel tables, per-subject features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltsheaf.sources.sheets import xlsx_table
from voltsheaf.sources.tables import upsert


def listed(spark: SparkSession, base: str, pattern: str = "*") -> DataFrame:
    """path of all files under base whose name fits a glob; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(base).select("path")


def dataset_manifest(spark: SparkSession, datasets: dict[str, dict]) -> DataFrame:
    """dataset, subject, device, line_freq, recordings, empty_rooms, events: one row per subject folder found.

    A dataset names base_dir, task, ending and, if it has them, empty_room_task with its ending,
    event_file_task with its ending, device_type and line_freq.  Subjects without a recording of
    the task keep an empty list; ids that occur in two datasets stay two rows.
    """
    parts = []
    for name, d in datasets.items():
        base = d["base_dir"].rstrip("/")
        marker = base.split("://", 1)[-1].lstrip("/")
        rest = F.element_at(F.split("path", F.lit(rf"\Q{marker}/\E")), -1)
        files = listed(spark, base).select("path", F.split(rest, "/")[0].alias("subject"), F.element_at(F.split("path", "/"), -1).alias("file")).filter(F.contains(rest, F.lit("/")))

        def hits(task: str | None, ending: str | None, d=d):
            if not task or not ending:
                return F.lit(None).cast("string")
            return F.when(F.contains(F.col("file"), F.lit(task)) & F.col("file").endswith(ending), F.col("path"))

        lists = {"recordings": hits(d["task"], d["ending"]), "empty_rooms": hits(d.get("empty_room_task"), d.get("empty_room_ending")), "events": hits(d.get("event_file_task"), d.get("event_file_ending"))}
        parts.append(
            files.groupBy("subject")
            .agg(*[F.sort_array(F.collect_list(c)).alias(k) for k, c in lists.items()])
            .select(F.lit(name).alias("dataset"), "subject", F.lit(d.get("device_type")).cast("string").alias("device"), F.lit(int(d.get("line_freq", 50))).alias("line_freq"), *lists)
        )
    return reduce(lambda a, b: a.unionByName(b), parts)


def device_of(path, given=None):
    """Device by what is given, else by the path or file ending."""
    ending = F.upper(F.element_at(F.split(path, r"\."), -1))
    found = F.when(F.contains(path, F.lit("4D")), "BTI").when(F.contains(path, F.lit(".ds")), "CTF").when(path.endswith(".fif"), "MEGIN").when(path.endswith(".bin"), "ARTEMIS123").otherwise(ending)
    return found if given is None else F.coalesce(given, found)


def layouts(spark: SparkSession, path: str, device: str) -> DataFrame:
    """device, layout, parcel, channel of a layout file: layout -> parcel -> list of channels."""
    kind = "map<string,map<string,array<string>>>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("layout", "parcels"))
    return rows.select(F.lit(device).alias("device"), "layout", F.explode("parcels").alias("parcel", "channels")).select("device", "layout", "parcel", F.explode("channels").alias("channel"))


#: Names under which a device's layouts are kept.
LAYOUT_OF = {"MEGIN": "FIF", "CTF": "DS", "BTI": "4D", "SET": "SET", "EDF": "EDF", "VHDR": "VHDR", "GES": "GES"}


def saved_layouts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Layouts with those of new in place of old ones of the same device and name."""
    return old.join(new.select("device", "layout").distinct(), ["device", "layout"], "left_anti").unionByName(new)


def channel_types(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema("name string, type string").csv(path).withColumn("type", F.lower("type"))


def montage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("Channel string, X double, Y double, Z double").csv(path)


def prepared(samples: DataFrame, types: DataFrame | None = None, positions: DataFrame | None = None) -> DataFrame:
    """samples with type, x, y and z of their channel, from tables as channel_types() and montage() give them.

    The tables hold a row a channel, or if they have a column subject, a row for each recording and channel; of
    repeated names the first in the order of the type or position counts.  Types are in small letters.  A type or position that the samples have already stays
    where the tables know none, and a recording that has any position keeps its own.
    """
    def of(table: DataFrame, name: str, columns: list[str]) -> tuple[DataFrame, list[str]]:
        on = ["subject", "channel"] if "subject" in table.columns else ["channel"]
        named_ = table.withColumnRenamed(name, "channel") if name != "channel" else table
        first = F.min(F.struct(*columns)).alias("__s")
        return named_.groupBy(*on).agg(first).select(*on, *[F.col(f"__s.{c}").alias(f"__{c}") for c in columns]), on

    out = samples
    for c, kind in (("type", "string"), ("x", "double"), ("y", "double"), ("z", "double")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    if types is not None:
        found, on = of(types, "name" if "name" in types.columns else "channel", ["type"])
        out = out.join(found, on, "left").withColumn("type", F.lower(F.coalesce("__type", "type"))).drop("__type")
    if positions is not None:
        lower = positions.withColumnsRenamed({"Channel": "channel", "X": "x", "Y": "y", "Z": "z"})
        found, on = of(lower, "channel", ["x", "y", "z"])
        own = out.filter(F.col("x").isNotNull()).select("subject").distinct().withColumn("__own", F.lit(True))
        out = out.join(found, on, "left").join(own, "subject", "left")
        out = out.withColumns({c: F.when(F.col("__own"), F.col(c)).otherwise(F.col(f"__{c}")) for c in "xyz"}).drop("__own", "__x", "__y", "__z")
    return out.select(*samples.columns, *[c for c in ("type", "x", "y", "z") if c not in samples.columns])


def demographics(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, TSV or XLSX table, all columns as text; other endings raise."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "xlsx":
        return xlsx_table(spark, path)
    sep = {"csv": ",", "tsv": "\t"}.get(ending)
    if sep is None:
        raise ValueError(f"not a CSV, TSV or XLSX file: {path}")
    return spark.read.option("header", True).option("sep", sep).csv(path)


def subject_features(spark: SparkSession, path: str) -> DataFrame:
    """Long features of per-subject wide CSV files (first column: subject; columns feature__band__region).

    Each file has its own columns, so lines are read as text and met with their file's header.
    """
    whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(path, wholetext=True)
    rows = whole.select(F.split("value", "\r?\n").alias("l")).select(F.split(F.col("l")[0], ",").alias("names"), F.explode(F.slice("l", F.lit(2), F.size("l"))).alias("line")).filter("line <> ''")
    cells = F.explode(F.arrays_zip(F.col("names").alias("name"), F.split("line", ",").alias("cell")))
    flat = rows.select(F.split("line", ",")[0].alias("subject"), cells.alias("x")).filter("x.name <> '' and x.name is not null")
    parts = F.split("x.name", "__")
    return flat.filter(F.size(parts) == 3).select("subject", parts[0].alias("feature"), parts[1].alias("band"), parts[2].alias("region"), F.expr("try_cast(nullif(x.cell, '') AS DOUBLE)").alias("value"))


def image_jobs(files: DataFrame) -> DataFrame:
    """subject, session, run and job label of anatomical images listed by path."""
    session, run = (F.nullif(F.regexp_extract("path", p, 1), F.lit("")) for p in ("(ses-[^_/]+)", "(run-[^_/]+)"))
    hit = files.filter(F.col("path").rlike(r"_T1w\.(nii\.gz|nii|mgz)$"))
    return hit.select(F.regexp_extract("path", "(sub-[^_/]+)", 1).alias("subject"), session.alias("session"), run.alias("run"), "path").withColumn("job", F.concat_ws("_", "subject", "session", "run")).distinct()


def write_features(long: DataFrame, path: str, run: str = "features", subjects: DataFrame | None = None) -> int:
    """Features of the subjects of a run in place of their earlier ones; other subjects keep theirs."""
    return upsert(long, "features", path, run, subjects)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("sep", "\t").csv(path)
