"""Cohort tables: manifests, demographics, joins, cleaning, reshaping."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltsheaf.functions.spectral import mapped


def with_demographics(features: DataFrame, demographics: list[tuple[str, DataFrame]], key: str = "participant_id", drop: tuple = ("eyes",)) -> DataFrame:
    """Features joined with the union of named datasets' demographics, by id as text.

    A dataset without a site column gets its own name as site; columns to drop may be absent.
    """
    parts = [(d if "site" in d.columns else d.withColumn("site", F.lit(name))).drop(*drop) for name, d in demographics]
    people = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return people.withColumn(key, F.col(key).cast("string")).join(features.withColumn(key, F.col(key).cast("string")), key)


def manifest(subjects: DataFrame, recordings: DataFrame, key: str = "subject", path: str = "path") -> DataFrame:
    """Every subject with its sorted recordings; subjects without any keep an empty list."""
    found = recordings.groupBy(key).agg(F.sort_array(F.collect_list(path)).alias("recordings"))
    return subjects.join(found, key, "left").withColumn("recordings", F.coalesce("recordings", F.array().cast("array<string>")))


def session(recordings: Column, index: int) -> Column:
    """The recording of a session index from 0; NULL beyond the last."""
    return F.try_element_at(recordings, F.lit(index + 1))


def without(subjects: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Subjects that have no row among others."""
    return subjects.join(others.select(key), key, "left_anti")


def only(subjects: DataFrame, passed: DataFrame, key: str) -> DataFrame:
    """Subjects that have a row among those that passed; an empty table passes nobody."""
    return subjects.join(passed.select(key), key, "left_semi")


def last_dataset_wins(subjects: DataFrame, order: str, key: str = "subject") -> DataFrame:
    """One row per subject, that of the last dataset."""
    return upsert(subjects.limit(0), subjects, [key], order)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of old, replaced or joined by rows of new of the same keys; the latest by order wins.

    A grouped maximum of whole rows, so that it combines on the map side.
    """
    both = old.withColumn("__age", F.lit(0)).unionByName(new.withColumn("__age", F.lit(1)))
    rank = F.struct(F.col("__age"), *([F.col(order)] if order else []), *[F.col(c) for c in old.columns if c not in keys and c != order])
    best = both.groupBy(*keys).agg(F.max(rank).alias("__best"))
    return best.select(*[F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in old.columns])


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a stated total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__n", rank).filter("__n = 1").drop("__n")


def kth_file(files: DataFrame, k: int, key: str = "subject", path: str = "path") -> DataFrame:
    """The k-th file (from 1) of each subject in path order; subjects with fewer are left out."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(path))
    return files.withColumn("__n", rank).filter(F.col("__n") == k).drop("__n")


def demographics_table(raw: DataFrame, id_col: int, age_col: int, *columns: dict) -> DataFrame:
    """participant_id, age and mapped columns of a table that is addressed by position.

    A column spec has col_name and either single_value or col_id with mapping; unmapped values are
    NULL, but for a diagnosis, which becomes "nan".  The first row of an id, in the order of all
    its values, stays.
    """
    names = raw.columns
    out = [F.col(names[id_col]).cast("string").alias("participant_id"), F.col(names[age_col]).cast("double").alias("age")]
    for c in columns:
        if ("single_value" in c) == ("mapping" in c):
            raise ValueError("a column takes either single_value or mapping")
        v = F.lit(c["single_value"]) if "single_value" in c else mapped(F.col(names[c["col_id"]]).cast("string"), {str(k): v for k, v in c["mapping"].items()})
        out.append((F.coalesce(v.cast("string"), F.lit("nan")) if c["col_name"] == "diagnosis" else v).alias(c["col_name"]))
    rows = raw.select(*out)
    return keep_first(rows, ["participant_id"], [c for c in rows.columns if c != "participant_id"])


def lookup_with_fallback(names: DataFrame, stats: DataFrame, full: str, bare: str, key: str = "region", value: str = "value") -> DataFrame:
    """Value by the full name, else by the bare one, else NULL."""
    a = stats.select(F.col(key).alias(full), F.col(value).alias("__a"))
    b = stats.select(F.col(key).alias(bare), F.col(value).alias("__b"))
    return names.join(a, full, "left").join(b, bare, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")


def nearest(df: DataFrame, value: str, templates: list[tuple[str, float]], name: str = "template") -> DataFrame:
    """The template of least distance, the first listed of equals; templates are a short list."""
    items = F.array(*[F.struct(F.abs(F.col(value) - F.lit(float(age))).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, age) in enumerate(templates)])
    return df.withColumn(name, F.array_min(items)["n"])


def level_grid(df: DataFrame, levels: list[str], lo: int, hi: int, step: int = 1, name: str = "age") -> DataFrame:
    """All combinations of the levels of batch columns, on a grid; each column has few levels."""
    grids = [df.select(c).distinct() for c in levels]
    out = reduce(lambda a, b: a.crossJoin(b), grids)
    return out.withColumn(name, F.explode(F.sequence(F.lit(lo), F.lit(hi), F.lit(step))))


def excluded_columns(names: list[str], pattern: str) -> list[str]:
    import re

    return [n for n in names if not re.search(pattern, n)]


def included_columns(names: list[str], parts: list[str], always: tuple = ()) -> list[str]:
    """Columns that hold one of the parts (a hemisphere suffix of a part is cut), and those asked for always."""
    parts = [p.removesuffix("-lh").removesuffix("-rh") for p in parts]
    return [n for n in names if n in always or any(p in n for p in parts)]


def missing_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the share of missing values of each column, in one pass."""
    return df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])


def drop_sparse_columns(df: DataFrame, columns: list[str], threshold: float = 0.2) -> DataFrame:
    """df without columns whose share of missing values reaches the threshold."""
    row = missing_shares(df, columns).first()
    return df.drop(*[c for c in columns if row[c] is None or row[c] >= threshold])


def drop_sparse_features(long: DataFrame, feature: str = "feature", value: str = "value", threshold: float = 0.2) -> DataFrame:
    """The same on a long table, as a join with the features that stay."""
    good = long.groupBy(feature).agg(F.avg(F.col(value).isNull().cast("double")).alias("__share")).filter(F.col("__share") < threshold)
    return long.join(good.select(feature), feature, "left_semi")


def fill_with_median(long: DataFrame, most_missing: int, feature: str = "feature", value: str = "value") -> DataFrame:
    """Features with more missing values than allowed go; in the others the median fills them."""
    stats = long.groupBy(feature).agg(F.sum(F.col(value).isNull().cast("long")).alias("__gone"), F.median(value).alias("__median")).filter(F.col("__gone") <= most_missing)
    return long.join(stats, feature).withColumn(value, F.coalesce(value, "__median")).drop("__gone", "__median")


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union of rows and of columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_distinct(parts: list[DataFrame], columns: list[str]) -> DataFrame:
    """Distinct rows of several tables, by their common columns."""
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts]).distinct()


def discovered(logs: DataFrame, exclude: list[str], subject: str = "subject", has_log: str = "has_log") -> DataFrame:
    """Subject folders of a results directory: those with a log, or all where none has one.

    Hidden folders, templates (fsaverage...) and excluded names never count.
    """
    own = logs.filter(~F.col(subject).startswith(".") & ~F.col(subject).startswith("fsaverage") & ~F.col(subject).isin(exclude))
    found = own.groupBy(subject).agg(F.max(F.col(has_log).cast("int")).alias("__log"))
    some = found.agg(F.max("__log").alias("__any"))
    return found.crossJoin(F.broadcast(some)).filter("__log = __any").select(subject)  # one row


def picked_channels(channels: DataFrame, kinds: list[str], drop: list[str] = (), kind: str = "type", name: str = "name") -> DataFrame:
    """Channels of the wanted sensor types (in any case), without those named in drop."""
    out = channels.filter(F.lower(kind).isin([k.lower() for k in kinds]))
    return out.filter(~F.col(name).isin(list(drop))) if drop else out


def melt(wide: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return wide.unpivot(ids, values, name, value)


def widen(long: DataFrame, ids: list[str], names: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """The wide table of a stated list of columns: no pass to find them, no growing plan."""
    return long.groupBy(*ids).pivot(name, names).agg(F.first(value, ignorenulls=True))
