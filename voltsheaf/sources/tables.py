"""Tables that a run leaves for the next step, each with its stated columns, as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltsheaf.sources import sinks

#: Columns of each kind of table, and what its files are dealt by.
SCHEMAS = {
    "psd": ("subject string, channel string, freqs array<double>, power array<double>", []),
    "features": ("subject string, feature string, band string, region string, value double", []),
    "splits": ("subject string, split string, seed int", []),
    "quantile_cube": ("response string, sex int, site int, age double, quantile double, value double", ["response"]),
    "z_scores": ("subject string, run int, `group` string, site int, response string, z double", ["response"]),
    "diagnostics": ("model string, parameter string, r_hat double, ess_bulk double, ess_tail double, mcse_sd double", []),
    "exclusions": ("subject string, reason string", []),
    "run_manifest": ("job string, subject string, command string, state string", []),
}


#: The columns that name what a run writes again.
KEYS = {"psd": ["subject"], "features": ["subject"], "splits": ["subject"], "quantile_cube": ["response"], "z_scores": ["response", "run"], "diagnostics": ["model"], "exclusions": ["subject"], "run_manifest": ["job", "subject"]}


def stated(df: DataFrame, kind: str) -> DataFrame:
    """df with the columns of its kind, cast to the stated types; others are left out."""
    schema = df.sparkSession.createDataFrame([], SCHEMAS[kind][0]).schema
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"{kind} needs the columns {missing}")
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields])


def upsert(df: DataFrame, kind: str, path: str, run: str, spoken_for: DataFrame | None = None) -> int:
    """Write a table of a known kind so that a repeated run replaces its own keys (sinks.replace_keys)."""
    return sinks.replace_keys(stated(df, kind), path, KEYS[kind], run, spoken_for)


def latest(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """What upsert() has left, key by key."""
    return sinks.current(spark, path, SCHEMAS[kind][0], KEYS[kind])


def save(df: DataFrame, kind: str, path: str, mode: str = "errorifexists") -> None:
    """Write a table of a known kind; its columns are cast to the stated types, others are left out."""
    out, parts = stated(df, kind), SCHEMAS[kind][1]
    out.write.mode(mode).partitionBy(*parts).parquet(path)


def load(spark: SparkSession, kind: str, path: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind][0]).parquet(path)


def exclusions(failed: DataFrame, no_log: DataFrame, poor: DataFrame, subject: str = "subject") -> DataFrame:
    """subject, reason: subjects to leave out, one row for each reason."""
    parts = [(failed, "failed"), (no_log, "missing"), (poor, "quality")]
    rows = [df.select(F.col(subject).cast("string").alias("subject"), F.lit(reason).alias("reason")).distinct() for df, reason in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
