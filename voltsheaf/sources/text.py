"""Text sources: logs, label tables, scheduler lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of all text files under a folder; a file is one row until it is exploded."""
    whole = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).filter("line <> ''")


def tail(lines: DataFrame, by: list[str], order: str, n: int = 200) -> DataFrame:
    """The last n lines of each file."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))
    return lines.withColumn("__n", rank).filter(F.col("__n") <= n).drop("__n")


def last_match(lines: DataFrame, by: list[str], order: str, needle: str, line: str = "line") -> DataFrame:
    return lines.filter(F.contains(F.col(line), F.lit(needle))).groupBy(*by).agg(F.max_by(line, order).alias(line))


def euler_numbers(lines: DataFrame, by: list[str] = ["path"], order: str = "line_no") -> DataFrame:  # noqa: B006
    """lh_en, rh_en and their mean, from the last log line that tells them; the 4th and 7th word."""
    number = lambda i: F.expr(f"try_cast(replace(split(trim(line), '\\\\s+')[{i}], ',', '') AS DOUBLE)")
    found = last_match(lines, by, order, "orig.nofix lheno")
    return found.select(*by, number(3).alias("lh_en"), number(6).alias("rh_en")).withColumn("avg_en", (F.col("lh_en") + F.col("rh_en")) / 2).na.drop()


def lookup_table(lines: DataFrame, line: str = "line") -> DataFrame:
    """name, id of a colour table: comments and blank lines are left out."""
    parts = F.split(F.trim(line), r"\s+")
    return lines.filter((F.trim(line) != "") & ~F.col(line).startswith("#")).select(parts[1].alias("name"), parts[0].cast("int").alias("id"))


def template_ages(names: DataFrame, name: str = "name") -> DataFrame:
    """Age in months that a template's name tells: ANTS<a>-<b>Months3T or Years; others are left out."""
    pattern = r"ANTS(\d+)-(\d+)(Month|Year)s?3T"
    a, b, unit = (F.regexp_extract(name, pattern, i) for i in (1, 2, 3))
    age = a.cast("double") + b.cast("double") / 10
    return names.filter(F.col(name).rlike(pattern)).select(name, F.when(unit == "Year", age * 12).otherwise(age).alias("months"))


def subjects_with_errors(files: DataFrame) -> DataFrame:
    """Subjects of error logs (path, content) that mention an error."""
    base = F.element_at(F.split("path", "/"), -1)
    bad = files.filter(F.contains(base, F.lit("err")) & F.contains(F.col("content"), F.lit("error")))
    return bad.select(F.split(F.split(base, r"\.")[0], "_")[0].alias("subject")).distinct()


# fixed values: what a log line of an error looks like
ERROR_PATTERNS = (
    r"\bERROR\b",
    r"Segmentation (fault|violation)",
    r"\bKilled\b",
    r"out of memory",
    r"No space left on device",
    r"Bus error",
    r"floating point exception",
    r"Abort",
    r"assertion.*failed",
)


def error_hints(lines: DataFrame, by: list[str], order: str, n: int = 10) -> DataFrame:
    """The last n lines of each log that look like errors, trimmed: by, hints."""
    pattern = "(?i)" + "|".join(ERROR_PATTERNS)
    hits = tail(lines.filter(F.col("line").rlike(pattern)), by, order, n)
    return hits.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "line"))), lambda x: F.trim(x["line"])).alias("hints"))


def task_of(path: Column) -> Column:
    """The task of a recording: the word before the last of its file name, split at underscores."""
    return F.try_element_at(F.split(F.element_at(F.split(path, "/"), -1), "_"), F.lit(-2))
