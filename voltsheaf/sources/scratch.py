"""Tables between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Writes tables below ``spark.checkpoint.dir``; where that is unset a local master takes a
    temporary folder and a cluster gets an error, as executors could not read each other's files."""

    def __init__(self, spark: SparkSession):
        place = spark.conf.get("spark.checkpoint.dir", None)
        if not place:
            if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            place = "file://" + tempfile.mkdtemp(prefix="voltsheaf-")
            spark.conf.set("spark.checkpoint.dir", place)
        self.spark, self.place, self.paths = spark, place.rstrip("/"), []

    def folder(self, name: str, lasts: bool = False) -> str:
        """A new path."""
        path = f"{self.place}/voltsheaf/{name}-{uuid.uuid4().hex}"
        if not lasts:
            self.paths.append(path)
        return path

    def saved(self, df: DataFrame, name: str, by: tuple = (), lasts: bool = False) -> DataFrame:
        """df computed once and read back, in folders by the columns ``by``; one that lasts is not deleted with the others."""
        path = self.folder(name, lasts)
        df.write.partitionBy(*by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        self.paths = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A Scratch whose tables go at the end, but for those that last."""
    s = Scratch(spark)
    try:
        yield s
    finally:
        s.clear()
