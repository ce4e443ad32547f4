import pytest
from pyspark.sql import functions as F

from voltsheaf.sources import files, sinks, tables

DDL = "subject string, feature string, band string, region string, value double"


def features(spark, rows):
    return spark.createDataFrame([(s, "f", "b", "r", float(v)) for s, v in rows], DDL)


def seen(spark, path):
    return sorted(((r.subject, r.value) for r in tables.latest(spark, "features", path).collect()), key=str)


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    assert seen(spark, path) == []
    assert files.write_features(features(spark, [("a", 1), ("a", 2), ("b", 3), (None, 4)]), path, "one") == 1
    files.write_features(features(spark, [("a", 5)]), path, "two")
    files.write_features(features(spark, [("a", 5)]), path, "two")
    assert seen(spark, path) == [("a", 5.0), ("b", 3.0), (None, 4.0)]
    files.write_features(features(spark, [(None, 9)]), path, "three", features(spark, [("b", 0)]))
    assert seen(spark, path) == [("a", 5.0), (None, 9.0)]
    assert [h["run"] for h in sinks.history(spark, path)] == ["one", "two", "two", "three"]
    with pytest.raises(ValueError):
        files.write_features(features(spark, []), path, "a/b")


def test_failed_runs_and_readers_in_between(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    files.write_features(features(spark, [("a", 1), ("b", 2)]), path, "one")
    early = tables.latest(spark, "features", path)
    with pytest.raises(Exception, match="broken"):
        files.write_features(features(spark, [("a", 7)]).withColumn("value", F.raise_error(F.lit("broken")).cast("double")), path, "bad")
    assert seen(spark, path) == [("a", 1.0), ("b", 2.0)]
    # a run that dies before its entry in the log leaves rows that nobody sees
    features(spark, [("a", 8)]).write.parquet(f"{path}/rows/{'0' * 32}")
    assert seen(spark, path) == [("a", 1.0), ("b", 2.0)]
    files.write_features(features(spark, [("a", 3)]), path, "two")
    assert sorted((r.subject, r.value) for r in early.collect()) == [("a", 1.0), ("b", 2.0)]
    assert sinks.vacuum(spark, path) >= 1 and seen(spark, path) == [("a", 3.0), ("b", 2.0)]


def test_two_writers_take_different_numbers(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    files.write_features(features(spark, [("a", 1)]), path, "one")
    stale = sinks.history(spark, path)
    files.write_features(features(spark, [("a", 2)]), path, "two")
    real, calls = sinks.history, []
    monkeypatch.setattr(sinks, "history", lambda s, p: stale if not calls.append(1) and len(calls) == 1 else real(s, p))
    assert files.write_features(features(spark, [("a", 3)]), path, "late") == 3
    monkeypatch.undo()
    assert seen(spark, path) == [("a", 3.0)]


def test_prepared_samples(spark):
    samples = spark.createDataFrame([("s", "A", 0, 1.0), ("s", "B", 0, 2.0), ("t", "A", 0, 3.0)], "subject string, channel string, t_idx long, value double")
    types = spark.createDataFrame([("A", "EEG"), ("A", "ZZZ"), ("Q", "ecg")], "name string, type string")
    places = spark.createDataFrame([("A", 1.0, 2.0, 3.0)], "Channel string, X double, Y double, Z double")
    got = {(r.subject, r.channel): (r.type, r.x, r.z) for r in files.prepared(samples, types, places).collect()}
    assert got == {("s", "A"): ("eeg", 1.0, 3.0), ("s", "B"): (None, None, None), ("t", "A"): ("eeg", 1.0, 3.0)}
    placed = samples.withColumns({c: F.when(F.col("subject") == "s", F.lit(9.0)) for c in "xyz"})
    got = {(r.subject, r.channel): r.x for r in files.prepared(placed, None, places).collect()}
    assert got == {("s", "A"): 9.0, ("s", "B"): 9.0, ("t", "A"): 1.0}
