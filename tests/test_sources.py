import json

import pytest
from pyspark.sql import functions as F

from voltsheaf.sources import files, text
from voltsheaf.streaming import monitor


def test_manifest(spark, tmp_path):
    for p in ("a/s1/ses-1/x_task-rest_eeg.fif", "a/s1/ses-2/y_task-rest_eeg.fif", "a/s2/z_task-other_eeg.fif", "b/s1/x_task-rest_eeg.fif", "a/s1/noise_room.fif"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("x")
    d = {"A": {"base_dir": f"{tmp_path}/a", "task": "task-rest", "ending": "eeg.fif", "empty_room_task": "noise", "empty_room_ending": "room.fif"}, "B": {"base_dir": f"{tmp_path}/b", "task": "task-rest", "ending": "eeg.fif", "line_freq": 60}}
    rows = {(r.dataset, r.subject): r for r in files.dataset_manifest(spark, d).collect()}
    assert set(rows) == {("A", "s1"), ("A", "s2"), ("B", "s1")}
    assert [len(rows["A", "s1"].recordings), len(rows["A", "s2"].recordings), len(rows["A", "s1"].empty_rooms)] == [2, 0, 1] and rows["B", "s1"].line_freq == 60
    dev = spark.createDataFrame([("/x/4D/a",), ("/x/a.fif",), ("/x/a.set",)], "p string").select(files.device_of(F.col("p")).alias("d"))
    assert [r.d for r in dev.collect()] == ["BTI", "MEGIN", "SET"]


def test_structured_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"EEG_LOBE": {"left": ["a", "b"], "right": ["c"]}}))
    lay = files.layouts(spark, f"{tmp_path}/l.json", "EDF")
    assert lay.count() == 3 and files.saved_layouts(lay, lay.limit(1)).count() == 1
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "s1.csv").write_text(",A__t__r1,B__u__r2\ns1,1.5,\n")
    (tmp_path / "f" / "s2.csv").write_text(",A__t__r3\ns2,2.5\n")
    got = sorted((r.subject, r.feature, r.band, r.region, r.value) for r in files.subject_features(spark, f"{tmp_path}/f").collect())
    assert got == [("s1", "A", "t", "r1", 1.5), ("s1", "B", "u", "r2", None), ("s2", "A", "t", "r3", 2.5)]
    (tmp_path / "c.tsv").write_text("name\ttype\nE1\tEEG\nE2\tEOG\n")
    assert [r.type for r in files.channel_types(spark, f"{tmp_path}/c.tsv").collect()] == ["eeg", "eog"]
    with pytest.raises(ValueError):
        files.demographics(spark, "x.ods")


def test_logs(spark, tmp_path):
    (tmp_path / "recon.log").write_text("start\norig.nofix lheno =  -10, rheno = -20\nmid\norig.nofix lheno =  -46, rheno = -52\nend\n")
    lines = text.numbered_lines(spark, str(tmp_path))
    r = text.euler_numbers(lines).first()
    assert (r.lh_en, r.rh_en, r.avg_en) == (-46.0, -52.0, -49.0)
    assert [x.line for x in text.tail(lines, ["path"], "line_no", 2).orderBy("line_no").collect()][-1] == "end"
    names = spark.createDataFrame([("ANTS2-5Years3T",), ("ANTS10-5Month3T",), ("other",)], "name string")
    assert {r.name: r.months for r in text.template_ages(names).collect()} == {"ANTS2-5Years3T": 30.0, "ANTS10-5Month3T": 10.5}
    lut = spark.createDataFrame([("# c",), ("",), ("1 cortex 0 0 0 0",)], "line string")
    assert [(r.name, r.id) for r in text.lookup_table(lut).collect()] == [("cortex", 1)]
    err = spark.createDataFrame([("/l/s1_run.err.txt", "an error"), ("/l/s2_run.err", "fine"), ("/l/s3.out", "error")], "path string, content string")
    assert [r.subject for r in text.subjects_with_errors(err).collect()] == ["s1"]
    job = files.image_jobs(spark.createDataFrame([("/d/sub-1/ses-2/anat/sub-1_ses-2_run-1_T1w.nii.gz",), ("/d/sub-3/anat/sub-3_T1w.mgz",), ("/d/x.txt",)], "path string"))
    assert sorted(r.job for r in job.collect()) == ["sub-1_ses-2_run-1", "sub-3"]


def test_streaming(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_seconds(id) AS ts, 's' AS subject, 'c' AS channel, CAST(id % 7 AS DOUBLE) AS value FROM range(100)")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    flags = monitor.amplitude_flags(stream, "ts", "subject", "channel", "value", "10 seconds", "5 seconds", "1 second", 5.0, 0.1)
    q = flags.writeStream.format("memory").queryName("flags").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("flags").filter("n = 10")
    batch = monitor.amplitude_flags(rows, "ts", "subject", "channel", "value", "10 seconds", "5 seconds", "1 second", 5.0, 0.1).filter("n = 10")
    assert got.count() > 10 and got.exceptAll(batch).count() == 0
    assert monitor.sessions(rows, "ts", "subject", "5 seconds", "1 second").first().n == 100


def test_sessions_part_at_exactly_the_gap(spark, tmp_path):
    times = [("a", 0), ("a", 9), ("a", 19), ("a", 39), ("b", 5), ("b", 16)]
    rows = spark.createDataFrame(times, "subject string, t long").withColumn("ts", F.timestamp_seconds("t")).coalesce(1)
    want = [("a", 0, 19, 2), ("a", 19, 29, 1), ("a", 39, 49, 1), ("b", 5, 15, 1), ("b", 16, 26, 1)]
    found = lambda df: sorted(tuple(r) for r in df.select("subject", F.unix_seconds("start"), F.unix_seconds("end"), "n").collect())
    assert found(monitor.sessions(rows, "ts", "subject", "10 seconds", "1 hour")) == want
    later = spark.createDataFrame([("c", 90_000)], "subject string, t long").withColumn("ts", F.timestamp_seconds("t"))  # closes the others
    rows.unionByName(later).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = monitor.sessions(stream, "ts", "subject", "10 seconds", "1 hour").writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert found(spark.table("sessions")) == want


def test_workbooks(spark, tmp_path):
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>id</t></si><si><r><t>s</t></r><r><t>1</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {main}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>age</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>31.5</v></c></row><row><c r="A3"/></row></sheetData></worksheet>')
    rows = files.demographics(spark, f"{tmp_path}/d.xlsx")
    assert rows.columns == ["id", "_c1", "age"] and [tuple(r) for r in rows.collect()] == [("s1", None, "31.5")]
