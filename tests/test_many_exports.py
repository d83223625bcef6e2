"""Landing and listing where uploads are many."""

import zipfile
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from parity import archives
from vitals.plans import ingest
from vitals.sources import archive, arrivals, store
from vitals.streaming.ingest import LISTING, OPENING, ingest_stream, landing_session

HEART = "HKQuantityTypeIdentifierHeartRate"
AT = datetime(2024, 2, 1)


def put(root, key, xml):
    path = root / "exports" / key
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w") as target:
        target.writestr("export/export.xml", xml)


def xml(*values):
    unreal = f'<Record type="{HEART}" value="0" startDate="2024-01-09"/>'
    rows = (f'<Record type="{HEART}" unit="&lt;" value="{v}" startDate="2024-01-0{v}"/>é' for v in values)
    return f"<!-- {unreal} --><HealthData>{''.join(rows)}<![CDATA[{unreal}]]></HealthData>"


def landed(spark, root, tables, staging):
    ingest_stream(spark, str(root), tables, staging, f"{tables}-landing").awaitTermination()
    ingest.normalise(spark, tables, staging, AT)
    records = store.scan_table(spark, tables, "records")
    return ingest.read_manifest(spark, tables, staging), records.select("user_id", "unit", "value", "start_date", "job_id")


def test_small_xml_is_no_file_and_large_xml_is(spark, tmp_path, rows, monkeypatch):
    root = tmp_path / "uploads"
    put(root, "u/1.zip", xml(1, 2))
    put(root, "u/2.zip", xml(2, 3))
    put(root, "v/1.zip", xml(4)[:-9])
    staging = tmp_path / "small"
    manifest, records = landed(spark, root, str(tmp_path / "a"), str(staging))
    assert not (staging / "kind=xml").exists()
    assert manifest.where("staged_path is not null").count() == 0
    expected = [
        ("u", "<", "1", "2024-01-01", "1"), ("u", "<", "2", "2024-01-02", "2"), ("u", "<", "3", "2024-01-03", "2"),
    ]
    assert rows(records) == expected
    counts = ingest.run_counts(spark, str(tmp_path / "a"), str(staging), AT)
    assert rows(counts, "user_id", "job_id", "records_kept") == [("u", "1", 2), ("u", "2", 2), ("v", "1", 0)]

    monkeypatch.setattr(archive.unpack_members, "__defaults__", (10, False))
    staging = tmp_path / "large"
    manifest, records = landed(spark, root, str(tmp_path / "b"), str(staging))
    assert manifest.where("content is not null").count() == 0
    assert manifest.where("staged_path is not null").count() == 2
    assert rows(records) == expected


def test_uploads_are_listed_in_tasks_of_some_folders(spark, tmp_path, rows, monkeypatch):
    root = tmp_path / "uploads"
    for user in range(5):
        put(root, f"u{user}/1.zip", xml(1))
    put(root, "u0/deep/er.zip", xml(1))
    put(root, "6.zip", xml(1))
    for hidden in ("u0/.7.zip", "_u/8.zip", ".9.zip", "u1/_10.zip"):
        put(root, hidden, xml(1))
    (root / "exports" / "u0" / "empty.zip").touch()
    monkeypatch.setattr(arrivals, "FOLDERS", 2)
    found = arrivals.export_arrivals(spark, str(root))
    assert "binaryFile" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.rdd.getNumPartitions() == 3
    # what is found is what Spark's own source lists
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true")
    listed = listed.load(f"{root}/exports").select("path", "length", F.col("modificationTime").alias("mtime"))
    second = F.date_trunc("second", "mtime").alias("mtime")
    assert listed.count() == 7
    assert rows(found.select("path", "length", second)) == rows(listed.select("path", "length", second))
    assert found.schema == listed.schema


def test_a_stream_lists_and_opens_in_few_tasks(spark, tmp_path, rows):
    root = tmp_path / "uploads"
    for user in range(100):
        put(root, f"u{user}/1.zip", xml(1))
    before = spark.conf.get(LISTING), spark.conf.get(OPENING)
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        session = landing_session(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert int(session.conf.get(LISTING)) == 4 * spark.sparkContext.defaultParallelism
    assert session.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    saved = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 32 << 20)  # of 4 MB each, eight would be a task
    try:
        tables, staging = str(tmp_path / "a"), str(tmp_path / "s")
        ingest_stream(spark, str(root), tables, staging, str(tmp_path / "c")).awaitTermination()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", saved)
    assert before == (spark.conf.get(LISTING), spark.conf.get(OPENING))
    assert ingest.read_manifest(spark, tables, staging).count() == 100
    assert len(list((tmp_path / "a").rglob("*.parquet"))) <= 5


def test_a_small_archive_is_read_at_once(tmp_path, monkeypatch):
    path = tmp_path / "1.zip"
    with zipfile.ZipFile(path, "w") as target:
        for n in range(20):
            target.writestr(f"workout-routes/{n}.gpx", f"<gpx>{n}</gpx>")
    reads = []

    class Counted:
        def __init__(self, source):
            self.source = source

        def read(self, *size):
            reads.append(size)
            return self.source.read(*size)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.source.close()

        def __getattr__(self, name):
            return getattr(self.source, name)

    opened = archive.open_input
    monkeypatch.setattr(archive, "open_input", lambda uri: Counted(opened(uri)))
    length = path.stat().st_size
    members = pd.DataFrame(
        [(str(path), "u", "1", length, f"workout-routes/{n}.gpx", n, 12, None, "gpx") for n in range(20)],
        columns=[*archive.column_names(archive.LISTED), "kind"],
    )
    expected = [f"<gpx>{n}</gpx>".encode() for n in range(20)]
    (found,) = archive._unpack(str(tmp_path), 100, True)(iter([members]))
    assert list(found.content) == expected
    assert len(reads) == 1

    monkeypatch.setattr(archive, "WHOLE_BYTES", length - 1)
    (found,) = archive._unpack(str(tmp_path), 100, True)(iter([members]))
    assert list(found.content) == expected
    assert len(reads) > 20


def test_a_manifest_is_read_without_python(spark, tmp_path):
    root = tmp_path / "uploads"
    put(root, "u/1.zip", xml(1))
    manifest, _ = landed(spark, root, str(tmp_path / "a"), str(tmp_path / "staging"))
    assert "ExistingRDD" not in manifest._jdf.queryExecution().toString()
    assert ingest.read_manifest(spark, str(tmp_path / "none"), "s").collect() == []


def test_archives_are_rendered_from_one_scan(spark, tmp_path, monkeypatch):
    spark.sql(
        """SELECT id event_id, timestamp'2024-01-01' + make_interval(0, 0, 0, id % 4) ts, id % 2 user_id,
        CASE WHEN id % 5 = 0 THEN 'view' ELSE 'click' END event_type, id / 2 value, '{"a": 1}' props FROM range(30)"""
    ).write.parquet(str(tmp_path / "events.parquet"))
    lines = archives._lines(spark.read.parquet(str(tmp_path / "events.parquet")))
    plan = lines._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Union" not in plan
    monkeypatch.setattr(archives, "LINES", 1)  # a block per line
    batches = lines.orderBy("user", "job", "part", "day", "seq").toArrow().to_batches()
    list(archives._write(str(tmp_path / "short"))(iter(batches)))
    contents = []
    for root in (archives.render_archives(spark, str(tmp_path)), tmp_path / "short"):
        with zipfile.ZipFile(f"{root}/exports/0/0.zip") as found:
            contents.append({name: found.read(name).decode() for name in found.namelist()})
    assert contents[0] == contents[1]
    assert list(contents[0]) == [
        "export/readme.txt",
        "export/export.xml",
        *(f"export/electrocardiograms/ecg_{day}.csv" for day in ["20240101"]),
        *(f"export/workout-routes/route_{day}.gpx" for day in ["20240101", "20240103"]),
    ]
    assert contents[0]["export/export.xml"].count("<Record ") == 5
    assert contents[0]["export/electrocardiograms/ecg_20240101.csv"] == (
        "Average Heart Rate (bpm),Classification,Date\n"
        '0.0,"{""a"": 1}",2024-01-01 00:00:00.000000\n'
    )
    assert contents[0]["export/workout-routes/route_20240103.gpx"] == (
        '<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>\n'
        '<trkpt lat="3.0" lon="6"><ele>1</ele><time>2024-01-03 00:00:00.000000</time></trkpt>\n'
        '<trkpt lat="9.0" lon="18"><ele>1</ele><time>2024-01-03 00:00:00.000000</time></trkpt>\n'
        "</trkseg></trk></gpx>\n"
    )
