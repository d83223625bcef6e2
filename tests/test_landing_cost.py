"""What landing and rendering take of memory, of the driver and of Python's zipfile."""

import json
import zipfile

import pyarrow as pa
import pytest

from parity import archives
from vitals.plans import ingest
from vitals.schema import JOBS
from vitals.sources import archive, arrivals, ecg_csv
from vitals.streaming.ingest import ingest_stream, land


def written(path, members, **settings):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED, **settings) as target:
        for name, text in members.items():
            target.writestr(name, text)
    return path


def unpacked(path):
    """Names with texts or reasons of an archive's members, listed and unpacked."""
    arrival = {"path": [str(path)], "user_id": ["u"], "job_id": ["1"], "length": [path.stat().st_size]}
    found = []
    for batch in archive._list_members(iter([pa.RecordBatch.from_pydict(arrival)])):
        kinds = pa.array(["xml" if name and name.endswith(".xml") else name and "gpx" for name in batch["member"].to_pylist()])
        listed = pa.RecordBatch.from_arrays([*batch.columns, kinds], [*batch.schema.names, "kind"])
        for out in archive._unpack_batches("/none", 1000, True)(iter([listed])):
            found += zip(out["member"].to_pylist(), out["content"].to_pylist(), out["reason"].to_pylist())
    return found


def test_long_ecg_lines_leave_in_small_batches():
    line = "2024-01-01," + "x" * (1 << 20)
    names = ["user_id", "job_id", "member_ordinal", "member", "content", "staged_path"]
    text = f"Date,Classification\n{line}\n{line}\n".encode()
    members = pa.RecordBatch.from_arrays(
        [["u"] * 10, ["1"] * 10, pa.array(range(10), pa.int32()), ["e.csv"] * 10, pa.array([text] * 10, pa.binary()), pa.nulls(10, pa.string())], names
    )
    found = list(ecg_csv._scan(iter([members])))
    assert sum(batch.num_rows for batch in found) == 20
    assert max(batch.nbytes for batch in found) <= archive.FRAME_BYTES + (2 << 20)


def test_unpacked_texts_leave_in_small_batches(tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "FRAME_BYTES", 500)
    path = written(tmp_path / "1.zip", {f"{n}.gpx": "y" * 200 for n in range(10)})
    arrival = {"path": [str(path)], "user_id": ["u"], "job_id": ["1"], "length": [path.stat().st_size]}
    (batch,) = archive._list_members(iter([pa.RecordBatch.from_pydict(arrival)]))
    listed = pa.RecordBatch.from_arrays([*batch.columns, pa.array(["gpx"] * 10)], [*batch.schema.names, "kind"])
    found = list(archive._unpack_batches(str(tmp_path), 1000, True)(iter([listed])))
    assert [out.num_rows for out in found] == [3, 3, 3, 1]
    assert sum((out["member"].to_pylist() for out in found), []) == [f"{n}.gpx" for n in range(10)]


def test_a_plain_archive_needs_no_zipfile(tmp_path, monkeypatch):
    members = {"é/export.xml": "<a><!-- < --></a>", "b.gpx": "text" * 100, "c.gpx": "", "export.xml": "<b>"}
    path = written(tmp_path / "1.zip", members)
    monkeypatch.setattr(zipfile, "ZipFile", None)
    assert unpacked(path) == [
        ("é/export.xml", b"<a><!--   --></a>", None), ("b.gpx", b"text" * 100, None), ("c.gpx", b"", None),
        ("export.xml", None, None),
    ]


def test_unusual_archives_are_left_to_zipfile(tmp_path):
    members = {"export.xml": "<a/>", "b.gpx": "text" * 100}
    expected = [("export.xml", b"<a/>", None), ("b.gpx", b"text" * 100, None)]
    path = written(tmp_path / "comment.zip", members)
    with zipfile.ZipFile(path, "a") as target:
        target.comment = b"said"
    assert unpacked(path) == expected
    shifted = tmp_path / "shifted.zip"
    shifted.write_bytes(b"front" + written(tmp_path / "plain.zip", members).read_bytes())
    assert unpacked(shifted) == expected
    for method in ("ZIP_BZIP2", "ZIP_LZMA"):
        other = tmp_path / f"{method}.zip"
        with zipfile.ZipFile(other, "w", getattr(zipfile, method)) as target:
            for name, text in members.items():
                target.writestr(name, text)
        assert unpacked(other) == expected
    data = (tmp_path / "plain.zip").read_bytes()
    # the checksum in the directory, the name before the member, the end
    entry = data.index(b"PK\1\2", data.index(b"PK\1\2") + 1)
    for at in (entry + 16, data.rindex(b"PK\3\4") + 30):
        broken = tmp_path / f"{at}.zip"
        broken.write_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        assert unpacked(broken) == [expected[0], ("b.gpx", None, archive.BAD_MEMBER)]
    short = tmp_path / "short.zip"
    short.write_bytes(data[:-5])
    assert unpacked(short) == [(None, None, archive.NOT_A_ZIP)]


def test_rendered_archives_are_the_same_packed_and_streamed(tmp_path, monkeypatch):
    def rendered(target, blocks):
        one = archives._Archive(str(target))
        one.begin(archives.XML, "")
        for block in blocks:
            one.add(block)
        one.begin(archives.ECG, "20240101")
        one.add(["1,a,2024-01-01"])
        one.close()
        with zipfile.ZipFile(target) as found:
            assert found.testzip() is None
            return [(name, found.read(name)) for name in found.namelist()]

    blocks = [["<Record/>", "<Record a='é'/>"], ["<Record/>"]]
    packed = rendered(tmp_path / "packed.zip", blocks)
    monkeypatch.setattr(archives, "HELD_BYTES", 0)
    assert rendered(tmp_path / "spilled.zip", blocks) == packed
    monkeypatch.setattr(archives, "LINES", 1)
    assert rendered(tmp_path / "streamed.zip", blocks) == packed
    assert [name for name, _ in packed] == ["export/readme.txt", "export/export.xml", "export/electrocardiograms/ecg_20240101.csv"]


def test_the_driver_is_not_told_of_each_upload(spark, tmp_path, rows):
    root, tables, staging = tmp_path / "uploads", str(tmp_path / "t"), str(tmp_path / "s")
    checkpoint = tmp_path / "c"

    def landed():
        ingest_stream(spark, str(root), tables, staging, str(checkpoint)).awaitTermination()
        return rows(ingest.read_manifest(spark, tables, staging), "path", "job_id")

    for user in range(40):
        written(root / "exports" / f"u {user}%2F+" / "1.zip", {"export.xml": "<a/>"})
    first = landed()
    assert len(first) == 40 and all(path.startswith(f"file:{root}/exports/u ") for path, _ in first)
    entries = [line for log in (checkpoint / "sources" / "0").iterdir() if log.name.isdigit() for line in log.read_text().splitlines()[1:]]
    assert 0 < len(entries) < 40
    assert not any(json.loads(entry)["path"].endswith(".zip") for entry in entries)
    # what has landed does not land again, what comes later does
    written(root / "exports" / "v" / "2.zip", {"export.xml": "<a/>"})
    written(root / "exports" / "u 0%2F+" / "3.zip", {"export.xml": "<a/>"})
    second = landed()
    assert sorted(set(second) - set(first)) == [
        (f"file:{root}/exports/u 0%2F+/3.zip", "3"), (f"file:{root}/exports/v/2.zip", "2"),
    ]
    assert len(second) == 42 and landed() == second
    with pytest.raises(ValueError, match="availableNow"):
        ingest_stream(spark, str(root), tables, staging, str(checkpoint), files_per_trigger=1)


def test_a_checkpoint_of_the_file_source_goes_on_as_it_began(spark, tmp_path):
    root, tables, staging = tmp_path / "uploads", str(tmp_path / "t"), str(tmp_path / "s")
    for user in range(3):
        written(root / "exports" / f"u{user}" / "1.zip", {"export.xml": "<a/>"})
    ingest_stream(spark, str(root), tables, staging, str(tmp_path / "c"), files_per_trigger=2).awaitTermination()
    written(root / "exports" / "u3" / "1.zip", {"export.xml": "<a/>"})
    ingest_stream(spark, str(root), tables, staging, str(tmp_path / "c")).awaitTermination()
    assert ingest.read_manifest(spark, tables, staging).count() == 4
    assert not (tmp_path / "c" / "uploads").exists()


def test_a_listing_whose_stream_broke_off_is_landed_by_the_next(spark, tmp_path, monkeypatch):
    from vitals.streaming import ingest as stream

    root, tables, staging = tmp_path / "uploads", str(tmp_path / "t"), str(tmp_path / "s")
    written(root / "exports" / "u" / "1.zip", {"export.xml": "<a/>"})
    with monkeypatch.context() as broken:
        broken.setattr(stream, "land", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            ingest_stream(spark, str(root), tables, staging, str(tmp_path / "c"))
    written(root / "exports" / "v" / "1.zip", {"export.xml": "<a/>"})
    ingest_stream(spark, str(root), tables, staging, str(tmp_path / "c")).awaitTermination()
    assert ingest.read_manifest(spark, tables, staging).count() == 2


def test_exports_are_validated_without_a_sort(spark, rows):
    listed = spark.createDataFrame(
        [
            ("p", "u", "1", 9, "export.xml", 0, 5, archive.BAD_MEMBER, "xml"),
            ("p", "u", "1", 9, "a/export.xml", 1, 5, archive.BAD_XML, "xml"),
            ("p", "u", "1", 9, "a.gpx", 2, 5, archive.BAD_MEMBER, "gpx"),
            ("q", "u", "2", 9, "export.xml", 0, 5, None, "xml"),
            ("q", "u", "2", 9, "a.gpx", 1, 5, archive.BAD_MEMBER, "gpx"),
            ("r", "u", "3", 9, None, None, None, archive.NOT_A_ZIP, None),
            ("r", "u", "3", 9, None, None, None, archive.TOO_LARGE, None),
            ("s", None, None, 9, None, None, None, archive.MALFORMED_KEY, None),
            ("t", "u", "4", 9, "other", 0, 1, "else", None),
        ],
        f"{archive.LISTED}, kind STRING",
    )
    checked = archive.validate_exports(listed)
    assert "SortAggregate" not in checked._jdf.queryExecution().executedPlan().toString()
    assert rows(checked, "path", "file_count", "valid", "reason", "error_step") == [
        ("p", 3, False, max(archive.BAD_MEMBER, archive.BAD_XML), "ParallelParsing"),
        ("q", 2, True, None, None),
        ("r", 0, False, max(archive.NOT_A_ZIP, archive.TOO_LARGE), "ValidateFile"),
        ("s", 0, False, archive.MALFORMED_KEY, "ParseInput"),
        ("t", 1, False, archive.NO_XML, "ValidateFile"),
    ]


def test_no_rows_take_no_python(spark):
    empty = ingest._empty(spark, JOBS)
    assert empty.schema == spark.createDataFrame([], JOBS).schema and empty.collect() == []
    assert "ExistingRDD" not in empty._jdf.queryExecution().toString()


def test_landing_takes_no_data_frames(spark, tmp_path):
    """Each worker that loads them holds 27 MB more to its end."""
    written(tmp_path / "exports" / "u" / "1.zip", {"export.xml": "<a/>"})
    found = arrivals.parse_export_key(arrivals.export_arrivals(spark, str(tmp_path)), str(tmp_path))
    plan = land(found, str(tmp_path), str(tmp_path / "s"))._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") >= 4 and "MapInPandas" not in plan
