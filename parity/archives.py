"""Renders events to export archives, one per user and job, with Spark."""

from __future__ import annotations

import struct
import zipfile
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parity.adapter import identifier, table, time_text
from vitals.session import shared_dir
from vitals.sources.files import StagedFile

_rendered: dict[tuple[str, str], str] = {}
#: Events, and users, whose archives a task writes.
EVENTS, USERS = 20_000, 1_000
#: Lines of a member that are written at once.
LINES = 10_000
#: Of an archive that is packed at once; a longer one is written as it comes.
HELD_BYTES, HELD_MEMBERS = 4 << 20, 10_000
README = "export/readme.txt"
#: Time and day of a member, as an archive has them: 2024-01-01.
WRITTEN = 0, (2024 - 1980) << 9 | 1 << 5 | 1


def _xml_text(column: Column) -> Column:
    for raw, entity in [("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")]:
        column = F.replace(column, F.lit(raw), F.lit(entity))
    return column


def _lines(events: DataFrame) -> DataFrame:
    """Every event's text lines, ``(user, job, part, day, seq, line)``.

    What opens and closes a member is the same in all of a part, and the writer's.
    """
    value = F.col("value").cast("string")
    record = F.concat(
        F.lit(' <Record type="'), identifier(),
        F.lit('" sourceName="a &gt; &quot;b&quot; type="'), F.lit(' unit="u" value="'),
        value, F.lit('" startDate="'), time_text("ts"), F.lit('"'),
        F.when(F.col("event_id") % 5 == 0, "/>").otherwise(
            '>\n  <MetadataEntry key="k" value="0"/>\n </Record>'
        ),
    )
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"'))
    point = F.concat(
        F.lit('<trkpt lat="'), value, F.lit('" lon="'), F.col("event_id").cast("string"),
        F.lit('"><ele>1</ele><time>'), time_text("ts"), F.lit("</time></trkpt>"),
    )
    day = F.date_format("ts", "yyyyMMdd")

    def line(part: int, day: Column, text: Column) -> Column:
        return F.struct(F.lit(part).alias("part"), day.alias("day"), text.alias("line"))

    lines = F.array(
        line(XML, F.lit(""), record),
        F.when(F.col("event_type") == "view", line(ECG, day, F.concat_ws(",", value, quoted, time_text("ts")))),
        line(GPX, day, point),
    )
    exploded = events.select(
        F.col("user_id").alias("user"),
        (F.col("event_id") % 3).alias("job"),
        F.col("event_id").alias("seq"),
        F.explode(lines).alias("of"),
    )
    return exploded.where(F.col("of").isNotNull()).select("user", "job", "seq", "of.*")


#: Members in their order: the name around the day, the first line, the last.
XML, ECG, GPX = 1, 2, 3
MEMBERS = {
    XML: (
        "export/export", ".xml",
        '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE HealthData [\n'
        "<!ELEMENT HealthData (Record*)>\n]>\n<HealthData>",
        "</HealthData>",
    ),
    ECG: ("export/electrocardiograms/ecg_", ".csv", "Average Heart Rate (bpm),Classification,Date", None),
    GPX: (
        "export/workout-routes/route_", ".gpx",
        '<gpx xmlns="http://www.topografix.com/GPX/1/1"><trk><trkseg>', "</trkseg></trk></gpx>",
    ),
}


def _packed(members: list[tuple[str, bytes]]) -> bytes:
    """An archive of some members, deflated; ``zipfile`` takes three times as long for many small ones."""
    out, directory, at = [], [], 0
    for name, content in members:
        raw, packed = name.encode("ascii"), zlib.compress(content, wbits=-15)
        sizes = zlib.crc32(content), len(packed), len(content)
        head = struct.pack("<4s5H3L2H", b"PK\3\4", 20, 0, zipfile.ZIP_DEFLATED, *WRITTEN, *sizes, len(raw), 0)
        out += head, raw, packed
        entry = 20, 20, 0, zipfile.ZIP_DEFLATED, *WRITTEN, *sizes, len(raw), 0, 0, 0, 0, 0o600 << 16, at
        directory += struct.pack("<4s6H3L5H2L", b"PK\1\2", *entry), raw
        at += len(head) + len(raw) + len(packed)
    size, count = sum(map(len, directory)), len(members)
    end = struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, count, count, size, at, 0)
    return b"".join([*out, *directory, end])


class _Archive:
    """An archive being written; of a member no more than a block of lines is held.

    A small archive is packed at once.
    """

    def __init__(self, target: str):
        self._target, self._archive = target, None
        self._members, self._held = [(README, b"not ingested\n")], 0
        self._lines: list[str] = []
        self._name = self._last = self._out = None

    def begin(self, part: int, day: str) -> None:
        self._end()
        before, after, first, self._last = MEMBERS[part]
        self._name = before + day + after
        self._lines.append(first)

    def add(self, lines: list[str]) -> None:
        self._lines += lines
        if len(self._lines) >= LINES:
            if self._out is None:
                self._spill()
                self._out = self._archive.open(self._name, "w")
            self._out.write(self._text())

    def _spill(self) -> None:
        """What is held goes to a file, and what follows goes there as it comes."""
        if self._archive is None:
            self._staged = StagedFile(self._target)
            self._archive = zipfile.ZipFile(self._staged.__enter__(), "w", zipfile.ZIP_DEFLATED)
            for name, content in self._members:
                self._archive.writestr(name, content)
            self._members.clear()

    def _text(self) -> bytes:
        text = "\n".join([*self._lines, ""]).encode()
        self._lines.clear()
        return text

    def _end(self) -> None:
        if self._name is None:
            return
        if self._last is not None:
            self._lines.append(self._last)
        if self._out is not None:
            self._out.write(self._text())
            self._out.close()
        elif self._archive is not None:
            self._archive.writestr(self._name, self._text())
        else:
            self._members.append((self._name, self._text()))
            self._held += len(self._members[-1][1])
            if self._held > HELD_BYTES or len(self._members) > HELD_MEMBERS:
                self._spill()
        self._name = self._out = None

    def close(self) -> None:
        self._end()
        if self._archive is None:
            with StagedFile(self._target) as out:
                out.write(_packed(self._members))
            return
        self._archive.close()
        self._staged.__exit__(None, None, None)


def _write(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        export = member = archive = None
        for batch in batches:
            *keys, lines = (batch.column(name).to_pylist() for name in ("user", "job", "part", "day", "line"))
            written, at = [], 0
            # a member's lines follow each other
            for key, group in groupby(zip(*keys)):
                end = at + sum(1 for _ in group)
                user, job, part, day = key
                if (user, job) != export:
                    if archive is not None:
                        archive.close()
                    export, member = (user, job), None
                    written.append(f"{root}/exports/{user}/{job}.zip")
                    archive = _Archive(written[-1])
                if (part, day) != member:
                    member = part, day
                    archive.begin(part, day)
                archive.add([f"{line}" for line in lines[at:end]])
                at = end
            yield pa.RecordBatch.from_arrays([pa.array(written, pa.string())], ["path"])
        if archive is not None:
            archive.close()

    return write


def render_archives(spark: SparkSession, sf_dir: str) -> str:
    """Root folder of the archives of all events; written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _rendered:
        root = shared_dir(spark, "exports")
        order = ["user", "job", "part", "day", "seq"]
        events = table(spark, sf_dir, "events")
        lines = _lines(events).repartition(events.count() // EVENTS + 1, "user", "job")
        written = lines.sortWithinPartitions(*order).mapInArrow(_write(root), "path STRING")
        written.write.format("noop").mode("overwrite").save()
        _rendered[key] = root
    return _rendered[key]


# --- archives that are not as they should be --------------------------------

HEART, STEPS = "HKQuantityTypeIdentifierHeartRate", "HKQuantityTypeIdentifierStepCount"
TRACK = '<{0}trk><{0}trkseg><{0}trkpt lat="1" lon="2"><{0}time>2024-01-05</{0}time></{0}trkpt></{0}trkseg></{0}trk>'


def _members(user: int) -> dict[str, bytes]:
    """Members of a user's archive, one fault for each remainder of the id by five."""
    csv = f"Date,Classification\n2024-01-02,a\nbroken\rline,x\n2024-01-03,{'x' * 200_000}\n"
    # no element, wherever a split of the file may begin
    unreal = f'<Record type="{HEART}" value="0" startDate="2024-01-09"/>'
    xml = (
        f"<!DOCTYPE HealthData [<!ENTITY e '{unreal}'>]><!-- {unreal} -->"
        f"<HealthData><!-- {unreal}{' ' * 3000}{unreal} --><note><![CDATA[--> {unreal}]]></note><?p {unreal}?>"
        f"<Record type='{HEART}' value='{user}' startDate='2024-01-01'/>"
        f'<Record\n type="{STEPS}" value="2" startDate="2024-01-02"></Record></HealthData>'
    )
    names = "export/electrocardiograms/e.csv", "export/workout-routes/r.gpx", "export/export.xml"
    space = 'xmlns:x="http://www.topografix.com/GPX/1/1"'
    prefixed = f"<x:gpx {space}>{TRACK.format('x:')}</x:gpx>"
    if user % 5 == 1:  # no XML
        return {names[0]: csv.encode(), names[1]: prefixed.encode()}
    if user % 5 == 2:  # XML that breaks off within a tag
        return {names[2]: xml[:-40].encode(), names[1]: prefixed.encode()}
    broken = b"<gpx><name>\xff</name>" + TRACK.format("").encode() + b"</gpx>"
    return {
        names[2]: xml.encode(),
        names[0]: csv.encode(),
        "export/workout-routes/q.gpx": broken,
        names[1]: prefixed.encode(),
    }


def _write_faulty(root: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            users = batch.column(0).to_pylist()
            if None in users:  # all are floats then, as in a data frame
                users = [float("nan") if user is None else float(user) for user in users]
            for user in users:
                # of remainder 3 the key names no job, of 0 the file is no archive
                key = f"{user}.zip" if user % 5 == 3 else f"{user}/{user % 5}.zip"
                with StagedFile(f"{root}/exports/{key}") as target:
                    if user % 5 == 0:
                        target.write(b"not an archive")
                        continue
                    target.write(_packed([*_members(user).items()]))
            yield batch

    return write


def render_faulty(spark: SparkSession, sf_dir: str) -> str:
    """Root folder with one archive of every user of the events, most of them faulty."""
    key = (spark.sparkContext.applicationId, f"faulty {sf_dir}")
    if key not in _rendered:
        root = shared_dir(spark, "faulty")
        users = table(spark, sf_dir, "events").select("user_id").distinct()
        users = users.repartition(users.count() // USERS + 1, "user_id")
        users.mapInArrow(_write_faulty(root), "user_id LONG").write.format("noop").mode("overwrite").save()
        _rendered[key] = root
    return _rendered[key]
