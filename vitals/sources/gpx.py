"""GPX workout routes: one row per track, waypoints in order.

Every member goes through one streaming parser: any encoding its declaration
names, any namespace prefix, tracks at any depth. A member held as a value is
checked and read in one pass; a larger one, staged as a file, is checked first,
so that its tracks can go out as they are read. What is read fills columns of
many tracks before it becomes a batch. A member that is not well-formed has no
tracks but a row with the reason.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.sources.archive import COPY_BYTES
from vitals.sources.files import open_input

POINT = ["lat", "lon", "ele", "time"]
SCANNED = (
    "user_id STRING, job_id STRING, member_ordinal INT, source_file STRING, track LONG, "
    f"waypoints ARRAY<STRUCT<{', '.join(f'{name}: STRING' for name in POINT)}>>, reason STRING"
)
NAMES = ["user_id", "job_id", "member_ordinal", "source_file", "track", "waypoints", "reason"]
NOT_WELL_FORMED = "GPX is not well-formed"
#: Tracks and waypoints of a batch; one longer track is a batch of its own.
TRACKS, WAYPOINTS = 4096, 1 << 16
# the others are encodings that are unknown or not a code page
FAULTS = (ElementTree.ParseError, expat.ExpatError, ValueError, LookupError)


class _Nothing:
    """Takes a document's parts and keeps none."""

    def start(self, *parts):
        pass

    end = data = start

    def close(self):
        pass


def well_formed(source) -> bool:
    """Reads a document to its end, a block at a time, and back to its start."""
    parser = ElementTree.XMLParser(target=_Nothing())
    try:
        while block := source.read(COPY_BYTES):
            parser.feed(block)
        parser.close()
    except FAULTS:
        return False
    source.seek(0)
    return True


class _Local(dict):
    """Names of elements without their namespace."""

    def __missing__(self, tag):
        self[tag] = name = tag.rpartition("}")[2]
        return name


class _Columns:
    """Tracks that have been read and not yet gone out."""

    def __init__(self):
        self.members: list[tuple] = []
        self.ends = [0]
        self.points: list[list[str]] = [[] for _ in POINT]
        self.local = _Local()

    def full(self) -> bool:
        return len(self.members) >= TRACKS or self.ends[-1] >= WAYPOINTS

    def reject(self, member: tuple) -> None:
        self.members.append((*member, None, NOT_WELL_FORMED))
        self.ends.append(self.ends[-1])

    def add(self, member: tuple, track: int, element) -> None:
        """The waypoints of a track; what is absent is the empty string."""
        local = self.local
        lats, lons, eles, times = self.points
        for segment in element:
            if local[segment.tag] != "trkseg":
                continue
            for point in segment:
                if local[point.tag] != "trkpt":
                    continue
                lats.append(point.get("lat", ""))
                lons.append(point.get("lon", ""))
                ele = time = None
                for child in point:
                    name = local[child.tag]
                    if name == "ele" and ele is None:
                        ele = child.text or ""
                    elif name == "time" and time is None:
                        time = child.text or ""
                eles.append(ele or "")
                times.append(time or "")
        self.members.append((*member, track, None))
        self.ends.append(len(lats))

    def batch(self) -> pa.RecordBatch:
        """What has been read, which is then forgotten."""
        users, jobs, ordinals, files, tracks, reasons = zip(*self.members)
        points = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in self.points], POINT)
        ends = pa.array(np.array(self.ends, np.int32))
        missing = pa.array([r is not None for r in reasons])
        columns = [
            pa.array(users, pa.string()),
            pa.array(jobs, pa.string()),
            pa.array(ordinals, pa.int32()),
            pa.array(files, pa.string()),
            pa.array(tracks, pa.int64()),
            pa.ListArray.from_arrays(ends, points, mask=missing),
            pa.array(reasons, pa.string()),
        ]
        local = self.local
        self.__init__()
        self.local = local
        return pa.RecordBatch.from_arrays(columns, NAMES)


def _streamed(source, local: _Local) -> Iterator:
    """The tracks of a document; what has been read of it is let go."""
    root = None
    for event, element in ElementTree.iterparse(source, events=("start", "end")):
        if root is None:
            root = element
        if event == "end" and local[element.tag] == "trk":
            yield element
            element.clear()
            root.clear()


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = _Columns()
    local = columns.local
    for batch in batches:
        # texts are taken one by one, the short columns at once
        *short, contents, paths = batch.columns
        for *member, path, text in zip(*(column.to_pylist() for column in short), paths.to_pylist(), contents):
            content = text.as_py()
            if content is not None:
                try:
                    root = ElementTree.fromstring(content)
                except FAULTS:
                    columns.reject(member)
                    continue
                found = (element for element in root.iter() if local[element.tag] == "trk")
                for track, element in enumerate(found):
                    columns.add(member, track, element)
                    if columns.full():
                        yield columns.batch()
                continue
            with open_input(path) as source:
                if not well_formed(source):
                    columns.reject(member)
                    continue
                for track, element in enumerate(_streamed(source, local)):
                    columns.add(member, track, element)
                    if columns.full():
                        yield columns.batch()
    if columns.members:
        yield columns.batch()


def scan_gpx(members: DataFrame) -> DataFrame:
    """``(user_id, job_id, member_ordinal, source_file, track, waypoints, reason)``.

    Tracks of unpacked GPX members, numbered within their member; a member that
    cannot be read has one row, with a reason in place of a track.
    """
    held = members.where(F.col("content").isNotNull() | F.col("staged_path").isNotNull())
    return held.select(
        "user_id", "job_id", "member_ordinal", "member", "content", "staged_path"
    ).mapInArrow(_scan, SCANNED)


def scan_gpx_routes(members: DataFrame) -> DataFrame:
    """The tracks of ``scan_gpx``."""
    return scan_gpx(members).where("reason is null").drop("reason")
