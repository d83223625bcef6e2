"""Listing, checking and unpacking export archives.

Spark has no archive source, so two Arrow-batched map functions open archives
inside tasks. Listing reads an archive's directory only; unpacking streams one
member at a time. Neither holds an archive above 1 MB or a large member in memory.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple
from urllib.parse import quote
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.functions.text import member_kind
from vitals.schema import MAX_ARCHIVE_BYTES, column_names
from vitals.sources.arrivals import MALFORMED_KEY
from vitals.sources.files import StagedFile, open_input

ROWS = 10_000
COPY_BYTES = 1 << 20
# Members up to this size travel as column values, larger ones as files.
INLINE_BYTES = 8 << 20
# Archives up to this size are read at once.
WHOLE_BYTES = 1 << 20
# Texts that go out at once, unless one member is longer.
FRAME_BYTES = 4 << 20
UNREADABLE = (
    zipfile.BadZipFile,
    zlib.error,
    EOFError,
    NotImplementedError,
    RuntimeError,
)

LISTED = (
    "path STRING, user_id STRING, job_id STRING, length LONG, member STRING, "
    "member_ordinal INT, member_size LONG, reason STRING"
)
UNPACKED = f"{LISTED}, kind STRING, staged_path STRING, content BINARY"

TOO_LARGE = "file exceeds the maximum size"
NOT_A_ZIP = "not a valid archive"
NO_XML = "no export XML"
BAD_MEMBER = "member cannot be read"
BAD_XML = "XML is not well-formed"


#: End of a directory and an entry of it, as ``zipfile`` reads them, and what comes before a member.
END, ENTRY, LOCAL = "<4s4H2LH", "<4s4B4HL2L5H2L", "<4s2B4HL2L2H"
END_BYTES, ENTRY_BYTES, LOCAL_BYTES = map(struct.calcsize, (END, ENTRY, LOCAL))
END64_BYTES = 20
END_MARK, END64_MARK, ENTRY_MARK, LOCAL_MARK = b"PK\5\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
#: The end of an archive that is read to list it; a longer directory is read by ``zipfile``.
TAIL_BYTES = 64 << 10
UTF8, DEFLATE_LEVELS, DESCRIBED_BEHIND = 0x800, 0x6, 0x8
WIDE = 0xFFFFFFFF


class _Entry(NamedTuple):
    """A member: name, length, and where it lies; ``end`` is where the next one begins."""

    name: str
    size: int
    method: int
    crc: int
    packed: int
    raw: bytes
    begin: int
    end: int


def _plain_directory(tail: bytes, length: int) -> list[_Entry] | None:
    """The members of an archive of which ``tail`` is the end, in their order.

    ``None`` if there is anything unusual about it, which ``zipfile`` then has
    to judge: a comment, extra fields, encryption, more than 4 GB, another
    compression, bytes in front, members out of order, or what is no archive.
    """
    if len(tail) < END_BYTES + END64_BYTES:
        return None
    mark, disk, first, here, count, size, offset, comment = struct.unpack_from(END, tail, len(tail) - END_BYTES)
    start = length - len(tail)
    if mark != END_MARK or disk or first or here != count or comment or offset + size != length - END_BYTES:
        return None
    if tail.startswith(END64_MARK, len(tail) - END_BYTES - END64_BYTES) or offset < start:
        return None
    at, stop, found = offset - start, offset - start + size, []
    while at < stop:
        if stop - at < ENTRY_BYTES:
            return None
        (mark, _, _, version, _, flags, method, _, _, crc, packed, full, named, extra, noted, disk, _, _, begin) = (
            struct.unpack_from(ENTRY, tail, at)
        )
        at += ENTRY_BYTES + named + noted
        if mark != ENTRY_MARK or extra or disk or version > 20 or at > stop:
            return None
        if flags & ~(UTF8 | DEFLATE_LEVELS | DESCRIBED_BEHIND) or method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            return None
        if WIDE in (packed, full, begin) or found and begin <= found[-1][-1]:
            return None
        raw = tail[at - noted - named : at - noted]
        try:
            name = raw.decode("utf-8" if flags & UTF8 else "cp437")
        except UnicodeDecodeError:
            return None
        if "\0" in name:
            return None
        found.append((name, full, method, crc, packed, raw, begin))
    ends = [entry[-1] for entry in found[1:]] + [offset]
    return [_Entry(*entry, end) for entry, end in zip(found, ends)] if len(found) == count else None


def _plain_member(data: bytes, entry: _Entry) -> bytes | None:
    """A member of a whole archive; ``None`` if it is not just as its entry says."""
    if entry.end - entry.begin < LOCAL_BYTES:
        return None
    mark, *_, named, extra = struct.unpack_from(LOCAL, data, entry.begin)
    at = entry.begin + LOCAL_BYTES
    begin = at + named + extra
    if mark != LOCAL_MARK or data[at : at + named] != entry.raw or begin + entry.packed > entry.end:
        return None
    text = data[begin : begin + entry.packed]
    if entry.method == zipfile.ZIP_DEFLATED:
        inflate = zlib.decompressobj(-15)
        try:
            text = inflate.decompress(text, entry.size + 1)
        except zlib.error:
            return None
        if not inflate.eof or inflate.unused_data:
            return None
    return text if len(text) == entry.size and zlib.crc32(text) == entry.crc else None


def _members(path: str, length: int) -> list[tuple[str, int]]:
    """Names and lengths of an archive's members; reads the directory only."""
    with open_input(path) as source:
        if length >= END_BYTES + END64_BYTES:
            source.seek(max(0, length - TAIL_BYTES))
            tail = source.read(TAIL_BYTES + 1)
            # of a file that has changed since it was listed the end is not known
            if len(tail) == min(length, TAIL_BYTES) and (entries := _plain_directory(tail, length)) is not None:
                return [(entry.name, entry.size) for entry in entries]
            source.seek(0)
        with zipfile.ZipFile(source) as archive:
            return [(info.filename, info.file_size) for info in archive.infolist()]


def _list_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = column_names(LISTED)
    for batch in batches:
        rows: list[int] = []
        found: list[tuple] = []

        def listed() -> pa.RecordBatch:
            heads = batch.take(pa.array(rows, pa.int32()))
            members, ordinals, sizes, reasons = zip(*found)
            columns = [
                *heads.columns,
                pa.array(members, pa.string()),
                pa.array(ordinals, pa.int32()),
                pa.array(sizes, pa.int64()),
                pa.array(reasons, pa.string()),
            ]
            rows.clear()
            found.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for row, (path, user, job, length) in enumerate(zip(*(c.to_pylist() for c in batch.columns))):
            reason, infos = None, ()
            if user is None or job is None:
                reason = MALFORMED_KEY
            elif length > MAX_ARCHIVE_BYTES:
                reason = TOO_LARGE
            else:
                try:
                    infos = _members(path, length)
                except (zipfile.BadZipFile, pa.ArrowInvalid):
                    # the second is a file too short to seek its directory
                    reason = NOT_A_ZIP
            if reason is not None:
                rows.append(row)
                found.append((None, None, None, reason))
            for ordinal, (name, size) in enumerate(infos):
                rows.append(row)
                found.append((name, ordinal, size, None))
                if len(rows) == ROWS:
                    yield listed()
            if len(rows) >= ROWS:
                yield listed()
        if rows:
            yield listed()


def list_members(arrivals: DataFrame) -> DataFrame:
    """All members of keyed arrivals; one row with a reason for a bad archive.

    Archives above the size limit, or under a malformed key, are not opened.
    """
    listed = arrivals.select("path", "user_id", "job_id", "length").mapInArrow(
        _list_members, LISTED
    )
    return listed.withColumn("kind", member_kind(F.col("member")))


def export_manifest(arrivals: DataFrame) -> DataFrame:
    """The members that are ingested, each with its kind."""
    return list_members(arrivals).where(F.col("kind").isNotNull())


def pick_export_xml(manifest: DataFrame) -> DataFrame:
    """Per export the XML that is parsed: the first in archive order."""
    return (
        manifest.where(F.col("kind") == "xml")
        .groupBy("user_id", "job_id")
        .agg(F.min_by("member", "member_ordinal").alias("member"))
    )


def _greatest(reasons: list[str], among: Column) -> tuple[Column, Callable[[str], Column]]:
    """The greatest of some reasons in a group, as an aggregate of numbers and what it stands for.

    Of texts it would be told by sorting all rows.
    """
    known = F.array(*map(F.lit, sorted(reasons)))
    place = F.max(F.when(among & F.col("reason").isin(reasons), F.array_position(known, F.col("reason"))))
    return place, lambda name: F.get(known, (F.col(name) - 1).cast("int"))


def validate_exports(members: DataFrame) -> DataFrame:
    """One row per listed export: is it valid, and if not why.

    ``members`` comes from ``list_members`` or ``unpack_members``. Partial
    counts are combined before the shuffle, so the size of an archive's
    directory does not matter.
    """
    xml = F.col("kind") == "xml"
    refused, refusal = _greatest([MALFORMED_KEY, TOO_LARGE, NOT_A_ZIP], F.lit(True))
    faulty, fault = _greatest([BAD_MEMBER, BAD_XML], xml)
    checked = members.groupBy("path", "user_id", "job_id", "length").agg(
        F.count("member").alias("file_count"),
        refused.alias("refused"),
        F.coalesce(F.bool_or(xml), F.lit(False)).alias("has_xml"),
        F.coalesce(F.bool_or(xml & F.col("reason").isin(BAD_MEMBER, BAD_XML)), F.lit(False)).alias("bad_xml"),
        faulty.alias("xml_reason"),
    )
    checked = checked.withColumns({"refused": refusal("refused"), "xml_reason": fault("xml_reason")})
    reason = (
        F.when(F.col("refused").isNotNull(), F.col("refused"))
        .when(~F.col("has_xml"), NO_XML)
        .when(F.col("bad_xml"), F.col("xml_reason"))
    )
    step = (
        F.when(F.col("refused") == MALFORMED_KEY, "ParseInput")
        .when(F.col("bad_xml"), "ParallelParsing")
        .otherwise("ValidateFile")
    )
    return checked.select(
        "path",
        "user_id",
        "job_id",
        "length",
        "file_count",
        reason.isNull().alias("valid"),
        reason.alias("reason"),
        F.when(reason.isNotNull(), step).alias("error_step"),
    )


def staged_path(staging: str, kind: str, user: str, job: str, ordinal: int) -> str:
    """Members are named by job and ordinal, never by the archive's own names."""
    user, job = quote(user, safe=""), quote(job, safe="")
    return (
        f"{staging.rstrip('/')}/kind={kind}/user_id={user}/job_id={job}"
        f"/{ordinal:08d}.{kind}"
    )


class _OpenArchive:
    """The archive whose members are being read; one at a time.

    A small one is read at once, as each member would take several short reads,
    and ``zipfile`` reads only what of it is unusual.
    """

    def __init__(self):
        self._path = self._source = self._archive = self._whole = self._plain = None

    def _open(self, path: str, length: int) -> None:
        if path == self._path:
            return
        self.close()
        self._source = open_input(path)
        if length <= WHOLE_BYTES:
            with self._source as source:
                self._whole = source.read()
            self._plain = _plain_directory(self._whole, len(self._whole))
            self._source = io.BytesIO(self._whole)
        self._path = path

    def content(self, path: str, length: int, ordinal: int) -> bytes | None:
        """A member as a whole, if it is held and as it should be; else ``member`` has to read it."""
        self._open(path, length)
        if self._plain is None or ordinal >= len(self._plain):
            return None
        return _plain_member(self._whole, self._plain[ordinal])

    def member(self, path: str, length: int, ordinal: int):
        self._open(path, length)
        if self._archive is None:
            self._archive = zipfile.ZipFile(self._source)
        return self._archive.open(self._archive.infolist()[ordinal])

    def close(self):
        if self._archive is not None:
            self._archive.close()
        if self._source is not None:
            self._source.close()
        self._path = self._source = self._archive = self._whole = self._plain = None


class _Scrubber:
    """Checks XML block by block and blanks each ``<`` that begins no tag.

    Such stand in comments, CDATA sections and processing instructions, and as
    ``<Record`` in front of the root. A split scan, which sees a few bytes only,
    may then take every ``<Record`` for an element. Lengths stay as they are.
    """

    SECTIONS = {b"<!--": b"-->", b"<![CDATA[": b"]]>", b"<?": b"?>"}
    BEGIN = re.compile(b"|".join(map(re.escape, SECTIONS)))
    RECORD = re.compile(b"<(?=Record)")
    #: A mark that begins before so many bytes of the end is seen as a whole.
    KEEP = max(map(len, SECTIONS)) - 1

    def __init__(self):
        self._parser = expat.ParserCreate()
        self._parser.StartElementHandler = self._begin
        self._defer(False)  # the root has to be known with the block it stands in
        self._root = self._until = None
        self._base, self._held = 0, b""

    def _begin(self, *_):
        self._root = self._parser.CurrentByteIndex
        self._parser.StartElementHandler = None
        self._defer(True)

    def _defer(self, enabled: bool) -> None:
        # expat releases without this method parse at once
        if hasattr(self._parser, "SetReparseDeferralEnabled"):
            self._parser.SetReparseDeferralEnabled(enabled)

    def feed(self, block: bytes, last: bool = False) -> bytes:
        """What of the blocks so far can be told; raises if they are not well-formed."""
        self._parser.Parse(block, last)
        data, at, out = self._held + block, 0, []
        limit = len(data) if last else len(data) - self.KEEP
        while at < limit:
            if self._root is None or self._base + at < self._root:
                stop = limit if self._root is None else min(limit, self._root - self._base)
                out.append(self.RECORD.sub(b" ", data[at : stop + self.KEEP])[: stop - at])
            elif self._until is None:
                mark = self.BEGIN.search(data, at)
                found = mark is not None and mark.start() < limit
                stop = mark.end() if found else limit
                self._until = self.SECTIONS[mark.group()] if found else None
                out.append(data[at:stop])
            else:
                end = data.find(self._until, at)
                stop = min(end, limit) if end >= 0 else limit
                out.append(data[at:stop].replace(b"<", b" "))
                if stop == end:
                    self._until = None
            at = stop
        self._held, self._base = data[at:], self._base + at
        return b"".join(out)


def _copy(member, out, check: bool) -> None:
    """Copies in blocks; with ``check``, XML that is not well-formed raises."""
    scrubber = _Scrubber() if check else None
    while block := member.read(COPY_BYTES):
        out.write(scrubber.feed(block) if scrubber else block)
    if scrubber:
        out.write(scrubber.feed(b"", last=True))


def _checked(member) -> bytes:
    """A member's XML as a whole; raises if it is not well-formed."""
    out = io.BytesIO()
    _copy(member, out, check=True)
    return out.getvalue()


def _unpack_batches(staging: str, inline_bytes: int, inline_xml: bool):
    names = column_names(UNPACKED)

    def read(archive: _OpenArchive, path, user, job, length, ordinal, size, kind) -> tuple:
        """Of a member the file it became, or its text, or why it is neither."""
        try:
            if size <= inline_bytes and (kind != "xml" or inline_xml):
                text = archive.content(path, length, ordinal)
                if text is None:
                    with archive.member(path, length, ordinal) as member:
                        return None, _checked(member) if kind == "xml" else member.read(), None
                return None, _checked(io.BytesIO(text)) if kind == "xml" else text, None
            with archive.member(path, length, ordinal) as member:
                target = staged_path(staging, kind, user, job, ordinal)
                with StagedFile(target) as out:
                    _copy(member, out, check=kind == "xml")
            return target, None, None
        except UNREADABLE:
            return None, None, BAD_MEMBER
        except expat.ExpatError:
            return None, None, BAD_XML

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, parsed_xml = _OpenArchive(), None
        try:
            for batch in batches:
                paths, users, jobs, lengths, _, ordinals, sizes, reasons, kinds = (
                    column.to_pylist() for column in batch.columns
                )
                begin, held, targets, contents, why = 0, 0, [], [], []

                def unpacked(end: int) -> pa.RecordBatch:
                    # what the listing knows goes on as it came
                    part = batch.slice(begin, end - begin)
                    columns = [
                        *part.columns[:7],
                        pa.array(why, pa.string()),
                        part.column(8),
                        pa.array(targets, pa.string()),
                        pa.array(contents, pa.binary()),
                    ]
                    for column in (targets, contents, why):
                        column.clear()
                    return pa.RecordBatch.from_arrays(columns, names)

                for row, (path, kind) in enumerate(zip(paths, kinds)):
                    target = content = reason = None
                    if kind is not None and not (kind == "xml" and path == parsed_xml):
                        target, content, reason = read(
                            archive, path, users[row], jobs[row], lengths[row], ordinals[row], sizes[row], kind
                        )
                        if kind == "xml":
                            parsed_xml = path
                    targets.append(target)
                    contents.append(content)
                    why.append(reason or reasons[row])
                    held += len(content or b"")
                    if held >= FRAME_BYTES:
                        yield unpacked(row + 1)
                        begin, held = row + 1, 0
                if targets:
                    yield unpacked(batch.num_rows)
        finally:
            archive.close()

    return unpack


def _unpack(staging: str, inline_bytes: int, inline_xml: bool):
    """The same over data frames."""
    unpack = _unpack_batches(staging, inline_bytes, inline_xml)
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    schema = pa.schema(list(zip([*column_names(LISTED), "kind"], types)))

    def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = (pa.RecordBatch.from_pandas(batch, schema, preserve_index=False) for batch in batches)
        return (found.to_pandas() for found in unpack(listed))

    return frames


def unpack_members(
    members: DataFrame, staging: str, inline_bytes: int = INLINE_BYTES, inline_xml: bool = False
) -> DataFrame:
    """The members' texts: XML as files below ``staging``, the rest in ``content``.

    A large measurement XML can be split once it is a file. CSV and GPX members
    are many and small; as values of a column they are stored together instead
    of as one tiny file each. One above ``inline_bytes`` becomes a file as well.
    With ``inline_xml`` the same goes for XML: where exports are many, a file and
    a folder of each would all have to be listed on the driver. In unpacked XML
    nothing but elements begins with ``<``, so that it can be split anywhere.

    ``members`` comes from ``list_members``, whose rows of one archive follow
    each other, so an archive is opened once. Of several XML members only the
    first is unpacked. Rows keep their order, and repeating an unpacking gives
    the same files.
    """
    columns = column_names(LISTED)
    unpack = _unpack_batches(staging, inline_bytes, inline_xml)
    return members.select(*columns, "kind").mapInArrow(unpack, UNPACKED)
