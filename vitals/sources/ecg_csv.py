"""ECG listings: small CSV files, columns named by each file's own header."""

from __future__ import annotations

import codecs
import csv
import io
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.schema import column_names
from vitals.sources.archive import COPY_BYTES, FRAME_BYTES, ROWS
from vitals.sources.files import open_input

SCANNED = (
    "user_id STRING, job_id STRING, member_ordinal INT, source_file STRING, "
    "row_in_file LONG, ecg_time STRING, classification STRING, "
    "average_heart_rate STRING, line LONG, reason STRING"
)
# Headers of the columns that are kept.
TIME, LABEL, RATE = "Date", "Classification", "Average Heart Rate (bpm)"
NOT_UTF8, NO_CSV = "CSV is not UTF-8", "line is no CSV"


def _is_utf8(source) -> bool:
    decoder = codecs.getincrementaldecoder("utf-8")()
    try:
        while block := source.read(COPY_BYTES):
            decoder.decode(block)
        decoder.decode(b"", final=True)
    except UnicodeDecodeError:
        return False
    source.seek(0)
    return True


def _places(header: list[str]) -> list[int | None]:
    """Where a file's header puts the columns; of equal names the last."""
    found = {name: at for at, name in enumerate(header)}
    return [found.get(name) for name in (TIME, LABEL, RATE)]


def _rows(source) -> Iterator[tuple]:
    """Per data line its number among the file's rows and its values, or the line
    of the file and a reason; a line that is no CSV costs that line only."""
    csv.field_size_limit(sys.maxsize)  # a long field is a field
    reader = csv.reader(io.TextIOWrapper(source, encoding="utf-8", newline="\n"))
    places, number = None, 0
    while True:
        try:
            row = next(reader)
        except csv.Error:
            yield None, None, None, None, reader.line_num, NO_CSV
            continue
        except StopIteration:
            return
        if places is None:
            places = _places(row)
        elif row:
            # a column that is absent has no time but an empty label and rate
            at, label, rate = (
                (row[place] if place < len(row) else None) if place is not None else absent
                for place, absent in zip(places, (None, "", ""))
            )
            yield number, at, label, rate, None, None
            number += 1


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = column_names(SCANNED)
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.int64(), pa.string()]
    block: list[tuple] = []
    held = 0

    def flushed() -> pa.RecordBatch:
        arrays = [pa.array(column, kind) for column, kind in zip(zip(*block), types)]
        block.clear()
        return pa.RecordBatch.from_arrays(arrays, names)

    for batch in batches:
        # texts are taken one by one, the short columns at once
        *short, contents, paths = batch.columns
        for *member, path, text in zip(*(column.to_pylist() for column in short), paths.to_pylist(), contents):
            content = text.as_py()
            with io.BytesIO(content) if content is not None else open_input(path) as source:
                # a file that does not decode is left out as a whole
                if not _is_utf8(source):
                    block.append((*member, None, None, None, None, None, NOT_UTF8))
                    continue
                for values in _rows(source):
                    block.append((*member, *values))
                    # a line may be as long as its file
                    held += sum(map(len, filter(None, values[1:4])))
                    if len(block) >= ROWS or held >= FRAME_BYTES:
                        yield flushed()
                        held = 0
    if block:
        yield flushed()


def scan_ecg(members: DataFrame) -> DataFrame:
    """One row per CSV data line of unpacked ECG members.

    Columns are found by the names in each file's own header: ``ecg_time`` is
    null where there is no such column or the line is too short. Blank lines are
    skipped. A line the reader refuses has a row with its place in the file and
    a reason instead, and so has a file that cannot be decoded, as a whole.
    """
    texts = members.where(F.col("content").isNotNull() | F.col("staged_path").isNotNull())
    return texts.select(
        "user_id", "job_id", "member_ordinal", "member", "content", "staged_path"
    ).mapInArrow(_scan, SCANNED)


def scan_ecg_csv(members: DataFrame) -> DataFrame:
    """The data lines of ``scan_ecg`` that could be read."""
    return scan_ecg(members).where("reason is null").drop("line", "reason")
