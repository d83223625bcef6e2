"""The measurement XML: every ``Record`` element, attributes only."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.functions.text import text

# Attribute of a Record -> column.
ATTRIBUTES = {
    "type": "type",
    "unit": "unit",
    "value": "value",
    "startDate": "start_date",
    "creationDate": "creation_date",
}
ELEMENT = ", ".join(f"{name} STRING" for name in ATTRIBUTES)
EXPORT_COLUMNS = "user_id STRING, job_id STRING"

# A Record's start tag, up to the first > outside quotes. One that never closes
# is no record.
TAG = r"""^Record(?=[\s/>])((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
# Tags written in another way than name="value" name="value" need a parser, as do
# values with entities.
SPACING = ["\t", "\r", "\n", "  ", " =", "= ", "='"]
ENTITY = "&"


def _position() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_blk"),
    ]


# Grows in the order of the text within a task. Being non-deterministic, it also
# keeps later filters above the projection it stands in, where they would
# otherwise be pushed down together with a second copy of the parsing.
POSITION = F.monotonically_increasing_id


def scan_health_xml(
    spark: SparkSession, path: str, splittable: bool = True, staged: bool = False
) -> DataFrame:
    """``(type, unit, value, start_date, creation_date, _file, _blk, _pos)``.

    ``Record`` elements are found at any depth; an absent attribute is
    the empty string.
    With ``staged``, ``path`` is a folder of unpacked members and the columns
    ``user_id`` and ``job_id`` come from its layout.

    Files are split by size and cut at every ``<``, which stands nowhere in a
    value; a piece is a tag and the text behind it, however long the file's
    parts without records are. Of records in comments, CDATA sections and
    entity declarations nothing is left in unpacked members; files from
    elsewhere that hold such need ``splittable=False``, which parses each file
    as a whole in one task.
    """
    layout = f", {EXPORT_COLUMNS}" if staged else ""
    keys = ["user_id", "job_id"] if staged else []
    columns = [text(name).alias(column) for name, column in ATTRIBUTES.items()]

    if not splittable:
        scan = (
            spark.read.format("xml")
            .schema(ELEMENT + layout)
            .option("rowTag", "Record")
            .option("attributePrefix", "")
            .option("ignoreSurroundingSpaces", "false")
            .option("mode", "DROPMALFORMED")
            .load(path)
        )
        return scan.select(*keys, *columns, *_position(), POSITION().alias("_pos"))

    chunks = (
        spark.read.format("text")
        .schema(f"value STRING{layout}")
        .option("lineSep", "<")
        .load(path)
        .select(*keys, "value", *_position())
    )
    return _records(chunks, keys)


def scan_xml_values(members: DataFrame) -> DataFrame:
    """``scan_health_xml`` of unpacked members that are held as values."""
    held = members.where(F.col("content").isNotNull())
    chunks = held.select(
        "user_id",
        "job_id",
        F.explode(F.split(F.col("content").cast("string"), "<")).alias("value"),
        F.col("path").alias("_file"),
        F.lit(0).cast("long").alias("_blk"),
    )
    return _records(chunks, ["user_id", "job_id"])


def _records(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """Records of texts that have been cut at every ``<``, in the columns ``keys`` and ``value``."""
    chunks = chunks.where(F.col("value").startswith("Record") & F.col("value").rlike(TAG))
    # Quotes cannot occur in a value, so cutting at them puts the names at the
    # first, third ... place and each value behind its name.
    tag = F.regexp_extract("value", TAG, 1)
    tags = chunks.withColumn("_tag", tag).withColumn("_parts", F.split("_tag", '"'))
    placed = tags.select(
        "*",
        *(F.array_position("_parts", f" {name}=").alias(f"_at_{name}") for name in ATTRIBUTES),
    )
    found = [(name, F.col(f"_at_{name}")) for name in ATTRIBUTES]
    plain = placed.select(
        *keys,
        "_tag",
        "_file",
        "_blk",
        *(
            F.when(at > 0, F.get("_parts", at.cast("int"))).otherwise("").alias(name)
            for name, at in found
        ),
        reduce(
            or_,
            [F.col("_tag").contains(blank) for blank in SPACING]
            # a value that reads like a name was found first
            + [(at > 0) & (at % 2 == 0) for _, at in found],
        ).alias("_special"),
    )
    parsed = F.from_xml(
        F.concat(F.lit("<Record"), F.regexp_replace("_tag", r"/\s*$", ""), F.lit("/>")),
        ELEMENT,
        {"attributePrefix": "", "ignoreSurroundingSpaces": "false"},
    )
    # Most values are plain text; only the others go through a parser.
    special = reduce(
        or_, [F.col(name).contains(ENTITY) for name in ATTRIBUTES], F.col("_special")
    )
    decoded = plain.withColumn("_decoded", F.when(special, parsed))
    values = [
        F.when(F.col("_decoded").isNull(), F.col(name))
        .otherwise(text(f"_decoded.{name}"))
        .alias(column)
        for name, column in ATTRIBUTES.items()
    ]
    return decoded.select(*keys, *values, "_file", "_blk", POSITION().alias("_pos"))
