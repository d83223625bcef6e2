"""Opaque page cursors: URL-safe base64 of the JSON of the last row's key."""

from __future__ import annotations

import base64
import binascii
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_cursor(key: Column) -> Column:
    """Cursor text of a key struct; null stays null."""
    plain = F.base64(F.to_json(key).cast("binary"))
    # base64 breaks long lines
    return F.translate(F.regexp_replace(plain, r"\s", ""), "+/", "-_")


def decode_cursor(cursor: Column, key_schema: str) -> Column:
    """Key struct of a cursor text; null if the text is no cursor."""
    plain = F.try_to_binary(F.translate(cursor, "-_", "+/"), F.lit("base64"))
    return F.from_json(plain.cast("string"), key_schema)


def read_cursor(cursor: str | None, columns: list[str]) -> tuple | None:
    """The key held by one cursor argument; empty means from the start."""
    if not cursor:
        return None
    try:
        key = json.loads(base64.b64decode(cursor, altchars=b"-_", validate=True))
        return tuple(key[name] for name in columns)
    except (binascii.Error, ValueError, KeyError, TypeError) as error:
        raise ValueError("Invalid cursor") from error
