"""Secrets in whole texts: fixed patterns, and literals assigned to telling names.

The lexer cuts source and configuration syntax into names, literals and
operators, pairs every literal with the name it is assigned to, follows
constants that are assigned on, and scores a pair by what the name says and how
random the literal looks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "named")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_HINT = re.compile("password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN, MIN_ACCESS = 12, 18

TOKEN = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
    r"""|(?P<name>[A-Za-z_$][A-Za-z0-9_$.\-]*)"""
    r"""|(?P<number>[0-9][A-Za-z0-9+/_=.\-]*)"""
    r"""|(?P<assign>:=|=>|(?<![=!<>])=(?!=)|:(?!:))"""
    r"""|(?P<join>\+|\.\.)"""
    r"""|(?P<close>[\]\)])"""
    r"""|(?P<line>\n)"""
    r"""|(?P<other>[^\s])"""
)
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How much a part of a name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "pass": 0.8, "secret": 1.0,
    "token": 1.0, "apikey": 1.0, "credential": 1.0, "credentials": 1.0, "bearer": 0.9,
    "auth": 0.7, "authorization": 0.8, "dsn": 0.7, "signature": 0.6, "cookie": 0.6, "session": 0.6,
    "salt": 0.6, "pin": 0.5, "key": 0.4,
}
#: Before "key" these make it a secret.
KEY_KINDS = {"api", "access", "private", "secret", "signing", "encryption", "master", "auth", "ssh", "aes", "hmac"}
PLACEHOLDER = re.compile(r"(?i)example|changeme|placeholder|your|dummy|sample|redacted|\*{3}|x{4}|<.*>|\$\{|\{\{|%\(")
MIN_LITERAL, MIN_SCORE = 8, 0.5


def name_score(name: str) -> float:
    parts = [p.lower() for p in NAME_PART.findall(name)]
    best = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    for before, part in zip(parts, parts[1:]):
        if part == "key" and before in KEY_KINDS:
            best = 1.0
    return best


def literal_score(value: str) -> float:
    """0 to 1: the bits of the characters' distribution, against 40."""
    if len(value) < MIN_LITERAL or any(c.isspace() for c in value) or PLACEHOLDER.search(value):
        return 0.0
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    mixed = any(c.isdigit() for c in value) + any(c.isalpha() for c in value)
    return min(1.0, entropy * len(value) / 40) * (1.0 if mixed == 2 else 0.6)


def pairs(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(name, literal, start, end) of every assignment, constants followed.

    A literal joined of several parts spans from the first to the last; a
    constant assigned on keeps the span where it was written.
    """
    constants: dict[str, tuple[str, int, int]] = {}
    tokens = [(m.lastgroup, m) for m in TOKEN.finditer(text)]
    i = 0
    while i < len(tokens):
        kind, m = tokens[i]
        if kind not in ("name", "string"):
            i += 1
            continue
        name = m.group() if kind == "name" else m.group()[1:-1]
        at = i + 1
        while at < len(tokens) and tokens[at][0] == "close":
            at += 1
        # an annotated name: "name: type = value"
        if (
            at + 2 < len(tokens)
            and tokens[at][1].group() == ":"
            and tokens[at + 1][0] == "name"
            and tokens[at + 2][1].group() == "="
        ):
            at += 2
        if at >= len(tokens) or tokens[at][0] != "assign":
            i += 1
            continue
        at += 1
        value, start, end, next_at = "", None, None, at
        while next_at < len(tokens):
            kind, part = tokens[next_at]
            if kind == "string":
                found = (part.group()[1:-1], part.start() + 1, part.end() - 1)
            elif kind == "name" and part.group() in constants:
                found = constants[part.group()]
            elif kind in ("name", "number") and start is None:
                found = (part.group(), part.start(), part.end())
            else:
                break
            value += found[0]
            start, end = (found[1], found[2]) if start is None else (min(start, found[1]), max(end, found[2]))
            next_at += 1
            if next_at < len(tokens) and tokens[next_at][0] == "join":
                next_at += 1
            else:
                break
        if start is not None:
            constants[name] = (value, start, end)
            yield name, value, start, end
        i = at  # the value may itself be the name of a pair: {a: {b: "c"}}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = []
    if ("=" in text or ":" in text) and ASSIGN_HINT.search(text):
        out += [
            (m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGN
        ]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m.group()) >= MIN_ACCESS]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def secret_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    found = base_spans(text)
    if "=" in text or ":" in text:
        own = set()
        for name, value, start, end in pairs(text):
            score = name_score(name) * literal_score(value)
            if score >= MIN_SCORE and not any(a <= start and end <= b for a, b, _ in found):
                own.add((start, end, "named"))
        found += own
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``, the spans (kind, start, end) of every row.

    A null text is empty and has none. Spans may overlap: each pattern finds
    its own, and the lexer adds literals that lie in none of them. Repeated
    rows give repeated rows; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for s, e, k in secret_spans(text or "")]
                for text in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(span))], ["doc_id", "found"]
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        scan, "doc_id long, found array<struct<kind: string, start: long, end: long>>"
    )


def redact_secrets(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mark``; n_chars follows.

    Overlapping spans become one mark. All columns and rows stay; a text
    without a span, null or empty stays as it is.
    """
    columns = docs.columns

    def clean(text: str) -> str:
        out, at = [], 0
        for start, end, _ in secret_spans(text):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]])

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(columns.index("text")).to_pylist()
            new = [text and clean(text) for text in old]
            arrays = list(batch.columns)
            arrays[columns.index("text")] = pa.array(new, pa.string())
            if "n_chars" in columns:
                at = columns.index("n_chars")
                kept = arrays[at].to_pylist()
                sizes = [k if a == b else len(b) for k, a, b in zip(kept, old, new)]
                arrays[at] = pa.array(sizes, arrays[at].type)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return docs.mapInArrow(redact, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts and joined spans of ``find_secrets``."""

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))),
            ",",
        )

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s.kind.isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(kind) for kind in BASE_KINDS],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )
