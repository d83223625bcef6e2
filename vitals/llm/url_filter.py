"""Judging URLs with glob rules, all rules at once in one bit-parallel automaton.

Every rule is a glob over the canonical URL ``.host<gap>path``: literal
characters, ``*`` for any run, ``<gap>`` for the place where the host ends. A
rule of m literals takes m + 1 bits; bit i says "the first i literals are
found". One step of Shift-And moves the bits of all rules, packed into 64-bit
words, along one character; a ``*`` after i literals keeps bit i alive. URLs of
a batch advance together, so a step is a few numpy operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Stands for the end of the host in a canonical URL; no character equals it.
GAP = 0x110000
ASCII_LOWER = {code: code + 32 for code in range(65, 91)}

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with ``path``."""

    verdict: str
    name: str  # host and path in one, like "net/"

    def glob(self) -> list[int | None]:
        host, slash, path = self.name.partition("/")
        return [None, *map(ord, f".{host}"), GAP, *map(ord, slash + path), None]


@dataclass(frozen=True)
class GlobRule:
    """Fits a canonical URL, ``.host`` and path, as a whole; ``*`` is any run."""

    verdict: str
    name: str

    def glob(self) -> list[int | None]:
        return [None if c == "*" else ord(c) for c in self.name]


HOST_RULES = (
    HostRule(BLOCK, "net/"),
    HostRule(ALLOW, "example.net/en/"),
    HostRule(BLOCK, "example.com/de/"),
    HostRule(ALLOW, "org/fr/"),
)
#: What the method adds for URLs that no host rule fits.
GLOB_RULES = tuple(
    GlobRule(BLOCK, f"*{word}*")
    for word in ("spam", "casino", "free-bets", "cheap-pills", "ads-track", "adserv", "porn")
)


def split_url(url: str | None) -> tuple[str, str]:
    """(host in lower case, path); both empty without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, end)
    host = rest[: end if slash < 0 else slash]
    return host.translate(ASCII_LOWER), rest[len(host) : end]


class Automaton:
    """Multiword Shift-And over all rules."""

    def __init__(self, rules):
        globs = [rule.glob() for rule in rules]
        literals = sorted({c for glob in globs for c in glob if c is not None})
        self.literals = np.array(literals, dtype=np.int64)
        bits = sum(sum(c is not None for c in glob) + 1 for glob in globs)
        self.words = max(1, -(-bits // 64))
        self.start = np.zeros(self.words, dtype=np.uint64)
        self.keep = np.zeros(self.words, dtype=np.uint64)
        self.masks = np.zeros((len(literals) + 1, self.words), dtype=np.uint64)  # last: any other
        self.final = []
        bit = 0

        def put(row: np.ndarray, bit: int) -> None:
            row[bit >> 6] |= np.uint64(1 << (bit & 63))

        for glob in globs:
            put(self.start, bit)
            for c in glob:
                if c is None:
                    put(self.keep, bit)
                else:
                    bit += 1
                    put(self.masks[literals.index(c)], bit)
            self.final.append((bit >> 6, np.uint64(bit & 63)))
            bit += 1

    def classes(self, text: str) -> np.ndarray:
        """Which mask each character of ``host<newline>path`` takes."""
        host, _, path = text.partition("\n")
        codes = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for p in (host, path)]
        codes = np.concatenate((codes[0], [GAP], codes[1])).astype(np.int64)
        at = np.searchsorted(self.literals, codes).clip(max=max(len(self.literals) - 1, 0))
        known = self.literals[at] == codes if len(self.literals) else np.zeros(len(codes), bool)
        return np.where(known, at, len(self.literals))

    def matches(self, urls: list[tuple[str, str]]) -> np.ndarray:
        """[url, rule] whether the rule fits."""
        # a newline inside a host would be taken for the gap: it matches no literal either way
        rows = [self.classes(f".{host.replace(chr(10), chr(0))}\n{path}") for host, path in urls]
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        lengths = np.array([len(rows[i]) for i in order])
        state = np.tile(self.start, (len(rows), 1))
        live = np.searchsorted(-lengths, -np.arange(lengths[0] if len(rows) else 0), side="left")
        flat = np.concatenate([rows[i] for i in order]) if rows else np.zeros(0, np.int64)
        at = np.concatenate(([0], np.cumsum(lengths)[:-1])) if rows else np.zeros(0, np.int64)
        one, top = np.uint64(1), np.uint64(63)
        for step, n in enumerate(live):
            now = state[:n]
            moved = now << one
            moved[:, 1:] |= now[:, :-1] >> top
            state[:n] = (moved & self.masks[flat[at[:n] + step]]) | (now & self.keep)
        out = np.zeros((len(rows), len(self.final)), dtype=bool)
        for rule, (word, bit) in enumerate(self.final):
            out[order, rule] = (state[:, word] >> bit) & one == one
        return out


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, glob_rules=GLOB_RULES) -> DataFrame:
    """page_id, url, host, path, rule, pattern, verdict of every row.

    The longest fitting host rule decides and is named in ``rule``. Where none
    fits, ``rule`` is null and a fitting glob, named in ``pattern``, decides: an
    allowing one before a blocking one, then the first listed; without any, the
    URL is allowed. A null URL and one without ``://`` have an empty host and
    path and are allowed. Repeated rows give repeated rows; other columns of
    ``pages`` are not read.
    """
    host_rules = sorted(host_rules, key=lambda r: (-len(r.name), r.name))
    glob_rules = sorted(glob_rules, key=lambda r: r.verdict != ALLOW)
    rules = [*host_rules, *glob_rules]
    own = len(host_rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(rules)
        for batch in batches:
            split = [split_url(url) for url in batch.column("url").to_pylist()]
            fits = automaton.matches(split)
            fits = np.concatenate((fits, np.ones((len(split), 1), dtype=bool)), axis=1)
            first = fits.argmax(axis=1)  # of the listed rules; the last stands for none
            names = [r.name for r in rules]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array([h for h, _ in split], pa.string()),
                    pa.array([p for _, p in split], pa.string()),
                    pa.array([names[i] if i < own else None for i in first], pa.string()),
                    pa.array([names[i] if own <= i < len(rules) else None for i in first], pa.string()),
                    pa.array([rules[i].verdict if i < len(rules) else ALLOW for i in first], pa.string()),
                ],
                ["page_id", "url", "host", "path", "rule", "pattern", "verdict"],
            )

    schema = "page_id long, url string, host string, path string, rule string, pattern string, verdict string"
    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url").mapInArrow(judge, schema)
