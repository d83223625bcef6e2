"""Words and shingles of whole texts as 64-bit hashes, a slice of rows at a time.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. Everything here is numpy over Arrow's own buffers:
memory is bounded by the slice (1 MB of text, or one longer text).
"""

from __future__ import annotations

import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
#: Odd multiplier of the polynomial over a word's bytes, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SPACES = bytes([0x20, *range(0x09, 0x0E)])


def worker_state(name: str, make):
    """A value made once per Python worker and kept between its tasks."""
    home = sys.modules.setdefault("vitals_worker_state", types.ModuleType("vitals_worker_state"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits in which every bit depends on every other."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fold_table(punctuation: bool) -> np.ndarray:
    """Byte to byte: A-Z to a-z, spaces to 0x20; ASCII punctuation too if asked."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[list(SPACES)] = 32
    if punctuation:
        signs = [b for b in range(33, 127) if not chr(b).isalnum()]
        table[signs] = 32
    return table


def exact_table() -> np.ndarray:
    """Byte to byte, spaces to 0x20 and nothing else."""
    table = np.arange(256, dtype=np.uint8)
    table[list(SPACES)] = 32
    return table


def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return of(BASE), of(INVERSE)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i < n, modulo 2**64."""
    common = worker_state("powers", lambda: _powers(SLICE_BYTES + 2))
    return common if n <= len(common[0]) else _powers(n)


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, at, data = column.buffers()
    at = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(at, at[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def lowered(column: pa.Array) -> pa.Array:
    """Texts in lower case, as Unicode has it; bytes that are no text are replaced."""
    try:
        return pc.utf8_lower(column)
    except pa.ArrowInvalid:
        raw = column.cast(pa.binary()).to_pylist()
        return pa.array([b if b is None else b.decode("utf-8", "replace").lower() for b in raw], pa.string())


class Words:
    """The words of one slice.

    row, start, end: per word, its row in the slice and its byte range there.
    hashes: per word, of its folded bytes. counts: per row, its words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        rows = len(offsets) - 1
        folded = table[data]
        solid = folded != 32
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        gap = np.concatenate(([True], ~solid))[:-1] if len(data) else np.zeros(0, bool)
        self.start = np.flatnonzero(solid & (gap | edge[:-1]))
        gap = np.concatenate((~solid, [True]))[1:] if len(data) else np.zeros(0, bool)
        self.end = np.flatnonzero(solid & (gap | edge[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        up, down = powers(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        values = worker_state("byte_values", _byte_values)
        np.cumsum(values[folded] * up[: len(data)], out=sums[1:])
        self.hashes = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.counts = np.bincount(self.row, minlength=rows)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every run of n words, in order; a shorter text is one run."""
        w, row = self.hashes, self.row
        if not len(w):
            return row, w
        first = np.concatenate(([0], np.cumsum(self.counts)[:-1]))
        short = np.flatnonzero((self.counts > 0) & (self.counts < n))
        run = len(w) - n + 1
        h, at = np.zeros(0, np.uint64), np.zeros(0, row.dtype)
        if run > 0:
            inside = row[:run] == row[n - 1 :]
            h = chained([w[j : j + run][inside] for j in range(n)])
            at = row[:run][inside]
        if len(short):
            more = np.array(
                [
                    chained([w[first[r] + j : first[r] + j + 1] for j in range(self.counts[r])])[0]
                    for r in short
                ],
                dtype=np.uint64,
            )
            h, at = np.concatenate((h, mix(more + np.uint64(n)))), np.concatenate((at, short))
            order = np.argsort(at, kind="stable")
            h, at = h[order], at[order]
        return at, h


def chained(parts: list[np.ndarray]) -> np.ndarray:
    """One hash of several in order."""
    h = parts[0]
    for part in parts[1:]:
        h = mix(h * np.uint64(BASE) + part)
    return h


def distinct(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted by (row, hash), each pair once."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (h[1:] != h[:-1])
    return row[new], h[new]


def signed(h: np.ndarray) -> np.ndarray:
    """As Spark's long."""
    return h.view(np.int64)
