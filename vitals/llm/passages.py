"""Passages of many words that occur more than once, by sparse suffix arrays.

Only suffixes at content-selected positions are kept: of every 43 consecutive
runs of eight words the one with the smallest hash, so that any 50 equal words
hold one such position in common. Suffixes whose run occurs once are dropped.
The rest are sorted by what follows and, in a second order, by what precedes;
neighbours are compared and the match is extended to both sides. Windows that
their neighbours leave uncovered, as these share one side only, are counted by
hash. Spans of one document that touch become one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vitals.llm.tables import landed, sieved
from vitals.llm.words import Words, chained, exact_table, mix, powers, signed, slices

MIN_WORDS = 50
RUN = 8
#: Bits of the position packed below a run's hash while the smallest is sought.
PLACE_BITS = 24


def leftmost_smallest(mixed: np.ndarray, window: int) -> np.ndarray:
    """Per window of so many hashes the place of the smallest, by its high bits; of equal ones the first."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    lowest = (mixed & ~low) | np.arange(len(mixed), dtype=np.uint64)
    span = 1
    while 2 * span <= window:
        lowest = np.minimum(lowest[:-span], lowest[span:])
        span *= 2
    if span < window:
        lowest = np.minimum(lowest[: len(lowest) - (window - span)], lowest[window - span :])
    return (lowest & low).astype(np.int64)


def picked(words: Words, run: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of a slice; per window of ``least`` words the run selected, -1 across texts."""
    w, row = words.hashes, words.row
    count = len(w) - run + 1
    window = least - run + 1
    if len(w) < least:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    h = chained([w[j : j + count] for j in range(run)])
    mixed, places = mix(h), 1 << PLACE_BITS
    lowest = [
        part + first
        for first in range(0, count - window + 1, places - window + 1)
        for part in [leftmost_smallest(mixed[first : first + places], window)]
    ]
    lowest = np.concatenate(lowest)
    whole = row[: len(lowest)] == row[least - 1 :]
    return h, np.where(whole, lowest, -1)


def selected(words: Words, run: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word within the row, hash) of the runs selected in a slice."""
    h, pick = picked(words, run, least)
    at = np.unique(pick[pick >= 0])
    return words.row[at], at - row_starts(words)[words.row[at]], h[at]


def row_starts(words: Words) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(words.counts)[:-1])).astype(np.int64)


def sites(rows: DataFrame, least: int) -> DataFrame:
    """gram, rid, at: the selected positions of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = exact_table()
        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            for first, data, offsets in slices(batch.column("text")):
                row, at, gram = selected(Words(data, offsets, table), RUN, least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(gram)), pa.array(rid[first + row]), pa.array(at.astype(np.int32))],
                    ["gram", "rid", "at"],
                )

    return rows.select("rid", "text").mapInArrow(run, "gram long, rid long, at int")


def contexts(chosen: DataFrame, least: int) -> DataFrame:
    """rid, doc_id, at and the words after and before each position, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = exact_table()
        for batch in batches:
            places = batch.column("places").to_pylist()
            for first, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, table)
                short = (words.hashes >> np.uint64(32)).astype("<u4")
                begin = np.concatenate(([0], np.cumsum(words.counts)))
                own, after, before, at = [], [], [], []
                for r in range(len(offsets) - 1):
                    w = short[begin[r] : begin[r + 1]]
                    back = w[::-1]
                    for place in places[first + r]:
                        own.append(first + r)
                        at.append(place)
                        after.append(w[place : place + least].tobytes())
                        before.append(back[len(w) - place : len(w) - place + least].tobytes())
                take = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rid").take(take),
                        batch.column("doc_id").take(take),
                        pa.array(at, pa.int32()),
                        pa.array(after, pa.binary()),
                        pa.array(before, pa.binary()),
                    ],
                    ["rid", "doc_id", "at", "after", "before"],
                )

    return chosen.mapInArrow(run, "rid long, doc_id long, at int, after binary, before binary")


def common_words(texts: list[bytes], least: int) -> np.ndarray:
    """How many first words each context shares with the next one."""
    width = 4 * least
    table = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint32).reshape(-1, least)
    size = np.array([len(t) // 4 for t in texts])
    differ = table[1:] != table[:-1]
    equal = np.where(differ.any(axis=1), differ.argmax(axis=1), least)
    return np.minimum(equal, np.minimum(size[1:], size[:-1]))


SPAN = "kind string, rid long, doc_id long, at int, after binary, before binary, first int, last int"
EDGE = ["rid", "doc_id", "at", "after", "before"]


def compared(ordered: DataFrame, least: int, edges: bool) -> DataFrame:
    """Spans that rows share with their neighbour in the order given.

    With ``edges`` also the first and the last row of every partition, whose
    neighbours lie in other partitions.
    """

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        rid, at = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        after = common_words([r[3] for r in rows], least)
        before = common_words([r[4] for r in rows], least)
        other = (rid[1:] != rid[:-1]) | (at[1:] != at[:-1])
        pair = np.flatnonzero(other & (after + before >= least))
        mine = np.concatenate((pair, pair + 1))
        before, after = np.tile(before[pair], 2), np.tile(after[pair], 2)
        n = len(mine)
        return record("span", n, [rows[i][:2] for i in mine], at[mine] - before, at[mine] + after)

    def record(kind, n, ids, first, last, edge=None) -> pa.RecordBatch:
        columns = list(zip(*edge)) if edge else [None] * 5
        ids = list(zip(*ids)) or [[], []]
        empty = [None] * n
        arrays = [
            pa.array([kind] * n, pa.string()),
            pa.array(ids[0], pa.int64()),
            pa.array(ids[1], pa.int64()),
            pa.array(columns[2] or empty, pa.int32()),
            pa.array(columns[3] or empty, pa.binary()),
            pa.array(columns[4] or empty, pa.binary()),
            pa.array(first, pa.int32()),
            pa.array(last, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SPAN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, head = None, None
        for batch in batches:
            rows = list(zip(*[batch.column(c).to_pylist() for c in EDGE]))
            if not rows:
                continue
            head = head or rows[0]
            if before is not None:
                rows.insert(0, before)
            before = rows[-1]
            if len(rows) > 1:
                yield spans(rows)
        if edges and head is not None:
            both = [head, before]
            yield record("edge", 2, [r[:2] for r in both], [None] * 2, [None] * 2, both)

    return ordered.mapInArrow(run, SPAN)


def neighbours(rows: DataFrame, order: list[str], least: int) -> DataFrame:
    """rid, doc_id, first, last of matches with the neighbour in the global order."""
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    out = landed(compared(spread, least, edges=True), "neighbours")
    # two rows of each partition, put in order once more: one task holds 100,000 partitions' with ease
    seams = out.where("kind = 'edge'").select(*EDGE).coalesce(1).sortWithinPartitions(*order)
    spans = out.where("kind = 'span'").unionByName(compared(seams, least, edges=False))
    return spans.select("rid", "doc_id", "first", "last")


def merged(found: DataFrame) -> DataFrame:
    """rid, doc_id, spans: the spans of every row in order, those that touch made one."""
    in_order = Window.partitionBy("rid").orderBy("first", "last")
    # a span that touches one before it belongs to the same stretch
    reached = F.max("last").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("first") <= reached, 0).otherwise(1)
    stretch = F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        found.withColumn("begins", begins)
        .withColumn("stretch", stretch)
        .groupBy("rid", "stretch")
        .agg(F.first("doc_id").alias("doc_id"), F.min("first").alias("first"), F.max("last").alias("last"))
        .groupBy("rid")  # still dealt out by rid
        .agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans"))
    )


class SpanHashes:
    """Hashes of any runs of words of a slice, from one pass over its words."""

    def __init__(self, words: Words):
        up, self.down = powers(len(words.hashes) + 1)
        self.sums = np.zeros(len(words.hashes) + 1, dtype=np.uint64)
        np.cumsum(words.hashes * up[: len(words.hashes)], out=self.sums[1:])

    def of(self, start: np.ndarray, n: int) -> np.ndarray:
        return mix((self.sums[start + n] - self.sums[start]) * self.down[start] + np.uint64(n))


def halves(chosen: DataFrame, least: int) -> DataFrame:
    """key, rid, lo, hi: windows that a site selects, from ``lo`` to ``hi``, in two parts.

    Those with half the other words or more before the run share as many words
    before it, the rest as many after it; ``key`` is a hash of these and the run.
    """
    half = (least - RUN) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = exact_table()
        for batch in batches:
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            places = batch.column("places")
            for first, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, table)
                begin, own = row_starts(words), places.slice(first, len(offsets) - 1)
                site = np.zeros(len(words.hashes) + 1, dtype=bool)
                lengths = own.value_lengths().to_numpy(zero_copy_only=False)
                site[np.repeat(begin, lengths) + own.flatten().to_numpy(zero_copy_only=False)] = True
                _, pick = picked(words, RUN, least)
                at = np.flatnonzero((pick >= 0) & site[pick])
                left = pick[at] - at >= half
                part = pick[at] * 2 + left
                edge = np.flatnonzero(part[1:] != part[:-1]) + 1 if len(at) else np.zeros(0, np.int64)
                one = np.concatenate(([0], edge))[: len(at)]
                end = np.concatenate((edge, [len(at)]))[: len(at)] - 1
                lo, hi, left = at[one], at[end], left[one]
                start = np.where(left, pick[lo] - half, pick[lo])
                key = SpanHashes(words).of(start, half + RUN) ^ left.astype(np.uint64)
                row = words.row[lo]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(key)),
                        pa.array(rid[first + row]),
                        pa.array((lo - begin[row]).astype(np.int32)),
                        pa.array((hi - begin[row]).astype(np.int32)),
                    ],
                    ["key", "rid", "lo", "hi"],
                )

    return chosen.select("rid", "text", "places").mapInArrow(run, "key long, rid long, lo int, hi int")


def windows(asked: DataFrame, least: int) -> DataFrame:
    """window, rid, doc_id, first, open: the hash of every window in the ranges of a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = exact_table()
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                words = Words(data, offsets, table)
                own = batch.column("ranges").slice(row, len(offsets) - 1)
                owner = np.repeat(np.arange(len(own)), own.value_lengths().to_numpy(zero_copy_only=False))
                lo, hi, opened = (own.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("lo", "hi", "open"))
                n = hi.astype(np.int64) - lo + 1
                first = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
                owner, opened = np.repeat(owner, n), np.repeat(opened, n)
                take = pa.array(row + owner)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(SpanHashes(words).of(row_starts(words)[owner] + first, least))),
                        batch.column("rid").take(take),
                        batch.column("doc_id").take(take),
                        pa.array(first.astype(np.int32)),
                        pa.array(opened.astype(bool)),
                    ],
                    ["window", "rid", "doc_id", "first", "open"],
                )

    return asked.select("rid", "doc_id", "text", "ranges").mapInArrow(
        run, "window long, rid long, doc_id long, first int, open boolean"
    )


def twice(rows: DataFrame, key: str, place: str) -> DataFrame:
    """The keys that stand at two places or more, one of them open; combined before the shuffle."""
    at = F.xxhash64("rid", place)
    counted = rows.groupBy(key).agg(F.min(at).alias("_a"), F.max(at).alias("_b"), F.max("open").alias("_open"))
    return counted.where("_a <> _b and _open").select(key)


def uncovered(chosen: DataFrame, near: DataFrame, least: int) -> DataFrame:
    """rid, doc_id, first, last of repeated windows outside the spans of ``near``.

    Every window has one site, and equal windows have equal ones. Only windows
    that share the longer side of their site with another place are hashed.
    """
    covered = f"exists(spans, s -> s.first <= lo and s.last >= hi + {least})"
    parts = halves(chosen, least).join(near.select("rid", "spans"), "rid", "left")
    parts = landed(
        parts.selectExpr("key", "rid", "lo", "hi", f"not coalesce({covered}, false) open"), "halves"
    )
    ranges = (
        parts.join(landed(twice(parts, "key", "lo"), "repeated-halves"), "key")
        .groupBy("rid")
        .agg(F.collect_set(F.struct("lo", "hi", "open")).alias("ranges"))  # at most the words of one text
    )
    ranges = landed(ranges, "ranges")
    asked = sieved(chosen.select("rid", "doc_id", "text"), ranges, "rid").join(ranges, "rid")
    hashed = landed(windows(asked, least), "windows")
    repeated = landed(twice(hashed, "window", "first"), "repeated-windows")
    return (
        hashed.where("open").join(repeated, "window").selectExpr("rid", "doc_id", "first", f"first + {least} last")
    )


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, first_word, n_words of every span that is repeated elsewhere.

    A span consists of runs of ``least`` words that stand at another place
    too, in another document or the same. Words are compared as they are,
    whatever white space is between them. Rows that repeat both id and text are
    one document; a null id stays null; null, empty and shorter texts have no
    span; a text may have any number of words that 31 bits count; other columns
    are not read; an empty table gives an empty result.
    """
    rows = docs.selectExpr(
        "cast(doc_id as long) doc_id", "cast(text as string) text", "xxhash64(doc_id, text) rid"
    ).where("text is not null")
    known = landed(sites(rows, least), "sites")
    repeated = known.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    places = (
        # landed, so that both sides are dealt out for the join and a hot run is split
        known.join(landed(repeated, "repeated-runs"), "gram")
        .groupBy("rid")
        .agg(F.array_sort(F.collect_set("at")).alias("places"))  # at most the words of one text
    )
    places = landed(places, "places")
    chosen = landed(sieved(rows, places, "rid").join(places, "rid"), "chosen")
    around = contexts(chosen, least)
    found = neighbours(around, ["after", "before", "rid", "at"], least).unionByName(
        neighbours(around, ["before", "after", "rid", "at"], least)
    )
    near = landed(merged(found), "spans")
    shared = near.select("rid", "doc_id", F.explode("spans").alias("span")).select("rid", "doc_id", "span.*")
    return merged(shared.unionByName(uncovered(chosen, near, least))).select(
        "doc_id", F.explode("spans").alias("span")
    ).selectExpr("doc_id", "cast(span.first as long) first_word", "cast(span.last - span.first as long) n_words")
