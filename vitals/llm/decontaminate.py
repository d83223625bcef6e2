"""Documents that hold passages of a benchmark.

A window of a document, as many words long as a benchmark item, is
fingerprinted by SimHash over its word shingles. The items' fingerprints are
indexed in blocks of bits: whatever lies within the radius differs in some
block by few enough bits to be found there. Candidates are verified by the
exact weighted similarity of the shingles. A shingle weighs by the number of
items of the whole benchmark that hold it.

What an item and a window share weighs no more than the window's shingles that
are the item's. Every window, at any offset, in which these weigh enough to reach
the similarity is fingerprinted; in no other can it be reached.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.llm.tables import carried, landed
from vitals.llm.words import Words, fold_table, lowered, mix, signed, slices

SHINGLE = 5
SIMILARITY = 0.8
#: Bits of a fingerprint, and how many may differ. At similarity 0.8 about 19
#: of 128 do; unrelated texts differ in 64.
BITS, RADIUS = 128, 31
BLOCKS = 8
BLOCK_BITS = BITS // BLOCKS
#: Pigeonhole: some block differs in at most so many bits.
BLOCK_RADIUS = RADIUS // BLOCKS
#: Items are taken in blocks of about so many; each block reads the documents once.
ITEMS_PER_BLOCK = 1000
FILTER_BITS = 20


def near_masks() -> np.ndarray:
    """All patterns of at most BLOCK_RADIUS set bits."""
    places = range(BLOCK_BITS)
    return np.array(
        [sum(1 << i for i in chosen) for k in range(BLOCK_RADIUS + 1) for chosen in itertools.combinations(places, k)],
        dtype=np.uint32,
    )


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def simhash(h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """[run, 2] fingerprints of consecutive runs of shingles."""
    out = np.empty((len(starts), 2), dtype=np.uint64)
    for half in range(2):
        bits = mix(h + np.uint64(half + 1))
        signs = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
        sums = np.add.reduceat(signs * weight[:, None].astype(np.float32), starts, axis=0)
        out[:, half] = np.packbits(sums > 0, axis=1).view(np.uint64)[:, 0]
    return out


def block_values(prints: np.ndarray) -> np.ndarray:
    """[fingerprint, block] the bits of each block."""
    return prints.view(np.uint16).reshape(len(prints), BLOCKS).astype(np.uint32)


class Items:
    """Benchmark items whose shingles have ``n`` words, ready to be looked up.

    ``total`` and ``in_items`` count all such items, and those that hold a
    shingle; left out, they are taken from the items given.
    """

    def __init__(
        self, ids: list, shingles: list[np.ndarray], n: int, total: int | None = None, in_items: dict | None = None
    ):
        self.ids, self.n = ids, n
        self.words = np.array([len(s) + n - 1 for s in shingles])
        lengths = np.array([len(s) for s in shingles])
        flat = np.concatenate(shingles)
        owner = np.repeat(np.arange(len(ids)), lengths)
        own = Counter(h for s in shingles for h in set(s.tolist()))
        total, in_items = total or len(ids), in_items or own
        self.rare = math.log(1 + total)
        self.weights = {h: math.log(1 + total / in_items[h]) for h in own}
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[flat >> np.uint64(64 - FILTER_BITS)] = True
        self.known = np.array(sorted(self.weights), dtype=np.uint64)
        self.known_weight = np.array([self.weights[h] for h in self.known.tolist()])
        self.bags = [Counter(s.tolist()) for s in shingles]
        # one entry per item and different shingle, by shingle
        pairs = np.unique(np.stack((flat, owner.astype(np.uint64)), axis=1), axis=0)
        self.hashes, self.owner = pairs[:, 0].copy(), pairs[:, 1].astype(np.int64)
        weighs = np.add.reduceat(self.weight(flat), np.cumsum(lengths) - lengths)
        self.least = SIMILARITY * weighs * (1 - 1e-9)  # sums in another order
        self.prints = simhash(flat, self.weight(flat), np.cumsum(lengths) - lengths)
        near = block_values(self.prints)[:, :, None] ^ near_masks()[None, None, :]
        near |= (np.arange(BLOCKS, dtype=np.uint32) << np.uint32(BLOCK_BITS))[None, :, None]
        item = np.broadcast_to(np.arange(len(ids), dtype=np.int32)[:, None, None], near.shape).reshape(-1)
        near = near.reshape(-1)
        order = np.argsort(near, kind="stable")
        self.near, self.near_item = near[order], item[order]

    def weight(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.known, h).clip(max=len(self.known) - 1)
        return np.where(self.known[at] == h, self.known_weight[at], self.rare)

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) of all that differ in at most RADIUS bits."""
        keys = block_values(prints) | (np.arange(BLOCKS, dtype=np.uint32) << np.uint32(BLOCK_BITS))
        low, high = (np.searchsorted(self.near, keys.reshape(-1), side=s) for s in ("left", "right"))
        n = high - low
        window = np.repeat(np.repeat(np.arange(len(prints)), BLOCKS), n)
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        found = np.unique(window * len(self.ids) + self.near_item[at])
        window, item = found // len(self.ids), found % len(self.ids)
        close = popcount(prints[window] ^ self.prints[item]).sum(axis=1) <= RADIUS
        return window[close], item[close]

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        """Weight of what both bags hold, against what either holds."""
        mine, other = self.bags[item], Counter(shingles.tolist())
        both = either = 0.0
        for h in mine.keys() | other.keys():
            w = self.weights.get(h, self.rare)
            both += w * min(mine[h], other[h])
            either += w * max(mine[h], other[h])
        return both / either if either else 0.0

    def promising(
        self, row: np.ndarray, item: np.ndarray, place: np.ndarray, h: np.ndarray, first: np.ndarray
    ) -> np.ndarray:
        """[window, 2] first shingle and the one after the last of the windows that may reach an item.

        ``place`` are shingles of the row that ``item`` holds, in order of row,
        item and place. A text shorter than the item is one window.
        """
        weight = self.weight(h[place])
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]))))
        ends = np.append(new[1:], len(place))
        enough = np.add.reduceat(weight, new) >= self.least[item[new]]
        out = []
        for start, end in zip(new[enough].tolist(), ends[enough].tolist()):
            at, i, r = place[start:end], item[start], row[start]
            size = int(self.words[i]) - self.n + 1
            low, high = int(first[r]), int(first[r + 1])
            if high - low <= size:
                out.append(np.array([[low, high]]))
                continue
            sums = np.concatenate(([0.0], np.cumsum(weight[start:end])))
            # windows in which a hit enters or leaves start a stretch of windows with equal sums
            turns = np.unique(np.clip(np.concatenate((at - size + 1, at + 1)), low, high - size))
            held = sums[np.searchsorted(at, turns + size)] - sums[np.searchsorted(at, turns)]
            until = np.append(turns[1:], high - size + 1)
            good = held >= self.least[i]
            lengths = (until - turns)[good]
            begin = np.repeat(turns[good] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
            out.append(np.stack((begin, begin + size), axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), dtype=np.int64)

    def matches(self, words: Words) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item, similarity, first word, words) of the windows that verify."""
        row, h = words.shingles(self.n)
        long_enough = words.counts >= self.n
        first = np.concatenate(([0], np.cumsum(np.where(long_enough, words.counts - self.n + 1, words.counts > 0))))
        hit = np.flatnonzero(self.seen[h >> np.uint64(64 - FILTER_BITS)])
        hit = hit[long_enough[row[hit]]]
        low, high = (np.searchsorted(self.hashes, h[hit], side=s) for s in ("left", "right"))
        n = high - low
        if not n.sum():
            return
        place = np.repeat(hit, n)
        item = self.owner[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        order = np.lexsort((place, item, row[place]))
        windows = self.promising(row[place[order]], item[order], place[order], h, first)
        for part in range(0, len(windows), 2000):  # bounded memory, whatever the number of hits
            start, end = windows[part : part + 2000].T
            lengths = end - start
            starts = np.cumsum(lengths) - lengths
            flat = h[np.repeat(start - starts, lengths) + np.arange(lengths.sum())]
            window, item = self.within(simhash(flat, self.weight(flat), starts))
            for w, i in zip(window.tolist(), item.tolist()):
                score = self.similarity(i, h[start[w] : end[w]])
                if score >= SIMILARITY:
                    r = int(row[start[w]])
                    yield r, i, score, int(start[w] - first[r]), int(lengths[w] + self.n - 1)


def shingled(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, words of a shingle, shingles) of every item with a word: short ones are one shingle."""
    table = fold_table(punctuation=True)
    for first, data, offsets in slices(lowered(texts)):
        words = Words(data, offsets, table)
        for n in range(1, SHINGLE + 1):
            own = np.flatnonzero(words.counts >= n if n == SHINGLE else words.counts == n)
            if not len(own):
                continue
            row, h = words.shingles(n)
            for r in own:
                yield first + int(r), n, h[row == r]


class Block(NamedTuple):
    """Some items, and by shingle length the whole benchmark's items and counts of their shingles."""

    items: list[tuple[object, str]]
    totals: dict[int, int]
    counts: dict[int, dict[int, int]]


def index(block: Block) -> list[Items]:
    """The items of one block, by shingle length."""
    groups: dict[int, tuple[list, list]] = {}
    for r, n, h in shingled(pa.array([text for _, text in block.items], pa.string())):
        ids, shingles = groups.setdefault(n, ([], []))
        ids.append(block.items[r][0])
        shingles.append(h)
    return [Items(ids, shingles, n, block.totals[n], block.counts[n]) for n, (ids, shingles) in groups.items()]


def found_in(indexes: list[Items], texts: pa.Array) -> Iterator[tuple[int, object, float, int, int]]:
    """(row, item id, similarity, first word, words), the best window of every row and item."""
    table = fold_table(punctuation=True)
    for first, data, offsets in slices(lowered(texts)):
        words = Words(data, offsets, table)
        best: dict[tuple[int, object], tuple[float, int, int]] = {}
        for items in indexes:
            for row, item, score, start, size in items.matches(words):
                key = (first + row, items.ids[item])
                if key not in best or (-score, start, size) < (-best[key][0], *best[key][1:]):
                    best[key] = (score, start, size)
        for (row, item), rest in best.items():
            yield row, item, *rest


def frequencies(items: DataFrame) -> DataFrame:
    """n, h, items, parts: how many items hold a shingle, and the blocks these lie in; a null h counts all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            for r, n, h in shingled(batch.column("text")):
                h = signed(np.unique(h)).tolist() + [None]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(h), part[r]), pa.int64()),
                        pa.array([n] * len(h), pa.int32()),
                        pa.array(h, pa.int64()),
                    ],
                    ["part", "n", "h"],
                )

    held = items.select("part", "text").mapInArrow(run, "part long, n int, h long")
    return held.groupBy("n", "h").agg(F.count("*").alias("items"), F.collect_set("part").alias("parts"))


def blocks(benchmark: DataFrame, per_block: int) -> Iterator[Block]:
    """The items in blocks of about ``per_block``, told apart by a hash of the text."""
    items = benchmark.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").where("text is not null")
    parts = max(1, -(-items.count() // per_block))
    items = landed(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")
    known = landed(frequencies(items), "frequencies")
    for part in range(parts):
        totals: dict[int, int] = {}
        counts: dict[int, dict[int, int]] = {}
        for n, h, held in known.where(F.array_contains("parts", F.lit(part).cast("long"))).select("n", "h", "items").collect():
            if h is None:
                totals[n] = held
            else:
                counts.setdefault(n, {})[h % (1 << 64)] = held
        own = items.where(F.col("part") == part).select("item_id", "text").collect()
        yield Block([(row["item_id"], row["text"]) for row in own], totals, counts)


def contaminated(docs: DataFrame, benchmark: DataFrame, per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words of every row and item it holds.

    Words are lower-cased and free of ASCII punctuation; an item of fewer
    than five words is one shingle. Of several windows the most similar counts,
    then the first. Rows and similarities do not depend on ``per_block``. Null and empty texts and items, and items without a word,
    match nothing; a null doc_id stays null; repeated rows are reported each;
    other columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    out = spark.createDataFrame([], schema)
    for block in blocks(benchmark, per_block):
        shared = carried(spark, block)  # at most about per_block items

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = index(shared())
            for batch in batches:
                found = list(found_in(indexes, batch.column("text")))
                ids = batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
                rest = list(zip(*[f[1:] for f in found])) or [[]] * 4
                types = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [ids, *[pa.array(c, t) for c, t in zip(rest, types)]],
                    ["doc_id", "item_id", "similarity", "first_word", "n_words"],
                )

        out = out.unionByName(rows.mapInArrow(scan, schema))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """``docs`` without the rows that hold a passage of the benchmark; all columns stay."""
    at = docs.columns.index("text")
    for block in blocks(benchmark, per_block):
        shared = carried(docs.sparkSession, block)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            indexes = index(shared())
            for batch in batches:
                keep = np.ones(batch.num_rows, dtype=bool)
                keep[[f[0] for f in found_in(indexes, batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
