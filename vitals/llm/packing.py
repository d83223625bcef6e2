"""Packing token pieces into sequences of fixed length.

The work that grows with the corpus (tokenising, numbering pieces, placing
them) runs on Spark. What to put together is decided on the histogram of piece
lengths, which has at most as many entries as a sequence has tokens, whatever
the corpus.

A configuration is a multiset of lengths that fits a sequence. The linear
program "fewest sequences so that the configurations cover the histogram" is
solved by multiplicative weights: prices per length, configurations of most
value by dynamic programming (a knapsack), prices raised where cover lags. Its
solution is rounded down; what is left is priced by the same program again, and
its longest piece gets the configuration of most value among the pieces that
are still there (a knapsack in which every piece counts once), until none is left.
"""

from __future__ import annotations

import base64
import collections
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.llm.tables import carried, landed
from vitals.llm.words import worker_state

CAPACITY = 2048
END_OF_TEXT_ID = 0
#: Rounds of multiplicative weights.
ROUNDS = 120
#: How fast prices follow the cover, which share of a demand one round of the
#: solution takes, and how far below the best value a configuration may lie.
RATE, SHARE, SLACK = 0.03, 0.25, 0.01
#: Turns of the solution; each admits configurations of a little less value.
TURNS = 8
#: Rounds for prices of what rounding leaves, and how often these are renewed.
LAST_ROUNDS, RENEWALS = 30, 6
#: Texts below this character (Latin, Greek, Cyrillic) go the faster way.
LAST_COMMON = "\u0530"

Pattern = tuple[int, ...]


# --- tokens ---------------------------------------------------------------


class Tokens:
    """Ids of texts in the byte-level vocabulary, as little-endian 32-bit bytes.

    ``exact`` reads the vocabulary itself, when a text first needs it.
    ``ranked`` reads the same vocabulary as ranks and gives the same ids at a
    quarter of the time; it takes texts without a special token in letters that
    every version of the character tables knows alike.
    """

    def __init__(self, vocabulary: str):
        import tiktoken

        self.vocabulary = vocabulary
        with open(vocabulary, encoding="utf-8") as file:
            self.special = [token["content"] for token in json.load(file)["added_tokens"]]
        with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranked = tiktoken.Encoding(
            "ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )

    @functools.cached_property
    def exact(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.vocabulary)

    def of(self, text: str) -> bytes:
        if (text.isascii() or max(text) < LAST_COMMON) and not any(s in text for s in self.special):
            ids = self.ranked.encode_ordinary(text)
        else:
            ids = self.exact.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


def tokens(vocabulary: str) -> Tokens:
    return worker_state("tokens:" + vocabulary, lambda: Tokens(vocabulary))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; of a cut text the first may be shorter."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    pieces = [(0, head)] if head else []
    return pieces + [(at, capacity) for at in range(head, n, capacity)]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task and place of every piece.

    ``place`` numbers the pieces of one length within a task from 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # where the worker itself finds the installed vocabulary
        known = tokens(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([END_OF_TEXT_ID], dtype="<u4").tobytes()
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
        for batch in batches:
            out: list[list[int]] = [[] for _ in names]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = known.of(text.as_py() or "") + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, value in zip(out, (doc_id, piece, start, length, crc, task, int(seen[length]))):
                        column.append(value)
                    seen[length] += 1
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"
    )


# --- configurations -------------------------------------------------------


def knapsack(values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Most value in each room up to ``capacity``, and the length taken last there.

    ``values[i]`` belongs to length i + 1 (-inf: no such piece). Room may stay
    empty: length 0 stands for one token left free.
    """
    best = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        options = best[room - 1 :: -1][:room] + values[:room]
        at = room - 1 - int(options[::-1].argmax())  # of equal values the longest piece
        if options[at] > best[room - 1]:
            best[room], last[room] = options[at], at + 1
        else:
            best[room] = best[room - 1]
    return best, last


def filled(last: np.ndarray, room: int) -> Pattern:
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
        room -= int(last[room]) or 1
    return tuple(out)


def priced(demand: np.ndarray, capacity: int, rounds: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Prices by multiplicative weights, the lower bound they prove, and the same without -inf.

    ``demand[i]`` pieces have length i + 1. Each round prices a knapsack for
    every length at once (its best configuration holds the length and fills
    what is left) and takes the configurations of nearly most value.
    """
    lengths = np.arange(1, capacity + 1)
    asked = demand > 0
    price = np.where(asked, lengths / capacity, -np.inf)
    bound, kept = 0.0, price.copy()
    over = np.zeros(capacity)
    for _ in range(rounds):
        best, last = knapsack(price, capacity)
        # prices scaled to a best value of 1 are feasible in the dual program
        worth = float((demand[asked] * price[asked]).sum() / best[capacity])
        if worth > bound:
            bound, kept = worth, price / best[capacity]
        wave = sum_of(waves(price, best, last, demand / rounds, SLACK), capacity)
        over += wave / max(wave.sum(), 1e-9) * demand.sum() / rounds
        part = np.where(asked, over / np.maximum(demand, 1), 0.0)
        price[asked] *= np.exp(RATE * np.clip(1 - wave[asked] * rounds / demand[asked] - part[asked] / 4, -1, 1))
        price[asked] /= price[asked].max()
    return kept, bound, np.where(asked, kept, 0.0)


def linear_program(
    demand: np.ndarray, capacity: int, rounds: int = ROUNDS
) -> tuple[dict[Pattern, float], float]:
    """Configurations with fractional counts, and a lower bound on all packings."""
    price, bound, _ = priced(demand, capacity, rounds)
    chosen: dict[Pattern, float] = {}
    rest = demand.astype(np.float64)
    for turn in range(TURNS):
        best, last = knapsack(price, capacity)
        got = waves(price, best, last, np.minimum(demand * SHARE, rest), SLACK * (1 + turn))
        for pattern, share in got:
            chosen[pattern] = chosen.get(pattern, 0.0) + share
        rest = np.maximum(rest - sum_of(got, capacity), 0)
        price = np.where(rest >= 1, price, -np.inf)  # what is used up is priced no more
        if not np.isfinite(price).any():
            break
    return chosen, bound


def waves(
    price: np.ndarray, best: np.ndarray, last: np.ndarray, room: np.ndarray, slack: float
) -> list[tuple[Pattern, float]]:
    """Configurations of nearly most value and how often each fits into ``room``.

    For every length the best one that holds it, in order of value.
    """
    capacity = len(price)
    lengths = np.arange(1, capacity + 1)
    asked = np.isfinite(price)
    value = np.full(capacity, -np.inf)
    value[asked] = price[asked] + best[capacity - lengths[asked]]
    room = room.copy()
    out = []
    for at in lengths[np.argsort(-value, kind="stable")] - 1:
        if value[at] < (1 - slack) * best[capacity]:
            break
        if room[at] <= 0:
            continue
        counts: dict[int, int] = {int(lengths[at]): 1}
        for length in filled(last, capacity - int(lengths[at])):
            counts[length] = counts.get(length, 0) + 1
        share = min(room[length - 1] / n for length, n in counts.items())
        if share > 0:
            out.append((tuple(sorted((k for k, n in counts.items() for _ in range(n)), reverse=True)), share))
            for length, n in counts.items():
                room[length - 1] -= share * n
    return out


def sum_of(chosen: list[tuple[Pattern, float]], capacity: int) -> np.ndarray:
    """How many pieces of each length the configurations hold."""
    out = np.zeros(capacity)
    for pattern, share in chosen:
        for length in pattern:
            out[length - 1] += share
    return out


def rounded(chosen: dict[Pattern, float], demand: np.ndarray) -> tuple[list[tuple[Pattern, int]], np.ndarray]:
    """Whole counts of the configurations, and what they leave."""
    rest = demand.copy()
    out = []
    order = sorted(chosen.items(), key=lambda c: (-sum(c[0]), -c[1], c[0]))
    for pattern, share in order:
        kinds, n = np.unique(pattern, return_counts=True)
        copies = int(min(np.floor(share), (rest[kinds - 1] // n).min()))
        if copies > 0:
            rest[kinds - 1] -= copies * n
            out.append((pattern, copies))
    return out, rest


def fullest(value: np.ndarray, rest: np.ndarray, first: int, capacity: int) -> Pattern:
    """A piece of length ``first`` and those of most value beside it, of the pieces in ``rest``.

    Pieces of a length are offered in lots of 1, 2, 4, ..., so that a knapsack
    that takes every lot once can take any number of them.
    """
    room = capacity - first
    lots = []
    for length in np.flatnonzero(rest[:room])[::-1] + 1:
        left = min(int(rest[length - 1]) - (length == first), room // int(length))
        lot = 1
        while left > 0:
            lots.append((int(length), min(lot, left)))
            left -= lot
            lot *= 2
    best = np.zeros(room + 1)
    taken = np.zeros((len(lots), room + 1), dtype=bool)
    for i, (length, n) in enumerate(lots):
        size = length * n
        with_it = best[: room + 1 - size] + value[length - 1] * n
        taken[i, size:] = with_it > best[size:]
        best[size:] = np.maximum(best[size:], with_it)
    pieces = [first]
    for i in range(len(lots) - 1, -1, -1):
        if taken[i, room]:
            length, n = lots[i]
            pieces += [length] * n
            room -= length * n
    return tuple(sorted(pieces, reverse=True))


def last_configurations(rest: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Configurations that use up what rounding leaves.

    The program's prices for the rest are renewed as it shrinks. Full ones come
    first among those of equal value.
    """
    rest = rest.copy()
    lengths = np.arange(1, capacity + 1)
    out = []
    whole = int((rest * lengths).sum())
    for turn in range(RENEWALS):
        left = int((rest * lengths).sum())
        if not left:
            break
        _, _, price = priced(rest, capacity, LAST_ROUNDS)
        value = np.where(rest > 0, price, 0.0) + lengths / capacity
        until = whole * (RENEWALS - 1 - turn) // RENEWALS
        while left > until:
            first = int(np.flatnonzero(rest)[-1]) + 1
            pattern = fullest(value, rest, first, capacity)
            kinds, n = np.unique(pattern, return_counts=True)
            copies = int((rest[kinds - 1] // n).min())
            rest[kinds - 1] -= copies * n
            left -= copies * sum(pattern)
            out.append((pattern, copies))
    return out


def configurations(demand: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[Pattern, int]], float]:
    """Configurations whose counts use up ``demand`` exactly, and the lower bound."""
    full = int(demand[capacity - 1])
    rest = demand.copy()
    rest[capacity - 1] = 0
    out = [((capacity,), full)] if full else []
    if not rest.any():
        return out, float(full)
    chosen, bound = linear_program(rest, capacity)
    whole, left = rounded(chosen, rest)
    return out + whole + last_configurations(left, capacity), full + bound


class Slots:
    """For the k-th piece of a length: its sequence and its offset there.

    One entry per configuration and length in it: as many as lengths allow, not
    as the corpus has pieces.
    """

    def __init__(self, chosen: list[tuple[Pattern, int]], capacity: int):
        first, entries = 0, []
        for pattern, copies in chosen:
            offset = 0
            for length, n in sorted(collections.Counter(pattern).items(), reverse=True):
                entries.append((length, n, n * copies, first, offset))
                offset += n * length
            first += copies
        table = np.array(entries, dtype=np.int64).reshape(-1, 5)
        table = table[np.argsort(table[:, 0], kind="stable")]
        self.each, self.sequence, self.offset = table[:, 1], table[:, 3], table[:, 4]
        # ranks of all lengths on one line, so that one search finds the entry
        self.until = np.cumsum(table[:, 2])
        total = np.zeros(capacity + 1, dtype=np.int64)
        np.add.at(total, table[:, 0], table[:, 2])
        self.before = np.concatenate(([0], np.cumsum(total)))[: capacity + 1]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.before[length] + rank
        entry = np.searchsorted(self.until, at, side="right")
        copy, turn = np.divmod(at - np.concatenate(([0], self.until))[entry], self.each[entry])
        return self.sequence[entry] + copy, self.offset[entry] + turn * length


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    A null or empty text is the single id 0. Only documents of more than
    ``capacity`` ids are cut. Repeated rows are packed each; a null id stays
    null; an empty table has no pieces; other columns are not read.
    """
    spark = docs.sparkSession
    known = landed(pieces(docs, capacity, vocabulary), "pieces")
    # one row per task and length, and how many of the length come in tasks before
    counted = known.groupBy("length", "task").agg(F.count("*").alias("n"))
    counted = landed(counted, "piece-counts")
    totals = counted.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most ``capacity`` rows
    demand = np.zeros(capacity, dtype=np.int64)
    for row in totals:
        demand[row["length"] - 1] = row["n"]
    slots = carried(spark, Slots(configurations(demand, capacity)[0], capacity))
    before = F.expr("sum(n) over (partition by length order by task) - n").alias("before")
    ranked = known.join(counted.select("length", "task", before), ["length", "task"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = slots()
        for batch in batches:
            rank = pc.add(batch.column("before"), batch.column("place")).to_numpy(zero_copy_only=False)
            sequence, offset = known.place(batch.column("length").to_numpy(zero_copy_only=False), rank)
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )
