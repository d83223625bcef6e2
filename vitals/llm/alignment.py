"""Tokens of two tokenizers over the same bytes, aligned.

A is a byte-level BPE read by ``tokenizers``, B a BPE with byte fallback read
by ``sentencepiece``. Both see a space and the text. Where tokens of both end,
the bytes are cut into groups; every A and every B token of a group are linked.

Ends of tokens come from the spans the libraries give, in characters; of B its
offset mapping, which the installed release has in place of the immutable proto.
A span tells the end of a token that has whole characters to itself. Tokens that
share a character (A cuts some in two, B falls back to its bytes) have the same
span or none, and are cut by the bytes they decode to.

Neither vocabulary has a token that goes on over a space behind another
character, so a text is cut there and each distinct piece is aligned once, as
long as a worker remembers it; a text is the sequence of its pieces. Pieces that
are new are encoded together, as the text they make with spaces between them.

How many documents hold a pair of ids linked is counted over all documents.
What a document says of its pairs joins those counts.
"""

from __future__ import annotations

import gc
import hashlib
import os
import sys
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.llm.tables import landed
from vitals.llm.words import worker_state

#: Files of the vocabularies, and ids that B may have.
VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
B_IDS = 1 << 16
#: New pieces are encoded together in texts of so many characters: one by one the
#: calls take twice the time, and longer texts take the libraries longer again.
JOINED_CHARS = 500
#: Pieces a worker remembers for sure (and at most twice as many), and the
#: longest of them in characters.
REMEMBERED, LONGEST = 100_000, 64
#: Characters whose pieces are looked up together.
BATCH_CHARS = 1 << 20
#: Counts of so many pairs are sent to all executors (some 60 MB); more are joined in a shuffle.
BROADCAST_PAIRS = 1_000_000
#: What stands for a space in B's pieces.
B_SPACE = "▁"


#: One piece of a text with the space in front of it: how many tokens of A and B and groups
#: it has, the groups as text, each with a ; behind it, and each link, a * B_IDS + b, as eight bytes.
Piece = tuple[int, int, int, str, bytes]
NO_TOKENS: Piece = (0, 0, 0, "", b"")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, and the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Aligner:
    """Both tokenizers and the pieces seen of late."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        self.a_bytes = {
            i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            for token, i in self.a.get_vocab().items()
        }
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(B_SPACE, " ").encode()
            for i, p in enumerate(self.b.id_to_piece(i) for i in range(self.b.get_piece_size()))
        ]
        if len(self.b_bytes) > B_IDS:
            raise ValueError(f"{path_b} has more than {B_IDS} ids")
        self.a_tokens = Tokens([self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)], "|")
        self.b_tokens = Tokens(self.b_bytes, ";")
        # letters, digits and ASCII signs
        self.solid = np.array([c.isalnum() or "!" <= c <= "~" for c in map(chr, range(sys.maxunicode + 1))], bool)
        # pieces met since the last turn, and those of the turn before
        self.young: dict[str, Piece | None] = {}
        self.old: dict[str, Piece | None] = {}

    def pieces(self, runs: list[list[str]]) -> list[Piece | None]:
        """One per piece of the runs; None where the tokens' bytes are not those of the piece.

        The pieces of a run are such as a text of theirs alone is cut into.
        """
        # the lists the libraries return are many and hold no cycles
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._pieces(runs)
        finally:
            if collecting:
                gc.enable()

    def _pieces(self, runs: list[list[str]]) -> list[Piece | None]:
        texts = ["".join(run) for run in runs]
        encoded_a = self.a.encode_batch(texts, add_special_tokens=False)
        # B puts the leading space there by itself
        encoded_b = self.b.encode([t[1:] for t in texts], return_type="offset_mapping", num_threads=1)
        laid = Laid(texts)
        a = Side(self.a_tokens, laid, [e.ids for e in encoded_a], [e.offsets for e in encoded_a], 0)
        b = Side(self.b_tokens, laid, [e["ids"] for e in encoded_b], [e["offsets"] for e in encoded_b], 1)
        sizes = np.array([len(run) for run in runs], np.int64)
        letters = np.fromiter(map(len, chain.from_iterable(runs)), np.int64, sizes.sum())
        lasts = laid.byte_of[np.cumsum(letters)]
        # runs whose bytes come out, and whose every piece ends with a token of both
        good = a.same & b.same
        apart = ~(a.of(good).at(laid) & b.of(good).at(laid))[lasts]
        good &= np.bincount(np.repeat(np.arange(len(runs)), sizes), apart, len(runs)) == 0
        if good.all():
            return grouped(a, b, laid, lasts)
        found = iter(grouped(a.of(good), b.of(good), laid, lasts[np.repeat(good, sizes)]))
        apiece = [[p] for run, well in zip(runs, good.tolist()) if not well and len(run) > 1 for p in run]
        alone = iter(self._pieces(apiece) if apiece else [])
        out: list[Piece | None] = []
        for run, well in zip(runs, good.tolist()):
            out += islice(found, len(run)) if well else islice(alone, len(run)) if len(run) > 1 else [None]
        return out

    def met(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[Piece | None]]:
        """How many pieces each text has, which of the distinct pieces they are, in order, and these."""
        laid = Laid([f" {text}" for text in texts])
        begins = self.cuts(laid)
        sizes = np.diff(np.searchsorted(begins, laid.letters))
        offsets = pa.py_buffer(laid.byte_of[begins].astype(np.int64))
        cut = pa.LargeStringArray.from_buffers(len(begins) - 1, offsets, pa.py_buffer(laid.whole)).dictionary_encode()
        which = cut.indices.to_numpy()
        pieces = cut.dictionary.to_numpy(zero_copy_only=False).tolist()
        young, old = self.young, self.old
        out: list[Piece | None] = [None] * len(pieces)
        new = []
        for at, piece in enumerate(pieces):
            if piece in young:
                out[at] = young[piece]
            elif piece in old:
                out[at] = young[piece] = old[piece]
            elif piece != " ":  # the empty text
                new.append(at)
        # behind a text's last piece there may be no cut
        last = {pieces[at] for at in which[np.cumsum(sizes) - 1].tolist()}
        runs = joined([pieces[at] for at in new], last)
        for at, found in zip(new, self.pieces(runs) if runs else []):
            out[at] = found
            if len(pieces[at]) <= LONGEST:
                young[pieces[at]] = found
            if len(young) >= REMEMBERED:
                self.old, self.young = young, (young := {})
        return sizes, which, out

    def cuts(self, laid: Laid) -> np.ndarray:
        """In characters, where pieces begin, and the end: in front of every text, and in front of a space
        behind a solid character, but of one at the end, as B gives no token for a space alone."""
        letters = np.frombuffer(laid.whole.decode().encode("utf-32-le"), np.uint32)
        out = np.zeros(len(letters) + 1, bool)
        out[1:-1] = (letters[1:] == ord(" ")) & self.solid[letters[:-1]]
        out[laid.letters[1:] - 1] = False
        out[laid.letters] = True
        return np.flatnonzero(out)

    def of(self, texts: list[str]) -> list[list[Piece | None]]:
        """The pieces of every text, in order."""
        sizes, which, pieces = self.met(texts)
        flat = map(pieces.__getitem__, which.tolist())
        return [list(islice(flat, n)) for n in sizes.tolist()]


def joined(pieces: list[str], last: set[str]) -> list[list[str]]:
    """Runs of consecutive pieces of JOINED_CHARS characters or one longer piece; each in ``last`` ends one."""
    runs, run, size = [], [], 0
    for piece in pieces:
        run.append(piece)
        size += len(piece)
        if size >= JOINED_CHARS or piece in last:
            runs.append(run)
            run, size = [], 0
    return [*runs, run] if run else runs


class Tokens:
    """A vocabulary: the bytes of every id, how many they are, and the id as
    text in front of a comma and in front of ``last``."""

    def __init__(self, own: list[bytes], last: str):
        self.bytes = own
        self.sizes = np.array([len(b) for b in own], np.int64)
        self.inner = np.array([f"{i}," for i in range(len(own))], object)
        self.final = np.array([f"{i}{last}" for i in range(len(own))], object)
        self.digits = np.array([len(w) for w in self.final], np.int64)


class Laid:
    """Texts one behind the other: their bytes, where each begins in characters
    and in bytes, and the first byte of every character."""

    def __init__(self, texts: list[str]):
        self.raw = [t.encode() for t in texts]
        self.whole = b"".join(self.raw)
        self.sizes = np.array([len(b) for b in self.raw], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.letters = np.cumsum([0, *(len(t) for t in texts)])
        if len(self.whole) == self.letters[-1]:
            self.byte_of = np.arange(len(self.whole) + 1)
        else:
            data = np.frombuffer(self.whole, np.uint8)
            self.byte_of = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))


class Side(NamedTuple("Fields", [("tokens", Tokens), ("ids", np.ndarray), ("ends", np.ndarray), ("counts", np.ndarray), ("same", np.ndarray)])):
    """Tokens of texts that lie one behind the other: ids, byte ends over all
    texts, tokens per text, and which texts' bytes the tokens decode to."""

    def __new__(cls, tokens: Tokens, laid: Laid, ids: list, spans: list, skipped: int):
        """``skipped``: characters in front of each text that the spans leave out."""
        counts = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int64, counts.sum())
        own = tokens.sizes[flat]
        row = np.repeat(np.arange(len(ids)), counts)
        held = np.bincount(row, own, len(ids)).astype(np.int64)
        same = held == laid.sizes
        if not same.all() or b"".join(map(tokens.bytes.__getitem__, flat.tolist())) != laid.whole:
            same = np.array(
                [b"".join(map(tokens.bytes.__getitem__, x)) == b for x, b in zip(ids, laid.raw)], bool
            )
        letters = laid.letters
        span = np.fromiter(chain.from_iterable(chain.from_iterable(spans)), np.int64, 2 * len(flat)).reshape(-1, 2)
        span = np.minimum(span + (skipped + letters[row])[:, None], letters[row + 1][:, None])
        decoded = np.cumsum(own) + (laid.begins - np.cumsum(held) + held)[row]
        # the end of a span, where the next token of the text does not begin before it
        ahead = np.append(span[1:, 0], letters[-1])
        whole = (ahead >= span[:, 1]) & (span[:, 1] > span[:, 0])
        ends = np.where(whole, laid.byte_of[span[:, 1]], decoded)
        return super().__new__(cls, tokens, flat, ends, counts, same)

    def of(self, chosen: np.ndarray) -> Side:
        """The chosen texts' tokens."""
        if chosen.all():
            return self
        kept = np.repeat(chosen, self.counts)
        return self._replace(ids=self.ids[kept], ends=self.ends[kept], counts=self.counts[chosen], same=self.same[chosen])

    def at(self, laid: Laid) -> np.ndarray:
        """Of every offset whether a token ends there."""
        out = np.zeros(len(laid.whole) + 1, bool)
        out[self.ends] = True
        return out


def grouped(a: Side, b: Side, laid: Laid, lasts: np.ndarray) -> list[Piece]:
    """The pieces that end at ``lasts``, of groups between the offsets where a token of A and one of B end."""
    cut = a.at(laid) & b.at(laid)
    # how many groups, and how many pieces, end in front of an offset
    group_at, piece_at = np.cumsum(cut) - cut, np.searchsorted(lasts, a.ends)
    group_a, group_b = group_at[a.ends], group_at[b.ends]
    n_b = np.bincount(group_b, minlength=np.count_nonzero(cut))
    # every token of A beside every token of B of its group
    repeats = n_b[group_a]
    first_b = (np.cumsum(n_b) - n_b)[group_a] - (np.cumsum(repeats) - repeats)
    beside = np.repeat(first_b, repeats) + np.arange(repeats.sum())
    links = (np.repeat(a.ids * B_IDS, repeats) + b.ids[beside]).tobytes()

    def shown(side: Side, group: np.ndarray) -> np.ndarray:
        last = np.append(group[1:] != group[:-1], True)
        return np.where(last, side.tokens.final[side.ids], side.tokens.inner[side.ids])

    # of each group the tokens of A, then those of B
    order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
    words = "".join(np.concatenate((shown(a, group_a), shown(b, group_b)))[order].tolist()) if len(order) else ""

    def summed(piece: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(piece, weights, len(lasts)).astype(np.int64)

    piece_b = np.searchsorted(lasts, b.ends)
    n_words = summed(piece_at, a.tokens.digits[a.ids]) + summed(piece_b, b.tokens.digits[b.ids])
    n_groups = summed(np.searchsorted(lasts, np.flatnonzero(cut)))
    word, link = np.cumsum(n_words), 8 * np.cumsum(summed(piece_at, repeats))
    columns = [summed(piece_at), summed(piece_b), n_groups, word - n_words, word, np.append(0, link[:-1]), link]
    return [
        (own_a, own_b, groups, words[i:j], links[k:m])
        for own_a, own_b, groups, i, j, k, m in zip(*(c.tolist() for c in columns))
    ]


def read(value: pa.Scalar) -> str:
    """The text; '' for null, empty and bytes that are no text."""
    try:
        return value.as_py() or ""
    except UnicodeDecodeError:
        return ""


def batches_of(column: pa.Array) -> Iterator[list[str]]:
    """Consecutive texts of BATCH_CHARS characters together, or one longer text."""
    texts, size = [], 0
    for value in column:
        texts.append(read(value))
        size += len(texts[-1])
        if size >= BATCH_CHARS:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def rows_of(sizes: np.ndarray, which: np.ndarray, pieces: list[Piece | None], groups: bool) -> list[pa.Array]:
    """Of texts as Aligner.met has them the columns of ``align`` behind doc_id."""
    texts = len(sizes)
    row = np.repeat(np.arange(texts), sizes)
    # a text with a piece that has no tokens has none
    bad = np.bincount(row, np.array([p is None for p in pieces], bool)[which], texts) > 0
    row, which, sizes = row[~bad[row]], which[~bad[row]], np.where(bad, 0, sizes)
    n_a, n_b, n_groups, shown, held = zip(*(p or NO_TOKENS for p in pieces))

    def summed(values: np.ndarray) -> np.ndarray:
        return np.bincount(row, values[which], texts).astype(np.int64)

    # the links of every piece, then the distinct ones of every text, with the text in front
    own = np.array([len(h) // 8 for h in held], np.int64)
    n_links = summed(own)
    first = np.cumsum(own) - own
    repeats = own[which]
    at = np.repeat(first[which] - (np.cumsum(repeats) - repeats), repeats) + np.arange(repeats.sum())
    links = np.frombuffer(b"".join(held), np.int64)[at]
    beyond = int(links.max(initial=0)) + 1
    begins = np.arange(texts + 1) * beyond
    keys, times = np.unique(links + np.repeat(begins[:-1], n_links), return_counts=True)
    offsets = np.searchsorted(keys, begins)
    pairs = keys - np.repeat(begins[:-1], np.diff(offsets))
    # the groups of all texts one behind the other, without the last ; of each
    whole = memoryview(pa.array(shown, pa.large_string()).take(pa.array(which)).buffers()[2] or b"")
    letters = np.append(0, np.cumsum(np.array([len(w) for w in shown], np.int64)[which]))
    ends = letters[np.append(0, np.cumsum(sizes))].tolist()
    pasted = [whole[i : j - 1] if i < j else whole[:0] for i, j in zip(ends, ends[1:])]
    hashes = [hashlib.sha256(g).hexdigest() if n else "" for g, n in zip(pasted, sizes.tolist())]
    out = [
        *(pa.array(summed(np.array(c, np.int64))) for c in [n_a, n_b, n_groups]),
        pa.array(n_links),
        pa.array(hashes, pa.string()),
        *(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(v)) for v in [pairs, times.astype(np.int32)]),
    ]
    return [*out, pa.array([str(g, "ascii") for g in pasted], pa.string())] if groups else out


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256,
    the distinct pairs linked (a * B_IDS + b) and how many links each has.

    With ``groups`` the groups as text, ``a1,a2|b1;a3|b2,b3``, come too.

    A text that is null, empty or no UTF-8, or that the ids do not decode to,
    has no tokens: zeros, no pairs and an empty hash. Texts are aligned whole,
    however long. Repeated rows and ids, and rows without one, are documents of
    their own; no other column is read; an empty table gives an empty result.
    The vocabularies' paths are those of the worker unless given.
    """
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"]
    kinds = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, links array<int>"
    if groups:
        names, kinds = [*names, "groups"], f"{kinds}, groups string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = path_a or public_tokenizers.path(VOCABULARY_A)
        b = path_b or public_tokenizers.path(VOCABULARY_B)
        aligner = worker_state(f"aligner:{a}:{b}", lambda: Aligner(a, b))
        for batch in batches:
            at = 0
            for texts in batches_of(batch.column("text")):
                ids = batch.column("doc_id").slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([ids, *rows_of(*aligner.met(texts), groups)], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, kinds)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, a, the documents that hold it, and whether no pair of its A id is held by more."""
    counted = (
        aligned.select(F.explode("pairs").alias("pair"))
        .groupBy("pair")
        .agg(F.count("*").alias("n_docs"))
        .withColumn("a", F.floor(F.col("pair") / B_IDS))
    )
    counted = landed(counted, "pairs")
    # one row per A id: at most as many as its vocabulary has
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counted.join(F.broadcast(most), "a").select(
        "pair", "a", "n_docs", (F.col("n_docs") == F.col("most")).alias("is_best")
    )


def scored(docs: DataFrame, **options) -> DataFrame:
    """``align`` with n_best and count_sum of every document in place of its pairs.

    n_best: links whose pair is held by most documents among those of its A id;
    count_sum: the documents that hold a link's pair, summed over links.
    """
    aligned = landed(align(docs, **options).withColumn("rid", F.monotonically_increasing_id()), "aligned")
    counts = landed(pair_counts(aligned), "pair-counts").select("pair", "n_docs", "is_best")
    if counts.count() <= BROADCAST_PAIRS:
        counts = F.broadcast(counts)
    held = aligned.select("rid", F.explode(F.arrays_zip("pairs", "links")).alias("p")).select(
        "rid", F.col("p.pairs").alias("pair"), F.col("p.links").cast("long").alias("links")
    )
    sums = (
        held.join(counts, "pair")
        .groupBy("rid")
        .agg(
            F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("n_best"),
            F.sum(F.col("links") * F.col("n_docs")).alias("count_sum"),
        )
    )
    zero = F.lit(0).cast("long")
    return (
        aligned.drop("pairs", "links")
        .join(sums, "rid", "left")
        .withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})
        .drop("rid")
    )
