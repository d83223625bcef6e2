"""Near copies by HyperMinHash, banding and exact verification.

A text's shingles fall into buckets by their hash; each bucket keeps of its
smallest hash the count of leading zeros and some mantissa bits. Runs of these
registers are band keys. Texts that share a key meet; the share of equal
registers, corrected for chance, estimates their similarity; what is left is
verified on the full sets, and verified links are closed into components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitals.llm.components import components
from vitals.llm.tables import arrow_batches, landed, sieved
from vitals.llm.words import Words, chained, distinct, fold_table, mix, signed, slices, worker_state

SIMILARITY = 80  # per cent of the union
#: 48 bands of 6 registers: a pair at the threshold shares none in 5 of 10 million.
BANDS, BAND = 48, 6
BUCKETS = BANDS * BAND
#: Bits of a register: mantissa, and six for the leading zeros.
MANTISSA = 10
#: Texts of a key that are compared with all others go in blocks of so many
#: texts and so many shingles.
BLOCK_TEXTS, BLOCK_SHINGLES = 64, 1 << 15
#: Bytes of rows that are handed to a worker at once.
BATCH_BYTES = 4 << 20
#: Pairs whose sets a task holds at once.
PAIRS = 500
#: An estimate this far below the threshold (six deviations at BUCKETS
#: registers) ends a pair; sets smaller than BUCKETS are verified anyway.
MARGIN = 0.14
#: Expected share of equal registers by chance, times 2**MANTISSA, at equal sizes.
CHANCE = 0.169919487159739
#: An empty bucket looks for a value in so many others, then in the next that has one.
DENSIFY_TRIES = 64


# --- registers ------------------------------------------------------------


def _probes() -> np.ndarray:
    """[try, bucket] the bucket an empty one borrows from."""
    at = np.arange(DENSIFY_TRIES * BUCKETS, dtype=np.uint64).reshape(DENSIFY_TRIES, BUCKETS)
    return (mix(at + np.uint64(0x5EED)) % np.uint64(BUCKETS)).astype(np.int64)


def registers(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """[row, bucket] registers of sorted distinct (row, hash); empty rows are 0."""
    bucket = ((h >> np.uint64(32)) * np.uint64(BUCKETS)) >> np.uint64(32)
    slot = row * BUCKETS + bucket.astype(np.int64)
    # rows are sorted by hash, so a bucket's hashes stand together
    rest = mix(h)
    new = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1]))) if len(slot) else slot
    least = np.minimum.reduceat(rest, new) if len(new) else rest
    low = (least & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high = np.floor(least.astype(np.float64) / 2.0**32)
    value = np.maximum(high + low / 2.0**32, 2.0**-32)
    power = np.floor(np.log2(value))
    zeros = (31 - power).astype(np.int64)  # leading zeros, 0 to 63
    part = np.floor((value / 2.0**power - 1) * (1 << MANTISSA)).astype(np.int64).clip(0, (1 << MANTISSA) - 1)
    out = np.zeros(rows * BUCKETS, dtype=np.uint16)
    out[slot[new]] = ((zeros.clip(0, 62) + 1) << MANTISSA | part).astype(np.uint16)
    return densified(out.reshape(rows, BUCKETS))


def densified(table: np.ndarray) -> np.ndarray:
    """Every empty bucket takes the value of the first of its probes that has one."""
    filled = table != 0
    out = table.copy()
    r, b = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    for probe in worker_state("probes", _probes):
        if not len(r):
            return out
        from_ = probe[b]
        hit = filled[r, from_]
        out[r[hit], b[hit]] = table[r[hit], from_[hit]]
        r, b = r[~hit], b[~hit]
    for i, j in zip(r, b):  # hardly ever: the next one that has a value
        full = np.flatnonzero(filled[i])
        out[i, j] = table[i, full[np.searchsorted(full, j) % len(full)]]
    return out


def band_keys(table: np.ndarray) -> np.ndarray:
    """[row, band] keys of runs of registers."""
    parts = table.astype(np.uint64).reshape(len(table), BANDS, BAND)
    keys = chained([parts[:, :, i] + np.uint64(1) for i in range(BAND)])
    return mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of register rows, corrected for chance."""
    equal = (a == b).mean(axis=1)
    ratio = n_a / np.maximum(n_b, 1)
    chance = CHANCE / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / (1 - chance)


def sets_of(column: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text."""
    table = fold_table(punctuation=False)
    out: list[np.ndarray] = []
    for _, data, offsets in slices(column):
        row, h = distinct(*Words(data, offsets, table).shingles(n))
        ends = np.searchsorted(row, np.arange(1, len(offsets) - 1), side="left")
        out += np.split(h, ends)
    return out


# --- stages ---------------------------------------------------------------


def sketches(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, digest of the text, n_shingles, digest of the set, registers of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = fold_table(punctuation=False)
        for batch in batches:
            for first, data, offsets in slices(batch.column("text")):
                rows = len(offsets) - 1
                row, h = distinct(*Words(data, offsets, table).shingles(n))
                size = np.bincount(row, minlength=rows)
                digest = np.zeros((2, rows), dtype=np.uint64)
                if len(h):
                    has = np.flatnonzero(size)
                    at = np.concatenate(([0], np.cumsum(size[has])[:-1]))
                    digest[0, has] = np.add.reduceat(mix(h + np.uint64(1)), at)
                    digest[1, has] = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0xABCDEF)), at)
                regs = registers(row, h, rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(first, rows),
                        batch.column("t").slice(first, rows),
                        pa.array(size.astype(np.int64)),
                        pa.array(signed(digest[0])),
                        pa.array(signed(digest[1])),
                        pa.array([r.tobytes() for r in regs], pa.binary()),
                    ],
                    ["doc_id", "t", "n", "d1", "d2", "regs"],
                )

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(cast(text as string)) t", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id long, t long, n long, d1 long, d2 long, regs binary")


def keys_of(sets: DataFrame) -> DataFrame:
    """key, id: one row per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = band_keys(np.array([np.frombuffer(r, np.uint16) for r in batch.column("regs").to_pylist()]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(keys.reshape(-1))),
                    pa.array(np.repeat(batch.column("id").to_numpy(zero_copy_only=False), BANDS)),
                ],
                ["key", "id"],
            )

    return sets.select("id", "regs").mapInArrow(run, "key long, id long")


def verified(pairs: DataFrame, near: DataFrame, n: int, similarity: int) -> DataFrame:
    """Of the pairs (a, b) those whose sets reach the similarity.

    The registers' estimate ends most of the others; the rest is counted.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # few pairs at once: their sets are held together
        for batch in (b.slice(at, PAIRS) for b in batches for at in range(0, b.num_rows, PAIRS)):
            a, b = (
                np.array([np.frombuffer(r, np.uint16) for r in batch.column(c).to_pylist()])
                for c in ("regs_a", "regs_b")
            )
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            likely = (estimate(a, b, n_a, n_b) >= similarity / 100 - MARGIN) | (np.minimum(n_a, n_b) < BUCKETS)
            batch = batch.filter(pa.array(likely))
            left, right = sets_of(batch.column("text_a"), n), sets_of(batch.column("text_b"), n)
            good = []
            for x, y in zip(left, right):
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= similarity * (len(x) + len(y) - common) and common > 0)
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    sides = [near.select(*[F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "regs", "text")]) for side in "ab"]
    pairs = landed(pairs.select("a", "b").distinct(), "pairs")
    # a text with many partners is dealt out as so many copies of itself
    fans = pairs.groupBy("a").agg(F.expr(f"cast(ceil(count(*) / {PAIRS}) as int)").alias("fan"))
    dealt = pairs.join(fans, "a").select("a", "b", F.expr("pmod(xxhash64(b), fan)").alias("salt"))
    heads = sieved(sides[0], fans.selectExpr("a id_a"), "id_a")
    left = fans.join(heads, F.col("a") == F.col("id_a")).select(
        "id_a", "n_a", "regs_a", "text_a", F.explode(F.expr("sequence(0L, fan - 1L)")).alias("salt_a")
    )
    met = (
        dealt.join(sides[1], F.col("b") == F.col("id_b"))
        .join(left, (F.col("a") == F.col("id_a")) & (F.col("salt") == F.col("salt_a")))
        .where(f"100 * least(n_a, n_b) >= {similarity} * greatest(n_a, n_b)")
        .select("a", "b", "n_a", "n_b", "regs_a", "regs_b", "text_a", "text_b")
    )
    return met.mapInArrow(check, "a long, b long")


def shingle_sets(near: DataFrame, n: int) -> DataFrame:
    """id and its set, as bytes of sorted hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [h.tobytes() for h in sets_of(batch.column("text"), n)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.binary())], ["id", "set"])

    return near.select("id", "text").mapInArrow(run, "id long, set binary")


def compared(left: pa.StructArray, right: pa.StructArray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of two blocks whose sets reach the similarity, components apart."""
    sets, others = (
        [np.frombuffer(value.as_buffer(), np.uint64) for value in side.field("set")] for side in (left, right)
    )
    words = np.unique(np.concatenate(sets))
    has, other = (np.zeros((len(side), len(words)), dtype=np.float32) for side in (sets, others))
    for i, h in enumerate(sets):
        has[i, np.searchsorted(words, h)] = 1
    for i, h in enumerate(others):
        at = np.searchsorted(words, h).clip(max=len(words) - 1)
        other[i, at[words[at] == h]] = 1
    common = has @ other.T
    size, other_size = (np.array([len(h) for h in side]) for side in (sets, others))
    good = 100 * common >= similarity * (size[:, None] + other_size[None, :] - common)
    component, other_component = (side.field("component").to_numpy() for side in (left, right))
    good &= component[:, None] != other_component[None, :]
    i, j = np.nonzero(good)
    return left.field("id").to_numpy()[i], right.field("id").to_numpy()[j]


def remaining(met: DataFrame, near: DataFrame, n: int, similarity: int) -> DataFrame:
    """Links (a, b) within a key between texts not yet in one component.

    ``met`` has key, id, n, component. Texts outside the key's largest
    component meet all texts of the key, as blocks of sets: a row of the join
    is two blocks, not two texts. A key of two texts has been compared already,
    and of keys that the same texts share one stands for all.
    """
    same = [
        F.bit_xor(F.xxhash64("id")).alias("x"),
        F.sum(F.xxhash64("id", "n").cast("decimal(38,0)")).alias("s"),
    ]
    parts = met.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"), *same)
    # the key's largest component, its texts, its shingles
    keys = (
        parts.groupBy("key")
        .agg(
            F.max(F.struct("c", "component")).alias("largest"),
            F.count("*").alias("components"),
            F.sum("c").alias("texts"),
            F.sum("n").alias("shingles"),
            F.bit_xor("x").alias("x"),
            F.sum("s").alias("s"),
        )
        .where("components > 1 and texts > 2")
        .groupBy("largest", "components", "texts", "shingles", "x", "s")
        .agg(F.min("key").alias("key"))
        .select(
            "key",
            F.col("largest.component").alias("main"),
            F.expr(f"cast(greatest(ceil(texts / {BLOCK_TEXTS}), ceil(shingles / {BLOCK_SHINGLES})) as int)").alias("blocks"),
        )
    )
    rows = landed(met.join(keys, "key"), "unresolved")
    sets = shingle_sets(near.join(rows.select("id").distinct(), "id"), n)
    whole = landed(rows.join(sets, "id").withColumn("block", F.expr("pmod(xxhash64(id), blocks)")), "unresolved-sets")
    item = F.struct("id", "component", "set")
    every = whole.groupBy("key", "block").agg(F.collect_list(item).alias("right"))
    outside = (
        whole.where("component <> main").groupBy("key", "block").agg(F.collect_list(item).alias("left")).drop("block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                left, right = (batch.column(c)[row].values for c in ("left", "right"))
                found = compared(left, right, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["a", "b"])

    blocks = outside.join(every, "key").select("left", "right").mapInArrow(run, "a long, b long").distinct()
    return landed(blocks, "rest")


def near_groups(docs: DataFrame, shingle: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Documents with 100 * intersection >= similarity * union of their shingle
    sets are linked; ``component_id`` is the smallest doc_id reachable, and
    ``kept`` marks the document that has it. A text shorter than a shingle is
    one shingle; a null text, and one without words, is linked with nothing.
    Rows that repeat a doc_id are one document; a null id is linked with
    nothing, has a null component and is kept. Other columns are not read; an
    empty table gives an empty result.

    Of the texts that share a key, each is verified against the one that meets
    most others; where that leaves more than one component, the texts outside
    the largest are compared with all. So a key costs little more than its size
    if its texts are copies of each other, and no link is left out.
    """
    # texts and blocks of sets make rows so large that batches are bounded by their bytes
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        return _grouped(docs, shingle, similarity)


def _grouped(docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    # worked out twice, as writing the registers of all rows costs more than hashing again
    sketched = sketches(docs, shingle)
    able = "n > 0 and doc_id is not null"
    known = landed(sketched.drop("regs", "t"), "sketches")
    # equal sets are one from here on
    sets = landed(
        sketched.where(able)
        .groupBy("n", "d1", "d2")
        .agg(F.min(F.struct("doc_id", "t")).alias("first"), F.first("regs").alias("regs"))
        .selectExpr("n", "d1", "d2", "first.doc_id id", "first.t t", "regs"),
        "sets",
    )
    equal = known.where(able).join(sets.select("n", "d1", "d2", "id"), ["n", "d1", "d2"])
    equal = landed(equal.where("doc_id <> id").selectExpr("doc_id a", "id b"), "equal-sets")

    # smaller sets reach the similarity only if equal
    wide = sets.where(f"100 * n >= {similarity} * (n + 1)")
    keys = keys_of(wide)
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = landed(keys.join(landed(shared, "shared"), "key"), "met")
    # the texts that meet others, once each, and all that is needed of them
    # by id and text, as rows of one id may differ in their texts
    texts = docs.selectExpr("cast(doc_id as long) id", "cast(text as string) text").selectExpr("*", "xxhash64(text) t")
    involved = landed(met.select("id").distinct(), "involved")
    near = (
        sieved(wide.select("id", "t", "n", "regs"), involved, "id")
        .join(involved, "id")
        .join(sieved(texts, involved, "id"), ["id", "t"])
    )
    near = landed(near.dropDuplicates(["id", "n", "regs"]), "near")
    company = met.groupBy("id").agg(F.sum("size").alias("company"))
    heads = (
        met.join(company, "id")
        .groupBy("key")
        .agg(F.max(F.struct("company", "id")).alias("head"))
        .selectExpr("key", "head.id head")
    )
    star = met.join(heads, "key").where("id <> head").selectExpr("head a", "id b")
    star = landed(verified(star, near, shingle, similarity), "star")
    labels = near.select("id", "n").distinct().join(components(star), "id", "left")
    at = met.join(labels.withColumn("component", F.coalesce("component", "id")), "id")
    rest = remaining(landed(at, "met-components"), near, shingle, similarity)

    closed = components(union([equal, star, rest]))
    return (
        known.select("doc_id", F.col("n").alias("n_shingles"))
        .join(closed.selectExpr("id doc_id", "component component_id"), "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
        .withColumn("kept", F.expr("doc_id <=> component_id"))
    )


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
