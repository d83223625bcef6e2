"""Short codes of vectors: per part of a vector the index of its nearest codebook entry.

Components are integers, floor(scale * x), so all sums are exact in any order.
To find the nearest entries of a slice of vectors, every dimension gets a
dictionary of the distinct integers that stand there; the squared differences
of those values to all entries are tabulated once, and the distance of a part
is a sum of table rows gathered by the dictionary's codes.

A round of fitting is one pass over all vectors. Each task adds up its own
vectors per part and entry, so what is shuffled and what the driver holds is
the size of the codebooks, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vitals.llm.tables import landed

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose distances are held at once.
SLICE_ROWS = 4096
#: A label with at least this share of all rows is joined apart: at most so many labels are.
HOT_LABELS = 1000


def chosen(vectors: DataFrame, id_column: str, vector: str, label: str) -> DataFrame:
    return vectors.select(
        F.col(id_column).cast("long").alias("vec_id"),
        F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("vector"),
    )


def integers(column: pa.Array, dims: int | None, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept, fits, values): which rows have finite components only, which of those
    have ``dims`` components, and the integers of the latter."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(pc.list_flatten(column), float("nan")).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(lengths, 0))
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    starts = ends - np.maximum(lengths, 0)
    kept = (lengths >= 0) & (bad[ends] == bad[starts])
    fits = kept & (lengths == dims)
    rows = starts[fits][:, None] + np.arange(dims or 0)
    with np.errstate(over="ignore"):
        values = np.floor(flat[rows] * scale)
    largest = np.abs(values).max(initial=0.0)
    if largest * largest * 4 * max(dims or 0, 1) >= 2.0**62:
        raise ValueError(f"a component of size {largest / scale:g} has distances beyond 64 bits")
    return kept, fits, values.astype(np.int64)


def nearest(values: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) per vector and part; of equal distances the lower index.

    ``values`` is vectors x dims, ``books`` parts x entries x width.
    """
    parts, entries, width = books.shape
    n = len(values)
    index, error = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.int64)
    spread = 2 * max(np.abs(values).max(initial=0), np.abs(books).max(initial=0))
    kind = np.int32 if width * spread * spread < 2**31 else np.int64
    for part in range(parts):
        total = np.zeros((n, entries), kind)
        for at in range(width):
            # the dimension's dictionary, and every value of it against all entries
            dictionary, codes = np.unique(values[:, part * width + at], return_inverse=True)
            table = (dictionary[:, None] - books[part, :, at][None, :]) ** 2
            total += table.astype(kind)[codes]
        index[:, part] = total.argmin(axis=1)
        error[:, part] = total[np.arange(n), index[:, part]]
    return index, error


def first_books(vectors: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray | None:
    """The parts of the kept vectors with the smallest ids; None if there is no such vector.

    Ids come in ascending order, missing ones last, equal ones by their vectors.
    """
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    ordered = vectors.where(F.col("vector").isNotNull() & finite).orderBy(F.asc_nulls_last("vec_id"), "vector")
    smallest = [r["vector"] for r in ordered.select("vec_id", "vector").limit(entries).collect()]
    smallest = [v for v in smallest if len(v) == len(smallest[0])]
    if not smallest or not smallest[0] or len(smallest[0]) % parts:
        return None
    _, _, values = integers(pa.array(smallest, pa.list_(pa.float64())), len(smallest[0]), scale)
    return values.reshape(len(values), parts, -1).transpose(1, 0, 2)


def moved(vectors: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """Codebooks after one round: each entry the mean, rounded down, of the parts it is nearest to."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((parts * entries, width), np.int64)
        counts = np.zeros(parts * entries, np.int64)
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                _, _, values = integers(batch.column("vector").slice(at, SLICE_ROWS), parts * width, scale)
                index, _ = nearest(values, books)
                cell = (index + np.arange(parts) * entries).ravel()
                np.add.at(sums, cell, values.reshape(-1, width))
                counts += np.bincount(cell, minlength=parts * entries)
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(met), pa.array(counts[met]), pa.array(list(sums[met]), pa.list_(pa.int64()))],
            ["cell", "n", "sums"],
        )

    added = vectors.select("vector").mapInArrow(run, "cell long, n long, sums array<long>")
    total = added.groupBy("cell").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")
    )
    out = books.reshape(-1, width).copy()
    for r in total.collect():  # at most parts x entries rows
        out[r["cell"]] = [s // r["n"] for s in r["sums"]]
    return out.reshape(books.shape)


def fit(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    *,
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> np.ndarray | None:
    """Codebooks, parts x entries x width, fitted on all vectors.

    None where no vector can be coded (see ``encode``). With fewer kept vectors
    than ``entries`` the codebooks have as many entries as there are vectors.
    """
    rows = chosen(vectors, id_column, vector, vector)
    books = first_books(rows, parts, entries, scale)
    for _ in range(rounds if books is not None else 0):
        books = moved(rows, books, scale)
    return books


def encode(
    vectors: DataFrame,
    books: np.ndarray | None,
    scale: int = SCALE,
    *,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
) -> DataFrame:
    """vec_id, label, codes (one byte a part) and error of every kept vector.

    Vectors that are null or hold null, infinite or NaN components are dropped.
    Those of another length than the first coded one, and all if that has no
    whole number of components a part, have no codes and no error. Repeated
    rows and ids, or none, are coded each; no other column is read; an empty
    table gives an empty result. A component whose distances may go beyond 64
    bits (some 2**20 with 64 dimensions) is an error.
    """
    rows = chosen(vectors, id_column, vector, label)
    dims = None if books is None else books.shape[0] * books.shape[2]
    kind: StructType = rows.select("vec_id", "label").schema
    kind = kind.add("codes", "binary").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                kept, fits, values = integers(part.column("vector"), dims, scale)
                codes = np.full(len(part), None, object)
                errors = np.zeros(len(part), np.int64)
                if books is not None:
                    index, error = nearest(values, books)
                    codes[fits] = [row.tobytes() for row in index.astype(np.uint8)]
                    errors[fits] = error.sum(axis=1)
                out = [
                    part.column("vec_id"),
                    part.column("label"),
                    pa.array(codes, pa.binary()),
                    pa.array(errors, pa.int64(), mask=~fits),
                ]
                whole = pa.RecordBatch.from_arrays(out, ["vec_id", "label", "codes", "error"])
                yield whole.filter(pa.array(kept))

    return rows.mapInArrow(run, kind)


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` and ``label_error``, the errors summed over rows of equal labels, nulls together.

    Labels that many rows share are at most HOT_LABELS; their sums go to the
    rows, so that no task gets all rows of one. The others meet in a join.
    """
    coded = landed(coded, "codes")
    sums = landed(
        coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors"
    )
    is_hot = F.col("n") * HOT_LABELS >= coded.count()
    columns = [coded[c] for c in coded.columns]

    def met(rows: DataFrame, by: DataFrame) -> DataFrame:
        by = by.select(F.col("label").alias("_label"), "label_error")
        return rows.join(by, rows["label"].eqNullSafe(by["_label"])).drop("_label")

    hot = sums.where(is_hot)
    hot_names = F.broadcast(hot.select(F.col("label").alias("_label")))
    cold_rows = coded.join(hot_names, coded["label"].eqNullSafe(hot_names["_label"]), "left_anti").select(columns)
    return met(coded, F.broadcast(hot)).unionByName(met(cold_rows, sums.where(~is_hot)))


def books_sha256(books: np.ndarray | None) -> str:
    numbers = [] if books is None else books.ravel().tolist()
    return hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()


def digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code in hex, error, label_error and codebooks_sha256 of every kept vector."""
    books = fit(vectors)
    return with_label_error(encode(vectors, books)).select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(books_sha256(books)).alias("codebooks_sha256"),
    )
