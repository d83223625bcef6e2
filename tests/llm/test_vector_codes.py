"""Codes and codebooks against plain integer arithmetic."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from vitals.llm import vector_codes as V

# label and others clash with names used inside
SCHEMA = "vec_id LONG, embedding ARRAY<FLOAT>, label INT, error STRING, codes STRING, n STRING, vector STRING, cell INT"


def table(spark, rows):
    return spark.createDataFrame([(*r, "e", "c", "n", "v", 1) for r in rows], SCHEMA)


def by_hand(rows, parts, entries, rounds, scale=V.SCALE):
    """(books, [(vec_id, label, codes, error)]) of rows of equal length."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    ints = [[math.floor(scale * float(np.float32(x))) for x in v] for _, v, _ in kept]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assigned():
        found = []
        for c in cut:
            best = [min((sum((a - b) ** 2 for a, b in zip(c[p], e)), i) for i, e in enumerate(books[p])) for p in range(parts)]
            found.append(([i for _, i in best], sum(d for d, _ in best)))
        return found

    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, (codes, _) in zip(cut, now) if codes[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    return books, [(r[0], r[2], bytes(codes), error) for r, (codes, error) in zip(kept, assigned())]


def some_rows(seed, n, dims, spread=1.0):
    r = random.Random(seed)
    rows = [(i, [r.choice([r.gauss(0, spread), 0.0, -0.5]) for _ in range(dims)], r.choice([None, 1, 2, i])) for i in range(n)]
    return rows + rows[:5] + [(7, [r.random() for _ in range(dims)], 2), (None, [0.25] * dims, None)]


BAD = [(1000, None, 1), (1001, [None] * 8, 1), (1002, [1.0] * 7 + [float("nan")], 2), (1003, [float("inf")] * 8, None)]


@pytest.mark.parametrize("seed, n, parts, entries, spread", [(1, 300, 4, 16, 1.0), (2, 40, 2, 64, 300.0), (3, 120, 8, 3, 0.01), (4, 90, 1, 8, 3e4)])
def test_against_plain_arithmetic(spark, seed, n, parts, entries, spread):
    rows = some_rows(seed, n, 8, spread)
    docs = table(spark, rows + BAD).repartition(5)
    books = V.fit(docs, parts, entries)
    expected, coded = by_hand(rows, parts, entries, V.ROUNDS)
    assert books.tolist() == expected
    got = [tuple(r) for r in V.encode(docs, books).select("vec_id", "label", "codes", "error").collect()]
    assert sorted(got, key=repr) == sorted([(a, b, bytearray(c), d) for a, b, c, d in coded], key=repr)


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_label_errors(spark, monkeypatch, hot):
    monkeypatch.setattr(V, "HOT_LABELS", hot)
    rows = [(i, [i / 7, i % 5 / 3], [None, 1, 1, 1, i][i % 5]) for i in range(200)]
    coded = V.encode(table(spark, rows), V.fit(table(spark, rows), 2, 4))
    got = V.with_label_error(coded).collect()
    sums = {}
    for r in got:
        sums[r["label"]] = sums.get(r["label"], 0) + r["error"]
    assert len(got) == 200 and all(r["label_error"] == sums[r["label"]] for r in got)


def test_awkward(spark):
    assert V.digest(table(spark, [])).count() == 0
    assert V.digest(table(spark, BAD)).count() == 0
    # another length than the first, and one that 16 parts do not cut
    rows = [(1, [0.5] * 32, 1), (2, [0.5] * 31, 1), (3, [], None), (4, [0.5] * 32, None)]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in V.digest(table(spark, rows)).collect()}
    assert got == {1: ("00" * 16, 0, 0), 2: (None, None, 0), 3: (None, None, 0), 4: ("00" * 16, 0, 0)}
    uneven = {r["vec_id"]: r["code"] for r in V.digest(table(spark, [(1, [0.5] * 31, 1), (2, [0.5] * 32, 1)])).collect()}
    assert uneven == {1: None, 2: None}
    assert [r["code"] for r in V.digest(table(spark, [(1, [], 1)])).collect()] == [None]


def test_distances_beyond_64_bits_are_refused():
    with pytest.raises(ValueError):
        V.integers(pa.array([[1e20] * 16]), 16, 256)


def test_ties_go_to_the_lower_index():
    books = np.array([[[5], [3], [3], [7]]])
    index, error = V.nearest(np.array([[4], [3], [6], [100]]), books)
    assert index[:, 0].tolist() == [0, 1, 0, 3] and error[:, 0].tolist() == [1, 0, 1, 93 * 93]
