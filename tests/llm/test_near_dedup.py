"""Near copies against all pairs."""

import random

import numpy as np
from cases import LONG, awkward, documents, empty, prose, words

from vitals.llm import near_dedup as N
from vitals.llm.components import components


def shingles(text, n):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = lower.encode().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def expected(docs, n):
    sets = {d: shingles(t, n) for d, t in docs}
    low = {d: d for d in sets}
    ids = sorted(sets)
    changed = True
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    ]
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return sorted((d, len(sets[d]), low[d], low[d] == d) for d in ids)


def edited(r, base, share):
    return " ".join("".join(r.choices("xyz", k=5)) if r.random() < share else w for w in base)


def test_against_all_pairs(spark, rows):
    r = random.Random(5)
    docs = [(i, prose(1000 + i, r.randint(3, 80))) for i in range(60)]
    for group in range(12):
        base = words(group, r.choice([4, 5, 6, 12, 40, 200]))
        docs += [(100 + 20 * group + k, edited(r, base, r.choice([0, 0.01, 0.03, 0.05, 0.08]))) for k in range(14)]
    # a passage shared by many, which alone makes no link
    common = prose(77, 40)
    docs += [(500 + i, common + " " + prose(3000 + i, 30)) for i in range(40)]
    docs += [(600, docs[0][1].upper()), (601, "a b c d"), (602, "a b c d e"), (603, "A\tB\nc d e"), (604, "a b c")]
    df = documents(spark, docs)
    for n in (2, 5):
        got = rows(N.near_groups(df, shingle=n), "doc_id", "n_shingles", "component_id", "kept")
        assert got == sorted(expected(docs, n), key=repr)


def test_awkward(spark, rows):
    got = {r[0]: r[1:] for r in rows(N.near_groups(awkward(spark), shingle=2)) if r[0] is not None}
    assert got[1] == got[2][:1] + (1, True) and got[2] == (0, 2, True) and got[3] == (0, 3, True)
    assert got[4] == (59, 4, True) and got[5] == (59, 4, False)
    assert got[9] == (1, 9, True) and got[10] == (1, 9, False)
    assert got[8] == (len(shingles(LONG, 2)), 8, True)
    none = [r for r in rows(N.near_groups(awkward(spark), shingle=2)) if r[0] is None]
    assert sorted(none, key=repr) == [(None, 0, None, True), (None, 59, None, True)]
    assert N.near_groups(empty(spark)).count() == 0


def test_estimate_follows_similarity():
    r = random.Random(3)
    base = [f"w{i}" for i in range(2000)]
    for share in (0.0, 0.02, 0.05, 0.1):
        texts = [" ".join(base), edited(r, base, share)]
        sets = N.sets_of(__import__("pyarrow").array(texts), 2)
        regs = [N.registers(np.zeros(len(s), np.int64), s, 1) for s in sets]
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        near = N.estimate(*regs, *[np.array([len(s)]) for s in sets])[0]
        assert abs(near - true) < N.MARGIN


def test_components_of_a_path_and_a_star(spark, rows):
    path = [(i, i + 1) for i in range(1, 40)]
    star = [(100, i) for i in range(101, 160)]
    edges = spark.createDataFrame(path + star + path[:3] + [(7, 7)], "a LONG, b LONG")
    assert rows(components(edges)) == sorted(
        [(i, 1) for i in range(1, 41)] + [(i, 100) for i in range(100, 160)], key=repr
    )
    assert components(edges.limit(0)).count() == 0


def test_a_sieve_keeps_every_row_that_is_meant(spark):
    from vitals.llm.tables import sieved

    rows = spark.range(20_000).selectExpr("if(id % 17 = 0, null, id) id", "cast(id as string) text")
    ids = spark.range(0, 20_000, 7).unionByName(spark.sql("select cast(null as bigint) id"))
    kept = sieved(rows, ids, "id")
    assert kept.columns == rows.columns
    assert kept.join(ids, "id").count() == rows.join(ids, "id").count()
    assert kept.count() < 4_000 + 20_000 // 17
    assert sieved(rows, ids.limit(0), "id").count() == 0


def test_texts_that_share_an_id_are_one_document(spark, rows):
    a, b, c = (words(900 + i, 60) for i in range(3))
    near = lambda base: [*base[:30], "other", *base[31:]]
    docs = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(c)), (5, " ".join(c))]
    docs += [(7, " ".join(near(a))), (8, " ".join(near(b))), (9, " ".join(near(c))), (10, prose(4001, 60))]
    got = {(r[0], r[1]) for r in rows(N.near_groups(documents(spark, docs)), "doc_id", "component_id")}
    assert got == {(5, 5), (7, 5), (8, 5), (9, 5), (10, 10)}


def test_a_text_with_many_partners_is_dealt_out(spark, rows, monkeypatch):
    monkeypatch.setattr(N, "PAIRS", 3)
    base = words(77, 90)
    docs = [(i, " ".join([*base[:40], f"only{i}", *base[41:]])) for i in range(40)] + [(50, prose(4002, 60))]
    got = rows(N.near_groups(documents(spark, docs)), "doc_id", "component_id")
    assert got == sorted([(i, 0) for i in range(40)] + [(50, 50)], key=repr)
