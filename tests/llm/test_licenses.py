"""License phrases and templates against plain Python."""

import random
import re

import pytest
from cases import LONG, awkward, documents, empty, prose

from vitals.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(L.UPPER, L.LOWER)


def words(text):
    return WORD.findall(text.translate(FOLD))


def tokens(text):
    own = words(text)
    return {f"{a} {b}" for a, b in zip(own, own[1:])} or set(own)


def blocks(text):
    """Lines over WRAP characters, and what stands between them and empty lines."""
    out, run = [], []
    for line in [*text.split("\n"), ""]:
        if len(line) > L.WRAP or not line.strip(" \t\r"):
            out += ["\n".join(run)] * bool(run) + [line] * (len(line) > L.WRAP)
            run = []
        else:
            run.append(line)
    return out


def by_hand(text, templates=L.TEMPLATES, threshold=L.THRESHOLD):
    text = text or ""
    own = words(text)
    places = sorted(
        (i, label) for label, phrase in L.PHRASES for i in range(len(own)) if own[i : i + len(p := phrase.split(" "))] == p
    )
    met = []
    for block in blocks(text):
        for template in templates:
            t = tokens(template.text)
            share = len(t & tokens(block))
            if t and 100 * share >= threshold * len(t):
                met.append((template.label, share / len(t)))
    score = 1.0 if places else max((c for _, c in met), default=0.0)
    base = {label for _, label in places}
    return (
        len(own), len(places), places[0][0] if places else None, places[-1][0] if places else None,
        ",".join(sorted(base)), ",".join(sorted(base | {label for label, _ in met})), score,
    )


def results(docs, **options):
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in L.digest(L.scan(docs, **options)).collect()}


NOTICES = [t.text for t in L.TEMPLATES] + [p for _, p in L.PHRASES]


def changed(r, text):
    """Words left out, doubled or swapped, other case and signs, lines wrapped."""
    own = text.split(" ")
    for _ in range(r.randint(0, 3)):
        i = r.randrange(len(own))
        own[i : i + 1] = r.choice([[], [own[i]] * 2, ["other"], [own[i], "more"]]) or ["x"]
    own = [w.upper() if r.random() < 0.1 else w for w in own]
    return "".join(w + r.choice([" ", " ", " ", "\n", ", ", "\n# ", " \n \n", "-", "\r\n"]) for w in own)


@pytest.mark.parametrize("threshold", [50, 90, 100])
def test_against_plain_python(spark, threshold):
    r = random.Random(threshold)
    texts = []
    for i in range(250):
        parts = [r.choice([changed(r, r.choice(NOTICES)), prose(i, r.randint(1, 40)), "\n\n", "cc by cc", "é" * 101]) for _ in range(r.randint(1, 5))]
        texts.append(r.choice(["\n", " ", "\n\n"]).join(parts))
    got = results(documents(spark, list(enumerate(texts))), threshold=threshold)
    for i, text in enumerate(texts):
        assert got[i] == by_hand(text, threshold=threshold), text
    assert len({row[5] for row in got.values()}) > 12


def test_small_cases(spark):
    texts = [
        None, "", "cc by", "CC-BY", "cc  by cc\nby", "ccby", "cc é by", "all rights", "ALL RIGHTS\n\nRESERVED", "general public license general public license",
        "released under the\nMIT license", "released under the license, mit", "K cc by", "É cc by é", "x" * 300 + " cc by", LONG + " cc by",
        "permission is granted", "\n\n\n", "\x00\x7f", "word",
    ]
    got = results(documents(spark, list(enumerate(texts))))
    assert got == {i: by_hand(text) for i, text in enumerate(texts)}
    assert got[10][5] == "mit" and got[11][5] == "" and got[8][1] == 1


def test_blocks_are_returned(spark):
    text = prose(1, 50) + "\n\n" + "Released under the\nMIT License.\n\nend"
    (row,) = L.scan(documents(spark, [(1, text)])).collect()
    assert [(b["label"], b["text"], b["containment"]) for b in row["blocks"]] == [("mit", "Released under the\nMIT License.", 1.0)]
    (row,) = L.scan(documents(spark, [(1, "so: CC BY")])).collect()
    assert [tuple(p) for p in row["places"]] == [("cc-by", 1, 2)]


def test_awkward(spark):
    docs = awkward(spark)
    assert L.digest(L.scan(docs)).count() == docs.count()
    assert L.digest(L.scan(empty(spark))).count() == 0
    assert results(docs, templates=(), phrases=L.PHRASES)[8][0] == 30_000
    one = documents(spark, [(1, "mit"), (2, "x mit")])
    assert {i: row[5] for i, row in results(one, templates=(L.Template("m", "MIT"), L.Template("none", "...")), phrases=()).items()} == {1: "m", 2: ""}


def test_joined_on_prefixes_only(spark):
    listed = L.entries(L.TEMPLATES, sorted({t for x in L.TEMPLATES for t in L.template_tokens(x.text)}), 90)
    rows = L.index(spark, listed).collect()
    assert sorted((r["template"], r["token"]) for r in rows) == sorted((e.number, t) for e in listed for t in e.prefix)
    with pytest.raises(ValueError):
        L.scan(empty(spark), templates=[L.Template("big", " ".join(map(str, range(L.MAX_VOCABULARY + 2))))])
    plan = L.scan(documents(spark, [(1, "x")]))._jdf.queryExecution().toString()
    assert not re.search(r"Python|MapInArrow|ArrowEval|ExistingRDD", plan)
