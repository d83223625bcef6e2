"""Tables with the awkward cases that every operator meets."""

import random

DOCUMENTS = (
    "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, "
    # names that the operators use inside
    "id LONG, n LONG, key STRING, kept STRING, component STRING, rid STRING, bits STRING, held_out STRING, block STRING"
)


def row(doc_id, text, lang="en", source="s"):
    return (doc_id, text, lang, source, len(text or ""), 7, 7, "k", "k", "c", "r", "b", "h", "x")


def words(seed, n, letters="abcdefgh"):
    r = random.Random(seed)
    return [" ".join("".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(1)) for _ in range(n)]


def prose(seed, n):
    return " ".join(words(seed, n))


def documents(spark, rows):
    return spark.createDataFrame([row(*r) if isinstance(r, tuple) else row(r) for r in rows], DOCUMENTS)


LONG = prose(99, 30_000)


def awkward(spark):
    """Null and empty texts, null ids, languages and sources, repeats, one long text."""
    return documents(
        spark,
        [
            (1, None),
            (2, ""),
            (3, " \n\t "),
            (None, prose(1, 60)),
            (None, None, None, None),
            (4, prose(2, 60), None, None),
            (4, prose(2, 60), None, None),
            (5, prose(2, 60)),
            (6, "1234 5678 !!"),
            (7, "é ß 語 " * 20, "fr"),
            (8, LONG),
            (9, "one"),
            (10, "one"),
        ],
    )


def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
