"""License notices in texts, in DataFrame operations only.

Two things are found. *Phrases*: their words stand consecutively anywhere in a
text. *Templates*: a block of a text holds at least ``THRESHOLD`` per cent of
the distinct tokens of a template, a token being two words in a row (of a block
or template of one word that word). Blocks and templates meet in an exact
set-similarity join on single tokens:

* tokens are ordered by how often they stand in the corpus, rarest first;
* of a template of n tokens, a of which must be met, a block holds at least one
  of the first n - a + 1 (prefix filter), so only those are joined on;
* a block with fewer than a template tokens is no partner (length filter);
* a pair is looked at where its first common token stands, and only if that
  leaves a tokens on either side (positional filter);
* what is left is counted on the full sets.

The templates are a parameter of bounded size; all else covers all rows. Texts
are split in place, so none is shuffled: only matches are.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitals.llm.tables import landed, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, after A-Z have been lower-cased, and words.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A line longer than this is a block; shorter ones are wrapped text, and a
#: block of them ends at a longer or an empty line.
WRAP = 100
LONG_LINE = rf"[^\n]{{{WRAP + 1},}}"
BLOCK_END = rf"{LONG_LINE}|\n[ \t\r]*\n"
#: Per cent of a template's tokens. Templates below ten tokens are met in full.
THRESHOLD = 90
#: Distinct tokens of all templates together; they travel inside the plan.
MAX_VOCABULARY = 20_000

#: Label and words that stand consecutively.
PHRASES = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)


class Template(NamedTuple):
    label: str
    text: str


#: Short notices, and sentences of well-known licenses and of their notices.
TEMPLATES = (
    Template("mit", "released under the MIT License"),
    Template("mit", "licensed under the MIT License"),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software",
    ),
    Template("apache-2.0", "licensed under the Apache License, Version 2.0"),
    Template(
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "apache.org/licenses/LICENSE-2.0",
    ),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
    ),
    Template("lgpl", "GNU Lesser General Public License"),
    Template("agpl", "GNU Affero General Public License"),
    Template("cc-by-4.0", "licensed under CC BY 4.0"),
    Template("cc-by-nc-4.0", "licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "licensed under CC BY-SA 4.0"),
    Template("cc-by-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc0", "Creative Commons CC0 1.0 Universal public domain dedication"),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template(
        "warranty",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ),
    Template("proprietary", "unauthorized copying of this file, via any medium, is strictly prohibited"),
)


def template_tokens(text: str) -> list[str]:
    """Distinct tokens of a template, split as the texts are."""
    words = re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
    return list(dict.fromkeys(pairs or words))


def needed(n: int, threshold: int = THRESHOLD) -> int:
    """Tokens that a block must share with a template of n tokens."""
    return -(-threshold * n // 100)


def lowered(text: Column) -> Column:
    """A-Z in lower case; of a text in ASCII ``lower`` touches nothing else, and is faster."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lowered(text), BREAK), "")


def bound(value: Column, use) -> Column:
    """``use(value)``, with ``value`` worked out once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(words: Column) -> Column:
    """Every two words in a row; one word alone."""
    n = F.size(words)
    return F.zip_with(
        F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(1))),
        F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(1))),
        lambda a, b: F.concat_ws(" ", a, b),
    )


def token_order(docs: DataFrame, vocabulary: Sequence[str]) -> list[str]:
    """The vocabulary, the rarest token of the corpus first; ties by the token.

    Counts are combined before the shuffle and there is one per template token.
    """
    token = F.explode(bound(words_of(text_or_empty()), tokens)).alias("token")
    counted = docs.select(token).where(F.col("token").isin(list(vocabulary))).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in counted.collect()}
    return sorted(vocabulary, key=lambda t: (counts.get(t, 0), t))


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


class Entry(NamedTuple):
    """A template that has tokens: its number, they in order, and how many are needed."""

    number: int
    label: str
    tokens: list[str]
    needed: int

    @property
    def prefix(self) -> list[str]:
        return self.tokens[: len(self.tokens) - self.needed + 1]


def entries(templates: Sequence[Template], order: Sequence[str], threshold: int) -> list[Entry]:
    rank = {token: i for i, token in enumerate(order)}
    sized = [sorted(template_tokens(t.text), key=rank.__getitem__) for t in templates]
    return [
        Entry(i, t.label, own, needed(len(own), threshold)) for i, (t, own) in enumerate(zip(templates, sized)) if own
    ]


def index(spark: SparkSession, listed: Sequence[Entry]) -> DataFrame:
    """The side of the join to look up: one row per template and token of its prefix."""
    rows = [
        F.struct(
            F.lit(e.number).alias("template"),
            F.lit(e.label).alias("label"),
            strings(e.tokens).alias("template_tokens"),
            F.lit(e.needed).alias("needed"),
        )
        for e in listed
    ]
    placed = spark.range(1).select(F.inline(F.array(*rows)))
    placed = placed.select("*", F.posexplode("template_tokens").alias("at", "token"))
    return placed.where(F.col("at") <= F.size("template_tokens") - F.col("needed")).drop("at")


def phrase_places(words: Column, phrases: Sequence[tuple[str, str]]) -> Column:
    """Places of all phrases: label, start and length in words."""
    starts = F.sequence(F.lit(0), F.size(words) - 1)

    def of(label: str, phrase: list[str]) -> Column:
        def stands(i: Column) -> Column:
            return reduce(Column.__and__, [F.get(words, i + k) == w for k, w in enumerate(phrase)])

        return F.transform(
            F.filter(starts, stands),
            lambda i: F.struct(
                F.lit(label).alias("label"), i.cast("long").alias("start"), F.lit(len(phrase)).alias("length")
            ),
        )

    return F.concat(*[of(label, phrase.split(" ")) for label, phrase in phrases])


def scan(
    docs: DataFrame,
    templates: Sequence[Template] = TEMPLATES,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    threshold: int = THRESHOLD,
) -> DataFrame:
    """doc_id, n_words, places and blocks of every row.

    ``places``: label, start and length in words of every phrase. ``blocks``:
    label, template (its number), containment and text of every block that
    meets a template; a block stands once per template it meets.

    A null text is empty: no words, empty lists. Rows that repeat an id, or
    have none, are scanned and returned each. Of ``docs`` only doc_id and text
    are read. Texts of any length are scanned whole, a row at a time. An empty
    table, no templates or templates without a word give no matches.
    """
    vocabulary = list(dict.fromkeys(token for t in templates for token in template_tokens(t.text)))
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"templates of over {MAX_VOCABULARY} tokens: scan for parts of them, as matches are independent")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = token_order(docs, vocabulary) if vocabulary else []
    listed = entries(templates, order, threshold)
    prefix = sorted({token for e in listed for token in e.prefix})
    least = min((e.needed for e in listed), default=1)

    text = F.col("text")
    pieces = F.concat(F.regexp_extract_all(text, F.lit(LONG_LINE), F.lit(0)), F.split(text, BLOCK_END))
    split = F.transform(pieces, lambda b: F.struct(b.alias("text"), words_of(b).alias("words")))

    def held(blocks: Column) -> Column:
        """Blocks with a token of some prefix; of them the templates' tokens, rarest first."""
        if not prefix:
            return F.array()
        cut = F.transform(blocks, lambda b: F.struct(b["text"].alias("text"), tokens(b["words"]).alias("tokens")))
        met = F.filter(cut, lambda b: F.exists(b["tokens"], lambda t: t.isin(prefix)))
        ranked = F.transform(
            met,
            lambda b: F.struct(
                b["text"].alias("text"), F.array_intersect(strings(order), b["tokens"]).alias("tokens")
            ),
        )
        return F.filter(ranked, lambda b: F.size(b["tokens"]) >= least)

    block_type = "array<struct<text:string,tokens:array<string>>>"
    counted = bound(
        split,
        lambda blocks: F.struct(
            F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + F.size(b["words"])).alias("n_words"),
            held(blocks).cast(block_type).alias("held"),
        ),
    )
    # texts that may hold a phrase: its longest word as a substring, then its words between breaks
    longest = {max(phrase.split(" "), key=len) for _, phrase in phrases}
    may_hold = reduce(Column.__or__, [F.contains(F.lower(text), F.lit(w)) for w in sorted(longest)], F.lit(False))
    hint = "|".join(phrase.replace(" ", BREAK) for _, phrase in phrases)
    places = F.when(
        may_hold & F.rlike(lowered(text), F.lit(hint)),
        bound(words_of(text), lambda words: phrase_places(words, phrases)) if phrases else F.array(),
    ).otherwise(F.array())
    scanned = landed(
        docs.withColumn("text", text_or_empty())
        .select(
            "doc_id",
            counted.alias("counted"),
            places.cast("array<struct<label:string,start:long,length:int>>").alias("places"),
            F.monotonically_increasing_id().alias("rid"),
        )
        .select("doc_id", "counted.n_words", "places", "counted.held", "rid"),
        "licenses",
    )
    found = "array<struct<label:string,template:int,containment:double,text:string>>"
    if not listed:
        return scanned.select("doc_id", "n_words", "places", F.array().cast(found).alias("blocks"))

    block = scanned.select("rid", F.posexplode("held").alias("block", "b")).select("rid", "block", "b.text", "b.tokens")
    looked_up = block.select("*", F.posexplode("tokens").alias("place", "token"))
    size = F.size("tokens")
    pairs = (
        # bounded by MAX_VOCABULARY tokens
        looked_up.join(F.broadcast(index(docs.sparkSession, listed)), "token")
        .where((size >= F.col("needed")) & (size - F.col("place") >= F.col("needed")))
        .withColumn("common", F.array_intersect("template_tokens", "tokens"))
        .where((F.get("common", F.lit(0)) == F.col("token")) & (F.size("common") >= F.col("needed")))
        .withColumn("containment", F.size("common") / F.size("template_tokens"))
    )
    # blocks of one text: bounded by the text itself
    matched = pairs.groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("block", "template", "label", "containment", "text"))).alias("pairs")
    )
    return scanned.join(matched, "rid", "left").select(
        "doc_id",
        "n_words",
        "places",
        F.transform(
            F.coalesce("pairs", F.array()),
            lambda p: F.struct(
                p["label"].alias("label"), p["template"].alias("template"),
                p["containment"].alias("containment"), p["text"].alias("text"),
            ),
        ).cast(found).alias("blocks"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and labels of every row of ``scan``.

    ``score`` is 1 where a phrase stands, else the greatest containment of a
    template in a block that meets it, else 0.
    """

    def named(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    starts = F.transform("places", lambda p: p["start"])
    base, more = F.transform("places", lambda p: p["label"]), F.transform("blocks", lambda b: b["label"])
    best = F.array_max(F.transform("blocks", lambda b: b["containment"]))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"),
        named(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
