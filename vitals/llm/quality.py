"""Quality rules on documents and their hosts, in DataFrame operations only.

Counts are taken of each whole text; failures are summed by host; a host's
failure rates, shrunk towards a beta prior fitted over all hosts, give a
verdict that goes back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.llm.tables import landed, text_or_empty

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
#: A document fails beyond so many per cent.
MAX_REPEATS, MAX_SYMBOLS, MAX_DUP_LINES = 50, 20, 60
#: A host is rejected if the shrunk rate of one rule's failures exceeds this.
MAX_HOST_RATE = 0.75
#: Bounds of the prior's weight, in documents.
MIN_WEIGHT, MAX_WEIGHT = 2.0, 1000.0

RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEATS} * n_words",
    "symbols": f"100 * n_symbols > {MAX_SYMBOLS} * word_chars",
    "dup_lines": f"100 * n_dup_lines > {MAX_DUP_LINES} * n_lines",
}
BASE_RULES = ("short", "repeats")


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, source and the counts of every text."""
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        text_or_empty().alias("text"),
    ).select(
        "doc_id",
        "source",
        (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.array_remove(F.split(text, f"{SPACE}+"), "").alias("words"),
    )
    # hashes of the windows of three words, in order
    hashed = split.select(
        "doc_id",
        "source",
        "word_chars",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(
            "if(size(words) < 3, array(), transform(sequence(0, size(words) - 3), "
            "i -> xxhash64(words[i], words[i + 1], words[i + 2])))"
        )
        .cast("array<long>")
        .alias("windows"),
    )
    # only texts with a repeated window are sorted
    sorted_ = hashed.withColumn(
        "placed",
        F.expr(
            "if(size(array_distinct(windows)) = size(windows), null, "
            "sort_array(transform(windows, (h, i) -> named_struct('h', h, 'p', i))))"
        ),
    )
    repeated = sorted_.withColumn(
        "places",
        F.expr(
            "sort_array(transform(filter(placed, (e, i) -> e.h = get(placed, i - 1).h "
            "or e.h = get(placed, i + 1).h), e -> e.p))"
        ),
    )
    covered = F.expr(
        "aggregate(transform(places, (p, i) -> least(3, coalesce(get(places, i + 1) - p, 3))), "
        "0, (a, x) -> a + x)"
    )
    return repeated.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop(
        "windows", "placed", "places"
    )


def judged(counted: DataFrame) -> DataFrame:
    return counted.select("*", *[F.expr(rule).alias(f"fails_{name}") for name, rule in RULES.items()])


def host_rates(marked: DataFrame) -> DataFrame:
    """source, n_docs and, per rule, the shrunk failure rate; one row per host.

    The prior of a rule has the mean of all documents and the weight that the
    spread of the hosts' rates calls for (method of moments).
    """
    hosts = (
        marked.where("source is not null")
        .groupBy("source")
        .agg(
            F.count("*").alias("n_docs"),
            *[F.sum(F.col(f"fails_{name}").cast("long")).alias(name) for name in RULES],
        )
    )
    means = [(F.sum(name) / F.sum("n_docs")).alias(f"mean_{name}") for name in RULES]
    squares = [(F.sum(F.col(name) * F.col(name) / F.col("n_docs")) / F.sum("n_docs")).alias(f"square_{name}") for name in RULES]
    prior = hosts.agg(*means, *squares).first()

    def shrunk(name: str) -> Column:
        mean = prior[f"mean_{name}"] or 0.0
        spread = max((prior[f"square_{name}"] or 0.0) - mean * mean, 1e-9)
        weight = min(max(mean * (1 - mean) / spread - 1, MIN_WEIGHT), MAX_WEIGHT)
        return ((F.col(name) + mean * weight) / (F.col("n_docs") + weight)).alias(f"rate_{name}")

    return hosts.select("source", "n_docs", *[shrunk(name) for name in RULES])


def quality(docs: DataFrame, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """doc_id, source, the counts, base_failed, host_rejected and kept of every row.

    A null or empty text has no words and fails. A null source is no host and
    rejects nothing. Repeated rows are counted and returned each; other columns
    are not read; an empty table gives an empty result.
    """
    marked = landed(judged(counts(docs)), "quality")
    worst = F.greatest(*[F.col(f"rate_{name}") for name in RULES])
    hosts = host_rates(marked).select("source", worst.alias("host_rate"))
    failed = F.expr(" or ".join(f"fails_{name}" for name in BASE_RULES))
    return (
        marked.join(hosts, "source", "left")
        .withColumn("base_failed", failed)
        .withColumn("host_rejected", F.coalesce(F.col("host_rate") > max_host_rate, F.lit(False)))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
        .select(
            "doc_id",
            "source",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "base_failed",
            "host_rejected",
            "kept",
        )
    )
