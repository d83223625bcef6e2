"""Language of whole texts, by spans of words.

A text is cut into words; a word's letters tell its script, and the script
leaves the languages that write it. Letter trigrams score the word in each.
Viterbi's best path over the words, where changing the language costs a fixed
penalty, labels spans; the language with most letters is the document's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitals.llm.tables import carried
from vitals.llm.words import mix, slices, worker_state

UNKNOWN = "und"
#: The classifier is fitted on about so many labelled rows at most.
TRAIN_ROWS = 12_000
BUCKETS = 1 << 16
SMOOTHING = 0.5
#: Log-likelihood that a change of language must gain.
PENALTY = 12.0
#: A script counts as a language's own from this share of its letters.
SCRIPT_SHARE = 0.005
FOREIGN = -50.0

#: First and last code point of the scripts told apart; fixed values.
SCRIPTS = (
    ("Latin", 0x0041, 0x024F),
    ("Greek", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Tamil", 0x0B80, 0x0BFF),
    ("Thai", 0x0E00, 0x0E7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Ethiopic", 0x1200, 0x137F),
    ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x1F00, 0x1FFF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF),
    ("Han", 0x20000, 0x3FFFF),
)
SCRIPT_NAMES = ("other", *dict.fromkeys(name for name, _, _ in SCRIPTS))
TOP = 0x40000


def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point below TOP: its lower case; its script, -1 unless a letter."""
    lower = np.arange(TOP, dtype=np.uint32)
    script = np.full(TOP, -1, dtype=np.int8)
    for code in [*range(0x20000), 0x20000]:
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        lower[code] = ord(c.lower()[0])
        if c.isalpha():
            script[code] = 0
    script[0x20000:] = 0
    for name, first, last in SCRIPTS:
        part = script[first : last + 1]
        part[part >= 0] = SCRIPT_NAMES.index(name)
    lower[[0x0B, 0x0C, 0x0D, 0x09, 0x0A]] = 32
    return lower, script


class Letters:
    """Words and hashed letter trigrams of one slice of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        codes, at = code_points(data, offsets)
        lower, script = worker_state("characters", _characters)
        known = np.minimum(codes, TOP - 1)
        codes, self.script = lower[known], script[known]
        solid = codes != 32
        edge = np.zeros(len(codes) + 1, dtype=bool)
        edge[at] = True
        before = np.concatenate(([True], ~solid))[: len(codes)]
        opens = solid & (before | edge[:-1])
        self.start = np.flatnonzero(opens)
        self.row = np.searchsorted(at, self.start, side="right") - 1
        self.counts = np.bincount(self.row, minlength=len(offsets) - 1)
        wide = codes.astype(np.uint64)
        left = np.concatenate(([32], wide))[: len(codes)].astype(np.uint64)
        left[opens] = 32
        right = np.concatenate((wide[1:], [32])).astype(np.uint64)[: len(codes)]
        right[edge[1:]] = 32
        h = mix((left << np.uint64(42)) ^ (wide << np.uint64(21)) ^ right)
        self.letter = self.script >= 0
        self.bucket = (h >> np.uint64(48)).astype(np.int64)  # 16 bits
        self.letters = self.per_word(self.letter.astype(np.int64))

    def per_word(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.start) if len(self.start) else values[:0]

    def scripts_per_word(self) -> np.ndarray:
        bits = np.where(self.letter, np.int64(1) << self.script.clip(0).astype(np.int64), 0)
        return np.bitwise_or.reduceat(bits, self.start) if len(self.start) else bits[:0]


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the rows, and where each row starts among them."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    leads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    if leads[-1] == len(codes):
        return codes, leads[offsets]
    rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:])]
    codes = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
    return codes, np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)


class Model:
    """Log-probabilities of trigrams and the scripts of each language."""

    def __init__(self, languages: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        used = max(1, int((counts.sum(axis=0) > 0).sum()))
        totals = counts.sum(axis=1, keepdims=True)
        self.logp = np.log((counts + SMOOTHING) / (totals + SMOOTHING * used)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.scripts = [sum(1 << int(s) for s in np.flatnonzero(row >= SCRIPT_SHARE)) for row in share]

    def word_scores(self, letters: Letters) -> np.ndarray:
        """[language, word] log-likelihoods; far below where the script is another's."""
        found = letters.scripts_per_word()
        out = np.empty((len(self.languages), len(letters.start)))
        fits = np.array([(found & scripts) != 0 for scripts in self.scripts])
        nobody = ~fits.any(axis=0) | (found == 0)
        for i, logp in enumerate(self.logp):
            out[i] = letters.per_word(np.where(letters.letter, logp[letters.bucket], 0).astype(np.float64))
            out[i][~fits[i] & ~nobody] += FOREIGN
        return out


def best_paths(scores: np.ndarray, row: np.ndarray, counts: np.ndarray, penalty: float) -> np.ndarray:
    """The language of every word on its text's best path.

    A text has its best single language throughout if no other gains half the
    penalty on any run of words: of k runs in other languages, even without one
    in the best, k - 1 changes cost at least as much as k such gains. That is
    found by the largest sum of a run, for all texts at once; the others go
    through Viterbi, one word of each at a time.
    """
    languages, words = scores.shape
    texts = len(counts)
    first = np.concatenate(([0], np.cumsum(counts)[:-1]))
    has = np.flatnonzero(counts)
    totals = np.zeros((languages, texts))
    if words:
        totals[:, has] = np.add.reduceat(scores, first[has], axis=1)
    single = totals.argmax(axis=0)
    path = single[row]
    if not words or languages < 2:
        return path
    open_ = np.zeros(texts, dtype=bool)
    base = scores[path, np.arange(words)]
    for i in range(languages):
        gain = scores[i] - base
        total = np.cumsum(gain)
        reach = 2 * (np.abs(total).max() + 1)
        low = np.concatenate(([0.0], total[:-1])) - reach * row
        run = total - (np.minimum.accumulate(low) + reach * row)
        open_[has] |= np.maximum.reduceat(run, first[has]) > penalty / 2 - 1e-6
    todo = np.flatnonzero(open_)
    if not len(todo):
        return path
    todo = todo[np.argsort(-counts[todo], kind="stable")]
    lengths, at = counts[todo], first[todo]
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    came = np.empty((languages, int(lengths.sum())), dtype=np.int8)
    placed = np.concatenate(([0], np.cumsum(live)))
    state = scores[:, at].copy()
    own = np.arange(languages)[:, None]
    for t in range(1, len(live)):
        n = live[t]
        now = state[:, :n]
        best = now.argmax(axis=0)
        jump = now[best, np.arange(n)] - penalty
        stay = now >= jump
        came[:, placed[t] : placed[t] + n] = np.where(stay, own, best)
        state[:, :n] = np.where(stay, now, jump) + scores[:, at[:n] + t]
    label = state.argmax(axis=0)
    for t in range(len(live) - 1, -1, -1):
        n = live[t]
        path[at[:n] + t] = label[:n]
        if t:
            label[:n] = came[label[:n], placed[t] + np.arange(n)]
    return path


def held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Counts of trigrams and scripts per language, over a sample of labelled rows.

    Rows held out, without language or text take no part. The sample holds
    about ``train_rows`` rows, chosen by a hash of the id; the counts are
    combined before the shuffle and number at most languages x buckets.
    """
    labelled = docs.where("text is not null and lang is not null").where(~held_out())
    share = min(1.0, train_rows / max(labelled.count(), 1))
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column("lang").to_pylist(), dtype=object)
            out: dict[str, np.ndarray] = {}
            for row, data, offsets in slices(batch.column("text")):
                letters = Letters(data, offsets)
                ends = code_points(data, offsets)[1]
                owner = np.searchsorted(ends, np.arange(len(letters.letter)), side="right") - 1
                for name in dict.fromkeys(lang[row : row + len(offsets) - 1]):
                    rows = np.flatnonzero(lang[row : row + len(offsets) - 1] == name)
                    own = letters.letter & np.isin(owner, rows)
                    size = BUCKETS + len(SCRIPT_NAMES)
                    seen = np.bincount(letters.bucket[own], minlength=size)
                    seen += np.bincount(BUCKETS + letters.script[own].astype(np.int64), minlength=size)
                    out[name] = out.get(name, 0) + seen
            for name, seen in out.items():
                at = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int64)), pa.array(seen[at])],
                    ["lang", "bucket", "n"],
                )

    table = (
        chosen.selectExpr("cast(lang as string) lang", "text")
        .mapInArrow(count, "lang string, bucket long, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(names), BUCKETS + len(SCRIPT_NAMES)))
    index = {name: i for i, name in enumerate(names)}
    lang = np.array([index[name] for name in table.column("lang").to_pylist()], dtype=np.int64)
    counts[lang, table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return Model(names, counts[:, :BUCKETS], counts[:, BUCKETS:])


def label(model: Model, data: np.ndarray, offsets: np.ndarray, penalty: float = PENALTY):
    """Of the rows of a slice: language and score, and each word's row and language."""
    letters = Letters(data, offsets)
    texts, languages = len(offsets) - 1, len(model.languages)
    if not languages:
        return [UNKNOWN] * texts, np.zeros(texts), letters, np.zeros(len(letters.start), np.int64)
    scores = model.word_scores(letters)
    path = best_paths(scores, letters.row, letters.counts, penalty)
    weight = np.zeros((texts, languages))
    np.add.at(weight, (letters.row, path), letters.letters)
    total = weight.sum(axis=1)
    best = weight.argmax(axis=1)
    own = path == best[letters.row]  # the words labelled so, and how sure they are
    likely = np.zeros((languages, texts))
    for i in range(languages):
        likely[i] = np.bincount(letters.row[own], scores[i][own], minlength=texts)
    mine = likely[best, np.arange(texts)]
    likely[best, np.arange(texts)] = -np.inf
    margin = mine - (likely.max(axis=0) if languages > 1 else mine - 50)
    sure = 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
    score = np.where(total > 0, weight.max(axis=1) / np.maximum(total, 1) * sure, 0.0)
    names = [model.languages[b] if n else UNKNOWN for b, n in zip(best, total)]
    return names, score, letters, path


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ``spans`` of every row.

    ``spans`` lists (lang, first word, words) along the text. ``lang_pred`` is
    ``und`` with score 0 for a null text, one without a letter, and where no
    language was learned; ties go to the first language by name. Repeated rows
    give repeated rows; of other columns none is read.
    """
    shared = carried(docs.sparkSession, model)  # languages x 2**16 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        span = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())])
        for batch in batches:
            for row, data, offsets in slices(batch.column("text")):
                names, score, letters, path = label(model, data, offsets, penalty)
                new = np.ones(len(path), dtype=bool)
                new[1:] = (path[1:] != path[:-1]) | (letters.row[1:] != letters.row[:-1])
                at = np.flatnonzero(new)
                sizes = np.diff(np.append(at, len(path)))
                first = np.concatenate(([0], np.cumsum(letters.counts)[:-1]))
                langs = np.array([*model.languages, UNKNOWN], dtype=object)
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array(langs[path[at]] if model.languages else [UNKNOWN] * len(at), pa.string()),
                        pa.array((at - first[letters.row[at]]).astype(np.int32)),
                        pa.array(sizes.astype(np.int32)),
                    ],
                    fields=list(span),
                )
                ends = np.concatenate(([0], np.cumsum(np.bincount(letters.row[at], minlength=len(offsets) - 1))))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(row, len(offsets) - 1),
                        batch.column("held_out").slice(row, len(offsets) - 1),
                        pa.array(names, pa.string()),
                        pa.array(score),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), spans),
                    ],
                    ["doc_id", "held_out", "lang_pred", "score", "spans"],
                )

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        held_out().alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return rows.mapInArrow(
        run,
        "doc_id long, held_out boolean, lang_pred string, score double, "
        "spans array<struct<lang: string, first: int, words: int>>",
    )


def identify(docs: DataFrame, train_rows: int = TRAIN_ROWS, penalty: float = PENALTY) -> DataFrame:
    """``fit`` and ``predict`` on the same rows."""
    return predict(docs, fit(docs, train_rows), penalty)


def with_language(docs: DataFrame, train_rows: int = TRAIN_ROWS, penalty: float = PENALTY) -> DataFrame:
    """The rows of ``docs`` whose text has a language; all columns stay as they are.

    A null text and one without a letter have none, and nothing has where no
    language was learned.
    """
    shared = carried(docs.sparkSession, fit(docs, train_rows))
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared()
        for batch in batches:
            named = []
            for _, data, offsets in slices(batch.column(at)):
                named += [name != UNKNOWN for name in label(model, data, offsets, penalty)[0]]
            yield batch.filter(pa.array(named, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
