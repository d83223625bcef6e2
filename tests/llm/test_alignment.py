"""Alignment of two tokenizers against whole texts, byte by byte."""

import hashlib
import random
import re
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from cases import LONG, awkward, documents, empty, prose
from tokenizers import Tokenizer

from vitals.llm import alignment as A

T = Tokenizer.from_file(P.path(A.VOCABULARY_A))
T.encode_special_tokens = True
S = sentencepiece.SentencePieceProcessor(model_file=P.path(A.VOCABULARY_B))
LETTERS = A.byte_letters()
TOKENS = {i: t for t, i in T.get_vocab().items()}


def groups_by_hand(text):
    """[(A ids, B ids)] of the whole text, from the tokens' bytes alone."""
    if not text:
        return []
    raw = f" {text}".encode()
    a = [(i, bytes(LETTERS[c] for c in TOKENS[i])) for i in T.encode(f" {text}", add_special_tokens=False).ids]
    b = [
        (i, bytes([int(S.id_to_piece(i)[3:-1], 16)]) if S.is_byte(i) else S.id_to_piece(i).replace("▁", " ").encode())
        for i in S.encode(text)
    ]
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return []
    out, at = [], [0, 0]
    own = ([], [])
    queue = ([*a], [*b])
    for end in range(1, len(raw) + 1):
        closed = []
        for side in (0, 1):
            while queue[side] and at[side] + len(queue[side][0][1]) <= end:
                i, token = queue[side].pop(0)
                at[side] += len(token)
                own[side].append(i)
            closed.append(at[side] == end)
        if all(closed):
            out.append((own[0][:], own[1][:]))
            own[0].clear()
            own[1].clear()
    return out


def by_hand(texts):
    groups = [groups_by_hand(t) for t in texts]
    links = [[(a, b) for g in own for a in g[0] for b in g[1]] for own in groups]
    count = Counter(pair for own in links for pair in set(own))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for own, pairs in zip(groups, links):
        shown = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in own)
        out.append((
            sum(len(a) for a, _ in own), sum(len(b) for _, b in own), len(own), len(pairs),
            sum(count[p] == most[p[0]] for p in pairs), sum(count[p] for p in pairs),
            hashlib.sha256(shown.encode()).hexdigest() if own else "",
        ))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "<|endoftext|> x", "x<s></s><unk> <0x41>", "語語 語", "é ß", "𝟘ﬁ ﬁ", "😀😀 👩‍👩‍👧 x",
    "a▁b", "a  b　 c", "x\u0085 y", "don't we'll 'tis", "1234 5 678,9", "\x00\x01 z", "é é", "‍ ‍", "﻿ x", "a\tb\r\nc",
    "ab" * 300, "x " * 500, "ÀÉÎ " * 40, "क्षि त्र", "مرحبا بالعالم", "𐍈 𐍈𐍈", "-- -- --", "͸ ",
]


@pytest.mark.parametrize("limit", [A.BROADCAST_PAIRS, 0])
def test_against_whole_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(A, "BROADCAST_PAIRS", limit)
    r = random.Random(5)
    letters = "ab cd  \n\t.,'-é語😀𝟘 ́ 1<>|"
    texts = ODD + ["".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(300)] + [prose(i, 50) for i in range(20)] + [prose(1, 50)]
    docs = documents(spark, list(enumerate(texts))).repartition(3)
    got = {x["doc_id"]: tuple(x[c] for c in COLUMNS) for x in A.scored(docs).collect()}
    assert [got[i] for i in range(len(texts))] == by_hand(texts)


def test_pieces_end_where_the_whole_text_is_cut():
    """No token of B goes on over a space behind another character."""
    spaced = [p for i in range(S.get_piece_size()) if "▁" in (p := S.id_to_piece(i)).lstrip("▁")]
    assert spaced == []
    assert not [t for t in TOKENS.values() if "Ġ" in t.lstrip("Ġ") and not set(t) <= set("ĠĊĉčÂł")]


def test_every_character_in_pairs():
    """Groups of pieces and of whole texts agree around every character of the lower planes."""
    aligner = A.Aligner(P.path(A.VOCABULARY_A), P.path(A.VOCABULARY_B))
    for start in range(1, 0x3100, 64):
        text = " ".join(f"{chr(c)} a{chr(c)} {chr(c)}b" for c in range(start, start + 64))
        (pieces,) = aligner.of([text])
        shown = [] if None in pieces else "".join(p[3] for p in pieces)[:-1].split(";")
        assert shown == [f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups_by_hand(text)], hex(start)


def test_awkward(spark, monkeypatch):
    monkeypatch.setattr(A, "REMEMBERED", 10)
    docs = awkward(spark)
    got = A.scored(docs).collect()
    texts = [r["text"] for r in docs.select("text").collect()]
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(by_hand(texts))
    assert A.scored(empty(spark)).count() == 0
    (row,) = A.align(documents(spark, [(1, LONG)]), groups=True).collect()
    assert hashlib.sha256(row["groups"].encode()).hexdigest() == row["groups_sha256"]
    raw = spark.sql("select 1L doc_id, cast(unhex('61ff62') as string) text")
    assert [r["n_a"] for r in A.scored(raw).collect()] == [0]


class Counted:
    """A tokenizer that counts the texts it is given."""

    def __init__(self, own):
        self.own, self.texts = own, 0

    def encode_batch(self, texts, **options):
        self.texts += len(texts)
        return self.own.encode_batch(texts, **options)

    def encode(self, texts, **options):
        self.texts += len(texts)
        return self.own.encode(texts, **options)


def shown(groups):
    return [f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups]


def test_new_pieces_are_encoded_together():
    """What the tokenizers are called for goes with the characters, not with the words."""
    aligner = A.Aligner(P.path(A.VOCABULARY_A), P.path(A.VOCABULARY_B))
    aligner.a, aligner.b = Counted(aligner.a), Counted(aligner.b)
    texts = [" ".join(f"w{i}x{i * j}é" for j in range(200)) for i in range(20)]
    got = aligner.of(texts)
    assert [len(own) for own in got] == [200] * 20
    for text, own in zip(texts, got):
        assert "".join(p[3] for p in own)[:-1].split(";") == shown(groups_by_hand(text))
    most = sum(map(len, texts)) / A.JOINED_CHARS + len(texts) + 1
    assert aligner.a.texts <= most and aligner.b.texts <= most
    # all are known now
    assert aligner.of(texts) == got and aligner.a.texts <= most


def test_a_piece_that_does_not_come_out_spoils_no_other():
    """B reads its sign for a space as a space; pieces encoded beside such a one are as they are alone."""
    aligner = A.Aligner(P.path(A.VOCABULARY_A), P.path(A.VOCABULARY_B))
    bad, good = "one two thr▁ee four five", "one two four five"
    (own, other, *ends) = aligner.of([bad, good, "", "▁", "six "])
    assert [p is None for p in own] == [False, False, True, False, False]
    assert other == [own[0], own[1], own[3], own[4]] and ends[:2] == [[None], [None]]
    assert "".join(p[3] for p in other)[:-1].split(";") == shown(groups_by_hand(good))


def test_cuts_are_where_a_pattern_has_them():
    aligner = A.Aligner(P.path(A.VOCABULARY_A), P.path(A.VOCABULARY_B))
    r = random.Random(8)
    texts = ["", " ", "a ", *("".join(r.choices("ab_ 1\n.é語😀 ́\u3000", k=r.randint(0, 30))) for _ in range(500))]
    laid = A.Laid([f" {t}" for t in texts])
    whole, cuts = laid.whole.decode(), aligner.cuts(laid).tolist()
    wanted = [p for t in texts for p in re.split(r"(?<=[\w!-~])(?= [\s\S])", f" {t}")]
    assert [whole[i:j] for i, j in zip(cuts, cuts[1:])] == wanted
