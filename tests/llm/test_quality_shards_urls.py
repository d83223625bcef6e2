"""Host rules, shards and URL rules."""

import math
import re
from collections import Counter

import pytest
from cases import LONG, awkward, documents, empty, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from vitals.llm import url_filter as U
from vitals.llm.quality import quality
from vitals.llm.shards import shards

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counted(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = Counter(windows)
    covered = {i + d for i, x in enumerate(windows) if twice[x] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (n, sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def test_counts(spark):
    texts = [None, "", "a", "a b c a b c", "x x x x", "a b\na b\n\n \nc", "#a *b$ %&|<>", "é 語\u00a0x", LONG]
    texts += ["the cat sat " * 40, prose(3, 120), prose(3, 60) + "\n" + prose(3, 60)]
    docs = documents(spark, [(i, t, "en", f"host{i % 2}") for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in quality(docs).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (
            r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]
        ) == counted(text)


def test_hosts(spark):
    good, bad = prose(1, 80), "short text"
    rows = [(i, good, "en", "fine") for i in range(40)] + [(40, bad, "en", "fine")]
    rows += [(100 + i, bad, "en", "poor") for i in range(60)] + [(199, good, "en", "poor"), (200, good, "en", None)]
    rows += [(300, bad, "en", "tiny"), (301, good, "en", "tiny")]
    got = {r["doc_id"]: (r["base_failed"], r["host_rejected"], r["kept"]) for r in quality(documents(spark, rows)).collect()}
    assert got[0] == (False, False, True) and got[40] == (True, False, False)
    assert got[199] == (False, True, False)  # a good text of a rejected host
    assert got[200] == (False, False, True) and got[301] == (False, False, True)


def test_quality_awkward(spark):
    assert quality(awkward(spark)).count() == awkward(spark).count()
    assert quality(empty(spark)).count() == 0


def split_by_hand(items, limit):
    """items: (bits as text, bytes); buckets split on one more bit while too large."""
    out, todo = {}, [("", list(items))]
    while todo:
        prefix, own = todo.pop()
        if sum(b for _, b in own) <= limit or len(own) == 1 or len(prefix) == 60:
            out |= {bits: (prefix, sum(b for _, b in own)) for bits, _ in own}
        else:
            todo += [(prefix + bit, part) for bit in "01" if (part := [x for x in own if x[0][len(prefix)] == bit])]
    return out


@pytest.mark.parametrize("limit", [1, 200, 5_000, 10**9])
def test_shards(spark, limit):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(300)] + [(7, "same")] * 120 + [(None, "n")] * 3 + [(900, "y" * 6000)]
    got = shards(documents(spark, rows), limit=limit, step=3).collect()
    assert len(got) == len(rows)
    import hashlib

    def bits(r):
        digest = hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}:{r['copy']}".encode()).hexdigest()
        return bin(int(digest[:15], 16))[2:].zfill(60)

    expected = split_by_hand([(bits(r), r["n_bytes"]) for r in got], limit)
    for r in got:
        assert (r["shard"], r["shard_bytes"]) == expected[bits(r)] and r["depth"] == len(r["shard"])
    assert Counter((r["doc_id"], r["n_bytes"]) for r in got) == Counter((i, len(t)) for i, t in rows)


def test_shards_awkward(spark):
    assert shards(awkward(spark), limit=100).count() == awkward(spark).count()
    assert shards(empty(spark)).count() == 0


def by_hand(host, path):
    """Longest fitting host rule."""
    fits = []
    for rule in U.HOST_RULES:
        h, slash, p = rule.name.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p):
            fits.append(rule)
    return max(fits, key=lambda r: len(r.name), default=None)


PIECES = ["://", "http", "net", "org", "example", ".", "/", "en/", "fr", "/de/", "?", "#", "com", "x", "NET", "\n", "\x00", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14))
def test_rules_by_hand(pieces):
    url = "".join(pieces)
    host, path = U.split_url(url)
    rules = sorted(U.HOST_RULES, key=lambda r: (-len(r.name), r.name))
    fits = U.Automaton(rules).matches([(host, path)])[0]
    found = next((r for r, fit in zip(rules, fits) if fit), None)
    assert found == by_hand(host, path)


def glob_regex(pattern):
    return re.compile("".join(".*" if c == "*" else re.escape(c) for c in pattern), re.DOTALL)


def test_many_globs_in_several_words():
    import random

    r = random.Random(2)
    globs = [
        U.GlobRule("block", "".join(r.choice("ab.*") for _ in range(r.randint(1, 12)))) for _ in range(40)
    ] + [U.GlobRule("block", "*"), U.GlobRule("block", ".ab")]
    automaton = U.Automaton(globs)
    assert automaton.words > 1
    urls = [("".join(r.choices("ab.", k=r.randint(0, 9))), "") for _ in range(200)]
    got = automaton.matches(urls)
    for (host, _), fits in zip(urls, got):
        # the gap after the host is a character of its own, which only * takes
        text = f".{host}\x01"
        assert [bool(glob_regex(g.name).fullmatch(text)) for g in globs] == fits.tolist()


def test_url_rows(spark, rows):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Net/", "http://net/x", "http://anet/", "http://a.net", "x://a.example.net/en/1?q#f",
            "http://www.casino.org/fr/2", "http://casino.org/en", "http://b.example.com/de/", "http://x.org?a=/fr/", "http://a.org/" + "y" * 5000]
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id LONG, url STRING, host STRING, rule STRING")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge_urls(pages).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4] == ("a.net", "/", "net/", "block") and got[5] == ("net", "/x", "net/", "block")
    assert got[6] == ("anet", "/", None, "allow") and got[7] == ("a.net", "", None, "allow")
    assert got[8] == ("a.example.net", "/en/1", "example.net/en/", "allow")
    assert got[9][2:] == ("org/fr/", "allow") and got[10][2:] == (None, "block")
    assert got[11][2:] == ("example.com/de/", "block") and got[12][:3] == ("x.org", "", None)
    assert U.judge_urls(pages.limit(0)).count() == 0 and math.isfinite(len(got[13][1]))
