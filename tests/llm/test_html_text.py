"""Main text of pages."""

import random
import re

import pytest

from vitals.llm import html_text as H


@pytest.fixture(scope="module")
def model():
    return H.fit()


def one(model, page):
    return H.main_texts(model, [page])[0]


WRAP = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav><!-- ad -->"
    "<div class='ad'>Buy this now, friend.</div>%s<footer>&copy; host &middot; All rights reserved.</footer></body></html>"
)


def test_blocks_and_character_references(model):
    body = "<article><h1>A &amp; B</h1><p><b>First\n  one.<br><p>Second &lt;one&gt;&nbsp;here.</p><p> </p></article>"
    assert one(model, WRAP % body) == "A & B\n\nFirst one.\n\nSecond <one> here."


def test_other_parts_are_left_out(model):
    body = (
        "<div class='cookie-notice'><p>We use cookies here.</p></div>"
        "<div id='post-content'><h1>Title here</h1><p>%s</p><p>%s</p></div>"
        "<aside class='sidebar'><h3>Related</h3><ul><li><a href='x'>Other story</a></li></ul></aside>"
        "<form class='search'><label>Search</label><input></form>"
        "<section id='comments'><h3>Comments</h3><div class='comment'><p>I liked it, really.</p></div></section>"
    ) % ("Some words of the story, told at length. " * 6, "More of the same, until the end. " * 5)
    text = one(model, WRAP % body)
    assert text.split("\n\n")[0] == "Title here" and text.count("\n\n") == 2
    for other in ("cookies", "Related", "Search", "liked", "rights", "Buy", "One"):
        assert other not in text


def test_open_nodes_have_open_parents():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(50):
        n = 12
        parents = np.array([-1, *[r.integers(0, i) for i in range(1, n)]])
        odds = r.normal(size=n)
        open_ = H.decoded(parents, odds)
        assert all(open_[parents[i]] or not open_[i] for i in range(1, n))
        # no allowed labelling is more likely
        def likelihood(label):
            asked = np.append(True, label[parents[1:]])
            return -np.logaddexp(0, np.where(label, -odds, odds))[asked].sum()

        best = -np.inf
        for bits in range(1 << n):
            label = np.array([(bits >> i) & 1 for i in range(n)], dtype=bool)
            if all(label[parents[i]] or not label[i] for i in range(1, n)):
                best = max(best, likelihood(label))
        assert abs(likelihood(open_) - best) < 1e-6


def test_held_out_generated_pages(model):
    maker, main = H.PageMaker(4711), re.compile(f"[{H.MAIN_LETTERS}]", re.I)
    right = 0
    for _ in range(150):
        page = maker.page()
        nodes, _, _ = H.describe(H.parse(page))
        expected = "\n\n".join(n.text for n in nodes if n.text and main.search(n.text))
        right += one(model, page) == expected
    assert right >= 0.9 * 150


def built(r):
    """A page of opaque names, built otherwise than those of the fit, and its main text."""
    vocabulary = "river stone cloud lamp window garden paper letter engine market winter table music village".split()

    def name():
        return r.choice([f' class="c{r.randint(1000, 9999)}"', f' class="sc-{r.randint(10, 99)}k"', f' id="b{r.random()}"', ""])

    def words(low, high):
        return " ".join(r.choices(vocabulary, k=r.randint(low, high))).capitalize() + "."

    def links(n):
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(1, 4)}</a></li>' for i in range(n)) + "</ul>"

    def box(tag, inside):
        return f"<{tag}{name()}>{inside}</{tag}>"

    blocks = [("h1", words(3, 9))] if r.random() < 0.8 else []
    for _ in range(r.randint(3, 9)):
        blocks.append(("p", " ".join(words(6, 18) for _ in range(r.randint(2, 6)))))
        if r.random() < 0.2:
            blocks.append(("h2", words(2, 5)))
    story = box(r.choice(["div", "section"]), "".join(f"<{tag}>{text}</{tag}>" for tag, text in blocks))
    menu = box(r.choice(["nav", "div"]), links(r.randint(3, 8)))
    remarks = [box("div", f"<b>{words(1, 2)}</b><p>{words(4, 14)}</p>") for _ in range(r.randint(2, 5))]
    parts = [
        box("div", f"<p>{words(5, 12)}</p><button>OK</button>") if r.random() < 0.4 else "",
        box("header", box("div", words(1, 3)) + menu) if r.random() < 0.5 else menu,
        box("div", story) if r.random() < 0.5 else story,
        box("div", f"<h3>{words(1, 2)}</h3>" + "".join(remarks)) if r.random() < 0.4 else "",
        box("div", f"<h3>{words(1, 3)}</h3>" + links(r.randint(3, 6))) if r.random() < 0.6 else "",
        box(r.choice(["footer", "div"]), f"<p>{words(3, 8)}</p><a href='/'>{words(1, 2)}</a>"),
    ]
    return f"<html><body>{''.join(parts)}</body></html>", "\n\n".join(text for _, text in blocks)


def test_pages_with_names_that_tell_nothing(model):
    r = random.Random(7)
    pages = [built(r) for _ in range(200)]
    assert sum(one(model, page) == text for page, text in pages) >= 190


STORY = "<h1>Head line</h1><p>Some words of the page, long enough. And more.</p><p>The second part, and its end is here.</p>"
TOLD = "Head line\n\nSome words of the page, long enough. And more.\n\nThe second part, and its end is here."


@pytest.mark.parametrize(
    "before",
    [
        "<nav><svg><path d='x'><ul><li><a href='x'>One</a></li></ul></nav>",
        "<svg><title>icon</title>",
        "<button>Menu",
        "<select><option>a<option>b",
        "<select><option>a<select><option>b</select>",
        "<template>",
        "<template><article><p>Not shown, at all.</p></article></template>",
        "<object><object>a</object>b</object>",
        "<dialog><div><p>Not shown</div><p>either</dialog>",
        "<nav><a href='x'><svg></a><a href='y'>Two</a></nav>",
    ],
)
def test_dropped_parts_end(model, before):
    page = f"<html><body>{before}<article>{STORY}</article><footer>&copy; host</footer></body></html>"
    assert one(model, page) == TOLD


def test_parts_inside_text(model):
    inside = STORY.replace("second", "second <math><mi>x</mi><annotation>TeX</annotation></math> <button>Copy</button>")
    assert one(model, WRAP % f"<article>{inside}</article>") == TOLD.replace("second", "second x")
    cut = STORY.replace("second", "second <a href='x'><svg></a> and")
    assert one(model, WRAP % f"<article>{cut}</article>") == TOLD.replace("second", "second and")


def test_many_parts_that_never_end():
    deep = H.parse("<object>" * 20_000 + "<svg><a>" * 20_000 + "<p>x</p>")
    assert [node.text for node in H.describe(deep)[0] if node.text] == ["x"]


@pytest.mark.parametrize("page", ["", "text", "<", "<p", "<p>a", "<article><p>x</p", "<!-- open", "<a href='", "<script>x", "</div></p>"])
def test_broken_markup(model, page):
    assert isinstance(one(model, page), str)


def test_deep_and_long_pages(model):
    assert isinstance(one(model, "<div>" * 20_000 + "x"), str)
    long = "word " * 200_000
    assert len(one(model, WRAP % f"<article><p>{long}</p></article>")) == len(long) - 1


def test_rows(spark, rows):
    page = WRAP % "<article><h1>Head</h1><p>Some body text, of the page. And more of it.</p></article>"
    pages = spark.createDataFrame(
        [(1, "u", page, "x"), (1, "u", page, "x"), (None, None, None, "x"), (2, "v", "", "x")],
        "page_id LONG, url STRING, html STRING, text STRING",
    )
    expected = "Head\n\nSome body text, of the page. And more of it."
    out = rows(H.extract(pages))
    assert out == sorted([(1, "u", expected)] * 2 + [(None, None, ""), (2, "v", "")], key=repr)
    assert H.extract(pages.limit(0)).count() == 0
