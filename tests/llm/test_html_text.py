"""Text of articles: pages built from known parts, odd markup, and the query against a plain reading of its own pages."""

import html
import os
import random
import re

import numpy as np
import pytest

from skaldic.llm import catalog, html_text

SF = "/root/testdata/sf0.01"
TREE = html_text.trained()


def text_of(page):
    return html_text.main_texts([page], TREE)[0]


AROUND = [
    "<nav><ul><li><a href='/x'>{}</a><li><a href='/y'>{}</a></ul></nav>", "<header><h2>{}</h2><p>{}</p></header>", "<footer><p>{}</p>&copy; {}</footer>",
    "<aside><p>{}</p><p>{}</p></aside>", "<div class=\"Sidebar-left\"><div><p>{}</p>{}</div></div>", "<div id='cookieNotice'>{}<br>{}</div>",
    "<div class='ad'>{} {}</div>", "<form action='/s'><p>{}</p><input value='>'><button>{}</button></form>",
    "<section id=comments><h3>{}</h3><article><p>{}</p></article></section>", "<ol class='comment-list'><li><p>{}</p></li><li>{}</ol>",
    "<script>document.write('<p>{}</p>', \"{}\")</script>", "<style>p:before {{content: '{}'}} /* {} */</style>", "<!-- <p>{}</p> {} -->",
    "<div role='complementary'><p>{}</p>{}</div>", "<div class='related-posts'><h4>{}</h4><a href=z>{}</a></div>",
]
HOMES = ["<article>{}</article>", "<main>{}</main>", "<div class='post'><div>{}</div></div>", "<div id='content'>{}</div>", "<section class='entry-content'>{}</section>"]


@pytest.mark.parametrize("seed", range(40))
def test_known_parts(seed):
    rng = random.Random(seed)
    words = lambda most: " ".join(rng.choice(["alpha", "beta", "g&amp;h", "&eacute;t&#233;", "x &lt; y", "1 < 2"]) for _ in range(rng.randint(1, most)))
    around = lambda: "".join(rng.choice(AROUND).format(words(60), words(12)) for _ in range(rng.randint(0, 3)))
    blocks = [words(rng.choice([2, 8, 50])) for _ in range(rng.randint(1, 6))]
    marked = [rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<div>{}</div>", "<ul><li>{}</li></ul>"]).format(b.replace(" ", rng.choice([" ", "\n\t ", "<br>", "<b> ", " <em></em>"]), 1)) for b in blocks]
    inner = "".join(m + (around() if rng.random() < 0.3 else "") for m in marked)
    page = "<!DOCTYPE html><html><head><title>no</title></head><body class='with-sidebar'>" + around() + rng.choice(HOMES).format(inner) + around() + rng.choice(["", "</body></html>"])
    assert text_of(page) == "\n".join(html.unescape(b) for b in blocks)


def test_odd_markup():
    assert text_of(None) == text_of("") == text_of("<article></article>") == text_of("<p> \n</p>") == ""
    assert text_of("<article><p>cut o") == "cut o"
    assert text_of("<article><p>kept</p><a hre") == "kept"
    assert text_of("<article>a<!-- open <p>b") == "a"
    assert text_of("<article>a<script>b") == "a"
    assert text_of("<article>one&nbsp;  two &amp;lt; &#x41;</article>") == "one two &lt; A"
    assert text_of("<article><p>a<br/>b<p>c</article>") == "a b\nc"
    assert text_of("<ARTICLE><P CLASS=AD>x</P><P>y</P></ARTICLE>") == "y"
    assert text_of("<form><main><p>a page in a form</p></main></form>") == "a page in a form"
    assert text_of("</div></p></article><article>k</article>") == "k"
    long = "<article>" + "<p>word word</p>" * 50_000
    assert text_of(long) == "\n".join(["word word"] * 50_000)
    assert text_of("<div>" * 20_000 + "</section>" * 20_000 + "<a <a <a " * 20_000) == ""


def test_unmarked_page():
    """No name says anything: words and links decide."""
    text = " ".join(f"w{k}" for k in range(40))
    page = f"<div><a href=a>Home</a> <a href=b>About us</a></div><div><p>{text}</p><p>Short.</p><p>{text}</p></div><div>All rights</div>"
    assert text_of(page) == f"{text}\nShort.\n{text}"


def test_tree():
    x = np.array([[0, 5], [0, 6], [0, 7], [1, 5], [1, 6], [1, 7], [2, 1], [2, 2], [2, 3]], float)
    y = np.array([0, 0, 0, 1, 1, 1, 0, 0, 0])
    tree = html_text.grow(x, y)
    assert ((tree.predict(x) >= 0.5) == y).all()
    assert (html_text.grow(x, np.ones(9, int)).predict(x) == 1).all()
    features, labels = html_text.labelled()
    assert ((TREE.predict(features) >= 0.5) == labels).all()


def test_rows(spark):
    rows = [(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (None, None, None), (2, "v", "<nav>b</nav>"), (3, None, "")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(map(repr, html_text.extract(pages).collect()))
    want = [(1, "u", "a"), (1, "u", "a"), (None, None, ""), (2, "v", ""), (3, None, "")]
    assert got == sorted(f"Row(page_id={p!r}, url={u!r}, text={t!r})" for p, u, t in want)
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query(spark):
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = catalog.op12_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        found = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)
        pieces = re.split(r"</?(?:p|h1)>", found[1].replace("<br>", " ") if found else "")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in pieces]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])
