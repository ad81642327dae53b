"""The labelled table: small pages in pieces, each piece text of the article (1) or not (0).

``{n}`` stands for n words of its own and ``{n*}`` for as many times the scale at
which a page is filled, so that every page is learned with short and with long texts.
"""

from __future__ import annotations

import re

_LINKS = "<ul><li><a href=/a>{1}</a></li><li><a href=/b>{2}</a></li><li><a href=/c>{1}</a></li><li><a href=/d>{2}</a></li></ul>"
_TEXT = "<p>{9*}</p><p>{1}</p><p>{14*}</p><p>{3}</p>"

EXAMPLES = [
    [("<html><body><nav>" + _LINKS + "</nav>", 0), ("<div class='ad'>{6*}</div>", 0), ("<article><h1>{6}</h1><p><b>{12*}<br>" + _TEXT + "</article>", 1), ("<footer>{7}</footer>", 0)],
    [("<header><div>{3}</div><a href=/>{1}</a></header><nav><a href=/>{1}</a> <a href=/>{2}</a></nav>", 0), ("<main><h1>{5}</h1>" + _TEXT, 1), ("<aside><h3>{2}</h3><p>{9*}</p></aside>", 0), ("<h2>{3}</h2>" + _TEXT + "</main>", 1), ("<footer><p>{8}</p>" + _LINKS + "</footer>", 0)],
    [("<div id='top-menu'>" + _LINKS + "</div>", 0), ("<div class='cookie-notice'><p>{15}</p><p>{4}</p></div>", 0), ("<div id='content'><h1>{7}</h1>" + _TEXT + "<ul><li>{5*}</li><li>{2}</li></ul></div>", 1), ("<div id='comments'><h3>{2}</h3><div><p>{12*}</p></div><div><p>{5*}</p><p>{2}</p></div></div>", 0), ("<div class='copyright'>{6}</div>", 0)],
    [("<div class='header'><h2>{3}</h2></div>", 0), ("<div class='post'><h1>{5}</h1><div class='entry'>" + _TEXT, 1), ("<div class='share'><a href=/>{1}</a> {1}</div>", 0), ("<blockquote>{8*}</blockquote><p>{4} <a href=/>{2}</a> {6*}</p></div></div>", 1), ("<ol class='commentlist'><li class='comment'><p>{16*}</p></li><li class='comment'><p>{3}</p></li></ol>", 0), ("<form action=/><p>{4}</p><label>{2}</label></form>", 0)],
    [("<div><a href=/>{1}</a> <a href=/>{1}</a> <a href=/>{2}</a></div>", 0), ("<div><h1>{6}</h1><p>{22*}</p><p>{12*}</p><p>{2}</p><p>{31*}</p><p>{17*}</p></div>", 1), ("<div>{6}</div>", 0)],
    [("<table><tr><td><a href=/>{2}</a><p><a href=/>{1}</a></p><p><a href=/>{2}</a></p></td><td>", 0), ("<p>{24*}</p><p>{18*}</p><p>{6*}</p><p>{30*}</p>", 1), ("</td></tr></table><center>{5}</center>", 0)],
    [("<div>{9} <a href=/>{3}</a> {2} <a href=/>{4}</a></div>", 0), ("<div><p>{40*}</p><p>{2}</p><p>{12*} <a href=/>{2}</a> {9*}</p></div>", 1), ("<div>{7} <a href=/>{5}</a> {3} <a href=/>{3}</a></div>", 0)],
    [("<div><p>{15}</p><p>{12}</p></div>", 0), ("<article><p>{8*}</p><p>{1}</p></article>", 1), ("<div><p>{21}</p></div><div>{30*}</div>", 0)],
    [("<p>{20*}</p><p>{3}</p><p>{9*}</p>", 1)],
    [("{25*}", 1)],
    [("<body><h1>{4}</h1><p>{11*}</p><h2>{2}</h2><p>{2}</p><p>{16*}</p></body>", 1)],
    [("<article><h1>{5}</h1>" + _TEXT, 1), ("<aside class='related'><h4>{2}</h4>" + _LINKS + "</aside>", 0), ("<p><a href=/>{3}</a></p>" + _TEXT + "<ul><li>{4}</li><li><a href=/>{2}</a></li></ul></article>", 1), ("<section class='comments'><article class='comment-body'><p>{12*}</p><p>{4}</p></article><article><p>{9*}</p></article></section>", 0)],
    [("<div role='navigation'>" + _LINKS + "</div>", 0), ("<div role='alert'>{9*}</div>", 0), ("<div role='main'><h1>{5}</h1>" + _TEXT + "</div>", 1), ("<div class='sidebar'><p>{10*}</p>" + _LINKS + "<div><p>{4}</p></div></div>", 0), ("<div id='footer'><p>{12}</p></div>", 0)],
    [("<div class='promo-box'><h3>{3}</h3><p>{14*}</p></div>", 0), ("<article><p>{2}</p>" + _TEXT, 1), ("<div class='advert'><p>{9*}</p></div><div class='newsletter-signup'><p>{11}</p></div>", 0), ("<table><tr><td>{3}</td><td>{1}</td></tr></table><p>{8*}</p>", 1), ("<footer><p>{4}</p></footer><nav><a href=/>{1}</a></nav></article>", 0)],
    [("<nav><p>{3}</p></nav><header><h1>{3}</h1><p>{8*}</p></header>", 0), ("<section class='article-text'><h2>{4}</h2>" + _TEXT + "</section>", 1), ("<section id='discussion'><div class='reply'><div>{13*}</div><div>{2}</div></div></section>", 0), ("<form><p>{6*}</p><select><option>{1}</option></select><button>{2}</button></form><dialog><p>{9*}</p></dialog>", 0)],
    [("<div><div><ul><li><a href=/>{3}</a></li><li><a href=/>{5}</a></li><li><a href=/>{4}</a></li></ul></div>", 0), ("<div><h2>{5}</h2><div>{35*}</div><div>{28*}</div><div>{19*}</div></div>", 1), ("<div><p><a href=/>{4}</a></p><p><a href=/>{6}</a></p></div><div><p>{5}</p></div></div>", 0)],
    [("<article><header><h1>{5}</h1><p>{3}</p></header>", 0), (_TEXT + "<figure><figcaption>{5}</figcaption></figure></article>", 1), ("<div class='popup'><div>{8*}</div></div><div class='widget'><p>{7*}</p></div>", 0)],
    [("<nav><a href=/>{1}</a></nav>", 0), ("<article><p>{1}</p></article>", 1), ("<footer>{5}</footer>", 0)],
    [("<nav><a href=/>{1}</a></nav>", 0), ("<article><h1>{3}</h1>" + _TEXT + "<p>{2}", 1)],
    [("<div>{5}</div>", 0), ("<article><p>{1}</p><p>{2}</p><p>{1}</p></article>", 1)],
    [("<div class='nav'>{3}</div>", 0), ("<article><p>{3}</p></article>", 1)],
    [("<div>{4}</div><div><a href=/>{2}</a></div>", 0), ("<main><p>{5}</p><p>{1}</p></main>", 1)],
    [("<div>{3}</div>", 0), ("<article><div>{2}</div><div>{7}</div><p><a href=/>{2}</a></p></article>", 1), ("<div>{5}</div>", 0)],
    [("<div><a href=/>{2}</a></div><div>{7}</div>", 0), ("<div><p>{26*}</p><p>{1}</p><p>{8*}</p><p>{2}</p></div>", 1)],
    [("<div>{6}</div>", 0), ("<div><h2>{2}</h2><p>{28*}</p><p>{19*}</p><p>{3}</p></div>", 1), ("<div>{4}</div>", 0)],
    [("<div>{2}</div><div>{9}</div>", 0), ("<article><p>{30*}</p><p>{6}</p></article>", 1), ("<div>{8}</div><div>{3}</div>", 0)],
    [("<div>{8}</div>", 0), ("<div class='content'><p>{4}</p><p>{2}</p></div>", 1), ("<div>{6}</div>", 0)],
    [("<div id='main'><p>{3*}</p><p>{1}", 1)],
    [("<div class='breadcrumbs'><a href=/>{1}</a> <a href=/>{1}</a> {2}</div>", 0), ("<div class='story'><p>{2}</p><p>{1}</p></div>", 1), ("<div class='ads'><p>{20*}</p></div>", 0)],
]


def filled(page: list[tuple[str, int]], scale: int) -> list[tuple[str, int]]:
    """The pieces of a page with words in place, none of them twice."""
    made = 0

    def words(m: re.Match) -> str:
        nonlocal made
        n = int(m[1]) * (scale if m[2] else 1)
        made += n
        return " ".join(f"w{made - n + k}" for k in range(n))

    return [(re.sub(r"\{(\d+)(\*?)\}", words, piece), label) for piece, label in page]
