"""Main text of hand-made pages and of the page table."""

from __future__ import annotations

import html
import re

import pytest

from corpusmill.llm import queries
from corpusmill.llm.page_text import extract, main_text

A = "First paragraph with quite some text, long enough to be taken for prose."
B = "Second paragraph of the article, which also goes on for a while."
C = "Third one, somewhat shorter."


def page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


CASES = {
    "article": (f"<nav><ul><li><a href=1>x</a></ul></nav><article><h1>Title</h1><p>{A}</p><p>{B}</p></article><footer>f</footer>", ["Title", A, B]),
    "div": (f"<div id='header'>Site name and slogan</div><div class='content'><h2>Title</h2><p>{A}<p>{B}<p>{C}</div><div class='sidebar'><p>{A} aside</p></div>", ["Title", A, B, C]),
    "sections": (f"<main><section><p>{A}</p><p>{B}</p></section><section><h2>Part</h2><p>{C}</p></section></main>", [A, B, "Part", C]),
    "comments": (f"<article><p>{A}</p><p>{B}</p><div class='comments'><p>{B} Great post, I say at length.</p></div></article><section id=comment-list><article class=comment><p>{A}</p></article></section>", [A, B]),
    "notice": (f"<div class='cookie-notice'><p>{A} We use cookies.</p></div><article><p>{B}</p></article><form><p>{A}</p><input></form>", [B]),
    "references": ("<article><p>caf&eacute; &amp; bar&nbsp;&#x41;&lt;b&gt;\n\t x<br>y</p></article>", ["café & bar A<b> x y"]),
    "unclosed": (f"<article><h1>T<p><b>{A}<br><p>{B}<p>{C}", ["T", A, B, C]),
    "scripts": (f"<article><p>{A}</p><script>var t='</p><p>no</p>';</script><!-- <p>no</p> --><p>{B}</p></article>", [A, B]),
    "inline": (f"<article><p>one <b>bold</b>, <i>it</i>al <a href='x'>link</a> end</p><p>{A}</p><ul><li>i1<li>i2</ul></article>", ["one bold, ital link end", A, "i1", "i2"]),
    "table": (f"<article><p>{A}</p><table><tr><td>a<td>b<tr><td>c</table></article>", [A, "a", "b", "c"]),
    "hidden": (f"<article><p>{A}</p><p hidden>{B}</p><p style='display: none'>{B}</p></article>", [A]),
    "bare": (f"{A}<br>{B}", [f"{A} {B}"]),
    "advert": (f"<article><p>{A}</p><div class='ad-box'>{B}</div><p>{C}</p></article>", [A, C]),
    "single": (f"<nav><a href=1>{A}</a></nav><article><p>{C}</p></article><footer><p>{A}</p></footer>", [C]),
}


@pytest.mark.parametrize("name", CASES)
def test_page(name):
    body, want = CASES[name]
    assert main_text(page(body)) == "\n\n".join(want)


@pytest.mark.parametrize("wrapper", [
    "div class='content with-sidebar'", "div id=main class=no-sidebar", "div class='post-content social-sharing-enabled'", "section class=newsletter-article",
    "div class='social'", "div class=widget"])
@pytest.mark.parametrize("inner", ["div class=body", "div class='promo-text'", "article"])
def test_a_marked_wrapper_of_the_article_stays(wrapper, inner):
    name, within = wrapper.split()[0], inner.split()[0]
    body = (f"<div id=header>Site</div><p>Short line</p><{wrapper}><{inner}><p>{A}</p><p>{B}</p><p>{C}</p></{within}>"
            f"<div class=sidebar><p>{C}</p></div></{name}><div class=cookie-notice><p>{C}</p></div>")
    got = main_text(page(body)).split("\n\n")
    assert [x for x in got if x != "Short line"] == [A, B, C]


def test_long_comments_do_not_replace_a_short_article():
    comments = f"<div class=comments>{f'<p>{B}</p>' * 30}</div>"
    for article in (f"<article><p>{A}</p></article>", f"<div><p>{A}</p></div>"):
        assert main_text(page(article + comments)) == A


def test_many_marked_wrappers():
    assert main_text(page("<div class=widget>" * 2000 + f"<p>{A}</p>")) == A


@pytest.mark.parametrize("source", ["", None, "   ", "<", "<<<>>>", "<p", "</p></div>", "<!--", "<script>x", "&amp", "<a 'x>", "<html><body></body></html>", "<td><li></ul>" * 50, "<div>" * 3000])
def test_broken_pages_do_not_fail(source):
    assert isinstance(main_text(source), str)


def test_link_lists_go_and_links_in_prose_stay():
    body = f"<article><p>{A} <a href=x>a link</a> in it.</p><p>{B}</p><ul><li><a href=1>one</a><li><a href=2>two</a><li><a href=3>three</a></ul></article>"
    assert main_text(page(body)).startswith(f"{A} a link in it.\n\n{B}")


def test_all_pages(spark, real):
    """The pages keep their articles in one element, so a plain cut gives the same text."""
    got = {r.page_id: r for r in queries.op10_page_text(spark, "/root/testdata/sf0.001").collect()}
    pages = real("pages").collect()
    assert len(got) == len(pages)
    for p in pages:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        text = "\n\n".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (text, len(text), p.url)


def test_the_names_of_the_article_element_decide_nothing(real):
    for p in real("pages").collect():
        plain = p.html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert main_text(plain) == main_text(p.html)


def test_density_decides_the_core():
    """Two wrappers without telling names: the one with prose is the text, the one with links is not."""
    links = "".join(f"<li><a href={k}>Entry number {k}</a> x</li>" for k in range(40))
    body = f"<div><div><div><ul>{links}</ul></div></div><div><h2>Title</h2><p>{A}</p><p>{B}</p><p>{C}</p></div></div>"
    assert main_text(page(body)) == "\n\n".join(["Title", A, B, C])


def test_deep_nesting_takes_linear_time():
    import time

    took = []
    for n in (10_000, 100_000):
        started = time.process_time()
        assert main_text("<body>" + "<div>" * n + A) == A
        took.append(time.process_time() - started)
    assert took[1] < 30 * took[0]


def test_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", page(f"<p>{A}</p>")), (3, "u", page("<p>" + "word " * 200_000 + "</p>")), (3, "u", "<p>é</p>")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.n_chars) for r in extract(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0), (2, 0), (None, len(A)), (3, 999_999), (3, 1)], key=repr)
    assert extract(df.limit(0)).collect() == []
