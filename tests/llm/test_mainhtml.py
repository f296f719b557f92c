"""Main text of pages whose article is known, of the given pages, and of damaged ones."""

import html
import random
import re

import duckdb

from glossa.llm import mainhtml, queries
from tests.conftest import SF

WORDS = "river stone window morning letter garden silver winter music table answer children market bridge".split()


def prose(rng, n):
    words = [rng.choice(WORDS) + rng.choice(["", "", "", ","]) for _ in range(n)]
    return " ".join(words).capitalize().rstrip(",") + "."


def article(rng):
    """(html, text) of blocks of all kinds, with characters that need references."""
    marks, blocks = [], []
    for k in range(rng.randint(1, 9)):
        text = prose(rng, rng.choice([1, 4, 30, 120])) + rng.choice(["", " a < b & c", ' "so" — é ½', " 5 > 3"])
        words = text.split()
        if len(words) > 3 and rng.random() < 0.5:  # markup and white space inside a block
            told = f"<b>{html.escape(words[0])}</b>\n\t <a href='/x'>{html.escape(words[1])}</a>  " + html.escape(" ".join(words[2:]))
        else:
            told = html.escape(text)
        kind = rng.choice(["p", "p", "p", "h2", "blockquote", "li", "open"]) if k else "h1"
        marks.append({"li": f"<ul><li>{told}</ul>", "open": f"<p>{told}"}.get(kind, f"<{kind}>{told}</{kind}>"))
        blocks.append(" ".join(text.split()))
    return "".join(marks), "\n".join(blocks)


def page(rng, body, holder):
    noise = [
        f"<nav><ul><li><a href='/'>{prose(rng, 2)}</a></li></ul></nav>", f"<div class='ad'>{prose(rng, 200)}</div>", f"<div id='cookie-notice'><p>{prose(rng, 60)}</p></div>",
        f"<aside><p>{prose(rng, 80)}</p></aside>", f"<form><p>{prose(rng, 20)}</p><input name=q><textarea><p>{prose(rng, 9)}</textarea></form>", f"<script>var t = '</p><article>{prose(rng, 5)}';</script>",
        f"<section class='comments'><div class='comment'><p>{prose(rng, 90)}</p></div></section>", f"<header><h1>{prose(rng, 3)}</h1></header>", f"<!-- <article>{prose(rng, 3)}</article> -->", f"<div class='sidebarRight'><p>{prose(rng, 70)}</p></div>",
    ]
    rng.shuffle(noise)
    cut = rng.randint(0, len(noise))
    start, end = holder
    return f"<!DOCTYPE html><html><head><title>{prose(rng, 4)}</title><style>p {{}}</style></head><body class='with-sidebar'>{''.join(noise[:cut])}{start}{body}{end}{''.join(noise[cut:])}<footer>&copy; {prose(rng, 12)}</footer></body></html>"


def test_articles_among_all_that_goes():
    rng = random.Random(2)
    for _ in range(300):
        body, text = article(rng)
        holder = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='wrap no-sidebar'><article class=post>", "</article></div>")])
        whole = page(rng, body, holder)
        assert mainhtml.main_text(whole) == text
        assert mainhtml.main_text(whole.replace("</body></html>", "")) == text


def test_articles_that_no_element_names():
    rng = random.Random(3)
    for _ in range(200):
        paragraphs = [prose(rng, rng.randint(20, 90)) for _ in range(rng.randint(2, 8))]
        body = "".join(f"<p>{html.escape(p)}</p>" for p in paragraphs)
        assert mainhtml.main_text(page(rng, body, ("<div><div>", "</div></div>"))) == "\n".join(paragraphs)


def test_siblings_links_and_lists():
    long = "One, two, three, four, five, six and a good many other words that make this a paragraph of some length, really."
    links = "<div>" + "".join(f"<a href='/{k}'>{long}</a> " for k in range(9)) + "</div>"
    assert mainhtml.main_text(f"<body>{links}<div><p>{long}</p><p>{long}</p></div></body>") == f"{long}\n{long}"
    assert mainhtml.main_text(f"<body><div><p>{long}</p></div><div><p>{long}</p></div>{links}</body>") == f"{long}\n{long}"
    assert mainhtml.main_text("<table><tr><td>one<td>two<tr><td>three</table>") == "one\ntwo\nthree"
    assert mainhtml.main_text("<main><article><p>a, b</p></article><article><p>c</p></article></main>") == "a, b\nc"
    assert mainhtml.main_text("<ol><li><article class='comment'><p>Nice, one.</p></article></ol><article><p>Body.</p></article>") == "Body."


def test_odd_pages():
    for page, text in ((None, ""), ("", ""), ("<", "<"), ("a < b", "a < b"), ("<p", ""), ("<!-- open", ""), ("x &amp y &lt;b&gt; &#233;&nbsp;z", "x & y <b> é z"), ("</p></div>tail", "tail"), ("<script>x", ""), ("<a title='>'>t</a>", "t")):
        assert mainhtml.main_text(page) == text
    assert mainhtml.main_text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert mainhtml.main_text("<p>" + "long, " * 200_000) == ("long, " * 200_000).strip()


def test_query_on_the_given_pages(spark):
    """The given pages mark their article, so that a plain cut tells its text."""

    def cut(page):
        inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", inner[1].replace("<br>", " "))) if inner else []
        return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)

    rows = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    got = {tuple(r) for r in queries.op12_main_text(spark, SF).collect()}
    assert got == {(i, u, cut(h), len(cut(h))) for i, u, h in rows}


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>Hi", 1), (1, "u", "<p>Hi", 1), (None, None, None, None)], "page_id long, url string, html string, n_chars int")
    assert sorted(map(str, mainhtml.extract(rows).collect())) == sorted(map(str, spark.createDataFrame([(1, "u", "Hi", 2), (1, "u", "Hi", 2), (None, None, "", 0)], mainhtml.SCHEMA).collect()))
    assert mainhtml.extract(rows.filter("false")).count() == 0
