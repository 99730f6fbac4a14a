import time

import numpy as np
import pytest

from wardenlog.llm import html_ttr as H

PARAGRAPH = "Some long sentence with many words in it, and then some more words to follow."
PAGE = f"""<html><head><title>t</title><style>p{{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></nav>
<div class="cookie-notice">{PARAGRAPH} We use cookies.</div><div class="ad">{PARAGRAPH}</div>
<article><header><h1>Title &amp; more</h1></header><p>First&nbsp;<b>bo</b>ld.<p>{PARAGRAPH}<br>next line</p><form>x <input></form>
<div><p>Short.</p></div><aside>side</aside><p>{PARAGRAPH}</p></article>
<section id="comments"><p>{PARAGRAPH}</p></section><footer>&copy; foot</footer></body></html>"""


def test_article_without_the_rest():
    assert H.main_text(PAGE) == f"Title & more First bold. {PARAGRAPH} next line Short. {PARAGRAPH}"


def test_page_without_an_article():
    body = f"<div><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><p>Brief.</p></div>"
    links = "<div>" + "".join(f"<a href={i}>l{i}</a> " for i in range(9)) + "</div>"
    assert H.main_text(f"<body>{links}{body}{links}</body>") == f"{PARAGRAPH} {PARAGRAPH} Brief."


def test_title_before_the_region():
    body = f"<div class=post-header><h1>Head</h1></div><div class=text><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p></div>"
    page = f"<div class=logo><h1>Site</h1></div><div id=wrap>{body}<div class=comments><p>{PARAGRAPH}</p></div></div><div class=sidebar>{PARAGRAPH}</div>"
    assert H.main_text(f"<body>{page}</body>") == f"Head {PARAGRAPH} {PARAGRAPH}"


def test_broken_and_empty_pages():
    assert H.main_text(None) == H.main_text("") == H.main_text("<nav>menu</nav>") == H.main_text("<script>x") == ""
    assert H.main_text("<article><p>open <b>bold<p>next &lt;") == "open bold next <"
    assert H.main_text("plain words") == "plain words"
    H.main_text("<div>" * 3000 + "deep" + "</p>" * 50)


def test_clusters():
    assert H.clusters(np.array([1.0, 9.0, 1.2, 8.0])).tolist() == [False, True, False, True]
    assert H.clusters(np.array([3.0, 3.0])).all()


def test_pages_table(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y"), (3, "w", "<p>" + "long text " * 50_000, "z")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = H.extract(pages).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.n_chars for r in got}[3] == 10 * 50_000 - 1
    assert H.extract(pages.limit(0)).count() == 0


def test_short_section_beside_a_long_one():
    long, short = "".join(f"<p>{PARAGRAPH}</p>" for _ in range(30)), f"<p>{PARAGRAPH} Twice.</p>"
    links = "<div>" + "".join(f"<a href={i}>l{i}</a> " for i in range(9)) + "</div>"
    words = " ".join([PARAGRAPH] * 30)
    for a, b in (("div", "div"), ("article", "article"), ("article", "div"), ("div", "section")):
        assert H.main_text(f"<body>{links}<{a}>{long}</{a}><{b}>{short}</{b}>{links}</body>") == f"{words} {PARAGRAPH} Twice."
        assert H.main_text(f"<body>{links}<{b}>{short}</{b}><{a}>{long}</{a}>{links}</body>") == f"{PARAGRAPH} Twice. {words}"


def test_marks_of_wrappers_and_articles():
    body = f"<p>{PARAGRAPH}</p><p>{PARAGRAPH}</p>"
    note = f"<div class=cookie-notice><p>{PARAGRAPH}</p></div><div class='box sidebar'><p>{PARAGRAPH}</p></div>"
    for tag, name in (("div", "content no-sidebar"), ("div", "layout with-sidebar"), ("article", "post category-notice"), ("div", "entry tag-social"),
                      ("section", "has-banner"), ("article", "post notice")):
        assert H.main_text(f"<body><{tag} class='{name}'>{body}</{tag}>{note}</body>") == f"{PARAGRAPH} {PARAGRAPH}"
    # A wrapper around the title and most of the text.
    assert H.main_text(f"<body><div class=sidebar-layout><h1>Head</h1>{body}{body}{body}</div>{note}</body>") == "Head " + " ".join([PARAGRAPH] * 6)
    comments = f"<div class=comments>{body * 9}</div>"
    assert H.main_text(f"<body><div class=text><h1>Head</h1>{body}</div>{comments}</body>") == f"Head {PARAGRAPH} {PARAGRAPH}"


@pytest.mark.parametrize("page", [
    "<div>x " * 50_000 + "</div>" * 50_000, "<div>x " * 50_000, "<div class=ad>x<h1>" * 50_000, "<b><div>" + "<i>x" * 50_000 + "</b>" * 50_000,
    "<p><span>" * 50_000 + "x", "<section><p>word</p>" * 50_000, "<a href=1>" * 50_000 + "x" + "</a>" * 50_000])
def test_deep_pages_take_linear_time(page):
    start = time.process_time()
    H.main_text(page)
    assert time.process_time() - start < 10
