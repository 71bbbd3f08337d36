import html
import re

import pytest
from corpusforge.llm import html_extract as ext

P1 = "This is the first paragraph of the story, and it has enough of the usual words in it to be told from a menu."
P2 = "It goes on with a second paragraph that is as long as the first, so that both of them are kept by the rules."
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{x:y}}</style></head><body class="post">
<header><h1>Site name</h1><a href="/">Home</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site so that it is the best for all of you who read it, and for us.</div>
{open}<h1>The title</h1><script>var s = "</p><p>not text</p>";</script><p>{p1}</p><!-- <p>no comment</p> --><p>A short one.</p>
<div class="advert">Buy the thing that all of you want to have now, for this is the best of all times to do it.</div><p>{p2}</p>
<form><label>Name</label><input name=a><p>Please send us your name and all that we want of you with this form.</p></form>{close}
<aside>More of the same that you may read in the side bar of this and of every other page that we have.</aside>
<section id="comments"><h2>Comments</h2><p>I think that this is the best of all the posts that I have read on this site, and more.</p></section>
<footer>All of the rights are ours and this is the end of the page.</footer></body></html>"""
WANT = f"The title {P1} A short one. {P2}"


@pytest.mark.parametrize("open_,close", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="entry-content">', "</div>"), ("<div>", "</div>")])
def test_article_without_the_rest(open_, close):
    assert ext.main_text(PAGE.format(open=open_, close=close, p1=P1, p2=P2)) == WANT


def test_character_references_white_space_and_inline_marks():
    page = f"<article><p>a&amp;b &lt;i&gt; &#233;&#x41;&nbsp; c</p><p>{P1[:20]}<b>{P1[20:40]}</b>{P1[40:]}\n\n  end</p></article>"
    assert ext.main_text(page) == f"a&b <i> éA c {P1} end"


def test_breaks_hidden_parts_and_forms_around_the_page():
    page = f"<form id=f><div style='display: none'>{P1}</div><article>{P1}<br>{P2}<form><p>{P1}</p></form></article><p>{P2}</p></form>"
    assert ext.main_text(page) == f"{P1} {P2}"


def test_broken_pages_end_somewhere():
    for page in ("<", "<p", "<!-- x", "<script>x", "</p></div>", "<article><p>" + P1, "<article><p>" + P1 + "<b>x<p>" + P2, "<a" * 20000, "&" * 9999, "<p>" * 5000):
        assert isinstance(ext.main_text(page), str)
    assert ext.main_text("<article><p>" + P1) == P1


def test_undecided_blocks_follow_their_neighbours():
    short = "<div>Well said</div>"
    assert ext.main_text(f"<div><div>{P1}</div>{short}<div>{P2}</div></div>") == f"{P1} Well said {P2}"
    assert ext.main_text(f"<nav>{short}</nav>{short}<nav>x</nav>") == ""


@pytest.mark.parametrize("name", ["content-sidebar-wrap", "has-sidebar", "no-sidebar", "main-content social-share-enabled", "sidebar", "page with-comments"])
@pytest.mark.parametrize("inner", ["<article><p>{}</p><p>Short.</p></article>", "<main><p>{}</p><p>Short.</p></main>"])
def test_names_of_wrappers_do_not_hide_an_article(name, inner):
    assert ext.main_text(f'<body><nav>x</nav><div class="{name}">{inner.format(P1)}</div><footer>{P2}</footer></body>') == f"{P1} Short."


def test_wrappers_of_layout_and_content_are_left_to_the_tests():
    assert ext.main_text(f'<div class="content-sidebar-wrap"><p>{P1}</p><div class="sidebar">{P2}</div></div>') == P1


def test_articles_by_name():
    assert ext.main_text(f'<article class="post related"><p>{P1}</p></article>') == P1
    assert ext.main_text(f'<article><p>{P1}</p></article><div class="related"><article><p>{P2}</p></article></div>') == P1
    assert ext.main_text(f'<article><p>{P1}</p></article><article class="post related"><p>{P2}</p></article>') == P1
    assert ext.main_text(f'<div><p>{P1}</p></div><div id="comments"><article><p>{P2}</p></article></div>') == P1
    assert ext.main_text(f'<article><p>{P1}</p><div class="post-comments"><article><p>{P2}</p></article></div></article>') == P1
    assert ext.main_text(f'<aside><article><p>{P2}</p></article></aside><p>{P1}</p>') == P1


def test_prose_without_known_stop_words():
    polish = "Wczoraj wieczorem nad rzeką zebrało się kilkadziesiąt osób, żeby wspólnie obejrzeć pokaz sztucznych ogni."
    chinese = "昨天晚上，数十人聚集在河边观看烟花表演。"
    for prose in (polish, chinese):
        page = f"<nav><a href=/>Start</a></nav><h1>T</h1><p>{prose}</p><p>{prose} <a href=x>42</a></p><div class=cookie-notice>{polish}</div><footer>{prose}</footer>"
        assert ext.main_text(page) == f"T {prose} {prose} 42"


def test_short_paragraphs_alone_and_labels():
    assert ext.main_text("<p>One short line.</p><p>And one more.</p><div><a href=x>Home</a></div>") == "One short line. And one more."
    assert ext.main_text(f"<article><p>Take <label>this</label> word. {P1}</p><form><label>Not this</label></form><label>nor this</label></article>") == f"Take this word. {P1}"


def test_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in ext.extract(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        inner = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)
        assert got[r["page_id"]] == " ".join(html.unescape(inner).split())


def test_null_empty_repeated_and_extra_columns(spark):
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<article>" + P1, 3), (3, "u", "x", 4), (3, "u", "x", 4), (4, "u", "<p>" + (P1 + " ") * 20000, 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = ext.extract(frame).collect()
    assert len(got) == 6 and got[0]["text"] == "" and got[1]["text"] == "" and got[2]["text"] == P1 and len(got[5]["text"]) > 2_000_000
    assert ext.extract(frame.limit(0)).count() == 0
