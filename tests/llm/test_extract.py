"""Main text of pages."""

import html
import re

import pytest

from hitweave.llm import extract
from hitweave.llm.queries import op1_main_text_path_ratios

PAGE = """<!DOCTYPE html><html><head><title>Ignored</title><style>p{}</style></head><body>
<header class=site><a href=/>Home</a> Site name, with a slogan.</header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, all sorts of them, to make things better. Do you agree?</div>
<div id=main><article><h1>A  heading</h1><p>First paragraph,\n with <b>bold</b> and caf&eacute; &amp; more text in it, so that it counts.</p>
<div class="ad">Buy now, cheap and good, all of it!</div><p>Second one; it is as long as the first, or nearly so.<br>After a break.
<ul><li>an item<li>another item</ul><script>var x = "<p>no</p>";</script><form>Name: <input> <button>Send</button></form>
<p>Last &lt;one&gt;.</article><aside>Related: other things, and more of them.</aside>
<section class="comments"><h2>Comments</h2><p>Reader says, at great length, that all of this is wrong, and so on.</p></section></div>
<footer>Copyright, all rights reserved. Imprint.</footer></body></html>"""


def test_article_only():
    assert extract.main_text(PAGE).split("\n") == [
        "A heading", "First paragraph, with bold and café & more text in it, so that it counts.",
        "Second one; it is as long as the first, or nearly so. After a break.", "an item", "another item", "Last <one>.",
    ]


def test_without_article_element():
    page = "<body><div class=menu><a href=a>x</a></div><div><div class=story><p>Text of some length, here it is.</p><p>And more of it, to the end.</p></div></div></body>"
    assert extract.main_text(page) == "Text of some length, here it is.\nAnd more of it, to the end."


def test_no_text():
    for page in (None, "", "   ", "<html></html>", "<script>x</script>", "<nav>menu</nav>", "<!-- only -->", "<"):
        assert extract.main_text(page) in ("", "<")
    assert extract.main_text("plain words, no tags.") == "plain words, no tags."


def test_broken_markup_and_depth():
    assert extract.main_text("<p>one <b>two<p>three <a href='x>four</p>") .startswith("one two")
    deep = "<div>" * 3000 + "<p>Deep text, down here.</p>" + "</div>" * 3000
    assert extract.main_text(deep) == "Deep text, down here."


def test_very_long():
    body = "".join(f"<p>Sentence number {n}, of many such.</p>" for n in range(20000))
    got = extract.main_text(f"<nav>menu</nav><article>{body}</article>")
    assert got.count("\n") == 19999 and got.endswith("Sentence number 19999, of many such.")


def _article(page):
    """The article of these pages by a pattern: its blocks between tags that end one."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    body = re.sub(r"<!--.*?-->", "", body, flags=re.S)
    blocks = re.split(r"</?(?:p|h1|h2|ul|li|div|article)\b[^>]*>", body)
    lines = [" ".join(html.unescape(re.sub(r"<br\b[^>]*>", " ", b)).split()) if "<" not in b else " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\b[^>]*>", " ", b))).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_query_against_pattern(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op1_main_text_path_ratios(spark, sf_dir).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        want = _article(pages[r.page_id].html)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_edges(spark):
    rows = [(1, "u", "<p>Some text, here.</p>", "a"), (1, "u", "<p>Some text, here.</p>", "a"), (None, None, None, None), (2, "v", "", "b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(extract.extract(df).collect(), key=lambda r: (r.page_id is None, r.page_id))
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(1, "Some text, here.", 16)] * 2 + [(2, "", 0), (None, "", 0)]
    assert extract.extract(df, carry=["text"]).columns == ["text", "text_", "n_chars"]
    assert extract.extract(df, carry=["text"], suffix="_main").columns == ["text", "text_main", "n_chars_main"]
    assert extract.extract(df.limit(0)).count() == 0


BODY = "".join(f"<p>Paragraph {n} of this story goes on for a while, as such do, and then it comes to its end.</p>" for n in range(6))
TEXT = re.sub("</p><p>", "\n", BODY)[3:-4]


@pytest.mark.parametrize("mark", ["content with-sidebar", "post has-comments", "entry share-on", "no-ads article-body", "search-engine-guide", "notice-board-article", "layout has-sidebar", "comments"])
def test_a_mark_around_most_text_does_not_stand(mark):
    page = f"<body><div class='{mark}'><div>{BODY}</div><div class=sidebar>Our other stories, and more.</div></div><div class=footer>All rights reserved.</div></body>"
    assert extract.main_text(page) == TEXT
    assert extract.main_text(f"<body><div id=comment-policy>{BODY}</div></body>") == TEXT
    assert extract.main_text(f"<body><form>{BODY}<input></form><nav>Home, and away.</nav></body>") == TEXT


def test_comments_longer_than_the_article_go():
    page = f"<body><div>{BODY}</div><div class=comments>{BODY * 4}</div></body>"
    assert extract.main_text(page) == TEXT


def test_unmarked_boilerplate_goes_by_its_path():
    page = f"<body><ul><li><a href=1>One of many</a><li><a href=2>Two of many</a></ul>{BODY}<div>Subscribe now, free and easy.</div><div>All rights reserved, 2020.</div></body>"
    assert extract.main_text(page) == TEXT
    page = f"<body><div><div>{BODY}</div><section><p>Subscribe now!</p></section><ul><li><a href=1>One of many</a></ul></div></body>"
    assert extract.main_text(page) == TEXT


def test_headings_and_leads_stay():
    assert extract.main_text(f"<article><header><h1>A title</h1></header><div><div>{BODY}</div></div></article>") == "A title\n" + TEXT
    assert extract.main_text(f"<div><p class=lead>A short lead.</p><div class=body>{BODY}</div></div>") == "A short lead.\n" + TEXT
    assert extract.main_text(f"<h1>A title</h1><div class=body>{BODY}<h2>More</h2><ul><li>one<li>two</ul></div>") == f"A title\n{TEXT}\nMore\none\ntwo"


@pytest.mark.parametrize("line", ["<font><b>Some words of a line.<br>", "<font><b><div>Some words of a line.</div>", "<i><div><font>Words here.</i></i>", "<p>Words <span class=ad>", "<li><div>Words of it.", "<a href=x>Words ", "<table><tr><td>Words"])
def test_unclosed_tags_take_linear_time(line):
    import time

    start = time.process_time()
    extract.main_text("<body>" + line * (1_000_000 // len(line)))
    assert time.process_time() - start < 20


def test_ratios_against_a_plain_version():
    """The content paths of a flat page, by the definition."""
    rng = __import__("random").Random(5)
    for _ in range(30):
        items = [(rng.choice(("div", "p", "section")), f"Node {n}: " + "word, " * rng.choice((1, 1, 2, 30, 60))) for n in range(rng.randint(3, 12))]
        texts = [t.strip() for _, t in items]
        ratio = {}
        for tag in ("div", "p", "section"):
            own = [t for (g, _), t in zip(items, texts) if g == tag]
            ratio[tag] = (sum(map(len, own)) / len(own), sum(t.count(",") + t.count(":") for t in own) / len(own)) if own else (0, 0)

        def smooth(i, which):
            near = items[i : i + 3]
            return sum(k * ratio[g][which] for k, (g, _) in zip((1, 0.6, 0.14), near)) / sum((1, 0.6, 0.14)[: len(near)])

        fused = [smooth(i, 0) * (1 + smooth(i, 1)) for i in range(len(items))]
        mean = sum(v * len(t) for v, t in zip(fused, texts)) / sum(map(len, texts))
        good = {g for g in ratio if (own := [v for v, (h, _) in zip(fused, items) if h == g]) and sum(own) / len(own) >= 0.3 * mean}
        content = [len(t) if g in good else 0 for (g, _), t in zip(items, texts)]
        if max(content) >= 0.9 * sum(content):
            continue  # one node is the region
        page = "<body><div>" + "".join(f"<{g}>{t}</{g}>" for g, t in items) + "</div></body>"
        assert extract.main_text(page).split("\n") == [t for (g, _), t in zip(items, texts) if g in good]
