"""Main text of pages."""

import pytest

from palimpsest.llm import html

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>{}</body></html>"
LONG = "A sentence that is long enough to be the text of an article, with many words in it. "


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<nav><ul><li><a href='/a'>menu</a></li></ul></nav><article><h1>Head</h1><p>One  two\n three.</p><p>Four</p></article><footer>&copy; x</footer>", "Head One two three. Four"),
        ("<article><p><b>Bold.<br><p>Next</p></article>", "Bold. Next"),
        ("<article><p>a<b>b</b>c &amp; d &lt;e&gt; &#233;&nbsp;f</p></article>", "abc & d <e> é f"),
        ("<article><p>x</p><div class='ad'>buy <div>now</div></div><p>y</p></article>", "x y"),
        ("<article><p>x</p><!-- <p>no</p> --><script>if (a<b) '</div>'</script><p>y</p></article>", "x y"),
        ("<article><p>x</p><section id='comments'><article class='comment'><p>first!</p></article></section></article>", "x"),
        ("<main><header><h1>H</h1></header><p>x</p><aside>side</aside><form><input name=q><button>go</button></form></main>", "H x"),
        ("<div class='cookie-notice'>We use cookies.</div><article><p>x</p><p class='newsletterSignup'>Subscribe</p><p hidden>h</p><p style='display: none'>n</p></article>", "x"),
        ("<article><p>see <a href='/x'>this link</a> here</p></article>", "see this link here"),
        ("<article></article>", ""),
        ("<article><p>cut of", "cut of"),
        ("<article><p>x &am", "x &am"),
        ("<article><p>x</p><p", "x"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
        ("<div class='menu'>never closed<article><p>x</p></article>", "x"),
    ],
)
def test_marked_articles(body, want):
    page = PAGE.replace("{}", body) if not body.endswith(("of", "am", "<p")) else PAGE.split("{}")[0] + body
    assert html.extract(page) == want


def test_line_blocks_without_an_article_element():
    text = [LONG * 2, "Short.", LONG * 3, LONG]
    body = "<div id='top'>" + "".join(f"<div><a href='/{i}'>link {i}</a></div>" for i in range(12)) + "</div><div>" + "".join(f"<p>{t}</p>" for t in text) + "</div>" + "<div> </div>" * 5 + "<div>small print</div>"
    assert html.extract(PAGE.replace("{}", body)) == " ".join(t.strip() for t in text)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><p>One.</p><ul><li><a href='/i'>Item</a></li></ul><p>Two.</p></article>", "One. Item Two."),
        ("<article><header><h1><a href='/h'>Head</a></h1></header><div><p>x</p></div></article>", "Head x"),
        ("<article><p>x</p><ul>" + "".join(f"<li><a href='/{k}'>l{k}</a></li>" for k in range(5)) + "</ul><p>y</p></article>", "x l0 l1 l2 l3 l4 y"),
        ("<main><p>x</p>" + "".join(f"<p><a href='/{k}'>l{k}</a></p>" for k in range(3)) + "<p>y</p></main>", "x l0 l1 l2 y"),
        (f"<div><h2>Short title</h2></div><div><p>{LONG * 2}</p></div>", f"Short title {LONG * 2}"),
        (f"<div><p>{LONG * 2}</p></div><div><p>Short.</p></div><div><p>{LONG * 2}</p></div><div><p>The end.</p></div>", f"{LONG * 2}Short. {LONG * 2}The end."),
        (f"<ul><li><a href='/'>menu</a></li></ul><div><h1><a href='/h'>Head</a></h1></div><div><div><p>{LONG * 2}</p></div></div>", f"Head {LONG * 2}"),
    ],
)
def test_links_and_short_blocks_of_an_article_stay(body, want):
    assert html.extract(PAGE.replace("{}", body)) == want.strip()


def test_table(spark):
    rows = [(1, "u", "<article>é</article>", 3), (1, "u", "<article>é</article>", 3), (2, None, None, 3), (None, "v", "", 3), (3, "w", "<article><p>" + "long text " * 200_000 + "</p></article>", 3)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert sorted((r.id or 0, r.n_chars) for r in got) == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 1_999_999)]
    assert html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_broken_markup_ends():
    for page in ("<", "<a", "<!--", "<script>", "</", "<p " + "a='" * 5000, "<" * 20_000, "<div>" * 3000 + "x", "<style>" * 300, '<p x="' * 2000):
        html.extract(page)
    assert html.extract("plain text without any markup") == "plain text without any markup"


@pytest.mark.parametrize("name", ["article-header", "related-work", "notice-of-death", "reader-question", "social-history", "share-prices"])
def test_names_with_other_words_mark_nothing(name):
    page = f'<article><p>Start of it.</p><div class="{name}">In it.</div><section id="{name}">This too.</section><p>End.</p></article>'
    assert html.extract(page) == "Start of it. In it. This too. End."


@pytest.mark.parametrize("name", ["ad", "ad-slot", "cookie-notice", "site-footer", "reader-comments", "related-links", "box sidebarRight"])
def test_names_of_plain_words_mark_a_block(name):
    assert html.extract(f'<article><p>Start of it.</p><div class="{name}">Not in it.</div><p>End.</p></article>') == "Start of it. End."


def test_a_word_in_main_is_not_the_article():
    text = "A long text of the page that is not in the main element at all. " * 4
    assert html.extract(f"<main>Home</main><div><p>{text}</p></div>") == ("Home " + text).strip()
    assert html.extract("<main>Home</main>") == "Home"


def test_bytes_that_are_no_text(spark):
    df = spark.sql("select 1L page_id, 'u' url, cast(unhex('3C703E61FF623C2F703E') as string) html")
    assert html.extract_pages(df).first().text == "a�b"
