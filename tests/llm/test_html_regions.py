"""Main text of pages whose names of classes, ids and attributes mislead."""

import pytest

from postmill.llm import html_text

TREE = html_text.train()
LONG = " ".join(["word"] * 60)


def text(page):
    return html_text.main_text(page, TREE)


def test_tree_learns_every_labelled_block():
    assert [row for row in html_text.LABELLED if html_text.decide(TREE, row[:-1]) != bool(row[-1])] == []


@pytest.mark.parametrize(
    "page",
    [
        f'<body><h1 class="entry-title">T</h1><p>{LONG}</p><p>{LONG}</p></body>',
        f'<body><h1>T</h1><figure id="main-image"><figcaption>Seen from the air</figcaption></figure><p>{LONG}</p><p>{LONG}</p></body>',
        f'<body><div class="story-teaser"><p>Read this too</p></div><h1>T</h1><p>{LONG}</p><p>Brief.</p><p>{LONG}</p></body>',
        f'<body><h1>T</h1><p>A <span class="main">word</span> of it {LONG}</p><p>{LONG}</p></body>',
    ],
)
def test_long_text_beside_a_named_block_stays(page):
    got = text(page).split("\n")
    assert sum(LONG in line for line in got) == 2 and "T" in got
    assert "Brief." in got or "Brief." not in page


def test_short_and_linked_blocks_beside_a_main_region_go():
    page = f'<body><div>Sign in</div><div><a href="/a">one two three four</a></div><div class="content"><p>{LONG}</p><p>Brief.</p></div><div>Made here</div></body>'
    assert text(page) == f"{LONG}\nBrief."


ARTICLE = f"<article><h1>T</h1><p>{LONG}</p></article>"


@pytest.mark.parametrize(
    "page",
    [
        f'<body><div class="page has-sidebar">{ARTICLE}</div></body>',
        f'<body><div class="layout with-ads"><p>{LONG}</p></div></body>',
        f'<body><div class="layout sidebar-left">{ARTICLE}</div></body>',
        f'<body><div class="layout sidebar-left"><h1>T</h1><p>{LONG}</p></div></body>',
        f'<body><div class="page ad-free"><div role="main"><p>{LONG}</p></div></div></body>',
        f'<body><form id="aspnetForm"><input name="a">{ARTICLE}</form></body>',
        f'<body><form id="aspnetForm"><div id="content"><p>{LONG}</p></div></form></body>',
        f'<article><h1 class="page-header">T</h1><p>{LONG}</p></article>',
    ],
)
def test_wrapper_closes_no_article(page):
    assert text(page) == (f"T\n{LONG}" if ">T<" in page else LONG)


@pytest.mark.parametrize(
    ("attributes", "shown"),
    [
        ('title="The hidden valley road"', True), ('style="overflow: hidden !important"', True), ("data-x='style=\"display:none\"'", True),
        ('title="aria-hidden=true"', True), ('style="--display: none"', True), ('style="display:none; display:block"', True), ('title="a class=ad"', True),
        ("hidden", False), ('HIDDEN=""', False), ("class=a hidden", False), ('style="color:red; DISPLAY : none"', False), ("style='display:none!important;display:block'", False), ("style=display:none", False), ('aria-hidden="true"', False),
    ],
)
def test_hidden_is_read_as_an_attribute(attributes, shown):
    assert text(f"<article><p>a b <span {attributes}>c</span> d</p><p {attributes}>{LONG}</p></article>") == (f"a b c d\n{LONG}" if shown else "a b d")


def test_words_of_inline_elements_cut_nothing():
    assert text(f'<article><p>A <span class="search">word</span> of <a class="share" href="/x">it</a> {LONG}</p></article>') == f"A word of it {LONG}"


@pytest.mark.parametrize("name", ["layout with-sidebar", "search-content", "tags", "share", "login", "related", "replies"])
def test_names_of_parts_drop_no_text(name):
    assert text(f'<body><div class="{name}"><h1>T</h1><p>{LONG}</p></div></body>') == f"T\n{LONG}"
    assert text(f'<article><h1>T</h1><div class="{name}"><p>{LONG}</p></div></article>') == f"T\n{LONG}"


def test_links_inside_an_article_are_judged_by_density_and_neighbours():
    bar = "<div><a>Share</a> <a>Tweet</a></div>"
    menu = "".join(f"<li><a>link number {k} of the long list here</a></li>" for k in range(3))
    page = f'<article><h1><a href="/">T of it</a></h1><p>{LONG}</p>{bar}<p>{LONG} <a>one</a></p><p><a>Read the whole of the long report here</a></p><p>End.</p><ul><li><a>Top</a></li>{menu}<li><a>Last</a></li></ul></article>'
    assert text(page) == f"T of it\n{LONG}\n{LONG} one\nRead the whole of the long report here\nEnd."


def test_tree_reads_words_and_links_of_neighbours():
    def used(tree):
        return {tree[0]} | used(tree[2]) | used(tree[3]) if isinstance(tree, tuple) else set()

    assert used(TREE) >= {0, 2, 3} and used(TREE) & {4, 5} and used(TREE) & {6, 7}
    for place in (html_text.ALONE, html_text.WITHIN, html_text.BESIDE):  # no place decides by itself
        assert {html_text.decide(TREE, row[:-1]) for row in html_text.LABELLED if row[0] == place} == {True, False}


def test_formulas_and_raw_text_stay():
    assert text("<article><p>a <math><mi>x</mi></math> b <object>c</object></p><xmp>raw <b> &amp;</xmp></article>") == "a x b c\nraw <b> &amp;"


def test_many_unclosed_tags_are_read_in_one_pass():
    import time

    for page in ("<div>" * 100_000, "<div>" * 50_000 + "</p>" * 50_000, "<blockquote>" * 50_000 + "<p>" * 50_000, "<p>" * 100_000, "<form>" * 50_000, "<a" * 50_000, "<!--" * 50_000):
        began = time.time()
        text(f"<article>{LONG}" + page)
        assert time.time() - began < 5


def test_outside_stays_outside():
    page = f'<body><nav><article>{LONG}</article></nav>{ARTICLE}<div class="comments"><article class="comment"><p>{LONG}</p></article></div><form><label>Mail</label></form><div class="ad">{LONG}</div></body>'
    assert text(page) == f"T\n{LONG}"


def test_a_short_linked_line_in_an_article_stays_and_runs_of_links_go():
    page = f'<article><p>{LONG}</p><p><a href="/a">Read it</a></p><p>{LONG}</p><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li><li><a href="/3">Three</a></li></ul></article>'
    assert text(page) == f"{LONG}\nRead it\n{LONG}"


def test_a_notice_beside_the_article_goes():
    notice = "We use things to improve your visit and measure what people read here so that we can pay for it and show what you like best of all"
    assert text(f'<body><div id="main"><p>{LONG}</p></div><div class="gdpr"><p>{notice}</p></div></body>') == LONG


def test_texts_of_the_pages_are_the_blocks_of_their_articles():
    """Another reading: the parts of the marked article between its block tags, without the elements and names left out."""
    import html as entities
    import re

    import pyarrow.parquet as pq

    bad = right = all_ = 0
    for row in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist():
        found = re.search(r"(?s)<article\b[^>]*>(.*)</article>", row["html"] or "")
        if not found:
            continue
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|nav|aside|form|footer)\b.*?</\1>|<(div|section|p)[^>]*\b(?:class|id)=[\"'][^\"']*\b(?:ad|ads|comments?|sidebar|notice|cookie|share)\b[^>]*>.*?</\2>", "\n\x00", found[1])
        lines = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", part)).replace("\x00", "").split()) for part in re.split(r"</?(?:p|div|h[1-6]|ul|ol|li|section|header|figure|figcaption|blockquote|table|tr|td|pre)\b[^>]*>|\x00", body)]
        want, got = [x for x in lines if x], text(row["html"]).split("\n")
        right += len(set(want) & set(got))
        all_ += len(set(want))
        bad += len(set(got) - set(want))
    assert all_ > 500 and right / all_ >= 0.98 and bad / max(1, right) <= 0.02
