"""Class and id names that only look like those of unwanted parts."""

from __future__ import annotations

import random
import time
from collections import Counter, defaultdict

import pytest

from kpiscope.llm import html


@pytest.mark.parametrize("name", ["content no-sidebar", "page with-sidebar", "search-result", "has-social"])
def test_wrappers_keep_their_text(name):
    assert html.main_text(f"<body><div class='{name}'><p>All of it</p></div></body>", set(), set()) == "All of it"


@pytest.mark.parametrize("name", ["post-header", "entry-header", "article-header", "header"])
def test_headlines_of_articles_stay(name):
    assert html.main_text(f"<article><div class='{name}'><h1>Head</h1></div><p>Body</p></article>", set(), set()) == "Head Body"


@pytest.mark.parametrize("tag", ["article", "main"])
def test_a_name_drops_no_article(tag):
    page = f"<div class=overlay><div id=search><div class=menu>Menu</div><{tag}><p>Text</p><div class=share>Share</div></{tag}></div></div>"
    assert html.main_text(page, set(), set()) == "Text"


@pytest.mark.parametrize("name", ["sidebar", "cookie-notice", "x nav-menu", "ad"])
def test_unwanted_names_still_go(name):
    assert html.main_text(f"<div><div class='{name}'>No</div><p>Yes</p></div>", set(), set()) == "Yes"


EXTRA = ["share-buttons", "ad-slot", "related-posts", "comment-list", "comments-area", "comment-body", "cookie-bar", "post-comments", "site-footer", "main-nav", "sidebar-left", "newsletter_box", "page-footer"]


@pytest.mark.parametrize("name", EXTRA)
@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_words_in_compound_names_drop(name, around):
    for attribute in ("class", "id"):
        page = f"<{around}><p>Yes it is the text</p><ol {attribute}='{name}'><li>No</li></ol></{around}>"
        assert html.main_text(page, set(), set()) == "Yes it is the text"


def test_long_comments_and_cards_stay_out():
    page = "<div><p>Text</p><div class='comment-list'>" + "<p>Me too, and for much longer than the text is</p>" * 9 + "</div><div class='related-posts'><article><p>Card</p></article></div></div>"
    assert html.main_text(page, set(), set()) == "Text"


def test_a_wrapper_with_most_of_the_text_stays():
    page = "<body><div class='sidebar-right'><div class='layout'><p>The text of the page is here</p><div class='sidebar'>No</div></div></div></body>"
    assert html.main_text(page, set(), set()) == "The text of the page is here"


def test_headlines_and_main_parts_outside_of_articles():
    assert html.main_text('<div class="header"><h1>Title</h1></div><p>Text</p>', set(), set()) == "Title Text"
    assert html.main_text('<div class="header"><b>Site</b></div><p>Text</p>', set(), set()) == "Text"
    assert html.main_text('<div role="main"><p>Text</p></div><div class="other">Else</div>', set(), set()) == "Text"


@pytest.mark.parametrize("tag", ["div", "p", "li", "b", "article", "td", "div class=menu"])
def test_deep_nesting_takes_linear_time(tag):
    name = tag.split()[0]
    page = f"<{tag}>x</i>" * 100_000 + f"</{name}>" * 100_000
    start = time.process_time()
    text = html.main_text(page, {1}, {1})
    assert time.process_time() - start < 8
    assert text.count("x") == (50_000 if "menu" in tag else 100_000)  # each of the outer half holds most of the text


def test_templates_are_those_of_a_plain_count(spark):
    rng = random.Random(7)
    shared = [f"<div>Part {k} of the site</div>" for k in range(6)] + [f"<ul class=x><li><a href=/{k}>Go {k}</a></ul>" for k in range(6)]
    rows = []
    for k in range(400):
        host = "big.example" if k % 3 else f"h{k % 5}.example"
        inner = "".join(x for n, x in enumerate(shared) if rng.random() < (n % 6 + 1) / 30)
        rows.append((k, f"http://{host}/{k}", f"<body>{inner}<article><p>Own {k % 350}</p>{rng.choice(shared)}</article></body>"))
    pages = defaultdict(set)
    for _, url, page in rows:
        pages[url.split("/")[2]].add(page)
    want = {}
    for host, found in pages.items():
        n, links = Counter(), {}
        for page in found:
            own = html.hashes(page)
            n.update(own.keys())
            links |= own
        often = {h for h, c in n.items() if c >= 10 and c >= 0.5 * len(found)}
        some = {h for h, c in n.items() if c >= 10 and (c >= 0.2 * len(found) or links[h])}
        want[host] = (often, some)
    assert any(links and a != b for a, b in want.values())
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame([(*r, "mine", "h") for r in rows], "page_id long, url string, html string, _host string, host string")).collect()}
    assert got == {i: html.main_text(page, *want[url.split("/")[2]]) for i, url, page in rows}
