from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripletide.llm import html_text
from tripletide.llm.html_text import main_text

ONE = "This is the text of the story and it is told by the people who were there for a long time, with all of it."
TWO = "It was not until the end of the year that they had been able to see what was in the house by the river."
MENU = "<nav><a href=a>Home</a><a href=b>News</a></nav>"
FOOT = "<footer>Imprint and contact</footer>"
BOTH = f"<p>{ONE}</p><p>Short.</p><p>{TWO}</p>"
TEXT = f"{ONE}\nShort.\n{TWO}"


@pytest.mark.parametrize(
    "page",
    [
        f'{MENU}<article class="post category-social comments-open">{BOTH}</article>{FOOT}',
        f'{MENU}<main class="has-sidebar legal">{BOTH}</main>{FOOT}',
        f'{MENU}<article><section class="discussion-of-results">{BOTH}</section></article>{FOOT}',
        f'{MENU}<article class="widget teaser">{BOTH}</article><div class="comment-list"><article><p>{ONE}</article></div>',
        f'{MENU}<article>{BOTH}</article><p>Copyright 2020 all rights reserved</p>{FOOT}',
        f'{MENU}{BOTH}<p>© 2020 The Paper</p>',
        f'{MENU}<div class="legal page">{BOTH}</div>{FOOT}',
        f'{MENU}<div id="content">{BOTH}</div><div class="site-footer">{ONE}</div><ul class=relatedPosts><li>{TWO}</ul>',
        f'<div class="cookie-notice">{ONE}</div><div>{BOTH}</div><div id="comments-area"><p>{TWO}</div>',
        f'<form>{ONE}</form><div class="sidebar-left">{TWO}</div><section>{BOTH}</section><div role=complementary>{ONE}</div>',
    ],
)
def test_layouts_with_and_without_an_article(page):
    assert main_text(page) == TEXT


def test_names_in_full_only():
    for name in ("comments", "comment-list", "site-footer", "relatedPosts", "ad", "main-nav", "cookie-notice", "social-share-buttons"):
        assert html_text._named(f' class="{name}"')[0], name
    for name in ("comments-open", "category-social", "discussion-of-results", "has-sidebar", "no-comments", "adaptive", "navy"):
        assert html_text._named(f' class="{name}"') == (False, False), name


def test_a_page_of_boilerplate_alone_is_empty_where_tags_say_so():
    assert main_text(f"{MENU}<footer>{ONE}</footer>") == ""
    assert main_text(f"<div class=cookie-notice><p>{ONE}</div><article></article><article><p>{TWO}</article>") == TWO
    assert main_text(f"<div class=legal><nav>{ONE}</nav><p>{TWO}</p></div>") == TWO


def test_rules_of_density_length_and_neighbours_matter(monkeypatch):
    listing = "cheap flights hotels cars deals offers prices booking travel summer winter beach city tours"
    links = "<div>" + "".join(f"<a href={i}>{TWO} {i}</a> " for i in range(3)) + "</div>"
    page = f"<div>Home</div>{links}<p>{ONE}</p><p>Short.</p><p>{TWO}</p><div>{listing}</div><div>More</div>"
    assert main_text(page) == TEXT
    for name, value in (("STOP_WORDS", frozenset()), ("SHORT", 0), ("LINKED", 2.0), ("STOP_LOW", 0.0)):
        with monkeypatch.context() as m:
            m.setattr(html_text, name, value)
            assert main_text(page) != TEXT, name
    blocks = html_text.label(html_text.blocks_of(page))
    assert [b.label for b in blocks if b.text == "Short."] == [html_text.GOOD]
    assert [b.label for b in blocks if b.text in ("Home", "More")] == [html_text.BAD] * 2


def test_rows_through_spark(spark):
    article = f"{MENU}<article>{BOTH}</article>{FOOT}"
    long = "<article>" + f"<p>{ONE}" * 20_000 + "</article>"
    rows = [(1, "u", article), (1, "u", article), (None, None, article), (2, "v", None), (3, "w", ""), (4, None, long), (5, "x", "<p>ä&#228;&amp;  b\t c</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("a")})
    got = html_text.extract_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(i, u, main_text(h), len(main_text(h))) for i, u, h in rows]
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert want[0][2] == TEXT and want[5][2].count("\n") == 19_999 and want[6][2] == "ää& b c"
    assert html_text.extract_text(pages.limit(0)).collect() == []
