"""Gold texts of page layouts: a name drops boilerplate, not the page that it describes."""

import pytest

from effortlens.llm import markup, pages

PAGES = {
    "body has a sidebar": ("<body class='single has-sidebar'><article><p>Body text</p></article>", "Body text"),
    "consent layer is open": ("<html class='cookie-consent-open'><body><div><p>Body text</p></div>", "Body text"),
    "article has comments": ("<article class='post has-comments'><p>Body text</p></article>", "Body text"),
    "content without sidebar": ("<div class='content no-sidebar'><p>Body text</p></div>", "Body text"),
    "body word stands alone": ("<body class='sidebar'><p>Body text</p></body>", "Body text"),
    "wrapper of the article": ("<div class='content-sidebar-wrap'><p>Lead</p><article><p>Body text</p></article></div>", "Lead\n\nBody text"),
    "widget builder": ("<div class='widget'><div class='related-layout'><main><p>Body text</p></main></div></div>", "Body text"),
    "article named after a menu": ("<article class='menu'><p>Body text</p></article>", "Body text"),
    "inline link is left out": ("<article><p>Body <a class='share'>link</a> rest</p></article>", "Body rest"),
    "inline button is left out": ("<article><p>Body <button>Buy <b>now</b></button>rest</p></article>", "Body rest"),
    "inline element with a block": ("<article><p>Body</p><span class=ad><div>Buy</div></span><p>rest</p></article>", "Body\n\nrest"),
    "hidden body": ("<body style='display:none'><p>Body text</p></body>", "Body text"),
    "hidden block": ("<article><p>Body text</p><div hidden>old</div></article>", "Body text"),
    "sidebar beside": ("<div class='page with-sidebar'><article><p>Body text</p></article><div class='sidebar'><p>Links</p></div></div>", "Body text"),
    "comments below": ("<article><p>Body text</p></article><div id='comments'><article class='comment'><p>Me too</p></article></div>", "Body text"),
    "comments are articles": ("<main><article><p>Body text</p></article><ol class='comment-list'><li class='comment'>Me too</ol></main>", "Body text"),
    "teasers below": ("<main><p>Body text</p><div class='related'><article><p>Teaser</p></article></div></main>", "Body text"),
    "camel case": ("<main><p>Body text</p><div class='relatedPosts'>Teaser</div></main>", "Body text"),
    "roles": ("<div role='navigation'>Home</div><div role='main'><p>Body text</p></div><div role='contentinfo'>Imprint</div>", "Body text"),
    "parts of names": ("<div class='site-header'>Top</div><p>Body text</p><div class='site-footer'>Imprint</div><div id='ad-slot-3'>Buy</div>", "Body text"),
    "letters of other words": ("<div class='roadmap shadow'><p>Body text</p></div><div class='download header-image'>Top</div>", "Body text"),
    "header of the article": ("<header>Top</header><article><header><h1>Title</h1></header><p>Body text</p></article>", "Title\n\nBody text"),
    "header class of a title": ("<h1 class='header'>Title</h1><p>Body text</p>", "Title\n\nBody text"),
    "newsletter in the text": ("<article><p>Body</p><form>mail <input></form><div class='newsletter-signup'>Join</div><p>text</p></article>", "Body\n\ntext"),
    "closed comments on the body": ("<body class='comments-closed page'><div class='entry'><p>Body text</p></div></body>", "Body text"),
    "aside around an article": ("<aside><article><p>Teaser</p></article></aside><div><p>Body text</p></div>", "Body text"),
    "no end tags": ("<body class=has-menu><nav><ul><li>Home<li>News</ul></nav><article class='story is-ad-free'><p>Body<p>text", "Body\n\ntext"),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layout(name):
    page, text = PAGES[name]
    assert "\n\n".join(line for line, kind in markup.lines(page) if kind != markup.DROP) == text


def test_layouts_through_spark(spark):
    rows = [(i, f"https://h{i}.example/a", page) for i, (page, _) in enumerate(PAGES.values())]
    found = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {i: text for i, (_, text) in enumerate(PAGES.values())}
