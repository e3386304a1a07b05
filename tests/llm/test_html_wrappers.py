"""Layout wrappers whose class names hold words of what is not main text."""

import pytest

from siltstone.llm.html_extract import main_text

STORY = "It was the best of the days that they had in the town and all of them knew it."
ARTICLE = f"<article><h1>The title</h1><p>{STORY}</p></article>"
WRAPPERS = ["content-sidebar-wrap", "layout has-sidebar", "container no-comments", "search-result-page"]


@pytest.mark.parametrize("name", WRAPPERS)
@pytest.mark.parametrize("inner", [ARTICLE, f"<main><h1>The title</h1><p>{STORY}</p></main>", f"<h1>The title</h1><p>{STORY}</p>"])
def test_a_wrapper_keeps_its_page(name, inner):
    page = f'<body><div class="{name}">{inner}<div class="related"><p>{STORY} Elsewhere.</p></div></div><footer>The foot of it</footer></body>'
    assert STORY in main_text(page).split("\n")
    if "<h1>" in inner and inner != f"<h1>The title</h1><p>{STORY}</p>":
        assert main_text(page) == f"The title\n{STORY}"


def test_heading_parts_and_linked_paragraphs_of_an_article():
    linked = "<p>See <a href=a>the first of the stories of the town</a> and <a href=b>the second of them</a>.</p>"
    page = f'<article><div class="entry-header"><h1 id="search">The title</h1></div><div class="post share">{linked}<p>{STORY}</p></div><div class="ad">Buy this</div></article>'
    assert main_text(page) == f"The title\nSee the first of the stories of the town and the second of them.\n{STORY}"


def test_comments_stay_apart():
    comment = f'<article class="comment"><p>{STORY} I think so too, and so do all of the others here.</p></article>'
    page = f'<div class="content-sidebar-wrap">{ARTICLE}<section id="comments">{comment * 5}</section></div><aside><article><p>{STORY} Teaser.</p></article></aside>'
    assert STORY in main_text(page)
    outside = f'{ARTICLE}<section id="comments">{comment * 5}</section><aside><article><p>{STORY} Teaser.</p></article></aside>'
    assert main_text(outside) == f"The title\n{STORY}"
