"""Pages that must not lose their text: forms around it, other scripts, compound class names, linked list items, odd markup."""

import pytest

from siltstone.llm.html_extract import main_text

STORY = "It was the best of the days that they had in the town and all of them knew it."
LONGER = f"{STORY} When the evening came they were still there, and it was not the last of it."
RUSSIAN = "Вчера вечером в городском порту открылась выставка старых карт, и посмотреть на неё пришли почти все жители города вместе с детьми."
CHINESE = "昨天晚上在城市港口举行了一场旧地图展览，几乎所有的市民都带着孩子来参观，展览一直持续到深夜才结束。"
POLISH = "Wczoraj wieczorem miejski port otworzył wystawę starych map, którą obejrzeli prawie wszyscy mieszkańcy miasta razem z dziećmi."
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul>"


@pytest.mark.parametrize("inner", [f"<article><h1>The title</h1><p>{STORY}</p></article>", f"<main><h1>The title</h1><p>{STORY}</p></main>", f"<div><h1>The title</h1><p>{STORY}</p></div>"])
def test_a_form_around_the_page(inner):
    page = f'<body><form id="aspnetForm" method="post"><div>{MENU}</div>{inner}<div class=sidebar><p>{STORY} Elsewhere.</p></div></form></body>'
    assert main_text(page) == f"The title\n{STORY}"


def test_forms_beside_the_text_stay_apart():
    form = f"<form><p>{STORY} Write to us.</p><label>Name</label><input></form>"
    for page in (f"<article><p>{STORY}</p>{form}</article>", f"<div><p>{LONGER}</p><p>{LONGER}</p></div>{form}", f"<article><p>{STORY}</p></article><form><p>{LONGER * 5}</p></form>"):
        assert "Write" not in main_text(page) and main_text(page).split("\n")[0] in (STORY, LONGER) and LONGER * 5 not in main_text(page)


def test_a_form_around_article_and_comments():
    comments = f"<section class=comments><article><p>{LONGER * 4}</p></article></section>"
    assert main_text(f"<form><article><p>{STORY}</p></article>{comments}</form>") == STORY


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE + CHINESE, POLISH])
def test_other_scripts_and_languages(text):
    page = f"<body>{MENU}<div><p>{text}</p><p>{text}</p></div>{MENU}<footer><p>{text}!</p></footer></body>"
    assert main_text(page) == f"{text}\n{text}"


@pytest.mark.parametrize("name", ["search-term-story", "header-image-story", "menu_of_the_day", "social-story", "post-share-study", "content-sidebar-wrap"])
def test_compound_names_inside_an_article(name):
    assert main_text(f"<article><p>{STORY}</p><p>{LONGER}</p><div class='{name}'><p>{STORY} Too.</p></div></article>") == f"{STORY}\n{LONGER}\n{STORY} Too."


@pytest.mark.parametrize("name", ["ad-slot", "related-stories", "cookie-notice", "share-buttons", "social-share-bar", "comment-list-inner", "site-sidebar", "js-ad", "newsletter-signup-box", "respond"])
def test_names_that_mark(name):
    for kind in ("class", "id"):
        assert main_text(f"<article><p>{STORY}</p><p>{LONGER}</p><div {kind}='{name}'><p>{STORY} Too.</p></div></article>") == f"{STORY}\n{LONGER}"


def test_list_items_with_links_in_running_text():
    items = "<ul><li>The first is <a href=a>a tale of two towns</a></li><li>See <a href=b>the second</a> of them, it is short</li></ul>"
    page = f"<div>{MENU}<p>{LONGER}</p>{items}<p>{LONGER}</p></div>{MENU}"
    assert main_text(page) == f"{LONGER}\nThe first is a tale of two towns\nSee the second of them, it is short\n{LONGER}"


def test_markup():
    assert main_text(f"<p>{STORY}</p><!--><p>{LONGER}</p><!---><p>{STORY}</p><!-- x --!><p>{LONGER}</p>") == f"{STORY}\n{LONGER}\n{STORY}\n{LONGER}"
    assert main_text(f'<p>{LONGER}</p><p style="DISPLAY: \n NONE">{STORY}</p><p aria-hidden="TRUE">{STORY}</p>') == LONGER
    assert main_text(f'<article><p>{STORY}</p></article><div id="respond"><p>{LONGER}</p></div>') == STORY


# Pages written by hand: (html, blocks of the article).
BY_HAND = [
    (f"<div id=wrap><div id=top>{MENU}</div><div id=story><h2>Harbour opens</h2><p>{LONGER}</p><blockquote>{STORY}</blockquote></div></div>", ["Harbour opens", LONGER, STORY]),
    (f"<table><tr><td>{MENU}</td><td><p>{LONGER}</p><p>{LONGER}</p></td></tr></table>", [LONGER, LONGER]),
    (f"<div class=hnews><div class=e-content><p>{LONGER}<p>{LONGER}<p>Short one.</div></div>", [LONGER, LONGER, "Short one."]),
    (f"<main id=m><div class=prose><h1>On <em>maps</em></h1><p>{STORY}</p><ol><li>One</li><li>Two</li></ol></div></main>{MENU}", ["On maps", STORY, "One", "Two"]),
    (f"<body>{LONGER}<br>{STORY}</body>", [f"{LONGER} {STORY}"]),
    (f"<article><figure><img src=x><figcaption>The old harbour</figcaption></figure><p>{STORY}</p></article>", ["The old harbour", STORY]),
    (f"<article lang=ru><h1>Карты</h1><p>{RUSSIAN}</p></article>{MENU}", ["Карты", RUSSIAN]),
    (f"<div><h1>地图</h1><p>{CHINESE}</p><p>{CHINESE}</p></div>", ["地图", CHINESE, CHINESE]),
    (f"<form action=/><main><p>{STORY}</p><pre>a &lt; b</pre></main></form>", [STORY, "a < b"]),
    (f"<div class=layout><section class=lead><p>{LONGER}</p></section><section class=rest><p>{LONGER}</p></section></div><aside><p>{LONGER}</p></aside>", [LONGER, LONGER]),
    (f"<nav>{MENU}</nav><div><p>{LONGER}</p><dl><dt>Where</dt><dd>In the town hall</dd></dl><p>{LONGER}</p></div>", [LONGER, "Where", "In the town hall", LONGER]),
    (f"<!-- a --><!DOCTYPE html><div><P>{LONGER}</P><SCRIPT>var x='</p>'</SCRIPT><P>{LONGER}</P></div>", [LONGER, LONGER]),
]


@pytest.mark.parametrize("page,blocks", BY_HAND)
def test_pages_written_by_hand(page, blocks):
    assert main_text(page).split("\n") == blocks
