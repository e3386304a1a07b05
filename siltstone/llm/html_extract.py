"""Main-text extraction from HTML by two-pass block rules."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frequent function words of four languages, in alphabetical order.
STOP_WORDS = {
    "en": "a about all also an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or our out she so than that the their them then there these they this to up was we were what when which who will with would you",
    "de": "als am an auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat im in ist mit nach nicht noch oder sich sie sind so um und von vor war werden wie wird zu zum zur über",
    "fr": "au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ont ou par pas plus pour qu que qui sa se ses son sont sur un une vous à été être",
    "es": "al como con de del donde el ella en entre era es esta este esto fue ha hay la las lo los más muy no o para pero por que se ser si sin sobre son su sus también un una y ya",
}
# Elements that start a block of their own.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe legend li main menu nav noframes noscript object ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
# Elements whose text is never prose.
DROPPED = set("script style template noscript svg math canvas head title iframe object select button textarea datalist".split())
# Elements that never hold the main text.
APART = set("nav header footer aside menu dialog".split())
# Elements that hold the main text only where they are wrapped around the whole of it.
FORMS = {"form", "fieldset"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Words of class and id values that mark what is not main text, wherever they begin or end a name.
STRONG_MARKS = set("ad ads advert advertisement adverts breadcrumb breadcrumbs comment comments cookie cookies disqus footer footers nav navbar navigation newsletter pagination related replies respond sidebar sidebars sponsor sponsored sponsors".split())
# Words that mark a name of one or two parts; in longer names two of all these words are needed.
WEAK_MARKS = set("banner banners consent header headers masthead mastheads menu menus modal modals notice notices pager popup popups promo promos promoted search share shares sharing social subscribe toolbar toolbars widget widgets".split())
# Words that say that the other part of such a name is what the text is about.
TOPICS = set("article copy essay paragraph prose recipe story text".split())
#: Class words of a layout that has, or lacks, such a part.
LAYOUT = re.compile(r"(?:^|(?<=\s))(?:has|no|with|without)-\S+", re.I)
#: Inside an article these mark its own heading part.
HEADING_MARKS = {"header", "headers", "masthead", "mastheads"}
PARTS = re.compile(r"[-_]+")
COMMENT_END = re.compile(r"--!?>")
#: Letters of other scripts than Latin; and those of which one says about as much as three Latin ones.
OTHER_SCRIPT = re.compile(r"[^\x00-\u024f\u2000-\u206f]")
WIDE = re.compile(r"[\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
SENTENCE_END = tuple(".!?\u2026\u3002\uff01\uff1f\u0964\u06d4\u061f")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "form"}
#: An attribute: its name is read whole, so that no name is tried from its middle.
ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
QUOTE_OR_END = re.compile(r"[>\"']")
#: References of so many digits are beyond all code points, or filled up with zeros.
LONG_REFERENCE = re.compile(r"&#([0-9]{9,});?")
SPACE = re.compile(r"\s+")
STOPS = frozenset(w for words in STOP_WORDS.values() for w in words.split())
#: A paragraph ends at these when its end tag is left out.
CLOSES_P = BLOCK - {"body", "html", "head", "option", "optgroup"}

SHORT, LONG, MOST_LINKS, FEW_STOPS, SOME_STOPS, MANY_STOPS = 70, 200, 0.35, 0.05, 0.15, 0.25


def decoded(text: str) -> str:
    """Character references decoded, white space made one space, ends trimmed."""
    if "&" in text:
        text = html.unescape(LONG_REFERENCE.sub(lambda m: f"&#{(m[1].lstrip('0') or '0')[:8]};", text))
    return SPACE.sub(" ", text).strip()


class Block:
    """Text of one block: its characters, those inside links, and where it stands: its innermost class mark and holder (-1: none).

    plain: whether letters stand outside of its links. size: its length, wide letters as three.
    """

    __slots__ = ("parts", "linked", "plain", "apart", "mark", "holder", "heading", "label", "text", "size", "other")

    def __init__(self, apart: bool, mark: int, holder: int, heading: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.plain = False
        self.apart, self.mark, self.holder, self.heading, self.label, self.text = apart, mark, holder, heading, "", ""
        self.size, self.other = 0, False

    def finish(self) -> None:
        """Join the parts and measure them; other: most of it is in a script that is not Latin."""
        self.text = text = decoded("".join(self.parts))
        self.size = len(text)
        if not text.isascii():
            self.size += 2 * sum(len(m) for m in WIDE.findall(text))
            self.other = 2 * len(OTHER_SCRIPT.findall(text)) > len(text)

    def prose(self) -> int:
        """Its size if it is long enough, and not mostly links."""
        return self.size if self.size >= SHORT and self.linked <= MOST_LINKS * len(self.text) else 0


class Place:
    """A mark, or an article or main element: the mark and the holder around it, the text and the prose under it.

    A mark's name is "form" if it is one for being a form alone.
    """

    __slots__ = ("name", "apart", "mark", "holder", "size", "prose")

    def __init__(self, name: str, apart: bool, mark: int, holder: int):
        self.name, self.apart, self.mark, self.holder, self.size, self.prose = name, apart, mark, holder, 0, 0


class Tags:
    """The tags of a page, one after another; no stretch of the page is read more than a fixed number of times."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = True  # until a tag's quote does not close: from then on tags end at the first >
        self.last = {c: page.rfind(c) for c in ">\"'"}
        self.unclosed: set[str] = set()

    def end_of_tag(self, at: int) -> int:
        """The place of the > that ends the tag whose name ends at `at`, or -1."""
        start = at
        while self.quotes:
            found = QUOTE_OR_END.search(self.page, at)
            if found is None:
                self.quotes = False
            elif found[0] == ">":
                return found.start()
            elif self.last[found[0]] == found.start():
                self.quotes = False
            else:
                at = self.page.index(found[0], found.end()) + 1
        return self.page.find(">", start)

    def after(self, name: str, at: int) -> int:
        """The place after the next end tag of that name, or -1."""
        if name not in self.unclosed:
            found = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)", re.I).search(self.page, at)
            if found is not None:
                end = self.page.find(">", found.end())
                return end + 1 if end >= 0 else len(self.page)
            self.unclosed.add(name)
        return -1

    def next(self, at: int) -> tuple[int, int, str, str]:
        """(start, end, name, attributes) of the next tag; a comment has no name, an end tag's starts with /. start -1: none is left."""
        page = self.page
        while (start := page.find("<", at)) >= 0 and self.last[">"] > start:
            if page.startswith("<!--", start):
                for empty in ("<!-->", "<!--->"):
                    if page.startswith(empty, start):
                        return start, start + len(empty), "", ""
                closed = COMMENT_END.search(page, start + 4)
                return start, closed.end() if closed else len(page), "", ""
            if page[start + 1 : start + 2] in ("!", "?"):
                return start, page.index(">", start) + 1, "", ""
            name = TAG_NAME.match(page, start + 1)
            if name is not None:
                end = self.end_of_tag(name.end())
                return start, end + 1, name[0].lower(), page[name.end() : end]
            at = start + 1
        return -1, len(page), "", ""


def mark_word(name: str, article: bool) -> bool:
    """Whether one class or id name marks what is not main text: a whole word, or parts of a compound that tell."""
    strong, weak = STRONG_MARKS, WEAK_MARKS
    parts = [x for x in PARTS.split(name.lower()) if x and not (article and x in HEADING_MARKS)]
    if not parts:
        return False
    if parts[0] in strong or parts[-1] in strong:
        return True
    known = sum(x in strong or x in weak for x in parts)
    return known >= 2 or known == 1 and len(parts) <= 2 and not any(x in TOPICS for x in parts)


def marked(name: str, values: dict[str, str], article: bool) -> bool:
    """Whether class or id say that the element is not main text."""
    if article and name in HEADINGS:
        return False
    said = LAYOUT.sub(" ", values.get("class", "")).split() + values.get("id", "").split()
    return any(mark_word(x, article) for x in said)


def hidden(values: dict[str, str]) -> bool:
    """Whether role, aria-hidden, hidden or style say that it is no text to read."""
    style = SPACE.sub("", values.get("style", "")).lower()
    return values.get("role", "").lower() in ROLES or values.get("aria-hidden", "").lower() == "true" or "hidden" in values or "display:none" in style


def split_blocks(page: str) -> tuple[list[Block], list[Place], list[Place]]:
    """Blocks in page order, class marks, and holders (articles and main elements), each after the one around it.

    Unclosed and stray tags are tolerated: an end tag closes up to its nearest open element.
    """
    blocks: list[Block] = []
    marks: list[Place] = []
    holders: list[Place] = []
    stack: list[tuple[str, bool, int, int]] = []  # element, apart, innermost mark and holder
    open_at: dict[str, list[int]] = {}  # places in the stack of each open element
    current: Block | None = None
    links = 0
    at = 0
    tags = Tags(page)

    def text(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            if piece.isspace():
                return
            current = Block(*(stack[-1][1:] if stack else (False, -1, -1)), any(e[0] in HEADINGS for e in stack[-3:]))
            blocks.append(current)
        current.parts.append(piece)
        if links:
            current.linked += len(piece.strip())
        elif not current.plain:
            current.plain = any(c.isalpha() for c in piece)

    def close(depth: int) -> None:
        while len(stack) > depth:
            open_at[stack.pop()[0]].pop()

    while at < len(page):
        start, end, name, attributes = tags.next(at)
        text(page[at : start if start >= 0 else end])
        at = end
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK:
                current = None
            if open_at.get(name):
                close(open_at[name][-1])
            continue
        if name == "br":
            text(" ")
            continue
        if name in DROPPED:
            end = tags.after(name, at)
            if end >= 0 or name in ("script", "style", "template", "svg"):
                at = end if end >= 0 else len(page)
            current = None if name in BLOCK else current
            continue
        empty = attributes.rstrip().endswith("/")
        if name == "a" and not empty:
            links += 1
        if name in BLOCK:
            current = None
            links = 0
            if name in CLOSES_P and stack and stack[-1][0] == "p":
                close(len(stack) - 1)
        if name in VOID or empty:
            continue
        _, apart, mark, holder = stack[-1] if stack else ("", False, -1, -1)
        if name in APART:
            # a heading block inside an article belongs to it
            apart = apart or not (name == "header" and holder >= 0)
        elif name in ("article", "main"):
            holders.append(Place(name, apart, mark, holder))
            holder = len(holders) - 1
        form = name in FORMS and not apart
        if attributes and not apart and name not in ("body", "html", "article", "main"):
            values: dict[str, str] = {}
            for k, a, b, c in ATTRIBUTE.findall(attributes):
                values.setdefault(k.lower(), html.unescape(a or b or c))
            if hidden(values):
                apart = True
            elif marked(name, values, holder >= 0):
                form = False
                marks.append(Place("", apart, mark, holder))
                mark = len(marks) - 1
        if form and not apart:
            marks.append(Place("form", apart, mark, holder))
            mark = len(marks) - 1
        open_at.setdefault(name, []).append(len(stack))
        stack.append((name, apart, mark, holder))
    for b in blocks:
        b.finish()
    return blocks, marks, holders


def set_apart(blocks: list[Block], marks: list[Place], holders: list[Place]) -> None:
    """Take class marks back from what holds the main text, set apart the blocks under all others, and label.

    That is: every main element; of articles, if each is under a mark, the one of most text; and within an article what
    holds over half of its text. A page left without main text gives up the marks that hold over half of all.
    A form is taken back if an article or main element stands in it, if all prose of its article does, or, on a page
    without articles outside of marks, if over half of all prose does.
    """
    waived = [False] * len(marks)
    open_blocks = [b for b in blocks if not b.apart]
    total = sum(len(b.text) for b in open_blocks)
    prose = 0
    for b in open_blocks:
        own = b.prose()
        prose += own
        for place in (marks[b.mark] if b.mark >= 0 else None, holders[b.holder] if b.holder >= 0 else None):
            if place is not None:
                place.size += len(b.text)
                place.prose += own
    for places, around in ((marks, "mark"), (holders, "holder")):
        for p in reversed(places):  # each stands after the one around it
            if getattr(p, around) >= 0:
                places[getattr(p, around)].size += p.size
                places[getattr(p, around)].prose += p.prose

    def waive(mark: int) -> None:
        while mark >= 0 and not waived[mark]:
            waived[mark] = True
            mark = marks[mark].mark

    def under() -> list[bool]:
        """Whether each mark, or one around it, still holds."""
        held: list[bool] = []
        for m, own in zip(marks, waived, strict=True):
            held.append(not own or m.mark >= 0 and held[m.mark])
        return held

    able = [h for h in holders if not h.apart]
    for h in able:
        if h.name == "main":
            waive(h.mark)
        around = h.mark
        while around >= 0 and marks[around].name == "form" and not waived[around]:
            waived[around] = True
            around = marks[around].mark
    held = under()
    if able and all(h.mark >= 0 and held[h.mark] for h in able):
        waive(max(able, key=lambda h: h.size).mark)
    held = under()
    outside = not any(h.mark < 0 or not held[h.mark] for h in able)
    for k, m in enumerate(marks):
        if m.name == "form":
            waived[k] = waived[k] or m.prose > 0 and (m.prose == holders[m.holder].prose if m.holder >= 0 else outside and 2 * m.prose > prose)
        else:
            waived[k] = waived[k] or m.holder >= 0 and 2 * m.size > holders[m.holder].size

    def settle() -> None:
        held = under()
        for b in open_blocks:
            b.apart = b.mark >= 0 and held[b.mark]
        label_blocks(blocks, holders)

    settle()
    most = [k for k, m in enumerate(marks) if 2 * m.size > total and not waived[k]]
    if most and not any(b.label == "good" for b in blocks):
        for k in most:
            waived[k] = True
        settle()


def stop_words(text: str) -> tuple[int, int]:
    """(stop words, words)."""
    words = [w.strip(".,;:!?\"'()").lower() for w in text.split()]
    return sum(w in STOPS for w in words), len(words)


def first_label(b: Block, anywhere: bool, in_article: bool, unknown: bool) -> str:
    """The first pass: good and bad by stop-word density, length and link density, near if these do not tell.

    Link density decides nothing inside an article: what is linked there is still its text. A block with many links
    that has words of its own is between: it follows its neighbours if both agree. In other scripts than Latin, and on
    a page of a language whose stop words are not listed (unknown), length and the end of a sentence stand for density.
    """
    n = len(b.text)
    if b.apart or not n:
        return "bad"
    links = b.linked / n
    if b.holder >= 0:
        if links > MOST_LINKS and not in_article:
            return "bad"
        return "good" if b.size >= SHORT or b.heading else "near"
    if links > MOST_LINKS:
        return "between" if b.plain and not anywhere else "bad"
    if unknown or b.other:
        if anywhere:
            return "near" if b.size >= LONG else "bad"
        return "good" if b.size >= LONG or b.size >= SHORT and b.text.endswith(SENTENCE_END) else "near"
    stops, words = stop_words(b.text)
    density = stops / words
    if anywhere:
        return "bad" if n < SHORT or density < SOME_STOPS else "near"
    if n < SHORT:
        return "near"
    if density >= MANY_STOPS or density >= SOME_STOPS and n >= LONG:
        return "good"
    return "near" if density >= SOME_STOPS or n < LONG else "bad"


def unknown_language(blocks: list[Block]) -> bool:
    """Whether the page's prose outside of articles has next to no stop word."""
    stops = words = 0
    for b in blocks:
        if not b.apart and b.holder < 0 and not b.other and b.prose():
            more = stop_words(b.text)
            stops, words = stops + more[0], words + more[1]
    return words > 0 and stops < FEW_STOPS * words


def label_blocks(blocks: list[Block], holders: list[Place]) -> None:
    """Both passes: the first decides by each block's own measures, the second gives ambiguous blocks the label of the nearest decided one.

    Of two as near, a good one counts. An ambiguous block of an article or main element looks only at decided blocks
    that stand in one too and are not set apart, so that an advert does not decide on the paragraph beside it; with
    none it is good, as is any ambiguous block of a page without decided ones. A block between is good if the nearest
    decided blocks on both sides are.
    """
    anywhere = any(b.holder >= 0 and not b.apart for b in blocks)
    articles: list[bool] = []
    for h in holders:
        articles.append(h.name == "article" or h.holder >= 0 and articles[h.holder])
    unknown = unknown_language(blocks)
    for b in blocks:
        b.label = first_label(b, anywhere, b.holder >= 0 and articles[b.holder], unknown)
    first = [b.label for b in blocks]
    nearest: list[list[tuple[int, bool]]] = [[] for _ in blocks]
    for order in (range(len(blocks)), range(len(blocks) - 1, -1, -1)):
        last: dict[bool, int | None] = {True: None, False: None}
        for k in order:
            b = blocks[k]
            if first[k] in ("near", "between"):
                s = last[b.holder >= 0]
                if s is not None:
                    nearest[k].append((abs(k - s), first[s] != "good"))
            else:
                last[False] = k
                if b.holder >= 0 and not b.apart:
                    last[True] = k
    for b, label, sides in zip(blocks, first, nearest, strict=True):
        if label == "near":
            b.label = "bad" if sides and min(sides)[1] else "good"
        elif label == "between":
            b.label = "good" if len(sides) == 2 and not any(bad for _, bad in sides) else "bad"


def main_text(page: str | None) -> str:
    """The main text: good blocks in page order, one a line."""
    blocks, marks, holders = split_blocks(page or "")
    set_apart(blocks, marks, holders)
    return "\n".join(b.text for b in blocks if b.label == "good" and b.text)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id_col, url_col, text, n_chars (code points). Null or empty html gives an empty text.

    Whole pages are read, however long; repeated rows are extracted again; other columns are ignored.
    """

    @F.pandas_udf("string")
    def extract(column: pd.Series) -> pd.Series:
        return column.map(main_text)

    texts = pages.select(F.col(id_col), F.col(url_col), extract(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))
