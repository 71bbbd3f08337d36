"""Main text of web pages by two passes over blocks.

The page is cut into blocks at block-level tags; text in scripts, styles, forms and other parts that never hold
prose is skipped. The first pass labels each block by its region, its length, its link density and its density of
stop words: good, bad, or short and undecided. In the second pass an undecided block takes the label of its nearest
decided neighbours; where they differ, the nearer one, or its region, decides. Where no block of the page is good (a
language without stop words here, or short paragraphs only), undecided paragraphs stay.

Names of classes mark regions, but with care: states of the page (``has-sidebar``) say nothing, names of layout beside
names of content leave a wrapper to the tests, and an article or main element inside a region that only a name
marks counts as main if the page has no other main region.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINKS, STOPS, SHORT = 0.34, 0.28, 70
# Tags by their role.
SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "video", "audio", "head",
           "title", "form", "button", "select", "textarea", "label", "fieldset", "dialog", "option", "datalist"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
BOILER = {"nav", "footer", "aside", "menu"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
          "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements in whose prose a label is a word like others.
PROSE = {"p", "li", "td", "dd", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end where their next sibling begins, with the tags that end them and those that shelter them.
CLOSED_BY = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
             "tr": ({"tr"}, {"table"}), "td": ({"td", "th", "tr"}, {"table"}), "th": ({"td", "th", "tr"}, {"table"})}
# Parts of class, id and role names that mark a region.
BOILER_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
    "sidebar", "sidenav", "aside", "complementary", "widget", "widgets", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "footer", "foot", "contentinfo", "masthead", "topbar", "toolbar", "cookie", "cookies", "consent", "gdpr", "notice",
    "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing",
    "social", "related", "recommended", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion",
    "pagination", "pager", "copyright", "legal", "disclaimer", "search", "tags", "skip"}
LAYOUT_NAMES = {"sidebar", "sidenav", "share", "sharing", "social", "related", "menu", "nav", "navbar", "banner", "search", "tags", "widget", "widgets"}
NOT_MAIN = {"comment", "comments", "reply", "ad", "sponsored"}
MAIN_NAMES = {"article", "main", "content", "post", "entry", "story", "articlebody"}
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a about after all also an and are as at be been but by can could did do for from had has have he her his how i if in into is it its "
    "more no not of on one or our out over she so some than that the their them then there these they this to up was we were what when "
    "which who will with would you "
    "aber als am auch auf aus bei bin bis das dass dem den der des die doch durch ein eine einem einen einer er es für hat ich ihr im ist "
    "kann mit nach nicht noch nur oder sein sich sie sind so über um und uns von vor war was wenn wie wir wird zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle elles en est et il ils je la le les leur lui mais même ne nous ont ou où par pas "
    "plus pour qu que qui sa se ses si son sont sur un une vous y "
    "al algo ante como con cuando del desde donde el ella ellos entre era es esta este esto fue ha hay la las lo los más me muy no nos o "
    "para pero por porque que se sin sobre su sus también te tiene todo un una y ya".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Possessive, and every branch may end with the page, so that broken markup is read once.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
#: Class names that tell a state of the page, not what an element holds.
STATE = re.compile(r"(?:has|no|with|without)[-_].*|.*[-_](?:enabled|disabled)", re.I)
WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    region: str  # "boiler", "named" (boilerplate by its name alone), "main", "again" (main inside such) or ""
    tag: str  # the element around the text
    parts: list[str] = field(default_factory=list)
    linked: int = 0  # characters inside links
    text: str = ""

    def add(self, part: str, link: bool) -> None:
        if "&" in part:
            part = html.unescape(part)
        self.parts.append(part)
        if link:
            self.linked += len(part)


def region_of(tag: str, attributes: str, outer: str) -> str:
    """Region that an element opens: boilerplate stays boilerplate, but for an article or main element where only a name
    said so; a page header is boilerplate unless inside the article."""
    inside = outer in ("main", "again")
    if outer == "boiler" or tag in BOILER or (tag == "header" and not inside):
        return "boiler"
    names: set[str] = set()
    if "none" in attributes and UNSEEN.search(attributes):
        return "boiler"
    if attributes and ("=" in attributes or "hidden" in attributes):
        for m in NAMED.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value == "true"):
                return "boiler"
            if key != "aria-hidden":
                names.update(x.lower() for token in value.split() if not STATE.fullmatch(token) for x in PART.findall(token))
    if tag in ("html", "body"):
        return outer
    marks = names & BOILER_NAMES
    if tag in MAIN:
        if names & NOT_MAIN or (outer == "named" and marks) or ("related" in names and not names & MAIN_NAMES):
            return "boiler"
        return "again" if outer in ("named", "again") or "related" in names else "main"
    if outer == "named":
        return outer
    if marks and not inside and names & MAIN_NAMES and marks <= LAYOUT_NAMES:
        return outer
    if marks or ("header" in names and not inside and names.isdisjoint(MAIN_NAMES)):
        return "boiler" if inside or marks & NOT_MAIN else "named"
    return outer if inside else "main" if names & MAIN_NAMES else outer


def blocks(page: str) -> list[Block]:
    """Blocks with text in page order. Unclosed elements end with the element around them; end tags without a start
    are ignored; an unclosed comment, script or tag reaches to the end of the page."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool]] = []  # tag, region, whether skipped
    region, skipped, links = "", False, 0
    current, at, low = Block("", ""), 0, page.lower()

    def end_block() -> None:
        nonlocal current
        if current.parts:
            current.text = " ".join("".join(current.parts).split())
            if current.text:
                out.append(current)
        current = Block(region, "")

    def place_block(tag: str) -> None:
        current.region, current.tag = region, tag

    def pop(tag: str, shelter: set[str]) -> None:
        nonlocal region, skipped, links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                links -= sum(x[0] == "a" for x in stack[k:])
                del stack[k:]
                region, skipped = (stack[-1][1], stack[-1][2]) if stack else ("", False)
                return
            if stack[k][0] in shelter:
                return

    while True:
        m = TAG.search(page, at)
        if not skipped and (stop := m.start() if m else len(page)) > at:
            current.add(page[at:stop], links > 0)
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if tag == "br" and not skipped:
            current.add(" ", False)
        if not tag or tag == "br":
            continue
        if m[1]:
            if tag not in INLINE:
                end_block()
            pop(tag, set() if tag not in INLINE else {"p", "div", "li", "td", "section", "article", "body"})
            if tag not in INLINE:
                place_block(next((x[0] for x in reversed(stack) if x[0] not in INLINE), ""))
            continue
        if tag not in INLINE:
            if tag in CLOSED_BY:
                for sibling in CLOSED_BY[tag][0]:
                    pop(sibling, CLOSED_BY[tag][1])
            elif tag not in VOID:
                pop("p", {"td", "li", "div", "article", "section", "body", "blockquote", "button"})
            end_block()
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            close = low.find("</" + tag, at)
            at = len(page) if close < 0 else close
        region = region_of(tag, m[3], region)
        word = tag == "label" and any(x[0] in PROSE for x in stack)
        skipped = (skipped or (tag in SKIPPED and not word)) and tag not in MAIN  # a form may wrap the whole page
        links += tag == "a"
        stack.append((tag, region, skipped))
        if tag not in INLINE:
            place_block(tag)
        elif not current.parts:
            current.region = region
    end_block()
    return out


def first_pass(block: Block, has_main: bool) -> str:
    """good, bad, or short (undecided)."""
    size, density = len(block.text), block.linked / len(block.text)
    if block.region in ("boiler", "named", "again"):
        return "bad"
    if block.region == "main" and size >= SHORT and density <= LINKS:
        return "good"
    words = WORD.findall(block.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if block.region == "main":
        return "bad" if density > 0.5 else "good" if density <= LINKS and stops >= STOPS else "short"
    if has_main or density > LINKS:
        return "bad"
    if size < (SHORT // 2 if block.tag == "p" else SHORT):
        return "short"
    return "good" if stops >= STOPS else "short" if density <= LINKS / 2 else "bad"


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is kept: undecided ones follow their nearest decided neighbours. If these differ, a block
    of the main region or a heading before good text is kept, another takes the nearer label; if they are as near,
    paragraphs are kept. Where nothing is good, undecided paragraphs and long blocks are, and the headings before them."""
    n = len(labels)
    if "good" not in labels:
        text = [x == "short" and (b.tag == "p" or len(b.text) >= SHORT or b.region == "main") for x, b in zip(labels, found)]
        for i in range(n - 2, -1, -1):
            text[i] = text[i] or (labels[i] == "short" and found[i].tag in HEADINGS and text[i + 1])
        return text
    before, after = [(0, "bad")] * n, [(0, "bad")] * n
    for order, near in ((range(n), before), (range(n - 1, -1, -1), after)):
        far, label = n + 1, "bad"
        for i in order:
            far += 1
            if labels[i] != "short":
                far, label = 0, labels[i]
            near[i] = (far, label)
    out = []
    for i, label in enumerate(labels):
        if label != "short":
            out.append(label == "good")
            continue
        (da, a), (db, b) = before[i], after[i]
        if found[i].region == "main":
            out.append(True)
        elif a == b:
            out.append(a == "good")
        elif found[i].tag in HEADINGS:
            out.append(b == "good")
        else:
            out.append(found[i].tag == "p" if da == db else (a if da < db else b) == "good")
    return out


def main_text(page: str | None) -> str:
    """Texts of the kept blocks, joined by spaces; empty for a null or empty page and for one without prose."""
    if not page:
        return ""
    found = blocks(page)
    has_main = any(b.region == "main" for b in found)
    if not has_main:
        for b in found:
            b.region = "main" if b.region == "again" else b.region
        has_main = any(b.region == "main" for b in found)
    kept = second_pass(found, [first_pass(b, has_main) for b in found])
    return " ".join(b.text for b, keep in zip(found, kept) if keep)


def extract(pages: DataFrame, page: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """(*carry, text) of every row, in one pass without a shuffle; memory is one Arrow batch.

    Null and empty pages give an empty text; repeated rows and null ids stay rows of their own; columns that are not
    carried are ignored; an empty table gives no rows. Pages are read whole, in time linear in their length.
    """
    slim = pages.select(*carry, F.col(page).cast("string").alias("_page"))
    kept = slim.select(*carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p.as_py()) for p in batch.columns[-1]], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], [*carry, "text"])

    return slim.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", text string")
