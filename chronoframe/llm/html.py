"""Main text of HTML pages by two-pass block rules.

Pass one decides blocks on their own: bad in elements that are not the article
(menus, footers, forms, asides, or by class or role) and where most of the text is
links; good where length and stop-word density speak of prose. Headings, short
blocks, and longer ones with few stop words stay undecided. Pass two gives each of
them the label of its nearest decided neighbour in its container, a heading that
of what follows. Where nothing in the container is decided, prose under a heading
is good, and other blocks are if both sides are. That a block is in an ``article``
or ``main`` decides nothing, but that a ``header`` there is not the page's.

Cases: null and empty html, and pages without a good block, give an empty text;
unclosed elements and comments run to the end of the page; null urls stay null;
rows that repeat a page_id give a row each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .base import map_rows

# Common function words of the languages at hand.
STOP_WORDS = frozenset(
    """
    a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more
    no not of on one or our she so some than that the their them there they this to was we were what when which who
    will with would you
    au aux avec ce ces cette dans de des du elle en est et être il ils je la le les leur lui mais ne nous on ou où
    par pas plus pour qu que qui sa se ses son sont sur un une vous
    aber als am an auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für
    hat ich ihr im in ist mit nach nicht noch nur oder sein sich sie sind über um und uns von vor war was wie wir zu
    zum zur
    al algo como con cuando de del desde dos el ella ellos en entre era es esta este esto fue ha hay la las lo los
    más me mi muy no nos o para pero por que se ser si sin sobre son su sus también tiene un una uno y ya yo
    """.split()
)
# Elements, roles and class words that mark parts other than the article.
BAD_TAGS = frozenset("nav footer aside form head title menu dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
BAD_WORDS = frozenset(
    """
    ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
    cookies disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices
    notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond
    share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar widget widgets
    """.split()
)
FRAME_WORDS = frozenset("article body content container has layout main no page post site with without wrap wrapper".split())
BLOCK_TAGS = frozenset(
    """
    address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer
    form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td
    tfoot th thead title tr ul
    """.split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SHORT, LONG, LINKS, FEW_STOPS, MANY_STOPS = 70, 200, 0.5, 0.1, 0.25
#: What a step from one container to another counts for, more than any number of blocks.
FAR = 1 << 40
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p blockquote pre li dd dt figcaption".split())
#: Blocks that are no containers of others.
FLAT = HEADINGS | frozenset("p li dt dd tr td th option button pre legend caption figcaption summary address".split())
#: Elements whose content is no text of the page.
RAW = frozenset("script style template iframe svg textarea select canvas audio video".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    tag: str = ""
    bad: bool = False
    region: int = 0  # its container
    linked: int = 0
    text: str = ""
    label: str = ""


def _bad_attrs(tag: str, attrs: str) -> bool:
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    for name, a, b, c, hidden in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if hidden or (name == "aria-hidden" and value.lower() == "true"):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.strip().lower() in BAD_ROLES:
            return True
        if name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in _NAME.findall(one)}
                if words & BAD_WORDS and not words & FRAME_WORDS:
                    return True
        if name == "itemprop" and value.lower() == "comment":
            return True
    return False


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("", text, "") for text, else ("<" or "/", element, attributes). Every character is passed a fixed number of times.

    A tag ends at the first > outside quotes; a quote that is never closed is
    none. What has no end at all (a tag, a comment, a script) goes to the page's end.
    """
    at, never = 0, set()  # quotes of which there is no other
    while True:
        lt = page.find("<", at)
        if lt < 0:
            break
        m = _TAG.match(page, lt)
        if not m and page[lt + 1 : lt + 2] not in ("!", "?"):
            yield "", page[at : lt + 1], ""  # a mere sign
            at = lt + 1
            continue
        if lt > at:
            yield "", page[at:lt], ""
        if not m:
            mark = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(mark, lt + (4 if mark == "-->" else 2))
            at = end + len(mark) if end >= 0 else len(page)
            continue
        here = m.end()
        while True:
            s = _STOP.search(page, here)
            if not s or s[0] == ">":
                break
            end = page.find(s[0], s.end()) if s[0] not in never else -1
            if end < 0:
                never.add(s[0])
            here = end + 1 if end >= 0 else s.end()
        if not s:
            at = len(page)
            break
        tag, at = m[2].lower(), s.end()
        yield "/" if m[1] else "<", tag, page[m.end() : s.start()]
        if tag in RAW and not m[1]:
            end = _CLOSE[tag].search(page, at)
            at = end.end() if end else len(page)
            yield "/", tag, ""
    if at < len(page):
        yield "", page[at:], ""


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, with what is known of where they stand."""
    out: list[Block] = []
    open_: list[tuple[str, bool, bool, int]] = []  # element, whether it is bad, whether it is in an article, its number
    count: Counter = Counter()  # of open elements
    now = Block()
    links, breaks, number = 0, 0, 0

    def turn(tag: str, bad: bool) -> None:
        nonlocal now, breaks
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            out.append(now)
        inside = open_[-1] if open_ else ("", False, False, 0)
        now, breaks = Block(tag=tag, bad=bad or inside[1], region=inside[3]), 0

    for kind, tag, attrs in tokens(page):
        if not kind:
            said = entities.unescape(tag)
            now.parts.append(said)
            if not said.isspace():
                breaks = 0
                if links:
                    now.linked += len(" ".join(said.split()))
        elif tag in RAW:
            pass
        elif tag == "a":
            links = kind == "<"
        elif tag == "br":
            breaks += 1
            now.parts.append(" ")
            if breaks > 1:
                turn(now.tag, now.bad)
        elif kind == "/":
            if count[tag]:
                while True:
                    last = open_.pop()[0]
                    count[last] -= 1
                    if last == tag:
                        break
            if tag in BLOCK_TAGS:
                links = 0
                turn("", False)
        elif tag in VOID:
            if tag == "hr":
                turn("", False)
        else:
            inside = open_[-1] if open_ else ("", False, False, 0)
            bad = _bad_attrs(tag, attrs) or tag in BAD_TAGS or (tag == "header" and not inside[2])
            block = tag in BLOCK_TAGS
            if bad and not block or block and tag not in FLAT:
                number += 1
                open_.append((tag, bad or inside[1], inside[2] or tag in ("article", "main"), number))
                count[tag] += 1
            if block:
                links = 0
            if block or bad:
                turn(tag, bad)
    turn("", False)
    return out


def classify(b: Block) -> str:
    """good, bad, or unsure, which leaves it to the neighbours."""
    if b.bad or b.linked > LINKS * len(b.text):
        return "bad"
    if len(b.text) < LONG and b.text.lower().startswith(("©", "copyright", "(c)")):
        return "bad"
    if b.tag in HEADINGS or len(b.text) < SHORT:
        return "unsure"
    words = _WORD.findall(b.text.lower())
    stops = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return "good" if stops >= MANY_STOPS or (stops >= FEW_STOPS and len(b.text) >= LONG) else "unsure"


def settle(found: list[Block]) -> None:
    """The labels of all blocks, in place."""
    for b in found:
        b.label = classify(b)
    firm = [b.label != "unsure" for b in found]
    titled = {b.region for b in found if b.tag in HEADINGS and not b.bad}
    n = len(found)
    before, after = [(0, "")] * n, [(0, "")] * n  # distance and label of the nearest decided neighbour
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        far, label, last = 2 * FAR, "bad", None
        for i in order:
            if last is not None:
                far += 1 if found[i].region == found[last].region else FAR
            side[i] = far, label
            if firm[i]:
                far, label = 0, found[i].label
            last = i
    for i, b in enumerate(found):
        if firm[i]:
            continue
        (p, left), (q, right) = before[i], after[i]
        if b.tag in HEADINGS and q < FAR:
            b.label = right  # a heading goes with what follows
        elif min(p, q) < FAR:
            b.label = left if p < q else right if q < p else "good" if "good" in (left, right) else "bad"
        elif b.region in titled and (not b.tag or b.tag in PROSE):
            b.label = "good"  # nothing is decided in a container with a heading: it is a short article
        else:
            b.label = "good" if left == right == "good" else "bad"


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    settle(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    def make():
        def rows(ids, urls, pages):
            for page_id, url, page in zip(ids, urls, pages):
                text = main_text(page)
                yield page_id, url, text, len(text)

        return rows

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_rows(pages.select("page_id", "url", "html"), make, f"page_id {kind}, url string, text string, n_chars long")
