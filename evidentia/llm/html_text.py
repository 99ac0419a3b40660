"""Main text of web pages by two passes of block rules.

The page is cut into blocks at block-level tags.  The first pass decides
blocks by what holds of them alone: their link density, their length and the
share of stop words, and the elements they stand in, as navigation, footers,
forms and the like are no text by definition.  Short blocks stay undecided;
the second pass gives them the label of the nearest decided neighbour, of the
better one where both are equally near.

Words in a class or id (``HINTS``) are only a hint.  A name is cut into words,
camel case too; its last word decides, words such as "body" or "container"
left aside: "comment-body" and "siteFooter" are hints, "sidebar-article" is
none, nor is "no-sidebar" (``STATES``).  Hints do not count on the page as a
whole, on what holds an article or a main heading, nor where nothing of the
page would be left; where still nothing is, the block with most text outside
links stays, unless it is all links.
Stop words are those listed, and the short words that run through many of the
page's own blocks; where a page's language shows neither, length and links
decide alone.

Reading takes one pass over the characters: each is looked at a fixed number
of times, whatever the mark-up.

Defined cases: null html counts as empty and gives empty text; scripts,
styles, titles and the like end at their own end tag only, or with the page; a
tag or comment that never ends takes the rest of the page, as in browsers;
elements left open end with the page; repeated rows are read each; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _common as C

#: First-pass limits: link density, characters of a short block, and shares of stop words.
MOST_LINKS, SHORT, FEW_STOPS, MANY_STOPS = 0.4, 70, 0.05, 0.25

#: Frequent function words of the languages at hand (fixed values).
STOP_WORDS = frozenset(
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which with you "
    "aber als am an auch auf aus bei das dem den der des die ein eine einen er es für hat ich im in ist mit nicht oder sich sie sind und von war wie wir zu "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les mais ne nous ou par pas plus pour qui que se son sur un une vous "
    "al como con del el ella ellos en entre era es esta este la las lo los más muy no o para pero por que se sin sobre su sus un una y".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no mark-up and no text of the page either.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements whose content is mark-up, but no text of the page.
UNSEEN = frozenset("noscript template svg math object canvas audio video map select button datalist head".split())
AROUND = frozenset("nav header footer aside form menu dialog search fieldset".split())
ARTICLE = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in a class or id that mark what stands around an article.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted banner cookie cookies consent gdpr notice notices alert disclaimer "
    "comment comments commentlist reply replies respond disqus sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs toolbar share sharing "
    "social newsletter subscribe subscription signup login search related recommended widget popup modal overlay footer masthead pagination pager skip".split()
)
#: Words beside a hint that tell of a state of the page.
STATES = frozenset("no not without has have with hide hidden page layout".split())
#: Words at the end of a name that say nothing of its own, and those that name the text itself.
PLAIN = frozenset("container wrapper wrap body content contents text inner outer list box area block section item items".split())
TEXTS = frozenset("site entry post story article main".split())
#: Short words that stand in this many blocks of a page are stop words of it.
RUNNING, RUNNING_CHARS = 3, 5

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|style|hidden|aria-hidden)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?+(?![^\s/])""", re.I)
_HIDDEN = re.compile(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_PART = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_HEADING = frozenset(f"h{i}" for i in range(1, 7))


@dataclass
class Block:
    text: str
    linked: int = 0  # characters inside links
    around: bool = False  # in an element that stands around the article
    hinted: bool = False  # in one that its class or id says so of
    article: bool = False  # in an article or main element
    label: str = field(default="")


@dataclass
class Open:
    """An open element."""

    tag: str
    around: bool = False
    hint: list[bool] | None = None  # of the innermost hinted element from here outward; shared with the blocks inside, as it may be taken back


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): kind is text, open or close; rest is the text or the attributes."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        if m := _TAG.match(page, lt):
            tag, at = m[2].lower(), m.end()
            yield ("close" if m[1] else "open"), tag, m[3]
            if tag in RAW and not m[1]:
                end = _RAW_END[tag].search(page, at)
                if end is None:
                    return
                at = end.start()
        elif page.startswith("<!--", lt):
            end = page.find("-->", lt + 2)
            if end < 0:
                return
            at = end + 3
        elif page[lt + 1 : lt + 2] in ("!", "?", "/") or page[lt + 1 : lt + 2].isalpha() and page[lt + 1].isascii():
            end = page.find(">", lt) if page[lt + 1] in "!?/" and not page[lt + 2 : lt + 3].isalpha() or page[lt + 1] in "!?" else -1
            if end < 0:
                return
            at = end + 1
        else:
            yield "text", "", "<"
            at = lt + 1


def _hints(name: str) -> bool:
    """Whether one class name or id names what stands around an article."""
    words = [w.lower() for w in _PART.findall(name)]
    if not HINTS.intersection(words) or STATES.intersection(words):
        return False
    head = next((w for w in reversed(words) if w not in PLAIN), "")
    return head not in TEXTS


def _says(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element stands around the article for certain, and whether its class or id hints at it."""
    around, hint = tag in AROUND, False
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value.lower()):
            around = True
        elif name == "role":
            around |= value.lower() in ROLES
        elif name in ("class", "id"):
            hint |= any(map(_hints, value.split()))
    return around, hint and tag not in ("html", "body") and tag not in ARTICLE


def blocks_of(page: str) -> list[Block]:
    """The page's blocks with text, in order; references are decoded, white space is single."""
    out: list[tuple[Block, list[bool] | None]] = []
    open_: list[Open] = []
    cleared = 0  # so many of the open elements, from the outermost on, have had their hints taken back
    held: Counter[str] = Counter()  # how many of a tag are open
    unseen = around = 0  # open elements that are not shown, that stand around
    text: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        got = " ".join("".join(text).split())
        if got:
            # elements open at one time lose their hints together, so the innermost one speaks for all
            out.append((Block(got, linked, around > 0, False, bool(held["article"] + held["main"])), open_[-1].hint if open_ else None))
        text.clear()
        linked = 0

    def pop() -> Open:
        nonlocal unseen, around, cleared
        e = open_.pop()
        cleared = min(cleared, len(open_))
        held[e.tag] -= 1
        unseen -= e.tag in UNSEEN or e.tag in RAW
        around -= e.around
        return e

    for kind, tag, rest in tokens(page):
        if kind == "text":
            if unseen:
                continue
            piece = entities.unescape(rest) if "&" in rest else rest
            text.append(piece)
            if held["a"]:
                linked += len("".join(piece.split()))
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in BLOCKS:
            end()
        if kind == "close":
            if held[tag]:
                while pop().tag != tag:
                    pass
        elif tag not in VOID and not (rest.endswith("/") and tag not in BLOCKS and tag not in RAW):
            if tag in BLOCKS:
                while open_ and open_[-1].tag not in BLOCKS and open_[-1].tag not in UNSEEN:  # inline elements end with their block
                    pop()
            if tag in ("p", "li", "dt", "dd", "option", "td", "th", "tr") and open_ and open_[-1].tag == tag:
                pop()
            elif tag in BLOCKS and open_ and open_[-1].tag == "p":
                pop()
            if tag == "body":
                while held["head"]:
                    pop()
            if tag in ARTICLE:
                while around and not unseen:  # an article ends what was left open before it
                    pop()
            if tag in ARTICLE or tag == "h1":
                for e in open_[cleared:]:  # what holds an article or the main heading does not stand around it
                    if e.hint:
                        e.hint[0] = False
                cleared = len(open_)
            says = _says(tag, rest)
            open_.append(Open(tag, says[0], [True] if says[1] else open_[-1].hint if open_ else None))
            held[tag] += 1
            unseen += tag in UNSEEN or tag in RAW
            around += says[0]
    end()
    for b, hint in out:
        b.hinted = bool(hint and hint[0])
    return [b for b, _ in out]


def _stop_share(b: Block, stops: frozenset[str]) -> float:
    ws = _WORD.findall(b.text.lower())
    return sum(w in stops for w in ws) / max(1, len(ws))


def own_stop_words(blocks: list[Block]) -> frozenset[str]:
    """The short words that run through the page's longer blocks."""
    seen = Counter(w for b in blocks if len(b.text) >= SHORT for w in {x for x in _WORD.findall(b.text.lower()) if len(x) <= RUNNING_CHARS})
    return frozenset(w for w, n in seen.items() if n >= RUNNING)


def first_pass(b: Block, stops: frozenset[str] = STOP_WORDS, known: bool = True, hints: bool = True) -> str:
    """good, bad, or an empty string for undecided; ``known`` says that the stop words are of the page's language."""
    solid = len("".join(b.text.split()))
    links = b.linked / max(1, solid)
    if b.around or hints and b.hinted or links > MOST_LINKS:
        return "bad"
    share = _stop_share(b, stops)
    if b.article:
        return "" if len(b.text) < SHORT and share < MANY_STOPS else "good"
    if len(b.text) < 2 * SHORT and b.text.lstrip("(").startswith(("©", "Copyright")):
        return "bad"
    if len(b.text) < SHORT:
        return ""
    if not known:
        return "good"
    return "good" if share >= MANY_STOPS else "" if share >= FEW_STOPS else "bad"


def _nearest(decided: list[tuple[int, str]], n: int) -> list[tuple[float, bool]]:
    """For each of ``n`` places the distance of the nearest decided block and whether it is not good."""
    out = [(float("inf"), True)] * n
    for order in (1, -1):
        k, at, label = 0, None, ""
        line = decided[::order]
        for i in range(n)[::order]:
            while k < len(line) and (line[k][0] - i) * order <= 0:
                at, label = line[k]
                k += 1
            if at is not None:
                out[i] = min(out[i], (abs(at - i), label != "good"))
    return out


def classify(blocks: list[Block]) -> list[Block]:
    """Both passes: every block gets the label good or bad.

    Neighbours in the same part of the page (the article, or outside it) come before others.
    """
    stops = STOP_WORDS | own_stop_words(blocks)
    known = any(_stop_share(b, stops) >= FEW_STOPS for b in blocks if len(b.text) >= SHORT and not b.around)
    first = [first_pass(b, stops, known) for b in blocks]
    if "good" not in first and not any(b.article for b in blocks):
        first = [first_pass(b, stops, known, hints=False) for b in blocks]
    n = len(blocks)
    every = _nearest([(i, x) for i, x in enumerate(first) if x], n)
    part = {a: _nearest([(i, x) for i, x in enumerate(first) if x and blocks[i].article == a], n) for a in (True, False)}
    for i, b in enumerate(blocks):
        far, bad = part[b.article][i]
        if far == float("inf"):
            far, bad = every[i]
            if b.article or far == float("inf"):
                bad = False  # where nothing is decided, all is kept
        b.label = first[i] or ("bad" if bad else "good")
    if blocks and not any(b.label == "good" for b in blocks):
        own = lambda b: (not b.around) * (len("".join(b.text.split())) - b.linked)
        best = max(blocks, key=lambda b: (not b.hinted, own(b)))
        best.label = "good" if own(best) > 0 and not best.hinted else "bad"
    return blocks


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in classify(blocks_of(page or "")) if b.label == "good")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page; needs columns page_id, url and html."""

    def run(batches):
        for batch in batches:
            got = [main_text(h) for h in batch.column(2).to_pylist()]
            cols = [batch.column(0), batch.column(1), pa.array(got, pa.string()), pa.array([*map(len, got)], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_pages(C.table(spark, sf_dir, "pages"))


QUERIES = {"op4_html_text": op4_html_text}
ORACLE_SQL: dict[str, str] = {}
