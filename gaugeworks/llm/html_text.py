"""Main text of web pages by the distribution of text over blocks.

Markup is stripped so that each block element's text is one line. The lengths of neighbouring lines are summed over sliding
windows. A surge, a line whose window sum reaches the threshold, opens a run of text; it ends at a dive, where the
sums fall below the threshold. The run with most text is kept, with the runs that belong to it.

Scripts, styles and other parts that are never prose are cut out first; menus, headers, footers, sidebars and comments are
cut out where an element's name, role or label says so, unless they hold an article or main element, or were never closed and took
most of the page in. Other classes and ids are hints, as are forms: such an element is cut out unless it holds an article or main
element or most of the page's text. Lines in an article or main element weigh more than others, up to a bound: where text
outside weighs more, the element does not matter. A page is read once, whatever its markup is like.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from gaugeworks.llm.common import per_text

WINDOW = 3
LEAST = 60
#: A line in a main element counts so many times; a run past a break stays if its lines have so many characters on average.
MAIN_WEIGHT = 4
DENSE = 30
#: Of deeper nesting, only so many containers are told apart, and labels read.
DEEPEST = 64
# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset(
    "script style template noscript head title svg math iframe object canvas audio video select textarea button "
    "datalist map applet frameset noframes".split()
)
ASIDE = frozenset("nav header footer aside menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split()
)
MAIN = frozenset(("article", "main"))
CONTAINERS = frozenset("article body center details div fieldset main section".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner banners "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login nav "
    "navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header masthead topbar toolbar "
    "pagination pager comment comments commentlist disqus reply replies respond discussion share sharing social related "
    "recommended recommendations widget widgets copyright disclaimer teaser teasers tags tagcloud skip".split()
)
#: Sections of an article are called like this too.
AMBIGUOUS = frozenset("discussion related notice notices".split())
#: The page itself, headings and paragraphs.
UNLABELLED = frozenset("html body p h1 h2 h3 h4 h5 h6 hgroup li td th dt dd tr blockquote pre figcaption caption".split())
#: What else a head may hold; any other element ends it, as its end tag may be left out.
HEADS = frozenset("base basefont bgsound command link meta noscript object script style template title".split())
#: A token of these words, one of the first line among them, names readers' comments.
COMMENTS = frozenset("comment comments commentlist disqus".split())
COMMENT_PARTS = COMMENTS | frozenset(
    "area author block body box children container content entry feed footer form header holder inner item list main meta "
    "replies reply respond section text thread title user wrap wrapper".split()
)
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_START = re.compile(r"<(?:!--|[!?]|(/?)([A-Za-z][^\s/>]*))")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it ends an element, name, attributes) of each tag, in order; comments and declarations have no name.

    A tag ends at the first ``>`` outside quotes. A quote that is never closed is none. The page is passed over once: what is not found
    behind one place is not looked for behind a later one.
    """
    last, at, unclosed = page.rfind(">"), 0, set()
    while match := _START.search(page, at):
        start, inner = match.span()
        if match[2] is None:
            comment = match[0] == "<!--"
            end = page.find("-->" if comment else ">", inner)
            at = len(page) if end < 0 else end + (3 if comment else 1)
            yield start, at, False, "", ""
            continue
        if inner > last:
            at = inner  # no tag ends any more; a comment may still come
            continue
        place, end = inner, -1
        while place <= last:
            stop = _STOP.search(page, place)
            sign = stop[0]
            if sign == ">":
                end = stop.start()
                break
            close = -1 if sign in unclosed else page.find(sign, stop.end())
            if close < 0:
                unclosed.add(sign)
            place = stop.end() if close < 0 else close + 1
        if end < 0:
            end = page.find(">", inner)
        at = end + 1
        yield start, at, match[1] == "/", match[2].lower(), page[inner:end]


def _part_of(name: str, attributes: str) -> str:
    """What an element's name, role or label says of it: ``cut``, ``aside``, ``comments``, ``hint`` or nothing."""
    if name in UNSEEN:
        return "cut"
    if name in ASIDE:
        return "aside"
    if not attributes or name in ("html", "body"):
        return "hint" if name == "form" else ""
    found = _ATTRIBUTE.findall(attributes)
    for attribute, value in found:
        attribute, value = attribute.lower(), value.strip("\"'").lower()
        if name not in MAIN and attribute == "role" and value in ROLES:
            return "hint" if value == "form" else "aside"
        if name not in MAIN and (attribute == "hidden" or attribute == "aria-hidden" and value == "true"):
            return "cut"
    if name not in UNLABELLED or name == "li":
        for attribute, value in found:
            if attribute.lower() in ("class", "id"):
                for token in value.strip("\"'").split():
                    words = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
                    if words & COMMENTS and words <= COMMENT_PARTS:
                        return "comments"
    return "hint" if name == "form" or _is_labelled(name, attributes) else ""


def _is_labelled(name: str, attributes: str) -> bool:
    """Whether a whole token of an element's class or id is made of labels. It is a hint only, and none in running text."""
    if not attributes or name in UNLABELLED:
        return False
    for attribute, value in _ATTRIBUTE.findall(attributes):
        if attribute.lower() in ("class", "id"):
            for token in value.strip("\"'").split():
                words = _WORD.findall(_CAMEL.sub(" ", token).lower())
                if words and LABELS.issuperset(words) and not AMBIGUOUS.issuperset(words):
                    return True
    return False


@dataclass
class _Hint:
    """A part that may be cut out, and what it turned out to hold."""

    kind: str
    size: int = 0
    holds_main: bool = False
    closed: bool = False

    def is_cut(self, whole: int) -> bool:
        most = 2 * self.size > whole
        if self.kind == "hint":
            return not (self.holds_main or most)
        return not (self.holds_main or most and not self.closed)


@dataclass
class _Element:
    name: str
    cut: bool
    main: bool
    hint: int | None
    container: bool


class _Open:
    """The open elements, and where those of a name, the blocks and the main ones are among them."""

    def __init__(self) -> None:
        self.stack: list[_Element] = []
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.mains: list[int] = []
        self.walls: list[int] = []

    def push(self, element: _Element) -> None:
        place = len(self.stack)
        self.places[element.name].append(place)
        if element.main:
            self.mains.append(place)
        if element.name in BLOCKS and element.name not in _CLOSED_BY:
            self.walls.append(place)
        self.stack.append(element)

    def pop(self) -> _Element:
        element = self.stack.pop()
        place = len(self.stack)
        self.places[element.name].pop()
        for kind in (self.mains, self.walls):
            if kind and kind[-1] == place:
                kind.pop()
        return element

    def last(self, name: str) -> int:
        return self.places[name][-1] if self.places.get(name) else -1

    def ended_by(self, name: str) -> int:
        """The innermost element that a start tag ends, behind the last block; -1 if there is none."""
        wall = self.walls[-1] if self.walls else -1
        found = max((self.last(closed) for closed, closers in _CLOSED_BY.items() if name in closers), default=-1)
        return found if found > wall else -1


def lines_of(page: str) -> list[tuple[str, bool, tuple]]:
    """(text, in main element, containers from the page down) per block, in page order; cut-out parts leave an empty line. One
    pass over the page; which hinted elements are cut out is told by what they turn out to hold."""
    lines: list[tuple[str, bool, tuple]] = []
    within: list[tuple] = []  # hinted elements around each line
    parts: list[str] = []
    elements, hinted = _Open(), []
    hints: tuple[int, ...] = ()
    place: tuple[int, ...] = ()
    cut = main = number = unread = at = 0

    def end_line(empty: bool = False) -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        for blank in ([] if not text else [text]) + [""] * empty:
            lines.append((blank, main > 0, place))
            within.append(hints)
        for hint in hints:
            hinted[hint].size += len(text)

    def close(depth: int, named: bool = False) -> None:
        """Close all elements from a place in the stack on; ``named`` if the outermost has its end tag."""
        nonlocal cut, main, hints, place
        while len(elements.stack) > depth:
            gone = elements.pop()
            cut -= gone.cut
            main -= gone.main
            if gone.hint is not None:
                hints = hints[:-1]
                # What a closing element holds is closed with it.
                hinted[gone.hint].closed = named
            place = place[:-1] if gone.container else place

    def read(text: str) -> None:
        nonlocal unread
        if cut:
            unread += len(text.strip())
        else:
            parts.append(text)

    for start, end, ending, name, attributes in tags(page):
        if start < at:
            continue  # within what was passed over
        read(page[at:start])
        at = end
        if not name:
            continue
        if ending:
            if name in BLOCKS and not cut:
                end_line()
            depth = elements.last(name)
            # An end tag does not reach beyond the main element that it stands in.
            if depth >= 0 and (name in MAIN or not elements.mains or elements.mains[-1] < depth):
                close(depth, True)
            continue
        if elements.last("head") >= 0 and name not in HEADS:
            close(elements.last("head"))
        if name in BLOCKS and not cut:
            end_line()
        if (ended := elements.ended_by(name)) >= 0:
            close(ended, True)
        if name in VOID or attributes.endswith("/"):
            continue
        part = _part_of(name, attributes)
        if part == "hint" and (cut or len(hints) >= DEEPEST):
            part = ""
        out = part == "cut" or part in ("aside", "comments") and len(hints) >= DEEPEST
        hint = not cut and not out and part != ""
        if (out or hint) and not cut:
            end_line(empty=name not in UNSEEN)
        if name in _RAW:
            found = re.compile(f"</{name}[^>]*>", re.I).search(page, at)
            at = found.end() if found else len(page)
            continue
        is_main = name in MAIN and not cut and not out
        if is_main and part != "comments" and not hint:
            for outer in hints:
                # Each comment may be an article of its own.
                if hinted[outer].kind != "comments" or name == "main":
                    hinted[outer].holds_main = True
        if hint:
            hinted.append(_Hint(part))
            hints += (len(hinted) - 1,)
        container = name in CONTAINERS and len(place) < DEEPEST
        if container:
            number += 1
            place += (number,)
        elements.push(_Element(name, out, is_main, len(hinted) - 1 if hint else None, container))
        cut += out
        main += is_main
    read(page[at:])
    end_line()
    whole = unread + sum(len(text) for text, _, _ in lines)
    gone = {number for number, hint in enumerate(hinted) if hint.is_cut(whole)}
    strict = {number for number in gone if hinted[number].kind != "hint"}
    kept = []
    for (text, inside, where), around in zip(lines, within):
        if strict.intersection(around):
            continue
        kept.append(("" if gone.intersection(around) else text, inside, where))
    return kept


def _runs(weights: list[int], sides: list[bool], least: int) -> list[tuple[int, int]]:
    """(first line, line after the last) from each surge to its dive; a run does not reach into or out of main elements."""
    runs, at = [], 0
    while at < len(weights):
        end = at
        while end < len(weights) and sides[end] == sides[at]:
            end += 1
        start = None
        for n in range(at, end + 1):
            total = sum(weights[max(at, n - WINDOW + 1) : min(end, n + WINDOW)]) if n < end else 0
            if start is None and total >= least:
                start = n
            elif start is not None and total < least:
                runs.append((start, n))
                start = None
        at = end
    return runs


def _kept(lines: list[tuple[str, bool, tuple]]) -> list[bool]:
    """Which lines lie between a surge and a dive that are kept.

    The run that weighs most is kept. Another one is kept if no break parts it from a kept one, if it stands in the same
    container or in one next to it, or if it is dense; what lies between two kept runs of one place stays with them. If the
    heaviest run is in a main element, those outside are not its text.
    """
    sizes = [len(text) for text, _, _ in lines]
    sides = [main for _, main, _ in lines]
    weights = [size * (MAIN_WEIGHT if main else 1) for size, main in zip(sizes, sides)]
    keep = [False] * len(lines)
    # On a page of short lines only, any text is a surge, if it is more than a word.
    runs = _runs(weights, sides, LEAST) or [run for run in _runs(weights, sides, 1) if any(" " in lines[n][0] for n in range(*run)) or sum(map(bool, sizes[slice(*run)])) > 1]
    if not runs:
        return keep
    mass = [sum(weights[first:last]) for first, last in runs]
    best = max(range(len(runs)), key=lambda run: (mass[run], -run))
    inside = sides[runs[best][0]]
    runs, top = [run for run in runs if sides[run[0]] or not inside], runs[best]
    places = [lines[max(range(*run), key=sizes.__getitem__)][2] for run in runs]
    best = runs.index(top)

    def near(a: tuple, b: tuple) -> bool:
        return a[: len(b)] == b or b[: len(a)] == a or a[:-1] == b[:-1]

    def dense(run: tuple[int, int]) -> bool:
        held = [size for size in sizes[slice(*run)] if size]
        return sum(held) >= DENSE * len(held)

    kept = {run for run in range(len(runs)) if run == best or near(places[run], places[best]) or dense(runs[run])}
    for step in (-1, 1):
        run = best
        while 0 <= run + step < len(runs):
            left, right = sorted((run, run + step))
            between = slice(runs[left][1], runs[right][0])
            whole = all(sizes[between])
            if whole and run in kept:
                kept.add(run + step)
            run += step
    for run in kept:
        keep[slice(*runs[run])] = [True] * (runs[run][1] - runs[run][0])
        if run + 1 in kept and (near(places[run], places[run + 1]) or all(sizes[runs[run][1] : runs[run + 1][0]])):
            for n in range(runs[run][1], runs[run + 1][0]):
                keep[n] = sides[n] or not inside
    if inside:
        # Short first and last lines of a main element are its text as well.
        for n in range(len(lines)):
            keep[n] = keep[n] or sides[n] and any(near(lines[n][2], places[run]) for run in kept)
    return keep


def main_text(page: str | None) -> str:
    """The text of one page; empty if there is none. Pages with null or empty markup have none.

    A line weighs as much as its text is long, ``MAIN_WEIGHT`` times that in a main element.
    """
    lines = lines_of((page or "").replace("\r\n", "\n"))
    return " ".join(text for (text, _, _), kept in zip(lines, _kept(lines)) if kept and text)


def extract_text(pages: DataFrame, key: str = "page_id", url: str = "url", markup: str = "html") -> DataFrame:
    """One row per row of ``pages``: (page_id, url, text, n_chars).

    Null and empty markup gives an empty text; null keys, null urls and repeated rows pass through; an empty table gives an
    empty one. Pages of any length are read whole. Columns other than those named are not read.
    """
    from pyspark.sql import functions as F

    kind = pages.schema[key].dataType.simpleString()
    both = pages.select(F.struct(F.col(key).alias("page_id"), F.col(url).alias("url")).alias("id"), F.col(markup).alias("m"))

    def rows(keys: list, texts: list) -> dict:
        made = [main_text((t or b"").decode("utf-8", "replace")) for t in texts]
        return {"id": keys, "text": made, "n_chars": list(map(len, made))}

    made = per_text(both, "id", "m", f"id struct<page_id:{kind},url:string>, text string, n_chars long", rows)
    return made.select("id.page_id", "id.url", "text", "n_chars")
