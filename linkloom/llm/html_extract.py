"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one per block element. The text lengths of ``WINDOW`` neighbouring lines are summed, links
counted at a tenth; a surge is where the sum rises to the threshold with text following, a dive where it falls below it.
The heaviest stretch between surge and dive is main text, and so is every other stretch, with the short lines between
two stretches that are not mostly links. Containers (``article``, ``main``) break ties that lengths can't: where one
holds most of the heaviest stretch, that stretch reaches to its ends, since short first and last paragraphs lie below any
threshold, and stretches outside of it stay only if they are at least half as heavy.

Which elements give lines: menus, footers, asides, controls and hidden elements give none. Elements named as boilerplate
by words of their class, id or role, and forms, are judged by their lines. A ``STRONG`` word cuts, unless the element
holds an unmarked container or, where no container stands elsewhere, most of the page's text (it is a wrapper then). A ``WEAK`` word cuts where the element is
short or mostly links, or stands outside the container of the page. Reader comments are cut whatever their length.

Elements end as HTML ends them: at their tag, with their parent, and where a sibling implies it (p, li, dt, dd, option,
table parts). What never closes ends at the next ``article`` or ``main``, if it would be cut.

Defined cases: null, empty and text-free pages give an empty text; ``<`` that opens no tag is text; white space inside a
block, no-break spaces included, becomes one space; whole pages are read, whatever their length; repeated rows give equal
results; null ids stay null and ids keep all digits; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from heapq import heappop, heappush
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.arrow import map_text

WINDOW, SURGE = 3, 60
#: Weight of a window, and share of links in it, from which an element with a weak word is prose.
PROSE, LINKED = 180, 0.25
#: Elements whose content is no text, and elements that are never part of an article.
RAW = frozenset("script style noscript template textarea title iframe svg object math".split())
DROPPED = frozenset("head nav footer aside button select dialog menu audio video canvas".split())
INLINE = frozenset(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset(("article", "main"))
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section summary table ul".split()
)
#: element -> (elements it ends, elements beyond which it ends none)
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("tbody",), ("table",)), "tfoot": (("thead", "tbody"), ("table",)),
}
#: Ends of elements don't look beyond these.
BORDERS = frozenset("table td th caption html".split())
TABLE = frozenset("table thead tbody tfoot tr td th caption html".split())
COMMENTS = frozenset("comment comments commentlist disqus respond".split())
#: Words of a class, id or role that mark boilerplate.
STRONG = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs complementary contentinfo cookie cookies consent footer gdpr masthead menu modal nav navbar "
    "navigation newsletter pagination pager popup promo promoted sidebar sponsor sponsored form".split()
)
WEAK = frozenset("banner header notice notices notification recommended related search share sharing signup social subscribe toolbar widget".split())
_TAG = re.compile(r"""<!--|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([^>]*)>)""")
_MARKED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
TEXT, OPEN, CLOSE = range(3)


def _words(attributes: str) -> set[str]:
    found = [a or b or c for a, b, c in _MARKED.findall(attributes)]
    return {w.lower() for x in found for w in _WORD.findall(x)}


def _tokens(page: str) -> list[tuple[int, str, str]]:
    """(TEXT, '', text), (OPEN, tag, attributes) and (CLOSE, tag, '') in page order; raw elements leave nothing."""
    out: list[tuple[int, str, str]] = []
    pos, stop = 0, page.rfind(">") + 1
    while pos < len(page):
        m = _TAG.search(page, pos, stop)
        if m is None:
            out.append((TEXT, "", page[pos:]))
            break
        if m.start() > pos:
            out.append((TEXT, "", page[pos : m.start()]))
        pos = m.end()
        if m[0] == "<!--":
            end = page.find("-->", pos)
            pos = end + 3 if end >= 0 else len(page)
        elif m[2]:
            tag, attributes = m[2].lower(), m[3] if m[3] is not None else m[4]
            if m[1]:
                out.append((CLOSE, tag, ""))
            elif tag in RAW:
                if not attributes.endswith("/"):
                    end = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
                    pos = end.end() if end else len(page)
            else:
                out.append((OPEN, tag, attributes))
    return out


def _ends(tokens: list[tuple[int, str, str]]) -> dict[int, tuple[int, bool]]:
    """open token -> (token at which the element ends, whether by its own tag)."""
    ends: dict[int, tuple[int, bool]] = {}
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()

    def close_from(depth: int, at: int, own: bool) -> None:
        for k in range(len(stack) - 1, depth - 1, -1):
            ends[stack[k][1]] = (at, own and k == depth)
            open_[stack[k][0]] -= 1
        del stack[depth:]

    def close_one(k: int, at: int, own: bool) -> None:
        """Ends an inline element; what it contains stays open."""
        ends[stack[k][1]] = (at, own)
        open_[stack[k][0]] -= 1
        del stack[k]

    def find(names: tuple[str, ...], borders: frozenset | tuple) -> int:
        if not any(open_[n] for n in names):
            return -1
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in borders:
                return -1
        return -1

    for i, (kind, tag, _) in enumerate(tokens):
        if kind == OPEN:
            if tag in ENDS_P and (k := find(("p",), BORDERS)) >= 0:
                close_from(k, i, False)
            if tag in SIBLINGS and (k := find(*SIBLINGS[tag])) >= 0:
                close_from(k, i, False)
            if tag == "a" and (k := find(("a",), BORDERS)) >= 0:
                close_one(k, i, False)
            if tag not in VOID:
                stack.append((tag, i))
                open_[tag] += 1
        elif kind == CLOSE and (k := find((tag,), () if tag in TABLE else BORDERS)) >= 0:
            if tag in INLINE:
                close_one(k, i, True)
            else:
                close_from(k, i, True)
    close_from(0, len(tokens), False)
    return ends


def to_lines(page: str) -> list[tuple[str, int, int]]:
    """(text, characters of links in it, container or -1) of every line, in page order, boilerplate elements cut."""
    tokens = _tokens(page)
    ends = _ends(tokens)
    lines: list[tuple[str, int, int]] = []
    groups: list[list] = []  # kind, whether it holds an unmarked container, whether within one, its first line, the line behind its last
    text: list[str] = []
    inside: list[tuple[int, int]] = []  # (end, group) of the judged elements that are open, as a heap
    held: list[tuple[int, int]] = []  # (container, end)
    links: list[int] = []
    linked = containers = 0
    skip = -1
    plain = [i for i, (kind, tag, a) in enumerate(tokens) if kind == OPEN and tag in CONTAINERS and not _words(a) & (STRONG | COMMENTS)]

    def flush() -> None:
        nonlocal text, linked
        line = " ".join("".join(text).split())
        if line:
            lines.append((line, linked, held[-1][0] if held else -1))
        text, linked = [], 0

    def first_plain(start: int, end: int) -> int | None:
        at = bisect_right(plain, start)
        return plain[at] if at < len(plain) and plain[at] < end else None

    for i, (kind, tag, what) in enumerate(tokens):
        if inside and inside[0][0] <= i or held and held[-1][1] <= i:
            flush()
            while inside and inside[0][0] <= i:
                groups[heappop(inside)[1]][4] = len(lines)
            while held and held[-1][1] <= i:
                held.pop()
        if i < skip:
            continue
        if kind == TEXT:
            piece = html.unescape(what)
            text.append(piece)
            links = [e for e in links if e > i]
            linked += len(piece) if links else 0
            continue
        if tag not in INLINE:
            flush()
        if kind == CLOSE:
            continue
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            continue
        end, own = ends[i]
        marks = _words(what) if what else set()
        comments = bool(marks & COMMENTS) and tag not in ("html", "body", "main")
        inner = first_plain(i, end)
        if not own and inner is not None and not comments:
            end = inner
        if tag in DROPPED or (tag == "header" and not held) or (what and _HIDDEN.search(what)):
            flush()
            skip = end
            continue
        if tag == "a":
            links.append(end)
        if tag in ("html", "body", "main"):
            marks = set()
        if comments or tag == "form" or marks & (STRONG | WEAK):
            if not (tag == "header" and held):
                flush()
                kind_ = "comments" if comments else "strong" if tag == "form" or marks & STRONG else "weak"
                heappush(inside, (end, len(groups)))
                groups.append([kind_, inner is not None and inner < end, bool(held), len(lines), None])
        if tag in CONTAINERS:
            containers += 1
            held.append((held[-1][0] if held else containers, ends[i][0]))
    flush()
    gone = _cut(lines, groups)
    return [x for x, g in zip(lines, gone, strict=True) if not g]


def _weight(text: str, linked: int) -> float:
    return len(text) - min(len(text), linked) * 0.9


def _covered(n: int, spans: list[tuple[int, int]]) -> list[bool]:
    """Which of ``n`` lines lie in one of the spans."""
    steps = [0] * (n + 1)
    for a, b in spans:
        steps[a] += 1
        steps[b] -= 1
    return [depth > 0 for depth in accumulate(steps[:n])]


def _cut(lines: list[tuple[str, int, int]], groups: list[list]) -> list[bool]:
    """Whether a line goes with a judged element that is cut. An element's lines are a run, so sums come from running totals."""
    weights = [_weight(t, n) for t, n, _ in lines]
    weight, chars, links = (list(accumulate(x, initial=0)) for x in (weights, [len(t) for t, _, _ in lines], [min(n, len(t)) for t, n, _ in lines]))
    window = [weight[min(len(lines), i + WINDOW)] - weight[i] for i in range(len(lines))]
    spans = [(a, len(lines) if b is None else b) for *_, a, b in groups]
    comments = _covered(len(lines), [x for x, g in zip(spans, groups, strict=True) if g[0] == "comments"])
    some = any(c >= 0 and not hidden for (_, _, c), hidden in zip(lines, comments, strict=True))
    cut = []
    for (a, b), (kind, wraps, within, *_) in zip(spans, groups, strict=True):
        own = weight[b] - weight[a]
        density = (links[b] - links[a]) / (chars[b] - chars[a]) if chars[b] > chars[a] else 0.0
        if wraps or (kind != "comments" and (within or not some) and 2 * own > weight[-1] and density < 0.5):
            continue
        best = max(window[a : b - WINDOW + 1]) if b - a >= WINDOW else own
        if kind == "weak" and (within or not some) and best >= PROSE and density < LINKED:
            continue
        cut.append((a, b))
    return _covered(len(lines), cut)


def stretches(weight: list[float], window: int = WINDOW, surge: int = SURGE) -> list[tuple[int, int]]:
    """Start and end of every run of lines between surge and dive, in page order."""
    sums = [sum(weight[i : i + window]) for i in range(len(weight))]
    found, start = [], None
    for i in range(len(weight) + 1):
        high = i < len(weight) and sums[i] >= surge
        if high and start is None:
            start = i
        elif not high and start is not None:
            end = min(len(weight), i + window - 1)
            while end > i and weight[end - 1] < surge / window:
                end -= 1
            first = start
            while first < i and weight[first] < surge / window:
                first += 1
            found.append((first, end))
            start = None
    return found


def kept_lines(lines: list[tuple[str, int, int]]) -> list[int]:
    """The lines of the main text: all stretches and what lies between them, with the ends that a container gives."""
    weight = [_weight(t, n) for t, n, _ in lines]
    heavy = lambda a, b: sum(weight[a:b])
    found = [(a, b) for a, b in stretches(weight) if heavy(a, b) > 0]
    if not found:  # no surge anywhere: short pages are what their container holds, or all lines
        held = [i for i in range(len(lines)) if lines[i][2] >= 0]
        return held or list(range(len(lines)))
    first, end = max(found, key=lambda x: heavy(*x))
    if sum(weight[i] for i in range(first, end) if lines[i][2] >= 0) < 0.5 * heavy(first, end):
        within = {i for a, b in found for i in range(a, b)}
        return [i for i in range(found[0][0], found[-1][1]) if i in within or 2 * lines[i][1] <= len(lines[i][0])]
    inside = {lines[i][2] for a, b in found for i in range(a, b) if lines[i][2] >= 0}
    kept = {i for i, x in enumerate(lines) if x[2] in inside}
    for a, b in found:
        free = [i for i in range(a, b) if lines[i][2] < 0]
        if 2 * sum(weight[i] for i in free) >= heavy(first, end):
            kept.update(free)
    return sorted(kept)


def main_text(page: str | None) -> str:
    lines = to_lines(page or "")
    return "\n".join(lines[i][0] for i in kept_lines(lines))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row; a task holds one slice of a batch."""

    def run(htmls: list[str | None]) -> list[list]:
        text = [main_text(x) for x in htmls]
        return [text, [len(t) for t in text]]

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return map_text(rows, "html", [("text", "string"), ("n_chars", "bigint")], run)
