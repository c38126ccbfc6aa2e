"""Operator 9: main text of HTML pages by line-block distribution.

Markup is read by the states of the HTML syntax (quotes open a value only behind ``=``) and
stripped into lines, one for each block-level element's run of text; a start tag closes what it
ends by rule, such as an open paragraph. Elements that never hold an article's text (scripts,
controls, menus, footers ...) are left out by name. A line counts its characters outside links, by their
share in it; lines in article and main elements count ``INSIDE`` times.

Marks (words of class, id and role) only weigh: a container marked as no part of the article is
left out unless it holds a heading of the page or an article, and most of the page's weight, as
a wrapper does; lines in containers of a doubtful mark count the share ``DOUBT``, and their block stays
only if it surges by itself.

The article's container is the innermost one that holds ``MOST`` of the page's weight. Over its
lines, text lengths are summed in sliding windows: it must surge somewhere, and all that the
container holds belongs to the article, but for lines of links at its edges that have containers of their own (in a container that is no
article or main element, for all lines of links at its edges). Where no container below the body
holds that much, the article begins where the sums surge and ends where they dive for good, with
the lines beside it in the same container. All pages take this way.

Defined results: null or empty HTML gives an empty text; unclosed tags end with their parent;
a page whose lines never surge (all are short) gives the lines around its longest one, the first
of equals; repeated rows are extracted alike; an empty table gives no rows; other columns are
not read. Time is linear in the page, however tags are left open.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements by what they do to lines.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul br caption search".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
DROPPED = frozenset("head script style textarea title noscript iframe xmp noembed noframes template nav footer aside button select option input label legend svg math canvas object embed audio video map menu dialog datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Elements whose lines are beside each other.
HOMES = frozenset("html body div section article main td th form center header details figure dialog fieldset".split())
#: Words of class, id or role that mark a container as no part of the article.
UNWANTED = frozenset("ad ads adv advert advertisement adverts adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus dropdown footer gdpr masthead menu modal nav navbar navigation newsletter pagination popup replies reply respond sidebar signup sponsor sponsored subscribe subscription complementary contentinfo dialog".split())
#: Those of them that an article element can be marked with.
ANSWERS = frozenset("comment comments replies reply respond".split())
#: Words of containers that may hold an article's section all the same.
DOUBTFUL = frozenset("alert copyright notice notification overlay paywall promo promoted promotion recommended related search share sharing skip social teaser toolbar topbar widget widgets".split())
INSIDE, DOUBT, MOST = 4.0, 0.3, 0.6

_ATTRIBUTES = r"(?:[\s/]++|[^\s/>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>\"'][^\s>]*+|))*+"
_TAG = re.compile(rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRIBUTES})(?:>|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)|'([^']*+)|([^\s>\"'][^\s>]*+)))?")
_NAMED = re.compile("class|id|role", re.I)
_CLOSED = re.compile(r"(?:^|[\s\"'])/$")
_WORD = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")
_ENDS: dict[str, re.Pattern] = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in RAW}
#: An element of this kind ends an open one of those, but not beyond one of the limits.
_PARAGRAPH = (("p",), ("button", "td", "th", "caption", "object"))
CLOSES = {n: _PARAGRAPH for n in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split()}
CLOSES |= {"li": (("li", "p"), ("ul", "ol", "menu", "td", "th")), "dt": (("dt", "dd", "p"), ("dl", "td", "th")), "dd": (("dt", "dd", "p"), ("dl", "td", "th"))}
CLOSES |= {"tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "option": (("option",), ("select",))}


class Line:
    """A block's text: characters outside and inside links, weight of its place, its container, the doubtful and the unwanted block it is in (0: none)."""

    __slots__ = ("text", "plain", "linked", "factor", "home", "doubt", "mark", "heading")

    def __init__(self, text: str, plain: int, linked: int, factor: float, home: int, doubt: int, mark: int, heading: bool):
        self.text, self.plain, self.linked, self.factor, self.home, self.doubt, self.mark, self.heading = text, plain, linked, factor, home, doubt, mark, heading

    @property
    def weight(self) -> float:
        """The plain characters, by their share in the line."""
        return self.factor * self.plain * self.plain / max(1, self.plain + self.linked)


def _marks(attributes: str) -> set[str]:
    found = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id", "role"):
            value = m[2] or m[3] or m[4] or ""
            found.update(_WORD.findall(re.sub("([a-z])([A-Z])", r"\1 \2", value).lower()))
    return found


class Places:
    """Containers: ``parent`` of each, article and main elements, those at the top; ``outer`` marked one of each marked one, and those that hold a heading of the page or an article."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.name: dict[int, str] = {}
        self.articles: set[int] = set()
        self.tops: set[int] = {0}
        self.outer: dict[int, int] = {}
        self.bearing: set[int] = set()

    def bear(self, mark: int) -> None:
        while mark and mark not in self.bearing:
            self.bearing.add(mark)
            mark = self.outer[mark]


_ROOT = ("", False, 1.0, 0, 0, 0)


class _Stack:
    """Open elements: name, dropped, factor, home, doubtful block, unwanted block."""

    def __init__(self):
        self.open: list[tuple[str, bool, float, int, int, int]] = []
        self.at: dict[str, list[int]] = defaultdict(list)  # name -> places in the stack
        self.top = _ROOT

    def push(self, name: str, *state) -> None:
        self.at[name].append(len(self.open))
        self.open.append((name, *state))
        self.top = self.open[-1]

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def cut(self, place: int) -> list[str]:
        """Closes all from a place on."""
        gone = [x[0] for x in self.open[place:]]
        for name in gone:
            self.at[name].pop()
        del self.open[place:]
        self.top = self.open[-1] if self.open else _ROOT
        return gone


def lines(page: str) -> tuple[list[Line], Places]:
    """The lines of a page, without those in dropped elements, and its containers."""
    out: list[Line] = []
    places = Places()
    stack = _Stack()
    parts: list[tuple[str, bool]] = []
    number = 0

    def flush() -> None:
        nonlocal parts
        if parts:
            text = _BLANK.sub(" ", html.unescape("".join([t for t, _ in parts]))).strip()
            if text:
                linked = sum(len(_BLANK.sub(" ", t).strip()) for t, a in parts if a)
                _, _, factor, home, doubt, mark = stack.top
                out.append(Line(text, max(0, len(text) - linked), linked, factor, home, doubt, mark, stack.last(HEADINGS) >= 0))
            parts = []

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        begin = m.start() if m else n
        if begin > at and not stack.top[1]:
            parts.append((page[at:begin], bool(stack.at["a"])))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag closes what it names, and what was left open inside
            if stack.at.get(name):
                place = stack.at[name][-1]
                if name in BLOCKS or any(x[0] in BLOCKS or x[1] for x in stack.open[place:]):
                    flush()
                stack.cut(place)
            elif name in BLOCKS:
                flush()
            continue
        if name in BLOCKS:
            flush()
        if name in CLOSES:
            ended, limits = CLOSES[name]
            place = min((stack.at[e][-1] for e in ended if stack.at.get(e) and stack.at[e][-1] > stack.last(limits)), default=-1)
            if place >= 0:
                stack.cut(place)
        if name in RAW:  # no markup inside
            end = _ENDS[name].search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or _CLOSED.search(m[3]):
            continue
        _, dropped, factor, home, doubt, mark = stack.top
        marks = _marks(m[3]) if m[3] and name not in ("html", "body") and _NAMED.search(m[3]) else ()
        number += 1
        article = name in ("article", "main")
        bad = name in DROPPED or (name == "header" and not (stack.at["article"] or stack.at["main"]))
        unwanted = bool(marks) and not (ANSWERS if article else UNWANTED).isdisjoint(marks)
        if (bad or unwanted) and name not in BLOCKS:
            flush()
        if name == "h1" or article and not unwanted:
            places.bear(mark)
        if unwanted:
            places.outer[number] = mark
            mark = number
        if article:
            factor, doubt = INSIDE, 0
        elif name == "form" or (marks and not DOUBTFUL.isdisjoint(marks)):
            factor, doubt = factor * DOUBT, number
        if name in HOMES:
            places.parent[number], places.name[number] = home, name
            home = number
            if article:
                places.articles.add(number)
            elif name in ("html", "body"):
                places.tops.add(number)
        stack.push(name, dropped or bad, factor, home, doubt, mark)
    flush()
    return out, places


def wanted(found: list[Line], places: Places) -> list[Line]:
    """Without the lines of unwanted containers, but for wrappers: those that bear the page's heading or an article, and most of its weight."""
    sums: dict[int, float] = defaultdict(float)
    for x in found:
        sums[x.mark] += x.weight
    total = sum(sums.values())
    for m in sorted(places.outer, reverse=True):  # inner ones have greater numbers
        sums[places.outer[m]] += sums[m]
    stays = {0}
    for m, outer in sorted(places.outer.items()):
        if outer in stays and m in places.bearing and 2 * sums[m] > total:
            stays.add(m)
    return [x for x in found if x.mark in stays]


def surging(found: list[Line], surge: int = 80) -> list[Line]:
    """Without the blocks of a doubtful name that do not surge by themselves."""
    sums: dict[int, float] = defaultdict(float)
    for x in found:
        sums[x.doubt] += x.weight
    return [x for x in found if not x.doubt or sums[x.doubt] >= surge]


def bounds(found: list[Line], window: int = 3, surge: int = 80, dive: int = 25) -> tuple[int, int]:
    """First line and end of the article: from the surge of the window sums to their last dive.

    Window k sums the weights of lines k to k + window - 1. It surges if its sum reaches
    ``surge`` and its first line counts; it has dived if it sums to ``dive`` at most. Of all
    stretches between a surge and the next dive those in the largest one's container, and those with a quarter of its sum
    at least, are the article, with what is between them (a picture or a list may split it).
    """
    weight = [x.weight for x in found]
    n = len(found)
    total = [0.0]
    for w in weight:
        total.append(total[-1] + w)
    sums = [total[min(n, k + window)] - total[k] for k in range(n)]
    runs, k = [], 0
    while k < n:
        if sums[k] >= surge and weight[k] > 0:
            begin = k
            while k < n and sums[k] > dive:
                k += 1
            end = k
            while end > begin + 1 and weight[end - 1] == 0:
                end -= 1
            runs.append((total[end] - total[begin], begin, end))
        k += 1
    if not runs:
        best = max(range(n), key=lambda i: (weight[i], -i), default=0)
        if not n or weight[best] == 0:
            return 0, n
        begin, end = best, best + 1
    else:
        most, at, _ = max(runs, key=lambda r: (r[0], -r[1]))
        kept = [r for r in runs if r[0] >= most / 4 or found[r[1]].home == found[at].home]
        begin, end = kept[0][1], kept[-1][2]
    return _beside(found, weight, begin, end)


def _beside(found: list[Line], weight: list[float], begin: int, end: int, links: int = 3) -> tuple[int, int]:
    """The range with the lines next to it in the same container, up to a list of ``links`` lines of links, and the heading above."""
    last = end - 1
    i = end
    while i < len(found) and found[i].home == found[last].home and i - end < links:
        i += 1
        if weight[i - 1] > 0:
            end = i
    first, i = begin, begin - 1
    while i >= 0 and found[i].home == found[first].home and begin - i <= links:
        if weight[i] > 0:
            begin = i
        i -= 1
    while begin > 0 and found[begin - 1].heading and found[begin - 1].linked == 0 and found[begin - 1].plain > 0 and not found[begin].heading:
        begin -= 1
    return begin, end


def container(found: list[Line], places: Places) -> int:
    """The innermost container that holds ``MOST`` of the weight, with those beside it of the same element that begin with a heading; 0: none, or only the page's body."""
    sums: dict[int, float] = defaultdict(float)
    for x in found:
        sums[x.home] += x.weight
    total = sum(sums.values())
    if not total:
        return 0
    inner = sorted(places.parent, reverse=True)  # inner containers have greater numbers
    home = 0
    for number in inner:
        if sums[number] >= MOST * total:
            home = number
            break
        sums[places.parent[number]] += sums[number]
    headed: dict[int, set[tuple[int, str]]] = defaultdict(set)  # parent -> its children that begin with a heading
    first: dict[int, bool] = {}
    for x in found:
        at = x.home
        while at and at not in first:
            first[at] = x.heading
            if x.heading:
                headed[places.parent[at]].add((at, places.name[at]))
            at = places.parent[at]
    while home and home not in places.articles and (up := places.parent[home]) not in places.tops and any(k != home and n == places.name[home] for k, n in headed[up]):
        home = up
    return 0 if home in places.tops else home


def _within(found: list[Line], places: Places, home: int) -> tuple[int, int]:
    """First line and end of a container's lines, without lines of links at its edges."""
    inside = {home}
    for number, parent in sorted(places.parent.items()):
        if parent in inside:
            inside.add(number)
    own = [i for i, x in enumerate(found) if x.home in inside]
    article = home in places.articles
    held = [i for i in own if found[i].weight > 0 or article and found[i].home == home]
    return (held[0], held[-1] + 1) if held else (0, 0)


def main_text(page: str | None, surge: int = 80) -> str:
    """The article's blocks, joined by line feeds."""
    found, places = lines(page or "")
    found = surging(wanted(found, places), surge)
    home = container(found, places)
    begin, end = bounds(found, surge=surge)
    if home and any(x.home == home or x.weight > 0 for x in found[begin:end]):
        first, last = _within(found, places, home)
        if first <= begin < last or first < end <= last or begin <= first < end:  # the surge is there
            begin, end = first, last
    return "\n".join([x.text for x in found[begin:end]])


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text, n_chars of every row."""
    kinds = f"`{key}` {pages.schema[key].dataType.simpleString()}, `{url}` {pages.schema[url].dataType.simpleString()}"

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[key, url, "text", "n_chars"])

    return pages.select(key, url, page).mapInArrow(run, f"{kinds}, text string, n_chars long")
