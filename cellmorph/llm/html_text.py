"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block element. A line's weight is the length of its text outside links; it is
zero where most of the text is in links, in elements that are no content (navigation, footers, scripts and the like),
in blocks whose class, id or role says so (unless such a block holds half of the page's weight and all of its articles:
then the word meant something else), and, where `article` or `main` elements hold most of the weight, outside of these. Weights are summed
over sliding windows of lines: text begins where a window surges, at a weighing line and the headings before it, and
ends at the dive where a whole window has no weight. All between a surge and its dive is kept, lines of links among
text too, but no lines of elements that are no content; three lines of links are a dive. Outside of articles a stretch
must also hold a window of SURGE characters or a sentence (a page without any keeps its heaviest stretch).

End tags may be missing: `p`, `li`, `dt`, `dd`, `td`, `th`, `tr` and `option` end where HTML lets them end. A page is
read once, in linear time, whatever its length; nothing is cut off.

Defined results: a null or empty page, or one without text, has the empty string; repeated rows and null ids are kept
as they are; an empty table gives no rows; columns other than page_id, url and html are ignored, whatever their names;
stretches of equal weight are both kept or both dropped, but of a page's heaviest ones the first is.
"""

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Lines summed in a window.
WINDOW = 3
#: Characters of a window that make a stretch outside of articles text, where it holds no sentence.
SURGE = 80
#: A line with more of its text than this in links is a menu.
LINKED = 0.7

# Element names and class or id words.
RAW = frozenset("script style noscript template iframe object svg canvas audio video textarea select title xmp noembed noframes".split())
SKIP = frozenset("nav footer aside button menu dialog fieldset label head".split())
#: No content unless they hold half of the page, or, for a header in an article, its heading.
SUSPECT = frozenset("header form".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
ADVERT = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted".split())
NOISE = ADVERT | frozenset(
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead topbar toolbar comment comments disqus replies respond cookie cookies consent gdpr notice notices "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget pagination pager copyright".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: What an opening tag ends besides an open p: elements of this kind up to the element that holds them.
ENDS = {"li": "item", "dt": "term", "dd": "term", "td": "cell", "th": "cell", "tr": "row", "tbody": "row", "thead": "row", "tfoot": "row", "option": "option", "optgroup": "option"}
KINDS = {"p": "p", "li": "item", "dt": "term", "dd": "term", "td": "cell", "th": "cell", "tr": "row", "option": "option"}
#: Kinds that can still be ended from inside an element: all from inline ones, some from these.
THROUGH = {"div": {"item", "term", "cell", "row"}, "p": {"item", "term", "cell", "row"}, "address": {"item", "term", "cell", "row"}, "table": set(), "ul": {"cell", "row"}, "ol": {"cell", "row"}, "dl": {"cell", "row"}}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/><]*+)", re.S)
_PLAIN = re.compile(r"(?:[^<>=]++|=(?!\s*+[\"']))*+")
_VALUE = re.compile(r"=\s*+([\"'])")
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>"']++))?""")
_PART = re.compile(r"[A-Za-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


class Line(NamedTuple):
    text: str
    weight: int
    blocked: bool  # in an element that is no content
    suspect: int  # number of the innermost open block that may be none, or -1
    framed: bool  # in an article or main element
    heading: bool


class Open(NamedTuple):
    """An open block element, or an inline one that is no content, with what holds inside it."""

    name: str
    blocked: bool
    suspect: int
    header: int  # number of the innermost header in an article, or -1
    framed: bool
    ends: dict  # kind: place on the stack of the element that an opening tag would end


def _verdict(name: str, attrs: str) -> str:
    """`blocked`, `suspect` or nothing, by an element's name and its hidden, role, class and id attributes."""
    if name in SKIP:
        return "blocked"
    found = "suspect" if name in SUSPECT else ""
    if not attrs or name in ("html", "body", "article", "main") or name in INLINE and name not in ("span", "a"):
        return found
    words = ADVERT if name in INLINE else NOISE
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", "") or key == "role" and value in NOISE_ROLES:
            return "blocked"
        if key in ("class", "id") and not words.isdisjoint(_PART.findall(value)):
            found = "blocked" if name in INLINE else "suspect"
    return found


class Page:
    """A page's lines; for each suspect block (number) the one around it, and whether it is an article's header with a
    heading (1) or a menu (-1)."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.around: list[int] = []
        self.titled: list[int] = []
        self._text: list[str] = []
        self._linked: list[str] = []
        self._heading = False
        self._stack = [Open("", False, -1, -1, False, {})]
        self._count: dict[str, int] = {}
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        line = " ".join(html.unescape("".join(self._text)).split())
        if line:
            top = self._stack[-1]
            linked = len(" ".join(html.unescape("".join(self._linked)).split()))
            self.lines.append(Line(line, 0 if linked > LINKED * len(line) else len(line) - linked, top.blocked, top.suspect, top.framed, self._heading))
        self._text.clear()
        self._linked.clear()

    def _pop(self, to: int) -> None:
        """Closes all elements from place `to` on."""
        for x in self._stack[to:]:
            self._count[x.name] -= 1
        del self._stack[to:]

    def _push(self, name: str, attrs: str) -> None:
        top, inline = self._stack[-1], name in INLINE
        what = _verdict(name, attrs)
        if inline and what != "blocked":
            return
        suspect, header = top.suspect, top.header
        if what == "suspect":
            self.around.append(suspect)
            self.titled.append(0)
            suspect = len(self.around) - 1
            if name == "header" and top.framed:
                header = suspect
        if header >= 0 and (name == "nav" or name in HEADING and not self.titled[header]):
            self.titled[header] = -1 if name == "nav" else 1
        ends = dict(top.ends) if inline else {k: v for k, v in top.ends.items() if k in THROUGH.get(name, ("cell", "row"))}
        if name in KINDS:
            ends[KINDS[name]] = len(self._stack)
        self._stack.append(Open(name, top.blocked or what == "blocked", suspect, header, top.framed or name in ("article", "main"), ends))
        self._count[name] = self._count.get(name, 0) + 1

    def _tag(self, closing: str, name: str, attrs: str) -> None:
        if name == "br":
            self._text.append(" ")
            return
        if name not in INLINE:
            self._flush()
            self._heading = name in HEADING and not closing
        if closing:
            if self._count.get(name):
                at = len(self._stack) - 1
                while self._stack[at].name != name:
                    at -= 1
                self._pop(at)
        elif name not in VOID:
            if name not in INLINE:
                for kind in ("p", ENDS.get(name)):
                    if kind in self._stack[-1].ends:
                        self._pop(self._stack[-1].ends[kind])
            if not attrs.endswith("/"):
                self._push(name, attrs)

    def _read(self, page: str) -> None:
        at, n, in_link, unquoted = 0, len(page), False, set()
        while at < n:
            tag = _TAG.search(page, at)
            end = tag.start() if tag else n
            literal = None
            if tag:
                stop = tag.end()
                if tag[2] is not None:
                    stop, closed = _rest(page, stop, unquoted)
                    literal = None if closed else page[end:stop]
            if not self._stack[-1].blocked or self._stack[-1].name not in INLINE:
                for piece in (page[at:end], literal):
                    if piece:
                        self._text.append(piece)
                        if in_link:
                            self._linked.append(piece)
            if not tag:
                break
            at = stop
            if tag[2] is None or literal is not None:
                continue
            closing, name, attrs = tag[1], tag[2].lower(), page[tag.end() : stop - 1]
            if name in RAW:
                if not closing and not attrs.endswith("/"):
                    over = _RAW_END[name].search(page, at)
                    at = n if over is None else over.start()
                continue
            if name == "a":
                in_link = not closing
            self._tag(closing, name, attrs)


def _rest(page: str, at: int, unquoted: set) -> tuple[int, bool]:
    """(place after a tag that has been read up to `at`, whether it is one): a value quoted after = may hold anything."""
    while True:
        at = _PLAIN.match(page, at).end()
        if at == len(page) or page[at] == "<":
            return at, False
        if page[at] == ">":
            return at + 1, True
        quote = _VALUE.match(page, at)
        over = -1 if quote[1] in unquoted else page.find(quote[1], quote.end())
        if over < 0:  # none follows to the page's end: the mark is a character like others
            unquoted.add(quote[1])
        at = quote.end() if over < 0 else over + 1


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """[start, end) between each surge and the dive after it."""
    n, found, start = len(weights), [], None
    total = sum(weights[:window])
    for i in range(n):
        if start is None and weights[i] > 0:
            start = i
        elif start is not None and total == 0:
            found.append((start, i))
            start = None
        total += (weights[i + window] if i + window < n else 0) - weights[i]
    if start is not None:
        while weights[n - 1] == 0:
            n -= 1
        found.append((start, n))
    return found


def sentence(text: str) -> bool:
    """Whether a line has three words and ends as sentences do."""
    return text.rstrip("\"'”’)»").endswith(tuple(".!?…。！？؟")) and len(text.split(None, 2)) == 3


def weights(page: Page) -> tuple[list[bool], list[int], bool]:
    """(whether each line may be content, its weight, whether articles hold most of the page's weight)."""
    lines = page.lines
    total, framed, held, own = 0, 0, [0] * len(page.around), [0] * len(page.around)
    for x in lines:
        if not x.blocked:
            total += x.weight
            framed += x.framed * x.weight
            if x.suspect >= 0:
                held[x.suspect] += x.weight
                own[x.suspect] += x.framed * x.weight
    for k in reversed(range(len(held))):  # inner blocks have higher numbers
        if (up := page.around[k]) >= 0:
            held[up] += held[k]
            own[up] += own[k]
    noise: list[bool] = []
    for w, f, titled, up in zip(held, own, page.titled, page.around, strict=True):
        # A block with half of the weight holds the page, if it holds all that is in articles.
        noise.append(up >= 0 and noise[up] or titled != 1 and (2 * w < total or f < framed))
    live = [not x.blocked and (x.suspect < 0 or not noise[x.suspect]) for x in lines]
    framed = sum(len(x.text) for x, ok in zip(lines, live, strict=True) if ok and x.framed)
    marked = framed > sum(x.weight for x, ok in zip(lines, live, strict=True) if ok and not x.framed)
    live = [ok and (x.framed or not marked) for x, ok in zip(lines, live, strict=True)]
    return live, [x.weight if ok else 0 for x, ok in zip(lines, live, strict=True)], marked


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The kept lines of the page's stretches, joined by an empty line."""
    read = Page(page or "")
    live, w, marked = weights(read)
    spans = stretches(w, window)
    if not marked:

        def strong(a, b):
            return any(sentence(read.lines[i].text) for i in range(a, b) if w[i]) or any(sum(w[i : min(b, i + window)]) >= SURGE for i in range(a, b))

        spans = [s for s in spans if strong(*s)] or [max(spans, key=lambda s: sum(w[s[0] : s[1]]))] if spans else []
    kept: list[str] = []
    last = 0
    for a, b in spans:
        while a > last and live[a - 1] and read.lines[a - 1].heading:
            a -= 1
        kept += [read.lines[i].text for i in range(a, b) if live[i]]
        last = b
    return "\n\n".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every whole page."""

    def task(batches):
        for batch in slices(batches):
            found = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(task, "page_id long, url string, text string, n_chars long")


def op10_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
