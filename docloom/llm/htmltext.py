"""Main text of web pages by tag-path ratios.

A page is cut into blocks at block-level tags; the tag path of a block is the chain of block-level elements above it, each with
its class and id. For every path the text length and the punctuation of its blocks are added up (text in links doesn't count). The two ratios of
text to path are smoothed over the path's container (the marked article, else the element above) and fused by a product. Paths at or above
a share of the best fused ratio are content, and open their containers: a marked article then counts with all paths below it, another container with
the headings, paragraphs, lists and tables directly in it, so that short blocks stay beside long paragraphs; there, and where they are named, paths that
are mostly links need a ratio of their own.

Marks are evidence beside the ratios, and weigh less the more text there is to go by: a path outside the article where a page marks one, and a path
with an element whose class or id names an advert, a menu or the like, have their ratio multiplied by WEIGHT to the power of
1 + REACH / the page's text. On a page with some thousands of characters that is little, so ratios choose; where the article is one line and an advert as
long, marks do. Only elements named as text of its own, such as readers' comments, notices and sidebars, which ratios can't tell from an article,
are multiplied by LEAST_WEIGHT.
Kinds that never hold article text (scripts, forms, navigation, headers, footers and asides, hidden elements) count zero. A word on an
element around the page's only articles doesn't weigh on them. If no ratio is above zero, the marked article counts as it is.

The scanner reads a page once: a tag that never ends ends the page, and after one whose quotes never close, quotes are read as plain characters.

Defined cases: a null or empty html has no text; broken markup, unclosed elements and truncated pages are read as far as they go;
repeated pages get the same text; pages of any length and depth are read whole in time that grows with their length; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import by_parts

# HTML element kinds and the words by which sites name what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
NO_TEXT = frozenset("script style noscript template head title svg math iframe object canvas select option button textarea form nav header footer aside menu dialog audio video map datalist".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
MAIN = frozenset("article main".split())
HEADED = frozenset("article main section".split())
OFF_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer form gdpr header legal login menu menus modal nav navbar "
    "navigation newsletter notice notices notification pagination pager popup promo promoted promotion reactions related replies reply search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription toc toolbar widget widgets".split()
)
#: Of these, the words that name text of its own, which is as long and as punctuated as an article.
OWN_WORDS = frozenset("comment comments consent cookie cookies disqus gdpr legal notice notices notification popup reactions related replies reply sidebar".split())
MAIN_WORDS = frozenset("article articlebody body content entry main post story text".split())
MAIN_ROLES, OFF_ROLES = frozenset(["main", "article"]), frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar note".split())

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
REST = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)", re.I) for x in RAW}
WORD = re.compile(r"[a-z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：।]")
SPACE = re.compile(r"\s+")
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table select".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FLOW = HEADINGS | SCOPES | frozenset("p li dt dd thead tbody tfoot tr td th caption blockquote pre figure figcaption".split())

#: Share of a path's ratios that comes from its container, and the least share of the best fused ratio that content has.
SMOOTHING, LEAST_SHARE = 0.5, 0.3
#: Weight of paths outside the marked article and of named ones, the text at which it counts twice, and its least value; the share of linked text from which a path is mostly links.
WEIGHT, REACH, LEAST_WEIGHT, LINKED = 0.75, 1000, 0.02, 0.5
#: Why an element is off: a word on an element around its article, a word on it or above, a word for text of its own, its kind.
AROUND, WORDED, OWN, NEVER = 1, 2, 3, 4


@dataclass
class Path:
    """One tag path of a page; above and main are numbers of paths, or -1."""

    tag: str
    above: int
    main: int  # the outermost element marked as the article
    off: int
    n: int = 0
    total: int = 0
    length: int = 0  # text outside links
    marks: int = 0


@dataclass
class Block:
    path: int
    parts: list = field(default_factory=list)
    linked: int = 0


def _marks(tag: str, attributes: str, inside: bool) -> tuple[str, bool, int]:
    """The element's name in a path, whether it is marked as the article, and whether it can't be part of it; inside the article a header is its own."""
    name, main, off = tag, tag in MAIN, NEVER * (tag in NO_TEXT)
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id"):
                words = set(WORD.findall(value))
                name += ("." if key == "class" else "#") + value
                main |= tag in ("div", "section") and bool(words) and words <= MAIN_WORDS
                if tag not in ("html", "body", "article", "main") and words & OFF_WORDS - ({"header"} if inside else set()):
                    off = max(off, OWN if words & OWN_WORDS else WORDED)
            elif key == "role":
                main |= value in MAIN_ROLES
                off = NEVER if value in OFF_ROLES else off
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                off = NEVER
    return name, main, off


def blocks(page: str, marked: bool = True) -> tuple[list[Block], list[Path]]:
    """Blocks with text, in page order, and the paths they are numbered by. marked=False: no class, id or role says anything, nor does an article element."""
    out: list[Block] = []
    paths = [Path("", -1, -1, 0)]
    numbers: dict[tuple, int] = {}
    stack: list[tuple[str, int]] = []  # tag, path
    places: dict[str, list[int]] = {}  # where in the stack each tag is open
    linked = False
    current: Block | None = None
    at, size, quotes = 0, len(page), True

    def text(raw: str) -> None:
        nonlocal current
        if current is None:
            if not raw.strip():
                return
            current = Block(stack[-1][1] if stack else 0)
            out.append(current)
        current.parts.append(raw)
        if linked:
            current.linked += len(raw)

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def close(i: int) -> None:
        """Close the i-th open element and all in it."""
        for tag, _ in stack[i:]:
            places[tag].pop()
        del stack[i:]

    while at < size:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        if start > at:
            text(page[at:start])
        m = NAME.match(page, start + 1)
        if not m:
            if page[start + 1 : start + 2] not in ("!", "?", "/"):
                text("<")
                at = start + 1
                continue
            mark = "-->" if page.startswith("<!--", start) else ">"
            end = page.find(mark, start + 2)
            if end < 0:
                break
            at = end + len(mark)
            continue
        rest = REST.match(page, m.end()) if quotes else None
        if rest:
            at, attributes = rest.end(), rest[1]
        else:
            quotes, end = False, page.find(">", m.end())
            if end < 0:
                break
            at, attributes = end + 1, page[m.end() : end]
        tag, closing = m[2].lower(), bool(m[1])
        if tag in INLINE:
            if tag == "br":
                text(" ")
            elif tag == "a":
                linked = not closing
            continue
        current, linked = None, False
        if closing:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in CLOSES_P and places.get("p"):
            close(places["p"][0])
        own = innermost(CLOSED_BY_OWN.get(tag, ()))
        if own > innermost(SCOPES):
            close(own)
        if tag in VOID:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            closed = page.find(">", end.end()) if end else -1
            at = closed + 1 if closed >= 0 else size
            continue
        above = stack[-1][1] if stack else 0
        name, main, off = _marks(tag, attributes, paths[above].main >= 0)
        if tag == "header" and any(places.get(x) for x in HEADED):
            off = paths[above].off  # an article's own heading
        if not marked:
            name, main, off = name, False, NEVER * (tag in RAW)
        key = (above, name, main, off)
        if key not in numbers:
            numbers[key] = len(paths)
            up = paths[above]
            starts = main and up.main < 0 and up.off in (WORDED, OWN) and not off
            paths.append(Path(tag, above, up.main if up.main >= 0 else len(paths) if main else -1, AROUND if starts else max(up.off, off)))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, numbers[key]))
    return out, paths


def fused_ratios(paths: list[Path], smoothing: float, weight: float, reach: float) -> list[float]:
    """The fused ratio of each path."""
    sums: dict[int, list[int]] = {}
    for p in paths:
        if p.off != NEVER:
            own = sums.setdefault(_container(p), [0, 0])
            own[0], own[1] = own[0] + p.length, own[1] + p.marks
    weight = max(LEAST_WEIGHT, weight ** (1 + reach / max(1, sum(length for length, _ in sums.values()))))
    article = any(p.n and p.main >= 0 and not p.off for p in paths)
    out = []
    for p in paths:
        if not p.n or not p.length or p.off == NEVER:
            out.append(0.0)
            continue
        length, marks = sums[_container(p)]
        text_ratio = (1 - smoothing) * p.length + smoothing * length
        mark_ratio = (1 - smoothing) * p.marks + smoothing * marks
        out.append(text_ratio * (1 + mark_ratio) * (weight if article and p.main < 0 else 1) * (LEAST_WEIGHT if p.off == OWN else weight if p.off else 1))
    return out


def _container(p: Path) -> int:
    return p.main if p.main >= 0 else p.above


def content(paths: list[Path], fused: list[float], least_share: float) -> list[bool]:
    """Which paths are content."""
    least = least_share * max(fused)
    if not least:
        return [p.main >= 0 and not p.off for p in paths]
    chosen = [f >= least for f in fused]
    opened = {_container(p) for p, c in zip(paths, chosen, strict=True) if c and not p.off}
    reached = [False] * len(paths)  # inside an opened container; a path comes after the one above it
    for i, p in enumerate(paths):
        reached[i] = p.main in opened if p.main >= 0 else p.tag in FLOW and (p.above in opened or reached[p.above])
        if reached[i] and p.n and not p.off and (p.main >= 0 or p.tag in HEADINGS or 1 - p.length / p.total < LINKED):
            chosen[i] = True
    return chosen


def extract(page: str | None, smoothing: float = SMOOTHING, least_share: float = LEAST_SHARE, weight: float = WEIGHT, reach: float = REACH, marked: bool = True) -> str:
    """Text of the content blocks, joined by line ends."""
    cut, paths = blocks(page or "", marked)
    found = []
    for b in cut:
        t = SPACE.sub(" ", entities.unescape("".join(b.parts))).strip()
        if t:
            found.append((b.path, t))
            p = paths[b.path]
            p.n, p.total, p.length = p.n + 1, p.total + len(t), p.length + max(0, len(t) - b.linked)
            p.marks += 0 if b.linked else len(PUNCTUATION.findall(t))
    if not any(p.n and p.main >= 0 and not p.off for p in paths):  # the only article stands in an element with such a word
        for p in paths:
            p.off = 0 if p.off == AROUND else p.off
    chosen = content(paths, fused_ratios(paths, smoothing, weight, reach), least_share)
    return "\n".join(t for path, t in found if chosen[path])


def _main_texts(pages: pa.Array) -> pa.Array:
    return pa.array([extract(x.as_py()) for x in pages], pa.string())


def main_text(html: Column) -> Column:
    """Main text of each html, never null; the other columns of the frame stay in the JVM."""
    return F.arrow_udf(by_parts(_main_texts), "string")(html.cast("string"))
