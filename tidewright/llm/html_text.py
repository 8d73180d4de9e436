"""Main text of web pages by composite text density.

A tolerant parser builds the element tree of one page, in time linear in its length. Every element
gets its characters per tag, adjusted by how much of it is link text (composite text density); an
element's density sum adds up its children, runs of bare text counting as children. The element
with the largest sum is the core of the page, the smallest density on the core's path to ``body``
the threshold: below every element that reaches it, the subtree with the largest sum is main text.
An ``article`` or ``main`` around the core breaks the tie between the nested elements of that path,
if it holds at least half of what the threshold finds; then it is the main text.

Menus, footers, sidebars, forms, scripts and page headers are out by tag, role and visibility.
Class and id names are evidence only. A name counts by its last word that isn't a mere position or
container (``cookie-banner-box`` is a banner, ``social-history`` is a history); what it names goes
if other text is left, it isn't a wrapper around the page's own article, and, for words that are
often used for text too, if it is short or mostly links. Reader comments are known by name, by the
heading over them, or as a run of like elements that each have a writer or a time.
"""

from __future__ import annotations

import bisect
import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import bounded_batches, lean

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|[\"'])*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea xmp iframe noframes noembed".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends the open elements named first, looking no further than those named second.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
_DROPPED = frozenset(
    "head script style title noscript nav aside footer form button select option optgroup input textarea template dialog menu "
    "iframe object embed svg canvas audio video map noframes noembed xmp search".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: Words of class and id names. Reader comments; other furniture; words that often name text as well; words that speak of a
#: neighbour, not of the element itself; positions and containers, which are passed over; marks of a comment's writer and time.
_READERS = frozenset("comment comments commentlist disqus respond response responses reply replies discussion reaction reactions talkback guestbook feedback kommentar kommentare commentaire commentaires comentario comentarios".split())
_STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promotion promotions banner "
    "cookie cookies consent gdpr notice notices alert alerts newsletter subscribe signup sidebar navbar nav navigation navmenu menu breadcrumb "
    "breadcrumbs pagination pager share sharing social footer masthead popup modal overlay paywall login hidden noprint".split()
)
_WEAK = frozenset("related recommended recommendations widget widgets toolbar search header copyright tags meta aside side teaser teasers outbrain taboola".split())
_TEXTUAL = frozenset("article body post entry story text".split())
_MODIFIER = frozenset("has with no without free non is".split())
_PASSED = frozenset("container wrapper wrap box block blocks list lists area inner outer section item items panel bar left right top bottom unit slot holder row col column group links link icons buttons region zone content main primary secondary global site page the of".split())
_BYLINE = frozenset("author by byline user username nick nickname avatar commenter writer date time timestamp posted when ago permalink reply vote votes".split())
_COMMENT_HEAD = re.compile(r"(?:\d+\s+)?(?:reader |user )?(?:comments?|responses?|replies|reactions?|discussion|kommentare?|commentaires?|comentarios?|leave a (?:comment|reply))(?:\s*\(?\d+\)?)?\s*:?", re.I)
_SKIN = frozenset(("html", "body"))
#: What must be left for a named element to go, if the page has no article, main or h1; the share of it up to which an element with an ambiguous name goes.
LEAST, SHARE = 25, 0.3


class _Page:
    """Flat arrays of one page's elements and text runs; element 0 is a root above everything."""

    def __init__(self) -> None:
        self.tag, self.parent, self.dropped, self.children = ["#root"], [-1], [False], [[]]
        self.in_article, self.in_head, self.in_title, self.in_link = [False], [False], [False], [False]
        self.kind, self.look, self.byline = [""], [""], [False]
        self.runs: list[tuple[int, int, str]] = []  # element, block, text


def _furniture_word(token: str) -> str | None:
    """The word that a class or id name stands for: its last one that is no position or container."""
    words = [w.lower() for w in _NAME.findall(token)]
    if not words or set(words) & _MODIFIER:
        return None
    return next((w for w in reversed(words) if w not in _PASSED), None)


def _evidence(attrs: dict[str, str]) -> str:
    """What class and id say an element is: readers, strong, weak or nothing."""
    if "class" not in attrs and "id" not in attrs:
        return ""
    words = {_furniture_word(t) for t in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()}
    if words & _TEXTUAL and not words & (_READERS | _STRONG):
        return ""
    return "readers" if words & _READERS else "strong" if words & _STRONG else "weak" if words & _WEAK else ""


def _is_out(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether tag, role or visibility alone rule an element out."""
    if tag in _DROPPED or tag == "header" and not in_article:
        return True
    if not attrs or tag in _SKIN:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _INVISIBLE.search(attrs.get("style", "")):
        return True
    return attrs.get("role", "").lower() in _ROLES


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(text)}


def _parse(source: str) -> _Page:
    page, stack, block, at = _Page(), [0], 0, 0
    tags = page.tag
    open_at: dict[str, list[int]] = {}  # depths of the open elements of each name
    blocks_at: list[int] = []  # depths of the open block elements

    def text(piece: str) -> None:
        if piece:
            page.runs.append((stack[-1], block, html.unescape(piece) if "&" in piece else piece))

    def close_to(depth: int) -> None:
        nonlocal block
        if blocks_at and blocks_at[-1] >= depth:
            block += 1
        while len(stack) > depth:
            open_at[tags[stack.pop()]].pop()
            if blocks_at and blocks_at[-1] == len(stack):
                blocks_at.pop()

    def deepest(names: tuple[str, ...]) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=0)

    def push(me: int, name: str) -> None:
        open_at.setdefault(name, []).append(len(stack))
        if name in _BLOCK:
            blocks_at.append(len(stack))
        stack.append(me)

    while True:
        m = _TOKEN.search(source, at)
        if m is None:
            text(source[at:])
            return page
        text(source[at : m.start()])
        at = m.end()
        name = m["tag"]
        if name is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if m["end"]:
            depth = deepest((name,))
            # The end of an inline element doesn't reach beyond the block that it stands in.
            if depth and (name in _BLOCK or not blocks_at or depth > blocks_at[-1]):
                close_to(depth)
            elif name in _BLOCK:
                block += 1
            continue
        if name in _BLOCK:
            block += 1
            if blocks_at and tags[stack[blocks_at[-1]]] == "p":
                close_to(blocks_at[-1])
        if name in _CLOSES:
            ends, within = _CLOSES[name]
            floor = deepest(within)
            if name == "tr":  # cells and their row
                inside = [open_at[x][bisect.bisect(open_at[x], floor)] for x in ends if open_at.get(x) and open_at[x][-1] > floor]
                if inside:
                    close_to(min(inside))
            elif (depth := deepest(ends)) > floor:
                close_to(depth)
        attrs, up, me = _attributes(m["attrs"]), stack[-1], len(tags)
        role = attrs.get("role", "").lower()
        tags.append(name)
        page.parent.append(up)
        page.children.append([])
        page.children[up].append(me)
        page.in_article.append(page.in_article[up] or name in ("article", "main") or role in ("main", "article"))
        page.in_link.append(page.in_link[up] or name == "a")
        page.in_head.append(page.in_head[up] or name == "header" and page.in_article[up])
        page.in_title.append(page.in_title[up] or name in _HEADINGS)
        page.dropped.append(page.dropped[up] or _is_out(name, attrs, page.in_article[up]))
        page.kind.append("" if name in _SKIN else _evidence(attrs))
        page.look.append(f"{name} {' '.join(attrs.get('class', '').split()[:1])}")
        page.byline.append(name in ("time", "cite") or bool(attrs) and bool({w.lower() for w in _NAME.findall(f"{attrs.get('class', '')} {attrs.get('rel', '')} {attrs.get('itemprop', '')}")} & _BYLINE))
        if name in _VOID:
            if name == "br":
                page.runs.append((up, block, " "))
        elif name in _RAW:
            end = _RAW_END[name].search(source, at)
            at = end.start() if end else len(source)
            push(me, name)
        elif not m["attrs"].endswith("/") or name in _BLOCK | {"a", "b", "i", "em", "strong", "span"}:
            push(me, name)


def _sizes(page: _Page) -> tuple[list[int], list[int]]:
    """Characters and link characters of every element, without what is out."""
    n = len(page.tag)
    chars, linked = [0] * n, [0] * n
    for i, _, run in page.runs:
        if not page.dropped[i]:
            size = len(" ".join(run.split()))
            chars[i] += size
            linked[i] += size * page.in_link[i]
    for i in range(n - 1, 0, -1):  # children come after their parents
        if not page.dropped[i]:
            chars[page.parent[i]] += chars[i]
            linked[page.parent[i]] += linked[i]
    return chars, linked


def _find_readers(page: _Page) -> None:
    """Marks reader comments that have no telling name: by the heading over them, and as runs of like elements with a writer or a time."""
    n = len(page.tag)
    signed = page.byline[:]  # a writer or a time somewhere below
    for i in range(n - 1, 0, -1):
        if signed[i]:
            signed[page.parent[i]] = True
    heads: dict[int, str] = {}
    for i, _, run in page.runs:
        if page.tag[i] in _HEADINGS:
            heads[i] = heads.get(i, "") + run
    opened: set[int] = set()
    for i, said in heads.items():
        up = page.parent[i]
        if up not in opened and _COMMENT_HEAD.fullmatch(" ".join(said.split())):
            opened.add(up)
            # The element that the heading opens; where it stands among other text, what follows it.
            if page.children[up][0] == i and page.tag[up] not in ("article", "main", *_SKIN):
                page.kind[up] = "readers"
            else:
                for j in page.children[up][page.children[up].index(i) :]:
                    page.kind[j] = "readers"
    for up in range(n):
        if page.tag[up] in _SKIN or len(page.children[up]) < 2:
            continue
        alike: dict[str, list[int]] = {}
        for j in page.children[up]:
            if signed[j] and not page.byline[j] and page.tag[j] in ("div", "li", "article", "section", "dd", "blockquote") and " " in page.look[j].strip():
                alike.setdefault(page.look[j], []).append(j)
        for like in alike.values():
            if len(like) > 1:
                for j in like:
                    page.kind[j] = page.kind[j] or "weak" if page.tag[j] == "article" and not page.in_article[up] else "readers"


def _drop_furniture(page: _Page) -> None:
    """Drops what names and structure speak against, as far as sizes agree."""
    _find_readers(page)
    n = len(page.tag)
    chars, linked = _sizes(page)
    holds = [t in ("article", "main", "h1") and not d for t, d in zip(page.tag, page.dropped, strict=True)]
    suspect = [False] * n
    for i in range(n - 1, 0, -1):
        if holds[i]:
            holds[page.parent[i]] = True
    free = chars[0]  # text outside every suspect
    for i in range(1, n):
        up = page.parent[i]
        # A wrapper around the page's own article isn't what its name says.
        own = page.kind[i] and not page.dropped[i] and chars[i] and not (holds[i] and page.kind[i] != "readers") and not (page.kind[i] == "readers" and page.tag[i] == "article" and not page.in_article[up])
        suspect[i] = suspect[up] or bool(own)
        if own and not suspect[up]:
            free -= chars[i]
        elif not own:
            page.kind[i] = ""
    anchored = any(page.tag[i] in ("article", "main", "h1") and chars[i] and not page.dropped[i] and not suspect[i] for i in range(n))
    for i in range(1, n):
        up = page.parent[i]
        if page.dropped[up]:
            page.dropped[i] = True
        elif page.kind[i]:
            weak = page.kind[i] == "weak"
            outside = free if suspect[i] else chars[0] - chars[i]
            small = chars[i] <= SHARE * outside or 2 * linked[i] > chars[i]
            text = page.tag[i] == "p" or page.tag[i] in _HEADINGS or page.tag[i] == "header"
            page.dropped[i] = (anchored or outside >= LEAST) and (not weak or small and not (text and page.in_article[i]))


def _densities(page: _Page) -> tuple[list[float], list[float], list[int]]:
    """Composite text density, density sum and characters of every element."""
    n = len(page.tag)
    chars, linked = _sizes(page)
    count, links, total = [0] * n, [0] * n, [0.0] * n
    for i, _, run in page.runs:
        if not page.dropped[i]:
            total[i] += len(" ".join(run.split()))
    for i in range(n - 1, 0, -1):
        if not page.dropped[i]:
            up = page.parent[i]
            count[up] += count[i] + 1
            links[up] += links[i] + (page.tag[i] == "a")
    share = linked[0] / max(chars[0], 1)
    density = [0.0] * n
    for i in range(n - 1, -1, -1):
        if page.dropped[i] or not chars[i]:
            continue
        tags = max(count[i], 1)
        base = math.log(chars[i] / max(chars[i] - linked[i], 1) * linked[i] + share * chars[i] + math.e)
        ratio = chars[i] / max(linked[i], 1) * tags / max(links[i], 1)
        density[i] = chars[i] / tags * math.log(max(ratio, 1.0)) / math.log(max(base, 1.0000001))
        if i:
            total[page.parent[i]] += density[i]
    return density, total, chars


def _content(page: _Page, density: list[float], total: list[float], chars: list[int]) -> list[bool]:
    """Which elements are main text."""
    n = len(page.tag)
    content = [False] * n
    body = next((i for i in range(n) if page.tag[i] == "body"), 0)
    core = max((i for i in range(n) if chars[i] and not page.dropped[i]), key=lambda i: (total[i], -i), default=None)
    if core is None:
        return content
    path, i = [], core
    while i >= 0:
        path.append(i)
        if i == body:
            break
        i = page.parent[i]
    least = min(density[i] for i in path)
    best = list(range(n))  # of each subtree, the element with the largest sum
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if not page.dropped[i] and (total[best[i]], -best[i]) > (total[best[up]], -best[up]):
            best[up] = best[i]
    reach = [body]
    while reach:
        i = reach.pop()
        if not page.dropped[i] and density[i] >= least:
            content[best[i]] = True
            reach.extend(page.children[i])
    content[core] = True
    found = [0, 0]  # characters that the threshold finds: in all, in the article
    outer = [i for i in path if page.tag[i] in ("article", "main")]
    article = next((i for i in outer if page.tag[i] == "article"), outer[-1] if outer else None)
    within = [i == article for i in range(n)]
    for i in range(1, n):
        content[i] = content[i] or content[page.parent[i]]
        within[i] = within[i] or within[page.parent[i]]
    for i, _, run in page.runs:
        if content[i] and not page.dropped[i]:
            found[0] += len(run)
            found[1] += len(run) * within[i]
    return within if article is not None and 2 * found[1] >= found[0] else content


def main_text(source: str | None) -> str:
    """Main text of one page: its blocks in page order, one per line; empty if it has none.

    Null and empty pages have empty text, and so has a page whose text is all furniture. Character references are decoded,
    white space inside a block (line breaks too) becomes one space. Broken markup is read as far as it goes.
    """
    if not source:
        return ""
    page = _parse(source)
    _drop_furniture(page)
    content = _content(page, *_densities(page))
    blocks: list[str] = []
    parts: list[str] = []
    open_block = -1
    for i, block, run in page.runs:
        if block != open_block:
            blocks.append("".join(parts))
            parts, open_block = [], block
        if content[i] and not page.dropped[i] and (page.in_title[i] or not page.in_head[i]):
            parts.append(run)
    blocks.append("".join(parts))
    return "\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """Adds the main text of ``html_col`` and its code points to the other columns; ``html_col`` itself goes.

    Works row by row without a shuffle, so memory is bounded by one Arrow batch. Rows are neither dropped nor merged: repeated
    rows, null pages and empty tables come out as they are. Columns of the names ``text_col`` and ``chars_col`` are replaced.
    """
    bounded_batches(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in (html_col, text_col, chars_col)]
    schema = T.StructType([*kept, T.StructField(text_col, T.StringType()), T.StructField(chars_col, T.LongType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(len(names))]
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*names, text_col, chars_col])

    return pages.select(*[pages[n] for n in names], pages[html_col]).mapInArrow(lean(run), schema)
