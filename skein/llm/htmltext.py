"""Main text of web pages by composite text density.

A page becomes a small DOM. For every node the density is its characters per tag, lowered
by the share of link characters and link tags in it and in the page. The densities of a
node's children are summed; the node with the largest sum is the core. The smallest density
on the path from the body to the core is the threshold: every node at or above it gives the
subtree with the largest sum below it. If the core lies in an article or main element, that
element as a whole belongs to the result too, so that short paragraphs stay, and so do the
articles beside it that reach the threshold.

Menus, footers, sidebars, notices, adverts, forms, comments and the like are left out by
element, role and class or id words before densities are taken. Pages are independent: one
pass over the rows, no shuffle, memory bounded by the largest single page.
"""

from __future__ import annotations

import html as entities
import re
import sys
from collections.abc import Iterator
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame

from skein.llm.tables import given, ship

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript template textarea title".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search "
    "section summary table tbody td tfoot th thead title tr ul".split()
)
OUT = frozenset(
    "head nav footer aside form script style noscript template iframe object svg canvas audio video select button "
    "textarea menu dialog search".split()
)
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "thead": frozenset(["tr", "td", "th", "thead", "tbody", "tfoot"]),
    "tbody": frozenset(["tr", "td", "th", "thead", "tbody", "tfoot"]),
    "tfoot": frozenset(["tr", "td", "th", "thead", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
    "optgroup": frozenset(["option", "optgroup"]),
}
#: An end tag or implied end does not reach through these.
FENCES = {
    "li": frozenset(["ul", "ol", "menu", "dir"]),
    "dt": frozenset(["dl"]),
    "dd": frozenset(["dl"]),
}
_TABLE = frozenset(["table"])
#: What ends an open paragraph.
ENDS_P = BLOCKS - frozenset("html head body option optgroup caption td th tr tbody thead tfoot legend title".split())

ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words in class or id that mark what is not part of the article.
HINTS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|sidenav|aside|menu|nav|navbar|navigation|"
    r"breadcrumbs?|footer|masthead|comments?|commentlist|disqus|respond|cookies?|consent|gdpr|notice|notices|alert|"
    r"newsletter|subscribe|subscription|signup|popup|modal|overlay|share|sharing|social|related|recommended|"
    r"recommendations|widget|toolbar|pagination|pager|skip|login|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
HEADER_HINTS = re.compile(r"(?:^|[\s_-])(?:header|topbar|sitehead)(?:$|[\s_-])", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HOLDERS = ("article", "main")


class _Page:
    """Nodes in document order as parallel lists, and text pieces (node, block number, text)."""

    def __init__(self):
        self.tag: list[str] = ["#root"]
        self.parent: list[int] = [0]
        self.hint: list[str] = [""]
        self.pieces: list[tuple[int, int, str]] = []

    def add(self, tag: str, parent: int, hint: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.hint.append(hint)
        return len(self.tag) - 1


def _hinted(attributes: str) -> str:
    """``side`` for what is not article text, ``header`` for a heading part, else nothing."""
    if not attributes or attributes.isspace():
        return ""
    header = ""
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            if HINTS.search(value):
                return "side"
            if HEADER_HINTS.search(value):
                header = "header"
        elif name == "role" and value.strip().lower() in ROLES:
            return "side"
        elif name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true"):
            return "side"
        elif name == "style" and HIDDEN.search(value):
            return "side"
    return header


def parse(source: str) -> _Page:
    page = _Page()
    stack = [0]
    names = ["#root"]
    block, at, size = 0, 0, len(source)

    def close_to(depth: int) -> None:
        del stack[depth:], names[depth:]

    def text(piece: str) -> None:
        if piece:
            page.pieces.append((stack[-1], block, entities.unescape(piece)))

    while at < size:
        found = _TOKEN.search(source, at)
        if not found:
            text(source[at:])
            break
        if found.start() > at:
            text(source[at : found.start()])
        at = found.end()
        ending, tag, attributes = found.group(1), found.group(2), found.group(3)
        if tag is None:
            ending, tag, attributes = found.group(4), found.group(5), found.group(6)
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS or tag == "br":
            if tag == "br":
                page.pieces.append((stack[-1], block, " "))
            else:
                block += 1
        if ending:
            if tag in names:
                depth = len(names) - 1 - names[::-1].index(tag)
                if tag in BLOCKS or not any(n in BLOCKS for n in names[depth + 1 :]):
                    close_to(depth)
            continue
        if tag in ENDS_P and "p" in names:
            depth = len(names) - 1 - names[::-1].index("p")
            if not any(n in ("td", "th", "button", "object") for n in names[depth + 1 :]):
                close_to(depth)
        closes = CLOSES.get(tag)
        if closes:
            fence = FENCES.get(tag, _TABLE)
            for depth in range(len(names) - 1, 0, -1):
                if names[depth] in fence:
                    break
                if names[depth] in closes:
                    close_to(depth)
                    if tag in ("li", "dt", "dd", "option"):
                        break
        node = page.add(tag, stack[-1], _hinted(attributes))
        if tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            inside = source[at : end.start()] if end else source[at:]
            if tag in ("title", "textarea"):
                page.pieces.append((node, block, entities.unescape(inside)))
            at = end.end() if end else size
            if tag in BLOCKS:
                block += 1
            continue
        stack.append(node)
        names.append(tag)
    return page


def _left_out(page: _Page) -> list[bool]:
    """Whether a node lies in something that is not article text."""
    n = len(page.tag)
    holds = [False] * n  # an article or main element is inside
    chars = [0] * n
    for node, _, piece in page.pieces:
        chars[node] += len(piece)
    heading = [False] * n
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        holds[up] = holds[up] or holds[i] or page.tag[i] in _HOLDERS
        heading[up] = heading[up] or heading[i] or page.tag[i] in ("h1", "h2")
        chars[up] += chars[i]
    out, inside = [False] * n, [False] * n
    for i in range(1, n):
        up, tag = page.parent[i], page.tag[i]
        inside[i] = inside[up] or tag in _HOLDERS
        drop = tag in OUT
        if tag == "form" and (holds[i] or 2 * chars[i] > chars[0]):
            drop = False  # a form around the page, not a form of it
        if tag == "header" or page.hint[i] == "header":
            drop = drop or not (inside[up] and heading[i]) and not holds[i]
        if page.hint[i] == "side" and not holds[i] and tag not in ("html", "body", "main"):
            # a wrapper that holds most of the page is not one of its side parts
            drop = drop or inside[up] or 2 * chars[i] <= chars[0] or tag not in ("div", "section", "article")
        out[i] = out[up] or drop
    return out


def main_text(source: str | None) -> str:
    """Text of the article in ``source``; blocks are joined by one line break."""
    if not source:
        return ""
    page = parse(source)
    out = _left_out(page)
    n = len(page.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    link = [False] * n
    for i in range(1, n):
        link[i] = link[page.parent[i]] or page.tag[i] == "a"
    for node, _, piece in page.pieces:
        if not out[node]:
            size = len(piece.strip())
            chars[node] += size
            if link[node]:
                link_chars[node] += size
    for i in range(n - 1, 0, -1):
        if not out[i]:
            up = page.parent[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            link_tags[up] += link_tags[i] + (page.tag[i] == "a")
    if not chars[0]:
        return ""
    share = link_chars[0] / chars[0]
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        if chars[i] and not out[i]:
            plain = max(1, chars[i] - link_chars[i])
            base = chars[i] / plain * link_chars[i] + share * chars[i]
            ratio = chars[i] / max(1, link_chars[i]) * max(1, tags[i]) / max(1, link_tags[i])
            density[i] = chars[i] / max(1, tags[i]) * log(e + ratio) / log(e + log(e + base))
        if i:
            total[page.parent[i]] += density[i]
    body = next((i for i in range(n) if page.tag[i] == "body" and not out[i]), 0)
    blocks = [i for i in range(n) if not out[i] and chars[i] and (i == 0 or page.tag[i] in BLOCKS)]
    score = [total[i] or density[i] for i in range(n)]
    core = max(blocks, key=lambda i: (score[i], i), default=0)

    path, holder = [core], None
    while path[-1]:
        if page.tag[path[-1]] in _HOLDERS:
            holder = path[-1]
        if path[-1] == body:
            break
        path.append(page.parent[path[-1]])
    chosen = [False] * n
    threshold = min(density[i] for i in path)
    best = list(range(n))  # node of the largest sum in each subtree
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if score[best[i]] > score[best[up]] and page.tag[best[i]] in BLOCKS:
            best[up] = best[i]
    for i in blocks:
        if density[i] >= threshold:
            chosen[best[i]] = True
            if holder is not None and page.tag[i] == "article" and page.parent[i] == page.parent[holder]:
                chosen[i] = True
    chosen[core if holder is None else holder] = True
    for i in range(1, n):
        chosen[i] = chosen[i] or chosen[page.parent[i]]

    lines: list[str] = []
    now, held_pieces = -1, []
    for node, block, piece in page.pieces:
        if not chosen[node] or out[node]:
            continue
        if block != now:
            lines.append("".join(held_pieces))
            now, held_pieces = block, []
        held_pieces.append(piece)
    lines.append("".join(held_pieces))
    return "\n".join(x for x in (" ".join(line.split()) for line in lines) if x)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    A null or empty page and a page without text give the empty text. Rows are independent:
    ids and addresses may repeat or be null; an empty table gives an empty result; other
    columns are ignored. Malformed markup is read as far as it goes: unclosed elements end
    with their parent, an unclosed comment or script takes the rest of the page.
    """
    source = given(pages, page_id=id_col, url=url_col, html=html_col)
    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(_pages, f"page_id {kind}, url string, text string, n_chars bigint")


ship(sys.modules[__name__])
