"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks (runs of text between block-level tags) under a tree of containers. A linear
classifier gives each block its odds of being content: from the nearest container that says what it is (its
tag, role, class and id), and from the block's own words, share of linked text and kind. The odds are capacities to
the terminals: what labelling the block otherwise would cost. Smoothness edges join blocks that follow each other, weaker
the further apart they are in the tree, and blocks with the container they stand in (DOM proximity). The minimum
cut separates content from boilerplate.

Before any flow is sent, a node whose terminal outweighs all its edges is settled (some minimum cut labels it so) and its
edges become terminals of its neighbours. Where a page says what its parts are, that settles all; augmenting paths
(level graphs) settle the rest. Each page is a row of its own, so pages need no shuffle.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import spread_table

# Fixed values of HTML: elements whose text is no markup, elements that begin and end a block, elements without an end.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object canvas audio video select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element that a start tag of one of these ends, and the elements that shield it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?([A-Za-z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</?([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_PIECES = re.compile(r"[a-z]+")

# What containers say of themselves. A boilerplate mark holds for all within; a content mark until the next mark.
JUNK_TAGS = frozenset("nav aside footer form button menu search dialog fieldset".split())
MAIN_TAGS = frozenset(["article", "main"])
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status note".split())
MAIN_ROLES = frozenset(["main", "article"])
JUNK_WORDS = frozenset(
    "ad ads adbox adcontainer adsbygoogle adsense adslot adunit adv advert advertisement advertisements advertising adverts adwrapper alert banner banners bottombar breadcrumb breadcrumbs comment commentary"
    " commentlist comments consent cookie cookies copyright disclaimer discuss discussion disqus foot footer footnav form gdpr header hidden kommentar kommentare links login masthead menu menus modal nav"
    " navbar navi navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promos promotion promotions recommendations related replies reply responses rss search"
    " share sharing sidebar sidebars signin signup skip skyscraper snackbar social socials sponsor sponsored sponsors subscribe subscription tags teaser teasers toast toolbar topbar trackback trending widget"
    " widgets".split()
)
#: A class with one of these says how a page is laid out, not what an element is.
LAYOUT_WORDS = frozenset("has no with without".split())
#: What makes an article element no article of the page.
COMMENT_WORDS = frozenset("comment comments kommentar kommentare related replies reply responses teaser teasers".split())
MAIN_WORDS = frozenset("article articlebody articletext body content contents entry entrycontent hentry main maincontent post postbody postcontent story storybody text".split())

#: Weights of the classifier: log odds of content.
IN_JUNK, IN_MAIN, OUTSIDE = -9.0, 6.0, -3.0
BIAS, PER_WORD, MOST_WORDS, SENTENCE, LINKED = -1.6, 0.15, 30, 0.8, -5.0
KINDS = {"h1": 2.0, "h2": 1.2, "h3": 1.0, "p": 1.0, "pre": 1.0, "blockquote": 0.8, "li": -0.3, "td": -0.3}
#: Capacities of the smoothness edges: between neighbours in page order, and between a block or container and its container.
FOLLOWS, WITHIN = 1.0, 0.6


class Container:
    __slots__ = ("depth", "main", "mark", "number", "tag", "up")

    def __init__(self, tag: str, up: Container | None, mark: int, main: bool, number: int) -> None:
        self.tag, self.up, self.mark, self.main, self.number = tag, up, mark, main, number
        self.depth = up.depth + 1 if up else 0


def said(attributes: str) -> dict[str, str]:
    """Attributes by name, in lower case; the first of a name holds."""
    return {k.lower(): v.strip("\"'").lower() for k, v in reversed(_ATTRIBUTE.findall(attributes))} if attributes else {}


def hidden(named: dict[str, str]) -> bool:
    style = named.get("style", "").replace(" ", "")
    return "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style


def mark_of(tag: str, attributes: str, up: Container) -> tuple[int, bool]:
    """-1 for boilerplate, 1 for content, 0 for nothing said; and whether a main or article element holds this one."""
    if up.mark < 0 and not (up.tag in ("form", "fieldset") and tag in MAIN_TAGS):
        return -1, up.main
    named = said(attributes)
    role = set(named.get("role", "").split())
    if hidden(named) or tag in JUNK_TAGS or role & JUNK_ROLES or tag == "header" and not up.main:
        return -1, up.main
    main = tag in MAIN_TAGS or bool(role & MAIN_ROLES) or named.get("itemprop") == "articlebody"
    words: set[str] = set()
    for token in f"{named.get('class', '')} {named.get('id', '')}".split() if tag not in ("html", "body") else ():
        pieces = set(_PIECES.findall(token))
        words |= set() if pieces & LAYOUT_WORDS else pieces
    junk = words & (COMMENT_WORDS if main else JUNK_WORDS)
    if junk:
        return -1, up.main
    if main or words & MAIN_WORDS and tag in ("div", "section", "td"):
        return 1, up.main or main
    return up.mark, up.main


def blocks_of(page: str) -> tuple[list[tuple[str, Container, float]], list[Container]]:
    """Blocks of a page (text, container, share of it in links) in page order, and all containers, the root first."""
    root = Container("", None, 0, False, 0)
    containers, stack, blocks = [root], [root], []
    pieces: list[str] = []
    linked: list[str] = []
    in_link, at, pattern = False, 0, _TAG
    inline_hidden: list[str] = []

    def end_block() -> None:
        text = " ".join("".join(pieces).split())
        if text:
            inside = " ".join("".join(linked).split())
            blocks.append((text, stack[-1], len(inside) / len(text)))
        pieces.clear()
        linked.clear()

    def add(raw: str) -> None:
        if raw and not inline_hidden:
            raw = unescape(raw) if "&" in raw else raw
            pieces.append(raw)
            if in_link:
                linked.append(raw)

    def close(upto: int) -> None:
        nonlocal in_link
        end_block()
        del stack[upto:]
        in_link = False

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        m = pattern.match(page, lt)
        if m is None and pattern is _TAG and (m := _LOOSE.match(page, lt)):
            pattern = _LOOSE  # a quote that never ends: quotes mean nothing from here on
        if m is None:
            add("<")
            at = lt + 1
            continue
        at = m.end()
        if m[1] is None:
            continue
        tag = m[1].lower()
        if page[lt + 1] == "/":
            if tag == "a":
                in_link = False
            elif tag in ("p", "br"):
                if tag == "br" or not any(c.tag == "p" for c in stack):
                    add(" ")
                else:
                    close(max(i for i, c in enumerate(stack) if c.tag == "p"))
            elif tag in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag or tag[0] == "h" and tag[1:].isdigit() and stack[i].tag[0] == "h" and stack[i].tag[1:].isdigit():
                        close(i)
                        break
                    if stack[i].tag in ("table", "td", "th") and tag not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "html", "body", "article", "main"):
                        break
                end_block()
            elif inline_hidden and tag == inline_hidden[-1]:
                inline_hidden.pop()
            if tag in BLOCK:
                inline_hidden.clear()
            continue
        if tag in RAW:
            raw = tag in ("script", "style", "textarea", "title")
            if raw or not m[2].rstrip().endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = end.end() if end else n if raw else at
            continue
        if tag in VOID and tag != "hr":
            if tag in ("br", "wbr"):
                add(" " if tag == "br" else "")
            continue
        if tag == "a":
            in_link = True
        if tag in BLOCK or tag == "button":
            end_block()
            if stack[-1].tag == "p" or any(c.tag == "p" for c in stack[-3:]):
                close(max(i for i, c in enumerate(stack) if c.tag == "p"))
            if tag in IMPLIED:
                ends, shields = IMPLIED[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in shields:
                        break
                    if stack[i].tag in ends and (i == 1 or stack[i - 1].tag not in ends):
                        close(i)
                        break
            if tag != "hr":
                mark, main = mark_of(tag, m[2], stack[-1])
                stack.append(Container(tag, stack[-1], mark, main, len(containers)))
                containers.append(stack[-1])
        elif m[2] and tag != "a" and (inline_hidden and tag == inline_hidden[-1] or hidden(said(m[2]))):
            inline_hidden.append(tag)  # a hidden span
    end_block()
    return blocks, containers


def odds(text: str, of: Container, linked: float, has_main: bool) -> float:
    """Log odds of a block's being content."""
    words = text.count(" ") + 1
    own = BIAS + PER_WORD * min(words, MOST_WORDS) + KINDS.get(of.tag, 0.0) + (SENTENCE if text[-1] in ".!?…。！？\"”»" else 0.0) + LINKED * linked
    if of.mark:
        return (IN_JUNK if of.mark < 0 else IN_MAIN) + max(-2.0, min(2.0, own))
    return own + (OUTSIDE if has_main else 0.0)


def _apart(a: Container, b: Container) -> int:
    """Steps between two containers in the tree."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        steps += 1
    return steps


def minimum_cut(terminal: list[float], edges: dict[int, dict[int, float]]) -> list[bool]:
    """Which nodes stand on the source's side of a minimum cut.

    terminal: capacity to the source, to the sink where negative. edges: capacities between nodes, given both ways.
    """
    n, side = len(terminal), [None] * len(terminal)
    terminal, edges = list(terminal), {i: dict(e) for i, e in edges.items()}
    todo = deque(range(n))
    while todo:  # persistency: a terminal that outweighs all edges decides
        i = todo.popleft()
        if side[i] is not None or abs(terminal[i]) < sum(edges.get(i, {}).values()):
            continue
        side[i] = terminal[i] > 0
        for j, c in edges.pop(i, {}).items():
            del edges[j][i]
            terminal[j] += c if side[i] else -c
            todo.append(j)
    rest = [i for i in range(n) if side[i] is None]
    if not rest:
        return side
    flow = {i: dict(edges.get(i, {})) for i in rest}
    source, sink = n, n + 1
    flow[source], flow[sink] = {}, {}
    for i in rest:
        a, b = (source, i) if terminal[i] > 0 else (i, sink)
        flow[a][b], flow[b][a] = abs(terminal[i]), 0.0
    tiny = 1e-9
    while True:
        level, ring = {source: 0}, deque([source])
        while ring:
            i = ring.popleft()
            for j, c in flow[i].items():
                if c > tiny and j not in level:
                    level[j] = level[i] + 1
                    ring.append(j)
        if sink not in level:
            break
        left = {i: list(e) for i, e in flow.items() if i in level}
        path = [source]
        while path:  # a blocking flow, without recursion
            i = path[-1]
            if i == sink:
                least = min(flow[a][b] for a, b in zip(path, path[1:], strict=False))
                back = 0
                for k in range(len(path) - 2, -1, -1):
                    a, b = path[k], path[k + 1]
                    flow[a][b] -= least
                    flow[b][a] += least
                    if flow[a][b] <= tiny:
                        back = k
                del path[back + 1 :]
                continue
            while left[i]:
                j = left[i][-1]
                if flow[i][j] > tiny and level.get(j, -1) == level[i] + 1:
                    path.append(j)
                    break
                left[i].pop()
            else:
                path.pop()
                if path:
                    left[path[-1]].pop()
    for i in rest:
        side[i] = i in level
    return side


def main_text(page: str | None) -> str:
    """The blocks of a page that the minimum cut labels content, joined by a line feed each."""
    if not page:
        return ""
    blocks, containers = blocks_of(page)
    if not blocks:
        return ""
    has_main = any(c.mark > 0 and c.main for c in containers)
    n = len(blocks)
    terminal = [odds(*b, has_main) for b in blocks] + [0.0] * len(containers)
    edges: dict[int, dict[int, float]] = {i: {} for i in range(len(terminal))}

    def join(i: int, j: int, capacity: float) -> None:
        edges[i][j] = edges[j][i] = capacity

    for i, (_, of, _) in enumerate(blocks):
        join(i, n + of.number, WITHIN)
        if i:
            join(i - 1, i, FOLLOWS / (1 + _apart(blocks[i - 1][1], of)))
    for c in containers[1:]:
        join(n + c.number, n + c.up.number, WITHIN)
    side = minimum_cut(terminal, edges)
    return "\n".join(b[0] for b, content in zip(blocks, side, strict=False) if content)


def extract(pages: DataFrame, column: str = "html", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """pages with the main text of `column` and its number of code points in place of `column`.

    Null and empty pages, and pages of which all is boilerplate, give an empty text. Pages are read whole however long;
    markup that breaks off is read as far as it goes, and an element that nothing ends holds to the end of its
    container. Repeated rows give equal rows, an empty table none. All other columns are kept as they
    are; one named `text` or `n_chars` is refused (ValueError), so pass other names then.
    """
    kept = [c for c in pages.columns if c != column]
    for name in (text, n_chars):
        if name.lower() in {c.lower() for c in kept}:
            raise ValueError(f"the pages have a column {name} already")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(x.as_py()) for x in batch.column(batch.schema.get_field_index(column))]
            others = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*others, pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], [*kept, text, n_chars])

    fields = pages.select(*kept).schema.add(text, "string").add(n_chars, "long")
    return pages.select(*kept, column).mapInArrow(extracted, fields)


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spread_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
