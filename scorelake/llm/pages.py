"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks in page order. A linear classifier gives each
block a cost for being content and one for being boilerplate; they become the
capacities of its edges to the two terminals. Neighbouring blocks, and blocks
under the same element, are joined by smoothness edges that weigh more the
nearer they are in the element tree. The minimum cut is the labelling of least
total cost. Pages are independent rows; memory is bounded by the longest page.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend, prepare, slices

# Comments, declarations and tags. Quoted values end before the next "<", so a missing quote can't run through the page.
_MARKUP = re.compile(r"<!--|<[!?][^>]*+>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)>?")
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_NAME = re.compile(r"[a-z0-9]+")

# Element names by what they do to text.
_RAW = frozenset("script style noscript template textarea iframe svg math object canvas select title".split())
#: Of these, the ones that nothing but their closing tag ends.
_TO_CLOSE = frozenset("script style title textarea".split())
_SPACED = frozenset("title select textarea svg object canvas".split())
_SELF_CLOSED = re.compile(r"(?:^|[\s\"'])/\Z")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSED_BY_OWN = frozenset("p li dt dd tr td th option".split())
# Elements, roles and words of class or id that speak for either label.
_PAGE_PARTS = frozenset("nav aside footer form menu button dialog head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
_BOILERPLATE = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs byline consent cookie cookies copyright disclaimer footer gdpr header"
    " legal login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup"
    " promo promoted promotion recommended related search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription"
    " taboola tags toc toolbar topbar widget widgets".split()
)
_REMARKS = frozenset("comment comments commentlist disqus discussion replies reply respond responses".split())
_CONTENT = frozenset("article content entry main post story text body".split())

#: Weights of the classifier: positive speaks for content.
BIAS, PART, REMARK, HINT, ARTICLE = -0.5, -6.0, -9.0, 1.5, 6.0
WORDS_PER_POINT, MOST_WORD_POINTS, SENTENCE, LINKS, HEADING, PARAGRAPH, ITEM = 20, 2.0, 0.7, -4.0, 0.5, 0.7, -0.7
#: Weight of a smoothness edge between blocks under the same element; it halves with each step apart.
SMOOTH = 0.8


@dataclass
class Element:
    name: str
    depth: int
    score: float
    up: Element | None = None
    remarks: bool = False


@dataclass
class Block:
    parent: Element
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    def score(self) -> float:
        words = self.text.count(" ") + 1
        name = self.parent.name
        points = BIAS + self.parent.score + min(words / WORDS_PER_POINT, MOST_WORD_POINTS)
        points += SENTENCE * self.text.endswith((".", "!", "?", "…", ":", ".”", '."'))
        points += LINKS * min(1.0, self.linked / max(1, len(self.text)))
        points += HEADING * (name[0] == "h" and name[1:].isdigit()) + PARAGRAPH * (name in ("p", "pre", "blockquote")) + ITEM * (name in ("li", "td", "th"))
        return points


def _opened(name: str, attributes: str, up: Element | None) -> Element:
    """An element with what it and its ancestors say about the text below: the innermost that says anything counts."""
    score, remarks = (up.score, up.remarks) if up else (0.0, False)
    inside_article = score == ARTICLE
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    own = set(_NAME.findall(f"{found.get('class', '')} {found.get('id', '')}".lower())) if found else set()
    hidden = found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "") or re.search(r"\shidden(?:[\s=/]|$)", attributes)
    whole = name in ("body", "html", "article", "main")
    if remarks or own & _REMARKS and not whole:
        # Comments may be articles by themselves: nothing inside speaks for content.
        score, remarks = REMARK, True
    elif hidden or name in _PAGE_PARTS or found.get("role") in _ROLES or own & _BOILERPLATE and not whole:
        score = PART
    elif name == "header":
        score = score if inside_article else PART
    elif name in ("article", "main") or found.get("role") in ("main", "article"):
        score = ARTICLE
    elif own & _CONTENT and score == 0:
        score = HINT
    return Element(name, up.depth + 1 if up else 0, score, up, remarks)


def _raw_ends(page: str) -> dict[int, int]:
    """By the end of its opening tag, where each closed element of ``_RAW`` ends that may hold its like.

    An unclosed one isn't there, and a later one's closing tag isn't taken for its own.
    """
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    at, size, lowered = 0, len(page), page.lower()
    where = lowered if len(lowered) == size else page
    while found := _MARKUP.search(page, at):
        at = found.end()
        if found[0] == "<!--":
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        name = (found[2] or "").lower()
        if name not in _RAW or not found[1] and _SELF_CLOSED.search(found[3]):
            continue
        if name in _TO_CLOSE:
            if not found[1]:
                end = where.find(f"</{name}", at)
                at = size if end < 0 else end
        elif not found[1]:
            open_.setdefault(name, []).append(at)
        elif open_.get(name):
            ends[open_[name].pop()] = at
    return ends


def _next_block(page: str, at: int) -> int:
    """Where the next tag of a block, opening or closing, begins."""
    for found in _MARKUP.finditer(page, at):
        if found[2] and found[2].lower() in _BLOCK:
            return found.start()
    return len(page)


def blocks_of(page: str) -> list[Block]:
    """Text blocks of a page in order, white space within a block made single spaces; empty ones are left out."""
    stack = [Element("html", 0, 0.0)]
    out: list[Block] = []
    block: Block | None = None
    links, at = 0, 0
    raw_ends: dict[int, int] | None = None

    def text(piece: str) -> None:
        nonlocal block
        if block is None:
            if not piece.strip():
                return
            block = Block(stack[-1])
        block.pieces.append(piece)
        if links:
            block.linked += len(piece)

    def close() -> None:
        nonlocal block
        if block is not None:
            block.text = " ".join(html.unescape("".join(block.pieces)).split())
            if block.text:
                out.append(block)
            block = None

    size, lowered = len(page), None
    while at < size:
        found = _MARKUP.search(page, at)
        if not found:
            text(page[at:])
            break
        if found.start() > at:
            text(page[at : found.start()])
        at = found.end()
        if found[0] == "<!--":
            end = page.find("-->", at)
            at = size if end < 0 else end + 3
            continue
        if not found[2]:
            continue
        name = found[2].lower()
        if not found[1] and name in _RAW:
            if _SELF_CLOSED.search(found[3]):
                pass  # it is empty
            elif name in _TO_CLOSE:
                lowered = page.lower() if lowered is None else lowered
                # Lower case may change lengths; then tags are looked for as they are.
                where = lowered if len(lowered) == size else page
                end = where.find(f"</{name}", at)
                closing = page.find(">", end) if end >= 0 else -1
                at = size if closing < 0 else closing + 1
            else:
                raw_ends = _raw_ends(page) if raw_ends is None else raw_ends
                # A missing closing tag costs no more than the rest of the block.
                at = raw_ends[at] if at in raw_ends else _next_block(page, at)
            if name in _SPACED:
                text(" ")
            continue
        if name == "a":
            links = 0 if found[1] else 1
            continue
        if name not in _BLOCK:
            if name in ("br", "img", "input", "wbr"):
                text(" ")
            continue
        close()
        if found[1]:
            if any(e.name == name for e in stack[1:]):
                links = 0
                while stack.pop().name != name:
                    pass
            continue
        if name in _VOID or name in ("html", "body"):
            if name == "body":
                while len(stack) > 1:
                    stack.pop()
                stack[0] = _opened("body", found[3], None)
            continue
        if stack[-1].name == "p" or name in _CLOSED_BY_OWN and stack[-1].name == name:
            stack.pop()  # a paragraph ends where any block begins
        if name in ("article", "main") and not stack[-1].remarks and stack[-1].score == PART:
            # A part of the page that was never closed doesn't hold the article.
            while len(stack) > 1 and stack[-1].score == PART:
                stack.pop()
        if not found[3].endswith("/"):
            stack.append(_opened(name, found[3], stack[-1]))
    close()
    return out


def _steps(a: Element, b: Element, most: int = 6) -> int:
    """Steps between two elements through their nearest common ancestor, up to ``most``."""
    steps, x, y = 0, a, b
    while x is not y and steps < most:
        if x.depth >= y.depth and x.up is not None:
            x = x.up
        elif y.up is not None:
            y = y.up
        else:
            return most
        steps += 1
    return steps


def _edges(blocks: list[Block]) -> list[tuple[int, int, float]]:
    edges, latest = [], {}
    for i, b in enumerate(blocks):
        near = {i - 1} if i else set()
        group = id(b.parent.up or b.parent)
        if group in latest:
            near.add(latest[group])
        latest[group] = i
        edges += [(j, i, SMOOTH / 2 ** max(0, _steps(blocks[j].parent, b.parent) - 2)) for j in near]
    return edges


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: ``|score|`` for a label against a node's score, the weight for each edge that is cut.

    True is the source side, positive scores. A node whose score outweighs all
    its edges keeps its sign in every minimum cut, so such nodes are fixed first
    and their edges moved into their neighbours' scores; what is left goes
    through a maximum flow. A tie goes to the sink side.
    """
    n = len(scores)
    unary = list(scores)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            around[a][b] = around[a].get(b, 0.0) + w
            around[b][a] = around[b].get(a, 0.0) + w
    label: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is not None or abs(unary[i]) <= sum(around[i].values()) and around[i]:
            continue
        label[i] = unary[i] > 0
        for j, w in around[i].items():
            unary[j] += w if label[i] else -w
            del around[j][i]
            if label[j] is None:
                queue.append(j)
        around[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        side = _max_flow(rest, unary, around)
        for i in rest:
            label[i] = i in side
    return [bool(x) for x in label]


def _max_flow(nodes: list[int], unary: list[float], around: list[dict[int, float]]) -> set[int]:
    """Nodes on the source side of a minimum cut, by shortest augmenting paths in layers."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(around[i]) for i in nodes}
    room[source] = {i: unary[i] for i in nodes if unary[i] > 0}
    room[sink] = {}
    for i in nodes:
        if unary[i] > 0:
            room[i][source] = 0.0
        elif unary[i] < 0:
            room[i][sink] = -unary[i]
            room[sink][i] = 0.0
    least = 1e-9
    while True:
        layer, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > least and v not in layer:
                    layer[v] = layer[u] + 1
                    queue.append(v)
        if sink not in layer:
            return {i for i in nodes if i in layer}
        ways = {u: list(room[u]) for u in layer}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for a, b in zip(path, path[1:], strict=False):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                path = [source]
                continue
            while ways[u]:
                v = ways[u][-1]
                if room[u].get(v, 0.0) > least and layer.get(v) == layer[u] + 1:
                    path.append(v)
                    break
                ways[u].pop()
            else:
                path.pop()
                if path:
                    ways[path[-1]].pop()


def main_text(page: str | None) -> str:
    """Content blocks in page order, two line feeds between them; empty for a null or empty page."""
    blocks = blocks_of(page) if page else []
    labels = min_cut([b.score() for b in blocks], _edges(blocks))
    return "\n\n".join(b.text for b, content in zip(blocks, labels, strict=True) if content)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Columns of ``pages`` but the page itself, in a struct ``page``, beside ``text`` and ``n_chars`` (code points).

    One row per row; a null or empty page, or one without content, has the empty text.
    """
    prepare(pages.sparkSession)
    others = [F.col(f"`{c}`") for c in pages.columns if c != html_col]
    packed = pages.select(F.struct(*others).alias("page") if others else F.struct(F.lit(0)).alias("page"), F.col(f"`{html_col}`").alias("_html"))
    fields = extend(packed.select("page").schema, "text string, n_chars bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in slices(batch):
                texts = [main_text(p) for p in few.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page", "text", "n_chars"])

    return packed.mapInArrow(run, fields)
