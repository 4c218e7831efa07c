"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read once into blocks: runs of text between the starts and ends of block elements.  Elements whose
tag or names say what they hold are kept as well (`Holder`).  In a flow network

* a block has the cost that a linear classifier over its own text gives (`WEIGHTS`: length, sentences, share
  of links, kind of element), as the capacity of its arc from the source (content) or to the sink
  (boilerplate); a name of the element that holds it adds less to it than one edge weighs;
* a holder has the cost of its kind (`HOLDERS`) in the same way, more for a tag that holds many blocks;
* smoothness edges (DOM proximity) join a block with the innermost holder around it, a holder with the one
  around it, blocks that follow one another, and blocks of one parent, weaker the farther apart they are.

The minimum cut is the labelling of least cost: what the classifier is overruled by, plus the edges between
content and boilerplate.  A short title or a one-word paragraph, boilerplate by its own text, is content by
its surroundings; a well written paragraph of a footer the other way round.

Nodes whose cost outweighs all their edges have that label in every minimum cut; they are settled first,
and what they pull at their neighbours is added to those.  Max-flow decides the others.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements and words of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
SILENT = frozenset("head title script style noscript template svg math iframe object audio video canvas map select option optgroup textarea button datalist".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog fieldset search address".split())
CONTENT_TAGS = frozenset("article main".split())
#: Names (words of class, id and role) of elements that hold boilerplate, of those that hold content, and words
#: that say nothing in a name of several words.
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright dialog discussion disqus footer gdpr header legal login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promos promoted promotion recommendations recommended related replies reply respond search searchform share sharing sidebar signup skip social sponsor sponsored sponsors subscribe taboola tags toast toolbar topbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article articlebody content entry main post story text body".split())
PLAIN_WORDS = frozenset("area bar block bottom box container fixed form global inner item items left link links list message outer page panel primary right secondary section site sticky sub the top wrap wrapper web".split())
#: The linear classifier: what each property of a block's own text adds to its score for content, and what
#: the names of its holder add.
WEIGHTS = {"base": -1.4, "per_word": 0.06, "most_words": 1.8, "sentence": 0.5, "paragraph": 0.7, "heading": 0.5, "link_share": -3.5, "list_item": -0.4, "content_name": 1.2, "boilerplate_name": -2.7}
#: Costs of holders, and what each block they hold adds: by tag, and by names.
HOLDERS = {"content_tag": (8.0, 2.0), "boilerplate_tag": (-8.0, -2.0), "content_name": (1.2, 0.0), "boilerplate_name": (-2.7, 0.0)}
#: Edges: of a block and its holder, of a holder and the one around it, of neighbours, of siblings.
HELD, NESTED, ADJACENT, SIBLING = 3.0, 1.0, 0.5, 0.4

_TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<(script|style)\b(?:.*?</\1\s*>|.*)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<[!?][^>]*>""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_CLOSES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Holder(NamedTuple):
    """An element that says what it holds: a key of `HOLDERS`, and the holder around it (-1 for none)."""

    kind: str
    around: int


class Block:
    __slots__ = ("depth", "holder", "links", "parent", "parts", "tag", "words")

    def __init__(self, tag: str, parent: int, holder: int, depth: int):
        self.tag, self.parent, self.holder, self.depth = tag, parent, holder, depth
        self.parts, self.links = [], 0


def _named(attributes: str) -> str:
    """What the class, id and role say: "content", "boilerplate" or nothing.

    A name is boilerplate if all its words are, or say nothing, and one is; `entry-header` and `has-sidebar`
    are not.  An element that has names of both kinds is content.
    """
    found = ""
    for attribute, value in _ATTRIBUTE.findall(attributes):
        if attribute.lower() not in ("class", "id", "role"):
            continue
        for name in value.strip("\"'").lower().split():
            words = [w for w in re.split(r"[-_]+|(?<=[a-z])\d+$", name) if w]
            if any(w in CONTENT_WORDS for w in words):
                if len(words) == 1 or all(w in CONTENT_WORDS or w in PLAIN_WORDS for w in words):
                    return "content"
            elif any(w in BOILERPLATE_WORDS for w in words) and all(w in BOILERPLATE_WORDS or w in PLAIN_WORDS for w in words):
                found = "boilerplate"
    return found


def _kind(tag: str, attributes: str, inside: str) -> str:
    """The kind of holder that an element is, if any.  inside: the kind of the holder around it."""
    if tag in BOILERPLATE_TAGS or (tag == "header" and inside != "content_tag"):
        return "boilerplate_tag"
    name = _named(attributes) if attributes and tag not in ("body", "html") else ""
    if tag in CONTENT_TAGS and name != "boilerplate":
        # an article among boilerplate is one of a list of teasers, or a reader's comment
        return "" if inside == "boilerplate_name" else "content_tag"
    return name and f"{name}_name"


def blocks(page: str) -> tuple[list[Block], list[Holder]]:
    """The page's blocks with text, in page order, white space inside turned into single spaces, and the holders."""
    # an open element: tag, number, innermost holder, in a link, silent
    stack = [("", 0, -1, False, False)]
    out, holders, number, at = [], [], 0, 0
    block = None

    def text(piece: str) -> None:
        nonlocal block
        _, _, holder, link, silent = stack[-1]
        if silent or not piece:
            return
        if block is None:
            if piece.isspace():
                return
            k = len(stack) - 1
            while k and stack[k][0] not in BLOCK:
                k -= 1
            block = Block(stack[k][0], stack[k - 1][1] if k else 0, holder, k)
            out.append(block)
        piece = html.unescape(piece) if "&" in piece else piece
        block.parts.append(piece)
        if link:
            block.links += len(piece)

    def pop(k: int) -> None:
        nonlocal block
        if any(s[0] in BLOCK for s in stack[k:]):
            block = None
        del stack[k:]

    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            k = len(stack) - 1
            while k and stack[k][0] != tag:
                k -= 1
            if k:
                pop(k)
            elif tag in BLOCK:
                block = None
            continue
        if tag in BLOCK:
            block = None
            k = len(stack) - 1
            scope = _CLOSES.get(tag, ())
            while k and stack[k][0] not in ("p", tag) and stack[k][0] not in scope and (stack[k][0] not in BLOCK):
                k -= 1
            if k and (stack[k][0] == "p" or (tag in _CLOSES and stack[k][0] == tag)):
                pop(k)
        if tag in VOID:
            if tag == "br":
                text(" ")
            continue
        number += 1
        _, _, holder, link, silent = stack[-1]
        kind = _kind(tag, m[4], holders[holder].kind if holder >= 0 else "")
        if kind:
            holders.append(Holder(kind, holder))
            holder = len(holders) - 1
        if not m[4].endswith("/"):
            stack.append((tag, number, holder, link or tag == "a", silent or tag in SILENT))
    text(page[at:])
    for b in out:
        b.words = " ".join("".join(b.parts).split())
    return [b for b in out if b.words], holders


def score(b: Block, kind: str = "") -> float:
    """The classifier's score of a block whose innermost holder is of this kind."""
    w, n = WEIGHTS, b.words.count(" ") + 1
    s = w["base"] + min(w["per_word"] * n, w["most_words"]) + w.get(kind, 0.0)
    s += (b.words[-1] in ".!?…:;\"'”»") * w["sentence"] + (b.tag in ("p", "blockquote", "pre")) * w["paragraph"]
    s += (len(b.tag) == 2 and b.tag[0] == "h" and b.tag[1].isdigit()) * w["heading"] + (b.tag == "li") * w["list_item"]
    return s + w["link_share"] * min(1.0, b.links / len(b.words))


def network(found: list[Block], holders: list[Holder]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Costs and edges of the blocks, followed by the holders."""
    n = len(found)
    costs = [score(b, holders[b.holder].kind if b.holder >= 0 else "") for b in found] + [HOLDERS[h.kind][0] for h in holders]
    for b in found:
        if b.holder >= 0:
            costs[n + b.holder] += HOLDERS[holders[b.holder].kind][1]
    links = [(i, n + b.holder, HELD) for i, b in enumerate(found) if b.holder >= 0]
    links += [(n + i, n + h.around, NESTED) for i, h in enumerate(holders) if h.around >= 0]
    return costs, links + edges(found)


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, capacity) of blocks in page order."""
    out, last = [], {}
    for i, b in enumerate(found):
        if i:
            p = found[i - 1]
            apart = 0 if p.parent == b.parent else 1 + abs(p.depth - b.depth)
            out.append((i - 1, i, ADJACENT / (1 + apart)))
        j = last.get(b.parent)
        if j is not None:
            out.append((j, i, SIBLING / (1 + (i - j - 1) * 0.25)))
        last[b.parent] = i
    return out


def minimum_cut(scores: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it lies on the source's side of a minimum cut."""
    n = len(scores)
    near = [{} for _ in range(n)]
    for i, j, c in links:
        near[i][j] = near[i].get(j, 0.0) + c
        near[j][i] = near[j].get(i, 0.0) + c
    unary, label = list(scores), [None] * n
    queue = deque(range(n))
    while queue:
        i = queue.popleft()
        if label[i] is None and abs(unary[i]) >= sum(near[i].values()) and (unary[i] or not near[i]):
            label[i] = unary[i] > 0
            for j, c in near[i].items():
                del near[j][i]
                unary[j] += c if label[i] else -c
                queue.append(j)
            near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        inside = _source_side(rest, unary, near)
        for i in rest:
            label[i] = i in inside
    return label


def _source_side(nodes: list[int], unary: list[float], near: list[dict[int, float]]) -> set[int]:
    """Dinic's max-flow over the unsettled nodes; what the source still reaches afterwards."""
    source, sink, eps = -1, -2, 1e-12
    room = {i: dict(near[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if unary[i] > 0:
            room[source][i], room[i][source] = unary[i], 0.0
        elif unary[i] < 0:
            room[i][sink], room[sink][i] = -unary[i], 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > eps and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level) - {source}
        arcs = {i: iter(list(room[i])) for i in level}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                flow = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                cut = None
                for k, (a, b) in enumerate(zip(path, path[1:], strict=False)):
                    room[a][b] -= flow
                    room[b][a] = room[b].get(a, 0.0) + flow
                    if cut is None and room[a][b] <= eps:
                        cut = k
                del path[cut + 1 :]
                arcs[path[-1]] = iter(list(room[path[-1]]))
                continue
            for j in arcs[i]:
                if room[i][j] > eps and level.get(j) == level[i] + 1:
                    path.append(j)
                    break
            else:
                level[i] = -1
                path.pop()


def main_text(page: str) -> str:
    """The main text of a page; empty if it has none."""
    found, holders = blocks(page)
    if not found:
        return ""
    keep = minimum_cut(*network(found, holders))
    return " ".join(b.words for b, k in zip(found, keep, strict=False) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of `pages`: id, url, `text`, `n_chars` (code points).

    A null or empty page has the empty text, and so has a page whose blocks are all boilerplate.  Rows are
    independent: repeated rows get the same text, other columns are not read, any number of rows is fine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "") for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "link", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("link"), F.col(html_col).alias("page"))
    out = rows.mapInArrow(run, f"id {kind}, link string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("link", url_col)
