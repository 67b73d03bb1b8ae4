"""Main text of web pages by tree scoring.

A page becomes a tree of elements.  Each block of running text passes points to
the elements around it, for being there, for its commas and its length, half as many to
each one further out; an element's points are discounted by the share of
its text that is in links.  The best container is kept with those siblings that
score well themselves, and its blocks are the text.  An ``article`` or ``main`` around the best is
taken instead unless half of its text is in links.

Menus, headers, footers, side columns, notices, adverts, forms and comments go by
their element, or by a word of their class, id or role that says so (``FIRM``), unless the page's only
article is in them.  A word that may mean anything (``LOOSE``) only halves an
element's points; such an element goes when it has no sentence or half of its text is in links.

Every pass over the tree or the marks is linear, in the depth of a page as well.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

_VALUE = r"\s*+=\s*+(?:\"[^\"]{0,%s}+\"|'[^']{0,%s}+'|(?![\"'])[^\s>]*+)"
#: Most tags at once; a tag with longer or more values is left to ``_end``.
_USUAL = rf"(?:[\s/]*+[^\s/>][^\s/>=]*+(?:{_VALUE % (4096, 4096)}|(?!\s*+=))){{0,64}}+[\s/]*+>"
_MARK = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)(?=[\s/>])({_USUAL})?+", re.S)
_PIECE = re.compile(rf"[\s/]*+(?:(>)|[^\s/>][^\s/>=]*+(?:{_VALUE % ('', '')})?+)")
_UNENDED = re.compile(r"<[!/]?[A-Za-z][^<>]*\Z")
_NAMED = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"'][^\s>\"']*+)))?+")
_NAMES = re.compile(r"(?:.*\W)?(class|id|role)", re.I | re.S)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
SPACED = {"br", "td", "th"}
CELLS = {"td", "th", "table"}
DROPPED = set("head nav footer aside form script style textarea title iframe noscript template button select input svg math canvas object embed audio video menu dialog noembed noframes xmp".split())
HEADS = {"h1", "h2", "h3", "h4", "h5", "h6"}
HOLDERS = {"div", "td", "section", "article", "main", "body", "html"}
#: Open elements that the start of one ends, and what they are not looked for beyond.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}} | {k: {"td", "th"} for k in ("td", "th")} | {"tr": {"tr", "td", "th"}} | {k: {"tr", "td", "th", "tbody", "thead", "tfoot"} for k in ("tbody", "thead", "tfoot")}
SCOPE = {"ul", "ol", "table", "dl", "select", "body", "html", "div", "section", "article", "main", "td", "th", "blockquote"}
FIRM = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promos nav navbar navigation navigator menu menubar sidebar sidebars "
    "footer masthead topbar comment comments commentlist respond replies disqus cookie cookies consent gdpr notice notices alert popup "
    "newsletter subscribe subscription signup breadcrumb breadcrumbs pagination pager contentinfo searchbox outbrain taboola".split()
)
LOOSE = set("aside rail widget widgets modal overlay paywall related recommended recommendations social share sharing promotion banner login copyright search toolbar complementary".split())
WANTED = {"article", "body", "html", "main"}
FINAL = tuple(".!?…:;。！？\"”»)")


class Node:
    __slots__ = ("tag", "parent", "children", "out", "mark", "within", "core", "points", "chars", "linked", "sentences", "inside")

    def __init__(self, tag: str, parent: Node | None, mark: str = ""):
        self.tag, self.parent, self.children, self.mark = tag, parent, [], mark
        self.within = tag in {"article", "main"} or (parent is not None and parent.within)
        self.out = tag in DROPPED or (tag == "header" and not self.within)
        self.core = self.inside = False
        self.points, self.chars, self.linked, self.sentences = 0.0, 0, 0, 0


def _mark(tag: str, attributes: str) -> str:
    """What class, id and role say against an element: "firm", "loose" or nothing; "core" for what holds an article's body."""
    if "=" not in attributes or tag in DROPPED:
        return ""
    found = ""
    for whole, *values in _NAMED.findall(attributes):
        if whole.lower() == "itemprop" and "".join(values).lower() == "articlebody":
            return "core"
        if tag in WANTED or not (named := _NAMES.fullmatch(whole)):
            continue
        name = named[1]
        for value in "".join(values).split():
            parts = [p.lower() for p in _PARTS.findall(value)]
            for i, part in enumerate(parts):
                if i and parts[i - 1] in {"has", "no", "with", "without"}:
                    continue
                site = part == "header" and name.lower() != "role" and parts in (["header"], ["site", "header"], ["page", "header"])
                if part in FIRM or site:
                    found = "firm"
                elif part in LOOSE and not found and tag in BLOCK:
                    found = "loose"
    return found


def _end(html: str, at: int, stuck: set[int]) -> int:
    """The end of the tag whose name ends at ``at``: the first > outside quoted values, or where there's none the first > at all, or -1.

    Places from which no such > follows are kept in ``stuck``, so a page is read in linear time.
    """
    place, seen = at, []
    while place not in stuck and (piece := _PIECE.match(html, place)):
        place = piece.end()
        if piece[1]:
            return place
        seen.append(place)
    stuck.update(seen)
    return html.find(">", at) + 1 or -1


class Open:
    """The open elements, and where the innermost of each name, of the blocks and of the cells is."""

    def __init__(self, root: Node):
        self.stack, self.at, self.blocks, self.cells = [], {}, [], []
        self.push(root)

    def push(self, node: Node):
        place = len(self.stack)
        self.stack.append(node)
        self.at.setdefault(node.tag, []).append(place)
        if node.tag in BLOCK or node.tag in CELLS:
            self.blocks.append(place)
        if node.tag in CELLS:
            self.cells.append(place)

    def close(self, place: int):
        """End the element at ``place`` and all in it; the root stays."""
        while len(self.stack) > max(place, 1):
            node = self.stack.pop()
            self.at[node.tag].pop()
            for places in (self.blocks, self.cells):
                if places and places[-1] == len(self.stack):
                    places.pop()

    def innermost(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)


def parse(html: str) -> list[Node]:
    """The elements of a page, each before those in it, the root first; text is their leaves.

    Unended elements end with their parent, paragraphs also with the next block.
    """
    root = Node("html", None)
    nodes, opened = [root], Open(root)
    at, end, stuck, last = 0, len(html), set(), html.rfind(">")
    while at < end:
        mark = _MARK.search(html, at)
        while mark and mark[2] and last < mark.end() and not mark[3]:
            mark = _MARK.search(html, mark.end())
        text = html[at : mark.start() if mark else end]
        if not mark and (cut := _UNENDED.search(text)):
            text = text[: cut.start()]
        if text:
            opened.stack[-1].children.append(text)
        if not mark:
            break
        at = mark.end()
        if not mark[2]:
            continue
        attributes = mark[3]
        if not attributes:
            at = _end(html, mark.end(), stuck)
            attributes = html[mark.end() : at]
        tag = mark[2].lower()
        if mark[1]:
            place = opened.innermost([tag])
            beyond = tag not in BLOCK and tag not in SPACED and opened.cells and opened.cells[-1] > place
            if place > 0 and not beyond:
                opened.close(place)
            elif tag == "p" or tag == "br":
                opened.stack[-1].children.append(Node("br", opened.stack[-1]))
            continue
        if tag == "html":
            continue
        if (tag in BLOCK or tag in CELLS) and opened.stack[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])
        if ended := ENDS.get(tag):
            scope = opened.innermost({"table"} if "td" in ended else SCOPE)
            while (place := opened.innermost(ended)) > scope:
                opened.close(place)
        node = Node(tag, opened.stack[-1], _mark(tag, attributes))
        opened.stack[-1].children.append(node)
        nodes.append(node)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else end
        elif tag not in VOID and (not attributes.endswith("/>") or tag in {"p", "div", "a", "li"}):
            opened.push(node)
    return nodes


def _leave_out(nodes: list[Node], firm: bool):
    """Mark what goes by element and, if ``firm``, by a telling word."""
    articles = [n for n in nodes if n.tag == "article"]
    for node in reversed(nodes):
        node.core |= node.tag == "main" or node.mark == "core" or (node.tag == "article" and len(articles) == 1)
        if node.mark == "firm" and firm and not node.core:
            node.out = True
        if node.parent is not None and not node.out:
            node.parent.core |= node.core
    for node in nodes[1:]:
        node.out |= node.parent.out


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(innermost block element, text, characters in links) of each block, in the order of the page."""
    out, pieces, linked = [], [], [0]

    def flush(owner: Node):
        if pieces:
            text = " ".join(_html.unescape("".join(pieces)).split())
            if text:
                out.append((owner, text, min(linked[0], len(text))))
            pieces.clear()
        linked[0] = 0

    stack: list = [(root, root, False, iter(root.children))]
    while stack:
        node, owner, link, rest = stack[-1]
        for child in rest:
            if isinstance(child, str):
                pieces.append(child)
                linked[0] += len(" ".join(child.split())) if link else 0
            elif not child.out:
                if child.tag in BLOCK:
                    flush(owner)
                    stack.append((child, child, link, iter(child.children)))
                else:
                    if child.tag in SPACED:
                        pieces.append(" ")
                    stack.append((child, owner, link or child.tag == "a", iter(child.children)))
                break
            elif child.tag in BLOCK:
                flush(owner)
        else:
            stack.pop()
            if node.tag in BLOCK:
                flush(node)
            elif node.tag in SPACED:
                pieces.append(" ")
    return out


def _weigh(nodes: list[Node], blocks: list[tuple[Node, str, int]]):
    """Points, characters, linked characters and sentences of each element, with those of what is in it."""
    for owner, text, linked in blocks:
        owner.chars += len(text)
        owner.linked += linked
        running = owner.tag not in HEADS
        owner.sentences += running and 2 * linked < len(text) and (text.endswith(FINAL) or len(text) >= 80)
        points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * running * (1 - linked / len(text))
        (owner if owner.tag in HOLDERS else owner.parent or owner).points += points
    for node in reversed(nodes):
        if node.mark == "loose" and not node.out:
            if not node.core and (not node.sentences or 2 * node.linked >= node.chars):
                node.out = True
                continue
            node.points /= 2
        if node.parent is not None and not node.out:
            above = node.parent
            above.points += node.points / 2
            above.chars, above.linked, above.sentences = above.chars + node.chars, above.linked + node.linked, above.sentences + node.sentences
    for node in nodes[1:]:
        node.out |= node.parent.out


def extract(html: str | None) -> str:
    """The main text of one page; null, empty and textless pages give an empty text."""
    for firm in (True, False):  # a page that is nothing but what goes by a word is read without such words
        nodes = parse(html or "")
        _leave_out(nodes, firm)
        blocks = _blocks(nodes[0])
        if blocks:
            break
    _weigh(nodes, blocks)
    blocks = [x for x in blocks if not x[0].out]
    if not blocks:
        return ""
    score = lambda n: n.points * (1 - n.linked / max(n.chars, 1))
    best = max((n for n in nodes if not n.out and n.chars), key=score)  # the first of equals: the outermost, around the earliest text
    node, outer = best, None
    while node is not None:
        if node.tag in {"article", "main"} and 2 * node.linked < node.chars:
            outer = node if outer is None or outer.tag == "main" else outer
        node = node.parent
    best = outer or best
    least, kept = 0.2 * score(best), [best]
    beside = [x for x in best.parent.children if isinstance(x, Node) and not x.out and x.chars] if best.parent is not None else []
    if outer is None:
        kept += [x for x in beside if score(x) >= max(least, 1) or x.tag in HEADS or (x.tag == "p" and 4 * x.linked < x.chars and x.chars > 80)]
    elif outer.tag == "article":
        kept += [x for x in beside if x.tag == "article" and score(x) >= least]
    for node in kept:
        node.inside = True
    for node in nodes[1:]:
        node.inside |= node.parent.inside
    return "\n".join(text for owner, text, _ in blocks if owner.inside)


def main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` without ``html``, with its main text in ``out``.

    White space within a block is one space, blocks are joined by newlines,
    character references are decoded.  Null and empty pages give an empty text;
    rows stand for themselves, so repeats and ties don't matter; a column named
    ``out``, whatever its case, is replaced.  Each page is read whole, however long, deep or broken.
    """
    kept = [f for f in pages.schema.fields if f.name != html and f.name.lower() != out.lower()]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{out}` string"])

    def run(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], out])

    return pages.select(*[f"`{f.name}`" for f in kept], f"`{html}`").mapInArrow(run, schema)
