"""Main text of raw pages by tree scoring.

Paragraphs pass points (length, commas, discounted by link density) to their ancestors; the best container is kept with
the siblings that score near it. Where an article or main element encloses the best container, that element is the
container: it is how pages mark their text, and headings or short paragraphs outside the best part of it are kept so. Its
siblings then are elements of the same name. Tags and names of menus, forms, notices, comments and the like only lower the
points of what they hold. One that holds the page's article, or, on a page without an article or main element, more than
HOLDER of its points (a form around a whole page), is none of these; menus, footers and comments stay what they are. Inside the chosen container what is named so is
left out; a name that merely contains such a word (`related-work`, `alert-lead`) leaves out nothing but links.

Null or empty html gives an empty string; unclosed tags close where their block does, raw ones at the end; repeated rows
each give their own result; an empty table gives no rows; every column is kept, but one named as the added column is
replaced. Time is linear in the page.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A quoted value may hold >; nothing is tried twice, so broken tags cost no more than whole ones.
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*+(?:=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_SPACE = re.compile(r"\s+")
_RAW = frozenset("script style textarea title iframe xmp".split())  # their text is no markup
_ISLANDS = frozenset("svg math select".split())  # blocks in them end them
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_GONE = _RAW | _ISLANDS | frozenset("noscript template object head nav header footer aside form button menu dialog canvas audio video label fieldset".split())
_BLOCK = frozenset(
    "p div article section main body html h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th blockquote pre figure figcaption address hr center details summary".split()
) | _GONE
_CLOSES_P = _BLOCK - {"head", "label", "button", "noscript", "template", "object"} - _RAW - _ISLANDS
_ITEM = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_ITEM_END = frozenset("ul ol dl table".split())
_NOISE = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer header masthead notice notices cookie cookies consent gdpr popup modal newsletter subscribe signup share sharing social related recommended comment comments commentlist disqus reply replies respond widget toolbar pagination pager copyright disclaimer alert".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog".split())
_PARAGRAPH = frozenset("p pre td blockquote li dd dt h1 h2 h3 h4 h5 h6 div section article main".split())
_HARD = _RAW | _ISLANDS | frozenset("noscript template object head canvas audio video".split())  # no text of the page
#: What may stand beside a word of _NOISE in a name that is all noise.
_PLAIN = frozenset("box block list container wrapper wrap bar section area slot unit site page main top bottom left right global item items link links button buttons content inner outer posts post articles stories module panel first last primary secondary icon icons text thread form group row col js".split())
SIBLING_SHARE = 0.2
LOWER = {"": 1.0, "weak": 0.5, "soft": 0.1, "remarks": 0.01}  # points that are left of a paragraph in an element of this kind
HOLDER = 0.75
_NEVER = frozenset("nav footer aside button menu dialog label".split())  # hold no page
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}


class _Node:
    __slots__ = ("tag", "parent", "kids", "score", "kind", "points", "weight")

    def __init__(self, tag: str, parent: _Node | None, kind: str = ""):
        self.tag, self.parent, self.kids, self.score, self.kind, self.points, self.weight = tag, parent, [], 0.0, kind, 0.0, 1.0


_REMARKS = frozenset("comment comments commentlist disqus reply replies respond".split())
_COMPOUND = re.compile(r"(?:with|has|no|without)[-_](\S+)")


def _noisy(attrs: str) -> str:
    """What an element's attributes make of it: "gone" (hidden), "remarks", "soft", "weak" or nothing."""
    if not attrs or attrs.isspace():
        return ""
    found = ""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            for token in _COMPOUND.sub(" ", value).split():
                words = set(re.split(r"[^a-z0-9]+", token)) - {""}
                if words & _NOISE:
                    kind = "weak" if any(w not in _NOISE and w not in _PLAIN and not w.isdigit() for w in words) else "remarks" if words & _REMARKS else "soft"
                    found = min(found or kind, kind, key=LOWER.get)
        elif name == "role" and value in _ROLES:
            found = min(found or "soft", "soft", key=LOWER.get)
        elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return "gone"
    return found


class _Tree:
    """Open elements, with the places of each name, so that every tag finds its partner at once."""

    def __init__(self):
        self.root = _Node("html", None)
        self.open = [self.root]
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.noise: list[int] = []  # places of open elements whose points are lowered for their names
        self.nodes = [self.root]  # parents before children
        self.marked = False  # whether an article or main element stands anywhere

    def last(self, names) -> int:
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def down(self, node: _Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.open))
        if node.tag in _BLOCK:
            self.blocks.append(len(self.open))
        self.open.append(node)

    def up(self, place: int) -> None:
        """Closes the element at a place and all in it."""
        while len(self.open) > place:
            node = self.open.pop()
            self.where[node.tag].pop()
            if node.tag in _BLOCK:
                self.blocks.pop()
        while self.noise and self.noise[-1] >= place:
            self.noise.pop()

    def begin(self, tag: str, attrs: str) -> None:
        if tag in _CLOSES_P:
            island = self.last(_ISLANDS)
            if island:
                self.up(island)
            if self.blocks and self.open[self.blocks[-1]].tag == "p":
                self.up(self.blocks[-1])
        if tag in _ITEM:
            place = self.last(_ITEM[tag])
            if place > self.last(_ITEM_END):
                while self.open[place - 1].tag in _ITEM[tag]:
                    place -= 1
                self.up(place)
        kind = "gone" if tag in _HARD else _noisy(attrs)
        if kind in ("", "weak") and tag in _GONE:
            kind = "soft"
        if kind in ("soft", "remarks") and tag not in _BLOCK:
            kind = "gone"
        node = _Node(tag, self.open[-1], kind)
        self.open[-1].kids.append(node)
        self.nodes.append(node)
        if tag in ("article", "main") and not kind:
            self.marked = True
            while self.noise:  # a holder of the article is no menu, whatever it is called
                self.open[self.noise.pop()].kind = ""
        if tag not in _VOID and tag not in _RAW and not attrs.endswith("/"):
            if kind == "weak" or kind == "soft" and (tag == "form" or tag not in _GONE):
                self.noise.append(len(self.open))
            self.down(node)

    def end(self, tag: str) -> None:
        place = self.last((tag,))
        if place and (tag in _BLOCK or not self.blocks or place > self.blocks[-1]):
            self.up(place)


def _parse(source: str) -> _Tree:
    tree = _Tree()
    at, end, closing = 0, len(source), source.rfind(">")
    text = 0  # where the text not yet taken begins
    endless: set[str] = set()
    while (at := source.find("<", at, closing + 1)) >= 0:
        if source.startswith("<!--", at):
            stop = source.find("-->", at + 4)
            stop, m = (end if stop < 0 else stop + 3), None
        elif source.startswith(("<!", "<?"), at):
            stop, m = source.find(">", at) + 1, None
        elif m := _TAG.match(source, at):
            stop = m.end()
        else:
            at += 1
            continue
        if at > text:
            tree.open[-1].kids.append(source[text:at])
        text = at = stop
        if m is None or m.group(2).lower() in ("html", "body"):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            tree.end(tag)
            continue
        tree.begin(tag, m.group(3) or "")
        if tag in _RAW:
            close = None if tag in endless else _RAW_END[tag].search(source, at)
            if close:
                text = at = close.end()
            elif tag != "iframe" and not m.group(3).endswith("/"):
                text = at = end
            else:
                endless.add(tag)
    if end > text:
        tree.open[-1].kids.append(source[text:])
    return tree


def _blocks(top: _Node) -> list[tuple[_Node, str, int]]:
    """(block, text, characters in links) in page order; text around nested blocks makes blocks of its own."""
    out: list = []
    run: list[str] = []
    state = {"links": 0}

    def flush(owner: _Node) -> None:
        if run:
            text = _SPACE.sub(" ", _html.unescape("".join(run))).strip()
            if text:
                out.append((owner, text, state["links"]))
            run.clear()
            state["links"] = 0

    # (node, next child, owner, inside a link); an explicit stack keeps deep pages from overflowing
    stack = [[top, 0, top, False]]
    while stack:
        frame = stack[-1]
        node, i, owner, linked = frame
        if i == len(node.kids):
            stack.pop()
            if node is owner:
                flush(owner)
            continue
        frame[1] += 1
        kid = node.kids[i]
        if isinstance(kid, str):
            run.append(kid)
            if linked:
                state["links"] += len(kid.strip())
        elif kid.kind == "gone":
            if kid.tag in _BLOCK:
                flush(owner)
        elif kid.tag in ("br", "wbr"):
            run.append(" " if kid.tag == "br" else "")
        elif kid.tag in _BLOCK:
            flush(owner)
            stack.append([kid, 0, kid, linked])
        else:
            stack.append([kid, 0, owner, linked or kid.tag == "a"])
    return out


def extract(source: str | None) -> str:
    """Article text of one page."""
    if not source:
        return ""
    tree = _parse(source)
    root, blocks, points = tree.root, _blocks(tree.root), {}
    for i, (block, text, links) in enumerate(blocks):
        if block.tag in _PARAGRAPH or block.tag in _GONE or block is root:
            points[i] = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - min(links / len(text), 1))
            block.points += points[i]
    for node in reversed(tree.nodes[1:]):
        if node.kind != "remarks":
            node.parent.points += node.points
    for node in tree.nodes[1:]:
        if node.kind == "soft" and node.tag not in _NEVER and not tree.marked and node.points > HOLDER * root.points:
            node.kind = ""
        node.weight = node.parent.weight * LOWER.get(node.kind, 1.0)
    scored = []
    for i, (block, text, links) in enumerate(blocks):
        if i in points:
            up, share = block if block.tag in ("div", "section", "article", "main") else block.parent or block, 1.0
            while up is not None and share > 0.1:
                if not up.score:
                    scored.append(up)
                up.score += points[i] * share * block.weight
                up, share = up.parent, share / 2
    if not scored:
        return ""
    best = max(scored, key=lambda n: n.score)
    article = best
    while article is not None and article.tag not in ("article", "main"):
        article = article.parent
    if article is not None:
        keep = {id(article)}
        if article.parent is not None:
            for kid in article.parent.kids:
                if isinstance(kid, _Node) and kid.tag == article.tag and kid.kind in ("", "weak") and kid.score >= max(SIBLING_SHARE * article.score, 1):
                    keep.add(id(kid))
    else:
        keep = {id(best)}
        if best.parent is not None:
            for kid in best.parent.kids:
                if isinstance(kid, _Node) and kid.kind in ("", "weak") and kid.score >= max(SIBLING_SHARE * best.score, 3):
                    keep.add(id(kid))
            for block, text, links in blocks:
                if block.parent is best.parent and block.kind in ("", "weak") and block.tag in ("p", "h1", "h2", "pre", "blockquote") and links < len(text) / 4:
                    keep.add(id(block))
    kept = []
    inside: dict[int, str] = {}  # of elements seen: "" outside, else kept, or kept but for its links
    for block, text, links in blocks:
        chain, up = [], block
        while up is not None and id(up) not in inside and id(up) not in keep:
            chain.append(up)
            up = up.parent
        at = "" if up is None else inside.get(id(up), "kept")
        for node in reversed(chain):
            at = "" if node.kind in ("soft", "remarks") else "prose" if at and node.kind == "weak" else at
            inside[id(node)] = at
        if at == "kept" or at == "prose" and links < len(text) / 4:
            kept.append(text)
    return "\n\n".join(kept)


def extract_main_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """Adds the article text of html_col; pages are independent, so nothing is shuffled."""

    @F.pandas_udf("string")
    def main_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda h: extract(None if h is None or h != h else h))

    return pages.withColumn(out, main_text(F.col(html_col)))
