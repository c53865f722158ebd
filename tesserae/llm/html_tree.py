"""A small tree of an HTML page: its text blocks in order, and the containers that score as the main body."""

from __future__ import annotations

import re
from html import unescape

_TOKEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|([^<]+)|<", re.S)
_CLASS = re.compile(r"class\s*=\s*[\"']?([^\"'>]+)")
# Elements by their part in a page.
VOID = frozenset("br hr img meta link input area base col embed source track wbr".split())
INLINE = frozenset("a b i u em strong span font small big code tt sub sup mark abbr cite q s del ins label".split())
PARAGRAPH = frozenset("p pre blockquote td dd".split())
LANDMARK = frozenset("nav footer aside header form menu".split())
# An open element of the first kind ends where one of the others begins.
ENDS_AT = {
    "p": frozenset("p div table ul ol pre blockquote h1 h2 h3 h4 h5 h6 article section nav footer aside header li td tr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"]),
}
SIBLING_SHARE = 0.2


class Node:
    __slots__ = ("children", "direct", "name", "parent", "score", "text", "linked", "small", "words")

    def __init__(self, name: str, label: str, parent: Node | None) -> None:
        self.name, self.words, self.parent = name, label, parent
        self.children: list[Node] = []
        self.score, self.direct = 0.0, False
        self.text, self.linked, self.small = 0, 0, 0


class Block:
    """A run of text inside one block element; small: characters in font or small elements."""

    __slots__ = ("linked", "name", "node", "small", "text")

    def __init__(self, text: str, name: str, node: Node, linked: int, small: int) -> None:
        self.text, self.name, self.node, self.linked, self.small = text, name, node, linked, small


def parse(html: str) -> list[Block]:
    """The page's text blocks in document order."""
    root = node = Node("body", "", None)
    blocks: list[Block] = []
    parts: list[str] = []
    links = smalls = linked = small = 0

    def flush() -> None:
        nonlocal linked, small
        text = unescape("".join(parts)).strip()
        if text:
            blocks.append(Block(text, node.name, node, linked, small))
            at = node
            while at is not None:
                at.text += len(text)
                at.linked += linked
                at.small += small
                at = at.parent
        parts.clear()
        linked = small = 0

    start = html.find("<body")
    for m in _TOKEN.finditer(html, max(0, start)):
        if (text := m[5]) is not None:
            parts.append(text)
            n = len(text.strip())
            if links:
                linked += n
            if smalls:
                small += n
            continue
        if m[3] is None:
            if m[0] == "<":
                parts.append("<")
            continue
        name = m[3].lower()
        if name in INLINE:
            step = -1 if m[2] else 1
            if name == "a":
                links = max(0, links + step)
            elif name in ("font", "small"):
                smalls = max(0, smalls + step)
            continue
        if name == "br":
            flush()
            continue
        if name in VOID or name == "body":
            continue
        flush()
        if m[2]:
            at = node
            while at is not None and at.name != name:
                at = at.parent
            if at is not None and at.parent is not None:
                node = at.parent
        else:
            while name in ENDS_AT.get(node.name, ()) and node.parent is not None:
                node = node.parent
            label = _CLASS.search(m[4])
            child = Node(name, label[1] if label else "", node)
            node.children.append(child)
            node = child
    flush()
    return blocks


def points(block: Block) -> float:
    """What a paragraph passes on: one, one for each comma, one for each hundred characters up to three, less its links."""
    text = block.text
    loose = 1 - min(1.0, (block.linked + block.small) / len(text))
    return (1 + text.count(",") + text.count("、") + min(len(text) // 100, 3)) * loose


def main_body(blocks: list[Block]) -> list[bool]:
    """For each block, whether it lies in the best container or a sibling that goes with it."""
    scored: dict[int, Node] = {}

    def give(node: Node | None, n: float) -> None:
        if node is not None:
            node.score += n
            scored[id(node)] = node

    for b in blocks:
        if len(b.text) < 25 or (b.name not in PARAGRAPH and b.name not in ("li", "div")):
            continue
        n = points(b)
        box = b.node if b.name in ("td", "div") else b.node.parent
        give(box, n)
        if box is not None:
            box.direct = True
            give(box.parent, n / 2)
    for node in scored.values():
        node.score *= 1 - (node.linked + node.small) / max(1, node.text)
        if node.name in LANDMARK:
            node.score = 0.0
    best = max((x for x in scored.values() if x.direct), key=lambda x: x.score, default=None)
    if best is None or best.score <= 0:
        return [False] * len(blocks)
    # the body's pieces are siblings: same label as the best, or a share of its score
    kept = {id(best)}
    around = best.parent.children if best.parent is not None else []
    for node in around:
        density = (node.linked + node.small) / max(1, node.text)
        if node.name in LANDMARK or density > 0.5 or (node.name, node.words) != (best.name, best.words):
            continue
        # a plain div says nothing of its part: it needs points of its own
        if node.name != "div" or node.words or node.score >= SIBLING_SHARE * best.score:
            kept.add(id(node))
    out = []
    for b in blocks:
        at, inside = b.node, False
        while at is not None:
            if at.name in LANDMARK:
                break
            if id(at) in kept:
                inside = True
                break
            at = at.parent
        out.append(inside and (b.linked + b.small) <= 0.5 * len(b.text))
    return out
