"""A tolerant reader of HTML: block nodes with the counts that the node features need, and text runs by node."""

from __future__ import annotations

import re
from html import unescape

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video button select option optgroup datalist textarea title".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}
SCOPES = frozenset("html body table td th caption button object".split())
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}

MARKUP = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z))", re.S)
LOOSE = re.compile(r"<()(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")  # a tag with a quote that nothing closes
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TOKEN = re.compile(r"[a-z]+")
#: Attributes that hide an element and all in it.
VEIL = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)(?!\s*=\s*[\"']?until-found)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*|'[^']*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


class Node:
    """A block element. runs: its own text, in order, with the page-order number of the block that each run lies in."""

    __slots__ = ("tag", "tokens", "parent", "children", "depth", "runs", "tags", "chars", "linked", "words", "stops", "hidden", "links")

    def __init__(self, tag: str, tokens: tuple[str, ...], parent: Node | None) -> None:
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.children: list[Node] = []
        self.depth = parent.depth + 1 if parent else 0
        self.runs: list[tuple[int, str]] = []
        self.tags = self.chars = self.linked = self.words = self.stops = self.links = self.hidden = 0
        if parent:
            parent.children.append(self)


def tokens_of(attributes: str) -> tuple[str, ...]:
    """Words of class, id, role and the like, lower-cased and cut at case changes and signs."""
    found: list[str] = []
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label", "data-role", "data-component"):
            value = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", next((v for v in values if v), ""))
            found += TOKEN.findall(value.lower())
    return tuple(found)


def read(html: str) -> list[Node]:
    """The block nodes of a page in document order; the first is a root without a tag."""
    root = Node("", (), None)
    nodes, stack, at, block = [root], [("", root)], 0, 0
    node, dark, anchors = root, 0, 0  # dark: open hidden elements; anchors: open links
    veiled: list[int] = []  # places on the stack of elements that an attribute hides

    def text(raw: str) -> None:
        if dark or not raw:
            return
        s = unescape(raw) if "&" in raw else raw
        node.runs.append((block, s))
        n = len(s) - s.count(" ")
        node.chars += n
        node.words += s.count(" ") + 1 if n else 0
        node.stops += s.count(".") + s.count(",") + s.count("?") + s.count("!")
        if anchors:
            node.linked += n

    def pop(upto: int) -> None:
        nonlocal node, dark, anchors, block
        while len(stack) > upto:
            name, owner = stack.pop()
            if veiled and veiled[-1] == len(stack):
                veiled.pop()
                dark -= 1
            if name in HIDDEN:
                dark -= 1
            elif name == "a":
                anchors -= 1
            elif name in BLOCK:
                block += 1
        node = stack[-1][1]

    def innermost(names: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> int | None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                return i
            if stack[i][0] in stops:
                return None
        return None

    while at < len(html):
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = MARKUP.match(html, lt) or LOOSE.match(html, lt)
        if not m:
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "p" and innermost({"p"}, SCOPES) is None:
                block += 1
            elif (i := innermost({tag}, SCOPES - {tag} if tag in BLOCK else BLOCK)) is not None:
                pop(i)
            continue
        node.tags += 1
        if tag in VOID:
            if tag in ("br", "hr"):
                text(" ")
                block += tag == "hr"
            elif tag == "input":
                node.hidden += 1
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at)
            node.hidden += tag in ("textarea",)
            close = html.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(html)
            continue
        if tag in CLOSES_P and (i := innermost({"p"}, SCOPES)) is not None:
            pop(i)
        if tag in SELF_CLOSING and (i := innermost(*SELF_CLOSING[tag])) is not None:
            # the outermost of the run that the new element ends
            while i > 1 and stack[i - 1][0] in SELF_CLOSING[tag][0]:
                i -= 1
            pop(i)
        if tag in ("html", "body") and any(name == tag for name, _ in stack):
            continue
        if tag == "a":
            if (i := innermost({"a"}, BLOCK)) is not None:
                pop(i)
            anchors += 1
            node.links += 1
        if tag in HIDDEN:
            dark += 1
            node.hidden += tag in ("select", "button")
        node.hidden += tag == "label"
        if tag in BLOCK:
            block += 1
            node = Node(tag, tokens_of(m[4]) if m[4] else (), node)
            nodes.append(node)
        if m[4].endswith("/") and tag not in BLOCK:
            if tag in HIDDEN:
                dark -= 1
            anchors -= tag == "a"
            continue
        if m[4] and VEIL.search(m[4]) and tag not in ("html", "body"):
            veiled.append(len(stack))
            dark += 1
        stack.append((tag, node))
    return nodes


def blocks(nodes: list[Node], kept: list[bool]) -> str:
    """The kept nodes' text: white space made one space, blocks trimmed and joined by two line ends."""
    by: dict[int, list[str]] = {}
    for node, keep in zip(nodes, kept, strict=True):
        if keep:
            for block, s in node.runs:
                by.setdefault(block, []).append(s)
    out = (" ".join("".join(by[b]).split()) for b in sorted(by))
    return "\n\n".join(x for x in out if x)
