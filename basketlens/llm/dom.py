"""A small DOM of block elements and text blocks, and their features.

Only what extraction needs: block-level elements become nodes, inline elements only mark link
text, and each run of text between block borders becomes a leaf.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import numpy as np

_NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
# The rest of a tag: quoted values may hold the signs that end it.
_INSIDE = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_END_TAG = {
    name: re.compile(rf"</{name}\b[^>]*>", re.I)
    for name in "script style textarea title noscript iframe template svg math object button".split()
}
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACES = re.compile(r"[ \t-\r   \u0085]+")

# Element names of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "html body article aside section main nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead"
    " tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset address details summary hgroup"
    " menu dialog center option select".split()
)
HIDDEN = set("script style noscript template svg math iframe object head title textarea".split())
RAW = set("script style textarea title noscript iframe template".split())
CLOSES_P = BLOCK - {"html", "body", "td", "th", "li", "dd", "dt", "tr", "tbody", "thead", "option"}
SAME = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

# Groups of attribute tokens, and element names that mean the same.
GROUPS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toc tabs skip",
    "header": "header head masthead banner topbar logo branding hero site title",
    "footer": "footer foot copyright legal colophon bottom imprint",
    "side": "sidebar side aside widget related recommended more popular trending rail complementary secondary links",
    "comment": "comment comments reply replies respond discussion disqus feedback thread reviews",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner outbrain taboola dfp",
    "notice": "cookie cookies consent gdpr notice notices alert alertdialog popup modal newsletter subscribe signup warning overlay message",
    "form": "form search login contact field input register",
    "share": "share sharing social follow facebook twitter author byline meta tags tag date",
    "content": "article content post entry story body main text articlebody blog news document page prose",
}
_GROUP_OF: dict[str, list[int]] = {}
for _i, _names in enumerate(GROUPS.values()):
    for _name in _names.split():
        _GROUP_OF.setdefault(_name, []).append(_i)
TAG_GROUPS = [
    {"article"}, {"main"}, {"section"}, {"div"}, {"p"}, {"h1"}, {"h2", "h3", "h4", "h5", "h6"}, {"ul", "ol", "menu", "dl"},
    {"li", "dt", "dd"}, {"table", "thead", "tbody", "tr", "td", "th", "caption"}, {"blockquote", "pre", "figure", "figcaption"},
    {"nav"}, {"header"}, {"footer"}, {"aside"}, {"form", "fieldset", "select", "option", "dialog", "details"}, {"#text"},
    {"html", "body"},
]
_TAG_GROUP = {name: i for i, names in enumerate(TAG_GROUPS) for name in names}
# Counts and lengths beyond these are as good as these: pages may be longer than any that trees were fitted on.
MOST_DEPTH, MOST_SIBLINGS, MOST_TEXT = 12, 24, 4000
FEATURES = 2 * len(TAG_GROUPS) + 2 * len(GROUPS) + 18


class Node:
    __slots__ = ("tag", "parent", "children", "groups", "text", "links", "tags", "inputs", "depth", "blocks", "label", "at")

    def __init__(self, tag: str, parent: Node | None, groups: tuple[int, ...] = ()):
        self.tag, self.parent, self.groups = tag, parent, groups
        self.children: list[Node] = []
        self.text = ""
        self.links = self.tags = self.inputs = self.blocks = 0
        self.depth = parent.depth + 1 if parent else 0
        self.label = 0
        self.at = 0
        if parent:
            parent.children.append(self)


def _groups(attributes: str) -> tuple[int, ...]:
    if not attributes:
        return ()
    out: set[int] = set()
    for value in _NAMES.findall(attributes):
        for token in _WORD.findall(value.lower()):
            out.update(_GROUP_OF.get(token, ()))
    return tuple(out)


def parse(page: str) -> Node:
    """The tree of a page; text blocks are leaves named #text, decoded and with single spaces."""
    root = Node("html", None)
    # The stack holds (name, node): inline elements have the node of the block around them.
    stack: list[tuple[str, Node]] = [("html", root)]
    held: list[str] = []
    linked = 0
    at, size = 0, len(page)

    def close_block() -> None:
        nonlocal linked
        if held:
            text = _SPACES.sub(" ", "".join(held)).strip(" ")
            if text:
                leaf = Node("#text", stack[-1][1])
                leaf.text, leaf.links = text, min(linked, len(text))
            held.clear()
        linked = 0

    # Open elements by name: whether one is open is known without looking through the stack.
    opened: Counter[str] = Counter()

    def pop_to(depth: int) -> None:
        for name, _ in stack[max(1, depth) :]:
            opened[name] -= 1
        del stack[max(1, depth) :]

    in_link = 0
    # Where a search found nothing it finds nothing further on; each is made once, so a broken page is read once too.
    quotes, last_end = True, page.rfind(">")
    unclosed: set[str] = set()

    def after(name: str, otherwise: int) -> int:
        """Where the element's end tag ends, if it comes at all."""
        if name in unclosed:
            return otherwise
        stop = _END_TAG[name].search(page, at)
        if stop is None:
            unclosed.add(name)
            return otherwise
        return stop.end()

    while at < size:
        sign = page.find("<", at)
        if sign != at:
            stop = size if sign < 0 else sign
            text = page[at:stop]
            at = stop
        else:
            text = None
            begun = _NAME.match(page, at)
            if page.startswith("<!--", at):
                stop = page.find("-->", at + 4)
                at = size if stop < 0 else stop + 3
                continue
            if at > last_end:
                # Nothing ends a tag from here on: the sign is text.
                text, at = "<", at + 1
            elif begun is None:
                if page[at + 1] in "!?":
                    at = page.find(">", at) + 1
                    continue
                text, at = "<", at + 1
        if text is not None:
            piece = entities.unescape(text) if "&" in text else text
            held.append(piece)
            if in_link:
                linked += len(piece.strip())
            continue
        closing, name = begun.groups()
        inside = _INSIDE.match(page, begun.end()) if quotes else None
        if inside is None:
            # A quote that never ends: from here on quotes mean nothing.
            quotes = False
            stop = page.find(">", begun.end()) + 1
        else:
            stop = inside.end()
        attributes, at = page[begun.end() : stop - 1], stop
        name = name.lower()
        top = stack[-1][1]
        if closing:
            if name == "a":
                in_link = 0
            if name == "p" and not opened["p"]:
                close_block()
                continue
            if opened[name]:
                k = len(stack) - 1
                while stack[k][0] != name:
                    k -= 1
                close_block()
                pop_to(k)
            continue
        if name == "br":
            held.append("\n")
        elif name == "hr":
            close_block()
        elif name in ("input", "button", "select", "textarea"):
            top.inputs += 1
        elif name == "a":
            in_link = 1
        if name in HIDDEN:
            if name in RAW and not attributes.endswith("/"):
                at = after(name, size)
            elif name != "head" and not attributes.endswith("/"):
                at = after(name, at)
            continue
        if name == "button":
            at = after(name, at)
            continue
        if name in VOID or name not in BLOCK:
            top.tags += 1
            continue
        close_block()
        in_link = 0
        if name == "html" or (name == "body" and opened[name]):
            continue
        if name in CLOSES_P and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in ("td", "th", "li", "dd", "blockquote", "div", "article", "section", "main"):
                    break
        if name in SAME and any(opened[n] for n in SAME[name][0]):
            close, border = SAME[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in border:
                    break
                if stack[k][0] in close:
                    pop_to(k)
                    if name not in ("tr",):
                        break
        node = Node(name, stack[-1][1], _groups(attributes))
        stack.append((name, node))
        opened[name] += 1
    close_block()
    return root


def nodes_of(root: Node) -> list[Node]:
    """Nodes in page order, parents before children."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def features(nodes: list[Node]) -> np.ndarray:
    """One row of numbers for each node, parents first."""
    n = len(nodes)
    own = np.array([[len(x.text), x.links, x.tags + 1, x.inputs, x.tag == "#text", len(x.text.split())] for x in nodes], float)
    total = own.copy()
    for i, node in enumerate(nodes):
        node.at = i
    for i in range(n - 1, 0, -1):
        total[nodes[i].parent.at] += total[i]
    before = np.cumsum(own[:, 0]) - own[:, 0]
    everything = max(1.0, total[0, 0])
    out = np.zeros((n, FEATURES))
    t, g = len(TAG_GROUPS), len(GROUPS)
    for i, node in enumerate(nodes):
        tag = _TAG_GROUP[node.tag] if node.tag in _TAG_GROUP else 3
        out[i, tag] = 1
        for k in node.groups:
            out[i, 2 * t + k] = 1
        up = node.parent
        if up is None:
            continue
        p = up.at
        out[i, t : 2 * t] = np.maximum(out[p, t : 2 * t], out[p, :t])
        out[i, 2 * t + g : 2 * t + 2 * g] = np.maximum(out[p, 2 * t + g : 2 * t + 2 * g], out[p, 2 * t : 2 * t + g])
        rest = out[i, 2 * (t + g) :]
        siblings = len(up.children)
        rest[0] = min(node.depth, MOST_DEPTH)
        rest[1] = min(siblings, MOST_SIBLINGS)
        rest[2] = min(total[p, 0], MOST_TEXT)
        rest[3] = total[p, 1] / max(1.0, total[p, 0])
        rest[4] = sum(1 for c in up.children if c.tag == node.tag) if siblings <= MOST_SIBLINGS else MOST_SIBLINGS
    rest = out[:, 2 * (t + g) :]
    length = np.maximum(1.0, total[:, 0])
    rest[:, 5] = np.minimum(total[:, 0], MOST_TEXT)
    rest[:, 6] = total[:, 1] / length
    rest[:, 7] = total[:, 0] / total[:, 2]
    rest[:, 8] = np.minimum(total[:, 3], MOST_SIBLINGS)
    rest[:, 9] = np.minimum(total[:, 4], MOST_SIBLINGS)
    rest[:, 10] = np.minimum(total[:, 5], MOST_TEXT)
    # A block's share of the page says less the longer the page.
    rest[:, 11] = total[:, 0] / min(everything, MOST_TEXT)
    rest[:, 12] = before / everything
    rest[:, 13] = total[:, 0] / np.maximum(1.0, total[:, 4])
    rest[:, 14] = own[:, 0]
    rest[:, 15] = [sum(x.text.count(c) for c in ".!?,;") for x in nodes]
    rest[:, 16] = rest[:, 15] / np.maximum(1.0, own[:, 5])
    rest[:, 17] = ["©" in x.text[:200] or "|" in x.text[:200] for x in nodes]
    return out
