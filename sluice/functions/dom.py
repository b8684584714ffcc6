"""A small HTML tree and a CSS selector engine, for use inside Arrow functions.

The tree follows the HTML parsing rules that matter for data pages: void and raw-text elements, implied head and
body, implied end tags, and unclosed formatting elements that carry over into the next block.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import escape, unescape
from weakref import WeakValueDictionary

#: White space of JavaScript's trim and \s (fixed value).
JS_SPACE = "\t\n\v\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "xmp", "iframe", "noembed", "noframes"])
ESCAPABLE = frozenset(["title", "textarea"])
IN_HEAD = frozenset("base link meta title style script noscript template".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section summary table ul li dd dt".split()
)
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: Open elements that a start tag closes, and where looking for them stops.
IMPLIED = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th"]), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = frozenset(["table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"])
P_SCOPE = frozenset(["table", "td", "th", "caption", "html", "body", "button", "template"])
TAG = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|$)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def js_trim(text: str) -> str:
    return text.strip(JS_SPACE)


#: Kinds of nodes that are text: with references, and raw. Elements' kinds are above them, the document's the first.
TEXT, RAW_TEXT, DOCUMENT = 0, 1, 2
#: Longest attributes of a tag, and longest page, that are kept once they are parsed.
KEPT_ATTRIBUTES, KEPT_PAGE = 400, 1 << 20


def _parsed(raw: str) -> dict[str, str]:
    attrs: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        attrs.setdefault(name.lower(), unescape(a or b or c))
    return attrs


_parsed_once = lru_cache(maxsize=4096)(_parsed)


class Tree:
    """A document as numbers: its nodes in document order, so that what is below one follows it up to ``end``.

    A node takes 20 bytes: its kind, the node above it, its end, and where in the page its attributes or text stand. These
    are read from the page when they are asked for.
    """

    __slots__ = ("html", "names", "kinds", "kind", "up", "end", "lo", "hi", "own", "unread", "views", "said")

    def __init__(self, html: str):
        self.html = html
        self.names, self.kinds = ["#text", "#raw"], {}
        self.kind, self.up, self.end, self.lo, self.hi = array("i"), array("i"), array("i"), array("I"), array("I")
        self.own: dict[int, dict[str, str]] = {}  # attributes that several tags gave
        self.number("#document")
        self.unread = frozenset(map(self.number, ("script", "style")))
        self.views: WeakValueDictionary[int, Node] = WeakValueDictionary()
        self.said: dict[str, bool] = {}

    def number(self, tag: str) -> int:
        """The kind of elements of this tag."""
        found = self.kinds.get(tag)
        if found is None:
            found = self.kinds[tag] = len(self.names)
            self.names.append(tag)
        return found

    def add(self, kind: int, up: int, lo: int = 0, hi: int = 0) -> int:
        self.kind.append(kind)
        self.up.append(up)
        self.lo.append(lo)
        self.hi.append(hi)
        return len(self.kind) - 1

    def close(self) -> None:
        """Find where each node ends, now that all are known."""
        self.end = end = array("i", range(1, len(self.kind) + 1))
        up = self.up
        for k in range(len(end) - 1, 0, -1):
            if end[up[k]] < end[k]:
                end[up[k]] = end[k]

    def node(self, k: int) -> Node:
        """The same object for the same node, as long as someone holds it."""
        found = self.views.get(k)
        if found is None:
            found = self.views[k] = Node(self, k)
        return found

    def below(self, k: int) -> Iterator[int]:
        """Children, texts too."""
        end, stop = self.end, self.end[k]
        k += 1
        while k < stop:
            yield k
            k = end[k]

    def elements(self, k: int) -> list[int]:
        kind = self.kind
        return [c for c in self.below(k) if kind[c] > RAW_TEXT]

    def tags(self, k: int) -> list[int]:
        """Children that are elements other than scripts and styles."""
        kind, unread = self.kind, self.unread
        return [c for c in self.below(k) if kind[c] > RAW_TEXT and kind[c] not in unread]

    def attrs(self, k: int) -> dict[str, str]:
        if k in self.own:
            return self.own[k]
        lo, hi = self.lo[k], self.hi[k]
        return {} if lo >= hi else _parsed_once(self.html[lo:hi]) if hi - lo <= KEPT_ATTRIBUTES else _parsed(self.html[lo:hi])

    def string(self, k: int) -> str:
        """What a text says."""
        raw = self.html[self.lo[k] : self.hi[k]]
        return raw if self.kind[k] == RAW_TEXT else unescape(raw)

    def text(self, k: int) -> str:
        kind, unread, stop, out = self.kind, self.unread, self.end[k], []
        k += 1
        while k < stop:
            if kind[k] <= RAW_TEXT:
                out.append(self.string(k))
            elif kind[k] in unread:
                k = self.end[k]
                continue
            k += 1
        return "".join(out)

    def mentions(self, name: str) -> bool:
        """Whether the page holds the word at all; if not, no element has an attribute of this name."""
        found = self.said.get(name)
        if found is None:
            found = self.said[name] = re.search(re.escape(name), self.html, re.I) is not None
        return found


class Node:
    """An element, as a view of the tree. ``children`` holds elements and strings."""

    __slots__ = ("tree", "at", "__weakref__")

    def __init__(self, tree: Tree, at: int):
        self.tree, self.at = tree, at

    @property
    def tag(self) -> str:
        return self.tree.names[self.tree.kind[self.at]]

    @property
    def attrs(self) -> dict[str, str]:
        return self.tree.attrs(self.at)

    @property
    def parent(self) -> Node | None:
        return self.tree.node(self.tree.up[self.at]) if self.at else None

    @property
    def children(self) -> list[Node | str]:
        out: list[Node | str] = []
        for k in self.tree.below(self.at):
            if self.tree.kind[k] > RAW_TEXT:
                out.append(self.tree.node(k))
            elif out and isinstance(out[-1], str):
                out[-1] += self.tree.string(k)
            else:
                out.append(self.tree.string(k))
        return out

    @property
    def is_tag(self) -> bool:
        """Scripts and styles are nodes of other kinds."""
        return self.tree.kind[self.at] not in self.tree.unread

    def elements(self) -> list[Node]:
        return [self.tree.node(k) for k in self.tree.elements(self.at)]

    def descendants(self) -> Iterator[Node]:
        kind = self.tree.kind
        return (self.tree.node(k) for k in range(self.at + 1, self.tree.end[self.at]) if kind[k] > RAW_TEXT)

    def text(self) -> str:
        return self.tree.text(self.at)

    def raw_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def get(self, name: str) -> str | None:
        return self.attrs.get(name)

    def classes(self) -> list[str]:
        return (self.attrs.get("class") or "").split()

    def closest(self, selector: str) -> Node | None:
        fits, k = compiled(selector).fits, self.at
        while k > 0:
            if fits(self.tree, k):
                return self.tree.node(k)
            k = self.tree.up[k]
        return None

    def html(self) -> str:
        attrs = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        if self.tag in VOID:
            return f"<{self.tag}{attrs}>"
        raw = self.tag in RAW
        inner = "".join(c.html() if isinstance(c, Node) else c if raw else escape(c, quote=False) for c in self.children)
        return f"<{self.tag}{attrs}>{inner}</{self.tag}>"


def parse(html: str | None) -> Node:
    """The document of an HTML text; it always has html, head and body."""
    return _Builder(html or "").tree.node(0)


@lru_cache(maxsize=8)
def _kept(html: str) -> Node:
    return parse(html)


def parse_cached(html: str) -> Node:
    """Like ``parse``; the last small pages are kept, large ones are not."""
    return _kept(html) if len(html) <= KEPT_PAGE else parse(html)


class _Builder:
    """Reads a page into a tree. What is open is a chain, each inside the one before, and only its last gets children;
    the head gets none once the body has one, so nodes come in document order."""

    def __init__(self, html: str):
        self.tree = Tree(html)
        self.tree.add(DOCUMENT, -1)
        self.root = self._add(0, "html")
        self.head = self._add(self.root, "head")
        self.body = -1  # made when it is first needed, behind all of the head
        self.given: dict[str, dict[str, str]] = {"html": {}, "head": {}, "body": {}}
        self.open: list[int] = []
        self.formatting: list[int] = []
        self.in_body = False
        self._read(html)
        self._body()
        self.tree.own = {k: self.given[t] for k, t in ((self.root, "html"), (self.head, "head"), (self.body, "body")) if self.given[t]}
        self.tree.close()

    def _add(self, parent: int, tag: str, lo: int = 0, hi: int = 0) -> int:
        return self.tree.add(self.tree.number(tag), parent, lo, hi)

    def _tag(self, node: int) -> str:
        return self.tree.names[self.tree.kind[node]]

    def _body(self) -> int:
        if self.body < 0:
            self.body = self._add(self.root, "body")
        return self.body

    def _top(self) -> int:
        return self.open[-1] if self.open else self._body() if self.in_body else self.head

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = TAG.search(html, at)
            self._text(at, m.start() if m else end)
            if not m:
                return
            at = m.end()
            if m["name"] is None:
                continue
            tag = m["name"].lower()
            if m["end"]:
                self._close(tag)
                continue
            self._start(tag, *m.span("rest"))
            if tag in RAW or tag in ESCAPABLE:
                close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                stop = close.start() if close else end
                if stop > at:
                    self.tree.add(RAW_TEXT if tag in RAW else TEXT, self.open[-1], at, stop)
                at = close.end() if close else end
                self.open.pop()

    def _text(self, lo: int, hi: int) -> None:
        if lo >= hi:
            return
        if not self.in_body or self.formatting:
            blank = not unescape(self.tree.html[lo:hi]).strip()
            if not self.in_body and not self.open:
                if blank:
                    return
                self.in_body = True
            if self.in_body and not blank:
                self._reconstruct()
        self.tree.add(TEXT, self._top(), lo, hi)

    def _reconstruct(self) -> None:
        for k, old in enumerate(self.formatting):
            if old not in self.open:
                new = self.tree.add(self.tree.kind[old], self._top(), self.tree.lo[old], self.tree.hi[old])
                self.open.append(new)
                self.formatting[k] = new

    def _start(self, tag: str, lo: int, hi: int) -> None:
        if tag in self.given:
            for k, v in _parsed(self.tree.html[lo:hi]).items():
                self.given[tag].setdefault(k, v)
            if tag == "body":
                self.in_body = True
                self.open = [n for n in self.open if self.tree.up[n] != self.head]
            return
        if not self.in_body and not self.open and tag not in IN_HEAD:
            self.in_body = True
        if tag in CLOSES_P:
            self._close_until(frozenset(["p"]), P_SCOPE)
        if tag in IMPLIED:
            closing, stop = IMPLIED[tag]
            while self._close_until(closing, stop):
                pass
        if tag in HEADINGS and self.open and self._tag(self.open[-1]) in HEADINGS:
            self.open.pop()
        if tag == "a":
            for old in [n for n in self.formatting if self._tag(n) == "a"]:
                self._close("a")
                if old in self.formatting:
                    self.formatting.remove(old)
        if self.in_body and tag not in CLOSES_P and tag not in IMPLIED and tag not in RAW:
            self._reconstruct()
        node = self._add(self._top(), tag, lo, hi)
        if tag in VOID:
            return
        self.open.append(node)
        if tag in FORMATTING:
            self.formatting.append(node)

    def _close_until(self, tags: frozenset[str], stop: frozenset[str]) -> bool:
        for k in range(len(self.open) - 1, -1, -1):
            tag = self._tag(self.open[k])
            if tag in tags:
                del self.open[k:]
                return True
            if tag in stop:
                return False
        return False

    def _close(self, tag: str) -> None:
        if tag == "head":
            self.open = []
            return
        if tag in ("html", "body"):
            return
        if tag == "p" and not any(self._tag(n) == "p" for n in self.open):
            self.in_body = True
            self._add(self._top(), "p")
            return
        if tag in FORMATTING:
            node = next((n for n in reversed(self.formatting) if self._tag(n) == tag), None)
            if node is not None:
                self.formatting.remove(node)
                if node in self.open:
                    del self.open[self.open.index(node):]
                return
        for k in range(len(self.open) - 1, -1, -1):
            own = self._tag(self.open[k])
            if own == tag:
                del self.open[k:]
                return
            if own in ("table", "td", "th", "caption") and tag not in TABLE_PARTS:
                return  # an end tag inside a cell closes nothing around the table


# CSS selectors.


class SelectorError(ValueError):
    """A selector that can't be parsed."""


NAME = r"(?:[-\w\u00a0-\uffff]|\\.)+"
TOKEN = re.compile(
    rf"(?P<space>\s*[>+~,]\s*|\s+)|(?P<tag>\*|{NAME})|#(?P<id>{NAME})|\.(?P<cls>{NAME})"
    rf"|\[\s*(?P<attr>{NAME})\s*(?:(?P<op>[*^$~|!]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<word>[^\s\]]+))\s*(?P<flag>[iIsS])?\s*)?\]"
    rf"|::?(?P<pseudo>[-\w]+)(?P<paren>\()?"
)
Test = Callable[[Tree, int], bool]


def _unescaped(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _argument(text: str, at: int) -> tuple[str, int]:
    """What stands between the bracket before ``at`` and its end, and the place behind that."""
    depth, quote, k = 1, "", at
    while k < len(text):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
            if not depth:
                return text[at:k], k + 1
        k += 1
    raise SelectorError(f"unclosed bracket in {text!r}")


def _siblings(t: Tree, k: int) -> list[int]:
    return t.elements(t.up[k]) if k else [k]


def _same_tag(t: Tree, k: int) -> list[int]:
    return [n for n in _siblings(t, k) if t.kind[n] == t.kind[k]]


def _leads(t: Tree, k: int, alike: bool = False) -> bool:
    """Whether no element of the parent, or none of the same tag, stands before."""
    return not k or next(n for n in t.below(t.up[k]) if t.kind[n] > RAW_TEXT and (not alike or t.kind[n] == t.kind[k])) == k


def _ends(t: Tree, k: int, alike: bool = False) -> bool:
    """Whether no element of the parent, or none of the same tag, stands behind."""
    n, stop = t.end[k], t.end[t.up[k]] if k else 0
    while n < stop:
        if t.kind[n] > RAW_TEXT and (not alike or t.kind[n] == t.kind[k]):
            return False
        n = t.end[n]
    return True


def _nth(argument: str) -> Callable[[int], bool]:
    text = argument.replace(" ", "").lower()
    text = {"odd": "2n+1", "even": "2n"}.get(text, text)
    m = re.fullmatch(r"(?:([+-]?\d*)n)?([+-]?\d+)?", text)
    if not m or not text:
        raise SelectorError(f"not a position: {argument!r}")
    a = 0 if m[1] is None else int(m[1] + "1") if m[1] in ("", "+", "-") else int(m[1])
    b = int(m[2] or 0)
    return lambda k: k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _attribute(name: str, op: str | None, value: str, ignore_case: bool) -> Test:
    name = name.lower()
    if op is None:
        return lambda t, k: name in t.attrs(k)
    want = value.lower() if ignore_case else value
    tests: dict[str, Callable[[str], bool]] = {
        "=": lambda v: v == want,
        "!=": lambda v: v != want,
        "*=": lambda v: bool(want) and want in v,
        "^=": lambda v: bool(want) and v.startswith(want),
        "$=": lambda v: bool(want) and v.endswith(want),
        "~=": lambda v: bool(want) and want in v.split(),
        "|=": lambda v: v == want or v.startswith(f"{want}-"),
    }
    test = tests[op]

    def check(t: Tree, k: int) -> bool:
        v = t.attrs(k).get(name)
        return op == "!=" if v is None else test(v.lower() if ignore_case else v)

    return check


def _pseudo(name: str, argument: str | None) -> Test:
    simple: dict[str, Test] = {
        "first-child": _leads,
        "last-child": _ends,
        "only-child": lambda t, k: _leads(t, k) and _ends(t, k),
        "first-of-type": lambda t, k: _leads(t, k, True),
        "last-of-type": lambda t, k: _ends(t, k, True),
        "only-of-type": lambda t, k: _leads(t, k, True) and _ends(t, k, True),
        "empty": lambda t, k: not any(t.kind[c] > RAW_TEXT or t.string(c) for c in t.below(k)),
        "root": lambda t, k: t.names[t.kind[k]] == "html",
        "checked": lambda t, k: "checked" in t.attrs(k) or "selected" in t.attrs(k),
        "disabled": lambda t, k: "disabled" in t.attrs(k),
        "enabled": lambda t, k: "disabled" not in t.attrs(k),
    }
    if argument is None:
        if name in simple:
            return simple[name]
        raise SelectorError(f"unknown pseudo-class :{name}")
    places: dict[str, tuple[Callable[[Tree, int], list[int]], bool]] = {
        "nth-child": (_siblings, False), "nth-last-child": (_siblings, True), "nth-of-type": (_same_tag, False), "nth-last-of-type": (_same_tag, True),
    }
    if name in places:
        among, back = places[name]
        right = _nth(argument)

        def placed(t: Tree, k: int) -> bool:
            alike = among(t, k)
            return right(len(alike) - alike.index(k) if back else alike.index(k) + 1)

        return placed
    if name in ("not", "is", "where", "matches"):
        inner = compiled(argument).fits
        return (lambda t, k: not inner(t, k)) if name == "not" else inner
    if name == "has":
        direct = argument.strip().startswith(">")
        held = compiled(argument.strip().lstrip("> "))
        return (lambda t, k: any(held.fits(t, c) for c in t.elements(k))) if direct else (lambda t, k: any(True for _ in held.found(t, k)))
    if name == "contains":
        want = argument.strip()
        want = want[1:-1] if len(want) > 1 and want[0] == want[-1] and want[0] in "\"'" else want
        return lambda t, k: want in t.text(k)
    raise SelectorError(f"unknown pseudo-class :{name}()")


class Selector:
    """A selector list: of each its last tag, the attributes that it can't do without, and its parts, signs and tests."""

    def __init__(self, lists: list[tuple[str | None, frozenset[str], list[tuple[str, list[Test]]]]]):
        self.lists = lists

    def fits(self, t: Tree, k: int) -> bool:
        return any(_fits(parts, len(parts) - 1, t, k) for _, _, parts in self.lists)

    def found(self, t: Tree, k: int) -> Iterator[int]:
        """What is below and fits, in document order. Nothing is tried where a tag or an attribute isn't on the page."""
        lists = [(t.kinds.get(tag, -1) if tag else None, parts) for tag, needed, parts in self.lists if (tag is None or tag in t.kinds) and all(map(t.mentions, needed))]
        if not lists:
            return
        kinds = {kind for kind, _ in lists}
        k, stop, kind = k + 1, t.end[k], t.kind
        if len(kinds) == 1 and None not in kinds:
            want = kinds.pop()
            while True:
                try:
                    k = kind.index(want, k, stop)
                except ValueError:
                    return
                if any(_fits(parts, len(parts) - 1, t, k) for _, parts in lists):
                    yield k
                k += 1
        for k in range(k, stop):
            own = kind[k]
            if own > RAW_TEXT and any((tag is None or tag == own) and _fits(parts, len(parts) - 1, t, k) for tag, parts in lists):
                yield k


def _fits(parts: list[tuple[str, list[Test]]], last: int, t: Tree, k: int) -> bool:
    if k <= 0:  # the document
        return False
    sign, tests = parts[last]
    for test in tests:
        if not test(t, k):
            return False
    if last == 0:
        return True
    if sign == ">":
        return _fits(parts, last - 1, t, t.up[k])
    if sign == " ":
        up = t.up[k]
        while up > 0:
            if _fits(parts, last - 1, t, up):
                return True
            up = t.up[up]
        return False
    before = _siblings(t, k)
    before = before[: before.index(k)]
    if sign == "+":
        return bool(before) and _fits(parts, last - 1, t, before[-1])
    return any(_fits(parts, last - 1, t, b) for b in before)


@lru_cache(maxsize=1024)
def compiled(selector: str) -> Selector:
    """A selector list to match with; raises SelectorError."""
    text = selector.strip(JS_SPACE)
    lists: list[list[tuple[str, list[Test]]]] = [[(" ", [])]]
    tags: list[str | None] = [None]
    needed: list[set[str]] = [set()]
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SelectorError(f"can't read {text[at:]!r} in {selector!r}")
        at = m.end()
        tests = lists[-1][-1][1]
        if m["space"] is not None:
            sign = m["space"].strip() or " "
            if not tests:
                raise SelectorError(f"misplaced {sign!r} in {selector!r}")
            if sign == ",":
                lists.append([(" ", [])])
                tags.append(None)
                needed.append(set())
            else:
                lists[-1].append((sign, []))
                tags[-1] = None
        elif m["tag"] is not None:
            if tests:
                raise SelectorError(f"misplaced name in {selector!r}")
            tag = _unescaped(m["tag"]).lower()
            tests.append((lambda t, k: True) if tag == "*" else (lambda t, k, tag=tag: t.names[t.kind[k]] == tag))
            tags[-1] = None if tag == "*" else tag
        elif m["id"] is not None:
            tests.append(lambda t, k, v=_unescaped(m["id"]): t.attrs(k).get("id") == v)
            needed[-1].add("id")
        elif m["cls"] is not None:
            tests.append(lambda t, k, v=_unescaped(m["cls"]): v in (t.attrs(k).get("class") or "").split())
            needed[-1].add("class")
        elif m["attr"] is not None:
            value = next((v for v in (m["dq"], m["sq"], m["word"]) if v is not None), "")
            tests.append(_attribute(_unescaped(m["attr"]), m["op"], value, (m["flag"] or "").lower() == "i"))
            if m["op"] != "!=":
                needed[-1].add(_unescaped(m["attr"]).lower())
        else:
            argument = None
            if m["paren"]:
                argument, at = _argument(text, at)
            tests.append(_pseudo(m["pseudo"].lower(), argument))
    if any(not tests for parts in lists for _, tests in parts):
        raise SelectorError(f"incomplete selector {selector!r}")
    return Selector([(tag, frozenset(names), parts) for tag, names, parts in zip(tags, needed, lists)])


def matcher(selector: str) -> Callable[[Node], bool]:
    """A test of nodes for a selector list; raises SelectorError."""
    fits = compiled(selector).fits
    return lambda node: fits(node.tree, node.at)


def each(node: Node, selector: str) -> Iterator[Node]:
    """Descendants that match, in document order; ancestors outside ``node`` count for the match."""
    tree = node.tree
    return map(tree.node, compiled(selector).found(tree, node.at))


def select(node: Node, selector: str) -> list[Node]:
    return list(each(node, selector))


def first(node: Node, selector: str) -> Node | None:
    return next(each(node, selector), None)
