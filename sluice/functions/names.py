"""Which class names carry meaning, and selectors built from names."""

from __future__ import annotations

import re

from sluice.functions.dom import Node

#: Utility prefixes whose classes say nothing about content (fixed values). Blocks reject all of them, fields the first group.
UTILITY = (
    "flex grid gap p px py pt pb pl pr m mx my mt mb ml mr w h min max text font bg border rounded shadow overflow items justify space col row z "
    "top left right bottom opacity cursor transition transform scale rotate translate hidden block inline relative absolute fixed sticky"
).split()
UTILITY_OF_BLOCKS = (
    "inset select pointer duration ease sr not float clear object aspect leading tracking align whitespace break truncate ring outline appearance "
    "resize order grow shrink basis self place content divide display"
).split()
#: Shapes of generated class names (fixed values).
GENERATED = re.compile(r"[a-z]-\d.*|(?i:css|sc)-(?i:[a-z0-9]){4,}|[a-z]{1,3}-[a-zA-Z0-9]{6,}", re.S)


def meaningful(name: str, for_blocks: bool = False) -> bool:
    """Whether a class names what an element is, rather than how it looks."""
    if not name or set(":[]") & set(name):
        return False
    prefix, dash, _ = name.partition("-")
    if dash and (prefix in UTILITY or for_blocks and prefix in UTILITY_OF_BLOCKS):
        return False
    return not GENERATED.fullmatch(name)


def named(node: Node, most: int, for_blocks: bool = False) -> list[str]:
    return [c for c in node.classes() if meaningful(c, for_blocks)][:most]


def by_mark(node: Node, marks: tuple[str, ...]) -> str | None:
    """[attribute="value"] of the first of these attributes that is set."""
    return next((f'[{m}="{node.get(m)}"]' for m in marks if node.get(m)), None)


def block_selector(node: Node) -> str:
    """Names a container: id, test id, item type, classes, or its tag below a named parent."""
    if node.get("id"):
        return f"{node.tag}#{node.get('id')}"
    found = by_mark(node, ("data-testid", "itemtype")) or ".".join([node.tag, *named(node, 3, True)])
    if found != node.tag:
        return found
    parent = node.parent
    if parent is None or parent.tag == "#document" or not parent.is_tag:
        return node.tag
    if parent.get("id"):
        return f"{parent.tag}#{parent.get('id')} > {node.tag}"
    if parent.get("data-testid"):
        return f'[data-testid="{parent.get("data-testid")}"] > {node.tag}'
    classes = named(parent, 2, True)
    return f"{'.'.join([parent.tag, *classes])} > {node.tag}" if classes else node.tag


def item_selector(node: Node, container: Node) -> str:
    own = by_mark(node, ("data-testid", "itemtype")) or ".".join([node.tag, *named(node, 3, True)])
    return f"{block_selector(container)} > {own}"


def relative_selector(node: Node, root: Node) -> str:
    """Names a node inside an item."""
    from sluice.functions.dom import SelectorError, select

    mark = by_mark(node, ("data-testid", "itemprop"))
    if mark:
        return mark
    classes = named(node, 2)
    if classes:
        found = ".".join([node.tag, *classes])
        try:
            if len(select(root, found)) == 1:
                return found
        except SelectorError:
            pass
    alike = [n for n in node.parent.elements() if n.tag == node.tag]
    if len(alike) > 1:
        return f"{node.tag}:nth-of-type({next(k for k, n in enumerate(alike) if n is node) + 1})"
    above = named(node.parent, 2) if node.parent.is_tag else []
    return f"{'.'.join([node.parent.tag, *above])} > {node.tag}" if above else node.tag


def plain_selector(node: Node, tag: str | None = None) -> str:
    return ".".join([tag or node.tag, *node.classes()[:2]])
