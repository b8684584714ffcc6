"""What a page's structure says: repeated blocks, page type, fields, pagination, detail links, rendering need, links.

Everything here works on one parsed page inside an Arrow function; scores and rankings over many rows are native
(see ``sluice.operators.analyze``).
"""

from __future__ import annotations

import json
import math
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

from sluice.functions.dom import JS_SPACE, RAW_TEXT, Node, SelectorError, Tree, compiled, each, first, js_trim, matcher, parse_cached, select
from sluice.functions.names import block_selector, item_selector, plain_selector, relative_selector
from sluice.functions.urls import normalize, parse_url, resolve
from sluice.plans.config import DEFAULTS

LEAST = DEFAULTS["min_repeated_blocks"]
SAMPLE = DEFAULTS["sample_size"]
#: Class names of cards (fixed values).
CARD = re.compile("card|product|item|listing|result|entry", re.I)


def _text(node: Node) -> str:
    return js_trim(node.text())


def _any(node: Node, selector: str) -> bool:
    return first(node, selector) is not None


# Repeated blocks.


def _shape(t: Tree, k: int, depth: int, most: int) -> str:
    if depth >= most or t.kind[k] in t.unread:
        return ""
    below = t.tags(k)
    tag = t.names[t.kind[k]]
    return tag if not below else f"{tag}>{'+'.join(_shape(t, n, depth + 1, most) for n in below)}"


def tag_shape(node: Node, depth: int = 0, most: int = 4) -> str:
    """Tags in pre-order to a depth; what lies at that depth is empty."""
    return _shape(node.tree, node.at, depth, most)


def _depth(t: Tree, k: int, most: int) -> int:
    below = t.tags(k) if most else []
    return 1 + max(_depth(t, n, most - 1) for n in below) if below else 0


def depth_of(node: Node, most: int = 4) -> int:
    return _depth(node.tree, node.at, most)


def fingerprint(node: Node) -> str:
    flags = "".join(str(int(_any(node, s))) for s in ("img", "a[href]", "time", "[itemprop]"))
    return f"{tag_shape(node)}|{len(node.tree.elements(node.at))}|{flags}"


def group_features(nodes: Iterable[Node]) -> dict:
    """What a group's score is made of. Nodes are read once, one at a time."""
    n = links = images = length = itemprops = 0
    head, heads, marks = None, set(), set()
    for x in nodes:
        text = _text(x)
        head, n, length = head or x, n + 1, length + len(text)
        heads.add(text[:100])
        links, images, itemprops = links + _any(x, "a[href]"), images + _any(x, "img"), itemprops + _any(x, "[itemprop]")
        if mark := x.get("data-testid"):
            marks.add(mark)
    parent = head.parent
    return {
        "count": n,
        "links": links / n,
        "images": images / n,
        "variety": len(heads) / n,
        "depth": depth_of(head),
        "length": length / n,
        "article": head.tag == "article",
        "row": head.tag == "tr" and parent.tag in ("tbody", "table"),
        "holds_article": _any(head, "article"),
        "card": bool(CARD.search(head.get("class") or "")),
        "in_footer": head.closest("footer") is not None,
        "footer_class": "footer" in (parent.get("class") or "").lower(),
        "itemprops": itemprops / n,
        "test_ids": len(marks),
    }


def group_score(f: dict) -> float:
    score = 0.3 if f["count"] >= 10 else 0.25 if f["count"] >= 5 else 0.15
    score += 0.2 * (f["links"] > 0.8) + 0.15 * (f["images"] > 0.5) + 0.2 * (f["variety"] > 0.7)
    score += 0.15 if f["depth"] >= 2 else -0.2 if f["depth"] < 1 else 0.0
    score += -0.3 if f["length"] < 5 else 0.1 if f["length"] > 20 else 0.0
    score += 0.2 * f["article"] + 0.25 * f["row"] + 0.15 * f["holds_article"] + 0.15 * f["card"]
    score -= 0.3 * f["in_footer"] + 0.3 * f["footer_class"]
    score += 0.2 * (f["itemprops"] > 0.5) + (0.15 if f["test_ids"] == 1 else 0.1 if f["test_ids"] == 2 else 0.0)
    return min(max(score, 0.0), 1.0)


def _holds(t: Tree, k: int) -> bool:
    """Whether a node other than a script or style has LEAST children of one tag."""
    if t.end[k] - k <= LEAST or t.kind[k] <= RAW_TEXT or t.kind[k] in t.unread:
        return False
    counts = Counter(t.kind[c] for c in t.tags(k))
    return bool(counts) and max(counts.values()) >= LEAST


def repeated_blocks(document: Node) -> list[dict]:
    """Groups of at least three alike children, best first, at most ten."""
    body = first(document, "body")
    tree = document.tree
    # Places of nodes, not nodes: a page may have millions.
    holders = [k for k in range(body.at + 1, tree.end[body.at]) if _holds(tree, k)]
    own = set(holders)
    out = []
    for at in holders:
        if any(k in own for k in tree.elements(at)):
            continue  # a container directly inside is more specific
        holder = tree.node(at)
        groups: dict[str, array[int]] = {}
        for k in tree.tags(at):
            groups.setdefault(fingerprint(tree.node(k)), array("i")).append(k)
        for shape, places in groups.items():
            if len(places) < LEAST:
                continue
            head = tree.node(places[0])
            selector, above = item_selector(head, holder), block_selector(holder)
            try:
                matcher(selector), matcher(above)
            except SelectorError:
                continue
            score = group_score(group_features(map(tree.node, places)))
            html = head.html()
            if score >= DEFAULTS["block_confidence_threshold"]:
                out.append({"selector": selector, "parent_selector": above, "count": len(places), "sample_html": html if len(html) <= 500 else f"{html[:497]}...", "confidence": score, "fingerprint": shape})
    out.sort(key=lambda b: -(b["confidence"] * 10 + math.log2(b["count"])))
    return out[: DEFAULTS["max_repeated_blocks"]]


# Page type.

#: URLs of lists and of single things, and where pagers are (fixed values).
LIST_URL = re.compile(r"/(products|listings|items|search|category|results|jobs|directory|catalog)\b", re.I)
DETAIL_URL = re.compile(r"/(product|item|listing|job|post|article)/[^/]+$", re.I)
PAGERS = 'nav[aria-label*="pag" i], .pagination, .pager, a[rel="next"]'


def ld_json(document: Node) -> list[object]:
    """Parsed JSON-LD scripts; malformed ones are left out."""
    out = []
    for node in select(document, 'script[type="application/ld+json"]'):
        try:
            out.append(json.loads(node.raw_text() or "{}"))
        except ValueError:
            continue
    return out


def page_type(document: Node, url: str, blocks: list[dict]) -> dict:
    """list, detail, article or unknown: the type with most weight, the earliest of equals."""
    votes: dict[str, float] = {}

    def vote(kind: str, weight: float, when: object = True) -> None:
        if when:
            votes[kind] = votes.get(kind, 0.0) + weight

    vote("list", 0.4, blocks and blocks[0]["count"] >= 5)
    vote("list", 0.2, LIST_URL.search(url or ""))
    vote("detail", 0.25, DETAIL_URL.search(url or ""))
    vote("list", 0.25, _any(document, PAGERS))
    articles = sum(1 for _ in each(document, "article"))
    vote("article", 0.3, articles == 1)
    vote("list", 0.2, articles > 3)
    for data in ld_json(document):
        kind = data.get("@type") if isinstance(data, dict) else None
        vote("list", 0.3, kind in ("ItemList", "SearchResultsPage"))
        vote("detail", 0.3, kind in ("Product", "Article"))
    best = max(votes, key=lambda k: votes[k], default="unknown")
    return {"page_type": best, "type_confidence": min(votes.get(best, 0.0), 1.0)}


# Fields.


def _like_price(text: str) -> bool:
    return bool(re.search(r"[$€£¥₹]|USD|EUR|GBP", text) or re.fullmatch(r"\d[\d,]*\.?\d{0,2}", js_trim(text)))


#: Rules for common fields: name, type, attribute, selectors, test of the value. Order is priority (fixed values).
RULES: list[tuple[str, str, str | None, tuple[str, ...], Callable[[str], bool] | None]] = [
    ("title", "string", None, ('[itemprop="name"]', '[itemprop="headline"]', "h1", "h2", "h3", "h4", '[class*="title"]', '[class*="name"]', '[class*="heading"]'), None),
    ("url", "url", "href", ('[itemprop="url"]', "h1 a[href]", "h2 a[href]", "h3 a[href]", "h4 a[href]", '[class*="title"] a[href]'), None),
    ("image", "image", "src", ('[itemprop="image"]', "img[src]", "img[data-src]", "img[data-lazy-src]", "img[data-original]", "picture img", '[class*="image"] img', '[class*="thumb"] img'), None),
    ("price", "price", None, ('[itemprop="price"]', '[class*="price"]', '[class*="cost"]', '[class*="amount"]'), _like_price),
    ("date", "date", None, ('[itemprop="datePublished"]', '[itemprop="dateCreated"]', "time", "[datetime]", '[class*="date"]', '[class*="time"]', '[class*="published"]', '[class*="posted"]'), None),
    ("description", "string", None, ('[itemprop="description"]', "p", '[class*="desc"]', '[class*="summary"]', '[class*="excerpt"]', '[class*="snippet"]'), lambda t: 30 < len(t) < 1000),
    ("rating", "number", None, ('[class*="rating"]', '[class*="stars"]', '[class*="score"]', '[class*="review"]'), None),
    ("location", "string", None, ('[class*="location"]', '[class*="address"]', '[class*="city"]'), None),
    ("category", "string", None, ('[class*="category"]', '[class*="tag"]', '[class*="label"]'), None),
]
#: Selectors to fall back on, by rule (fixed values).
FALLBACKS = {
    "title": ["h2", "h3", '[class*="title"]'], "price": ['[class*="price"]', '[class*="cost"]'], "image": ["img[src]", "img[data-src]"],
    "date": ["time", "[datetime]", '[class*="date"]'], "url": ["h2 a[href]", "h3 a[href]"],
}
#: JSON-LD paths and the fields they give (fixed values).
LD_FIELDS = [
    ("name", "title", "string"), ("headline", "title", "string"), ("url", "url", "url"), ("image", "image", "image"), ("description", "description", "string"), ("datePublished", "date", "date"),
    ("dateCreated", "date", "date"), ("offers.price", "price", "price"), ("price", "price", "price"), ("ratingValue", "rating", "number"), ("aggregateRating.ratingValue", "rating", "number"),
    ("addressLocality", "location", "string"),
]
OG_FIELDS = {"title": "string", "description": "string", "image": "image", "url": "url"}
#: Names of pictures that aren't content, and shapes of amounts, dates and figures (fixed values).
ICON = re.compile("icon|logo|avatar|badge|sprite|placeholder", re.I)
MONEY = re.compile(r"[$€£¥₹][\s\d,.]|[\d,]+\.?\d{0,2}\s*(?:USD|EUR|GBP|JPY)")
DATE = re.compile(r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b", re.I)
FIGURE = re.compile(r"\d[\d,]*\.?\d{0,2}")


def _distinct(values: Iterable[str], most: int = 5) -> list[str]:
    return list(dict.fromkeys(values))[:most]


def _field(name: str, selector: str, values: list[str], kind: str, score: float, source: str, fallbacks: list[str] | None = None) -> dict:
    return {"name": name, "selector": selector, "fallback_selectors": fallbacks or [], "sample_values": _distinct(values), "inferred_type": kind, "confidence": score, "inference_source": source}


def items_of(document: Node, block: dict, most: int | None = None) -> list[Node]:
    """The block's items, or the first of them: children of the container that has about as many of them as the block counts."""
    above, mark, own = block["selector"].rpartition(" > ")
    above = above if mark else block["parent_selector"]
    tree, fits = document.tree, compiled(own).fits
    best: list[int] = []
    for holder in (n for n in each(document, above) if n.is_tag):
        places = [k for k in tree.elements(holder.at) if fits(tree, k)]
        if abs(len(places) - block["count"]) < abs(len(best) - block["count"]):
            best = places
    found = map(tree.node, best) if best else each(document, block["selector"])
    return list(islice((n for n in found if n.is_tag), most))


def ld_fields(document: Node) -> list[tuple[str, str, str, str]]:
    """name, value, type and source of every text that JSON-LD items give."""
    out = []
    for data in ld_json(document):
        for item in data if isinstance(data, list) else [data]:
            kind = item.get("@type") if isinstance(item, dict) else None
            if not kind:
                continue
            for path, name, type_ in LD_FIELDS:
                value: object = item
                for part in path.split("."):
                    value = value.get(part) if isinstance(value, dict) else None
                if isinstance(value, str) and value:
                    out.append((name, value, type_, f"{kind}.{path}"))
    return out


def open_graph(document: Node) -> dict[str, str]:
    out = {}
    for node in select(document, 'meta[property^="og:"], meta[name^="twitter:"]'):
        name, content = node.get("property") or node.get("name") or "", node.get("content") or ""
        if name and content:
            out[re.sub("^(og|twitter):", "", name)] = content
    return out


def where_said(item: Node, value: str) -> str | None:
    """The first small element that says a value, as text or link."""
    want = js_trim(value).lower()
    for node in item.descendants():
        if not node.is_tag or len(node.elements()) > 2:
            continue
        link = node.get("href") or ""
        if _text(node).lower().startswith(want) or link and link.endswith(value):
            return relative_selector(node, item)
    return None


def _said_in(items: list[Node], value: str) -> tuple[str, int] | None:
    """The commonest selector of a value and how many items say it, if two fifths do."""
    found = [s for s in (where_said(i, value) for i in items) if s]
    return (Counter(found).most_common(1)[0][0], len(found)) if found and len(found) / len(items) >= 0.4 else None


def _rule_value(node: Node, attribute: str | None) -> str:
    if attribute == "src":
        return next((v for v in (node.get(a) for a in ("src", "data-src", "data-lazy-src", "data-original")) if v), "")
    return (node.get(attribute) if attribute else None) or _text(node)


def by_rules(items: list[Node], taken: set[str]) -> list[dict]:
    out = []
    for rank, (name, kind, attribute, selectors, test) in enumerate(RULES, 1):
        if name in taken:
            continue
        values, places = [], []
        for item in items:
            for selector in selectors:
                node = first(item, selector)
                value = _rule_value(node, attribute) if node is not None else ""
                if value and (test is None or test(value)):
                    values.append(value)
                    places.append(relative_selector(node, item))
                    break
        share = len(values) / len(items)
        if share >= DEFAULTS["field_match_threshold"]:
            out.append(_field(name, Counter(places).most_common(1)[0][0], values, kind, share * 0.8 + (0.2 if rank <= 3 else 0.1), f"rule:{name}", FALLBACKS.get(name)))
    return out


def by_position(items: list[Node]) -> list[dict]:
    """Fields of pages without telling names: the first leaf of each item that looks right."""

    def leaves(item: Node) -> list[Node]:
        return [n for n in item.descendants() if n.is_tag and not n.elements()]

    def title(item: Node):
        return next(((n, _text(n)) for n in leaves(item) if n.tag not in ("nav", "footer", "button", "input") and 5 <= len(_text(n)) <= 200), None)

    def image(item: Node):
        for n in select(item, "img"):
            source = n.get("src") or n.get("data-src") or n.get("data-lazy-src") or ""
            digits = re.match(r"\s*(\d+)", n.get("width") or "0")
            if source and not ICON.search(source) and not 0 < int(digits[1] if digits else 0) <= 32:
                return n, source
        return None

    def said(pattern: re.Pattern, most: int | None = None):
        return lambda item: next(((n, _text(n)) for n in leaves(item) if pattern.search(_text(n)) and (most is None or len(_text(n)) < most)), None)

    def date(item: Node):
        node = first(item, "time")
        return (node, node.get("datetime") or _text(node)) if node is not None else said(DATE, 40)(item)

    def link(item: Node):
        return next(((n, n.get("href")) for n in select(item, "a[href]") if n.get("href") and not n.get("href").startswith("#")), None)

    def figure(item: Node):
        return next(((n, t) for n, t in ((n, _text(n)) for n in leaves(item)) if FIGURE.fullmatch(t) and len(t) <= 8 and not MONEY.search(t) and not DATE.search(t)), None)

    out = []
    least = max(1, math.floor(len(items) * DEFAULTS["field_match_threshold"]))
    for name, kind, find in (("title", "string", title), ("image", "image", image), ("price", "price", said(MONEY)), ("date", "date", date), ("url", "url", link), ("score", "number", figure)):
        places: dict[str, list[str]] = {}
        for item in items:
            met = find(item)
            if met:
                places.setdefault(relative_selector(met[0], item), []).append(met[1])
        if places:
            best = max(places, key=lambda s: len(places[s]))
            if len(places[best]) >= least:
                out.append(_field(name, best, places[best], kind, len(places[best]) / len(items) * 0.5 + 0.05, "structural:position"))
    return out


def infer_fields(document: Node, block: dict) -> list[dict]:
    """Proposed fields of a block, most confident first; a name is the first source's that finds it."""
    items = items_of(document, block, SAMPLE)
    if not items:
        return []
    out: dict[str, dict] = {}
    for name, value, kind, source in ld_fields(document):
        met = None if name in out else _said_in(items, value)
        if met:
            out[name] = _field(name, met[0], [value], kind, 0.95, f"jsonld:{source}")
    for f in [*by_rules(items, set(out)), *by_position(items)]:
        out.setdefault(f["name"], f)
    og = open_graph(document)
    for name, kind in OG_FIELDS.items():
        met = _said_in(items, og[name]) if og.get(name) and name not in out else None
        if met:
            out[name] = _field(name, met[0], [og[name]], kind, 0.7, f"og:{name}")
    return sorted(out.values(), key=lambda f: -f["confidence"])


# Pagination and detail links.

#: Where links to next pages and buttons for more are, what they say, and parameters that number pages (fixed values).
NEXT = ('a[aria-label*="next" i]', ".pagination a.next", ".pager a.next", "a.next-page", '[class*="pagination"] a:last-child')
NEXT_WORDS = ("next", "next page", ">", ">>", "»", "›", "next ›")
MORE = ('button:contains("Load more")', 'button:contains("Show more")', 'a:contains("Load more")', '[class*="load-more"]', '[class*="show-more"]')
PAGE_PARAMS = ("page", "p", "pg", "offset", "start")


def _hint(strategy: str, selector: str, score: float, pattern: str | None = None) -> dict:
    return {"strategy": strategy, "selector": selector, "url_pattern": pattern, "confidence": score}


def _next_link(document: Node) -> dict | None:
    node = first(document, 'a[rel="next"]')
    if node is not None and node.get("href"):
        return _hint("next-link", 'a[rel="next"]', 0.95, node.get("href"))
    for selector in NEXT:
        node = first(document, selector)
        if node is not None and node.get("href"):
            return _hint("next-link", selector, 0.7, node.get("href"))
    for node in each(document, "a"):
        if node.get("href") and _text(node).lower() in NEXT_WORDS:
            above = node.parent.classes() if node.parent else []
            return _hint("next-link", plain_selector(node, "a") if node.classes() else f".{above[0]} > a" if above else "a", 0.65, node.get("href"))
    return None


def page_param(links: list[str], url: str) -> str | None:
    """The parameter that numbers pages: at least two links have it, all with digits."""
    parsed = [parse_url(x, url) for x in links]
    if not all(parsed):
        return None
    from urllib.parse import parse_qsl

    queries = [dict(reversed(parse_qsl(u.query or "", keep_blank_values=True))) for u in parsed]
    for name in PAGE_PARAMS:
        values = [q[name] for q in queries if q.get(name)]
        if len(values) >= 2 and all(re.fullmatch("[0-9]+", v) for v in values):
            return name
    return None


def pagination_hints(document: Node, url: str) -> list[dict]:
    out = [h for h in [_next_link(document)] if h]
    holder = first(document, 'nav[aria-label*="pag" i], .pagination, .pager, [class*="pagina"]')
    if holder is not None:
        name = page_param([n.get("href") for n in select(holder, "a[href]") if n.get("href")], url)
        if name:
            out.append(_hint("page-param", f"{plain_selector(holder)} a", 0.85, f"{name}={{{{page}}}}"))
    more = next((s for s in MORE if _any(document, s)), None)
    if more:
        out.append(_hint("infinite-scroll", more, 0.6))
    return sorted(out, key=lambda h: -h["confidence"])


HEADINGS = "h1,h2,h3,h4,h5,h6"


def detail_links(document: Node, block: dict, base: str) -> list[dict]:
    """Rows of links in the block's first items: relative selector, absolute url, score, item and place."""
    out = []
    items = list(islice((n for n in each(document, block["selector"]) if n.is_tag), SAMPLE))
    for k, item in enumerate(items):
        for place, node in enumerate(select(item, "a[href]")):
            href = node.get("href")
            if not href or href == "#" or href.startswith(("javascript:", "mailto:")):
                continue
            url = resolve(href, base)
            if not url:
                continue
            score = 0.3 * (_any(node, HEADINGS) or node.closest(HEADINGS) is not None) + 0.2 * (10 < len(_text(node)) < 200)
            score += 0.25 * bool(re.search(r"(?i:/[a-z0-9-]+/[a-z0-9-]{3,}$)|/\d+$", url)) + 0.1 * (place == 0)
            score += 0.15 * bool(re.search("title|main|primary|detail|more", node.get("class") or "", re.I))
            named = plain_selector(node, "a") if node.classes() else f"{node.parent.tag} > a" if re.fullmatch("h[1-6]", node.parent.tag) else "a[href]"
            out.append({"selector": named, "url": url, "score": score, "item": k, "place": place, "items": len(items)})
    return out


def detail_hints(document: Node, block: dict, base: str) -> list[dict]:
    """Selectors of links to detail pages: mean score times the share of items, most confident first."""
    groups: dict[str, list[dict]] = {}
    for row in detail_links(document, block, base):
        groups.setdefault(row["selector"], []).append(row)
    out = []
    for selector, rows in groups.items():
        share = len(rows) / rows[0]["items"]
        if share >= 0.5:
            out.append({"selector": selector, "sample_urls": _distinct(r["url"] for r in rows), "confidence": min(sum(r["score"] for r in rows) / len(rows) * share + 0.1, 1.0)})
    return sorted(out, key=lambda h: -h["confidence"])


# Rendering need.

#: Roots of script applications and names of their bundles (fixed values).
ROOTS = ("#root", "#app", "#__next", "#__nuxt", "[data-reactroot]", "[ng-app]")
CHUNKS = re.compile(r"/_next/|/chunks/|runtime[-.].*\.js|app[-.].*\.js")


#: Weight, signal and reason of each sign that scripts make a page (fixed values).
SIGNALS = (
    (0.5, "empty", "empty-body-with-scripts"), (0.4, "spa", "spa-marker:"), (0.3, "vue", "vue-data-v"), (0.4, "next_meta", "next-head-count-meta"), (0.5, "next_data", "__NEXT_DATA__-hydration"),
    (0.4, "nuxt", "__NUXT__-hydration"), (0.4, "gatsby", "__GATSBY__-hydration"), (0.3, "chunks", "js-bundle-chunks"), (0.5, "noscript", "noscript-javascript-required"), (0.2, "low_text", "low-text-to-html-ratio"),
)


def rendering_features(html: str, document: Node) -> dict:
    """Signals that a page's content is made by scripts."""
    length = len(_text(first(document, "body")))
    inline = " ".join(n.raw_text() for n in select(document, "script:not([src])"))
    sources = [n.get("src") or "" for n in select(document, "script[src]")]
    root = next((s for s in ROOTS if _any(document, s)), None)
    return {
        "body_length": length, "html_length": len(html), "scripts": len(sources), "root": root,
        "vue": "data-v-" in html, "next_meta": _any(document, 'meta[name="next-head-count"]'), "next_data": "__NEXT_DATA__" in inline, "nuxt": "__NUXT__" in inline,
        "gatsby": "__GATSBY__" in inline or "window.___gatsby" in inline, "chunks": bool(CHUNKS.search(" ".join(sources))),
        "noscript": "javascript" in " ".join(n.text() for n in select(document, "noscript")).lower(),
        "empty": length < 200 and len(sources) > 3, "spa": root is not None, "low_text": len(html) > 2000 and length / len(html) < 0.05,
    }


def rendering_score(signals: dict) -> float:
    return min(sum(weight for weight, name, _ in SIGNALS if signals[name]), 1.0)


# Links.

#: URLs that a crawler leaves out (fixed values).
ASSET = re.compile(r"\.(css|js|png|jpg|jpeg|gif|svg|ico|woff|woff2|ttf|pdf|zip|xml|json)$", re.I)
IGNORED = re.compile(r"/(login|logout|signup|register|cart|checkout|account|auth|admin|api/|wp-admin)", re.I)
#: Where a crawler looks for links, and what it calls what it finds there, in order (fixed values).
LINK_PLACES = (
    ("nav", 'nav a[href], header a[href], [role="navigation"] a[href]'),
    ("nav", 'aside a[href], [class*="sidebar"] a[href], [class*="side_"] a[href], [class*="categories"] a[href], [class*="menu"] a[href]'),
    ("footer", "footer a[href]"),
    ("content", 'main a[href], #content a[href], .content a[href], [class*="container"] a[href]'),
)
#: Where navigation is (fixed values).
NAV_PLACES = (
    'nav, [role="navigation"], [role="tablist"], [role="menubar"], [aria-label*="categor" i], [aria-label*="filter" i], [aria-label*="tab" i], [class*="categor"], '
    '[class*="filter"], [class*="sidebar"], [class*="tabs"], [class*="nav-"], [class*="-nav"], aside, [class*="menu"]'
)


def useful(url: str) -> bool:
    found = parse_url(url)
    if found is None or ASSET.search(url) or IGNORED.search(url):
        return False
    return found.path not in ("", "/") or found.href.split("#")[0].endswith("/")


def crawl_links(document: Node, base: str) -> Iterator[dict]:
    """Links of the same origin worth a visit, first place first."""
    own, seen = parse_url(base), set()
    for source, selector in LINK_PLACES if own is not None else ():
        for node in each(document, selector):
            url = normalize(node.get("href"), base) if node.get("href") else None
            if url and url not in seen and parse_url(url).origin == own.origin and useful(url):
                yield {"url": url, "source": source, "ord": len(seen)}
                seen.add(url)


def section_links(document: Node, page_url: str) -> Iterator[dict]:
    """Labelled links of the same origin, once for each path and query."""
    own, seen, n = parse_url(page_url), set(), 0
    for node in each(document, "a[href]"):
        found = parse_url(node.get("href") or "", page_url)
        if found is None or own is None or found.origin != own.origin:
            continue
        path = re.sub(r"/$", "", re.sub(r"/index\.(html?|php|asp)$", "", found.path, flags=re.I)) or "/"
        key = f"{own.origin}{path}{found.search}"
        label = js_trim(re.sub(f"[{JS_SPACE}]+", " ", node.text()))
        if key in seen:
            continue
        seen.add(key)
        if 1 <= len(label) <= 60:
            yield {"label": label, "url": key, "path": path, "search": found.search, "depth": 0 if path == "/" else path.count("/"), "in_nav": node.closest(NAV_PLACES) is not None, "ord": n}
            n += 1


def page_title(document: Node, url: str) -> str:
    title, head = first(document, "title"), first(document, "h1")
    return (_text(title) if title is not None else "") or (_text(head) if head is not None else "") or url


def analyse(html: str | None, url: str | None) -> dict:
    """Everything about a page in one pass over one parse."""
    html, url = html or "", url or ""
    document = parse_cached(html)
    blocks = repeated_blocks(document)
    return {
        "title": page_title(document, url), **page_type(document, url, blocks), "blocks": blocks, "fields": infer_fields(document, blocks[0]) if blocks else [], "og": open_graph(document),
        "pagination": pagination_hints(document, url), "detail_links": detail_hints(document, blocks[0], url) if blocks else [], "rendering": rendering_features(html, document),
    }
