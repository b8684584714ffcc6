from sluice.functions import dom, mining, urls

LISTING = """<html><head><title>Shop</title></head><body><nav aria-label="pagination"><a href="?page=1">1</a><a href="?page=2">2</a><a rel="next" href="/p/2">Next</a></nav>
<div class="products">""" + "".join(
    f'<div class="product-card"><h3><a href="/products/item-{i}">Product number {i}</a></h3><span class="price">${i}9.99</span><img src="/i/{i}.jpg"><p class="desc">A description of product {i} that is long enough</p></div>'
    for i in range(1, 6)
) + "</div></body></html>"


def test_tree_rules():
    d = dom.parse("<ul><li>a<li>b</ul><p><b>x<p>y<table><tr><td>1<td>2</table><script>if (a < b) '</p>'</script>")
    assert [n.text() for n in dom.select(d, "li")] == ["a", "b"]
    assert [n.text() for n in dom.select(d, "p > b")] == ["x", "y"]  # an unclosed b goes on in the next block
    assert [n.text() for n in dom.select(d, "td")] == ["1", "2"]
    assert "if" not in d.text()
    d = dom.parse("<div id=o><table><tr><td>x</div>y</table><p>z</div>")
    assert dom.first(d, "#o").text() == "xyz"


def test_selectors():
    d = dom.parse('<div id=a class="x y"><p data-k="Vw">1</p><p>2</p><span>3</span></div>')
    texts = lambda s: [n.text() for n in dom.select(d, s)]
    assert texts("#a > p:nth-of-type(2)") == ["2"]
    assert texts("div.x.y p + p, span:last-child") == ["2", "3"]
    assert texts('[data-k*="vW" i]') == ["1"] and texts('[data-k*="vW"]') == []
    assert texts("p:not([data-k])") == ["2"] and texts("div:has(> span) p:contains('2')") == ["2"]
    assert texts("p ~ span") == ["3"] and texts("p:nth-child(odd)") == ["1"]
    for bad in ("p[", "> p", "p >", "..a", "p:nope"):
        try:
            dom.matcher(bad)
            raise AssertionError(bad)
        except dom.SelectorError:
            pass


def test_urls():
    r = urls.resolve
    assert r("/path", "https://example.com") == "https://example.com/path"
    assert r("https://x.org/a", "https://example.com") == "https://x.org/a"
    assert [r(x, "https://e.com") for x in ("#", "javascript:void(0)", "", None)] == [None] * 4
    assert r("../b?x=ü", "https://E.com:443/a/c/d") == "https://e.com/a/b?x=%C3%BC"
    assert urls.normalize("/a/index.html#top", "https://e.com") == "https://e.com/a"
    assert urls.parse_url("https://e.com/a?page=1&q=b c").with_param("page", "2") == "https://e.com/a?page=2&q=b+c"


def test_blocks_and_type():
    d = dom.parse(LISTING)
    blocks = mining.repeated_blocks(d)
    assert len(blocks) == 1 and blocks[0]["count"] == 5 and blocks[0]["selector"] == "div.products > div.product-card" and blocks[0]["confidence"] == 1.0
    assert mining.page_type(d, "https://s.com/products", blocks) == {"page_type": "list", "type_confidence": 0.8500000000000001}
    assert mining.page_type(dom.parse("<article>x</article>"), "https://s.com/post/1", [])["page_type"] == "article"
    assert mining.repeated_blocks(dom.parse("<p>a</p>")) == []


def test_fields():
    d = dom.parse(LISTING)
    found = {f["name"]: f for f in mining.infer_fields(d, mining.repeated_blocks(d)[0])}
    assert found["title"]["confidence"] == 1.0 and found["price"]["inferred_type"] == "price" and found["price"]["selector"] == "span.price"
    assert found["url"]["sample_values"][0] == "/products/item-1" and found["image"]["selector"] == "div.product-card > img"
    assert abs(found["description"]["confidence"] - 0.9) < 1e-9


def test_pagination_and_links():
    d = dom.parse(LISTING)
    hints = mining.pagination_hints(d, "https://s.com/")
    assert [h["strategy"] for h in hints] == ["next-link", "page-param"] and hints[1]["url_pattern"] == "page={{page}}"
    assert mining.pagination_hints(dom.parse("<p>x</p>"), "https://s.com/") == []
    pager = mining.pagination_hints(dom.parse('<div class="pager"><a href="/2">Next</a></div>'), "https://s.com/")
    assert pager[0]["selector"] == ".pager > a" and pager[0]["confidence"] == 0.65
    links = mining.detail_hints(d, mining.repeated_blocks(d)[0], "https://s.com/")
    assert links[0]["selector"] == "h3 > a" and links[0]["sample_urls"][0] == "https://s.com/products/item-1"


def test_ld_json_and_open_graph():
    d = dom.parse('<meta property="og:title" content="T"><meta name="twitter:title" content="U"><script type="application/ld+json">{"@type":"Product","name":"N","offers":{"price":"5"}}</script><script type="application/ld+json">{bad</script>')
    assert mining.open_graph(d) == {"title": "U"}
    assert [f[:2] for f in mining.ld_fields(d)] == [("title", "N"), ("price", "5")]


def test_a_proposed_config_runs():
    from sluice.operators.extract import raw_items
    from sluice.plans.propose import propose

    config = propose("shop", "https://s.com/", mining.analyse(LISTING, "https://s.com/"))
    assert config.required == ["title", "url"] and config.pagination.next_selector == 'a[rel="next"]'
    items = raw_items(LISTING, config.list_selector, config.fields)
    assert len(items) == 5 and dict(zip([f.name for f in config.fields], items[0]["raw"]))["url"] == "/products/item-1"
