from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.functions import dom, mining, urls

MARKUP = st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<div class='a b'>", "</div>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<br>", "<a href='/x'>", "</a>", "<script>", "</script>", "text ", "&amp;", "<", "<!-- c -->", "<h1>", "</h1>"]), max_size=40).map("".join)


@settings(max_examples=150, deadline=None)
@given(MARKUP)
def test_any_markup_gives_a_tree(html):
    d = dom.parse(html)
    nodes = list(d.descendants())
    assert [n.tag for n in d.elements()] == ["html"] and all(n.parent is not None and any(c is n for c in n.parent.children) for n in nodes)
    assert len(set(map(id, nodes))) == len(nodes)
    again = dom.parse(d.elements()[0].html())
    assert again.text() == d.text()
    mining.analyse(html, "https://e.org/")


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc/.?#:@ é%2\\", max_size=20))
def test_resolved_links_are_fixed_points(link):
    found = urls.resolve(link, "https://example.org/a/b?q=1")
    if found and found.startswith("https://"):
        assert urls.resolve(found, "https://other.org/") == found
