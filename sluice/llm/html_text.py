"""Main text of web pages: markup proposes, a host suffix array disposes.

Markup cuts a page into blocks and drops those of menus, headers, footers, sidebars, notices, adverts, forms and
reader comments by element, role and class. All other blocks, inside an article or main element or not, are
token streams of the page's host, and what its pages repeat decides over them:

* Outside such an element a run of ``RUN`` tokens that two distinct pages hold is boilerplate.
* Inside, two pages may print one article, so repetition alone says nothing. A block there is boilerplate if it stands
  in at least ``PLACES`` and ``SHARE`` of the host's distinct pages' number of different surroundings (the blocks before
  and after it): copies of an article, edited ones too, bring the same surroundings along.
* Where the runs outside that no other page holds have ``TEASER`` times the words of what is inside, the element holds
  teasers: all blocks are judged as outside ones. Else what lies outside goes.

Runs and blocks are counted over the whole host by hash, with map-side combine, and reach their pages as a note. One
range shuffle brings a host's pages together (by host, then by a hash of the page, so that a host with a third of all
pages spreads over many tasks). A task concatenates the streams and notes of at most ``GROUP`` pages of one host
at a time, sorts their suffixes, removes the tokens that repeated runs cover and keeps the unique ones. As the notes
hold all that recurs on the host, the borders of groups and tasks change no text.

A null or empty html gives the empty text; a null url is a host of its own. Repeated rows and rows with null
ids stay rows; a page repeated under the same url isn't a distinct page. An empty table gives no rows.
Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import cut, release

GROUP = 400
#: Tokens of the shortest run that counts as repeated; a power of two.
RUN = 8

#: Surroundings in which a block inside an article is boilerplate: at least so many, and this share of the host's pages.
PLACES, SHARE = 4, 0.5
#: Unique words outside an article or main element for each word inside that make it a teaser.
TEASER = 2

#: Elements whose text is never part of a page's main text.
DROPPED = frozenset("nav footer aside form menu dialog head button select svg canvas object video audio map noscript template".split())
#: Elements that begin and end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end at the next tag of these.
ENDED_BY = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "head": frozenset(["body"]), "option": frozenset(["option"])}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that name boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion sidebar sidebars "
    "nav navbar navigation menu menus breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup login footer masthead comments comment commentlist disqus reply replies respond "
    "share sharing social related recommended widget widgets toolbar pager pagination search".split()
)
#: Words that do so for an element inside a line.
INLINE_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted share sharing".split())
HEADERS = frozenset(["header", "topbar", "siteheader"])
MARK = re.compile(
    r"<!--.*?(?:-->|$)|<(script|style|title|textarea|iframe|xmp|noembed|noframes)\b.*?(?:</\1\s*>|$)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_PARTS = re.compile(r"[^a-z0-9]+")


def _named(raw: str, inside: int, names: frozenset[str] = NAMES) -> bool:
    """Whether attributes say that an element is boilerplate or hidden."""
    for name, a, b, c in ATTRIBUTE.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return True
        if name == "role" and value in ROLES:
            return True
        if name in ("class", "id"):
            for word in value.split():
                parts = set(NAME_PARTS.split(word))
                if parts & names and not ("free" in parts or "content" in parts or "article" in parts or "post" in parts and "comments" not in parts):
                    return True
                if not inside and parts & HEADERS:
                    return True
    return False


def blocks_of(html: str | None) -> list[tuple[str, bool]]:
    """Visible blocks of a page in order, without named boilerplate; the flag: the page's article elements hold it, or
    its main element where it has no article."""
    out: list[tuple[str, int]] = []
    open_: list[tuple[str, bool, int]] = []  # tag, dropped, and 2 in an article, 1 in a main element, else 0
    words: list[str] = []
    dropped, inside, at = False, 0, 0

    def end_block() -> None:
        if words:
            text = " ".join(entities.unescape("".join(words)).split())
            if text:
                out.append((text, inside))
            words.clear()

    html = html or ""
    for m in MARK.finditer(html):
        if not dropped and m.start() > at:
            words.append(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        block = tag in BLOCKS
        if block:
            end_block()
        if m[2]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == tag:
                    del open_[k:]
                    break
        else:
            if block:
                while open_ and tag in ENDED_BY.get(open_[-1][0], ()):
                    open_.pop()
                dropped, inside = open_[-1][1:] if open_ else (False, 0)
            if tag in VOID:
                if tag == "br" and not dropped:
                    words.append(" ")
                continue
            attributes = m[4]
            if not block and tag not in DROPPED and not attributes:
                continue  # inline markup changes nothing
            drop = dropped or tag in DROPPED or tag == "header" and not inside
            drop = drop or bool(attributes.strip()) and tag not in ("html", "body") and _named(attributes, inside, NAMES if block else INLINE_NAMES)
            if not block and not drop or attributes.endswith("/"):
                continue
            open_.append((tag, drop, max(inside, {"article": 2, "main": 1}.get(tag, 0))))
        dropped, inside = open_[-1][1:] if open_ else (False, 0)
    if not dropped and at < len(html):
        words.append(html[at:])
    end_block()
    best = max((level for _, level in out), default=0)
    return [(text, level == best > 0) for text, level in out]


def repeated(streams: list[np.ndarray], pages: list[object], run: int = RUN) -> list[np.ndarray]:
    """Of each stream, the tokens covered by a run of ``run`` tokens that a stream of another page holds too.

    Suffixes of the concatenated streams (a separator of its own ends each) are sorted by prefix doubling
    as deep as a run; neighbours that share that depth and belong to distinct pages repeat.
    """
    sizes = [len(s) + 1 for s in streams]
    total = sum(sizes)
    if total <= len(streams):
        return [np.zeros(len(s), bool) for s in streams]
    top = max((int(s.max()) for s in streams if len(s)), default=0) + 1
    text = np.concatenate([np.append(s, top + i) for i, s in enumerate(streams)])
    page = np.repeat(np.unique(np.array([str(p) for p in pages]), return_inverse=True)[1], sizes)
    rank, depth = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while depth < run:
        after = np.concatenate([rank[depth:] + 1, np.zeros(min(depth, total), np.int64)])[:total]
        rank = np.unique(rank * (total + 2) + after, return_inverse=True)[1].astype(np.int64)
        depth *= 2
    order = np.lexsort((page, rank))  # the suffix array, as deep as a run
    same = rank[order][1:] == rank[order][:-1]
    group = np.concatenate([[0], np.cumsum(~same)])
    low, high = np.full(group[-1] + 1, total), np.full(group[-1] + 1, -1)
    np.minimum.at(low, group, page[order])
    np.maximum.at(high, group, page[order])
    starts = order[low[group] != high[group]]
    edge = np.zeros(total + run + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    covered = np.cumsum(edge)[:total] > 0
    ends = np.cumsum(sizes)
    return [covered[e - n : e - 1] for e, n in zip(ends, sizes)]


def within(gone: np.ndarray, run: int = RUN) -> np.ndarray:
    """Covered tokens of a block whose run is the whole block or long by itself: a run that ends a few words into the
    next block says nothing about that."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
    out = np.zeros(len(gone), bool)
    for a, b in zip(edges[::2], edges[1::2]):
        out[a:b] = b - a >= min(run, len(gone))
    return out


def run_hashes(host: str, words: list[str], run: int = RUN) -> list[int]:
    """Of a host's page, the hash of the run at each word (signed 64 bits)."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    start = host.encode("utf-8", "surrogatepass") + b"\0"
    digests = b"".join(xxhash.xxh64_digest(start + b" ".join(raw[k : k + run])) for k in range(len(raw) - run + 1))
    return np.frombuffer(digests, ">i8").tolist()


def hashed(*parts: str) -> int:
    """Signed 64 bits of some texts in order."""
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def block_hashes(host: str, blocks: list[tuple[str, bool]]) -> list[tuple[int, int]]:
    """Of each block inside the article or main element: its hash on this host, and that of its surroundings."""
    texts = ["", *(text for text, _ in blocks), ""]
    return [(hashed("block", host, text), hashed(texts[k], texts[k + 2])) for k, (text, inside) in enumerate(blocks) if inside]


def unique_inside(host: str, blocks: list[tuple[str, bool]], shared: set[int]) -> list[str]:
    """What is left of each of the blocks inside the article or main element where ``shared`` holds the boilerplate ones' hashes:
    the array of the page's stream and these blocks' finds their tokens, also where they run on in other blocks."""
    own = [text for text, inside in blocks if inside]
    named = [text for text in own if hashed("block", host, text) in shared] if shared else []
    if not named:
        return own
    vocabulary: dict[str, int] = {}
    numbered = lambda text: np.array([vocabulary.setdefault(w, len(vocabulary)) for w in text.split(" ")], np.int64)
    streams = [numbered(text) for text in own]
    gone = repeated([np.concatenate(streams), *map(numbered, dict.fromkeys(named))], ["page", *["boilerplate"] * len(set(named))])[0]
    out, at = [], 0
    for text, stream in zip(own, streams):
        covered = within(gone[at : at + len(stream)])
        at += len(stream)
        out.append("" if text in named else " ".join(w for w, g in zip(text.split(" "), covered) if not g))
    return out


def texts_of(pages: list[tuple[object, str | None]], host: str = "", shared: list[set[int]] | None = None) -> list[str]:
    """Main texts of one host's (url, html) pages; ``shared``: of each page, the hashes of runs that other pages hold, and
    of blocks that are boilerplate inside articles."""
    found = [blocks_of(h) for _, h in pages]
    vocabulary: dict[str, int] = {}
    streams, loose = [], []
    for blocks in found:
        words = [w for text, inside in blocks if not inside for w in text.split(" ")]
        loose.append(words)
        streams.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], dtype=np.int64))
    urls: list[object] = [u for u, _ in pages]
    seen: set[int] = set()
    for words, stream, hashes in zip(loose, streams[:], shared or []):
        for k, h in enumerate(run_hashes(host, words) if hashes else []):
            if h in hashes and h not in seen:
                seen.add(h)
                streams.append(stream[k : k + RUN])
                urls.append("\0")  # no page's url
    covered = repeated(streams, urls)
    out = []
    for k, (blocks, words, gone) in enumerate(zip(found, loose, covered)):
        inner = unique_inside(host, blocks, shared[k] if shared else set())
        outer, at = [], 0
        for text in (text for text, inside in blocks if not inside):
            n = text.count(" ") + 1
            outer.append(" ".join(w for w, g in zip(words[at : at + n], within(gone[at : at + n])) if not g))
            at += n
        size = lambda texts: sum(text.count(" ") + 1 for text in texts if text)
        teaser = size(outer) >= TEASER * size(inner)
        left, right = iter(inner), iter(outer)
        both = [next(left) if inside else next(right) for _, inside in blocks if inside or teaser]
        out.append("\n\n".join(text for text in both if text))
    return out


def main_texts(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumns({"host": host, "spread": F.xxhash64("page_id", "url")})

    kinds = "host string, spread long, page long, run long, place long"

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for host, spread, url, html in zip(*(batch.column(k).to_pylist() for k in range(4))):
                blocks = blocks_of(html)
                found = list(set(run_hashes(host, [w for text, inside in blocks if not inside for w in text.split(" ")])))
                inner = list(set(block_hashes(host, blocks)))
                n, page = len(found) + len(inner), hashed(str(url))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([host] * n, pa.string()), pa.array([spread] * n, pa.int64()), pa.array([page] * n, pa.int64()), pa.array(found + [h for h, _ in inner], pa.int64()), pa.array([None] * len(found) + [p for _, p in inner], pa.int64())],
                    ["host", "spread", "page", "run", "place"],
                )

    each = cut(rows.select("host", "spread", "url", "html").mapInArrow(runs, kinds), "runs")
    # Runs outside articles that distinct pages hold; blocks inside ones that recur at all, then those in enough surroundings.
    counted = each.groupBy("run").agg(F.min("page").alias("a"), F.max("page").alias("b"), F.min("place").alias("c"), F.max("place").alias("d"), F.first("host").alias("host"))
    counted = cut(counted.where("c IS NULL AND a <> b OR c <> d"), "counted")
    sizes = rows.groupBy("host").agg(F.count_distinct(F.coalesce("url", F.lit(""))).alias("pages"))
    inner = each.join(counted.where("c IS NOT NULL").select("run"), "run").groupBy("host", "run").agg(F.count_distinct("place").alias("places"))
    inner = inner.where(F.col("places") >= PLACES).join(sizes, "host").where(F.col("places") >= SHARE * F.col("pages")).select("run")
    recurring = counted.where("c IS NULL").select("run").unionByName(inner)
    notes = cut(each.select("host", "spread", "run").join(recurring, "run").groupBy("host", "spread").agg(F.collect_set("run").alias("runs")), "notes")
    release(each, counted)
    # A page's recurring runs travel as a row before it.
    noted = notes.select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "host", "spread", "runs")
    rows = rows.withColumn("runs", F.lit(None).cast("array<long>")).unionByName(noted).withColumn("page", F.col("runs").isNull())
    rows = rows.repartitionByRange(n, "host", "spread").sortWithinPartitions("host", "spread", "page")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        note: tuple = (None, None, set())

        def done() -> pa.RecordBatch:
            texts = texts_of([(r[1], r[2]) for r in held], held[0][3], [r[4] for r in held])
            out = pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
            held.clear()
            return out

        for batch in batches:
            for page_id, url, html, host, spread, found in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if found is not None:
                    note = (host, spread, set(found))
                    continue
                if held and (held[-1][3] != host or len(held) == group):
                    yield done()
                held.append((page_id, url, html, host, note[2] if note[:2] == (host, spread) else set()))
        if held:
            yield done()

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
