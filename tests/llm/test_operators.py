"""Each operator against a brute-force version, on nulls, empty and long texts, ties, repeated rows and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sluice.llm import byte_repeats, common, decontaminate, html_text, lm_score, packing, quality, simhash, token_files, tokens, toxicity, word_repeats
from tests.llm.fixtures import documents, empty, texts, words


@pytest.fixture(scope="module")
def docs(spark):
    common.ship(spark)
    return documents(spark).cache()


def raw_words(text):
    return (text or "").encode().split()


def test_quality_counts(docs, spark):
    def brute(t):
        t = t or ""
        w = raw_words(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        covered = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if raw_words(x)]
        return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)

    rows = quality.quality(docs).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == Counter((i, *brute(t)) for i, t in texts())
    assert all(not r["kept"] for r in rows if r["base_failed"]) and all(r["kept"] for r in rows if r["doc_id"] in range(12))
    assert quality.quality(empty(spark)).count() == 0


def test_quality_estimates_stay_anchored():
    odds, adds = quality.estimate([((0, 0, 1), 900), ((-1, 0, 1), 50), ((-1, -1, 0), 20)])
    assert odds + adds[0][-1] + adds[2][1] < 0 < odds + adds[2][1]


def test_language_model_counts(docs, spark):
    rows = lm_score.lm_scores(docs, least=3000).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    low = [(i, [w.lower() for w in raw_words(t)]) for i, t in texts()]
    c = Counter(w for i, ws in low if not held(i) for w in ws)
    ends = sum(not held(i) for i, _ in low)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = Counter((i, held(i), len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws) + math.log10((ends + 1) / (n + v + 1)), 4)) for i, ws in low)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert lm_score.lm_scores(empty(spark)).count() == 0


def test_trainers_together_learn_from_whole_documents(spark, monkeypatch):
    # A language of two words that take turns: what a model of counts can't know. Many trainers, more than FAN.
    rows = [(k, " ".join(["ab", "cd"] * (40 + k % 7) + ["ef"] * (k % 3))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(lm_score, "FAN", 2)
    monkeypatch.setattr(lm_score, "RATES", (0.2,) * 8)
    found = {r["doc_id"]: r for r in lm_score.lm_scores(docs, least=1, every=1, portion=12_000).collect()}
    gain = sum(r["score"] - r["base_score"] for r in found.values()) / sum(r["n_tokens"] for r in found.values())
    assert len(found) == 400 and gain > 0.1
    again = {r["doc_id"]: r["score"] for r in lm_score.lm_scores(docs.repartition(5), least=1, every=1, portion=12_000).collect()}
    assert all(abs(again[k] - r["score"]) < 1e-3 * abs(r["score"]) for k, r in found.items())


def test_rounds_together_read_every_training_document(spark, monkeypatch):
    from sluice.llm import recurrent_lm as lm

    read, plain = [], lm.mean
    monkeypatch.setattr(lm, "mean", lambda parts: read.append(sum(n for _, n in parts)) or plain(parts))
    docs = spark.createDataFrame([(k, " ".join(words(500 + k, 20 + k % 9))) for k in range(300)], "doc_id long, text string")
    found = lm_score.lm_scores(docs, least=1).collect()
    assert len(read) == len(lm_score.RATES) and min(read) > 0 and sum(read) == found[0]["train_tokens"]


def test_language_model_reads_words_by_the_batch():
    r = np.random.default_rng(3)
    odd = [None, "", " \n", "b", "É é"] + ["".join(r.choice(list("aB \t\n\x0b\x0c\r\x1c\x1f\x85\u3000\u00a0éÀ\x00😀"), r.integers(0, 25))) for _ in range(500)]
    plain = [(t or "").encode().lower().split() for t in odd]
    found, sizes = lm_score.words_of(pa.array(odd, pa.string()))
    assert found.to_pylist() == [w for ws in plain for w in ws] and sizes.tolist() == [len(ws) for ws in plain]
    rare = lambda w: zlib.crc32(w[-2:]) % lm_score.RARE
    assert lm_score.rare_classes(found[7:]).tolist() == [rare(w) for w in found[7:].to_pylist()]
    head = [(w, rare(w), n) for w, n in Counter(found.to_pylist()).most_common(9)]
    scorer = lm_score.Scorer(head, 3, 10_000, 900, np.full(16, 2000.0), np.full(16, 90.0))
    batch = pa.RecordBatch.from_arrays([pa.array(odd, pa.string())], ["text"])
    reads = [scorer.read(piece.column("text")) for piece in lm_score.pieces(batch, 900)]
    places = {w: k for k, (w, _, _) in enumerate(head)}
    ids = [[places.get(w, scorer.shape.end + 1 + rare(w)) for w in ws] + [scorer.shape.end] for ws in plain]
    assert len(reads) > 3 and [x.tolist() for f in reads for x in f.each()] == ids
    far = [{d["word"]: (d["n"], d["rare"]) for d in row} for f in reads for row in f.far().to_pylist()]
    assert far == [{w: (n, rare(w)) for w, n in Counter(w for w in ws if w not in places).items()} for ws in plain]


@pytest.mark.parametrize("size", [1, 200])
def test_recurrent_model_gradients(size):
    # Against differences of the loss, with logits that exp can take as they are and with larger ones.
    from sluice.llm import recurrent_lm as lm

    r, shape = np.random.default_rng(1), lm.Shape(np.array([40, 30, 20, 10, 9, 8]), 10, 2, classes=3)
    p = {k: v * (size if k in ("k", "o") else 1) for k, v in shape.start().items()}
    goal = r.integers(0, shape.begin, (6, 5))
    ids, goal[4:, 3:] = np.vstack([np.full(5, shape.begin), goal[:-1]]), -1
    ids[1:][ids[1:] == shape.end] = shape.begin
    h = np.zeros((5, lm.HIDDEN), np.float32)
    assert lm.mild(h, *lm.outputs(p)) == (size == 1)

    def loss(p):
        table, u = lm.folded(p)
        states, now = [], h
        for t in range(len(ids)):
            now = lm.step(now * (ids[t] != shape.begin)[:, None].astype(np.float32), table.take(ids[t], 1), u)[0]
            states.append(now)
        real = goal.ravel() >= 0
        return -lm.log_probs(p, shape, np.concatenate(states)[real], goal.ravel()[real]).mean()

    g = lm.gradients(p, shape, ids, goal, h)[1]
    assert set(g) == set(p)
    for k in p:
        way = r.normal(0, 1, p[k].shape).astype(np.float32)
        by = 1e-2 / max(1.0, float(np.abs((g[k] * way).sum())))
        change = (loss(p | {k: p[k] + by * way}) - loss(p | {k: p[k] - by * way})) / (2 * by)
        assert abs(change - float((g[k] * way).sum())) < 2e-3 + 0.03 * abs(change), k


def test_recurrent_model_learns_and_is_whole():
    from sluice.llm import recurrent_lm as lm

    shape = lm.Shape(np.array([40, 30, 20, 10]), 10, 2, classes=3)
    docs = [np.array([0, 1, 0, 1, 0, 1, shape.end])] * 60
    p = lm.train(shape, docs, epochs=20)
    h = np.random.default_rng(0).normal(0, 1, (1, lm.HIDDEN)).astype(np.float32)
    assert abs(np.exp(lm.log_probs(p, shape, np.repeat(h, shape.begin, 0), np.arange(shape.begin))).sum() - 1) < 1e-5
    good, bad = lm.score(p, shape, [docs[0], np.array([1, 1, 0, 0, 1, 1, shape.end])])
    assert good > bad + 1
    long = np.tile(docs[0][:6], 100)  # the state goes through many windows
    assert abs(lm.score(p, shape, [long, docs[0]])[0] - lm.score(p, shape, [long])[0]) < 1e-3


def union(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


@pytest.mark.parametrize("tile", [3, 4096])
def test_simhash(docs, spark, tile, monkeypatch):
    def brute(t):
        w = [x.lower() for x in raw_words(t)]
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    rows = texts()
    fps = [brute(t) for _, t in rows]
    root = union(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 4])
    low = {r: min((rows[k][0] for k in range(len(rows)) if root[k] == r and rows[k][0] is not None), default=None) for r in root}
    monkeypatch.setattr(simhash, "TILE", tile)
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((i, f"{f:016x}", low[r]) for (i, _), f, r in zip(rows, fps, root))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_bk_trees_follow_the_radius():
    from sluice.llm.bktree import Forest

    r = np.random.default_rng(3)
    v = r.integers(0, 1 << 62, 60, dtype=np.int64).view(np.uint64)
    v = np.unique(np.concatenate([v, v[:30] ^ np.uint64(1 << 9 | 5), v[:9] ^ np.uint64(0x1F)]))
    shard = np.sort(r.integers(0, 4, len(v)))
    got = {(int(a), int(b)) for q, n, _ in Forest(v, shard).search(v, shard, 4) for a, b in zip(q, n)}
    assert got == {(a, b) for a in range(len(v)) for b in range(len(v)) if shard[a] == shard[b] and bin(int(v[a] ^ v[b])).count("1") <= 4}


@pytest.mark.parametrize("tile", [2, 4096])
def test_links_of_a_dense_group_survive_tiles(spark, tile):
    centre = 0x0123456789ABCDEF
    fps = [centre ^ (1 << k) for k in range(40)] + [centre ^ 0x5555555500000000, 7]
    links = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), tile=tile)
    roots = {r["node"]: r["root"] for r in common.components(links).collect()}
    assert len(roots) == 40 and set(roots.values()) == {min(fps[:40])}


def test_near_copies_go_and_clean_documents_stay(docs, spark):
    left = simhash.keep_one_of_each(docs)
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in left.collect())
    gone = {21, 22, 41, 42}  # of the texts without words the smallest real id stays, not the null one
    kept = [i for i, _ in texts() if i is not None and i not in gone]
    blank = sum(1 for i, t in texts() if not raw_words(t))
    assert left.columns == docs.columns and [i for null, i in ids if not null] == sorted(kept) and len(ids) == len(kept) + 1 and blank == 4
    assert simhash.keep_one_of_each(empty(spark)).count() == 0


def test_word_repeats(docs, spark):
    rows = [(i, raw_words(t)) for i, t in texts()]
    c = Counter(tuple(w[k : k + 35]) for _, w in rows for k in range(len(w) - 34))

    def brute(w):
        out = {k + j for k in range(len(w) - 34) if c[tuple(w[k : k + 35])] > 1 for j in range(35)}
        return len(w), len(out), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in out)).hexdigest()

    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in word_repeats.word_repeat_digests(docs).collect())
    assert got == Counter((i, *brute(w)) for i, w in rows)
    assert word_repeats.without_repeats(docs).select("own.*").columns == docs.columns
    assert word_repeats.word_repeat_digests(empty(spark)).count() == 0


@pytest.mark.parametrize("tile", [0, 2048])
def test_byte_repeats(docs, spark, tile, monkeypatch):
    rows = [(i, (t or "").encode()) for i, t in texts()]
    c = Counter(b[k : k + 400] for _, b in rows for k in range(len(b) - 399))

    def brute(b):
        edge = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if c[b[k : k + 400]] > 1:
                edge[k] += 1
                edge[k + 400] -= 1
        out = np.cumsum(edge)[: len(b)] > 0
        spans = int((np.diff(np.concatenate([[0], out.astype(int)])) == 1).sum())
        return len(b), int(out.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~out].tobytes()).hexdigest()

    found = byte_repeats.without_byte_repeats(docs, tile=tile).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found)
    assert got == Counter((i, *brute(b)) for i, b in rows)
    assert byte_repeats.byte_repeat_digests(empty(spark)).count() == 0


def test_phrases_shorter_than_half_a_window_are_not_sorted(spark, monkeypatch):
    # Every document has the same 150 bytes in other surroundings: no 400-byte string recurs, so no suffix need be sorted.
    phrase = " ".join(words(900, 60))[:150]
    rows = [(k, " ".join(words(901 + k, 120)) + phrase + " ".join(words(951 + k, 120))) for k in range(12)]
    sorted_, plain = [], byte_repeats.edges_of
    monkeypatch.setattr(byte_repeats, "edges_of", lambda found, *a: sorted_.append(found.count()) or plain(found, *a))
    assert byte_repeats.without_byte_repeats(spark.createDataFrame(rows, "doc_id long, text string")).where("n_removed > 0").count() == 0
    assert sorted_ == [0]
    # Repeats of 399 to 430 bytes, cut at every place of a tile, go as they do by brute force.
    base = " ".join(words(902, 400)).encode()
    texts_ = [base[:1200]] + [bytes([65 + k]) * 50 + base[37 * k : 37 * k + 399 + k] + bytes([97 + k]) * 50 for k in range(20)]
    found = byte_repeats.without_byte_repeats(spark.createDataFrame([(k, t.decode()) for k, t in enumerate(texts_)], "doc_id long, text string")).collect()
    c = Counter(t[k : k + 400] for t in texts_ for k in range(len(t) - 399))
    gone = {i: len({k + j for k in range(len(t) - 399) if c[t[k : k + 400]] > 1 for j in range(400)}) for i, t in enumerate(texts_)}
    assert {r["doc_id"]: r["n_removed"] for r in found} == gone and gone[1] == 0 < gone[2]


def test_suffix_order_of_prefix_free_parsing():
    from sluice.llm.parsing import suffix_order

    r = np.random.default_rng(5)
    base = bytes(r.integers(97, 100, 400, dtype=np.uint8))
    parts = [base[a:b] + bytes(r.integers(97, 100, 30, dtype=np.uint8)) for a, b in (sorted(r.integers(0, 400, 2)) for _ in range(8))] + [b"a" * 90]
    order, _ = suffix_order(parts, 1000)
    suffixes = [t[k:] for t in parts for k in range(len(t))]
    assert [suffixes[k] for k in order] == sorted(suffixes)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a>x</a></li></ul></nav>
<div class="ad">buy</div><div id="cookie-notice">we use cookies</div>{main}<aside class=sidebar>more</aside><form><p>mail</p></form><section class="comments"><p>nice</p></section><footer>&copy; f</footer></body></html>"""


def test_html_text(spark):
    article = "<article><h1>Title &amp; more</h1><p>a <b>bold<br>word</p><p>x &lt; y &#233;<div class='share'>tweet</div></article>"
    loose = lambda k: f"<div>All rights reserved by the owner of this very site</div><div><p>Page {k} says something of its own</p></div>"
    rows = [
        (1, "https://a.org/1", PAGE.format(main=article)), (2, "https://a.org/2", PAGE.format(main=article)), (3, "https://b.org/1", PAGE.format(main=loose(1))),
        (4, "https://b.org/2", PAGE.format(main=loose(2))), (5, "https://c.org/", None), (6, None, ""), (None, "https://c.org/x", "plain  text"), (7, "https://c.org/y", "<main><p>" + "w " * 50_000 + "</main>"),
        (9, "https://e.org/", "<main><div>around</div><article><header><h1>H</h1></header><p>one <span class='ad'>buy</span> two<ul><li>x<li>y</ul></article></main>"),
        (8, "https://d.org/", "a < b <!-- gone --> c"), (8, "https://d.org/", "a < b <!-- gone --> c"),
    ]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, host string")
    want = [(1, "Title & more\n\na bold word\n\nx < y é")] * 1 + [(2, "Title & more\n\na bold word\n\nx < y é"), (3, "Page 1 says something of its own"), (4, "Page 2 says something of its own"), (5, ""), (6, ""), (None, "plain text"), (9, "H\n\none two\n\nx\n\ny"), (7, ("w " * 50_000).strip()), (8, "a < b c"), (8, "a < b c")]
    got = html_text.main_texts(pages).collect()
    assert Counter((r["page_id"], r["text"]) for r in got) == Counter(want) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.main_texts(pages.limit(0)).count() == 0


def test_repeated_runs_need_distinct_pages():
    a = np.arange(12)
    assert [x.sum() for x in html_text.repeated([a, np.append(a, 50)], ["p", "q"])] == [12, 12]
    assert [x.sum() for x in html_text.repeated([a, a], ["p", "p"])] == [0, 0] and html_text.repeated([a[:0]], ["p"])[0].sum() == 0


def test_decontamination(docs, spark):
    rows = texts()
    passage = " ".join((rows[3][1] or "").split()[20:60])
    question = "Tom has 12 apples and gives 5 apples to Anna who eats 12 of them in 3 hours"
    items = spark.createDataFrame([(1, passage, "x"), (2, question, "x"), (3, None, "x"), (4, "", "x"), (None, "never seen words in any text here", "x"), (1, passage, "x")], "item_id long, text string, lang string")
    more = spark.createDataFrame([(60, "Well. Bob has 13 apples and gives 6 apples to Lisa who eats 13 of them in 4 hours today"), (61, "Well. Bob has 13 apples and gives 6 apples to Lisa who eats 14 of them in 4 hours today")], "doc_id long, text string")
    all_docs = docs.select("doc_id", "text").union(more)
    got = sorted((r["doc_id"], r["item_id"], r["changed_slots"] > 0) for r in decontaminate.leaks(all_docs, items).collect())
    assert got == [(3, 1, False), (3, 1, False), (60, 2, True)]
    left = decontaminate.without_leaks(docs, items)
    assert left.columns == docs.columns and left.count() == docs.count() - 1
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(all_docs, items, block=60).collect()) == [(3, 1), (3, 1), (60, 2)]
    assert decontaminate.leaks(empty(spark), items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def test_encoder_equals_the_library():
    e = tokens.Encoder(tokens.default_path(), keep=50)
    for t in [t for _, t in texts()[:8]] + [None, "", "  a  b\n\n c's <|endoftext|> é \t ", "日本 123 !!\r\n", "x  y \n z  "]:
        assert e.tokenizer.encode(t or "", add_special_tokens=False).ids == e.encode(t).tolist()
    assert len(e.known) == 50


def encoded(end):
    e = tokens.Encoder(tokens.default_path())
    rows = sorted(texts(), key=lambda r: (r[0] is not None, r[0] or 0))
    return [(i, np.append(e.encode(t).astype("<u4"), np.uint32(end)).astype("<u4")) for i, t in rows]


def test_token_files(docs, spark, tmp_path):
    folder = f"file://{tmp_path}/t"
    token_files.write_token_files(docs, tokens.default_path(), 2, folder, 5)
    want, start = [], 0
    for i, ids in encoded(2):
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert Counter(map(tuple, token_files.read_token_files(spark, folder).collect())) == Counter(want)
    back = [(i, x.tolist()) for part in range(5) for i, _, x in token_files.documents_of(folder, part)]
    assert back == [(i, ids.tolist()) for i, ids in encoded(2)]
    assert token_files.token_file_digests(empty(spark), tokens.default_path(), 2).count() == 0


def test_packing(docs, spark):
    rows = packing.pack_documents(docs, tokens.default_path(), 1, 2048).collect()
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows)
    want = Counter((i, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()), len(ids)) for i, ids in encoded(1) for s in range(0, len(ids), 2048))
    assert pieces == want
    sequences: dict[int, list] = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.pack_documents(empty(spark), tokens.default_path()).count() == 0


def test_patterns_place_every_piece_with_little_waste():
    demand = np.bincount(np.random.default_rng(1).integers(0, 128, 20_000), minlength=128)
    uses = packing.plan(demand, 128)
    assert (sum(n * c for c, n in uses) == demand).all() and all((c * np.arange(1, 129)).sum() <= 128 for c, _ in uses)
    assert sum(n for _, n in uses) <= 1.02 * (demand * np.arange(1, 129)).sum() / 128
    assert packing.plan(np.zeros(128, int), 128) == []


def test_toxicity_gradients():
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.start_weights().items()}
    x, mask = r.normal(0, 1, (5, 3, 12)), np.ones((5, 3))
    mask[3:, 1] = 0
    keep: dict = {}
    toxicity.forward(p, x, mask, keep)
    d = r.normal(0, 1, 3)
    g, dx = toxicity.backward(p, x, mask, keep, d)
    for name in ("wo", "va", "wa"):
        at = tuple(0 for _ in p[name].shape)
        old = p[name][at]
        p[name][at] = old + 1e-4
        up = toxicity.forward(p, x, mask) @ d
        p[name][at] = old - 1e-4
        down = toxicity.forward(p, x, mask) @ d
        p[name][at] = old
        assert abs((up - down) / 2e-4 - g[name][at]) < 1e-4
    x2 = x.copy()
    x2[1, 0, 2] += 1e-4
    assert abs((toxicity.forward(p, x2, mask) - toxicity.forward(p, x, mask)) @ d / 1e-4 - dx[1, 0, 2]) < 1e-3


def test_short_items_leak_only_verbatim():
    m = decontaminate.Matcher([(1, "42"), (2, "In Paris"), (3, "Tom met Anna Smith")])
    got = [[x[0] for x in found] for found in m.match(["There are 7 cats here.", "It took 42 days", "they live in Rome", "They live in Paris.", "then Bob met Lisa Jones", "then Tom met Anna Smith again"])]
    assert got == [[], [1], [], [2], [], [3]]
    # Five placeholders in a row say nothing unless they keep their words.
    m = decontaminate.Matcher([(1, "see Paris London Rome Berlin Madrid Vienna")])
    assert [len(x) for x in m.match(["see Oslo Bern Riga Cairo Lima Quito", "we see Paris London Rome Berlin Madrid Vienna today"])] == [0, 1]


def brute_leaks(docs, items, width=5, similarity=0.8):
    """Pairs of document and item by trying every shift of the item over the document."""
    out = set()
    for item_id, item in items:
        (words, codes, slot, _), = decontaminate._Kinds().templates([item])
        n = len(words) - width + 1
        bare = [w.decode().strip(decontaminate.STRIPPED).lower() for w in words]
        for doc_id, text in docs:
            (w, c, _, _), = decontaminate._Kinds().templates([text])
            low = [x.decode().strip(decontaminate.STRIPPED).lower() for x in w]
            for shift in range(-n, len(w)):
                to, back, good = {}, {}, 0
                fits = True
                for p in range(n):
                    if not 0 <= p + shift <= len(w) - width or any(c[p + shift + j] != codes[p + j] for j in range(width)):
                        continue
                    pairs = [(bare[p + j], low[p + shift + j]) for j in range(width) if slot[p + j]]
                    fits = fits and all(to.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in pairs)
                    good += 1
                if fits and good >= similarity * n:
                    out.add((doc_id, item_id))
    return out


def test_leaks_are_those_of_every_shift(spark):
    r = random.Random(3)
    plain = [w for w in "the of and went to market with bread apples for old grey house near river then sold them again".split()]
    names = "Tom Anna Bob Lisa Carl Dora".split()

    def sentence(n):
        return " ".join(["well", *(r.choice(names) if r.random() < 0.15 else str(r.randint(2, 9)) if r.random() < 0.15 else r.choice(plain) for _ in range(n))])

    items = [(k, sentence(14)) for k in range(12)]

    def variant(text):
        swap = dict(zip(names, r.sample(names, len(names))))
        add = r.randint(0, 40)
        return " ".join(swap.get(w, str(int(w) + add) if w.isdigit() else w) for w in text.split())

    docs = [(k, f"{sentence(20)} {variant(items[k % 12][1]) if k % 2 else items[k % 12][1]} {sentence(15)}") for k in range(40)] + [(100 + k, sentence(60)) for k in range(20)]
    # One number in the middle changed by itself: consistent only if that number occurs once.
    docs += [(200 + k, " ".join(str(int(w) + 50) if w.isdigit() and j == 9 else w for j, w in enumerate(t.split()))) for k, t in items]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(docs, items)
    assert got >= want and len(want) >= 40 and len(got - want) <= 2  # copies with words put in are beyond the shifts


def test_toxicity(docs, spark):
    clean = [t for _, t in texts()[:12]]
    rows = [(100 + k, clean[k % 12] + f" {k} " + clean[(k + 3) % 12]) for k in range(120)]
    rows = [(i, t.replace(" ", " vilewords ", 3) if k % 3 == 0 else t) for k, (i, t) in enumerate(rows)]
    labels = spark.createDataFrame([(i, 1, int("vilewords" in t)) for i, t in rows] + [(None, 1, 1), (100, 1, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    more = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))
    got = toxicity.toxicity(more, labels).collect()
    truth = dict(rows)
    assert len(got) == more.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["doc_id"] in truth and r["held_out"]]
    assert sum(r["predicted"] == int("vilewords" in truth[r["doc_id"]]) for r in held) >= 0.9 * len(held)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    assert {r["score"] for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(empty(spark), labels).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 200), (200, 300), (5, 5)] + [(1000, 1001 + k) for k in range(50)]
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 200: 100, 300: 100} | {1000 + k: 1000 for k in range(51)}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def edited(seed, words=44, edits=9):
    """Three copies of one text with other beginnings and ends."""
    r = random.Random(seed)
    w = [f"w{r.randrange(10**6)}" for _ in range(words)]

    def edit(k):
        t, h = r.randrange(edits), r.randrange(edits)
        return " ".join([f"h{seed}x{k}x{i}" for i in range(h)] + w[h : words - t] + [f"t{seed}x{k}x{i}" for i in range(t)])

    return [edit(k) for k in range(3)]


@pytest.mark.parametrize("tile", [2, 4096])
def test_a_nearer_text_that_is_not_similar_hides_no_pair(spark, tile):
    # Of each three texts the second and third are similar (0.81); the first is no copy but nearer to both by fingerprint.
    rows = [(3 * n + k, t) for n, seed in enumerate((5762, 10352)) for k, t in enumerate(edited(seed))]
    left = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile)
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 1, 3, 4]


def test_similar_links_are_those_of_all_pairs():
    from itertools import combinations

    made = [t for seed in range(40) for t in edited(seed, 30, 5)] + ["", " "]
    sets = [simhash.shingles(t) for t in made]
    n, sizes = np.arange(len(made)), np.array([len(s) for s in sets])
    values = np.array([simhash.sketch(t)[0] for t in made]).view(np.uint64)
    a, b = simhash.similar_links(values, n * 0, n, n, np.concatenate(sets), sizes, 0.7, 64)
    alike = [(i, j) for i, j in combinations(range(len(made)), 2) if len(np.intersect1d(sets[i], sets[j])) >= 0.7 * len(np.union1d(sets[i], sets[j]))]
    assert union(len(made), zip(a.tolist(), b.tolist())) == union(len(made), alike) and 0 < len(alike)


def test_similar_texts_of_few_shingles_meet_whatever_their_bits(spark):
    rows = []
    for seed in (17, 65, 83):  # 5 and 4 shingles, similarity 0.8, fingerprints 19 or 20 bits apart
        r = random.Random(seed)
        w = [f"w{r.randrange(10**6)}" for _ in range(9)]
        rows += [(2 * len(rows), " ".join(w)), (2 * len(rows) + 1, " ".join(w[:-1]))]
    left = simhash.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 4, 8]


def test_windows_outside_a_copy_hide_no_leak():
    item = "Tom has 12 apples and gives 5 apples to Anna who eats 12 of them in 3 hours before the school bus comes back to the old market and takes Tom home again with 4 friends"
    m = decontaminate.Matcher([(1, item)])
    lost = item.replace("Tom has 12 apples and", "Tom holds 12 apples and")
    stray = "Yesterday Bob has 77 apples and nothing. "
    variant = item.replace("12", "13", 1).replace("Anna", "Lisa") + ". "
    assert [len(x) for x in m.match([lost, stray + "Well. " + lost, lost + ". " + stray, variant + lost, lost + ". " + variant])] == [1] * 5
    # An item whose own copy is inconsistent is no leak, whatever stands beside it.
    mixed = item.replace("eats 12", "eats 14")
    assert m.match([mixed, stray + mixed, mixed + ". " + stray]) == [[], [], []]
    short = "Tom has 12 apples and gives 5 apples to Anna who eats 12 of them in 3 hours"
    wrong = short.replace("eats 12", "eats 14")
    assert decontaminate.Matcher([(2, short)]).match([wrong, wrong + ". " + wrong]) == [[], []]


def brute_texts(rows):
    """Main texts by comparing all pages of a host with each other, word by word."""
    host = lambda url: (url or "").split("/")[2] if url else ""
    cut_pages = [(host(url), url, html_text.blocks_of(html)) for _, url, html in rows]
    run = html_text.RUN

    def grams(ws):
        return {tuple(ws[k : k + run]) for k in range(len(ws) - run + 1)}

    def left(words, spans, bad):
        """The blocks' words (spans of the stream) without those under the given grams."""
        gone = [False] * len(words)
        for k in range(len(words) - run + 1):
            if tuple(words[k : k + run]) in bad:
                gone[k : k + run] = [True] * run
        return [" ".join(w for w, g in zip(words[a:b], html_text.within(np.array(gone[a:b], bool))) if not g) for a, b in spans]

    def stream(texts_):
        words, spans = [], []
        for t in texts_:
            spans.append((len(words), len(words) + len(t.split(" "))))
            words += t.split(" ")
        return words, spans

    out = []
    for h, url, blocks in cut_pages:
        mine = [(u, b) for g, u, b in cut_pages if g == h]
        loose, spans = stream([t for t, inside in blocks if not inside])
        others = set().union(*(grams(stream([t for t, inside in b if not inside])[0]) for u, b in mine if u != url), set())
        outer = left(loose, spans, others)
        around = {}
        for _, b in mine:
            ts = ["", *(t for t, _ in b), ""]
            for k, (t, inside) in enumerate(b):
                if inside:
                    around.setdefault(t, set()).add((ts[k], ts[k + 2]))
        n = len({u for u, _ in mine})
        bad = [t for t, places in around.items() if len(places) >= max(4, 0.5 * n)]
        own = [t for t, inside in blocks if inside]
        words, spans = stream(own)
        here = [t for t in bad if t in own]
        inner = ["" if t in here else x for t, x in zip(own, left(words, spans, set().union(*(grams(t.split(" ")) for t in here), set())))]
        size = lambda ts: sum(len(t.split(" ")) for t in ts if t)
        teaser = size(outer) >= 2 * size(inner)
        a, b = iter(inner), iter(outer)
        out.append("\n\n".join(t for t in [next(a) if inside else next(b) for _, inside in blocks if inside or teaser] if t))
    return out


def site_pages():
    r = random.Random(8)
    say = lambda n: " ".join(r.choice("bcdfglmn") + r.choice("aeiou") + r.choice("rst") + r.choice("aeiou") for _ in range(n))
    call, line, copied = "Read all the other stories of this paper for one single euro a week", "Follow us", [say(20) for _ in range(3)]
    rows = []
    for k in range(40):
        host = "a.org" if k < 26 else "b.org" if k < 38 else "c.org"
        body = [say(r.randint(3, 25)) for _ in range(r.randint(2, 4))]
        inside = list(copied) if k % 5 == 0 else body  # a story that many pages print
        inside = inside[:1] + [line] + inside[1:]
        inside = inside[:-1] + [f"{inside[-1]} {call}"] if k % 7 == 0 else [*inside, call]
        outside = f"<div>All rights reserved by the owner of this very site</div><div>{say(4)}</div>"
        if k % 13 == 4:  # the article elements are teasers
            outside += f"<div>{say(90)}</div>"
            inside = [say(5)]
        tag = ("article", "main", "div")[k % 3]
        rows.append((k, f"https://{host}/{k}", f"<nav>menu</nav><{tag}>{''.join(f'<p>{t}</p>' for t in inside)}</{tag}>{outside}<footer>end</footer>"))
    return rows + [(40, "https://a.org/5", rows[5][2]), (41, None, "<article><p>no host here</article>"), (None, None, None), (42, "https://a.org/e", "")]


def test_html_text_equals_comparing_all_pages(spark):
    rows = site_pages()
    want = Counter((k, u, t) for (k, u, _), t in zip(rows, brute_texts(rows)))
    assert any("Follow" not in t and t for _, _, t in want) and any("euro" in (h or "") for _, _, h in rows)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions, group in ((1, 400), (4, 3), (64, 400)):
            spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
            assert Counter((r["page_id"], r["url"], r["text"]) for r in html_text.main_texts(pages, group).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_repeat_across_groups_of_a_host(spark):
    notice = "<div>All rights reserved by the owner of this very site</div>"
    rows = [(k, f"https://b.org/{k}", f"{notice if k % 9 == 0 else ''}<p>Page {k} says something of its own</p>") for k in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for group in (1, 3, 400):
        assert {r["text"] for r in html_text.main_texts(pages, group).collect()} == {f"Page {k} says something of its own" for k in range(30)}


def test_added_tokens_in_a_text_have_their_ids():
    from tokenizers import Tokenizer

    plain, e = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path())
    for t in ["a <|endoftext|> b", "<|endoftext|>", "x  <|endoftext|><|endoftext|>  y \n<|endoftext", "no token"]:
        assert plain.encode(t, add_special_tokens=False).ids == e.encode(t).tolist()
    assert 50256 in e.encode("a<|endoftext|>b").tolist()


def test_encoder_splits_ascii_and_other_texts_as_the_library():
    import random

    from tokenizers import Tokenizer

    plain, e, draw = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path()), random.Random(7)
    for k in range(4000):
        text = "".join(draw.choices("ab1 '\t\n\r\x0b\x0c\x1c\x1f\x00sdlverm_.-" + ("é²\x85\xa0中" if k % 2 else ""), k=draw.randint(0, 14)))
        assert e.encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids, repr(text)
