"""Each operator against a brute-force version on the odd rows, and on the empty table."""

import hashlib
import json
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import no_docs, odd_docs, odd_texts, prose
from pyspark.sql import functions as F

from shelfrank.llm import (decontaminate, html_extract, license_scan, lm_score, packing, quality, simhash, suffix_dedup,
                           toxicity, url_filter)
from shelfrank.llm.html_blocks import blocks_of


def raw(t):
    return (t or "").encode()


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


# 1 ---------------------------------------------------------------------------------------------

def brute_spans(texts, length=200):
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                cover[i:i + length] = True
        out.append(cover)
    return out


def expected_report(docs):
    rows = rows_of(docs)
    texts = [raw(t) for _, t in rows]
    out = []
    for (d, _), t, c in zip(rows, texts, brute_spans(texts)):
        left = np.frombuffer(t, np.uint8)[~c].tobytes()
        runs = int((np.diff(np.r_[0, c.astype(int)]) == 1).sum())
        out.append((d, len(t), int(c.sum()), runs, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def shared_passages():
    p = prose(50, 45)  # over 200 bytes
    a = [prose(60 + i, 40) + " " + p[i:len(p) - (i % 7)] + " " + prose(90 + i, 30) for i in range(25)]
    return [*a, p[:200], p[1:202], p[:199], "z" * 450, prose(60, 40), "q" * 199, (prose(7, 8) + " ") * 9]


@pytest.mark.parametrize("hot", [2_000, 3])
def test_suffix_dedup_equals_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (hot, 50))
    for docs in (odd_docs(spark, [t for t in odd_texts() if not t or len(t) < 20_000]), odd_docs(spark, shared_passages())):
        got = sorted((tuple(r) for r in suffix_dedup.report(docs).collect()), key=str)
        assert got == expected_report(docs)


def test_suffix_samples_over_chunks(monkeypatch):
    t = raw(prose(9, 3_000))
    whole = {tuple(x) for x in zip(*suffix_dedup.samples(t)[:1])}
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1_000)
    parts = suffix_dedup.samples(t)
    assert {tuple(x) for x in zip(*parts[:1])} == whole
    starts = sorted((a, b) for a, b in zip(parts[1], parts[2]))
    assert [s for a, b in starts for s in range(a, b + 1)] == list(range(len(t) - 199))


def test_suffix_strip(spark):
    p = prose(50, 45)
    out = {r["doc_id"]: r for r in suffix_dedup.strip(odd_docs(spark, [prose(1, 30) + p, prose(2, 30) + p, None, "", "é" * 300, prose(3, 50)])).collect()}
    assert out[5]["text"] == prose(3, 50) and out[2]["text"] is None and out[3]["text"] == ""
    assert 1 in out and p not in out[1]["text"] and out[1]["n_chars"] == len(out[1]["text"])
    assert set(out) == {1, 2, 3, 5}  # 0 is repeated as a row, 4 lost everything; both go
    assert suffix_dedup.strip(no_docs(spark)).count() == 0 == suffix_dedup.report(no_docs(spark)).count()


# 2 ---------------------------------------------------------------------------------------------

def test_license_base(spark):
    texts = ["Released UNDER the MIT-License; under the mit license", "apache license, version 2 cc by-nc", None, "", "under the mit",
             "x\nunder the\nmit license7", "SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND Apache-2.0", "underthe mit license",
             "a under the mit license under the mit license"]
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for r in license_scan.scan_licenses(odd_docs(spark, texts + odd_texts())).collect():
        t = (texts + odd_texts())[r["doc_id"]] if r["doc_id"] is not None else "under the mit"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = sorted((i, lab) for p, lab in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())
        assert (r["n_words"], r["n_base"]) == (len(w), len(at))
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert r["base_labels"] == ",".join(sorted({lab for _, lab in at}))
        assert {*filter(None, r["base_labels"].split(","))} <= {*r["labels"].split(",")}
        assert 0 <= r["score"] <= 1
    assert license_scan.scan_licenses(no_docs(spark)).count() == 0


def test_license_expressions():
    ev = license_scan.expression_labels
    assert ev("MIT OR GPL-2.0") == ({"mit", "gpl"}, True)
    assert ev("MIT AND GPL-2.0") == ({"mit", "gpl"}, False)
    assert ev("GPL-2.0 WITH Classpath-exception-2.0 OR (ISC AND MIT) and more prose") == ({"gpl", "isc", "mit"}, True)
    assert ev("MIT and this is prose")[0] == {"mit"}
    assert ev("AND") is None and ev("") is None and ev("(MIT") is None


def test_license_identifiers_and_longest_notices():
    auto = license_scan.automaton()

    def said(text):
        return license_scan.scan(auto, text)[5:]

    tag = "SPDX-License-Identifier: "
    for text, labels, score in [
            (tag + "mitigation", "", 0.0), (tag + "CC-BY-ND-4.0", "cc-by-nd", 0.5), (tag + "EPL-2.0", "epl", 1.0),
            (tag + "EUPL-1.2", "eupl", 1.0), (tag + "GPL-2.0-or-later WITH Classpath-exception-2.0", "gpl", 0.5),
            (tag + "GPL-3.0+ OR MIT", "gpl,mit", 1.0), (tag + "CC-BY-NC-SA-3.0-DE", "cc-by-nc,cc-by-nc-sa", 0.5), (tag + "Apache-2.0-or-later", "apache-2", 1.0),
            ("Creative Commons Attribution-NonCommercial", "cc-by-nc", 0.5), ("creative commons attribution", "cc-by", 1.0),
            ("Creative Commons Attribution Non-Commercial No-Derivatives", "cc-by-nc-nd", 0.5), ("CC BY-SA 4.0", "cc-by-sa", 1.0),
            ("GNU Lesser General Public License", "lgpl", 1.0), ("gnu general public license, mozilla public license", "gpl,mpl", 0.5)]:
        assert said(text) == (labels, score), text
    assert said("cc by nc sa") == ("cc-by-nc,cc-by-nc-sa", 0.5)  # a base label stays


def test_license_long_text():
    import time
    auto, n = license_scan.automaton(), 450_000  # 4 MB of base phrases
    at = time.perf_counter()
    got = license_scan.scan(auto, "cc by-nc " * n)
    assert got[:6] == (3 * n, n, 0, 3 * (n - 1), "cc-by-nc", "cc-by-nc") and time.perf_counter() - at < 5


# 3 ---------------------------------------------------------------------------------------------

PAGE = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>'
        '<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now</div>'
        '<article><h1>Title &amp; more</h1><p><b>First  para<br>graph.<p>Second &eacute; one.</p><ul><li>Point</ul></article>'
        '<div class="comments"><p>nice post</p></div><div id="cookie">We use cookies</div><form><label>Mail</label></form>'
        '<footer>&copy; us</footer>')
TEXT = "Title & more\nFirst para graph.\nSecond é one.\nPoint"


def test_html_extraction(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = html_extract.train_labeller(pages, 80)
    own = spark.createDataFrame([(1, "u", PAGE, 1), (2, None, None, 1), (3, "u", "", 1), (1, "u", PAGE, 1), (4, "u", "<", 1), (5, "u", "&amp", 1)],
                                "page_id long, url string, html string, text int")
    got = {r["page_id"]: r for r in html_extract.extract_text(own, model).collect()}
    assert got[1]["text"] == TEXT and got[1]["n_chars"] == len(TEXT)
    assert got[2]["text"] == got[3]["text"] == "" and got[2]["n_chars"] == 0
    # every block of the given pages is named by its container: held-out accuracy over blocks
    rows = pages.collect()
    done = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages, model).collect()}
    right = sum(done[r["page_id"]] == "\n".join(b.text for b in blocks_of(r["html"]) if html_extract.known_label(b) == 1) for r in rows)
    assert right >= 0.99 * len(rows)
    assert html_extract.extract_text(own.where("false")).count() == 0


def test_blocks_of_broken_markup():
    got = [(b.path, b.text) for b in blocks_of('<p title="a>b" data-x=it\'s>One</p><div class="x\'y">Two<p>Three <a href=\'q>\'>l</a><li>F')]
    assert got == [(("p",), "One"), (("div", "class=x", "class=y"), "Two"), (("div", "class=x", "class=y", "p"), "Three l"),
                   (("div", "class=x", "class=y", "p", "li"), "F")]
    assert [b.text for b in blocks_of("a < b &lt; c &amp d <!-- no <p>x")] == ["a < b < c & d"]
    assert [b.text for b in blocks_of("<p>x</p><a " + 'b="c" ' * 5_000)] == ["x"]
    assert blocks_of("<script>" + "<p>y</p>" * 10_000) == []


def test_blocks_keep_article_text():
    def texts(page):
        return [b.text for b in blocks_of(page)]
    assert texts("<html><head><title>t</title><meta charset=x><article><p>One</p>two</article>") == ["One", "two"]
    assert texts("<head><style>s</style>bare<p>One") == ["bare", "One"]
    assert texts("<head><title>t</title></head><body><p>One") == ["One"]
    assert texts("<p>a <svg width=1 /> b</p><p>c</p><svg><path/><text>no</text></svg><p>d") == ["a b", "c", "d"]
    assert texts("<p>a</p><svg><path d='x'><p>b</p><svg><g></svg><p>c") == ["a", "b", "c"]
    assert texts("<p>with <math><msup><mi>x</mi><mn>2</mn></msup></math> and <math/> on</p><p>b") == ["with x2 and on", "b"]
    assert texts("<math><mi>y</mi><annotation encoding=tex>y</annotation></math><p>b") == ["y", "b"]
    assert texts("<object data=x><p>fall back</p></object><p>b") == ["fall back", "b"]
    for tag in ("select", "noscript", "template"):
        assert texts(f"<p>a</p><{tag}><b>no</b></{tag}><p>b</p><{tag}><p>c") == ["a", "b", "c"]
    assert texts("<p>x</p>" + "<template><svg>" * 20_000 + "<p>y") == ["x", "y"]


def test_html_long_and_deep_pages():
    """A page of 50,000 blocks among small ones, and one of 50,000 open tags."""
    import resource
    small = [html_extract.Page(blocks_of(PAGE), {}) for _ in range(63)]
    long = blocks_of("<main>" + "<p>one two three</p>" * 50_000 + "</main>")
    deep = blocks_of("".join(f"<div class=c{i % 9}>w{i}" for i in range(50_000)))
    assert len(long) == len(deep) == 50_000 and deep[2].path == ("div", "class=c0", "div", "class=c1", "div", "class=c2")
    model = html_extract.Labeller()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = model.label([*small, html_extract.Page(long, {}), html_extract.Page(deep, {})])
    grown = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before  # kB
    assert grown < 500_000 and [len(p) for p in out[-2:]] == [50_000, 50_000]
    alone = model.label(small[:1])[0]
    assert all(np.allclose(p, alone, atol=1e-6) for p in out[:63])
    assert np.isnan(html_extract.known_labels(deep)).all() and (html_extract.known_labels(long) == 1).all()


def test_html_training_takes_long_pages(spark):
    """Pages behind long comments train and read like the pages without."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plain = {r["page_id"]: r["text"] for r in html_extract.extract_text(pages).collect()}
    behind = pages.withColumn("html", F.concat(F.lit("<!--" + "x " * 25_000 + "-->"), F.col("html")))
    assert {r["page_id"]: r["text"] for r in html_extract.extract_text(behind).collect()} == plain
    assert sum(map(len, html_extract.sample_pages(behind, 200, 120_000))) <= 120_000
    assert [len(h) for h in html_extract.sample_pages(behind, 200, 10)] == [10]
    assert html_extract.sample_pages(pages.where("false"), 200, 10) == []


def test_lstm_embedding_gradients():
    pages = [html_extract.Page(blocks_of(PAGE), {}), html_extract.Page(blocks_of("bare <b>x</b>" + PAGE)[:4], {})]
    m = html_extract.Labeller()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    longest = max(p.n for p in pages)
    y, known = np.zeros((2, longest)), np.ones((2, longest))
    y[:, 2:5] = 1
    known[1, 4:] = 0
    _, g = m.gradients(pages, y, known)
    for k in ("path", "word"):
        for at in zip(*np.unravel_index(np.argsort(-np.abs(g[k]).ravel())[:4], g[k].shape)):
            m.w[k][at] += 1e-3
            up = m.gradients(pages, y, known)[0]
            m.w[k][at] -= 2e-3
            down = m.gradients(pages, y, known)[0]
            m.w[k][at] += 1e-3
            assert abs((up - down) / 2e-3 - g[k][at]) < 2e-2 * abs(g[k][at]) + 2e-5


def test_lstm_gradients():
    pages = [html_extract.Page(blocks_of(PAGE), {}), html_extract.Page(blocks_of(PAGE)[:4], {})]
    m = html_extract.Labeller()
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    y = np.zeros((2, pages[0].n))
    y[:, 2:5] = 1
    known = np.ones_like(y)
    known[1, 4:] = 0
    _, g = m.gradients(pages, y, known)
    for k in ("xf", "xb", "hf", "hb", "bf", "out"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        m.w[k][at] += 1e-4
        up = m.gradients(pages, y, known)[0]
        m.w[k][at] -= 2e-4
        down = m.gradients(pages, y, known)[0]
        m.w[k][at] += 1e-4
        assert abs((up - down) / 2e-4 - g[k][at]) < 2e-3 * abs(g[k][at]) + 2e-5


# 4 ---------------------------------------------------------------------------------------------

def brute_fingerprint(t):
    w = raw(t).lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_components(spark):
    near = [prose(200, 400) + f" v{i}" for i in range(6)] + [prose(200 + i, 30) for i in range(20)]
    docs = odd_docs(spark, odd_texts() + near)
    rows = rows_of(docs)
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            root[i] = min(root[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4)
    ids = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            ids[r] = min(d, ids.get(r, d))
    want = sorted((str(d), f"{f:016x}", ids.get(r)) for (d, _), f, r in zip(rows, fps, root))
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(ids.values())
    assert simhash.near_duplicates(no_docs(spark)).count() == 0 == simhash.keep_one(no_docs(spark)).count()


def test_vantage_point_shards_lose_no_link():
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 200, dtype=np.uint64)
    flips = np.uint64(1) << r.integers(0, 63, (4, 200, 10), dtype=np.uint64)
    fps = np.unique((base[:, None] ^ flips[0] ^ flips[1] ^ flips[2] ^ flips[3]).ravel())
    fps = np.unique(np.concatenate([fps, r.integers(0, 1 << 63, 2_000, dtype=np.uint64)]))
    nodes = simhash.build_tree(fps[::7], 4, r)
    idx, shard, home = simhash.shards_of(fps, nodes, 4)
    assert home.sum() == len(fps)
    total, want = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    for s in np.unique(shard):
        at = shard == s
        own, f = idx[at], simhash.Forest(at.sum())
        simhash.match(fps[own], np.arange(len(own)), np.flatnonzero(home[at]), 4, f)
        total.link(own, own[f.roots()])
    i, j = np.nonzero(simhash.distance(fps[:, None], fps[None, :]) <= 4)
    want.link(i, j)
    assert (total.roots() == want.roots()).all()


def test_star_components(spark):
    r = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, int(x)) for x in range(101, 140)] + [tuple(map(int, r.integers(200, 260, 2))) for _ in range(40)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["node"]: x["root"] for x in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: m for n, m in root.items() if n in got}
    assert all(root[n] == n for n in root if n not in got)


# 5 ---------------------------------------------------------------------------------------------

def brute_leaks(docs, items):
    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def grams(w):
        return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4)))
    out = {}
    for d, t in docs:
        w = words(t)
        for k, it in items:
            iw = words(it)
            if not iw or not w:
                continue
            g = grams(iw)
            best = 0
            for s in range(max(1, len(w) - len(iw) + 1)):
                h = grams(w[s:s + len(iw)])
                best = max(best, sum((g & h).values()) / sum((g | h).values()))
            if best >= 0.8:
                out[(d, k)] = best
    return out


def test_decontamination_equals_brute_force(spark):
    item = prose(300, 60)
    w = item.split()
    items = [(1, item), (2, prose(301, 12)), (3, "short one"), (4, ""), (5, None), (6, "la " * 20)]
    texts = [prose(310, 50) + " " + item + " " + prose(311, 50), item.upper(), " ".join(w[:30] + ["new"] + w[30:]), " ".join(w[3:]),
             " ".join(w[:30]), "a short, one b", None, "", prose(312, 300), prose(301, 12) + "!", "la " * 60, " ".join(w[4:] + w[:4]),
             prose(313, 40) + " " + " ".join([*w[:58], "zz", "yy"])]
    docs = odd_docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("start", F.lit(1))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(docs, bench).collect()}
    want = brute_leaks(rows_of(docs), items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    left = decontaminate.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in rows_of(docs)} - {d for d, _ in want}
    assert decontaminate.find_leaks(no_docs(spark), bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0


def test_decontamination_any_order_and_short_documents(spark):
    item = prose(300, 60)
    w = item.split()
    halves = " ".join(w[30:] + w[:30])
    longest = sorted(range(56), key=lambda i: -len(w[i]))[:7]
    short = " ".join(w[12:]) if max(longest) < 12 else None
    # cuts that take the seven probes of full windows but at most a fifth of the shingles
    words60 = ["internationalization" + str(i) if i < 7 else "w" + str(i) for i in range(60)]
    items = [(1, item), (2, " ".join(words60)), (3, "la " * 30 + "tea for two " * 3)]
    texts = [halves, prose(320, 50) + " " + halves + " " + prose(321, 50), " ".join(words60[7:]), " ".join(words60[11:]), " ".join(words60[12:]),
             prose(322, 20) + " " + " ".join(words60[7:]), "tea for two " * 3 + "la " * 30 + prose(323, 40),
             prose(324, 70) + " " + " ".join(w[40:] + w[20:40] + w[:20]), short]
    docs = odd_docs(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_leaks(docs, bench).collect()}
    want = brute_leaks(rows_of(docs), items)
    assert {(0, 1), (1, 1), (2, 2), (3, 2)} <= want.keys()
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_probe_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_PROBES", 4)
    item = prose(300, 60)
    docs, bench = odd_docs(spark, [item + " end", "none"]), spark.createDataFrame([(1, item), (2, prose(1, 40))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench).collect()} == {(0, 1)}


def test_decontamination_long_items(spark):
    """Work grows with the item, not with its cube: a leak of 2,000 words inside 20,000."""
    import time
    item = prose(330, 2_000)
    docs = odd_docs(spark, [prose(331, 9_000) + " " + item + " " + prose(332, 9_000), prose(333, 500) + " " + prose(330, 1_900), "la " * 5_000])
    bench = spark.createDataFrame([(1, item), (2, "la " * 1_500)], "item_id long, text string")
    decontaminate.find_leaks(odd_docs(spark, ["a b"]), bench).count()  # warm
    at = time.perf_counter()
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["similarity"]) for r in decontaminate.find_leaks(docs, bench).collect()}
    assert time.perf_counter() - at < 40
    assert got[0, 1] == (9_000, 1.0) and got[2, 2] == (0, 1.0) and 0.9 < got[1, 1][1] < 1.0 and len(got) == 3


def test_decontamination_plan_is_native(spark):
    docs, bench = odd_docs(spark, ["a"]), spark.createDataFrame([(1, prose(1, 40))], "item_id long, text string")
    plan = decontaminate.find_leaks(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)


# 6 ---------------------------------------------------------------------------------------------

def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdict(spark):
    docs = odd_docs(spark, odd_texts() + ["a\nb\na\n\n\na", "### $$$ &", "\u2003 x\x1c y"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = quality.judge(docs).collect()
    assert sorted(str((r["doc_id"], *(r[n] for n in names))) for r in out) == sorted(str((d, *brute_counts(t))) for d, t in rows_of(docs))
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"]) and r["kept"] is not None
    assert quality.judge(no_docs(spark)).count() == 0


def test_quality_fences_follow_the_group(spark):
    calm = [prose(i, 80) for i in range(150)]
    loud = [prose(i, 80).replace(" ", " # ", 30) for i in range(150, 300)]
    wild = [prose(i, 80).replace(" ", " ### ") for i in range(2)]
    rows = ([(i, t, "en", "calm") for i, t in enumerate(calm)] + [(1000 + i, t, "en", "loud") for i, t in enumerate(loud)]
            + [(2000 + i, t, "en", "calm") for i, t in enumerate(wild)])
    out = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i] for i in range(150)) and all(out[1000 + i] for i in range(150)) and not out[2000] and not out[2001]


# 7 ---------------------------------------------------------------------------------------------

def test_url_filter(spark):
    urls = ["http://www.Example.com/en/x?q#f", "https://example.com/en/1", "https://a.b.example.com/en/", "http://example.com/de/",
            "https://x.net/es/1", "https://x.net/de/1", "net/es/", None, "", "https://example.com", "ftp://com/a?b", "http://notexample.com/en/",
            "http://com.org/x", "https://x.net?/es/", "https://x.org/en/#/a", "http://a.www.example.com/en/", "http://casino-win.example.org/",
            "x://y://com/", "http://EXAMPLE.net/ES/1"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls + urls[:1])], "page_id long, url string, rule string")
    rules = [(h, p, v) for v, h, p in url_filter.BASE_RULES]
    for r in url_filter.filter_urls(pages).collect():
        u = (urls + urls[:1])[r["page_id"]] or ""
        host = path = ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = host.lower()
        fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path)
        if fit:
            assert (r["rule"], r["verdict"]) == max(fit)[1:]
        else:
            assert r["rule"] is None and r["verdict"] == ("block" if "casino" in u else "allow")
    assert url_filter.filter_urls(pages.where("false")).count() == 0


def test_url_rule_that_ends_inside_a_word(spark):
    urls = ["https://example.com/products/1", "https://example.com/prod", "https://example.com/pro", "https://example.com/a/bc", "https://x.org/prod"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    base = [("block", "example.com", "/prod"), ("block", "example.com", "/a/b")]
    got = {r["page_id"]: r["rule"] for r in url_filter.filter_urls(pages, base).collect()}
    assert got == {0: "example.com/prod", 1: "example.com/prod", 2: None, 3: "example.com/a/b", 4: None}


# 8 ---------------------------------------------------------------------------------------------

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    docs = odd_docs(spark, odd_texts() + ["a <|endoftext|> b", "emoji \U0001F600 \ufffd"]).repartition(5)
    tok = Tokenizer.from_file(packing.tokenizer_paths()[0])
    got = [r.asDict() for r in packing.pack(docs, packing.tokenizer_paths(), fan_in=2).collect()]
    ids = {(d, t): [*tok.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows_of(docs)}
    pieces = Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got)
    covered = Counter()
    for (d, s, n, crc, total), k in pieces.items():
        assert any(a == d and len(v) == total and zlib.crc32(np.array(v[s:s + n], "<u4").tobytes()) == crc for (a, _), v in ids.items())
        covered[d] += n * k
    want = Counter()
    for d, t in rows_of(docs):
        want[d] += len(ids[(d, t)])
    assert covered == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 1024
    assert packing.pack(no_docs(spark), packing.tokenizer_paths()).count() == 0


def test_fast_ids_equal_tokenizers(spark):
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(packing.tokenizer_paths()[0]), packing.Encoder(*packing.tokenizer_paths())
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert enc(r[0]) == [*tok.encode(r[0], add_special_tokens=False).ids, 0]


def test_long_white_space_runs(spark):
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(packing.tokenizer_paths()[0]), packing.Encoder(*packing.tokenizer_paths())
    runs = ["\n" * 1_200_000, "a" + "\u00a0\n \t" * 300_001 + "b", "x " * 60_000 + " " * 1_050_000 + "y", " " * 199_999]
    for t in runs:
        assert enc(t) == [*tok.encode(t, add_special_tokens=False).ids, 0]
    docs = spark.createDataFrame([(1, runs[0]), (2, "end")], "doc_id long, text string")
    assert {r["doc_id"] for r in packing.pack(docs, packing.tokenizer_paths()).collect()} == {1, 2}


# 9 ---------------------------------------------------------------------------------------------

def test_lm_base_and_probability(spark):
    docs = odd_docs(spark, [t for t in odd_texts() if not t or len(t) < 20_000] + [prose(i, 200) for i in range(400, 440)])
    rows = rows_of(docs)
    counts, n = Counter(), 0
    for d, t in rows:
        if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2:
            w = [*raw(t).lower().split(), b"\n"]
            counts.update(w)
            n += len(w)
    out = lm_score.score_documents(docs, block_tokens=900).collect()
    want = []
    for d, t in rows:
        w = [*raw(t).lower().split(), b"\n"]
        want.append((str(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(np.log10((counts[x] + 1) / (n + len(counts) + 1)) for x in w), 6)))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == sorted(want)
    held = [r for r in out if r["held_out"] and r["n_tokens"] > 100]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm_score.score_documents(no_docs(spark)).count() == 0


def test_lm_factors_sum_to_one():
    w, r = lm_score.Weights(), np.random.default_rng(0)
    w.classes += r.standard_normal(w.classes.shape)
    w.members += r.standard_normal(w.members.shape)
    h = r.integers(0, 1 << 63, 5, dtype=np.uint64)
    feats = lm_score.contexts(h, np.array([3, 2]))
    total = 0
    for b in range(256):
        pc, pm, _, _ = lm_score.predict(w, feats, np.full(5, b))
        total = total + pc[:, b // 16] * pm[:, b % 16]
    assert np.allclose(total, 1, atol=1e-4)


# 10 --------------------------------------------------------------------------------------------

def brute_segments(s):
    """Maximal segments by definition: the best run, then the same left and right of it."""
    best = None
    for a in range(len(s)):
        total = 0.0
        for b in range(a, len(s)):
            total += s[b]
            if total > 0 and (best is None or total > best[2] + 1e-9 or (abs(total - best[2]) <= 1e-9 and b + 1 - a < best[1] - best[0])):
                best = (a, b + 1, total)
    if best is None:
        return []
    a, b, t = best
    return brute_segments(s[:a]) + [(a, b, t)] + [(x + b, y + b, z) for x, y, z in brute_segments(s[b:])]


def test_maximal_segments():
    r = np.random.default_rng(2)
    for _ in range(300):
        s = list(np.round(r.normal(-0.2, 1, r.integers(1, 25)), 3))
        assert [(a, b, round(t, 6)) for a, b, t in toxicity.segments(s)] == [(a, b, round(t, 6)) for a, b, t in brute_segments(s)], s


def test_toxicity_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = toxicity.train_model(docs, labels)
    scored = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((scored[r["doc_id"]] >= 0.5) == bool(r["toxic"]) for r in held) >= 0.93 * len(held)
    odd = odd_docs(spark)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_documents(odd, model).collect())
    kept = toxicity.reject_toxic(odd, model)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert toxicity.score_documents(no_docs(spark), model).count() == 0
    none = toxicity.train_model(no_docs(spark), labels.where("false"))
    assert {r["score"] for r in toxicity.score_documents(odd, none).collect()} == {0.0}


def test_results_are_plain(spark):
    """Registered names and the integer ids the results carry."""
    from shelfrank.llm.queries import QUERIES
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))
    json.dumps(sorted(QUERIES))
