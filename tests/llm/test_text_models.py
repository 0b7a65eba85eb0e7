from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import bytenet, html_text, language


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1


def test_language(documents, corpus, nothing):
    got = language.language_id(documents).collect()
    assert len(got) == len(corpus)
    by = {r["doc_id"]: r for r in got}
    for i, text, lang, _ in corpus:
        r = by[i]
        assert r["held_out"] == held(i) and 0 <= r["score"] <= 1
        if not text or not any(c.isalpha() for c in text):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "fr")
    sure = [(by[i]["lang_pred"], lang) for i, text, lang, _ in corpus if i is not None and i < 160 and held(i)]
    assert sum(a == b for a, b in sure) / len(sure) >= 0.95
    assert language.language_id(nothing).count() == 0


def test_lookup_is_a_filter_for_all_languages():
    samples = {f"l{k}": [f"{'abcdefghij'[k % 10]}{k:03d} " * 30] for k in range(70)}  # more languages than bits in a word
    m = language.fit(samples, language.Settings(sizes=(4,), row_bits=14))
    for k in (0, 63, 64, 69):
        assert language.predict(m, samples[f"l{k}"][0])[0] == f"l{k}"
    assert language.predict(m, "12 34")[0] == "und"
    assert language.predict(language.fit({}), "text")[0] == "und"


def test_every_language_with_a_row_is_learned(spark):
    rows = [(i, "the cat sat on the mat and the dog", "en") for i in range(60)] + [(100, "zwei kleine schafe gingen zwei kleine", "de"), (100, "zwei kleine schafe gingen zwei kleine", "de")]
    rows = [r for r in rows if not held(r[0])]
    assert {r[2] for r in rows} == {"en", "de"}
    m = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.languages == ["de", "en"] and language.predict(m, "kleine zwei")[0] == "de" and language.predict(m, "the mat")[0] == "en"


def test_numerals_are_no_letters():
    m = language.fit({"en": ["the cat sat on the mat"] * 3})
    for text in ("²½", "Ⅷ", "12 ³", "_"):
        assert language.predict(m, text)[0] == "und"
    assert language.predict(m, "² the")[0] == "en"


def test_lookup_by_brute_force(corpus):
    """Sets of typical n-grams instead of a filter's rows; the filter is large, so that chance adds next to nothing."""
    samples = {"en": [t for i, t, g, _ in corpus if g == "en" and t and not held(i)][:60], "fr": [t for i, t, g, _ in corpus if g == "fr" and t and not held(i)][:60]}
    s = language.Settings(row_bits=22)
    m = language.fit(samples, s)
    typical = {}
    for n in s.sizes:
        counts = {}
        for name, texts in samples.items():
            raw = "\n".join(texts).lower().encode()
            own = {}
            for k in range(len(raw) - n + 1):
                own[raw[k : k + n]] = own.get(raw[k : k + n], 0) + 1
            counts[name] = own, len(raw)
        share = lambda name, g, counts=counts: counts[name][0].get(g, 0) / counts[name][1]
        for name in samples:
            typical[name, n] = {g for g, c in counts[name][0].items() if c >= s.least_count and share(name, g) >= s.least_ratio * max(share(x, g) for x in samples)}
    for _, text, _, _ in corpus:
        if not text or not any(c.isalpha() for c in text) or len(text.encode()) < 5:
            continue
        raw = text.lower().encode()
        want = np.array([sum(raw[k : k + n] in typical[x, n] for n in s.sizes for k in range(len(raw) - n + 1)) for x in m.languages])
        got, places = language.hits(m, np.frombuffer(raw, np.uint8))
        assert places == sum(max(0, len(raw) - n + 1) for n in s.sizes)
        assert np.abs(got - want).max() <= 2 + 0.002 * places
        if abs(want[0] - want[1]) > 4 + 0.004 * places:
            assert language.predict(m, text)[0] == m.languages[int(np.argmax(want))]


def test_held_out_languages(spark):
    got = language.language_id(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    true = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang IS NOT NULL").select("doc_id", "lang")
    rows = got.filter("held_out AND lang_pred <> 'und'").join(true, "doc_id").collect()
    assert len(rows) > 200 and sum(r["lang_pred"] == r["lang"] for r in rows) / len(rows) >= 0.95


def test_long_texts_are_taken_in_parts(monkeypatch):
    m = language.fit({"en": ["the cat sat on the mat"] * 3, "fr": ["le chat est sur la table"] * 3})
    data = np.frombuffer(b"the cat sat on the mat " * 200, np.uint8)
    whole = language.hits(m, data)
    monkeypatch.setattr(language, "PART", 97)
    parts = language.hits(m, data)
    assert whole[1] == parts[1] and np.allclose(whole[0], parts[0])


def test_quality(spark, documents, corpus, nothing):
    quality = {i: int(not (text and "changed" in text)) for i, text, _, _ in corpus if i is not None}
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()] + [(9999, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    small = bytenet.Settings(filters=8, epochs=6, sample_docs=60)
    got = bytenet.quality_scores(documents, labels, settings=small).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == held(r["doc_id"])
    again = bytenet.quality_scores(documents, labels, settings=small)
    assert sorted(r["score"] for r in again.collect()) == sorted(r["score"] for r in got)
    assert bytenet.quality_scores(nothing, labels, settings=small).count() == 0
    none = bytenet.quality_scores(documents, labels.limit(0), settings=small)
    assert none.select(F.min("score"), F.max("score")).first()[:] == (0.5, 0.5)


def test_network_learns_and_parts_agree(monkeypatch):
    r = np.random.default_rng(0)
    texts = ["".join(r.choice(list("abcde fgh")) for _ in range(300)) for _ in range(80)]
    texts = [t if i % 2 else t[:150] + "ZQ#ZQ#" + t[150:] for i, t in enumerate(texts)]
    net = bytenet.fit(texts[:60], [i % 2 for i in range(60)], bytenet.Settings(filters=6, epochs=25))
    right = [int(net.score(t) >= 0.5) == i % 2 for i, t in enumerate(texts)][60:]
    assert sum(right) >= 18
    text = "some words # " * 300
    one = net.score(text)
    monkeypatch.setattr(bytenet, "PART", 512)
    assert abs(net.score(text) - one) < 1e-6
    late = "abc " * 5000 + "ZQ#ZQ#" * 20
    assert net.score(late) < net.score("abc " * 5000)  # the end of a long text counts


def test_convolution_by_brute_force():
    texts = ["ab c", "Some WORDS, and then some words and then some words 123", "x" * 700, ""]
    net = bytenet.fit(texts, [0, 1, 0, 1], bytenet.Settings(filters=5, epochs=2))
    s = net.settings
    for text in texts:
        data = text.encode()
        again = bytenet.repeats(np.frombuffer(data, np.uint8), s.repeat_bytes)
        best = []
        for begin in range(0, max(1, len(data)), s.chunk):
            found = np.full(s.filters, -np.inf)
            for at in range(begin, begin + s.chunk, s.step):
                value = net.bias.astype(float).copy()
                for k in range(s.width):
                    inside = at + k < len(data)
                    x = np.append(net.table[data[at + k] if inside else 256], again[at + k] if inside else 0.0)
                    value += x @ net.filters[k * len(x) : (k + 1) * len(x)]
                found = np.maximum(found, value)
            best.append(np.maximum(found, 0))
        best = np.array(best)
        z = np.concatenate([best.mean(axis=0), best.max(axis=0), [np.log1p(len(data)) / 5]]) @ net.head + net.offset
        assert abs(net.score(text) - 1 / (1 + np.exp(-z))) < 1e-4


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{x}.parquet") for x in ("documents", "labels"))
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = bytenet.quality_scores(some, labels, settings=bytenet.Settings(epochs=4)).filter("held_out").join(labels, "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in got) / len(got)
    assert len(got) > 1000 and right >= 0.8, right


def test_ids_that_repeat_are_sampled_within_bounds(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(3, 9)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(3 + i % 6, f"text {i}") for i in range(600)], "doc_id long, text string")
    seen = []
    bytenet_fit, bytenet.fit = bytenet.fit, lambda texts, marks, s: seen.append(len(texts)) or bytenet_fit([], [], s)
    try:
        bytenet.learn(docs, labels, settings=bytenet.Settings(sample_docs=20))
    finally:
        bytenet.fit = bytenet_fit
    assert 0 < seen[0] <= 80


def test_gradient():
    settings = bytenet.Settings(filters=3, epochs=1)
    net = bytenet.fit(["abc def", "XYZ!! ##"], [1, 0], settings)
    assert net.score(None) == net.score("") and 0 < net.score("") < 1


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<div class="main-menu"><a href=1>Home</a></div><div id=cookieNotice>We use cookies</div>
<div class=wrap><div class=post><h1>Head  line</h1><p>First paragraph of the text,\n with <b>bold</b> &amp; <a href=2>a link</a>.<p>Second<br>one &lt;here&gt;
<script>var x = "<p>no</p>";</script><ul><li>item one of the list<li>item two of the list</ul><!-- <p>hidden</p> --></div>
<div class="sidebar"><ul><li><a href=3>other</a></ul></div></div><form><p>Sign up</p></form><div class="comments"><p>Great post, thanks for all of it</p></div><footer>&copy; 2020</footer></body></html>"""


def test_main_text():
    assert html_text.extract(PAGE) == "Head line\nFirst paragraph of the text, with bold & a link.\nSecond one <here>\nitem one of the list\nitem two of the list"
    article = PAGE.replace("class=post", "class=x").replace("<div class=wrap>", "<div class=wrap><article>").replace('<div class="sidebar">', '</article><div class="sidebar">')
    assert html_text.extract(article) == html_text.extract(PAGE)


def test_odd_pages(spark):
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<html><body></body></html>") == ""
    assert html_text.extract("just text &eacute;") == "just text é"
    assert html_text.extract("<p>one</p></div></p><p>two <b>bold<p>three") == "one\ntwo bold\nthree"
    assert html_text.extract("<p>cut in a tag <a hre") == "cut in a tag"
    assert html_text.extract("<script>never closed <p>x") == ""
    assert html_text.extract("<p>a < b</p><p>x&nbsp;&nbsp;y</p>").split("\n")[-1] == "x y"
    assert "deep" in html_text.extract("<div>" * 3000 + "deep text" + "</div>" * 3000)
    pages = spark.createDataFrame([(1, "u", "<p>a</p>", 9), (None, None, None, 9), (1, "u", "<p>a</p>", 9)], "page_id long, url string, html string, text int")
    got = html_text.html_main_text(pages).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0)], key=repr)
    assert html_text.html_main_text(pages.limit(0)).count() == 0


LONG = " ".join(f"word{k} of the analysis" for k in range(40))


def test_names_alone_cut_nothing():
    nav = "<nav><a href=1>home</a></nav>"
    for name in ("market-share-analysis", "share", "related", "header-widgets"):
        page = f'{nav}<div class="{name}"><p>{LONG} one.</p><p>{LONG} two.</p><p>{LONG} three.</p></div>'
        assert html_text.extract(page) == f"{LONG} one.\n{LONG} two.\n{LONG} three.", name
    section = f'<article><h1>T</h1><p>{LONG}</p><div class="ad-hoc-networks"><h2>Ad hoc</h2><p>{LONG} b</p></div><p>{LONG} c</p></article>'
    assert html_text.extract(nav + section) == f"T\n{LONG}\nAd hoc\n{LONG} b\n{LONG} c"
    body = f'<div id="post-related-work"><p>{LONG}</p><p>{LONG}</p></div><div class="ad">Buy it</div>'
    assert html_text.extract(nav + body) == f"{LONG}\n{LONG}"
    only = f'{nav}<div class="comments"><p>{LONG}</p></div>'
    assert html_text.extract(only) == LONG


def test_headings_and_titled_sections_stay_whatever_their_ids():
    nav = "<nav><a href=1>home</a></nav>"
    heads = "".join(f'<h2 id="{x}">{x.title()} law</h2><p>{LONG} {x}</p>' for x in ("cookies", "related", "navigation", "comments"))
    assert html_text.extract(f"{nav}<article><h1>T</h1>{heads}</article>") == "\n".join(["T", *(y for x in ("cookies", "related", "navigation", "comments") for y in (f"{x.title()} law", f"{LONG} {x}"))])
    page = f'{nav}<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p><section id="related"><h2>Related work</h2><p>A short one.</p></section></article>'
    assert html_text.extract(page) == f"T\n{LONG}\n{LONG}\nRelated work\nA short one."
    links = "".join(f"<li><a href={k}>Another post {k}</a></li>" for k in range(4))
    page = f'{nav}<article><h1>T</h1><p>{LONG}</p><p>{LONG}</p><section id="related"><h2>Related</h2><ul>{links}</ul></section></article>'
    assert html_text.extract(page) == f"T\n{LONG}\n{LONG}"


def test_articles_of_the_given_pages():
    """All pages of a table whose article is marked: its words, nothing else."""
    import html
    import re

    import pyarrow.parquet as pq

    from tests.oracle import ROOT

    pages = pq.read_table(f"{ROOT}/sf0.01/pages.parquet").to_pylist()
    good = 0
    for page in pages:
        article = re.search(r"(?s)<article[^>]*>(.*?)</article>", page["html"])
        own = re.sub(r"(?s)<(script|style|aside|nav|form|div class=.?ad\b)[^>]*>.*?</(script|style|aside|nav|form|div)>", " ", article[1])
        good += html_text.extract(page["html"]).split() == html.unescape(re.sub(r"<[^>]+>", " ", own)).split()
    assert good >= 0.99 * len(pages)


def test_lists_of_links_inside_the_article_stay():
    links = "".join(f"<li><a href={k}>Reference {k}</a></li>" for k in range(5))
    page = f"<nav><ul>{links}</ul></nav><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p><ul>{links}</ul></article>"
    assert html_text.extract(page) == "\n".join(["T", LONG, LONG, *(f"Reference {k}" for k in range(5))])


def test_only_headings_of_the_article_stay():
    page = f"<div id=top><h1>SITE LOGO</h1></div><div class=content><h2>Head</h2><div><p>{LONG}</p><p>{LONG}</p></div></div>"
    assert html_text.extract(page) == f"Head\n{LONG}\n{LONG}"


def test_comments_go_where_an_article_is_left():
    said = "".join(f"<div class=comment><p>{LONG} {k}</p></div>" for k in range(6))
    page = f"<div class=story><p>{LONG}</p><p>{LONG}</p></div><div id=post-comments>{said}</div>"
    assert html_text.extract(page) == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("part", ['<p class="a>x', "<p a='x>", "<p don't a=1>", "<!--", "<![CDATA[", "<script>", "<b>", "</i><b>", "<div class=comments>", "<a b= ", "<"])
def test_time_is_linear(part):
    import time

    begin = time.process_time()
    html_text.extract(part * (1_000_000 // len(part)))
    assert time.process_time() - begin < 8


def slow_measures(node):
    """(characters, in links, tags, link tags) of a subtree, by looking at every text's ancestors."""
    texts, elements = [], []

    def walk(x, inside):
        for y in x.children:
            if isinstance(y, str):
                texts.append((y, inside))
            else:
                elements.append(y.name)
                walk(y, inside or y.name == "a")

    walk(node, node.name == "a")
    count = lambda ts: sum(not c.isspace() for t in ts for c in t)
    return count(t for t, _ in texts), count(t for t, i in texts if i), len(elements), elements.count("a") + (node.name == "a")


def test_densities_by_brute_force():
    r = np.random.default_rng(7)

    def made(depth):
        out = []
        for _ in range(r.integers(1, 5)):
            kind = r.choice(["div", "p", "a", "b", "section", "text"])
            inner = made(depth - 1) if depth and kind != "text" and kind != "a" else "some words " * int(r.integers(0, 6))
            out.append(inner if kind == "text" else f"<{kind}>{inner}</{kind}>")
        return "".join(out)

    for _ in range(40):
        root = html_text.parse(made(3))
        nodes = html_text.measure(root)
        c, lc, _, _ = slow_measures(root)
        share = lc / max(1, c)
        densities = {}
        for node in nodes:
            c, lc, t, lt = slow_measures(node)
            assert (node.chars, node.tags, node.link_tags) == (c, t, lt)
            t, lt = max(1, t), max(1, lt)
            base = np.log(c / max(1, c - lc) * lc + share * c + np.e)
            densities[id(node)] = max(0.0, np.log(max(1.0, c / max(1, lc) * t / lt)) / base) * c / t if c else 0.0
            assert node.density == pytest.approx(densities[id(node)])

        def total(node):
            return sum(total(x) if x.name in html_text.INLINE else densities[id(x)] for x in node.children if not isinstance(x, str))

        best = max(total(x) for x in nodes)
        assert root.best.total == pytest.approx(best)
        html_text.select(root)
        assert any(x.main and x.total == pytest.approx(best) for x in nodes) or best == 0
