import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnworks.llm import cnn, htmltext, lm, shingles
from tarnworks.llm.common import read

from . import docs

SF = "/root/testdata/sf0.01"


def auc(labels, scores):
    order = np.argsort(np.argsort(scores)) + 1
    good = np.array(labels) == 1
    return (order[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_classifier_on_held_out_labels(spark):
    labels = read(spark, SF, "labels")
    rows = cnn.quality_classifier(read(spark, SF, "documents"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert auc([r.quality for r in held], [r.score for r in held]) > 0.9


def test_every_byte_counts():
    net = cnn.fresh()
    text = "a" * 5000
    whole, _ = cnn.pooled(cnn.padded(text + "b"), net)
    base, _ = cnn.pooled(cnn.padded(text + "a"), net)
    assert whole.shape == base.shape and not np.array_equal(whole, base)


def test_gradients_by_difference():
    rng, net = np.random.default_rng(1), {k: v.astype(np.float64) for k, v in cnn.fresh().items()}
    data, got = cnn.padded("some text with a few words " * 40), {k: np.zeros_like(v) for k, v in net.items()}
    cnn.gradients(data, 1.0, net, got)
    loss = lambda: np.log1p(np.exp(-cnn.forward(data, net)[0]))
    for name in ("outer", "inner", "bias", "inner_bias"):
        at = tuple(rng.integers(0, n) for n in net[name].shape)
        kept = net[name][at]
        net[name][at] = kept + 1e-5
        up = loss()
        net[name][at] = kept - 1e-5
        down = loss()
        net[name][at] = kept
        assert got[name][at] == pytest.approx((up - down) / 2e-5, abs=1e-4)


def test_classifier_rows(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int")
    assert cnn.quality_classifier(docs.docs(spark), labels).count() == len(docs.ROWS)
    assert cnn.quality_classifier(docs.empty(spark), labels).count() == 0
    assert {r.score for r in cnn.quality_classifier(docs.docs(spark), labels.limit(0)).collect()} == {0.5}


def test_language_model_prefers_order(spark):
    rng = random.Random(4)
    line = "the red fox saw the old dog and the old dog saw the red fox"
    rows = [(k, " ".join([line] * 6)) for k in range(60)]
    for k in range(20):
        words = rows[k][1].split()
        rng.shuffle(words)
        rows.append((1000 + k, " ".join(words)))
    got = {r.doc_id: r.mean_log_prob for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2, "doc_id")).collect()}
    assert min(v for k, v in got.items() if k < 1000) > max(v for k, v in got.items() if k >= 1000)


def test_language_model_rows(spark):
    rows = lm.lm_scores(docs.docs(spark)).collect()
    assert len(rows) == len(docs.ROWS)
    for r, row in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(docs.ROWS, key=lambda r: str(r[0]))):
        assert r.n_words == len((row[1] or "").encode().split())
        assert (r.mean_log_prob is None) == (r.n_words == 0)
    assert lm.lm_scores(docs.empty(spark)).count() == 0


def test_probabilities_sum_to_one():
    net = {k: v + 0.1 for k, v in lm.fresh().items()}
    around = [np.full(lm.WORDS, 3)] * len(lm.PLACES)
    assert np.exp(lm.log_probabilities(net, around, np.arange(lm.WORDS))).sum() == pytest.approx(1, abs=1e-5)


def test_rare_words_are_scored_as_words(spark):
    common = [f"c{k:03d}" for k in range(lm.WORDS - lm.SHARED)]
    rng, rare = random.Random(6), [f"r{k}" for k in range(300)]
    rows = [(k, " ".join(common * 4)) for k in range(4)]
    rows += [(10 + k, " ".join(rng.choices(rare + common[:50], [1 + j % 5 for j in range(350)], k=40))) for k in range(100)]
    rows += [(200, "alone c001 c002 alone other"), (201, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).cache()
    counts: dict[bytes, int] = {}
    for _, text in rows:
        for w in shingles.split(text):
            counts[w] = counts.get(w, 0) + 1
    hashed = {w: int(shingles.word_hashes(w.decode()).view(np.int64)[0]) for w in counts}
    assert len(set(hashed.values())) == len(counts)
    top = sorted(counts, key=lambda w: (-counts[w], hashed[w]))[: lm.WORDS - lm.SHARED]
    known, shares = lm.vocabulary(lm.counted(frame).cache())
    assert known.tolist() == [hashed[w] for w in top]
    numbers, totals = lm.Numbers(known), {}
    bucket = {w: int(numbers.of(w.decode())[0]) for w in counts}
    assert [bucket[w] for w in top] == list(range(len(top)))
    rest = set(counts) - set(top)
    for w in rest:
        totals[bucket[w]] = totals.get(bucket[w], 0) + counts[w]
    expected = {w: np.log(counts[w] / totals[bucket[w]]) for w in rest}
    assert len(expected) > 250 and min(bucket[w] for w in rest) >= lm.WORDS - lm.SHARED
    assert {r.word: (r.log_share, r.once) for r in shares.collect()} == {hashed[w]: (pytest.approx(x), counts[w] == 1) for w, x in expected.items()}
    net = lm.trained(frame, known)
    base = lm.scored(net, [numbers.of(text) for _, text in rows])
    wanted = {k: b + sum(expected.get(w, 0.0) for w in shingles.split(text)) for (k, text), b in zip(rows, base)}
    got = lm.lm_scores(frame).collect()
    assert {r.doc_id: r.log_prob for r in got} == pytest.approx(wanted, rel=1e-5)
    assert {r.doc_id: r.n_unseen for r in got} == {k: sum(counts[w] == 1 for w in shingles.split(text)) for k, text in rows}


def test_hashes_of_words(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(shingles, "SPAN", 64)
    monkeypatch.setattr(shingles, "LONG", 20)
    texts = ["".join(rng.choice("abAB \n\té ") for _ in range(rng.choice([0, 3, 30, 200, 900]))) for _ in range(400)] + ["x" * 50, "y" * 300 + " b", " " + "z" * 100 + " ", "X" * 50, None, "x" * 20]
    seen: dict[bytes, int] = {}
    for text, got in zip(texts, shingles.hashed(texts), strict=True):
        words = shingles.split(text)
        assert len(words) == len(got)
        for w, h in zip(words, got.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen) > 300


def test_one_step_equals_a_plain_one():
    rng = np.random.default_rng(5)
    padded = np.concatenate([np.full(3, lm.WORDS), rng.integers(0, 40, 700), np.full(3, lm.WORDS), rng.integers(0, 40, 90), np.full(3, lm.WORDS)]).astype(np.int32)
    net, memory = lm.fresh(), {k: np.full_like(v, 1e-6) for k, v in lm.fresh().items()}
    before = {k: v.copy() for k, v in net.items()}
    lm.step(net, memory, padded, 0, 600)
    at = [i for i in range(600) if padded[i + 3] < lm.WORDS]
    loss = lambda n: -lm.log_probabilities(n, [np.array([padded[i + 3 + p] for i in at]) for p in lm.PLACES], padded[[i + 3 for i in at]]).mean()
    wide = {k: v.astype(np.float64) for k, v in before.items()}
    for name, cell in (("around", (1, 7, 5)), ("around", (5, lm.WORDS, 2)), ("bias", (4,)), ("word", (0, 3, 6)), ("group", (2, 1))):
        own = wide[name][cell]
        wide[name][cell] = own + 1e-4
        up = loss(wide)
        wide[name][cell] = own - 1e-4
        slope = (up - loss(wide)) / 2e-4
        wide[name][cell] = own
        moved = lm.RATE * slope / (np.sqrt(1e-6 + slope**2) + 1e-6)
        assert before[name][cell] - net[name][cell] == pytest.approx(moved, rel=0.02, abs=1e-4)
    unseen = np.setdiff1d(np.arange(lm.WORDS), padded)
    assert np.array_equal(net["around"][:, unseen], before["around"][:, unseen])


def test_held_out_gain_over_counts_of_words(spark):
    table = read(spark, SF, "documents")
    mine, other = (table.where(f"doc_id % 2 = {k}") for k in (0, 1))
    counts = lm.counted(mine).cache()
    known, _ = lm.vocabulary(counts)
    numbers, net = lm.Numbers(known), lm.trained(mine, known)
    n = np.ones(lm.WORDS)
    for r in counts.collect():
        n[numbers.of_hashes(np.array([r.word]))[0]] += r.n
    texts = [numbers.of(r.text) for r in other.select("text").collect()]
    plain = np.log(n / n.sum())
    total = sum(map(len, texts))
    gain = (sum(lm.scored(net, texts)) - sum(plain[t].sum() for t in texts)) / total
    print("held-out gain, nats a word:", gain)
    assert gain > 0.15


def test_documents_that_occur_twice_are_scored_apart(spark):
    table = read(spark, SF, "documents")
    copies = Counter(r.text for r in table.collect())
    rows = lm.lm_scores(table).join(table, "doc_id").where("n_words >= 50").collect()
    twice, share = [int(copies[r.text] > 1) for r in rows], [-r.n_unseen / r.n_words for r in rows]
    assert sum(twice) > 5 and all(r.n_unseen == 0 for r in rows if copies[r.text] > 1)
    print("area:", auc(twice, share))
    assert auc(twice, share) > 0.9


def test_training_steps_of_4096_words(monkeypatch):
    seen = []
    monkeypatch.setattr(lm, "step", lambda net, memory, padded, start, stop: seen.append(stop - start))
    lm.fit_to(lm.fresh(), ["a " * 50_000], lm.Numbers(shingles.word_hashes("a").view(np.int64)))
    assert max(seen) == 4096 and sum(seen) >= 50_000


def test_scores_do_not_depend_on_company():
    net, rng = lm.fresh(), np.random.default_rng(2)
    texts = [rng.integers(0, lm.WORDS, n).astype(np.int32) for n in (0, 1, 5, 9000, 3)]
    assert lm.scored(net, texts) == pytest.approx([lm.scored(net, [t])[0] for t in texts], rel=1e-5)


@pytest.fixture(scope="module")
def trees():
    return htmltext.fit(pages=150)


def test_unseen_pages(trees):
    rng, right = random.Random(77), 0
    for _ in range(60):
        nodes = htmltext.parse(htmltext.training_page(rng))
        wanted = np.array([htmltext.MARK in x.text for x in nodes])
        for x in nodes:
            x.text = x.text.replace(htmltext.MARK, "")
        kept = htmltext.decode(nodes, trees.score(htmltext.features(nodes)))
        right += htmltext.text_of(nodes, kept) == htmltext.text_of(nodes, wanted)
    assert right >= 48


def test_tables_pages(spark, trees):
    rows = htmltext.extract_text(read(spark, "/root/testdata/sf0.001", "pages"), trees).collect()
    html = {r.page_id: r.html for r in read(spark, "/root/testdata/sf0.001", "pages").collect()}
    assert len(rows) == len(html)
    for r in rows:
        article = html[r.page_id].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(htmltext.entities.unescape(htmltext.re.sub("<[^>]*>", " ", b)).split()) for b in htmltext.re.split("</?(?:h1|p)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_labels_never_contradict():
    rng = random.Random(3)
    for _ in range(50):
        nodes = htmltext.parse(htmltext.training_page(rng))
        keep = htmltext.decode(nodes, np.array([rng.gauss(0, 4) for _ in nodes]))
        for i, x in enumerate(nodes):
            if i and keep[i]:
                assert keep[x.parent]
            if keep[i] and x.tag != "#text":
                assert any(keep[c] for c in x.children)


def test_head_without_its_end(trees):
    body = "<h1>The harvest of the year</h1><p>The farmers of the valley say that this harvest, the best in ten years, came late.</p><p>More rain is expected, and prices may fall again.</p>"
    wanted = htmltext.main_texts([f"<html><head><title>x</title><meta charset=utf-8></head><body><article>{body}</article></body></html>"], trees)
    pages = [
        f"<html><head><title>x</title><meta charset=utf-8><body><article>{body}</article></body></html>",
        f"<!doctype html><head>\n<title>x</title>\n<link rel=x href=y>\n<script>if (a < b) {{}}</script>\n<article>{body}</article>",
        f"<title>x</title><meta charset=utf-8><article>{body}</article>",
        f"<HEAD><STYLE>p {{}}</STYLE><ARTICLE>{body}</ARTICLE>",
    ]
    assert wanted[0].startswith("The harvest") and htmltext.main_texts(pages, trees) == wanted * len(pages)
    assert "plain words" in "".join(x.text for x in htmltext.parse("<head><title>x</title>plain words"))


#: Pages written by hand in layouts that ``training_page`` doesn't compose, with their main text.
FOREIGN = [
    (
        """<!doctype html><html lang=en><head><meta charset=utf-8><title>Sourdough</title><link rel=stylesheet href=a.css><body class="home blog">
        <div id="masthead"><div class="logo"><a href=/>My Kitchen</a></div><ul class="menu"><li><a href=/a>Recipes<li><a href=/b>About<li><a href=/c>Contact</ul></div>
        <div id="wrapper"><div id="content" class="post-body"><h1>Sourdough for beginners</h1><p>A good loaf needs four things: flour, water, salt and time. Most people fail on the last one.
        <p>Mix the flour and water by hand, and let them rest for an hour. Then add the salt, and fold the dough every half an hour.
        <h2>Baking</h2><p>Heat the oven until it is as hot as it gets. Bake for forty minutes, and let the loaf cool before cutting it.</div>
        <div id="sidebar"><h3>Popular posts</h3><ul><li><a href=/1>Rye bread</a><li><a href=/2>Bagels</a></ul></div></div>
        <div id="footer"><p>&copy; 2020 My Kitchen. All rights reserved. <a href=/p>Privacy</a></div></html>""",
        "Sourdough for beginners\nA good loaf needs four things: flour, water, salt and time. Most people fail on the last one.\nMix the flour and water by hand, and let them rest for an hour. Then add the salt, and fold the dough every half an hour.\nBaking\nHeat the oven until it is as hot as it gets. Bake for forty minutes, and let the loaf cool before cutting it.",
    ),
    (
        """<html><body><nav class="navbar"><a href="/">Docs</a> <a href="/api">API</a> <a href="/blog">Blog</a></nav><div class="row"><div class="col sidebar-left"><ul><li><a href="#a">Install</a></li><li><a href="#b">Use</a></li></ul></div>
        <main class="col docs-content"><h1>Install the client</h1><p>The client runs on any machine that has a recent runtime. Download the archive, unpack it, and put the folder on your path.</p><pre>client --version</pre>
        <ul><li>Linux needs nothing else, as all libraries are bundled.</li><li>Windows needs a restart after the first run.</li></ul><p>If a command fails, look at the log, which names the step that failed.</p></main></div>
        <footer class="page-footer"><ul><li><a href="/t">Terms</a></li><li><a href="/s">Status</a></li></ul></footer></body></html>""",
        "Install the client\nThe client runs on any machine that has a recent runtime. Download the archive, unpack it, and put the folder on your path.\nclient --version\nLinux needs nothing else, as all libraries are bundled.\nWindows needs a restart after the first run.\nIf a command fails, look at the log, which names the step that failed.",
    ),
    (
        """<html><head><title>News</title></head><body><header class="site-header"><a href=/>The Daily</a><nav><ul><li><a href=/w>World</a></li><li><a href=/s>Sport</a></li></ul></nav></header>
        <div class="cookie-consent"><p>We use cookies to make this site better. By reading on you agree to that.</p><button>Accept</button></div>
        <section class="story"><article itemscope><h1>Bridge reopens after two years</h1><p>The old bridge over the river reopened on Monday, two years after a flood damaged its pillars.</p><div class="ad-slot">Advertisement: buy two, get one free today only.</div>
        <p>The mayor, who walked over it first, said that the work had cost less than planned, and thanked the builders.</p><blockquote>It stands firmer than ever, and it will do so for a hundred years.</blockquote><p>Trams will follow in May.</p></article></section>
        <section class="comments"><h2>12 comments</h2><div class="comment"><p>At last! I have waited for this for so long, thank you all.</p></div><div class="comment"><p>Still too narrow for bikes, if you ask me, and too loud.</p></div></section>
        <aside class="related"><h3>More from us</h3><ul><li><a href=/1>Flood report</a></li></ul></aside><footer>Imprint | Contact</footer></body></html>""",
        "Bridge reopens after two years\nThe old bridge over the river reopened on Monday, two years after a flood damaged its pillars.\nThe mayor, who walked over it first, said that the work had cost less than planned, and thanked the builders.\nIt stands firmer than ever, and it will do so for a hundred years.\nTrams will follow in May.",
    ),
    (
        """<html><body bgcolor=white><table width=100%><tr><td class=nav width=150><a href=a.html>Home</a><br><a href=b.html>Links</a><br><a href=c.html>Guest book</a></td>
        <td class=content><h2>My walk along the coast</h2><p>We started at dawn, when the fog still lay on the water, and walked north along the cliffs.</p><p>By noon the sun was out, the path was dry, and we could see the islands, one behind the other.</p></td></tr></table>
        <div class=foot>Last updated in 1999</div></body></html>""",
        "My walk along the coast\nWe started at dawn, when the fog still lay on the water, and walked north along the cliffs.\nBy noon the sun was out, the path was dry, and we could see the islands, one behind the other.",
    ),
]


def test_foreign_pages():
    """Words in common, over words of both, on pages in layouts that were not trained on."""
    shares = []
    for text, (_, wanted) in zip(htmltext.main_texts([p for p, _ in FOREIGN], htmltext.fit()), FOREIGN):
        a, b = Counter(text.split()), Counter(wanted.split())
        shares.append(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())))
    print(shares)
    assert np.mean(shares) >= 0.9 and min(shares) >= 0.75


def test_odd_markup(trees):
    long = "<div>" * 3000 + "deep text that goes on for a while" + "</div>" * 2000
    odd = [None, "", "plain text only, no markup at all", "<p", "<!-- never closed", "<script>x", "</p></div>", "<p>a<p>b</article>", "&amp;&lt;&#65;", "<a href='>'>x</a>", long, "<table><tr><td>1<td>2<tr><td>3</table>"]
    texts = htmltext.main_texts(odd, trees)
    assert texts[0] == texts[1] == "" and len(texts) == len(odd)


def test_empty_pages(spark, trees):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "", "x"), (2, None, "", "x")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in htmltext.extract_text(pages, trees).collect()] == [("", 0)] * 3
    assert htmltext.extract_text(pages.where(F.lit(False)), trees).count() == 0
