"""Main text of web pages by gradient-boosted trees over the nodes of the document.

A page is parsed into a tree of elements and text runs. Each node has features: its tag and its parent's, sectioning
ancestors, stems found in its attribute tokens and its ancestors', depth, text and link density of its subtree, and
statistics among its siblings. Boosted trees give the chance that a node holds main text. The labelling that is
likeliest under one rule is then chosen bottom-up: below a node without main text there is none, and a node with
main text has some below it; so no ancestor contradicts a descendant.

The trees are fitted here on pages that ``training_page`` composes from common layouts, with the main text known by
construction; no table is needed. They are fitted once a driver process and sent to the tasks (about 50 KB).

A null or empty page has an empty text; markup that never closes runs to the end, but for the head, which ends where
the first element or text of the body begins; pages of any length are parsed whole. Repeated rows give repeated rows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from bisect import bisect_right
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from tarnworks.llm.common import over_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|[^<]+|<", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(?:class|id|role|itemprop|aria-label|name)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
RAW = {"script", "style", "template", "noscript", "iframe", "svg", "textarea", "title", "select"}
#: What a head may hold; anything else begins the body.
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noframes", "head", *RAW} - {"iframe", "svg", "textarea", "select"}
RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.IGNORECASE) for tag in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "body", "article", "section", "main", "div", "p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot",
    "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "header", "footer", "nav", "aside", "form", "fieldset", "address", "details", "summary", "hr", "center", "dialog",
}
#: What a start tag closes, if that is open within the nearest of the elements that hold it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"datalist"})}
TAGS = ("#text", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "a", "span", "article", "main", "section", "nav", "header", "footer", "aside", "form", "table", "td", "button", "blockquote", "pre", "figure", "body", "label", "b")
OVER = ("article", "main", "nav", "header", "footer", "aside", "form", "button", "table", "dialog")
STEMS = {
    "content": ("content", "article", "post", "entry", "story", "main", "body", "text"),
    "menu": ("nav", "menu", "breadcrumb", "crumb", "toc", "pager", "pagination", "tabs", "toolbar", "skip"),
    "advert": ("ad", "ads", "advert", "adslot", "sponsor", "promo", "banner", "dfp", "affiliate"),
    "comment": ("comment", "comments", "respond", "reply", "replies", "disqus", "discussion", "feedback", "reader"),
    "side": ("sidebar", "side", "aside", "widget", "rail", "related", "recommend", "popular", "trending", "more"),
    "notice": ("cookie", "notice", "consent", "gdpr", "alert", "modal", "popup", "overlay", "newsletter", "subscribe", "signup", "paywall", "privacy", "toast"),
    "frame": ("header", "footer", "masthead", "foot", "top", "bottom", "copyright", "legal", "site", "logo", "brand"),
    "social": ("share", "social", "follow", "tweet", "facebook", "like", "author", "byline", "meta", "tags", "tag"),
    "form": ("form", "search", "login", "input", "contact"),
}
WHOLE_ONLY = {"ad", "ads", "top", "side", "more", "nav", "text", "tag", "like", "foot", "meta", "body", "site"}
STOP = re.compile(r"[.,;!?]")
TAG_NUMBER, OVER_BIT = {t: k for k, t in enumerate(TAGS)}, {t: 1 << k for k, t in enumerate(OVER)}
MARK = "\ue000"
TREES, DEPTH, BINS, RATE, PAGES, SEED = 60, 5, 32, 0.2, 400, 3
TOGETHER = 64


class Node:
    __slots__ = ("block", "children", "parent", "stems", "tag", "text")

    def __init__(self, tag: str, parent: int, stems: int = 0, text: str = ""):
        self.tag, self.parent, self.stems, self.text, self.children = tag, parent, stems, text, []


def stems_of(attributes: str) -> int:
    """A bit for each group of stems found in the tokens of the attributes."""
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        for token in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", m[1] or m[2] or m[3] or "").lower()):
            for g, stems in enumerate(STEMS.values()):
                if any(token == s or s not in WHOLE_ONLY and token.startswith(s) for s in stems):
                    found |= 1 << g
    return found


class Open:
    """Open elements, innermost last, and where each kind of them stands, so that none is looked for."""

    def __init__(self):
        self.nodes, self.tags, self.blocks = [0], ["body"], []
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def cut(self, place: int) -> None:
        """Close the element at ``place`` and all within it."""
        while len(self.nodes) > place:
            self.nodes.pop()
            self.places[self.tags.pop()].pop()
        while self.blocks and self.blocks[-1] >= place:
            self.blocks.pop()

    def last(self, tags) -> int:
        """Place of the innermost element of any of ``tags``; 0 if there is none."""
        return max((p[-1] for p in (self.places.get(t) for t in tags) if p), default=0)

    def first_after(self, tags, place: int) -> int:
        """Place of the outermost element of any of ``tags`` within the one at ``place``; 0 if there is none."""
        found = (p[k] for p in (self.places.get(t) for t in tags) if p and (k := bisect_right(p, place)) < len(p))
        return min(found, default=0)

    def implied_end(self, tag: str) -> None:
        """Close what the start of ``tag`` ends: an open paragraph, cells and rows, items, options."""
        if tag in BLOCK and self.blocks and self.tags[self.blocks[-1]] == "p":
            self.cut(self.blocks[-1])
        if tag in CLOSES:
            closed, holders = CLOSES[tag]
            holder = self.last(holders)
            place = self.first_after(closed, holder) if tag == "tr" else self.last(closed)
            if place > holder:
                self.cut(place)


def parse(page: str) -> list[Node]:
    """Nodes in page order; a text run is a node of its own, and so is each line break."""
    nodes, open_, runs = [Node("body", -1)], Open(), {}

    def add(node: Node) -> int:
        nodes[node.parent].children.append(len(nodes))
        nodes.append(node)
        return len(nodes) - 1

    at, head = 0, False
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        if not m[2]:
            if page[m.start()] != "<" or m[0] == "<":
                if head and not m[0].strip():
                    continue
                head = False
                last = nodes[open_.nodes[-1]].children[-1:]
                if last and last[0] in runs and last[0] == len(nodes) - 1:
                    runs[last[0]].append(m[0])
                else:
                    runs[add(Node("#text", open_.nodes[-1]))] = [m[0]]
            continue
        tag = m[2].lower()
        if m[1]:
            head = head and tag != "head"
            if tag not in ("html", "head", "body") and open_.places.get(tag):
                open_.cut(open_.places[tag][-1])
            continue
        head = (head or tag == "head") and tag in IN_HEAD
        if tag in ("html", "head", "body") or head and tag not in RAW:
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else len(page)
            continue
        open_.implied_end(tag)
        node = add(Node(tag, open_.nodes[-1], stems_of(m[3]) if "=" in m[3] else 0))
        if tag not in VOID and not m[3].endswith("/"):
            open_.push(node, tag)
    for k, parts in runs.items():
        nodes[k].text = "".join(parts)
    return nodes


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    parents = [max(0, x.parent) for x in nodes]
    text, link, stops, tags, paragraphs, depth, over, above, in_link = ([0] * n for _ in range(9))
    for i, x in enumerate(nodes):
        p = parents[i]
        if i:
            depth[i], over[i], above[i], in_link[i] = depth[p] + 1, over[p], above[p] | nodes[p].stems, in_link[p] or x.tag == "a"
        if x.tag == "#text":
            text[i] = len(x.text.strip())
            if text[i]:
                stops[i] = len(STOP.findall(x.text))
                link[i] = text[i] if in_link[i] else 0
        else:
            tags[i] = 1
            if x.tag in OVER_BIT:
                over[i] |= OVER_BIT[x.tag]
            paragraphs[i] = x.tag in ("p", "h1", "h2", "blockquote", "pre")
    for i in range(n - 1, 0, -1):
        p = parents[i]
        text[p] += text[i]
        link[p] += link[i]
        stops[p] += stops[i]
        tags[p] += tags[i]
        paragraphs[p] += paragraphs[i]
    order, siblings = [0] * n, [1] * n
    for x in nodes:
        for k, c in enumerate(x.children):
            order[c], siblings[c] = k, len(x.children)
    parent = np.array(parents)
    tag = np.array([TAG_NUMBER.get(x.tag, len(TAGS)) for x in nodes])
    stems, above, over = np.array([x.stems for x in nodes]), np.array(above), np.array(over)
    text, link, stops, tags, paragraphs, depth, order, siblings = (np.array(v, dtype=np.float64) for v in (text, link, stops, tags, paragraphs, depth, order, siblings))
    whole = max(1.0, text[0])
    columns = [
        *(tag == k for k in range(len(TAGS))),
        *(tag[parent] == k for k in range(len(TAGS))),
        *((over >> k & 1) for k in range(len(OVER))),
        *((stems >> g & 1) for g in range(len(STEMS))),
        *((above >> g & 1) for g in range(len(STEMS))),
        depth,
        np.log1p(text),
        np.log1p(text[parent]),
        link / np.maximum(1, text),
        (link / np.maximum(1, text))[parent],
        np.log1p(text / np.maximum(1, tags)),
        np.log1p((text / np.maximum(1, tags)))[parent],
        stops / np.maximum(1, text),
        text / whole,
        text[parent] / whole,
        text / np.maximum(1, text[parent]),
        np.log1p(tags),
        np.log1p(paragraphs),
        np.log1p(paragraphs[parent]),
        order / siblings,
        np.log1p(siblings),
        np.arange(n) / n,
    ]
    return np.column_stack(columns).astype(np.float32)


def words(rng: random.Random, least: int, most: int, marked: bool) -> str:
    text = " ".join("".join(rng.choice("abcdefghilmnoprstuvé") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(least, most)))
    text = re.sub(r"(\w+ ){6}\w+", lambda m: m[0] + rng.choice([",", ".", ".", ""]), text).capitalize() + rng.choice([".", ".", "", "!"])
    return f"{MARK}{text}" if marked else text


def links(rng: random.Random) -> str:
    return "".join(f'<li><a href="/{k}">{words(rng, 1, 3, False)}</a></li>' for k in range(rng.randint(2, 9)))


def clutter(rng: random.Random) -> str:
    """A piece of a page that isn't main text."""
    short, long = words(rng, 2, 12, False), words(rng, 10, 60, False)
    name = lambda *names: f'{rng.choice(["class", "id", "class"])}="{rng.choice(names)}"'
    tag = rng.choice(["div", "div", "section", "aside"])
    return rng.choice([
        lambda: f"<nav{rng.choice(['', ' class=\"menu\"', ' role=\"navigation\"'])}><ul>{links(rng)}</ul></nav>",
        lambda: f"<{tag} {name('menu', 'nav-bar', 'breadcrumbs', 'toc', 'pagination')}><ul>{links(rng)}</ul></{tag}>",
        lambda: f"<header {name('site-header', 'masthead', 'top', 'page')}><a href='/'>{short}</a><p>{short}</p></header>",
        lambda: f"<header><{rng.choice(['h1', 'h2', 'div'])}>{short}</{rng.choice(['h1', 'h2', 'div'])}><p>{short}</p></header>",
        lambda: f"<footer>&copy; {short} &middot; {long}</footer>",
        lambda: f"<footer {name('footer', 'site-footer', 'x')}><p>{long}</p><ul>{links(rng)}</ul></footer>",
        lambda: f"<aside><h3>{short}</h3><p>{long}</p></aside>",
        lambda: f"<aside {name('sidebar', 'x', 'related')}><ul>{links(rng)}</ul><p>{long}</p></aside>",
        lambda: f"<{tag} {name('sidebar', 'side', 'widget', 'related-posts', 'recommended', 'right-rail')}><h3>{short}</h3><p>{long}</p></{tag}>",
        lambda: f"<div {name('ad', 'ads', 'advert', 'ad-slot', 'banner', 'promo', 'sponsored')}>{rng.choice([short, long])}</div>",
        lambda: f"<{tag} {name('cookie', 'cookie-notice', 'notice', 'consent', 'gdpr-bar', 'alert', 'newsletter', 'subscribe-box', 'popup')}><p>{long}</p><button>{short}</button></{tag}>",
        lambda: f"<div {name('cookie-banner', 'notice', 'privacy-notice')}>{long}</div>",
        lambda: f"<form action='/s'><label>{short}</label><input name=q><p>{short}</p><button>{short}</button></form>",
        lambda: f"<{tag} {name('comments', 'comment-list', 'reader-comments', 'responses replies', 'discussion')}><h2>{short}</h2>" + "".join(f"<{e} {name('comment', 'comment-body', 'reply')}><p>{words(rng, 5, 60, False)}</p></{e}>" for e in [rng.choice(["div", "li", "article"])] * rng.randint(1, 5)) + f"</{tag}>",
        lambda: f"<div {name('comment', 'user-comment')}><b>{short}</b> {long}</div>",
        lambda: f"<div {name('share', 'social', 'share-buttons', 'byline-links')}><a href='#'>{short}</a> <a href='#'>{short}</a></div>",
    ])()


def main_text(rng: random.Random) -> str:
    out = [f"<{h}>{words(rng, 3, 12, True)}</{h}>" for h in ["h1"] if rng.random() < 0.85]
    for _ in range(rng.choice([1, 2, 3, 5, 8, 15])):
        text = words(rng, *rng.choice([(1, 6), (5, 25), (20, 120)]), True)
        out.append(rng.choice([
            lambda: f"<p>{text}</p>",
            lambda: f"<p>{text}</p>",
            lambda: f"<p>{text}",
            lambda: f"<p><b>{text}<br>",
            lambda: f"<p>{text} <a href='/x'>{words(rng, 1, 3, True)}</a> {words(rng, 2, 9, True)}</p>",
            lambda: f"<h2>{words(rng, 1, 8, True)}</h2><p>{text}</p>",
            lambda: f"<ul>{''.join(f'<li>{words(rng, 2, 20, True)}</li>' for _ in range(rng.randint(2, 5)))}</ul>",
            lambda: f"<blockquote>{text}</blockquote>",
            lambda: f"<table><tr><td>{words(rng, 1, 4, True)}</td><td>{words(rng, 1, 4, True)}</td></tr></table>",
            lambda: f"<pre>{text}</pre>",
            lambda: f"<div>{text}</div>",
            lambda: f"<figure><img src=x><figcaption>{words(rng, 2, 12, True)}</figcaption></figure>",
        ])())
        if rng.random() < 0.35:
            out.append(clutter(rng))
    return "".join(out)


def training_page(rng: random.Random) -> str:
    """A page whose main text is marked."""
    open_, close = rng.choice([
        ("<article>", "</article>"), ("<article>", "</article>"), ('<article class="post">', "</article>"), ("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"),
        ('<div id="main-content">', "</div>"), ('<div class="entry-content">', "</div>"), ('<section class="story-body">', "</section>"), ('<div class="wrap"><div class="article-text">', "</div></div>"), ('<div role="main">', "</div>"),
    ])
    if rng.random() < 0.1:
        open_, close = open_ + f"<header><h1>{words(rng, 3, 9, True)}</h1></header>", close
    before, after = ("".join(clutter(rng) for _ in range(rng.randint(0, 4))) for _ in range(2))
    wrap = rng.choice([("", ""), ("<div id=page>", "</div>"), ('<div class="container"><div class="row">', "</div></div>")])
    return f"<html><head><title>x</title></head><body>{wrap[0]}{before}{open_}{main_text(rng)}{close}{after}{wrap[1]}</body></html>"


class Trees:
    """Boosted regression trees on binned features, for a logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH):
        values = [np.unique(c) for c in x.T]
        self.cuts = [(v[1:] + v[:-1]) / 2 if len(v) <= BINS else np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c, v in zip(x.T, values)]
        binned, score = self.binned(x), np.full(len(x), np.log(y.mean() / (1 - y.mean())))
        self.start, self.depth, self.trees = score[0], depth, []
        for _ in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(1e-6, p * (1 - p))
            feature, cut, value, leaf = self.grow(binned, g, h)
            self.trees.append((feature, cut, value))
            score = score + value[leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)]).astype(np.uint8)

    def grow(self, x, g, h):
        """A full tree, level by level: split features and bins in heap order, then leaf values."""
        n, m = x.shape
        leaf = np.zeros(n, dtype=np.int64)
        feature, cut = np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, BINS, dtype=np.int64)
        for level in range(self.depth):
            width = 2**level
            best = np.full(width, 1e-6)
            total_g, total_h = np.bincount(leaf, g, width), np.bincount(leaf, h, width)
            for f in range(m):
                cell = leaf * BINS + x[:, f]
                left_g = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(1)
                left_h = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(1)
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (total_g**2 / (total_h + 1))[:, None]
                at = gain.argmax(1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                feature[width - 1 : 2 * width - 1][better], cut[width - 1 : 2 * width - 1][better] = f, at[better]
            place = width - 1 + leaf
            leaf = leaf * 2 + (x[np.arange(n), feature[place]] > cut[place])
        return feature, cut, RATE * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1), leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        binned, out, every = self.binned(x), np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = at * 2 + 1 + (binned[every, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out


@cache
def fit(pages: int = PAGES, seed: int = SEED) -> Trees:
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = parse(training_page(rng))
        holds = np.array([MARK in x.text for x in nodes])
        for x in nodes:
            x.text = x.text.replace(MARK, "")
        for i in range(len(nodes) - 1, 0, -1):
            holds[nodes[i].parent] |= holds[i]
        xs.append(features(nodes))
        ys.append(holds)
    return Trees(np.concatenate(xs), np.concatenate(ys).astype(float))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which nodes hold main text: the likeliest labels where a node does if and only if one of its children does."""
    odds = np.clip(odds, -12, 12)
    yes, no = -np.log1p(np.exp(-odds)), -np.log1p(np.exp(odds))
    none, some = np.zeros(len(nodes)), np.zeros(len(nodes))  # best of the subtree without and with main text
    forced: dict[int, int] = {}
    for i in range(len(nodes) - 1, -1, -1):
        children = nodes[i].children
        none[i] = no[i] + sum(none[c] for c in children)
        if nodes[i].tag == "#text":
            some[i] = yes[i] if nodes[i].text.strip() else -np.inf
        elif not children:
            some[i] = -np.inf
        else:
            gain = [some[c] - none[c] for c in children]
            top = int(np.argmax(gain))
            some[i] = yes[i] + sum(max(none[c], some[c]) for c in children) + min(0.0, gain[top])
            forced[i] = children[top]
    keep = np.zeros(len(nodes), dtype=bool)
    keep[0] = some[0] > none[0]
    for i, x in enumerate(nodes):
        if keep[i]:
            for c in x.children:
                keep[c] = some[c] > none[c] or c == forced.get(i) and some[c] > -np.inf
    return keep


def text_of(nodes: list[Node], keep: np.ndarray) -> str:
    """Blocks of kept text in page order."""
    blocks, block_of, last = [], [0] * len(nodes), -1
    for i, x in enumerate(nodes):
        if i:
            block_of[i] = i if x.tag in BLOCK else block_of[x.parent]
        if x.tag == "#text":
            if keep[i]:
                if block_of[i] != last or broken:
                    blocks.append([])
                blocks[-1].append(x.text)
                last, broken = block_of[i], False
        elif x.tag in BLOCK:
            broken = True
        elif x.tag == "br" and blocks:
            blocks[-1].append(" ")
    joined = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    """Main text of each page; the trees score the nodes of ``TOGETHER`` pages at once."""
    out: list[str] = []
    for start in range(0, len(pages), TOGETHER):
        parsed = [parse(p or "") for p in pages[start : start + TOGETHER]]
        odds = trees.score(np.concatenate([features(nodes) for nodes in parsed]))
        ends = np.cumsum([len(nodes) for nodes in parsed])
        out += [text_of(nodes, decode(nodes, own)) for nodes, own in zip(parsed, np.split(odds, ends[:-1]))]
    return out


def extract_text(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    model = trees or fit()

    def run(batches):
        for batch in batches:
            texts = main_texts(batch["html"], model)
            yield {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    return over_batches(pages.select("page_id", "url", "html"), run, "page_id long, url string, text string, n_chars long")
