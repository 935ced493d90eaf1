"""Suffix sorting, removed repeats, manifest and filter audit against plain Python."""

import hashlib
import random
import zlib
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tarnworks.llm import audit, merkle, repeats
from tarnworks.llm.common import read
from tarnworks.llm.suffixes import repeated_windows, suffix_array

from . import docs

WIDE = 9007199254740993


def digest(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# -- suffix sorting


def pieces(rng):
    letters = rng.choice([b"ab", b"\0\1", b"abc", b"a", bytes(range(256))])
    parts = []
    for _ in range(rng.randrange(1, 8)):
        own = bytes(rng.choice(letters) for _ in range(rng.randrange(1, 60)))
        if parts and rng.random() < 0.6:
            own = rng.choice(parts)[rng.randrange(5) :] + own
        parts.append(own + letters[:1] * rng.choice([0, 0, 0, 150]))
    return parts


@pytest.mark.parametrize("width", [8, 9, 20, 100])
def test_two_stage_order_and_repeated_windows(width):
    rng = random.Random(width)
    for _ in range(150):
        parts = pieces(rng)
        data, ends = b"".join(parts), np.cumsum([len(p) for p in parts])
        order = suffix_array(np.frombuffer(data, dtype=np.uint8), width)
        assert sorted(order) == list(range(len(data)))
        keys = [data[i : i + width] for i in order if i + width <= len(data)]
        assert keys == sorted(keys)
        seen, expected, at = set(), np.zeros(len(data), dtype=bool), 0
        for part in parts:
            for i in range(len(part) - width + 1):
                expected[at + i] = part[i : i + width] in seen
                seen.add(part[i : i + width])
            at += len(part)
        assert (repeated_windows(data, ends, width) == expected).all()


def test_hostile_bytes_take_few_steps():
    n = 1 << 20
    for data in (b"a" * n, b"ab" * (n // 2), (b"a" * 999 + b"b") * (n // 1000), (b"b" * 999 + b"a") * (n // 1000)):
        assert repeated_windows(data, np.array([len(data)]), 100).sum() >= len(data) - 2200


# -- removed repeats


def plain_repeats(rows):
    keyed = [(d is not None, d or 0, hashlib.sha256((t or "").encode()).digest(), d, (t or "").encode()) for d, t in rows]
    seen, out = set(), []
    for *_, doc_id, data in sorted(keyed, key=lambda r: r[:3]):
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(data[i : i + 100])
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc_id, len(data), sum(gone), runs, digest(bytes(b for b, g in zip(data, gone) if not g))))
    return out


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_repeats_equal_brute_force(spark):
    table = read(spark, "/root/testdata/sf0.01", "documents")
    expected = plain_repeats([(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()])
    assert in_order(repeats.without_repeats(table).collect()) == in_order(expected)


@pytest.mark.parametrize(("chunk", "group", "span"), [(4 << 20, 1 << 20, 1 << 18), (20_000, 3_000, 500)])
def test_repeats_of_awkward_rows(spark, monkeypatch, chunk, group, span):
    """Small chunks and groups deal frequent passages over many groups and use the second round."""
    for name, value in (("CHUNK", chunk), ("GROUP", group), ("SPAN", span), ("RUN", 64), ("DIGESTS", 3)):
        monkeypatch.setattr(repeats, name, value)
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(r[0], r[1]) for r in docs.ROWS]
    rows += [(WIDE, shared), (None, shared), (WIDE + 2, "ü" * 400), (WIDE + 2, shared[:150])]
    rows += [(k, "ab" * rng.randrange(200) + "x") for k in range(2000, 2020)] + [(k, "z" * rng.randrange(90, 400)) for k in range(2100, 2110)]
    for k in range(3000, 3200):
        own = "".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(300)))
        a = rng.randrange(500)
        rows.append((k, own + shared[a : a + rng.randrange(50, 500)] + own[:120]))
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id chunk", "text sha", "map('k', timestamp'0001-01-01') h").repartition(6)
    assert in_order(repeats.without_repeats(table).collect()) == in_order(plain_repeats(rows))


def test_repeats_of_no_rows(spark):
    assert repeats.without_repeats(docs.empty(spark)).count() == 0


# -- manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_leaf(doc_id, text, lang, source, n_chars):
    return digest("".join(map(field, (doc_id, source, lang, n_chars, text))))


def plain_tree(nodes):
    """Root, and for each node its (left, right) siblings up to it."""
    paths, over = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, place in enumerate(over):
            run = place // 3 * 3
            paths[k].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
        nodes, over = [digest("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)], [p // 3 for p in over]
    return (nodes[0] if nodes else None), paths


def plain_manifest(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        leaf = changed = plain_leaf(doc_id, text, lang, source, n_chars)
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
            changed = plain_leaf(doc_id, text.replace("\n", ""), lang, source, n_chars)
        groups.setdefault((source is not None, (source or "").encode()), []).append((doc_id is not None, doc_id or 0, leaf, changed, doc_id))
    keys, out = sorted(groups), []
    low = {k: plain_tree([x[2] for x in sorted(groups[k], key=lambda x: x[:3])]) for k in keys}
    root, above = plain_tree([low[k][0] for k in keys])
    for k, upper in zip(keys, above):
        for (*_, leaf, changed, doc_id), path in zip(sorted(groups[k], key=lambda x: x[:3]), low[k][1]):
            for a, b in path + upper:
                changed = digest(a + changed + b)
            out.append((doc_id, leaf, low[k][0], root, digest("".join(a + b for a, b in path + upper)), changed, changed == root))
    return out


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_manifest_equals_plain_tree(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "LEVELS", depth)
    rng = random.Random(depth)
    rows = [r[:5] for r in docs.ROWS] + [(WIDE, "a\nb", "en", "a", 3), (WIDE + 2, "a\nb", None, None, None), (None, "a\nb", "de", "a", -3)]
    rows += [(rng.randrange(1 << 40), rng.choice(["x\ny", "x", None, ""]), "en", rng.choice(["hot", "hot", "é", "z", "", None]), 1) for _ in range(300)]
    rows += [(7_000 + k, "alone", "en", f"s{k:03}", 5) for k in range(40)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = table.selectExpr("*", "doc_id i", "text node", "1 n", "map('k', timestamp'0001-01-01') path").repartition(5)
    assert in_order(merkle.manifest(table).collect()) == in_order(plain_manifest(rows))


def test_manifest_of_one_row_and_of_none(spark):
    one = spark.createDataFrame([(5, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    (row,) = merkle.manifest(one).collect()
    assert row.leaf == row.subroot == row.root == plain_leaf(5, "a", "en", "s", 1) and row.proof_sha256 == digest("")
    assert merkle.manifest(one.limit(0)).count() == 0


# -- filter audit


def plain_audit(rows, labels):
    least = {}
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    failing = []
    for doc_id, text, lang in rows:
        text = text or ""
        w = text.encode().split()
        fails = {f for f, bad in zip("ABCDE", (
            len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            any(c in "#$%&*|" for c in text), doc_id is not None and doc_id > least[text])) if bad}
        failing.append((lang or "", fails, labels.get(doc_id, (0, 0)) if doc_id is not None else (0, 0)))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failing}:
        own = [x[1:] for x in failing if x[0] == part]
        for order in permutations("ABCDE"):
            left = list(own)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                failed = sum(f in x[0] for x in own)
                out[part, "".join(order), step] = [len(left), len(gone), failed - len(gone), sum(x[0] == {f} for x in own), sum(x[1][0] for x in gone), sum(x[1][1] for x in gone)]
                shapley[part, f] += len(gone)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


@pytest.mark.parametrize("held", [1 << 24, 300])
def test_audit_equals_plain_counts(spark, monkeypatch, held):
    monkeypatch.setattr(audit, "HELD", held)
    rng = random.Random(held)
    rows = [(r[0], r[1], r[2]) for r in docs.ROWS] + [(WIDE, "same", "en"), (WIDE + 2, "same", "de"), (None, "same", None), (WIDE + 1, "same", ""), (WIDE + 1, "other", "")]
    rows += [(rng.randrange(5000), " ".join(rng.choice(["Aa", "b", "c$", "d", "e e"]) for _ in range(rng.choice([1, 2, 3, 300]))), rng.choice(["en", "fr", None])) for _ in range(400)]
    marks = [(k, rng.randrange(2), rng.randrange(2)) for k in range(0, 5000, 2)] + [(WIDE, 1, 1), (None, 1, 1), (3, 0, None), (3, 1, 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "lang part", "1 mask", "map('k', timestamp'0001-01-01') n").repartition(5)
    got = audit.interactions(table, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    known = {d: (q or 0, t or 0) for d, q, t in marks if d is not None}
    assert sorted(tuple(r) for r in got) == plain_audit(rows, known)


def test_audit_keeps_texts_of_one_hash_apart():
    rows = [(1, "x", 5, "p", 0), (1, "y", 6, "p", 0), (1, "x", 7, "p", 0), (1, "x", 4, "p", 0)]
    sent = list(audit.before_sending(rows))
    got = [r for d, r in sent if d is None] + list(audit.smallest((d, r) for d, r in sent if d is not None))
    assert sorted(got) == [(4, "p", 0, 1), (5, "p", 16, 1), (6, "p", 0, 1), (7, "p", 16, 1)]


def test_audit_of_no_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(docs.empty(spark), labels).count() == 0
