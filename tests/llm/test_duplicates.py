import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnworks.llm import decontaminate, minhash
from tarnworks.llm.common import Work, read
from tarnworks.llm.components import connected_components

from . import docs


def shingles(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, k, most):
    sets = [shingles(t, k) for _, t in rows]
    at = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * both >= most * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [(doc_id, len(sets[i]), least[root(i)]) for i, (doc_id, _) in enumerate(rows)]


@pytest.mark.parametrize(("k", "most", "depth"), [(3, 85, 3), (5, 80, 2)])
def test_components_equal_brute_force(spark, k, most, depth):
    table = read(spark, "/root/testdata/sf0.01", "documents")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    got = minhash.near_duplicates(table, k, most, depth=depth).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, k, most))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_large_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 8)
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
        rows.append((k * 3 + 1, " ".join(words)))
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, depth=3).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))


def test_near_duplicate_rows(spark):
    got = minhash.near_duplicates(docs.docs(spark)).collect()
    assert len(got) == len(docs.ROWS)
    by_id = {r.doc_id: r for r in got}
    assert by_id[6].component_id == 5 and by_id[5].kept and not by_id[6].kept
    assert by_id[1].n_shingles == by_id[2].n_shingles == by_id[3].n_shingles == 0
    assert by_id[1].kept and by_id[None].kept and by_id[None].component_id is None
    assert minhash.near_duplicates(docs.empty(spark)).count() == 0
    kept = minhash.one_of_each(docs.docs(spark)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r[0]) for r in docs.ROWS if r[0] != 6)


def test_connected_components(spark):
    rng = random.Random(9)
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(500, 600)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    work = Work(spark, "test")
    table = work.cut(spark.createDataFrame(edges, "a long, b long"), "edges")
    assert {r.id: r.component for r in connected_components(table, work).collect()} == {x: root(x) for x in parent}
    empty = work.cut(spark.createDataFrame([], "a long, b long"), "none")
    assert connected_components(empty, work).count() == 0


def brute_leaks(rows, items):
    found = set()
    for doc_id, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        for item_id, item in items:
            own = "".join(c.lower() if "A" <= c <= "Z" else c for c in item or "").encode().split()
            if not own:
                continue
            k = min(5, len(own))
            want = Counter(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
            for start in range(len(words) - len(own) + 1):
                w = words[start : start + len(own)]
                have = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
                both = sum((want & have).values())
                if both >= 0.8 * sum((want | have).values()):
                    found.add((doc_id, item_id))
                    break
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    items = [(k, " ".join(words(rng.randint(1, 40)))) for k in range(25)] + [(90, None), (91, " ")]
    rows = []
    for k in range(120):
        text = words(rng.randint(0, 120))
        for _ in range(rng.randint(0, 2)):
            item = (rng.choice(items[:25])[1]).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = item
        rows.append((k, " ".join(text)))
    table, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    expected = brute_leaks(rows, items)
    for most in (200_000, 60):  # one block of items, several
        assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(table, bench, most).collect()} == expected
        assert {r.doc_id for r in decontaminate.without_leaks(table, bench, most).collect()} == {k for k, _ in rows} - {d for d, _ in expected}


def test_leak_rows(spark):
    bench = spark.createDataFrame([(1, docs.PROSE), (2, None)], "item_id long, text string")
    got = decontaminate.find_leaks(docs.docs(spark), bench).collect()
    assert sorted(r.doc_id for r in got) == [5, 6, 6] and all(r.similarity == 1.0 for r in got)
    assert decontaminate.find_leaks(docs.docs(spark), bench.limit(0)).count() == 0
    assert decontaminate.find_leaks(docs.empty(spark), bench).count() == 0


def test_pipeline_stages(spark, sf_dir):
    rows = read(spark, sf_dir, "documents")
    work, table = Work(spark, "test"), rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = work.cut(stage(spark, table, sf_dir), name)
        assert after.columns == rows.columns
        if name != "mixing":
            assert 0 < after.count() <= table.count()
            assert after.join(table, rows.columns, "left_anti").count() == 0
        table = after
    copies = Counter(r.doc_id for r in table.select("doc_id").collect())
    assert max(copies.values()) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, table, sf_dir)
    assert last.count() == table.count()


def test_pipeline_stages_on_odd_documents(spark, sf_dir):
    for table in (docs.docs(spark), docs.empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, table, sf_dir).count() >= 0
    mixed = corpus_pipeline.mixing(spark, docs.docs(spark), sf_dir)
    assert mixed.columns == docs.docs(spark).columns and mixed.where(F.col("doc_id") == 2).count() == 0
