"""The pipeline's stages against plain Python, each on what the one before kept, and the whole on odd tables."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tarnworks.llm import cnn
from tarnworks.llm.common import Work, read
from tarnworks.llm.tokens import vocabulary_path

from . import docs
from .test_duplicates import brute, shingles
from .test_rules_mixing import targets, words


def leaking(text, items):
    """Whether a window of an item's size shares runs of five words with it, 0.8 or more by weight."""
    own = shingles(text, 5)
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    for size, want, runs in items:
        if len(own & runs) < 0.8 * len(runs):
            continue
        k = min(5, size)
        for start in range(len(w) - size + 1):
            have = Counter(tuple(w[start + i : start + i + k]) for i in range(size - k + 1))
            if sum((want & have).values()) >= 0.8 * sum((want | have).values()):
                return True
    return False


def test_whole_pipeline_equals_plain_python(spark, sf_dir):
    from tokenizers import Tokenizer

    rows = [(r.doc_id, r.text, r.source) for r in read(spark, sf_dir, "documents").collect()]
    work, stages = Work(spark, "test"), dict(corpus_pipeline.STAGES)
    cut = lambda name, table: work.cut(stages[name](spark, table, sf_dir), name)

    good = cut("quality_classifier", read(spark, sf_dir, "documents"))
    net = cnn.fit(*cnn.labelled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))
    rows = [r for r in rows if cnn.probability(r[1], net) >= 0.7]
    assert sorted(r.doc_id for r in good.collect()) == sorted(r[0] for r in rows)

    single = cut("near_dedup", good)
    lead = {d: c for d, _, c in brute([r[:2] for r in rows], 5, 80)}
    rows = [r for r in rows if lead[r[0]] == r[0]]
    assert sorted(r.doc_id for r in single.collect()) == sorted(r[0] for r in rows)

    clean = cut("decontamination", single)
    items = []
    for item in read(spark, sf_dir, "benchmark").collect():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in item.text or "").encode().split()
        k = min(5, len(w))
        if w:
            runs = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
            items.append((len(w), runs, set(runs)))
    rows = [r for r in rows if not leaking(r[1], items)]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(r[0] for r in rows)

    mixed = cut("mixing", clean)
    copies = Counter(r.doc_id for r in mixed.collect())
    sizes, taken, largest = defaultdict(int), Counter(), Counter()
    for doc_id, text, source in rows:
        n = len(words(text))
        sizes[source] += n
        taken[source] += n * copies[doc_id]
        largest[source] = max(largest[source], 2 * n)
    assert set(copies) <= {r[0] for r in rows} and max(copies.values()) <= 3
    for source, target in targets(sizes).items():
        assert abs(taken[source] - target) <= largest[source] + 1e-6

    plain, text_of = Tokenizer.from_file(vocabulary_path()), {d: t for d, t, _ in rows}
    start = 0
    for row in sorted(stages["token_shards"](spark, mixed, sf_dir).collect(), key=lambda r: r.start):
        ids = np.array([*plain.encode(text_of[row.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
        copies[row.doc_id] -= 1
    assert not any(copies.values())


@pytest.mark.parametrize("rows", [docs.docs, docs.empty], ids=["odd", "empty"])
def test_run_on_odd_tables(spark, tmp_path, rows):
    rows(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, k % 2, 0) for k in (4, 5, 7, 8)] if rows is docs.docs else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "na na na na na na na")] if rows is docs.docs else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    known = {r[0] for r in docs.ROWS}
    assert all(r.doc_id in known and r.doc_id != 7 for r in got.collect())
