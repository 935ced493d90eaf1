import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnworks.llm import mixing, rules
from tarnworks.llm.common import n_words, read

from . import docs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(text):
    w = words(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if many[x] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    n = len(w)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def test_counts_equal_brute_force(spark, sf_dir):
    table = read(spark, sf_dir, "documents").select("doc_id", "text").unionByName(docs.docs(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "text"))
    expected = Counter((r.doc_id, *brute(r.text)) for r in table.collect())
    got = rules.quality_rules(table).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    assert not any(r.kept and r.base_failed for r in got)


def test_windows_without_packing(spark):
    got = docs.docs(spark).select(rules.words(F.col("text")).alias("w")).where(F.size("w") >= 4).select(rules.windows_found_again(F.col("w")).alias("a"), rules.from_windows(F.col("w")).alias("b"))
    assert all(r.a == r.b for r in got.collect())


def test_rules_separate_labelled_documents(spark):
    labels = read(spark, "/root/testdata/sf0.01", "labels").withColumnRenamed("quality", "label")
    rows = rules.quality_rules(read(spark, "/root/testdata/sf0.01", "documents")).join(labels, "doc_id").collect()
    assert sum(r.kept for r in rows if r.label == 1 and not r.base_failed) > 0.98 * sum(r.label == 1 and not r.base_failed for r in rows)
    assert sum(r.kept for r in rows if r.label == 0) < 0.1 * sum(r.label == 0 for r in rows)


def by_document(votes, rounds):
    """Expectation-maximisation over documents one by one, in numpy: share, chances and posteriors."""
    share, chances = rules.START_GOOD, np.array([[c] * votes.shape[1] for c in rules.START_BAD_VOTES])
    cast, bad = (votes != 0).astype(float), (votes < 0).astype(float)

    def good():
        like = [np.where(cast > 0, np.where(bad > 0, c, 1 - c), 1.0).prod(1) for c in chances]
        return share * like[0] / (share * like[0] + (1 - share) * like[1])

    for _ in range(rounds):
        p = good()
        weights = np.stack([p, 1 - p])
        mass = weights.sum(1) + rules.SMOOTHING * np.array([rules.START_GOOD, 1 - rules.START_GOOD])
        chances = np.stack([(w @ bad + rules.SMOOTHING * c) / (w @ cast + rules.SMOOTHING) for w, c in zip(weights, rules.START_BAD_VOTES)])
        share = mass[0] / mass.sum()
    return share, chances, good()


def test_estimate_equals_brute_force():
    rng = np.random.default_rng(3)
    truth = rng.random(3000) < 0.7
    right = np.array([0.95, 0.8, 0.7, 0.6, 0.9])
    votes = np.where(rng.random((3000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None] * (rng.random((3000, 5)) < 0.8)
    patterns = sorted(Counter(map(tuple, votes.tolist())).items())
    share, chances, good = rules.estimate(patterns)
    own_share, own_chances, own_good = by_document(votes, rules.ROUNDS)
    assert share == pytest.approx(own_share) and np.allclose(chances, own_chances)
    at = {v: p for (v, _), p in zip(patterns, good)}
    assert np.allclose([at[tuple(v)] for v in votes.tolist()], own_good)
    assert abs(share - truth.mean()) < 0.05 and np.abs(1 - np.array(chances[0]) - right).max() < 0.05  # the accuracies that made the votes


def test_rules_that_copy_each_other_are_merged():
    rng = np.random.default_rng(4)
    truth = np.where(rng.random(4000) < 0.7, 1, -1)
    votes = np.where(rng.random((4000, 7)) < 0.85, 1, -1) * truth[:, None]
    votes[:, 6] = np.where(rng.random(4000) < 0.2, votes[:, 6], votes[:, 5])  # four of five votes are the sixth rule's
    patterns = sorted(Counter(map(tuple, votes.tolist())).items())
    assert rules.alike(patterns, rules.estimate(patterns)[2]) == [[0], [1], [2], [3], [4], [5, 6]]
    assert rules.merged((1, -1, 0, -1, -1), [[0], [1], [2], [3, 4]]) == (1, -1, 0, -1) and rules.merged((1, -1), [[0, 1]]) == (0,)


def test_verdicts_are_not_all_must_pass(spark):
    counts = rules.features(read(spark, "/root/testdata/sf0.01", "documents"))
    votes = {r.doc_id: r[1:] for r in counts.select("doc_id", *(v.alias(n) for n, v in rules.rules().items())).collect()}
    rows = [r for r in rules.quality_rules(read(spark, "/root/testdata/sf0.01", "documents")).collect() if not r.base_failed]
    one_bad_vote = [r for r in rows if min(votes[r.doc_id]) < 0 and r.kept]
    assert one_bad_vote and all(sum(v < 0 for v in votes[r.doc_id]) == 1 and sum(v > 0 for v in votes[r.doc_id]) >= 4 for r in one_bad_vote)
    assert any(not r.kept for r in rows)


def test_no_documents(spark):
    assert rules.quality_rules(docs.empty(spark)).count() == 0
    assert mixing.mix(docs.empty(spark)).count() == 0


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    out, left, open_ = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while open_ and left > 1e-9:
        total, over = sum(weight[s] for s in open_), False
        for s in sorted(open_, key=str):
            out[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if out[s] >= 3 * sizes[s]:
                left += out[s] - 3 * sizes[s]
                out[s] = 3.0 * sizes[s]
                open_.discard(s)
    return out


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_mixing(spark, scale):
    table = read(spark, f"/root/testdata/{scale}", "documents").select("doc_id", "source", "text").unionByName(docs.docs(spark).select((F.col("doc_id") + 10**6).alias("doc_id"), "source", "text"))
    source = defaultdict(set)
    sizes = Counter()
    for r in table.collect():
        source[r.doc_id].add(r.source)
        sizes[r.source] += len(words(r.text))
    expected = targets(sizes)
    rows = mixing.mix(table).collect()
    assert len(rows) == table.count()
    taken, largest = Counter(), Counter()
    for r in rows:
        (s,) = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], 2 * r.size)
    for s in sizes:
        assert abs(taken[s] - expected[s]) <= largest[s] + 1e-6
    assert sorted(rows, key=str) == sorted(mixing.mix(table).collect(), key=str)


def test_repeated_rows_are_settled_one_by_one(spark):
    rows = [(None, f"s{k % 2}", "w x y z") for k in range(800)] + [(k, "s0", "a b c") for k in range(3)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(table).collect()
    assert len(got) == len(rows)
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source_size].append(r)
    assert len(by_source) == 2
    for own in by_source.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 8
        assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size for r in own)
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(table.repartition(7)).collect()))
    copies = Counter(r.source for r in mixing.mixed(table).collect())
    taken = {own[0].source_size: sum(r.taken // r.size for r in own) for own in by_source.values()}
    assert copies == {"s0": taken[1609], "s1": taken[1600]}


def test_mixed_rows_keep_their_columns(spark):
    names = ("_id", "_size", "_turn", "_copy", "_copies", "_key", "_nth", "size", "k", "unit", "source_size")
    rows = [(k // 2, f"s{k % 2}", "w " * (1 + k % 2), *(f"{n}{k}" for n in names)) for k in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.mixed(table).collect()
    assert set(map(tuple, got)) <= set(rows)
    copies = Counter(map(tuple, got))
    wanted = {(r.doc_id, r.size): r.taken // r.size for r in mixing.mix(table).collect()}
    assert {(row[0], 1 + k % 2): copies[row] for k, row in enumerate(rows)} == wanted  # equal identifiers of two sources aren't swapped


def test_a_source_without_words_and_empty_mix(spark):
    table = spark.createDataFrame([(1, "a", None), (2, "a", " "), (3, "b", "x y")], "doc_id long, source string, text string")
    got = {r.doc_id: r for r in mixing.mix(table).collect()}
    assert got[1].taken == got[2].taken == 0 and got[1].target == 0 and got[3].taken % 2 == 0
    assert mixing.mixed(docs.empty(spark)).count() == 0


def test_words_are_counted(spark):
    rows = docs.docs(spark).select("text", n_words(F.col("text")).alias("n")).collect()
    assert all(r.n == len(words(r.text)) for r in rows)
