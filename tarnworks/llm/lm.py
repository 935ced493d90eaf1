"""Documents scored by masked pseudo-likelihood.

A small network predicts every word of a text, masked, from three words on either side: the sum of a table row for
each place around it, squashed, gives a distribution over 32 groups of words and one over the 32 words of a group.
A document's score is the sum of the log-probabilities of all its words.

Vocabulary: all words of the corpus are counted, by a 64-bit hash of each (two words that share one, at a chance of
n ** 2 / 4e19 for n distinct words, count as one); the commonest get a number of their own, the others share buckets.
A word in a bucket has the probability of the bucket, which the network gives, times the word's share of all that
the bucket counts. So the probabilities of all distinct words of the corpus, however many, sum to one at each place.
The counts of the words in buckets stay a table and never meet on one machine: documents are scored in blocks, the
distinct words of each block are joined with that table, and the logarithms of their shares come back to the block.
The same join tells which words the corpus holds only once; a document that occurs twice has none of them.

Training: in each of ``ROUNDS`` rounds every task fits a copy of the network to all its documents of that round, in
numpy, and passes on how the weights moved; a tree of tasks averages the moves by words. Every document trains in
one round. What is gathered grows with the input: a row for each distinct word and task or block, and the weights
of each task; the driver gets a list of 992 words, the totals of 32 buckets and one averaged network (1 MB).

Null, empty and blank texts have no words: their sum is 0 and their mean null. Texts of any length are scored whole.
Repeated rows count and are scored each. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.common import Work
from tarnworks.llm.shingles import hashed, word_hashes

GROUPS, PER_GROUP, SIDE, HIDDEN = 32, 32, 3, 32
SHARED = 32
WORDS = GROUPS * PER_GROUP
PLACES = [*range(-SIDE, 0), *range(1, SIDE + 1)]
ROUNDS, STEP, SLICE, RATE, LANES, SEED = 2, 4096, 8192, 0.15, 16, 5  # STEP: words in each step of training; SLICE: scored at once
#: Logits below this have exponentials that sum without overflow.
SAFE = 60.0
#: Words that a task counts before it passes the counts on; a longer text is a part of its own.
MOST_COUNTED = 2_000_000
#: Words in buckets, repeats included, and documents after which a block of documents ends; a longer text is a block of its own.
BLOCK_WORDS, BLOCK_DOCS = 1_000_000, 20_000


def counted(docs: DataFrame) -> DataFrame:
    """word (its hash) and n of every distinct word of the documents."""

    def run(batches):
        held, size = [], 0

        def distinct():
            words, n = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"word": words, "n": n})

        for own in hashed(t for batch in batches for t in batch["text"]):
            held.append(own.view(np.int64))
            size += len(own)
            if size > MOST_COUNTED:
                yield distinct()
                held, size = [], 0
        if size:
            yield distinct()

    return docs.select("text").mapInPandas(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, DataFrame]:
    """The commonest words, by count and then by hash; word, log_share (in its bucket) and once of all others."""
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS - SHARED).collect()
    known = np.array([r.word for r in top], dtype=np.int64)
    n, last = (top[-1].n, top[-1].word) if len(top) == WORDS - SHARED else (0, 0)
    others = counts.where((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > last))).withColumn("bucket", F.pmod(F.col("word"), F.lit(SHARED)).cast("int"))
    totals = dict(others.groupBy("bucket").agg(F.sum("n")).collect())  # SHARED rows
    total = F.array(*(F.lit(float(totals.get(k, 1))) for k in range(SHARED)))[F.col("bucket")]
    return known, others.select("word", F.log(F.col("n") / total).alias("log_share"), (F.col("n") == 1).alias("once"))


class Numbers:
    """Number of each word: its place among the known ones; others share the last numbers by hash."""

    def __init__(self, known: np.ndarray):
        self.place = np.argsort(known).astype(np.int32)
        self.known = known[self.place]

    def of_hashes(self, words: np.ndarray) -> np.ndarray:
        out = (WORDS - SHARED + words % SHARED).astype(np.int32)
        if len(self.known):
            at = np.searchsorted(self.known, words).clip(max=len(self.known) - 1)
            hit = self.known[at] == words
            out[hit] = self.place[at[hit]]
        return out

    def of(self, text: str | None) -> np.ndarray:
        return self.of_hashes(word_hashes(text).view(np.int64))


def fresh(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "around": (rng.standard_normal((len(PLACES), WORDS + 1, HIDDEN)) * 0.05).astype(np.float32),  # the last row: beyond the text
        "bias": np.zeros(HIDDEN, np.float32),
        "group": (rng.standard_normal((HIDDEN, GROUPS)) * 0.05).astype(np.float32),
        "group_bias": np.zeros(GROUPS, np.float32),
        "word": (rng.standard_normal((GROUPS, HIDDEN, PER_GROUP)) * 0.05).astype(np.float32),
        "word_bias": np.zeros((GROUPS, PER_GROUP), np.float32),
    }


def log_sums(x: np.ndarray, bound: float) -> np.ndarray:
    """Logarithm of the sum of exponentials of each row; ``bound``: on all logits, known from the weights."""
    if bound < SAFE:
        return np.log(np.exp(x).sum(1))
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def bound_of(weights: np.ndarray, bias: np.ndarray) -> float:
    """No logit exceeds this, as hidden values lie between -1 and 1."""
    return float((np.abs(weights).sum(-2) + np.abs(bias)).max())


def contexts(padded: np.ndarray, start: int, stop: int) -> list[np.ndarray]:
    """Numbers of the words at each place around the words from ``start`` to ``stop``; ``padded`` has SIDE more at either end."""
    return [padded[start + SIDE + p : stop + SIDE + p] for p in PLACES]


def hidden(net: dict, around: list[np.ndarray]) -> np.ndarray:
    h = net["around"][0].take(around[0], axis=0)
    for table, numbers in zip(net["around"][1:], around[1:]):
        h += table.take(numbers, axis=0)
    h += net["bias"]
    return np.tanh(h, out=h)


def by_group(groups: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts words of a group together, and (group, start, stop) in that order."""
    order = np.argsort(groups.astype(np.int8), kind="stable")
    ends = np.searchsorted(groups[order], np.arange(GROUPS + 1)).tolist()
    return order, [(g, a, b) for g, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]


def word_logits(net: dict, h: np.ndarray, groups: np.ndarray, parts: list[tuple[int, int, int]]) -> np.ndarray:
    """Logits of the words of each one's group, for words in the order of ``by_group``."""
    out = np.empty((len(h), PER_GROUP), dtype=h.dtype)
    for g, a, b in parts:
        np.matmul(h[a:b], net["word"][g], out=out[a:b])
    out += net["word_bias"].take(groups, axis=0)
    return out


def log_probabilities(net: dict, around: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    h, every = hidden(net, around), np.arange(len(target))
    groups, own = target // PER_GROUP, target % PER_GROUP
    logits = h @ net["group"] + net["group_bias"]
    out = (logits[every, groups] - log_sums(logits, bound_of(net["group"], net["group_bias"]))).astype(np.float64)
    order, parts = by_group(groups)
    logits = word_logits(net, h[order], groups[order], parts)
    out[order] += logits[every, own[order]] - log_sums(logits, bound_of(net["word"], net["word_bias"]))
    return out


def softmax(x: np.ndarray, bound: float) -> np.ndarray:
    e = np.exp(x if bound < SAFE else x - x.max(1, keepdims=True))
    e /= e.sum(1, keepdims=True)
    return e


def step(net: dict, memory: dict, padded: np.ndarray, start: int, stop: int) -> None:
    """One step of Adagrad on the words from ``start`` to ``stop`` that aren't padding."""
    real = np.flatnonzero(padded[start + SIDE : stop + SIDE] < WORDS)
    if not len(real):
        return
    around = [a[real] for a in contexts(padded, start, stop)]
    target = padded[start + SIDE : stop + SIDE][real]
    h, n = hidden(net, around), len(real)
    groups, own, every = target // PER_GROUP, target % PER_GROUP, np.arange(n)
    error = softmax(h @ net["group"] + net["group_bias"], bound_of(net["group"], net["group_bias"]))
    error[every, groups] -= 1
    got = {"group": h.T @ error / n, "group_bias": error.sum(0) / n, "word": np.zeros_like(net["word"]), "word_bias": np.zeros_like(net["word_bias"])}
    back = error @ net["group"].T
    order, parts = by_group(groups)
    sorted_h, sorted_back = h[order], np.empty_like(h)
    error = softmax(word_logits(net, sorted_h, groups[order], parts), bound_of(net["word"], net["word_bias"]))
    error[every, own[order]] -= 1
    for g, a, b in parts:
        np.matmul(sorted_h[a:b].T, error[a:b], out=got["word"][g])
        np.matmul(error[a:b], net["word"][g].T, out=sorted_back[a:b])
    got["word"] /= n
    got["word_bias"][[g for g, _, _ in parts]] = np.add.reduceat(error, [a for _, a, _ in parts], axis=0) / n
    back[order] += sorted_back
    back *= (1 - h * h) / n
    got["bias"] = back.sum(0)
    for name, g in got.items():
        memory[name] += g * g
        net[name] -= RATE * g / (np.sqrt(memory[name]) + 1e-6)
    # rows of the tables: the slopes at all places of a word, for each place around, are summed in the words' order
    window = padded[start : stop + 2 * SIDE]
    spread = np.zeros((len(window) + 2 * SIDE, HIDDEN), dtype=np.float32)
    spread[real + 2 * SIDE] = back
    order = np.argsort(window, kind="stable")
    words = window[order]
    firsts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    rows = words[firsts]
    for k, p in enumerate(PLACES):
        g = np.add.reduceat(spread.take(order + (SIDE - p), axis=0), firsts, axis=0)
        seen = memory["around"][k][rows] + g * g
        memory["around"][k][rows] = seen
        net["around"][k][rows] -= RATE * g / (np.sqrt(seen) + 1e-6)


def fit_to(net: dict, texts, numbers: Numbers) -> tuple[dict, int]:
    """The network after a pass over the texts, and the number of their words."""
    net, memory, total = {k: v.copy() for k, v in net.items()}, {k: np.full_like(v, 1e-6) for k, v in net.items()}, 0
    gap, held, size = np.full(SIDE, WORDS, dtype=np.int32), [], 0

    def learn(held):
        padded = np.concatenate([gap, *held])
        for start in range(0, len(padded) - 2 * SIDE, STEP):
            step(net, memory, padded, start, min(start + STEP, len(padded) - 2 * SIDE))

    for words in hashed(texts):
        own = numbers.of_hashes(words.view(np.int64))
        total += len(own)
        held += [own, gap]
        size += len(own)
        if size >= 4 * STEP:
            learn(held)
            held, size = [], 0
    if size:
        learn(held)
    return net, total


def packed(net: dict) -> np.ndarray:
    return np.concatenate([net[k].ravel() for k in sorted(net)])


def unpacked(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, v in sorted(fresh().items()):
        out[k] = flat[at : at + v.size].reshape(v.shape).astype(np.float32)
        at += v.size
    return out


def summed(batches):
    """Sums of the moves of each part, as they stream by in order."""
    part, total, words = None, None, 0
    for batch in batches:
        for key, move, n in zip(batch["part"], batch["move"], batch["n"]):
            if key != part:
                if part is not None:
                    yield pd.DataFrame({"part": [part], "move": [total.tobytes()], "n": [words]})
                part, total, words = key, np.zeros(len(move) // 8), 0
            total += np.frombuffer(move)
            words += n
    if part is not None:
        yield pd.DataFrame({"part": [part], "move": [total.tobytes()], "n": [words]})


def trained(docs: DataFrame, known: np.ndarray, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    net = fresh()
    for turn in range(rounds):

        def run(batches, net=net):
            texts = (t for batch in batches for t in batch["text"])
            moved, n = fit_to(net, texts, Numbers(known))
            if n:
                move = (packed(moved).astype(np.float64) - packed(net)) * n
                name = xxhash.xxh3_64_intdigest(move.tobytes())
                parts = np.array_split(move, LANES)
                yield pd.DataFrame({"part": range(LANES), "lane": [name % LANES] * LANES, "name": [name >> 1] * LANES, "move": [p.tobytes() for p in parts], "n": [n] * LANES})

        own = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == turn).select("text")
        moves = own.mapInPandas(run, "part int, lane int, name long, move binary, n long")
        first = moves.withColumn("part", F.col("part") * LANES + F.col("lane")).repartition("part").sortWithinPartitions("part", "name").select("part", "move", "n")
        lanes = first.mapInPandas(summed, "part int, move binary, n long")
        second = lanes.select((F.col("part") / LANES).cast("int").alias("part"), F.col("part").alias("name"), "move", "n").repartition("part").sortWithinPartitions("part", "name").select("part", "move", "n")
        rows = second.mapInPandas(summed, "part int, move binary, n long").orderBy("part").collect()  # one network
        if rows:
            net = unpacked(packed(net) + np.concatenate([np.frombuffer(r.move) / r.n for r in rows]))
    return net


def scored(net: dict, texts: list[np.ndarray]) -> list[float]:
    """Scores of many texts, computed in slices that span them."""
    gap = np.full(SIDE, WORDS, dtype=np.int32)
    padded = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    owner = np.repeat(np.arange(len(texts)), [len(t) + SIDE for t in texts])
    out, n = np.zeros(len(texts)), len(padded) - 2 * SIDE
    for start in range(0, n, SLICE):
        stop = min(start + SLICE, n)
        target = padded[start + SIDE : stop + SIDE]
        at = np.flatnonzero(target < WORDS)
        logs = log_probabilities(net, [a[at] for a in contexts(padded, start, stop)], target[at])
        out += np.bincount(owner[start:stop][at], logs, len(texts))
    return out.tolist()


class Block:
    """Documents scored together, and the words of theirs that lie in buckets."""

    def __init__(self):
        self.ids, self.lengths, self.scores, self.words, self.owners, self.size = [], [], [], [], [], 0

    def add(self, ids: list, words: list[np.ndarray], numbers: list[np.ndarray], scores: list[float]) -> None:
        for own, n in zip(words, numbers):
            rare = own[n >= WORDS - SHARED]
            self.words.append(rare)
            self.owners.append(np.full(len(rare), len(self.owners), dtype=np.int32))
            self.size += len(rare)
        self.ids += ids
        self.lengths += map(len, numbers)
        self.scores += scores

    def rows(self, name: int):
        """A row for each distinct word, with a document number for each time it occurs, and one for the documents."""
        none = [i is None for i in self.ids]
        kept = np.array([[i or 0 for i in self.ids], none, self.lengths], dtype=np.int64).tobytes() + np.array(self.scores, dtype=np.float64).tobytes()
        yield pa.RecordBatch.from_pydict({"block": pa.array([name], pa.int64()), "size": pa.array([len(self.ids)], pa.int32()), "word": pa.array([None], pa.int64()), "at": pa.array([kept], pa.binary())})
        words = np.concatenate(self.words)
        if not len(words):
            return
        order = np.argsort(words, kind="stable")
        words, owners = words[order], np.concatenate(self.owners)[order]
        firsts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
        ends = np.append(firsts, len(words))
        for start in range(0, len(firsts), 50_000):
            upto = min(start + 50_000, len(firsts))
            offsets = ((ends[start : upto + 1] - ends[start]) * 4).astype(np.int32)
            at = pa.Array.from_buffers(pa.binary(), upto - start, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(owners[ends[start] : ends[upto]].tobytes())])
            yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(upto - start, name)), "size": pa.array(np.zeros(upto - start, np.int32)), "word": pa.array(words[firsts[start:upto]]), "at": at})


def in_blocks(known: np.ndarray, net: dict[str, np.ndarray]):
    """A mapInArrow function from doc_id and text to the rows of blocks."""

    def run(batches):
        numbers, block, name = Numbers(known), Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts, start = batch.column("doc_id").to_pylist(), hashed(t.as_py() for t in batch.column("text")), 0
            while start < len(ids):
                words, held, size = [], [], 0
                while start + len(held) < len(ids) and size < 16 * SLICE:
                    words.append(next(texts).view(np.int64))
                    held.append(numbers.of_hashes(words[-1]))
                    size += len(held[-1])
                block.add(ids[start : start + len(held)], words, held, scored(net, held))
                start += len(held)
                if block.size >= BLOCK_WORDS or len(block.ids) >= BLOCK_DOCS:
                    yield from block.rows(name)
                    block, name = Block(), name + 1
        if block.ids:
            yield from block.rows(name)

    return run


def numbers_in(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers in a column of bytes, in order, and how many each row holds."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes(), dtype=np.int32), np.diff(ends) // 4


def added_up(batches):
    """Scores of the documents of each block, whose rows stream by in order, the one for the documents first."""
    ids, none, lengths, scores, unseen = (), None, None, None, None

    def done():
        with np.errstate(invalid="ignore", divide="ignore"):
            mean = scores / lengths
        return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, mask=none), "n_words": pa.array(lengths), "log_prob": pa.array(scores), "mean_log_prob": pa.array(mean, mask=lengths == 0), "n_unseen": pa.array(unseen)})

    for batch in batches:
        sizes, at = batch.column("size").to_numpy(), batch.column("at")
        shares, once = batch.column("log_share").to_numpy(zero_copy_only=False), batch.column("once").fill_null(False).to_numpy(zero_copy_only=False)
        firsts = np.flatnonzero(sizes).tolist()
        for start, stop in zip([0, *firsts], [*firsts, len(sizes)]):
            if start < stop and sizes[start]:
                if len(ids):
                    yield done()
                kept = at[start].as_py()
                ids, none, lengths = np.frombuffer(kept[: 24 * sizes[start]], dtype=np.int64).reshape(3, -1)
                none, scores = none.astype(bool), np.frombuffer(kept[24 * sizes[start] :]).copy()
                unseen = np.zeros(len(ids), dtype=np.int64)
                start += 1
            if start < stop:
                owners, times = numbers_in(at.slice(start, stop - start))
                scores += np.bincount(owners, np.repeat(shares[start:stop], times), len(scores))
                unseen += np.bincount(owners[np.repeat(once[start:stop], times)], minlength=len(scores))
    if len(ids):
        yield done()


def lm_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, log_prob (the sum over all words), mean_log_prob and n_unseen (words that occur nowhere else in
    the corpus, which is what a model of the rest of it has not seen) of every row of ``docs``."""
    work = Work(docs.sparkSession, "lm_scores")
    known, shares = vocabulary(work.cut(counted(docs), "counts"))
    net = trained(docs, known, rounds)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(in_blocks(known, net), "block long, size int, word long, at binary")
    joined = rows.join(shares, "word", "left").select("block", "size", "at", "log_share", "once")  # the documents' row has no word
    return joined.repartition("block").sortWithinPartitions("block", F.desc("size")).mapInArrow(added_up, "doc_id long, n_words long, log_prob double, mean_log_prob double, n_unseen long")
