"""Benchmark passages in documents by SimHash of item-sized windows.

For every benchmark item, windows of as many words slide over the whole text. A window's fingerprint is the SimHash
of its runs of five words, each weighted by how often it occurs. Multi-index blocks find every item fingerprint
within Hamming distance ``RADIUS``: two numbers of 64 bits that near differ by at most ``BLOCK_RADIUS`` bits in one of
the eight blocks, and tables by block and value give the items that are so near there. Candidates are verified by the exact weighted
similarity, the sum of lesser counts over the sum of greater counts, of at least 0.8.

A window cannot reach that if fewer than 0.8 of its runs occur in the benchmark at all, so only the others are
fingerprinted; that skips no match. Items lie in blocks of bounded size, each with its own pass over the documents,
so what is sent to the executors is bounded however large the benchmark.

Null, empty and blank texts and items match nothing; an item under five words is one run. Equal items match alike.
Texts of any length are searched whole; repeated documents match each; an empty table of documents gives no rows, and
an empty benchmark lets all documents pass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tarnworks.llm.common import filtered, over_batches
from tarnworks.llm.shingles import hashed, runs, word_hashes

WORDS, LEAST = 5, 0.8
BLOCKS, BLOCK_RADIUS = 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Runs of words in a block of items at most, but for an item that is longer.
MOST_RUNS = 200_000
HITS = "item_id long, start_word long, n_words long, similarity double"
NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= BLOCK_RADIUS
#: Runs of words whose fingerprint sums are held at a time.
SPAN, TOGETHER = 1 << 15, 1 << 12


def simhashes(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the windows of ``length`` runs at the ascending ``starts``: of each of 64 bits, whether more
    runs have it than not, a run counting as often as it occurs."""
    out = np.empty(len(starts), dtype=np.uint64)
    done = 0
    while done < len(starts):
        low = starts[done]
        upto = int(np.searchsorted(starts, low + SPAN))
        own = starts[done:upto] - low
        part = np.ascontiguousarray(hashes[low : low + own[-1] + length])
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
        sums = np.concatenate([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0)])
        out[done:upto] = np.packbits(sums[own + length] - sums[own] > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]
        done = upto
    return out


def similarity(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


class Fingerprints:
    """Items of one size: their fingerprints, and for each block and value of it the items that are near there."""

    def __init__(self, items: list[int], prints: np.ndarray, n_runs: int):
        self.items, self.prints, self.n_runs = items, prints, n_runs
        own = prints.view(np.uint8).reshape(-1, BLOCKS)
        self.blocks = [np.packbits(NEAR[:, own[:, b]], axis=1) for b in range(BLOCKS)]

    def near(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in ``values``, place in ``items``) of fingerprints within ``RADIUS``."""
        own = values.view(np.uint8).reshape(-1, BLOCKS)
        found = self.blocks[0][own[:, 0]]
        for b in range(1, BLOCKS):
            found = found | self.blocks[b][own[:, b]]
        at, item = np.nonzero(np.unpackbits(found, axis=1, count=len(self.items)))
        close = np.bitwise_count(values[at] ^ self.prints[item]) <= RADIUS
        return at[close], item[close]


class Items:
    """A block of benchmark items with the tables that searches need."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.ids = [item for item, _ in rows]
        self.n_words = [len(w) for _, w in rows]
        hashes = [runs(w, WORDS) for _, w in rows]
        self.counts = [Counter(h.tolist()) for h in hashes]
        every = np.unique(np.concatenate(hashes))
        self.every, self.bits = every, max(16, int(len(every)).bit_length() + 5)
        self.mask = np.zeros(1 << self.bits, dtype=bool)
        self.mask[(every >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        of_size: dict[int, list[int]] = {}
        for k, n in enumerate(self.n_words):
            of_size.setdefault(n, []).append(k)
        self.sizes = {n: Fingerprints(ks, np.array([simhashes(hashes[k], np.zeros(1, dtype=np.int64), len(hashes[k]))[0] for k in ks], dtype=np.uint64), len(hashes[ks[0]])) for n, ks in sorted(of_size.items())}

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which of these runs occur in an item."""
        out = self.mask[(hashes >> np.uint64(64 - self.bits)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            place = np.searchsorted(self.every, hashes[at]).clip(max=len(self.every) - 1)
            out[at] = self.every[place] == hashes[at]
        return out

    def search(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item that the text of these words holds."""
        best: dict[int, tuple[float, int]] = {}
        for width in {min(WORDS, n) for n in self.n_words}:
            if len(words) < width:
                continue
            hashes = runs(words, width)
            hit = self.known(hashes)
            if not hit.any():
                continue
            before = np.concatenate([[0], np.cumsum(hit)])
            for n_words, held in self.sizes.items():
                n = held.n_runs
                if min(WORDS, n_words) != width or len(hashes) < n:
                    continue
                all_starts = np.flatnonzero(before[n:] - before[:-n] >= LEAST * n - 1e-9)
                for part in range(0, len(all_starts), TOGETHER):
                    starts = all_starts[part : part + TOGETHER]
                    for at, place in zip(*held.near(simhashes(hashes, starts, n))):
                        k, start = held.items[place], int(starts[at])
                        s = similarity(Counter(hashes[start : start + n].tolist()), self.counts[k])
                        if s >= LEAST and s > best.get(k, (0, 0))[0]:
                            best[k] = (s, start)
        return [(self.ids[k], start, self.n_words[k], s) for k, (s, start) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, most_runs: int = MOST_RUNS) -> Iterator[Items]:
    """Items in blocks of bounded size, ordered by identifier."""
    rows, held = [], 0
    for row in benchmark.select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        words = word_hashes(row.text)
        if len(words) == 0:
            continue
        if rows and held + len(words) > most_runs:
            yield Items(rows)
            rows, held = [], 0
        rows.append((row.item_id, words))
        held += len(words)
    if rows:
        yield Items(rows)


def find_leaks(docs: DataFrame, benchmark: DataFrame, most_runs: int = MOST_RUNS) -> DataFrame:
    """doc_id, item_id, start_word, n_words and similarity: a row for each document and item that it holds."""
    kept, found = docs.select("doc_id", "text"), None
    for items in item_blocks(benchmark, most_runs):

        def run(batches, items=items):
            for batch in batches:
                rows = [(doc_id, *hit) for doc_id, words in zip(batch["doc_id"], hashed(batch["text"])) for hit in items.search(words)]
                if rows:
                    yield dict(zip(("doc_id", "item_id", "start_word", "n_words", "similarity"), zip(*rows)))

        part = over_batches(kept, run, f"doc_id long, {HITS}")
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], f"doc_id long, {HITS}") if found is None else found


def without_leaks(docs: DataFrame, benchmark: DataFrame, most_runs: int = MOST_RUNS) -> DataFrame:
    """Rows of ``docs`` that hold no item, decided as they stream by; nothing is shuffled."""
    for items in item_blocks(benchmark, most_runs):
        docs = filtered(docs, lambda texts, items=items: [not items.search(words) for words in hashed(texts)], "text")
    return docs
