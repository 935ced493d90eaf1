"""Hashes of words and of runs of words, for whole texts, in numpy.

No word is looked up: the hash of each comes from sums over the bytes of a span of texts, so nothing is remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import xxhash

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
P1, P2, P3 = (np.uint64(p) for p in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(h: np.ndarray) -> np.ndarray:
    """A finalizer: every bit of the input moves every bit of the output."""
    h = (h ^ h >> np.uint64(30)) * P2
    h = (h ^ h >> np.uint64(27)) * P3
    return h ^ h >> np.uint64(31)


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


#: Bytes that are hashed at a time; longer words have a hash of another kind, wherever they stand.
SPAN, LONG = 1 << 18, 1 << 9
WHITE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: A number for each byte, the same for A to Z and a to z, none for white space; and powers of an odd number and of its inverse.
LETTERS = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.uint64)[np.frombuffer(LOWER, dtype=np.uint8)] * ~WHITE
BASE = 0x9E3779B97F4A7C15
POWERS, INVERSES = powers(BASE, SPAN + 1), powers(pow(BASE, -1, 1 << 64), SPAN + 1)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER).split()


def of_long(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word.translate(LOWER), 42)


def in_span(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of up to ``SPAN`` bytes, and where it starts: sums of letters times powers, told apart by sums so far."""
    raw = np.frombuffer(data, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(WHITE[raw], prepend=True, append=True))
    starts, stops = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(LETTERS[raw] * POWERS[: len(raw)], out=sums[1:])
    words = mixed((sums[stops] - sums[starts]) * INVERSES[starts])
    for k in np.flatnonzero(stops - starts > LONG):
        words[k] = of_long(data[starts[k] : stops[k]])
    return words, starts


def in_long(data: bytes) -> np.ndarray:
    """Hash of each word of a text of any length, span by span, cut at white space."""
    out, at = [], 0
    while at < len(data):
        stop = at + SPAN
        if stop < len(data):
            gaps = np.flatnonzero(WHITE[np.frombuffer(data, dtype=np.uint8, count=SPAN, offset=at)])
            stop = at + int(gaps[-1]) + 1 if len(gaps) else at
        if stop == at:  # a word longer than a span
            found = re.search(rb"[\x20\x09-\x0D]", data[at:])
            stop = at + found.start() if found else len(data)
            out.append(np.array([of_long(data[at:stop])], dtype=np.uint64))
        else:
            out.append(in_span(data[at:stop])[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def hashed(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Hash of each word of each text, in order; short texts are handled together."""
    held, size = [], 0

    def together():
        words, starts = in_span(b" ".join(held))
        ends = np.cumsum([len(d) + 1 for d in held])
        return np.split(words, np.searchsorted(starts, ends[:-1]))

    for text in texts:
        data = (text or "").encode()
        if held and size + len(data) >= SPAN:
            yield from together()
            held, size = [], 0
        if len(data) >= SPAN:
            yield in_long(data)
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        yield from together()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words of a text, with A to Z lower-cased."""
    return next(hashed([text]))


def runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, in order; of the whole if there are fewer words; none without words."""
    if len(words) == 0:
        return words
    width = min(k, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        h = (h ^ h >> np.uint64(29)) * P1 + words[j : j + n]
    return mixed(h)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Distinct runs of ``k`` words, ascending."""
    return np.unique(runs(word_hashes(text), k))


def shingle_sets(texts: Iterable[str | None], k: int) -> Iterator[np.ndarray]:
    """``shingle_set`` of each text."""
    return (np.unique(runs(words, k)) for words in hashed(texts))
