"""Two-stage suffix sorting of a byte array in numpy, and the repeated windows that neighbours in it show.

A suffix is small if it is less than its successor. Small suffixes are sorted directly, eight bytes or fewer a round
and only those that still tie, down to ``depth`` bytes. All others are induced: the first-byte buckets are scanned in
ascending order, and the predecessor of each suffix met, if it isn't small, takes the next place of its own bucket. A
run of one byte is placed as a whole, so the number of steps depends neither on runs nor on repeats. Order is exact
for the first ``depth`` bytes; suffixes that agree so far are neighbours, in any order.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def words_at(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one integer that compares like them; ``raw`` has eight bytes to spare."""
    view = np.ndarray((len(raw) - WORD + 1,), dtype=">u8", buffer=raw, strides=(1,))
    return view[places].astype(np.uint64)


def small_suffixes(raw: np.ndarray) -> np.ndarray:
    """Whether each suffix is less than its successor; the end counts as less than any byte."""
    n = len(raw)
    differs = np.append(raw[1:] != raw[:-1], True)
    at = np.where(differs, np.arange(n), n)
    decider = np.minimum.accumulate(at[::-1])[::-1]  # the next place whose byte differs from its follower's
    less = np.append(raw[:-1] < raw[1:], False)
    return less[decider]


def agree(padded: np.ndarray, a: np.ndarray, b: np.ndarray, width: int, known: int = 0) -> np.ndarray:
    """Whether the common prefix of the suffixes at ``a`` and ``b`` has ``width`` bytes; ``known`` bytes of it are known."""
    same = np.zeros(len(a), dtype=bool)
    left = np.arange(len(a))
    for at in [*range(known, width - WORD, WORD), width - WORD]:
        left = left[words_at(padded, a[left] + at) == words_at(padded, b[left] + at)]
    same[left] = True
    return same


def sorted_directly(padded: np.ndarray, places: np.ndarray, depth: int) -> np.ndarray:
    """``places`` by the first ``depth`` bytes from each."""
    order = places[np.argsort(words_at(padded, places))]
    keys = words_at(padded, order)
    new = np.append(True, keys[1:] != keys[:-1])[: len(order)]
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))  # places of the order that tie with a neighbour
    done, rounds = WORD, 0
    while done < depth and len(open_):
        group = np.cumsum(new[open_])
        if rounds in (1, 5):  # ties that agree to the end need no more rounds
            tie = np.flatnonzero(~new[open_])
            differ = tie[~agree(padded, order[open_[tie] - 1], order[open_[tie]], depth, done)]
            going = np.zeros(int(group[-1]) + 1, dtype=bool)
            going[group[differ]] = True
            open_ = open_[going[group]]
            if not len(open_):
                break
            group = np.cumsum(new[open_])
        taken = min(WORD - 1, (64 - int(group[-1]).bit_length()) // 8)  # bytes beside the group's number
        held = order[open_]
        key = group.astype(np.uint64) << np.uint64(8 * taken) | words_at(padded, held + done) >> np.uint64(64 - 8 * taken)
        by = np.argsort(key)
        order[open_], key = held[by], key[by]
        fresh = np.append(True, key[1:] != key[:-1])
        new[open_] = fresh
        open_ = open_[~(fresh & np.append(fresh[1:], True))]
        done, rounds = done + taken, rounds + 1
    return order


def suffix_array(raw: np.ndarray, depth: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Places of all suffixes of ``raw`` in order of their first ``depth`` bytes.

    With ``wanted`` given, at least the suffixes that it marks: a small suffix that induces none of them isn't sorted.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    padded = np.concatenate([raw, np.zeros(depth + 2 * WORD, dtype=np.uint8)])
    small = small_suffixes(raw)
    places = np.flatnonzero(small)
    met = raw
    if wanted is not None:
        source = np.searchsorted(places, np.arange(n))  # the small suffix that a suffix is or is induced from
        used = np.zeros(len(places) + 1, dtype=bool)
        used[source[wanted]] = used[-1] = True
        places, met = places[used[:-1]], raw[used[source]]
    direct = sorted_directly(padded, places, depth)
    counts, firsts = np.bincount(met, minlength=256), np.bincount(raw[direct], minlength=256)
    start = np.concatenate([[0], np.cumsum(counts)])
    direct_start = np.concatenate([[0], np.cumsum(firsts)])
    #: How many equal bytes end at each place.
    change = np.append(True, raw[1:] != raw[:-1])
    run = np.arange(n) - np.maximum.accumulate(np.where(change, np.arange(n), 0)) + 1
    out, free = np.empty(len(met), dtype=np.int64), start[:-1].copy()
    out[free[raw[-1]]] = n - 1  # the end comes first, and the last suffix before it
    free[raw[-1]] += 1
    for c in np.flatnonzero(counts):
        induced = out[start[c] : free[c]]
        lengths = run[induced]
        if len(induced) and lengths.max() > 1:
            steps = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            by = np.argsort(steps, kind="stable")
            induced = (np.repeat(induced, lengths) - steps)[by]
            out[start[c] : start[c] + len(induced)] = induced
        smalls = direct[direct_start[c] : direct_start[c + 1]]
        out[start[c + 1] - len(smalls) : start[c + 1]] = smalls
        before = np.concatenate([induced, smalls]) - 1
        before = before[before >= 0]
        byte = raw[before]
        before, byte = before[byte > c], byte[byte > c]
        by = np.argsort(byte, kind="stable")
        before, byte = before[by], byte[by]
        met = np.bincount(byte, minlength=256)
        out[free[byte] + np.arange(len(byte)) - (np.cumsum(met) - met)[byte]] = before
        free += met
    return out


def repeated_windows(data: bytes, ends: np.ndarray, width: int, looked_at: np.ndarray | None = None) -> np.ndarray:
    """For each place of ``data``: whether the ``width`` bytes from it also start at an earlier place.

    ``data`` is a row of pieces that end at ``ends`` (ascending); a window lies within one piece. ``width`` is 8 or more.
    With ``looked_at`` given, only windows at the places that it marks count.
    """
    raw = np.frombuffer(data, dtype=np.uint8)
    n = len(raw)
    found = np.zeros(n, dtype=bool)
    whole = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n) >= width
    if looked_at is not None:
        whole &= looked_at
    order = suffix_array(raw, width, whole)
    order = order[whole[order]]
    if len(order) < 2:
        return found
    padded = np.concatenate([raw, np.zeros(width + WORD, dtype=np.uint8)])
    new = np.append(True, ~agree(padded, order[:-1], order[1:], width))
    first = np.minimum.reduceat(order, np.flatnonzero(new))[np.cumsum(new) - 1]
    found[order[order != first]] = True
    return found
