"""Quality rules as weak supervision, in DataFrame functions alone.

Each rule looks at a few counts of a text and votes good, votes bad or abstains. How often each rule is right is
not set but estimated: the votes of all documents that the base doesn't settle are counted by pattern (at most 3 to
the number of rules), and expectation-maximisation over those counts gives the share of good documents and how often
each rule votes bad on good and on bad ones, without limits on either. What the start fixes is only which of the two
classes is the good one. Rules that vote alike within a class (a correlation of ``ALIKE`` or more) would count one
finding twice, so they are merged into one voter, and the estimate is made again. A document's posterior probability
of being good then decides: one bad vote of a rule that nothing else bears out doesn't outweigh many good ones.

Null and empty texts have no words; they, and texts under 50 words, fail the base. Texts of any length are counted
whole. Repeated rows count each. An empty table gives no rows. If the base settles every document, nothing is
estimated and none is kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.common import Work, bound, words

SYMBOLS = r"[#*$%&|<>]"
#: Letters, at most one mark after them, quotes or brackets around.
PLAIN = r"""^[("'«]*\p{L}[\p{L}\p{M}'’-]*[.,;:!?…]?[)"'»]*$"""
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_plain")
#: Where the estimate starts: the share of good documents, and the chance of a bad vote on good and on bad ones; it counts as much as ``SMOOTHING`` documents.
START_GOOD, START_BAD_VOTES, SMOOTHING = 0.8, (0.05, 0.4), 2.0
ROUNDS, ALIKE = 100, 0.5
KEEP_FROM = 0.5


def windows_found_again(w: Column) -> Column:
    """Places, in ascending order, of the 3-word windows that occur twice or more among the words ``w``.

    A window's hash and place share one integer, so that the sort is one of plain integers. Neighbours of equal
    hash are compared word by word; if any differ, the windows themselves are sorted instead.
    """
    n = F.size(w)
    room = F.when(n < 1 << 16, 1 << 16).when(n < 1 << 20, 1 << 20).otherwise(1 << 32).cast("long")

    def from_packed(s):
        place = lambda k: F.pmod(s["v"][k], s["room"]).cast("int")
        same = lambda k: s["v"][k] - F.pmod(s["v"][k], s["room"]) == s["v"][k - 1] - F.pmod(s["v"][k - 1], s["room"])
        window = lambda i: F.struct(w[i], w[i + 1], w[i + 2])
        return bound(F.filter(F.sequence(F.lit(1), F.size(s["v"]) - 1), same), lambda pairs: F.when(
            F.forall(pairs, lambda k: window(place(k)) == window(place(k - 1))),
            F.sort_array(F.array_distinct(F.concat(F.transform(pairs, place), F.transform(pairs, lambda k: place(k - 1))))),
        ).otherwise(from_windows(w)))

    def packed(room):
        hashed = lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])
        return F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: bound(hashed(i), lambda h: h - F.pmod(h, room)) + i))

    found = bound(room, lambda room: bound(F.struct(packed(room).alias("v"), room.alias("room")), from_packed))
    return F.when(n >= 4, found).otherwise(F.array().cast("array<int>"))


def from_windows(w: Column) -> Column:
    rows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(w[i].alias("a"), w[i + 1].alias("b"), w[i + 2].alias("c"), i.alias("i"))))

    def of(r):
        same = lambda k: (r[k]["a"] == r[k - 1]["a"]) & (r[k]["b"] == r[k - 1]["b"]) & (r[k]["c"] == r[k - 1]["c"])
        pairs = F.filter(F.sequence(F.lit(1), F.size(r) - 1), same)
        return F.array_sort(F.array_distinct(F.concat(F.transform(pairs, lambda k: r[k]["i"]), F.transform(pairs, lambda k: r[k - 1]["i"]))))

    return bound(rows, of)


def covered(places: Column) -> Column:
    """Words that 3-word windows at these ascending places cover."""
    gaps = F.aggregate(F.sequence(F.lit(1), F.size(places) - 1), F.lit(0), lambda a, k: a + F.least(F.lit(3), places[k] - places[k - 1]))
    return F.when(F.size(places) == 0, 0).when(F.size(places) == 1, 3).otherwise(gaps + 3).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that rules look at, for every row of ``docs``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    step = docs.select("doc_id", words(F.col("text")).alias("w"), lines.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    step = step.withColumn("again", windows_found_again(F.col("w")))
    w, line = F.col("w"), F.col("l")
    return step.select(
        "doc_id",
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        "n_symbols",
        (F.size(line) - F.size(F.array_distinct(line))).cast("long").alias("n_dup_lines"),
        covered(F.col("again")).alias("n_repeat_words"),
        F.size(line).cast("long").alias("n_lines"),
        F.size(F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)))).cast("long").alias("n_upper"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.size(F.filter(w, lambda x: x.rlike(PLAIN))).cast("long").alias("n_plain"),
    )


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes of each rule on a row of ``features``: 1 good, -1 bad, 0 abstains."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.col
    lines = F.greatest(c("n_lines"), F.lit(1))
    return {
        "symbols": vote(c("n_symbols") > 0.25 * n, c("n_symbols") < 0.02 * n),
        "repeats": vote(c("n_repeat_words") > 0.3 * n, c("n_repeat_words") < 0.1 * n),
        "dup_lines": vote(c("n_dup_lines") > 0.3 * lines, (c("n_dup_lines") == 0) & (c("n_lines") > 1)),
        "capitals": vote(c("n_upper") > 0.4 * n, c("n_upper") < 0.1 * n),
        "plain_words": vote(c("n_plain") < 0.6 * n, c("n_plain") > 0.9 * n),
        "variety": vote((c("n_distinct") < 0.25 * n) & (n >= 50) & (n < 2000), (c("n_distinct") > 0.5 * n) & (n >= 50)),
        "word_length": vote((c("word_chars") < 2.0 * n) | (c("word_chars") > 16.0 * n), (c("word_chars") >= 3.0 * n) & (c("word_chars") <= 10.0 * n)),
        "length": vote(n < 20, n >= 80),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[list[float]], list[float]]:
    """Share of good documents; for good and bad ones, the chance that a vote cast by each rule is bad; and for each
    pattern the probability of being good. Abstaining tells nothing.

    ``patterns``: vote patterns and their counts, a list that the number of rules bounds.
    """
    k = len(patterns[0][0]) if patterns else 0
    share, chances = START_GOOD, [[c] * k for c in START_BAD_VOTES]
    good = [START_GOOD] * len(patterns)
    for _ in range(rounds if patterns else 0):
        mass = [SMOOTHING * START_GOOD, SMOOTHING * (1 - START_GOOD)]
        bad, cast = [[SMOOTHING * c] * k for c in START_BAD_VOTES], [[SMOOTHING] * k for _ in START_BAD_VOTES]
        for at, (votes, count) in enumerate(patterns):
            good[at] = probability(share, chances, votes)
            for c, x in enumerate((good[at] * count, (1 - good[at]) * count)):
                mass[c] += x
                for j, v in enumerate(votes):
                    if v:
                        cast[c][j] += x
                        bad[c][j] += x * (v < 0)
        share = mass[0] / sum(mass)
        chances = [[b / n for b, n in zip(*rows)] for rows in zip(bad, cast)]
    return share, chances, [probability(share, chances, votes) for votes, _ in patterns]


def probability(share: float, chances: list[list[float]], votes: tuple[int, ...]) -> float:
    """Of being good, given the votes."""
    odds = math.log(share / (1 - share)) + sum(math.log(g / b) if v < 0 else math.log((1 - g) / (1 - b)) for g, b, v in zip(*chances, votes) if v)
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def alike(patterns: list[tuple[tuple[int, ...], int]], good: list[float]) -> list[list[int]]:
    """Rules in groups: two are together if their votes correlate by ``ALIKE`` or more within a class, over documents
    on which both vote, and each votes bad there on at least one document."""
    k = len(patterns[0][0]) if patterns else 0
    group = list(range(k))
    for i in range(k):
        for j in range(i):
            for side in (0, 1):
                n = a = b = both = 0.0
                for (votes, count), p in zip(patterns, good):
                    if votes[i] and votes[j]:
                        x = count * (1 - p if side else p)
                        n, a, b, both = n + x, a + x * (votes[i] < 0), b + x * (votes[j] < 0), both + x * (votes[i] < 0 and votes[j] < 0)
                spread = a * (n - a) * b * (n - b)
                if min(a, b, n - a, n - b) >= 1 and n * both - a * b >= ALIKE * math.sqrt(spread):
                    group = [group[i] if g == group[j] else g for g in group]
    return [[j for j in range(k) if group[j] == g] for g in sorted(set(group))]


def merged(votes: tuple[int, ...], groups: list[list[int]]) -> tuple[int, ...]:
    """One vote of each group: what more of its rules say, none on a draw."""
    sums = [sum(votes[j] for j in own) for own in groups]
    return tuple((x > 0) - (x < 0) for x in sums)


def posterior(share: float, chances: list[list[float]], votes: list[Column]) -> Column:
    """``probability`` as a column."""
    odds = F.lit(math.log(share / (1 - share)))
    for g, b, v in zip(*chances, votes):
        odds = odds + F.when(v > 0, math.log((1 - g) / (1 - b))).when(v < 0, math.log(g / b)).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the posterior probability of being good (0 if the base failed)."""
    work = Work(docs.sparkSession, "rules")
    counts = work.cut(features(docs), "features")  # a few numbers a document
    votes, failed = rules(), (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    table = counts.where(~failed).groupBy(*(v.alias(name) for name, v in votes.items())).count().collect()  # at most 3 ** rules rows
    patterns = sorted((tuple(row[:-1]), row[-1]) for row in table)
    groups = alike(patterns, estimate(patterns)[2])
    again: dict[tuple[int, ...], int] = {}
    for own, count in patterns:
        again[merged(own, groups)] = again.get(merged(own, groups), 0) + count
    share, chances, _ = estimate(sorted(again.items()))
    counts = counts.select("*", *(v.alias(f"vote_{name}") for name, v in votes.items()))
    cast = [F.col(f"vote_{name}") for name in votes]
    voters = [F.signum(sum((cast[j] for j in own[1:]), cast[own[0]])) for own in groups]
    quality = F.when(failed, 0.0).otherwise(posterior(share, chances, voters))
    out = counts.select("doc_id", *FEATURES[:5], failed.alias("base_failed"), quality.alias("quality"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM))
