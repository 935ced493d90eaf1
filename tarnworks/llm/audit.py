"""How quality filters interact: for every order of five filters, what each removes, and what only it removes.

Four filters look at a text alone; the fifth, that a smaller identifier has the same text, needs the whole table. Rows
go as an RDD to partitions by the xxhash of their text. A partition keeps, for each hash, a chain of the different
full texts with the smallest identifier of each, so that texts whose hashes collide stay apart; rows of any other
identifier are emitted as repeats. Before rows are sent, a task does the same among up to ``HELD`` characters of
texts: only the smallest of them travels with its text, so a text that a third of all rows have leaves each task once
in a while.

Which filters a row fails is a mask of five bits. ``combineByKey`` adds up, for each part, a vector of counts by mask
(rows, good and toxic ones); all figures follow from its 96 numbers.

Results: a null text is an empty one, a null language is the part of the empty string. A null identifier is smaller
than none and repeats none. Rows of one identifier and text aren't each other's repeats. Labels of several rows for a
document hold if one says so; those of a null identifier belong to no document. Texts of any length are read whole.
Further columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.common import words

FILTERS = "ABCDE"
#: Characters of texts that a task compares before it sends rows, and bytes of texts in a partition.
HELD, PARTITION = 1 << 24, 1 << 25
COPY = 1 << FILTERS.index("E")
COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    own = words(text)
    fails = (
        F.size(own) < 200,
        100 * F.size(F.array_distinct(own)) < 50 * F.size(own),
        100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0)).cast("int")


class Chains:
    """By hash, the different texts met, each with its smallest identifier and the rows that have it."""

    def __init__(self):
        self.held: dict[int, list[list]] = {}

    def add(self, digest: int, text: str, doc_id: int, rows: Counter) -> tuple[int, Counter]:
        """Rows that this one shows to be repeats, and their identifier."""
        chain = self.held.setdefault(digest, [])
        for entry in chain:
            if entry[0] == text:
                if doc_id == entry[1]:
                    entry[2].update(rows)
                    return doc_id, Counter()
                if doc_id > entry[1]:
                    return doc_id, rows
                known = entry[1:]
                entry[1:] = [doc_id, rows]
                return known[0], known[1]
        chain.append([text, doc_id, rows])
        return doc_id, Counter()

    def rows(self):
        for digest, chain in self.held.items():
            for text, doc_id, rows in chain:
                yield digest, (text, doc_id, rows)


def settled(doc_id: int | None, rows: Counter, copy: int):
    return ((doc_id, part, mask | copy, n) for (part, mask), n in rows.items())


def before_sending(rows):
    """(hash, (text, identifier, rows)) of the smallest of each text of a task, and (None, settled row) of the others."""
    chains, size = Chains(), 0
    for digest, text, doc_id, part, mask in rows:
        own = Counter({(part, mask): 1})
        if doc_id is None:
            yield from ((None, r) for r in settled(None, own, 0))
            continue
        yield from ((None, r) for r in settled(*chains.add(digest, text, doc_id, own), COPY))
        size += len(text) + 64
        if size >= HELD:
            yield from chains.rows()
            chains, size = Chains(), 0
    yield from chains.rows()


def smallest(records):
    """Rows of a partition with all bits, once its chains are complete."""
    chains = Chains()
    for digest, own in records:
        yield from settled(*chains.add(digest, *own), COPY)
    for _, (_, doc_id, rows) in chains.rows():
        yield from settled(doc_id, rows, 0)


def masks(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask and number n of rows; all rows of ``docs`` are counted once."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(text.alias("text"), "doc_id", F.coalesce("lang", F.lit("")).alias("part"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(spark.sparkContext.defaultParallelism, 1 + size // PARTITION)
    flagged = rows.select(F.xxhash64("text"), "text", F.col("doc_id").cast("long"), "part", failures(F.col("text")))
    sent = flagged.rdd.mapPartitions(before_sending)
    routed = sent.filter(lambda r: r[0] is not None).partitionBy(count, lambda digest: digest).mapPartitions(smallest)
    known = sent.filter(lambda r: r[0] is None).map(lambda r: r[1])
    return spark.createDataFrame(known.union(routed), "doc_id long, part string, mask int, n long")


def counted(row) -> list[int]:
    vector = [0] * (3 * 2 ** len(FILTERS))
    return added(vector, row)


def added(vector: list[int], row) -> list[int]:
    mask, n, good, toxic = row
    vector[3 * mask] += n
    vector[3 * mask + 1] += n * good
    vector[3 * mask + 2] += n * toxic
    return vector


def merged(a: list[int], b: list[int]) -> list[int]:
    return [x + y for x, y in zip(a, b)]


def figures(part: str, vector: list[int]):
    """A row for each order and step, from the counts by mask."""
    n, good, toxic = vector[0::3], vector[1::3], vector[2::3]
    bits = {f: 1 << k for k, f in enumerate(FILTERS)}
    rows, shapley = [], Counter()
    for order in permutations(FILTERS):
        seen = 0
        for step, f in enumerate(order, 1):
            here = [m for m in range(len(n)) if m & bits[f] and not m & seen]
            removed = sum(n[m] for m in here)
            redundant = sum(n[m] for m in range(len(n)) if m & bits[f] and m & seen)
            seen |= bits[f]
            kept = sum(n[m] for m in range(len(n)) if not m & seen)
            shapley[f] += removed
            rows.append((f, ("".join(order), step, kept, removed, redundant, n[bits[f]], sum(good[m] for m in here), sum(toxic[m] for m in here))))
    return [(part, *row, shapley[f]) for f, row in rows]


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Figures of each part, order and step over all rows of ``docs``."""
    spark = docs.sparkSession
    flag = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    met = masks(docs).join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    vectors = met.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(counted, added, merged)
    return spark.createDataFrame(vectors.flatMap(lambda r: figures(*r)), COLUMNS)


INTERACTIONS_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
counts AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
flags AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM counts),
known AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
masks AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM flags LEFT JOIN known USING (doc_id) GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, k::INT AS step, filter_order[k] AS f, '[' || filter_order[1:k] || ']' AS upto, '[' || filter_order[1:k - 1] || '.]' AS seen FROM orders, range(1, 6) t(k)),
told AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS own, fails = f AS only_own, regexp_matches(fails, upto) AS gone, regexp_matches(fails, seen) AS earlier
  FROM masks, steps),
figures AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT earlier), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (own AND earlier), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (own AND NOT earlier), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT earlier), 0)::BIGINT AS toxic_lost
  FROM told GROUP BY part, filter_order, step, f)
SELECT * EXCLUDE f, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM figures
"""
