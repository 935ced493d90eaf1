"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle set gives two values of its signature, the least and the greatest, so a
signature takes half as many hash evaluations. Bands of ``depth`` minima and as many maxima pick candidates: two
documents above the threshold share no band with a chance of (1 - t ** (2 depth)) ** bands, below one in a million
at the settings used. Candidates are then confirmed on full sets, so no link is wrong.

Documents of one set are one class from the start. Every class meets the least class of each of its buckets, which
groups candidates; within a group all pairs are compared, in blocks: a group is dealt by hash into chunks of about
``CHUNK`` classes, and each pair of chunks is a task's work, by products of membership matrices. A block passes on a
spanning forest of its links, never all pairs. So a group of thousands of near copies is spread over many tasks, and
no link that candidates hold is lost.

A null, empty or blank text has no shingles and no links. Repeated rows are copies; an empty table gives no rows.
Rows with a null identifier are kept and linked with nothing.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.common import Work, over_batches
from tarnworks.llm.components import connected_components
from tarnworks.llm.shingles import shingle_sets

BANDS, CHUNK, SLICE = 32, 96, 4096
#: Shingles that are hashed at a time.
PART = 1 << 12


def multipliers(count: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(shingles: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of the set under each permutation."""
    least, most = np.full(len(factors), 2**64 - 1, dtype=np.uint64), np.zeros(len(factors), dtype=np.uint64)
    for start in range(0, len(shingles), PART):
        values = shingles[None, start : start + PART] * factors[:, None]
        np.minimum(least, values.min(1), out=least)
        np.maximum(most, values.max(1), out=most)
    return least, most


def band_hashes(shingles: np.ndarray, factors: np.ndarray, bands: int) -> list[int]:
    least, most = (x.reshape(bands, -1) for x in signature(shingles, factors))
    joined = np.concatenate([least, most], axis=1)
    return [xxhash.xxh3_64_intdigest(row.tobytes(), seed=b) - (1 << 63) for b, row in enumerate(joined)]


def signed(docs: DataFrame, k: int, depth: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, key (of the set; null if empty) and bands of each row."""
    factors = multipliers(depth * bands)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, s in zip(batch["doc_id"], shingle_sets(batch["text"], k)):
                linked = len(s) and doc_id is not None
                rows.append((doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()) if linked else None, band_hashes(s, factors, bands) if linked else None))
            yield dict(zip(("doc_id", "n_shingles", "key", "bands"), zip(*rows)))

    return over_batches(docs.select("doc_id", "text"), run, "doc_id long, n_shingles long, key binary, bands array<long>")


def forest(sets: list[np.ndarray], most: int, whole: int) -> list[tuple[int, int]]:
    """Links that span the components of these sets; linked: whole * intersection >= most * union."""
    n, sizes = len(sets), np.array([len(s) for s in sets], dtype=np.int64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    shared = np.bincount(column)[column] > 1
    owner, (_, column) = owner[shared], np.unique(column[shared], return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n, n), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, SLICE):
        a, b = np.searchsorted(column, [start, start + SLICE])
        member = np.zeros((n, SLICE), dtype=np.float32)
        member[owner[a:b], column[a:b] - start] = 1
        common += member @ member.T
    common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    linked = np.triu(whole * common >= most * union, 1)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    out = []
    for i, j in zip(*np.nonzero(linked)):
        a, b = root(int(i)), root(int(j))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(i), int(j)))
    return out


def confirmed(docs: DataFrame, groups: DataFrame, work: Work, k: int, most: int, whole: int) -> DataFrame:
    """Links (a, b) between the documents of each group (id, component), spanning what is linked within it."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("m")).where(F.col("m") > CHUNK)
    large = work.cut(sizes, "large_groups")
    chunks = F.coalesce(F.ceil(F.col("m") / CHUNK), F.lit(1)).cast("int")
    dealt = groups.join(large, "component", "left").withColumn("g", chunks).withColumn("c", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    dealt = work.cut(dealt.select("id", "component", "g", "c"), "dealt")
    texts = docs.select(F.col("doc_id").alias("id"), "text").hint("merge").join(dealt, "id")

    def sets(batches):
        for batch in batches:
            batch["shingles"] = [s.tobytes() for s in shingle_sets(batch["text"], k)]
            yield batch[["id", "component", "g", "c", "shingles"]]

    members = texts.mapInPandas(sets, "id long, component long, g int, c int, shingles binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(F.least("c", j).alias("i"), F.greatest("c", j).alias("j")))
    blocks = members.withColumn("block", F.explode(pairs)).select("component", "block.i", "block.j", "id", "shingles")

    def rows(batches):
        for batch in batches:
            yield from batch.itertuples(index=False, name=None)

    def compare(batches):
        found = []
        for _, own in groupby(rows(batches), key=lambda r: r[:3]):
            ids, held = [], []
            for *_, doc_id, data in own:
                ids.append(doc_id)
                held.append(np.frombuffer(data, dtype=np.uint64))
            found += [(ids[i], ids[j]) for i, j in forest(held, most, whole) if ids[i] != ids[j]]
            if len(found) >= 10_000:
                yield pd.DataFrame(found, columns=["a", "b"])
                found = []
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])

    placed = blocks.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "id")
    return placed.mapInPandas(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, most: int = 80, whole: int = 100, depth: int = 2, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``; linked from most / whole on."""
    work = Work(docs.sparkSession, "minhash")
    rows = work.cut(signed(docs, k, depth, bands), "signed")
    classes = work.cut(rows.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")), "classes")
    buckets = classes.select("id", F.explode("bands").alias("bucket"))
    shared = work.cut(buckets.groupBy("bucket").agg(F.min("id").alias("lead"), F.count("*").alias("n")).where("n > 1").select("bucket", "lead"), "buckets")
    candidates = work.cut(buckets.join(shared, "bucket").where("id != lead").select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), "candidates")
    groups = work.cut(connected_components(candidates, work), "groups")
    links = work.cut(confirmed(docs, groups, work, k, most, whole), "links")
    parts = connected_components(links, work)
    known = classes.select("key", "id").join(parts, "id", "left").select("key", F.coalesce("component", "id").alias("component_id"))
    known = work.cut(known, "known")
    out = rows.select("doc_id", "n_shingles", "key").join(known, "key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, most: int = 80, whole: int = 100, depth: int = 2, bands: int = BANDS) -> DataFrame:
    """Rows of ``docs`` but for near duplicates: the document of least identifier of each group stays, once."""
    kept = near_duplicates(docs, k, most, whole, depth, bands).where("kept and doc_id is not null").select("doc_id").distinct()
    first = docs.hint("merge").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return first.select(docs.columns).unionByName(docs.where("doc_id is null"))
