"""Merkle manifest of a table: leaves, roots and proofs, collapsed in blocks by higher-order SQL functions.

A row is a leaf. Leaves of one source are numbered in order and dealt into blocks of ``FAN`` to the ``LEVELS``; each
block is one array, which ``sequence``, ``transform`` and ``slice`` collapse level by level. Roots of blocks are again
nodes that are numbered, so the same step recurs until each source has one root, and once more over the sources'
roots. A source of any size is many blocks; no task holds more than one block's array at a time, and numbering needs no
window: rows are sorted by range, and a row's number is its place in its partition and the partition's first number.

Going down, each node's siblings follow from its block's levels, and those of the block itself are appended. What a
row's path holds is thus two digests a level.

Results: nulls count as ``-``. Null identifiers come first among a source's leaves and are never tampered with; rows
of one identifier are ordered by their leaves. A null source is the first source. A lone leaf is its own root and has
no siblings (their digest is that of nothing). Texts of any length are hashed whole. Further columns are ignored, an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.common import Work, bound

FAN, LEVELS = 3, 6


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(encoded(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), encoded(text)), 256)


def numbered(nodes: DataFrame, group: str, order: list[str], work: Work, label: str) -> DataFrame:
    """``nodes`` with ``i``, from 0 within each group in the given order, and ``n``, the size of the group."""
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    sorted_ = nodes.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    rows = work.cut(sorted_, f"{label}_sorted")
    part = F.shiftright("at", 33).alias("part")
    # one row for each partition and group in it
    parts = rows.groupBy(group, part).agg(F.min("at").alias("first"), F.count("*").alias("size"))
    whole = parts.groupBy(F.col(group).alias("g")).agg(F.sum("size").alias("n"), F.collect_list(F.struct("part", "size")).alias("own"))
    before = F.aggregate(F.filter("own", lambda p: p["part"] < F.col("part")), F.lit(0).cast("long"), lambda a, p: a + p["size"])
    starts = parts.join(whole, F.col(group).eqNullSafe(F.col("g"))).select(F.col(group).alias("g"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), "n")
    starts = work.cut(starts, f"{label}_starts")
    met = rows.join(starts, rows[group].eqNullSafe(starts["g"]) & (F.shiftright("at", 33) == F.col("p")))
    return met.select(*nodes.columns, (F.col("at") + F.col("shift")).alias("i"), "n")


def collapse(nodes: Column) -> Column:
    """Digests of every ``FAN`` consecutive nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(nodes, k * FAN + 1, FAN), "").cast("binary"), 256))


def levels(nodes: Column, whole: Column) -> Column:
    """Arrays of a block's nodes, level by level, up to its root: ``LEVELS`` times if the group has further blocks."""
    step = lambda held, _: F.when(whole & (F.size(F.element_at(held, -1)) == 1), held).otherwise(F.concat(held, F.array(collapse(F.element_at(held, -1)))))
    return F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.array(nodes), step)


def siblings(held: Column, place: Column) -> Column:
    """For each level, what stands left and right of the node over ``place`` in its run."""

    def at(level: Column) -> Column:
        width = F.element_at(F.array(*(F.lit(FAN**k) for k in range(LEVELS + 1))), level)
        return bound(F.floor(place / width).cast("int"), lambda own: F.struct(
            F.array_join(F.slice(held[level - 1], own - own % FAN + 1, own % FAN), "").alias("l"),
            F.array_join(F.slice(held[level - 1], own + 2, FAN - 1 - own % FAN), "").alias("r"),
        ))

    top = F.size(held) - 1
    return F.when(top > 0, F.transform(F.sequence(F.lit(1), F.greatest(top, F.lit(1))), at)).otherwise(F.array().cast("array<struct<l:string,r:string>>"))


def tree(nodes: DataFrame, group: str, work: Work, label: str) -> tuple[DataFrame, DataFrame]:
    """Roots (group, root), and ``nodes`` with ``path``, their siblings up to the root, level by level.

    ``nodes`` has the group, ``i``, ``n``, ``node`` and further columns.
    """
    block = FAN**LEVELS
    more = [c for c in nodes.columns if c not in (group, "i", "n")]
    held = nodes.groupBy(group, F.floor(F.col("i") / block).alias("b"), "n").agg(F.array_sort(F.collect_list(F.struct("i", *more))).alias("own"))
    held = work.cut(held.withColumn("levels", levels(F.transform("own", lambda x: x["node"]), F.col("n") <= block)), f"{label}_blocks")
    tops = held.select(group, F.col("b").alias("i"), F.ceil(F.col("n") / block).alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
    if held.where(F.col("n") > block).isEmpty():
        roots = tops.select(group, F.col("node").alias("root"))
        above = held.withColumn("above", F.array().cast("array<struct<l:string,r:string>>"))
    else:
        roots, upper = tree(tops, group, work, f"{label}_up")
        upper = upper.select(F.col(group).alias("g"), F.col("i").alias("at"), F.col("path").alias("above"))
        above = held.join(upper, F.col(group).eqNullSafe(F.col("g")) & (F.col("b") == F.col("at")))
    rows = above.select(group, "n", "levels", "above", F.explode("own").alias("x"))
    path = F.concat(siblings(F.col("levels"), (F.col("x.i") % block).cast("int")), F.col("above"))
    return roots, rows.select(group, "n", "x.i", *(F.col("x")[c].alias(c) for c in more), path.alias("path"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``."""
    work = Work(docs.sparkSession, "merkle")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(tampered & F.contains("text", F.lit("\n")), leaf(F.translate("text", "\n", "")))
    leaves = docs.select("doc_id", "source", leaf(F.col("text")).alias("node"), changed.alias("changed"))
    own, paths = tree(numbered(leaves, "source", ["doc_id", "node"], work, "leaves"), "source", work, "leaves")
    own = own.withColumnRenamed("root", "node").withColumn("all", F.lit(True))
    roots, upper = tree(numbered(own, "all", ["source"], work, "sources"), "all", work, "sources")
    top = upper.join(roots, "all").select(F.col("source").alias("s"), F.col("node").alias("subroot"), "root", F.col("path").alias("above"))
    met = paths.join(top, F.col("source").eqNullSafe(F.col("s"))).withColumn("path", F.concat("path", "above"))
    folded = F.aggregate("path", F.coalesce("changed", "node"), lambda a, s: F.sha2(F.concat(s["l"], a, s["r"]).cast("binary"), 256))
    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["l"], s["r"])), "").cast("binary"), 256)
    out = met.select("doc_id", F.col("node").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same rows by recursion over whole levels; the checksum is computed bit by bit.
MANIFEST_SQL = """
WITH RECURSIVE fields AS (
  SELECT doc_id, source, text, concat_ws('',
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END,
    CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
    CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END,
    CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END) AS head,
    list_reduce(list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))) AS crc
  FROM documents),
leaves AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i,
    sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') END) END AS changed
  FROM fields),
low AS (
  SELECT source, 0 AS lv, i, leaf AS node FROM leaves
  UNION ALL
  SELECT source, lv + 1, i // 3, sha256(string_agg(node, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM low) WHERE n > 1 GROUP BY source, lv, i // 3),
subroots AS (
  SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i
  FROM (SELECT source, node FROM low QUALIFY lv = max(lv) OVER (PARTITION BY source))),
high AS (
  SELECT 0 AS lv, i, node FROM subroots
  UNION ALL
  SELECT lv + 1, i // 3, sha256(string_agg(node, '' ORDER BY i))
  FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY lv, i // 3),
way AS (
  SELECT doc_id, a.lv, n.i < a.place AS is_left, n.i AS place, n.node
  FROM (SELECT doc_id, leaves.source, low.lv, leaves.i // (3 ** low.lv)::BIGINT AS place FROM leaves JOIN low ON low.source IS NOT DISTINCT FROM leaves.source AND low.i = leaves.i // (3 ** low.lv)::BIGINT) a
  JOIN low n ON n.source IS NOT DISTINCT FROM a.source AND n.lv = a.lv AND n.i // 3 = a.place // 3 AND n.i != a.place
  UNION ALL
  SELECT doc_id, 1000 + a.lv, n.i < a.place, n.i, n.node
  FROM (SELECT doc_id, high.lv, s.i // (3 ** high.lv)::BIGINT AS place FROM leaves JOIN subroots s ON s.source IS NOT DISTINCT FROM leaves.source JOIN high ON high.i = s.i // (3 ** high.lv)::BIGINT) a
  JOIN high n ON n.lv = a.lv AND n.i // 3 = a.place // 3 AND n.i != a.place),
-- a run of one node has no siblings but is hashed, so levels come from the tree
steps AS (
  SELECT doc_id, lv, row_number() OVER (PARTITION BY doc_id ORDER BY lv) AS k
  FROM (SELECT doc_id, lv FROM leaves JOIN (SELECT DISTINCT source AS g, lv FROM low QUALIFY lv < max(lv) OVER (PARTITION BY source)) ON g IS NOT DISTINCT FROM source
    UNION ALL SELECT doc_id, 1000 + lv FROM leaves, (SELECT DISTINCT lv FROM high QUALIFY lv < max(lv) OVER ()))),
sides AS (
  SELECT s.doc_id, k, coalesce(string_agg(node, '' ORDER BY place) FILTER (is_left), '') AS l, coalesce(string_agg(node, '' ORDER BY place) FILTER (NOT is_left), '') AS r
  FROM steps s LEFT JOIN way w ON w.doc_id = s.doc_id AND w.lv = s.lv GROUP BY s.doc_id, k),
fold AS (
  SELECT doc_id, 0::BIGINT AS k, coalesce(changed, leaf) AS node FROM leaves
  UNION ALL
  SELECT f.doc_id, s.k, sha256(s.l || f.node || s.r) FROM fold f JOIN sides s ON s.doc_id = f.doc_id AND s.k = f.k + 1),
top AS (SELECT node AS root FROM high ORDER BY lv DESC LIMIT 1)
SELECT doc_id, leaf, s.node AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaves
JOIN subroots s ON s.source IS NOT DISTINCT FROM leaves.source
LEFT JOIN (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY k)) AS proof_sha256 FROM sides GROUP BY doc_id) USING (doc_id)
JOIN (SELECT doc_id, arg_max(node, k) AS folded_root FROM fold GROUP BY doc_id) USING (doc_id), top
"""
