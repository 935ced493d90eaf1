"""Mixing sources to target weights by pivotal rounding, in DataFrame functions alone.

A source's target divided by its size gives each of its documents a number of copies: a whole part, the same for
all, and a fraction. Fractions are rounded in duels. Two documents meet; words move at random from one fraction
to the other until one is 0 or 1; it is settled and the other meets the next. A duel keeps the words that the
two stand for, and each fraction's expectation, so a source misses its target by less than one document.

Duels run within blocks of about 64 documents, in one task each; what is left of a block, one document at most,
meets what is left of 63 other blocks, and so on up a tree. No task sees more than a block, however large a source.
Choices come from hashes of identifiers, so reruns agree.

Rows of one (source, doc_id, size) are settled one by one: their fractions add up to a number of whole copies, which
as many of them take, and one fraction, which one of them brings to the duels. Documents without words, and sources
without any, take nothing. A null source is one of its own, last in order; a null text has no words; texts of any
length count whole; an empty table gives no rows. Other columns, whatever their names, pass through ``mixed``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.llm.common import Work, bound, n_words

WEIGHTS = (1, 2, 3)
MOST = 3
BLOCK = 64
UNIT = "struct<doc_id:bigint,size:bigint,copies:bigint,up:bigint,x:double>"
#: Rows of a repeated unit that are made together; a unit's rows are numbered in the square of ``PARTS`` parts at most.
TOGETHER, PARTS = 4096, 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """k (rank by code point, null last), source, source_size, target, n: a row for each source.

    Targets share the size of all sources by weight. Ascending by how soon they are full, sources fill up to
    ``most`` times their size as long as the level, what is left over the weights left, lies above them.
    """
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rows = rows.withColumn("k", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("k") - 1) % len(weights) + 1)
    rows = rows.withColumn("weight", weight.cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "k")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("left", F.sum(F.col("source_size")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", F.col("left") / F.sum("weight").over(onward))
    rows = rows.withColumn("full", F.col("cap") / F.col("weight") <= F.col("level"))
    level = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(everything)
    return rows.select("k", "source", "source_size", "n", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")).alias("target"))


def chance(*parts: Column) -> Column:
    """A number from 0 up to 1 by hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def duel(state: Column, unit: Column, level: int) -> Column:
    """The state after ``unit`` met the state's open document: settled documents, and the open one or null."""
    a, b = state["open"], unit
    room = lambda u: u["size"] * (1 - u["x"])
    held = lambda u: u["size"] * u["x"]
    with_x = lambda u, x: F.struct(u["doc_id"].alias("doc_id"), u["size"].alias("size"), u["copies"].alias("copies"), u["up"].alias("up"), x.cast("double").alias("x")).cast(UNIT)

    def moved(d):
        # to a: a fills up or b runs out; to b: the other way round
        to_a = chance(a["doc_id"], a["size"], b["doc_id"], b["size"], F.lit(level)) * (d["to_a"] + d["to_b"]) < d["to_b"]
        size_a, size_b = a["size"], b["size"]
        xa = F.when(to_a, F.when(room(a) <= held(b), 1.0).otherwise(a["x"] + d["to_a"] / size_a)).otherwise(F.when(held(a) <= room(b), 0.0).otherwise(a["x"] - d["to_b"] / size_a))
        xb = F.when(to_a, F.when(held(b) <= room(a), 0.0).otherwise(b["x"] - d["to_a"] / size_b)).otherwise(F.when(room(b) <= held(a), 1.0).otherwise(b["x"] + d["to_b"] / size_b))
        return F.struct(xa.alias("a"), xb.alias("b"))

    def after(x):
        settled = lambda v: (v <= 0) | (v >= 1)
        ua, ub = with_x(a, x["a"]), with_x(b, x["b"])
        done = F.concat(state["done"], F.when(settled(x["a"]) & settled(x["b"]), F.array(ua, ub)).when(settled(x["a"]), F.array(ua)).otherwise(F.array(ub)))
        left = F.when(~settled(x["a"]), ua).when(~settled(x["b"]), ub).otherwise(F.lit(None).cast(UNIT))
        return F.struct(done.alias("done"), left.alias("open"))

    most = F.struct(F.least(room(a), held(b)).alias("to_a"), F.least(held(a), room(b)).alias("to_b"))
    met = bound(bound(most, moved), after)
    return F.when(a.isNull(), F.struct(state["done"].alias("done"), unit.alias("open"))).otherwise(met).cast(f"struct<done:array<{UNIT}>,open:{UNIT}>")


def settle(units: Column, level: int) -> Column:
    start = F.struct(F.array().cast(f"array<{UNIT}>").alias("done"), F.lit(None).cast(UNIT).alias("open"))
    return F.aggregate(units, start, lambda state, unit: duel(state, unit, level))


def settled_units(sizes: DataFrame, work: Work, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, k, source_size, target, doc_id, size, copies, whole, more: a row for each (source, doc_id, size).

    All of its ``copies`` rows are taken ``whole`` times, and ``more`` of them once more.
    """
    sources = work.cut(source_targets(sizes, weights, most).coalesce(1), "sources")
    most_documents = sources.agg(F.max("n")).first()[0] or 0
    units = sizes.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keys = ("k", "source", "source_size", "target", "whole")
    known = units.withColumnRenamed("source", "own").join(sources, F.col("own").eqNullSafe(F.col("source"))).withColumn("whole", F.floor(ratio))
    known = known.withColumn("all", F.when(F.col("size") > 0, F.col("copies") * (ratio - F.col("whole"))).otherwise(0.0)).withColumn("up", F.floor("all"))
    known = known.withColumn("x", F.col("all") - F.col("up"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK))
    known = known.select(*keys, F.pmod(F.xxhash64("doc_id", "size"), blocks).alias("block"), F.struct("doc_id", "size", "copies", "up", "x").cast(UNIT).alias("u"))
    known = work.cut(known, "units")
    out = [known.where("u.x = 0").select(*keys, "u")]
    level, open_units, left = 0, known.where("u.x > 0"), max(1, math.ceil(most_documents / BLOCK))
    while True:
        grouped = open_units.groupBy(*keys, "block").agg(F.array_sort(F.collect_list("u")).alias("units"))
        table = work.cut(grouped.select(*keys, "block", settle(F.col("units"), level).alias("s")), f"level{level}")
        out.append(table.select(*keys, F.explode("s.done").alias("u")))
        rest = table.where("s.open is not null").select(*keys, "block", F.col("s.open").alias("u"))
        if left == 1:
            break
        open_units, left, level = rest.withColumn("block", F.floor(F.col("block") / BLOCK)), math.ceil(left / BLOCK), level + 1
    last = F.when(chance(F.col("u.doc_id"), F.lit("last")) < F.col("u.x"), 1.0).otherwise(0.0)
    rows = rest.select(*keys, F.struct("u.doc_id", "u.size", "u.copies", "u.up", last.alias("x")).cast(UNIT).alias("u"))
    for part in out:
        rows = rows.unionByName(part)
    return rows.select(*keys, "u.doc_id", "u.size", "u.copies", (F.col("u.up") + F.col("u.x").cast("long")).alias("more"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs`` (doc_id, source, text)."""
    work = Work(docs.sparkSession, "mixing")
    sizes = work.cut(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    units = settled_units(sizes, work, weights, most)
    single = units.where("copies = 1").withColumn("nth", F.lit(0).cast("long"))
    many = units.where("copies > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / TOGETHER))))
    many = many.repartition("doc_id", "size", "part")  # a unit of very many rows is made by many tasks
    upto = F.least(F.col("copies"), (F.col("part") + 1) * TOGETHER) - 1
    many = many.withColumn("nth", F.explode(F.sequence(F.col("part") * TOGETHER, upto))).drop("part")
    taken = F.col("size") * (F.col("whole") + (F.col("nth") < F.col("more")).cast("long"))
    return single.unionByName(many).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Rows of ``docs``, each as often as the mix takes it, with all their columns.

    Where several rows share source, identifier and size, those that come first by a hash of the text are taken once
    more. They are numbered in parts by that hash and by their place in a written table, so no task sees all of them.
    """
    work = Work(docs.sparkSession, "mixed")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row).select("row", F.col("row.source").alias("source"), F.col("row.doc_id").alias("doc_id"), n_words(F.col("row.text")).alias("size"))
    sizes = work.cut(rows.select("doc_id", "source", "size"), "sizes")
    units = work.cut(settled_units(sizes, work, weights, most).select(F.col("source").alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z"), "copies", "whole", "more"), "units")
    same = F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    single = rows.join(units.where("copies = 1 and whole + more > 0"), same).select("row", (F.col("whole") + F.col("more")).alias("times"))
    many = rows.join(work.cut(units.where("copies > 1"), "repeated"), same)  # written, so that Spark knows its size and moves few rows
    by_text, by_place = F.pmod(F.xxhash64("row.text"), F.lit(PARTS)).alias("by_text"), F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).alias("by_place")
    many = work.cut(many.select("row", "s", "d", "z", "whole", "more", by_text, by_place), "many")
    unit, part = ("s", "d", "z"), ("by_text", "by_place")
    before = Window.partitionBy(*unit).orderBy(*part).rowsBetween(Window.unboundedPreceding, -1)
    parts = many.groupBy(*unit, *part).agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.select(*(F.col(c).alias(f"p_{c}") for c in (*unit, *part)), "before")
    own = F.col("s").eqNullSafe(F.col("p_s")) & F.col("d").eqNullSafe(F.col("p_d"))
    for c in ("z", *part):
        own = own & (F.col(c) == F.col(f"p_{c}"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy(*unit, *part).orderBy(F.xxhash64("row.text")))
    times = F.col("whole") + (F.col("nth") <= F.col("more")).cast("long")
    many = many.join(parts, own).withColumn("nth", nth).select("row", times.alias("times"))
    taken = single.unionByName(many).where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return taken.select("row").select("row.*")
