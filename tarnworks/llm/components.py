"""Connected components of an edge table, by large and small stars.

A large star ties every greater neighbour of a node to the least of its neighbours; a small star ties the lesser
ones. In turn they flatten each component into a star around its least node in a logarithmic number of rounds. Each
step is a minimum by key, which tasks combine before the shuffle, and a join with that minimum, which Spark splits
where a node has very many edges; no step gathers a node's edges or a component in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnworks.llm.common import Work


def connected_components(edges: DataFrame, work: Work) -> DataFrame:
    """id, component (the least identifier of its component) for every node of ``edges`` (a, b), a table of ``work``."""
    table, seen, started = edges, None, False
    while True:
        both = table.union(table.select("b", "a")).toDF("u", "v") if started else edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
        least = work.cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = work.cut(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large")
        lesser = work.cut(large.groupBy("u").agg(F.min("v").alias("m")), "lesser")
        tied = large.join(lesser, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        small = work.cut(tied.union(lesser.select("u", "m")).toDF("a", "b").distinct(), "small")
        if started:
            work.drop(table)
        work.drop(least, large, lesser)
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        table, started = small, True
        if now == seen or now[0] == 0:
            break
        seen = now
    return table.select(F.col("a").alias("id"), F.col("b").alias("component")).union(table.select("b", "b").distinct())
