"""Strongly connected components of large graphs, and a cycle of each as a path.

Nodes with one edge in and one out are passed over first: pointers double along them, so a chain of n nodes takes
log n rounds and becomes one edge, and rings without branches show up on the way. Nodes without a way in or out go.
What is left is coloured: each node takes the greatest node that reaches it; within a colour, what reaches that
node is its component. Both steps repeat on what has no component yet, until a bounded number of edges is left, which
one task walks. Nothing is collected; every other step is a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tarnworks.session import cut, cut_afresh, scratch

WALKED = 500_000  # edges left over that one task takes; rounds over so few would mostly plan and start jobs


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table: unlike a checkpoint, it is read by columns and packed, which pays where all nodes are in it."""
    at = scratch(df.sparkSession, "cycles")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def nearby(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, last, going, low, at, steps, shut of one task's rows of nodes that lead on (from, to, inner).

    Rings among the rows are shut, and chains whose last node is among them followed to it. Rows of others lead one step on.
    """
    rows = pa.Table.from_batches(parts).sort_by("from")
    names, inner, here = rows["from"], rows["inner"].to_numpy(), np.arange(len(rows))
    onward = pc.fill_null(pc.index_in(rows["to"], names.combine_chunks()), -1).to_numpy()
    going, shut = onward >= 0, np.zeros(len(rows), dtype=bool)
    last, low = np.where(going, onward, here), np.where(going, onward, len(rows))
    at, steps = np.ones(len(rows), dtype=np.int64), going.astype(np.int64)
    while going.any():
        least = np.zeros(len(rows) + 1, dtype=bool)
        least[here[going & (low == here)]] = True  # all nodes of a ring have met its least one when that one has met itself
        shut |= going & least[low]
        g = np.flatnonzero(going & ~shut)
        to = last[g]
        at[g] = np.where(low[to] < low[g], steps[g] + at[to], at[g])
        low[g], steps[g], last[g] = np.minimum(low[g], low[to]), steps[g] + steps[to], last[to]
        going[:] = False
        going[g] = (onward[last[g]] >= 0)
    far = ~shut & inner[last]
    told = {"node": names, "last": pc.if_else(pa.array(far), rows["to"], names.take(pa.array(last))), "going": far, "low": pc.if_else(pa.array(far), rows["to"], names.take(pa.array(low, mask=~shut)))}
    told |= {"at": pa.array(np.where(far, 1, at), mask=~shut & ~far), "steps": np.where(far, 1, steps), "shut": shut}
    yield from pa.table(told).to_batches()


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(node, own, steps) of the nodes with one edge in and one out, and the edges that lead out of them; None if there
    are none. ``own`` names the chain that a node lies in, ``steps`` are those to its last node.

    The least node of a ring isn't part of a chain: it stays, so that the ring becomes an edge from it to itself, and
    names the chain. It is known once a node is the least one on its way, so rings take as many rounds as chains of
    their length do, however many there are. Nodes are sorted over tasks first, and chains and rings of nodes that lie
    in one task take no round: where neighbours have neighbouring names, rounds are left with what crosses tasks.
    """
    side = lambda node, out: edges.select(F.col(node).alias("node"), F.lit(out).alias("out"), (F.col("from") == F.col("to")).alias("loop"), *(F.when(F.lit(out), F.col(c)).alias(c) for c in ("to", "level", "chain")))
    ends = side("from", True).unionByName(side("to", False)).groupBy("node")
    ends = ends.agg(F.count_if("out").alias("n_out"), F.count_if(~F.col("out")).alias("n_in"), F.bool_or("loop").alias("loop"), *(F.max(c).alias(c) for c in ("to", "level", "chain")))
    single = written(ends.where("n_out = 1 and n_in = 1 and not loop").select(F.col("node").alias("from"), "to", "level", "chain"))
    if single.isEmpty():
        return None
    onward = single.join(single.select(F.col("from").alias("to"), F.lit(True).alias("inner")), "to", "left")
    onward = written(onward.withColumn("inner", F.coalesce("inner", F.lit(False))))
    # the last node of a chain points to itself and goes no further; low is the least node ahead, at the steps to it
    node = edges.schema["from"].dataType.simpleString()
    sorted_rows = onward.select("from", "to", "inner").repartitionByRange("from")
    hops = written(sorted_rows.mapInArrow(nearby, f"node {node}, last {node}, going boolean, low {node}, at long, steps long, shut boolean"))
    done = [hops.where("shut and node != low").select("node", F.col("low").alias("own"), (F.col("at") - 1).alias("steps"))]
    hops = hops.where("not shut").drop("shut")
    while True:
        going, shut = hops.where("going").agg(F.count("*"), F.count_if(F.col("low") == F.col("node"))).first()
        if shut:  # all nodes of a ring have met its least one when that one has met itself
            least = hops.where("going and low = node").select("low", F.lit(True).alias("shut"))
            hops = cut_afresh(hops.join(least, "low", "left"))
            ring = hops.where("shut")
            done.append(ring.where("node != low").select("node", F.col("low").alias("own"), (F.col("at") - 1).alias("steps")))
            going, hops = going - ring.count(), hops.where("shut is null").drop("shut")
        if not going:
            break
        there = hops.select(F.col("node").alias("last"), F.col("last").alias("last2"), F.col("going").alias("going2"), F.col("low").alias("low2"), F.col("at").alias("at2"), F.col("steps").alias("steps2"))
        at = F.when(F.col("low2") < F.col("low"), F.col("steps") + F.col("at2")).otherwise(F.col("at"))
        moved = hops.where("going").join(there, "last").select("node", F.col("last2").alias("last"), F.col("going2").alias("going"), F.least("low", "low2").alias("low"), at.alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"))
        hops = cut_afresh(hops.where("not going").unionByName(moved))
    ends, out = hops.select("node", F.col("last").alias("own"), "steps"), onward.where("not inner")
    for ring in done:
        ends = ends.unionByName(ring)
        out = out.unionByName(onward.join(ring.where("steps = 0").select(F.col("node").alias("from")), "from", "left_semi"))
    return ends, out.select("from", "to", "level", "chain")


def walked(edges: pa.Table) -> pa.Table:
    """The ``edges`` whose ends lie in one component, with its name, by one depth-first walk (Gabow's)."""
    names = pc.unique(pa.chunked_array([*edges["from"].chunks, *edges["to"].chunks], edges["from"].type))
    a, b = (pc.index_in(edges[side], names).to_numpy() for side in ("from", "to"))
    order = np.argsort(a, kind="stable")
    onward, first = b[order].tolist(), np.searchsorted(a[order], np.arange(len(names) + 1)).tolist()
    met, own, at, count = [0] * len(names), [-1] * len(names), first[:-1], 0
    path, waiting, bounds = [], [], []  # nodes on the way, nodes without a component, first nodes of what may be one
    for root in range(len(names)):
        new = root if not met[root] else None
        while path or new is not None:
            if new is not None:
                met[new] = count = count + 1
                for held in (path, waiting, bounds):
                    held.append(new)
            node, new = path[-1], None
            if at[node] < first[node + 1]:
                to = onward[at[node]]
                at[node] += 1
                if not met[to]:
                    new = to
                elif own[to] < 0:
                    while met[bounds[-1]] > met[to]:
                        bounds.pop()
                continue
            path.pop()
            if bounds[-1] == node:
                bounds.pop()
                while own[node] < 0:
                    own[waiting.pop()] = node
    own = np.array(own, dtype=np.int64)
    inner = own[a] == own[b]
    return edges.filter(pa.array(inner)).add_column(0, "component", names.take(pa.array(own[a][inner])))


class Components:
    """Components of ``edges`` (from, to) that hold a cycle; ``nodes`` (node, component), component the least node.

    ``few`` is the number of edges, besides those from a node to itself, that one task takes at the end.
    """

    def __init__(self, edges: DataFrame, few: int = WALKED):
        self.edges = written(edges.select("from", "to").where("`from` is not null and `to` is not null").distinct())
        self.node = self.edges.schema["from"].dataType
        self.few = few
        none = F.lit(None).cast("int")
        self.stack: list[DataFrame] = []  # edges of the chains passed over, level by level
        self.wholes: list[DataFrame] = []  # own, from, to of the edge that stands for each chain
        self.found: list[DataFrame] = []  # edges of components, chains still passed over
        left = self._without_dead_ends(self.edges.withColumns({"level": none, "chain": F.lit(None).cast(self.node)}))
        self.edges = left.select("from", "to")  # often few of all, and all that components can hold
        left, n = self._reduced(left)
        while n > self.few:
            left, n = self._reduced(self._without_dead_ends(self._coloured(left)))
        self.found.append(self._walked(left, n))
        self.nodes = self._named()

    # each edge has the chain that it stands for (level, chain), or nulls

    def _reduced(self, edges: DataFrame) -> tuple[DataFrame, int]:
        """Edges that branch, once chains are passed over and dead ends are gone, or few; and how many lead elsewhere."""
        n = edges.where("`from` != `to`").count()
        while n:
            edges = self._without_dead_ends(self._passed_over(edges))
            n, last = edges.where("`from` != `to`").count(), n
            if n <= self.few or n == last:
                break
        return edges, n

    def _without_dead_ends(self, edges: DataFrame) -> DataFrame:
        """Edges from a node to itself, and others that a way leads to and from."""
        loops, edges = edges.where("`from` = `to`"), edges.where("`from` != `to`")
        sources, targets = edges.select("from").distinct(), edges.select("to").distinct()
        kept = edges.join(targets.toDF("from"), "from", "left_semi").join(sources.toDF("to"), "to", "left_semi")
        return written(kept.select("from", "to", "level", "chain").unionByName(loops))

    def _passed_over(self, edges: DataFrame) -> DataFrame:
        met = chains(edges)
        if met is None:
            return edges
        hops, out = written(met[0]), met[1]
        level = len(self.stack)
        # edges of a chain, counted down to its last node; and the one that leaves it
        into = edges.join(hops.withColumnRenamed("node", "to"), "to").select("own", "steps", "from", "to", "level", "chain")
        out = out.join(hops.where("steps = 0").select(F.col("node").alias("from"), "own"), "from").select("own", F.lit(-1).cast("long").alias("steps"), "from", "to", "level", "chain")
        chain = written(into.unionByName(out))
        whole = written(chain.groupBy("own").agg(F.max_by("from", "steps").alias("from"), F.min_by("to", "steps").alias("to")))
        self.stack.append(chain)
        self.wholes.append(whole)
        passed = whole.select("from", "to", F.lit(level).alias("level"), F.col("own").alias("chain"))
        kept = edges.join(hops.select(F.col("node").alias("from")), "from", "left_anti").join(hops.select(F.col("node").alias("to")), "to", "left_anti")
        both = kept.select("from", "to", "level", "chain").unionByName(passed)
        # of parallel edges the one over fewest levels stays; the others' nodes are placed by their ends
        first = F.min(F.struct(F.coalesce("level", F.lit(-1)).alias("o"), "level", "chain")).alias("e")
        return written(both.groupBy("from", "to").agg(first).select("from", "to", "e.level", "e.chain"))

    def _coloured(self, edges: DataFrame) -> DataFrame:
        """Record the components of each colour's greatest node; edges among nodes without one."""
        ends = edges.select(F.col("from").alias("node")).union(edges.select("to")).distinct()
        colour = cut(ends.withColumn("colour", F.col("node")))
        while True:
            up = edges.join(colour.toDF("from", "up"), "from").groupBy(F.col("to").alias("node")).agg(F.max("up").alias("up"))
            new = cut_afresh(colour.join(up, "node", "left").select("node", F.greatest("colour", "up").alias("colour"), F.coalesce(F.col("up") > F.col("colour"), F.lit(False)).alias("news")))
            colour = new.select("node", "colour")
            if new.where("news").isEmpty():
                break
        inner = edges.join(colour.toDF("from", "c"), "from").join(colour.toDF("to", "c2"), "to").where("c = c2").select("from", "to", "level", "chain", "c")
        inner = cut(inner)
        reach = cut(colour.where("node = colour").select("node", F.col("colour").alias("component")))
        rim = reach
        while True:
            back = inner.join(rim.toDF("to", "c"), ["to", "c"]).select(F.col("from").alias("node"), F.col("c").alias("component")).distinct()
            rim = cut_afresh(back.join(reach, "node", "left_anti"))
            if rim.isEmpty():
                break
            reach = cut_afresh(reach.unionByName(rim))
        own = inner.join(reach.toDF("from", "component"), "from").join(reach.select(F.col("node").alias("to")), "to", "left_semi").select("component", "from", "to", "level", "chain")
        self.found.append(cut(own))
        known = reach.select("node")
        return cut_afresh(edges.join(known.toDF("from"), "from", "left_anti").join(known.toDF("to"), "to", "left_anti"))

    def _walked(self, edges: DataFrame, n: int) -> DataFrame:
        """component, from, to, level, chain of the last edges; ``n`` of them don't lead from a node to itself."""
        loops = edges.where("`from` = `to`")
        if not n:
            return loops.select(F.col("from").alias("component"), "from", "to", "level", "chain")
        schema = StructType([StructField("component", self.node), *edges.schema])
        own = cut(edges.where("`from` != `to`").groupBy().applyInArrow(walked, schema))
        named = loops.join(own.select("from", "component").distinct(), "from", "left")
        return own.unionByName(named.withColumn("component", F.coalesce("component", "from")))

    def _inner_edges(self) -> DataFrame:
        """component, from, to of every edge of the coloured graphs, chains still passed over."""
        out = self.edges.select(F.col("from").alias("component"), "from", "to", F.lit(None).cast("int").alias("level"), F.lit(None).cast(self.node).alias("chain")).limit(0)
        for part in self.found:
            out = out.unionByName(part)
        return out

    def _named(self) -> DataFrame:
        inner = cut(self._inner_edges())
        nodes = inner.select(F.col("from").alias("node"), "component").distinct()
        for chain, whole in zip(reversed(self.stack), reversed(self.wholes)):  # a chain belongs to the component that holds both its ends
            placed = whole.join(nodes.toDF("from", "component"), "from").join(nodes.toDF("to", "c2"), "to").where("component = c2").select("own", "component")
            members = chain.where("steps >= 0").select(F.col("to").alias("node"), "own").join(placed, "own").select("node", "component")
            nodes = written(nodes.unionByName(members))  # who was passed over stands in one chain and at no end
        least = nodes.groupBy("component").agg(F.min("node").alias("least"))
        return written(nodes.join(least, "component").select("node", F.col("least").alias("component")))

    def summary(self) -> DataFrame:
        """component, nodes and edges of each."""
        sizes = self.nodes.groupBy("component").agg(F.count("*").alias("nodes"))
        own = self.nodes.toDF("from", "component").join(self.edges, "from").join(self.nodes.toDF("to", "c2"), "to").where("component = c2")
        return sizes.join(own.groupBy("component").agg(F.count("*").alias("edges")), "component")

    def cycles(self) -> DataFrame:
        """component, place (from 0), node: one cycle of each component, its nodes in order."""
        inner = cut(self._inner_edges())
        start = inner.groupBy("component").agg(F.max("from").alias("node"))
        # breadth first from one node of each, until an edge leads back to it
        seen = cut(start.withColumns({"depth": F.lit(0), "parent": F.lit(None).cast(self.node)}))
        rim, closed, depth = seen, None, 0
        while True:
            step = rim.select("component", F.col("node").alias("from")).join(inner, ["component", "from"]).select("component", "from", F.col("to").alias("node"))
            back = step.join(start, ["component", "node"]).groupBy("component").agg(F.min("from").alias("last"), F.lit(depth).alias("depth"))
            closed = cut_afresh(back if closed is None else closed.unionByName(back))
            rim = step.join(seen, ["component", "node"], "left_anti").join(closed, "component", "left_anti")
            depth += 1
            rim = cut_afresh(rim.groupBy("component", "node").agg(F.lit(depth).alias("depth"), F.min("from").alias("parent")))
            if rim.isEmpty():
                break
            seen = cut_afresh(seen.unionByName(rim))
        at = closed.select("component", F.col("last").alias("node"), "depth")
        way = at.join(start.withColumnRenamed("node", "to"), "component").select("component", "depth", F.col("node").alias("from"), "to")
        for d in range(depth, 0, -1):
            here = at.where(F.col("depth") == d).join(seen, ["component", "node", "depth"])
            way = way.unionByName(here.select("component", F.lit(d - 1).alias("depth"), F.col("parent").alias("from"), F.col("node").alias("to")))
            at = cut_afresh(at.where(F.col("depth") < d).unionByName(here.select("component", F.col("parent").alias("node"), F.lit(d - 1).alias("depth"))))
        path = cut_afresh(way.join(inner, ["component", "from", "to"]).withColumn("place", F.array(F.col("depth").cast("long"))).select("component", "place", "from", "level", "chain"))
        for level in range(len(self.stack) - 1, -1, -1):  # put back what was passed over
            own = self.stack[level].select(F.col("own").alias("chain"), F.lit(level).alias("level"), F.col("steps").alias("s"), F.col("from").alias("f"), F.col("level").alias("l2"), F.col("chain").alias("c2"))
            wide = path.join(own, ["level", "chain"], "left")
            path = cut_afresh(wide.select("component", F.concat("place", F.array(-F.coalesce("s", F.lit(0)))).alias("place"), F.coalesce("f", "from").alias("from"), F.when(F.col("f").isNull(), F.col("level")).otherwise(F.col("l2")).alias("level"), F.when(F.col("f").isNull(), F.col("chain")).otherwise(F.col("c2")).alias("chain")))
        least = self.nodes.toDF("from", "least")
        ordered = path.join(least, "from").select(F.col("least").alias("component"), "place", F.col("from").alias("node"))
        return ordered


def numbered(path: DataFrame) -> DataFrame:
    """component, place, node with places from 0; a cycle's nodes are sorted by their component in one task each."""
    place = F.row_number().over(Window.partitionBy("component").orderBy("place")) - 1
    return path.select("component", place.alias("place"), "node")
