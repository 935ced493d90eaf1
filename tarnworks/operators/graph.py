"""Dependency graphs as edge tables: zones and their metrics, degrees, hubs, neighbourhoods, cycles, communities.

Loops cut lineage after each round, since a round uses the last one's result more than once.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.functions.scalars import half_up, risk_level, risk_score
from tarnworks.session import cut, cut_afresh, scratch


def crossings(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Edges between files of different zones, with both zones."""
    return zoned(edges, zones).where("from_zone != to_zone")


def zoned(edges: DataFrame, zones: DataFrame) -> DataFrame:
    a = zones.select(F.col("path").alias("from"), F.col("zone").alias("from_zone"))
    return edges.join(a, "from").join(zones.select(F.col("path").alias("to"), F.col("zone").alias("to_zone")), "to")


def zone_metrics(edges: DataFrame, zones: DataFrame) -> DataFrame:
    """Per zone: cohesion (internal over all edges that touch it), coupling, risk. Edges are counted, not weighted."""
    rows = zoned(edges, zones).groupBy("from_zone", "to_zone").agg(F.count("*").alias("n"))
    ends = rows.select(F.col("from_zone").alias("zone"), "n", (F.col("from_zone") == F.col("to_zone")).alias("inside")).unionByName(rows.where("from_zone != to_zone").select(F.col("to_zone").alias("zone"), "n", F.lit(False).alias("inside")))
    sums = ends.groupBy("zone").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("internal"), F.sum("n").alias("edges"))
    out = zones.groupBy("zone").agg(F.count("*").alias("files")).join(sums, "zone", "left").withColumns({"internal": F.coalesce("internal", F.lit(0)), "edges": F.coalesce("edges", F.lit(0))})
    cohesion = F.when(F.col("files") <= 1, 1.0).when(F.col("edges") == 0, 0.0).otherwise(half_up(F.col("internal") / F.col("edges"), 2))
    coupling = F.when((F.col("files") <= 1) | (F.col("edges") == 0), 0.0).otherwise(half_up(1 - F.col("internal") / F.col("edges"), 2))
    out = out.withColumns({"cohesion": cohesion, "coupling": coupling})
    return out.withColumns({"risk_score": half_up(risk_score(F.col("cohesion"), F.col("coupling")), 4), "risk_level": risk_level(F.col("cohesion"), F.col("coupling"))})


def zone_aggregates(metrics: DataFrame, least_files: int = 5) -> DataFrame:
    """Means of cohesion and coupling over zones that are large enough, weighted by files and not."""
    n = F.sum("files")
    kept = metrics.where(F.col("files") >= least_files)
    return kept.agg(F.count("*").alias("zones"), *(half_up(F.sum(F.col(c) * F.col("files")) / n, 4).alias(f"weighted_{c}") for c in ("cohesion", "coupling")), *(half_up(F.avg(c), 4).alias(f"plain_{c}") for c in ("cohesion", "coupling")))


def zone_flows(edges: DataFrame, zones: DataFrame) -> DataFrame:
    return crossings(edges, zones).groupBy("from_zone", "to_zone").agg(F.count("*").alias("n"))


def two_way_pairs(flows: DataFrame) -> DataFrame:
    """Zone pairs with edges in both directions."""
    low, high = F.least("from_zone", "to_zone").alias("a"), F.greatest("from_zone", "to_zone").alias("b")
    forward = F.col("from_zone") < F.col("to_zone")
    out = flows.groupBy(low, high).agg(F.sum(F.when(forward, F.col("n")).otherwise(0)).alias("forward"), F.sum(F.when(~forward, F.col("n")).otherwise(0)).alias("backward"))
    return out.where("forward > 0 and backward > 0")


def entry_points(edges: DataFrame, zones: DataFrame) -> DataFrame:
    return crossings(edges, zones).select(F.col("to_zone").alias("zone"), "to").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("from").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("to").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def most_imported(edges: DataFrame, n: int = 20) -> DataFrame:
    return edges.groupBy(F.col("to").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(n)


def distinct_callers(calls: DataFrame, of: str, by: str, least: int, n: int) -> DataFrame:
    """Nodes with at least so many distinct neighbours on the other side, the first ``n`` of them."""
    return calls.groupBy(F.col(of).alias("node")).agg(F.count_distinct(by).alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "node").limit(n)


def tight_pairs(calls: DataFrame, least: int, n: int) -> DataFrame:
    """Unordered pairs with at least so many calls, and how they split by direction."""
    forward = F.col("from") < F.col("to")
    out = calls.where("from != to").groupBy(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).agg(F.count("*").alias("n"), F.count_if(forward).alias("forward"), F.count_if(~forward).alias("backward"))
    return out.where(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(n)


def hub_files(edges: DataFrame, zones: DataFrame, least: int, n: int) -> DataFrame:
    """Files that so many zones besides their own import."""
    rows = crossings(edges, zones).groupBy(F.col("to").alias("node")).agg(F.count_distinct("from_zone").alias("zones"))
    return rows.where(F.col("zones") >= least).orderBy(F.desc("zones"), "node").limit(n)


def dead_exports(exports: DataFrame, calls: DataFrame, imports: DataFrame) -> DataFrame:
    """Exports (file, name) that nothing calls or imports."""
    return exports.join(calls, ["file", "name"], "left_anti").join(imports, ["file", "name"], "left_anti")


def merged_edges(parts: DataFrame) -> DataFrame:
    """One row for each (from, to, type) with the union of its symbols."""
    return parts.groupBy("from", "to", "type").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("symbols")))).alias("symbols"))


def undirected(edges: DataFrame, parallel: bool = False) -> DataFrame:
    """Both directions of each edge, parallel ones added (or left as they are); a missing weight is the number of symbols, 1 at least."""
    w = F.greatest(F.coalesce("weight", F.size("symbols").cast("double"), F.lit(1.0)), F.lit(1.0)) if "symbols" in edges.columns else F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1.0))
    kept = edges.where("from != to").withColumn("w", w)
    both = kept.select(F.col("from").alias("src"), F.col("to").alias("dst"), "w").union(kept.select("to", "from", "w"))
    return both if parallel else both.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def ball(edges: DataFrame, start: Column | DataFrame, hops: int) -> DataFrame:
    """Nodes within so many hops of the start nodes, in any direction, with their distance.

    ``start``: a condition on the edges' ends (a), or a table of nodes (node), which may have no edges.
    """
    both = cut(edges.select(F.col("from").alias("a"), F.col("to").alias("b")).union(edges.select("to", "from")).distinct())
    nodes = start.select("node") if isinstance(start, DataFrame) else both.where(start).select(F.col("a").alias("node"))
    found = nodes.withColumn("distance", F.lit(0)).distinct()
    for hop in range(1, hops + 1):
        rim = found.where(F.col("distance") == hop - 1).join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(hop).alias("distance"))
        found = cut(found.unionByName(rim).groupBy("node").agg(F.min("distance").alias("distance")))
    return found


def reachable(edges: DataFrame, steps: int) -> DataFrame:
    """(from, to) pairs joined by a path of at most 2 ** steps edges. For graphs of few nodes, such as zones."""
    reach = cut(edges.select("from", "to").distinct())
    for _ in range(steps):
        onward = reach.select(F.col("from").alias("mid"), F.col("to").alias("end"))
        reach = cut(reach.union(reach.join(onward, F.col("to") == F.col("mid")).select("from", F.col("end").alias("to"))).distinct())
    return reach


def in_cycles(edges: DataFrame, steps: int) -> DataFrame:
    """Nodes on a cycle, with the least node of their strongly connected component."""
    reach = reachable(edges, steps)
    back = reach.select(F.col("to").alias("from"), F.col("from").alias("to"))
    return reach.intersect(back).groupBy(F.col("from").alias("node")).agg(F.least(F.min("to"), F.first("from")).alias("component"), F.count_distinct("to").alias("size"))


def cyclic_core(edges: DataFrame, rounds: int) -> DataFrame:
    """Edges left after so many rounds of removing nodes without a predecessor or a successor: what cycles, or paths
    between them, hold. Linear in the edges, for graphs too large for ``in_cycles``. No round sends nodes to the driver."""
    for _ in range(rounds):
        sources, targets = edges.select("from").distinct(), edges.select("to").distinct()
        edges = cut(edges.join(targets.select(F.col("to").alias("from")).hint("merge"), "from", "left_semi").join(sources.select(F.col("from").alias("to")).hint("merge"), "to", "left_semi").select("from", "to"))
    return edges


def dependency_report(deps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, blocker) with whether the blocker exists and blocks itself."""
    known = nodes.select(F.col("id").alias("blocker"), F.lit(True).alias("known"))
    return deps.join(known, "blocker", "left").select("id", "blocker", F.coalesce("known", F.lit(False)).alias("resolved"), (F.col("id") == F.col("blocker")).alias("on_itself"))


def nodes_on_cycles(edges: DataFrame) -> DataFrame | None:
    """node, for every node on a cycle of ``edges`` (from, to), or None; reachability runs only on what peeling leaves."""
    core, n = edges, edges.count()
    while True:
        core = cyclic_core(core, 1)
        left = core.count()
        if left == n:
            break
        n = left
    if not n:
        return None
    steps = core.select("from").distinct().count()
    return cut(in_cycles(core, max(steps - 1, 0).bit_length() + 1).select("node"))


def chain_lengths(deps: DataFrame) -> DataFrame:
    """Length of the longest chain of blockers above each item, however long.

    A chain ends at an item on a cycle, and such an item has no chain of its own.
    """
    edges = cut(deps.select("id", "blocker").where("id is not null and blocker is not null").distinct())
    cycles = nodes_on_cycles(edges.toDF("from", "to"))
    if cycles is not None:
        edges = cut(edges.join(cycles.select(F.col("node").alias("id")).hint("merge"), "id", "left_anti"))
    lengths = cut(edges.select("id").distinct().withColumn("length", F.lit(1)))
    while True:
        longer = edges.join(lengths.toDF("blocker", "above").hint("merge"), "blocker").groupBy("id").agg((F.max("above") + 1).alias("longer"))
        grown = cut_afresh(lengths.join(longer.hint("merge"), "id", "left").select("id", F.greatest("length", "longer").alias("length"), F.coalesce(F.col("longer") > F.col("length"), F.lit(False)).alias("grown")))
        lengths = grown.select("id", "length")
        if grown.where("grown").isEmpty():
            return lengths


def proximity_edges(files: DataFrame, edges: DataFrame, weight: float = 0.2) -> DataFrame:
    """Neighbours in order within a directory, where no edge joins them yet."""
    following = F.lead("path").over(Window.partitionBy("directory").orderBy("path"))
    pairs = files.withColumn("to", following).where("to is not null").select(F.col("path").alias("from"), "to", F.lit(weight).alias("weight"))
    known = edges.select(F.least("from", "to").alias("a"), F.greatest("from", "to").alias("b")).distinct()
    return pairs.join(known, (F.least("from", "to") == F.col("a")) & (F.greatest("from", "to") == F.col("b")), "left_anti")


def neighbour_moves(edges: DataFrame, places: DataFrame, share: float = 0.8, least: int = 2) -> DataFrame:
    """Files with more than a share of their neighbours, and at least two, in one other directory."""
    both = edges.select(F.col("from").alias("path"), F.col("to").alias("other")).union(edges.select("to", "from")).where("path != other").distinct()
    there = both.join(places.select(F.col("path").alias("other"), F.col("directory").alias("there")), "other")
    counted = there.groupBy("path", "there").agg(F.count("*").alias("n")).withColumn("all", F.sum("n").over(Window.partitionBy("path")))
    return counted.join(places, "path").where((F.col("there") != F.col("directory")) & (F.col("n") >= least) & (F.col("n") > share * F.col("all"))).select("path", "directory", "there", "n", "all")


def neighbours(part: pd.DataFrame) -> dict[str, dict[str, float]]:
    """Weights by node and neighbour, of edges (src, dst, w) in both directions."""
    near: dict[str, dict[str, float]] = {}
    for a, b, w in zip(part["src"], part["dst"], part["w"]):
        near.setdefault(a, {})[b] = near.get(a, {}).get(b, 0.0) + w
    return near


def local_moves(near: dict[str, dict[str, float]], resolution: float, passes: int, total: float | None = None, start: dict[str, str] | None = None) -> dict[str, str]:
    """Community of each node after passes of moves, until one moves none."""
    degree = {n: sum(x.values()) for n, x in near.items()}
    total = sum(degree.values()) if total is None else total
    home = {n: (start or {}).get(n, n) for n in near}
    held: dict[str, float] = {}
    for n, c in home.items():
        held[c] = held.get(c, 0.0) + degree[n]
    for _ in range(passes if total else 0):
        moved = False
        for n in sorted(near):
            links: dict[str, float] = {}
            for other, w in near[n].items():
                if other != n and other in home:
                    links[home[other]] = links.get(home[other], 0.0) + w
            own = home[n]
            rest = held[own] - degree[n]
            best, gain = own, 0.0
            for c in sorted(links):
                if c != own and (g := (links[c] - links.get(own, 0.0)) / total - 2 * resolution * degree[n] * (held[c] - rest) / total**2) > gain:
                    best, gain = c, g
            if best != own:
                held[own] -= degree[n]
                held[best] += degree[n]
                home[n], moved = best, True
        if not moved:
            break
    return home


def louvain(edges: DataFrame, group: str, resolution: float = 1.0, passes: int = 100, most_nodes: int = 1_000_000) -> DataFrame:
    """Communities by sequential local moves, exactly, for one bounded graph (a connected component) per ``group``.

    Nodes go in order of name and move to the neighbouring community of greatest gain, the lesser name on a tie,
    until a pass moves none. The gain of a move is (w_c - w_own) / m2 - 2 γ k (S_c - S_own) / m2², where m2 is the
    weight of the group, or of the whole graph if ``edges`` have it as a column m2. A node starts in the community
    that a column ``start`` of its edges names, else in its own. A group of more nodes than ``most_nodes`` raises an
    error; ``propagated_labels`` is for those.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        near = neighbours(part)
        if len(near) > most_nodes:
            raise ValueError(f"a group has {len(near)} nodes, more than {most_nodes}")
        total = float(part["m2"].iloc[0]) if "m2" in part else None
        home = local_moves(near, resolution, passes, total, dict(zip(part["src"], part["start"])) if "start" in part else None)
        return pd.DataFrame({group: part[group].iloc[0], "node": list(home), "community": list(home.values())})

    kind = edges.schema[group].dataType.simpleString()
    return edges.groupBy(group).applyInPandas(run, f"`{group}` {kind}, node string, community string")


def propagated_labels(edges: DataFrame, rounds: int) -> DataFrame:
    """Communities for graphs of any size: in each round a node takes the label of most weight around it, the least
    on a tie. A different result from ``louvain``, under its own name.

    ``edges`` (src, dst, w) has both directions of each pair, as ``undirected`` gives them, parallel ones added or not.
    They are written once, bucketed by their node, so that a round moves labels to them and then one message an edge.
    """
    spark = edges.sparkSession
    tasks, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"edges_{uuid.uuid4().hex}"
    edges.repartition(tasks, "dst").groupBy("src", "dst").agg(F.sum("w").alias("w")).write.bucketBy(tasks, "dst").option("path", scratch(spark, "edges")).saveAsTable(name)
    try:
        held = spark.table(name)
        best = lambda community: F.max_by(community, F.struct("w", F.struct((-F.xxhash64(community)).alias("h")))).alias("community")
        # in the first round the labels around a node are its neighbours
        labels = held.select(F.col("dst").alias("node"), F.col("src").alias("community"), "w")
        labels = cut_afresh(labels.groupBy("node").agg(best("community"))) if rounds else labels.select("node", F.col("node").alias("community")).distinct()
        for _ in range(rounds - 1):
            sent = held.join(labels.withColumnRenamed("node", "dst").hint("shuffle_hash"), "dst").select(F.col("src").alias("node"), "community", "w")
            # one shuffle serves both sums and choice
            around = sent.repartition(tasks, "node").groupBy("node", "community").agg(F.sum("w").alias("w"))
            labels = cut_afresh(around.groupBy("node").agg(best("community")))
        return labels if rounds else cut_afresh(labels)
    finally:
        spark.sql(f"DROP TABLE {name}")


def partition_similarity(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean over the zones of ``a`` of the best Jaccard with a zone of ``b``; only zones that share files are compared."""
    size = lambda t, n: t.groupBy("zone").agg(F.count("*").alias(n))
    shared = a.select("path", F.col("zone").alias("za")).join(b.select("path", F.col("zone").alias("zb")), "path").groupBy("za", "zb").agg(F.count("*").alias("n"))
    rows = shared.join(size(a, "na").withColumnRenamed("zone", "za"), "za").join(size(b, "nb").withColumnRenamed("zone", "zb"), "zb")
    best = rows.groupBy("za").agg(F.max(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("best"))
    return size(a, "na").join(best, F.col("zone") == F.col("za"), "left").agg(half_up(F.avg(F.coalesce("best", F.lit(0.0))), 4).alias("similarity"))
