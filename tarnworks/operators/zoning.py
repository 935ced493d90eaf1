"""Zones from a graph of files: communities, and what merges, splits, caps, names and keeps them.

Edges are (src, dst, w) in both directions, members (node, community). Work on files and edges is grouped and joined
by Spark: communities are found by connected component, and each step that merges sees only the graph of communities,
a row for each and one for each pair with edges between them. Its order decides its result, so it runs as one task
over that graph, for each connected component where a limit on the number of zones doesn't tie them together; a graph of
more than ``MOST`` communities raises an error. Large communities are split one task each.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.functions.text import glob_pattern
from tarnworks.operators.graph import local_moves, louvain, neighbours, proximity_edges, undirected
from tarnworks.operators.inventory import assigned_by_proximity, derived_zone_names, pinned
from tarnworks.operators.similarity import clusters
from tarnworks.session import cut, cut_afresh

MOST = 200_000
Sizes, Flows = dict[str, int], dict[str, dict[str, float]]


def communities(edges: DataFrame, resolution: float = 1.0, start: DataFrame | None = None) -> DataFrame:
    """component, node, community of every node with an edge: local moves on the whole graph's weight, by component.

    ``start``: node, community to start from. Nodes of different components never meet, so the result is that of one
    pass over the whole graph.
    """
    parts = clusters(edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))
    rows = edges.join(parts.select(F.col("name").alias("src"), F.col("cluster").alias("component")), "src").crossJoin(edges.agg(F.sum("w").alias("m2")))  # one row
    if start is not None:
        rows = rows.join(start.select(F.col("node").alias("src"), F.col("community").alias("start")), "src", "left").withColumn("start", F.coalesce("start", "src"))
    return cut(louvain(rows, "component", resolution))


def contracted(members: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, w, n: weight and number of directed edges from each community to each (itself included), and a row (a, size) for each."""
    a, b = members.select(F.col("node").alias("src"), F.col("community").alias("a")), members.select(F.col("node").alias("dst"), F.col("community").alias("b"))
    flows = edges.join(a, "src").join(b, "dst").groupBy("a", "b").agg(F.sum("w").alias("w"), F.count("*").alias("n"), F.lit(0).cast("long").alias("size"))
    sizes = members.groupBy(F.col("community").alias("a")).agg(F.count("*").alias("size"))
    return flows.unionByName(sizes.select("a", F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("w"), F.lit(0).cast("long").alias("n"), "size"))


class Contracted:
    """The graph of communities, with merges."""

    def __init__(self, part: pd.DataFrame, value: str = "w"):
        self.sizes: Sizes = {}
        self.flows: Flows = {}
        for row in part.itertuples(index=False):
            if row.b is None:
                self.sizes[row.a] = int(row.size)
                self.flows.setdefault(row.a, {})
            else:
                own = self.flows.setdefault(row.a, {})
                own[row.b] = own.get(row.b, 0.0) + getattr(row, value)
        self.home = {c: c for c in self.sizes}

    def merge(self, gone: str, into: str) -> None:
        self.sizes[into] += self.sizes.pop(gone)
        for other, w in self.flows.pop(gone).items():
            back = self.flows[other].pop(gone, 0.0) if other != gone else 0.0
            target = into if other in (gone, into) else other
            self.flows[into][target] = self.flows[into].get(target, 0.0) + w
            self.flows[target][into] = self.flows[target].get(into, 0.0) + back
        self.home[gone] = into

    def strongest(self, c: str) -> str | None:
        """The other community with most weight to ``c``, the lesser name on a tie."""
        near = [(-w, other) for other, w in self.flows[c].items() if other != c and w > 0]
        return min(near)[1] if near else None

    def final(self) -> dict[str, str]:
        def end(c):
            while self.home[c] != c:
                c = self.home[c]
            return c

        return {c: end(c) for c in self.home}


def small(graph: Contracted, least: int = 3, rounds: int = 50) -> None:
    """Communities under a size join their strongest neighbour, again until none does."""
    for _ in range(rounds):
        merged = False
        for c in sorted(c for c, n in graph.sizes.items() if n < least):
            if graph.sizes.get(c, least) < least and (into := graph.strongest(c)):
                graph.merge(c, into)
                merged = True
        if not merged:
            return


def satellites(graph: Contracted, most: int = 8, share: float = 0.3, rounds: int = 10) -> None:
    """Communities up to a size with enough of their weight outside join their strongest neighbour."""
    for _ in range(rounds):
        merged = False
        for c in sorted(c for c, n in graph.sizes.items() if n <= most):
            if c not in graph.sizes:
                continue
            inside = graph.flows[c].get(c, 0.0) / 2
            outside = sum(w for other, w in graph.flows[c].items() if other != c)
            if inside + outside and outside / (inside + outside) >= share and (into := graph.strongest(c)):
                graph.merge(c, into)
                merged = True
        if not merged:
            return


def tied_both_ways(graph: Contracted, share: float = 0.4) -> None:
    """Pairs whose edges between them are many beside the lesser's own become one, the greatest ratio first; one pass."""
    inside = {c: graph.flows[c].get(c, 0.0) / 2 for c in graph.sizes}
    pairs = [(-w / least, a, b) for a in graph.sizes for b, w in graph.flows[a].items() if a < b and (least := min(inside[a], inside[b])) and w / least >= share]
    gone: set[str] = set()
    for _, a, b in sorted(pairs):
        if a not in gone and b not in gone:
            source, into = (a, b) if graph.sizes[a] < graph.sizes[b] else (b, a)
            graph.merge(source, into)
            gone.add(source)


def capped(graph: Contracted, most: int) -> None:
    """The pair with most weight becomes one until no more communities are left than ``most``; without any, the two smallest."""
    while len(graph.sizes) > most:
        pairs = [(-(w + graph.flows[b].get(a, 0.0)), a, b) for a in graph.sizes for b, w in graph.flows[a].items() if a < b]
        if pairs:
            _, a, b = min(pairs)
        else:
            b, a = sorted(graph.sizes, key=lambda c: (graph.sizes[c], c))[:2]
            graph.merge(b, a)
            continue
        graph.merge(*((a, b) if graph.sizes[a] < graph.sizes[b] else (b, a)))


def regrouped(members: DataFrame, edges: DataFrame, rule: Callable[[Contracted], None], value: str = "w", by_component: bool = True) -> DataFrame:
    """``members`` (component, node, community) after a rule on the graph of their communities; ``value``: w or n."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        graph = Contracted(part, value)
        if len(graph.sizes) > MOST:
            raise ValueError(f"{len(graph.sizes)} communities, more than {MOST}")
        rule(graph)
        final = graph.final()
        return pd.DataFrame({"community": list(final), "into": list(final.values())})

    of = members.groupBy(F.col("community").alias("a")).agg(F.min("component").alias("part"))
    rows = contracted(members, edges).join(of, "a").withColumn("part", F.col("part") if by_component else F.lit(""))
    into = cut(rows.groupBy("part").applyInPandas(run, "community string, into string"))
    return cut(members.join(into, "community").select("component", "node", F.col("into").alias("community")))


def by_directory(files: list[str]) -> dict[str, str]:
    """Files by two directories of their path, or three if two don't tell them apart; none if fewer than two groups have two files."""
    for depth in (2, 3):
        groups: dict[str, list[str]] = {}
        for f in files:
            parts = f.split("/")
            groups.setdefault("/".join(parts[:-1][:depth]) or parts[0], []).append(f)
        if len(groups) > 1:
            break
    if sum(len(own) > 1 for own in groups.values()) < 2:
        return {}
    return {f: f"dir-{k}" for k, (_, own) in enumerate(sorted(groups.items())) for f in own}


def split_once(near: dict[str, dict[str, float]], files: list[str]) -> dict[str, str]:
    """Parts of one community: by moves at growing resolution, else by directory; none if it can't be split."""
    for resolution in (1, 2, 4, 8):
        home = local_moves({f: near.get(f, {}) for f in files}, resolution, 100)
        rows = [(c, None, 0.0, 0, sum(x == c for x in home.values())) for c in set(home.values())]
        rows += [(home[a], home[b], w, 1, 0) for a, own in near.items() for b, w in own.items()]
        graph = Contracted(pd.DataFrame(rows, columns=["a", "b", "w", "n", "size"], dtype=object))
        small(graph)
        final = graph.final()
        if len(set(final.values())) > 1:
            return {f: final[c] for f, c in home.items()}
    return by_directory(files)


def split_large(members: DataFrame, edges: DataFrame, most: int, rounds: int = 10) -> DataFrame:
    """``members`` with communities over a size split, one task for each, until none is or none can be."""
    whole = members.limit(0).select("community")
    for _ in range(rounds):
        large = members.groupBy("community").agg(F.count("*").alias("size")).where(F.col("size") > most).join(whole, "community", "left_anti")
        large = cut(large.select("community"))
        if large.isEmpty():
            break
        own = members.join(large, "community").select("node", "community")
        inside = edges.join(own.select(F.col("node").alias("src"), "community"), "src").join(own.select(F.col("node").alias("dst"), F.col("community").alias("to")), "dst").where("community = to")
        rows = inside.select("community", "src", "dst", "w").unionByName(own.select("community", F.col("node").alias("src"), F.lit(None).cast("string").alias("dst"), F.lit(0.0).alias("w")))

        def run(part: pd.DataFrame) -> pd.DataFrame:
            found = split_once(neighbours(part[part["dst"].notna()]), sorted(part.loc[part["dst"].isna(), "src"]))
            name = part["community"].iloc[0]
            return pd.DataFrame({"node": list(found) or [None], "community": name, "part": [f"{name}#{c}" for c in found.values()] or [None]})

        parts = cut(rows.groupBy("community").applyInPandas(run, "node string, community string, part string"))
        whole = cut(whole.union(parts.where("node is null").select("community")))
        members = cut(members.join(parts.where("node is not null").select("node", "part"), "node", "left").select("component", "node", F.coalesce("part", "community").alias("community")))
    return members


def merged_by_key(members: DataFrame, keys: DataFrame, most: int | None = None) -> DataFrame:
    """``members`` with communities of one key (community, key) joined to the largest, as far as ``most`` nodes allow.

    In order of size the others join if they still fit, which is a running sum; one that doesn't fit is left out of it.
    """
    sizes = members.groupBy("community").agg(F.count("*").alias("size")).join(keys.where("key is not null"), "community")
    room = F.lit(most if most is not None else 1 << 62).cast("long")

    def taken(all_):
        start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<string>").alias("who"))
        step = lambda acc, x: F.when((acc["held"] == 0) | (acc["held"] + x["size"] <= room), F.struct((acc["held"] + x["size"]).alias("held"), F.array_append(acc["who"], x["community"]).alias("who"))).otherwise(acc)
        return F.aggregate(all_, start, step)["who"]

    ordered = F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "community", "size")))
    who = sizes.groupBy("key").agg(ordered.alias("all")).select(taken(F.col("all")).alias("who"))
    into = who.select(F.explode("who").alias("community"), F.col("who")[0].alias("into"))
    return members.join(into, "community", "left").select("component", "node", F.coalesce("into", "community").alias("community"))


def dominant(members: DataFrame, value: Column, share: float = 0.7) -> DataFrame:
    """community, key: the value (null: none) that at least a share of a community's nodes have, the lesser on a tie."""
    counted = members.groupBy("community", value.alias("key")).agg(F.count("*").alias("n"))
    sums = counted.groupBy("community").agg(F.sum("n").alias("size"), F.min_by("key", F.when(F.col("key").isNotNull(), F.struct((-F.col("n")).alias("n"), "key"))).alias("key"), F.max(F.when(F.col("key").isNotNull(), F.col("n"))).alias("best"))
    return sums.where(F.col("best") >= share * F.col("size")).select("community", "key")


def median_weight(edges: DataFrame) -> DataFrame:
    """One row: the median weight of undirected edges, 1 if there are none."""
    return edges.where("src < dst").agg(F.coalesce(F.median("w"), F.lit(1.0)).alias("median"))


def stability_edges(edges: DataFrame, before: DataFrame, weight: float = 0.5, most_pairs: int = 500) -> DataFrame:
    """src, dst, w to add, in both directions, so that files (node, zone) that shared a zone before stay together.

    Each weighs a share of the median edge. In a zone of few files all pairs get one; in a larger one each file gets
    one to the first, and what edges there are among the others get two.
    """
    there = before.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    sizes = there.groupBy("zone").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1").withColumn("all", F.col("n") * (F.col("n") - 1) / 2 <= most_pairs)
    held = cut(there.join(sizes, "zone"))
    few = held.where("all").select("zone", F.col("node").alias("src")).join(held.where("all").select("zone", F.col("node").alias("dst")), "zone").where("src != dst").select("src", "dst", F.lit(1.0).alias("x"))
    star = held.where("not all and node != hub")
    star = star.select(F.col("node").alias("src"), F.col("hub").alias("dst"), F.lit(1.0).alias("x")).union(star.select("hub", "node", F.lit(1.0)))
    large = held.where("not all and node != hub").select("zone", "node")
    inner = edges.join(large.select(F.col("zone").alias("za"), F.col("node").alias("src")), "src").join(large.select(F.col("zone").alias("zb"), F.col("node").alias("dst")), "dst").where("za = zb and src != dst")
    inner = inner.select("src", "dst", F.lit(2.0).alias("x"))
    return few.union(star).union(inner).crossJoin(median_weight(edges)).groupBy("src", "dst").agg((F.sum("x") * F.first("median") * weight).alias("w"))  # one median


def limits(files: int, percent: float = 15.0, most: int = 30) -> tuple[int, int]:
    """Most files of a zone and most zones, for so many files."""
    size = max(3, math.ceil(files * percent / 100))
    return size, min(most, max(max(3, files // 12), math.ceil(files / size)))


def directory_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def zones_of(edges: DataFrame, files: DataFrame, before: DataFrame | None = None, pins: DataFrame | None = None, most_zones: int | None = None, percent: float = 15.0) -> DataFrame:
    """path, zone of every file (path): communities of imports (from, to, weight), merged, capped, split, named, pinned.

    ``before``: node, zone of the last run, which new zones lean to; ``pins``: path, zone that overrule all. Files
    without an edge go with the commonest zone of the nearest directory that has room, or into one of their directory's name.
    """
    real = cut(undirected(edges))
    near = proximity_edges(files.select("path", directory_of(F.col("path")).alias("directory")), edges)
    rows = real.union(undirected(near).select("src", "dst", (F.col("w") * 0.2).alias("w")))  # neighbours in a directory, with a fifth of an import's weight
    if before is not None:
        rows = rows.union(stability_edges(real, before))
    graph = cut(rows.groupBy("src", "dst").agg(F.sum("w").alias("w")))
    most_files, zones = limits(files.count(), percent)
    zones = min(zones, most_zones) if most_zones else zones
    members = communities(graph, start=before.select("node", F.col("zone").alias("community")) if before is not None else None)
    members = regrouped(members, graph, tied_both_ways, "n")
    members = regrouped(members, graph, small)
    members = regrouped(members, graph, satellites)
    members = regrouped(members, graph, lambda g: capped(g, zones), by_component=False)
    members = split_large(members, graph, most_files)
    top = F.regexp_extract("node", r"^(packages/[^/]+)/", 1)
    members = cut(merged_by_key(members, dominant(members, F.nullif(top, F.lit(""))), most_files))
    members = regrouped(members, graph, lambda g: capped(g, zones), by_component=False)
    named = derived_zone_names(members.select("community", F.coalesce(F.nullif(directory_of(F.col("node")), F.lit("")), F.lit("root")).alias("directory")))
    zoned = cut(members.join(named, "community").select(F.col("node").alias("path"), "zone"))
    loose = cut(files.join(zoned, "path", "left_anti").select("path"))
    out = zoned.unionByName(assigned_by_proximity(loose, zoned, most_files if percent < 100 else None))
    rest = files.join(out, "path", "left_anti").select("path", F.coalesce(F.nullif(directory_of(F.col("path")), F.lit("")), F.lit("root")).alias("zone"))
    out = out.unionByName(rest)
    return pinned(out, pins) if pins is not None else out


def subdivided(edges: DataFrame, zones: DataFrame, depth: int = 3, least_edges: int = 3) -> DataFrame:
    """path, zone, level: zones that are large enough split into zones of their own, named after them, down to ``depth`` levels."""
    n = zones.count()
    least = max(12, math.ceil(n * 0.15))
    out = cut(zones.select("path", "zone", F.lit(0).alias("level")))
    for level in range(1, depth + 1):
        sizes = out.groupBy("zone").agg(F.count("*").alias("size"), F.max("level").alias("level")).where((F.col("size") >= least) & (F.col("level") == level - 1))
        own = out.join(sizes.select("zone"), "zone")
        a, b = own.select(F.col("path").alias("from"), "zone"), own.select(F.col("path").alias("to"), F.col("zone").alias("to_zone"))
        inside = cut(edges.join(a, "from").join(b, "to").where("zone = to_zone").select("from", "to", "weight", "zone"))
        for row in inside.groupBy("zone").agg(F.count("*").alias("n")).where(F.col("n") >= least_edges).orderBy("zone").collect():  # a few zones, as each holds a good share of the files
            files = out.where(F.col("zone") == row.zone).select("path")
            parts = cut(zones_of(inside.where(F.col("zone") == row.zone).drop("zone"), files, most_zones=8))
            if parts.select("zone").distinct().count() > 1:
                named = parts.select("path", F.concat_ws("/", F.lit(row.zone), "zone").alias("sub"))
                out = cut(out.join(named, "path", "left").select("path", F.coalesce("sub", "zone").alias("zone"), F.when(F.col("sub").isNotNull(), level).otherwise(F.col("level")).alias("level")))
    return out


def kept_names(zones: DataFrame, before: DataFrame, least: float = 0.5) -> DataFrame:
    """zone, name for zones (path, zone) that were there before (path, zone): of two zones the lesser share that they have
    in common is at least ``least``, above zero.

    Zones choose in turn, each the old name not yet taken that it shares most with. Turns, and old names that share
    alike, go by a column ``place`` of either table, else by name. In each round every zone asks for its next name and
    a name goes to the first that asks, taken from a later one that had it; so rounds end where dealing in turn does.
    A zone asks for at most 1 / ``least`` names.
    """

    def sized(rows, zone, n, place):
        order = F.min("place") if "place" in rows.columns else F.first("zone")
        return rows.groupBy("zone").agg(F.count("*").alias(n), order.alias(place)).withColumnRenamed("zone", zone)

    both = zones.select("path", "zone").join(before.select("path", F.col("zone").alias("name")), "path").groupBy("zone", "name").agg(F.count("*").alias("n"))
    both = both.join(sized(zones, "zone", "new", "turn"), "zone").join(sized(before, "name", "old", "then"), "name")
    both = both.withColumn("overlap", F.least(F.col("n") / F.col("new"), F.col("n") / F.col("old"))).where(F.col("overlap") >= least)
    wishes = F.array_sort(F.collect_list(F.struct((-F.col("overlap")).alias("o"), "then", "name")))["name"]
    held = cut(both.groupBy("zone", "turn").agg(wishes.alias("names")).withColumn("at", F.lit(1)))
    while True:
        asking = held.where(F.col("at") <= F.size("names")).withColumn("name", F.element_at("names", F.col("at")))
        given = asking.groupBy("name").agg(F.min_by("zone", F.struct("turn", "zone")).alias("winner"))
        asking = cut_afresh(asking.join(given, "name").withColumn("refused", F.col("zone") != F.col("winner")))
        if asking.where("refused").isEmpty():
            return asking.select("zone", "name")
        held = asking.select("zone", "turn", "names", (F.col("at") + F.col("refused").cast("int")).alias("at"))


def anchored(zones: DataFrame, anchors: list[tuple[str, str]]) -> DataFrame:
    """Zones (path, zone) with files that a pattern of ``anchors`` (zone, glob) fits moved to its zone, the first that fits."""
    place = F.when(F.lit(False), "")
    for zone, glob in anchors:
        place = place.when(F.col("path").rlike(glob_pattern(glob)), zone)
    return zones.withColumn("zone", F.coalesce(place, F.col("zone")))


def pin_divergence(pins: DataFrame, zones: DataFrame, edges: DataFrame) -> DataFrame:
    """path, zone, directory, there, edges: pinned files (path, zone) that lie elsewhere than most of their zone's files.

    Not those whose directory holds the zone's, nor tests; ``edges``: those between the file and the zone. A pin's own
    file doesn't count, so the zone's best directory is among its two largest and that file's.
    """
    test = lambda c: F.col(c).rlike(r"(^|/)(tests?|__tests__|spec)/")
    at = zones.where(~test("path")).select("zone", "path", directory_of(F.col("path")).alias("there"))
    pinned = pins.select(F.col("path").alias("pin"), "zone").where(~test("pin")).distinct()
    own = at.join(pinned.withColumnRenamed("pin", "path"), ["zone", "path"]).groupBy("zone", F.col("path").alias("pin"), "there").agg(F.count("*").alias("own"))
    rank = F.row_number().over(Window.partitionBy("zone").orderBy(F.desc("n"), "there"))
    largest = at.groupBy("zone", "there").agg(F.count("*").alias("n")).withColumn("rank", rank).where("rank <= 2")
    counted = pinned.join(largest, "zone").join(own, ["zone", "pin", "there"], "left").withColumn("n", F.col("n") - F.coalesce("own", F.lit(0))).where("n > 0")
    best = counted.groupBy("pin", "zone").agg(F.min_by("there", F.struct((-F.col("n")).alias("n"), "there")).alias("there"))
    best = best.withColumn("directory", directory_of(F.col("pin"))).where("there != directory and not startswith(there, concat(directory, '/'))")
    both = edges.select(F.col("from").alias("pin"), F.col("to").alias("path")).union(edges.select("to", "from"))
    linked = both.join(best.select("pin", "zone"), "pin").join(zones.select("path", "zone"), ["path", "zone"]).groupBy("pin", "zone").agg(F.count("*").alias("edges"))
    return best.join(linked, ["pin", "zone"], "left").select(F.col("pin").alias("path"), "zone", "directory", "there", F.coalesce("edges", F.lit(0)).alias("edges"))


def dependency_chunks(files: DataFrame, most: int = 500) -> DataFrame:
    """path, chunk: files by their first directory; a directory of more files than ``most`` in several chunks."""
    top = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"^([^/]+)/", 1)).otherwise(".")
    place = F.floor((F.row_number().over(Window.partitionBy("top").orderBy("path")) - 1) / most)
    return files.select("path", top.alias("top")).withColumn("part", place).select("path", F.concat_ws("#", "top", "part").alias("chunk"))
