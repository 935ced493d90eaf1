"""Files, imports, calls and findings: resolution, summaries, health, classification by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.functions.scalars import half_up
from tarnworks.session import cut, cut_afresh

#: Kinds of import that the health score counts.
IMPORT_TYPES = ("static", "dynamic", "require", "type", "reexport")


def file_summary(files: DataFrame) -> DataFrame:
    """Counts by language, by role, by category and in all, in one pass of grouping sets."""
    sets = [[F.col("language")], [F.col("role")], [F.col("category")], []]
    return files.groupingSets(sets, "language", "role", "category").agg(F.count("*").alias("files"), F.sum("lines").alias("lines"))


def zone_summary(zones: DataFrame, files: DataFrame) -> DataFrame:
    return zones.join(files.select("path", "lines"), "path", "left").groupBy("zone").agg(F.count("*").alias("files"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"))


def import_summary(edges: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """The most imported files, type imports aside, and one row with the mean number of edges an importing file has."""
    top = edges.where("type != 'type'").groupBy(F.col("to").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(n)
    mean = edges.agg(half_up(F.count("*") / F.nullif(F.count_distinct("from"), F.lit(0)), 2).alias("mean_edges"))
    return top, mean


def import_density(edges: Column, files: Column) -> Column:
    """absent, sparse (under a quarter of an edge a file) or rich."""
    return F.when((edges == 0) | (files == 0), "absent").when(edges / files < 0.25, "sparse").otherwise("rich")


def import_health(cycles: Column, edges: Column, packages: Column, files: Column) -> Column:
    """0 to 100: cycles count .4, imports a file .3, packages a file .3; 100 without files."""
    per_file, outside = edges / files, packages / files
    mean_score = F.when(per_file <= 8, 100.0).when(per_file <= 15, 100 - (per_file - 8) / 7 * 50).otherwise(F.greatest(F.lit(0.0), 50 - (per_file - 15) * 5))
    outside_score = F.when(outside <= 3, 100.0).otherwise(F.greatest(F.lit(0.0), 100 - (outside - 3) * 20))
    score = 0.4 * F.greatest(F.lit(0.0), 100 - 500 * cycles / files) + 0.3 * mean_score + 0.3 * outside_score
    return F.when(files == 0, 100).otherwise(half_up(score))


def resolved_calls(calls: DataFrame, functions: DataFrame, imports: DataFrame) -> DataFrame:
    """Each call with the file that defines what it calls: the caller's own, else one it imports, else the only one anywhere.

    calls: file, callee; functions: file, name; imports: from, to.
    """
    own = functions.select(F.col("file").alias("file"), F.col("name").alias("callee"), F.col("file").alias("own")).distinct()
    near = imports.select(F.col("from").alias("file"), F.col("to").alias("near")).join(functions.select(F.col("file").alias("near"), F.col("name").alias("callee")), "near").groupBy("file", "callee").agg(F.min("near").alias("near"))
    single = functions.groupBy(F.col("name").alias("callee")).agg(F.min("file").alias("single"), F.count_distinct("file").alias("n")).where("n = 1").drop("n")
    rows = calls.join(own, ["file", "callee"], "left").join(near, ["file", "callee"], "left").join(single, "callee", "left")
    how = F.when(F.col("own").isNotNull(), "own").when(F.col("near").isNotNull(), "imported").when(F.col("single").isNotNull(), "single").otherwise("unresolved")
    return rows.select("file", "callee", F.coalesce("own", "near", "single").alias("target"), how.alias("how"))


def zone_call_stats(calls: DataFrame, zones: DataFrame) -> DataFrame:
    """Per zone: calls inside it, out of it and into it."""
    a, b = zones.select(F.col("path").alias("from"), F.col("zone").alias("a")), zones.select(F.col("path").alias("to"), F.col("zone").alias("b"))
    rows = calls.join(a, "from", "left").join(b, "to", "left")
    ends = rows.select(F.col("a").alias("zone"), F.when(F.col("a") == F.col("b"), "inside").otherwise("out").alias("kind")).union(rows.where("a is null or b is null or a != b").select("b", F.lit("into")))
    return ends.where("zone is not null").groupBy("zone").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("inside", "out", "into")))


def connection_map(calls: DataFrame, zones: DataFrame) -> DataFrame:
    """path, other_zone, n: calls between a file and another zone, counted at both ends."""
    a, b = zones.select(F.col("path").alias("from"), F.col("zone").alias("a")), zones.select(F.col("path").alias("to"), F.col("zone").alias("b"))
    rows = calls.join(a, "from").join(b, "to").where("a != b")
    ends = rows.select(F.col("from").alias("path"), F.col("b").alias("other_zone")).union(rows.select("to", "a"))
    return ends.groupBy("path", "other_zone").agg(F.count("*").alias("n"))


def external_edges(external: DataFrame, packages: DataFrame) -> DataFrame:
    """Imports of packages that live in the repository, as edges from the importer to the package's entry file."""
    return external.select("package", F.explode("importedBy").alias("from")).join(packages.select("package", F.col("entry").alias("to")), "package").select("from", "to", "package").distinct()


def package_prefix(paths: DataFrame, packages: DataFrame) -> DataFrame:
    """Each path with the longest package root that it lies under: its ancestors are looked up, so it is an equi join."""
    parts = F.split("path", "/")
    roots = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    up = paths.select("path", F.explode(roots).alias("root")).join(packages.select("root"), "root")
    best = up.groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, "path", "left")


def suffix_matches(changed: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs of paths of which one ends with the other at a slash: each path's suffixes are looked up."""
    def suffixes(c):
        parts = F.split(c, "/")
        return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))

    c, k = changed.select(F.col("path").alias("changed")).distinct(), known.select(F.col("path").alias("known")).distinct()
    forward = c.withColumn("key", F.explode(suffixes("changed"))).join(k.withColumn("key", F.col("known")), "key").select("changed", "known")
    backward = k.withColumn("key", F.explode(suffixes("known"))).join(c.withColumn("key", F.col("changed")), "key").select("changed", "known")
    return forward.union(backward).distinct()


def file_info(paths: DataFrame, files: DataFrame, zones: DataFrame, edges: DataFrame) -> DataFrame:
    """What is known about each of some files: inventory, zone, what it imports and what imports it."""
    out = edges.groupBy(F.col("from").alias("path")).agg(F.array_sort(F.collect_set("to")).alias("imports"))
    into = edges.groupBy(F.col("to").alias("path")).agg(F.array_sort(F.collect_set("from")).alias("imported_by"))
    return paths.join(files, "path", "left").join(zones, "path", "left").join(out, "path", "left").join(into, "path", "left")


def page(rows: DataFrame, limit: int, *order: str, offset: int = 0) -> DataFrame:
    """A page of rows in order, each with the number of all."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(total)  # one row


def classified(files: DataFrame, rules: list[tuple[str, str, float]], primary: float = 0.4, secondary: float = 0.3) -> DataFrame:
    """path, archetype, score, second: rules (archetype, pattern, weight) that match a path add up, at most 1.

    The best archetype counts from ``primary`` on, the first in the rules' order on a tie; the next from ``secondary``.
    """
    names = list(dict.fromkeys(a for a, _, _ in rules))
    scores = {a: F.least(F.lit(1.0), sum((F.when(F.col("path").rlike(p), w).otherwise(0.0) for x, p, w in rules if x == a), F.lit(0.0))) for a in names}
    ranked = F.array_sort(F.array(*(F.struct((-s).alias("s"), F.lit(k).alias("k"), F.lit(a).alias("a")) for k, (a, s) in enumerate(scores.items()))))
    rows = files.select("path", ranked.alias("r"))
    first, second = F.col("r")[0], F.get(F.col("r"), F.lit(1))
    has = -first["s"] >= primary
    return rows.select("path", F.when(has, first["a"]).alias("archetype"), half_up(-first["s"], 4).alias("score"), F.when(has & (-second["s"] >= secondary), second["a"]).alias("second"))


def merged_classes(*layers: DataFrame) -> DataFrame:
    """path, archetype from the first layer that has one."""
    out = layers[0].select("path", F.col("archetype").alias("c0"))
    for k, layer in enumerate(layers[1:], 1):
        out = out.join(layer.select("path", F.col("archetype").alias(f"c{k}")), "path", "full_outer")
    return out.select("path", F.coalesce(*(F.col(f"c{k}") for k in range(len(layers)))).alias("archetype"))


def merged_zones(zones: DataFrame) -> DataFrame:
    """Zones of one name (case and edges aside) as one: metrics weighted by files, file lists united."""
    n = F.sum(F.size("files"))
    weighted = lambda c: half_up(F.sum(F.col(c) * F.size("files")) / F.nullif(n, F.lit(0)), 4).alias(c)
    return zones.groupBy(F.lower(F.trim("name")).alias("key")).agg(F.min("name").alias("name"), weighted("cohesion"), weighted("coupling"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("files")))).alias("files"))


def stale_findings(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings all of whose related files are gone."""
    rows = findings.select("id", F.explode("related").alias("path")).where(r"path rlike '\\.[A-Za-z0-9]+$'")
    there = rows.join(files.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    return there.groupBy("id").agg(F.bool_or(F.coalesce("there", F.lit(False))).alias("any")).where("not any").select("id")


def recommendations(findings: DataFrame, chunk: int = 3) -> DataFrame:
    """Findings of a scope and category in chunks, in order, with a count by severity."""
    w = Window.partitionBy("scope", "category").orderBy("id")
    part = F.floor((F.row_number().over(w) - 1) / chunk)
    return findings.withColumn("part", part).groupBy("scope", "category", "part").agg(F.count("*").alias("findings"), *(F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")))


def acknowledged(findings: DataFrame, acks: DataFrame) -> DataFrame:
    """Findings whose hash an acknowledgement has, whole or by a prefix that only one finding has."""
    by_hash = findings.join(acks.select("hash"), "hash", "left_semi")
    starts = acks.select(F.col("hash").alias("prefix")).where(F.length("prefix") < 12)
    keyed = findings.select("id", "hash", F.explode(F.transform(F.sequence(F.lit(4), F.lit(11)), lambda k: F.substring(F.col("hash"), F.lit(1), k))).alias("prefix"))
    once = keyed.join(starts, "prefix").groupBy("prefix").agg(F.count_distinct("id").alias("n"), F.first("id").alias("id")).where("n = 1").select("id")
    return by_hash.select("id").union(once).distinct()


def derived_zone_names(members: DataFrame) -> DataFrame:
    """community, zone: the directory most of its files share, the lesser on a tie, with -2, -3 for repeated names."""
    counted = members.groupBy("community", "directory").agg(F.count("*").alias("n"))
    best = counted.groupBy("community").agg(F.min_by("directory", F.struct((-F.col("n")).alias("n"), "directory")).alias("zone"), F.sum("n").alias("size"))
    rn = F.row_number().over(Window.partitionBy("zone").orderBy(F.desc("size"), "community"))
    return best.withColumn("rn", rn).select("community", F.when(F.col("rn") == 1, F.col("zone")).otherwise(F.concat_ws("-", "zone", "rn")).alias("zone"))


def assigned_by_proximity(loose: DataFrame, zoned: DataFrame, most: int | None = None) -> DataFrame:
    """path, zone for files without one: the commonest zone of the nearest directory above that itself holds zoned files.

    Ties go to the lesser zone; files below no such directory get none. With ``most``, a zone takes files, by path, until
    it has so many; the others ask the next zone of their directory, then those of directories further up. Each round
    every file asks one zone, so the result is that of dealing the files one by one.
    """
    segments = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda k: F.array_join(F.slice(segments, F.lit(1), k), "/"))
    asked = loose.select("path").distinct().select("path", F.explode(F.slice(above, F.lit(1), F.size(segments) - 1)).alias("dir"))
    here = F.array_join(F.slice(segments, F.lit(1), F.size(segments) - 1), "/")
    order = F.struct((-F.length("dir")).alias("d"), (-F.col("n")).alias("n"), "zone")
    options = asked.join(zoned.groupBy(here.alias("dir"), "zone").agg(F.count("*").alias("n")), "dir")
    if most is None:
        return options.groupBy("path").agg(F.min_by("zone", order).alias("zone"))
    room = cut(zoned.groupBy("zone").agg((F.lit(most) - F.count("*")).alias("room")))
    choices = options.groupBy("path").agg(F.array_sort(F.collect_list(order)).alias("x"))
    held = cut(choices.select("path", F.array_distinct("x.zone").alias("zones"), F.lit(1).alias("at")))
    by_path = Window.partitionBy("zone").orderBy("path")
    while True:
        wanted = held.where(F.col("at") <= F.size("zones")).withColumn("zone", F.element_at("zones", F.col("at")))
        ranked = wanted.select("zone", "path", F.row_number().over(by_path).alias("k")).where(F.col("k") <= most)
        last = ranked.join(room, "zone").where("k = room").select("zone", F.col("path").alias("last"))
        limits = room.join(last, "zone", "left")
        full = (F.col("room") <= 0) | F.coalesce(F.col("path") > F.col("last"), F.lit(False))
        asking = cut_afresh(wanted.join(limits, "zone").select("path", "zones", "at", "zone", full.alias("refused")))
        if asking.where("refused").isEmpty():
            return asking.select("path", "zone")
        held = asking.select("path", "zones", (F.col("at") + F.col("refused").cast("int")).alias("at"))


def pinned(zones: DataFrame, pins: DataFrame) -> DataFrame:
    """Zones with some files moved to where pins say."""
    return zones.join(pins.select("path", F.col("zone").alias("pin")), "path", "left").select("path", F.coalesce("pin", "zone").alias("zone"))


def route_patterns(name: Column) -> Column:
    """URL pattern of a dotted route file name below the folder of routes; null of a layout without a path.

    ``$x`` is a parameter, ``$`` the rest of the path, ``(x)`` is written without and ``($x)`` is optional, ``_x`` in
    front has no path, ``_index`` at the end and ``_`` after a name are left out. A name that leads out of the folder
    has none.
    """
    stem = F.regexp_replace(name, r"\.[^./]+$", "")
    every = F.split(stem, r"\.")
    named = F.when(F.element_at(every, -1) == "_index", F.slice(every, F.lit(1), F.size(every) - 1)).otherwise(every)
    pathless = F.coalesce(F.startswith(F.get(named, F.lit(0)), F.lit("_")), F.lit(False))
    parts = F.when(pathless, F.slice(named, F.lit(2), F.size(named))).otherwise(named)

    def shown(part):
        bare = F.regexp_replace(part, "(?<=.)_$", "")
        fitted = F.regexp_replace(F.regexp_replace(bare, r"^\(\$(.*)\)$", ":$1?"), r"^\((.*)\)$", "$1")
        return F.when(bare == "$", "*").otherwise(F.regexp_replace(fitted, r"^\$", ":"))

    path = F.concat(F.lit("/"), F.array_join(F.transform(parts, shown), "/"))
    whole = F.when(stem.isin("_index", "index"), "/").when(pathless & (F.size(parts) == 0), F.lit(None)).otherwise(path)
    return F.when(F.startswith(name, F.lit("..")), F.lit(None)).otherwise(whole)
