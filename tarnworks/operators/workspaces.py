"""Member projects of a workspace as one project: files, imports and zones, and the imports between members.

``members`` has a row for each project: member (its name), prefix (its directory), package (the name that others import
it by) and entry (the file that this name stands for), the last two perhaps null. Tables of members have a column
``member`` beside paths that are relative to its directory. Rows of unknown members are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnworks.functions.scalars import half_up


def directory(prefix: Column) -> Column:
    """A prefix without slashes at its end; empty for the root, as "." is."""
    return F.regexp_replace(prefix, r"^\./|^\.$|/+$", "")


def below(prefix: Column, path: Column) -> Column:
    """A member's path as one of the workspace."""
    folder = directory(prefix)
    return F.when(folder == "", path).otherwise(F.concat(folder, F.lit("/"), path))


def united(members: DataFrame, rows: DataFrame, *paths: str) -> DataFrame:
    """Rows of all members with the columns ``paths`` relative to the workspace."""
    joined = rows.join(members.select("member", F.col("prefix").alias("_prefix")), "member")
    return joined.withColumns({p: below(F.col("_prefix"), F.col(p)) for p in paths}).drop("_prefix")


def inventory_totals(files: DataFrame) -> DataFrame:
    """measure, key, n: files and lines of all, and files by language, role and category."""
    row = lambda measure, key, n: F.struct(F.lit(measure).alias("measure"), key.alias("key"), n.cast("long").alias("n"))
    rows = F.array(row("files", F.lit(""), F.lit(1)), row("lines", F.lit(""), F.coalesce("lines", F.lit(0))), *(row(c, F.col(c), F.lit(1)) for c in ("language", "role", "category")))
    return files.select(F.explode(rows).alias("x")).where("x.key is not null").groupBy("x.measure", "x.key").agg(F.sum("x.n").alias("n"))


def import_totals(edges: DataFrame, externals: DataFrame) -> DataFrame:
    """One row: edges, packages, circular and per_file (edges for each importing file, to two places).

    ``edges`` (from, to) within members, ``externals`` (package). Rings were told by each member, so here there are none.
    """
    inside = edges.groupBy("from").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.count("*").alias("files"))
    outside = externals.select("package").distinct().agg(F.count("*").alias("packages"))
    mean = F.when(F.col("files") > 0, half_up(F.col("edges") / F.col("files"), 2)).otherwise(0.0)
    return inside.join(outside).select("edges", "packages", F.lit(0).cast("long").alias("circular"), mean.alias("per_file"))  # one row each


def most_imported(edges: DataFrame, most: int = 10) -> DataFrame:
    """path, n: files that most edges lead to, ties to the lesser path."""
    return edges.groupBy(F.col("to").alias("path")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(most)


def united_zones(members: DataFrame, zones: DataFrame) -> DataFrame:
    """``zones`` (member, zone, path) with the member's name before the zone's."""
    return united(members, zones, "path").withColumn("zone", F.concat_ws(":", "member", "zone"))


def targets(members: DataFrame, zones: DataFrame, entries: DataFrame) -> DataFrame:
    """package, target, to, to_zone: where an import of a member's package leads.

    To its entry, if a zone of ``united_zones`` has it; else to the first entry point of the member's first zone that
    has any, else to the first file of its first zone. ``entries``: member, zone, path and place, the order of a zone's
    entry points.
    """
    named = members.where("package is not null")
    direct = united(members, named.where("entry is not null").select("member", F.col("entry").alias("path")), "path")
    direct = direct.join(zones.groupBy("path").agg(F.max("zone").alias("zone")), "path").select("member", F.struct(F.lit(0).alias("k"), F.lit("").alias("z"), F.lit(0).cast("long").alias("p"), "path", "zone").alias("x"))
    points = united_zones(members, entries).select("member", F.struct(F.lit(1).alias("k"), F.col("zone").alias("z"), F.col("place").cast("long").alias("p"), "path", "zone").alias("x"))
    files = zones.select("member", F.struct(F.lit(2).alias("k"), F.col("zone").alias("z"), F.lit(0).cast("long").alias("p"), "path", "zone").alias("x"))
    best = direct.unionByName(points).unionByName(files).groupBy("member").agg(F.min("x").alias("x"))
    return named.select("member", "package").join(best, "member").select("package", F.col("member").alias("target"), F.col("x.path").alias("to"), F.col("x.zone").alias("to_zone"))


def member_crossings(members: DataFrame, imports: DataFrame, zones: DataFrame, entries: DataFrame) -> DataFrame:
    """from, to, from_zone, to_zone: imports (member, package, path) of other members' packages, each once.

    ``zones`` as ``united_zones`` has them; files outside all zones cross none. A member's imports of itself don't count.
    """
    where = targets(members, zones, entries)
    rows = imports.select("member", "package", "path").distinct().join(where, "package").where("member != target")
    placed = united(members, rows, "path").join(zones.groupBy("path").agg(F.max("zone").alias("from_zone")), "path")
    return placed.select(F.col("path").alias("from"), "to", "from_zone", "to_zone").distinct()


def innermost_members(files: DataFrame, members: DataFrame) -> DataFrame:
    """``files`` (path) with the member whose directory is the nearest above, null if none is.

    A file asks for each directory above it, so the prefixes are a table of any size. Of members with one directory the
    lesser name has it.
    """
    folders = members.select(directory(F.col("prefix")).alias("dir"), "member").groupBy("dir").agg(F.min("member").alias("member"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    asked = files.select("path").where("path is not null").distinct().select("path", F.explode(above).alias("dir"))
    nearest = asked.join(folders, "dir").groupBy("path").agg(F.max_by("member", F.length("dir")).alias("member"))
    return files.join(nearest, "path", "left")
