"""Merges, the work items that they belong to, what they changed, and what a run wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.functions.text import source_branch

UUID = r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"
#: Kinds of change that a summary counts by themselves.
CHANGES = ("added", "modified", "deleted", "renamed", "copied")


def items_of_messages(merges: DataFrame, items: DataFrame) -> DataFrame:
    """sha, item: identifiers in a merge's subject and body, of items that exist."""
    text = F.lower(F.concat_ws("\n", "subject", "body"))
    found = merges.select("sha", F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(UUID), F.lit(1)))).alias("item"))
    return found.join(items.select(F.col("id").alias("item")), "item", "left_semi").select("sha", "item")


def items_of_branches(merges: DataFrame, items: DataFrame) -> DataFrame:
    """sha, item: the first whole identifier in the name of the merged branch that exists, else the item whose first 8 hex
    digits a part of the name starts with; of items that share these, the least."""
    branch = F.lower(source_branch(F.col("subject")))
    rows = merges.select("sha", branch.alias("branch")).where("branch is not null")
    known = items.select(F.lower("id").alias("item")).distinct()
    whole = rows.select("sha", F.posexplode(F.regexp_extract_all("branch", F.lit(UUID), F.lit(1))).alias("n", "item")).join(known, "item", "left_semi")
    short = known.groupBy(F.substring("item", 1, 8).alias("start")).agg(F.min("item").alias("item"))
    starts = F.filter(F.split("branch", r"[^0-9a-f]+"), lambda p: F.length(p) >= 8)
    part = rows.select("sha", F.posexplode(F.transform(starts, lambda p: F.substring(p, 1, 8))).alias("n", "start")).join(short, "start").select("sha", (F.col("n") + 1000).alias("n"), "item")
    return whole.select("sha", "n", "item").unionByName(part).groupBy("sha").agg(F.min_by("item", "n").alias("item"))


def runs_of_merges(merges: DataFrame, runs: DataFrame, items: DataFrame, hours: int = 24, series: Column | None = None) -> DataFrame:
    """sha, item: items of runs (item, ended) that ended after the merge before, at most some hours before the merge.

    Each run goes to the first merge at or after it, found by one fill over the union of both; ``series`` (of both
    tables, say the repository) spreads histories over tasks.
    """
    key = series if series is not None else F.lit(0)
    both = merges.select(key.alias("k"), F.col("merged_at").alias("ts"), F.lit(1).alias("kind"), "sha", F.lit(None).cast("string").alias("item"))
    both = both.unionByName(runs.select(key.alias("k"), F.col("ended").alias("ts"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("sha"), F.col("item").cast("string").alias("item")))
    onward = Window.partitionBy("k").orderBy("ts", "kind", "sha").rowsBetween(0, Window.unboundedFollowing)
    filled = both.withColumn("next", F.first(F.when(F.col("kind") == 1, F.struct("ts", "sha")), ignorenulls=True).over(onward))
    near = F.unix_micros(F.col("next.ts")) - F.unix_micros("ts") < hours * 3_600_000_000
    found = filled.where((F.col("kind") == 0) & F.col("next").isNotNull() & near).select(F.col("next.sha").alias("sha"), "item").distinct()
    return found.join(items.select(F.col("id").cast("string").alias("item")), "item", "left_semi").select("sha", "item")


def merge_graph(merges: DataFrame, items: DataFrame, runs: DataFrame, hours: int = 24, series: Column | None = None) -> DataFrame:
    """sha, item, attribution: edges from merges to items by message, by branch and by run, each once."""
    parts = {"commit-message": items_of_messages(merges, items), "branch-name": items_of_branches(merges, items), "run": runs_of_merges(merges, runs, items, hours, series)}
    return reduce(DataFrame.unionByName, (p.select("sha", "item", F.lit(a).alias("attribution")) for a, p in parts.items())).distinct()


def linkage(merges: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: merges, those with and without an item, and items that have a merge."""
    linked = merges.select("sha").distinct().join(edges.groupBy("sha").agg(F.lit(1).alias("linked")), "sha", "left").agg(F.count("*").alias("merges"), F.count("linked").alias("linked"))
    return linked.crossJoin(edges.agg(F.count_distinct("item").alias("items"))).select("merges", "linked", (F.col("merges") - F.col("linked")).alias("unlinked"), "items")  # one row each


def change_summary(files: DataFrame) -> DataFrame:
    """Per merge: files by kind of change."""
    return files.groupBy("sha").agg(*(F.count_if(F.col("change") == c).alias(c) for c in CHANGES), F.count_if(~F.col("change").isin(*CHANGES) | F.col("change").isNull()).alias("other"), F.count("*").alias("total"))


def written_category(path: Column, document: str = "prd.json", folder: str | None = None) -> Column:
    """metadata, test, docs, config or code, the first that fits; metadata: the document of items and what its folder holds."""
    own = F.endswith(path, F.lit(document))
    return (
        F.when(own | F.contains(path, F.lit(f"{folder}/")) if folder else own, "metadata")
        .when(path.rlike(r"\.(test|spec)\.[jt]sx?$|__tests__/|/tests/|^tests/"), "test")
        .when(path.rlike(r"(?i)\.(md|mdx|txt|rst)$"), "docs")
        .when(path.rlike(r"(?i)\.(json|ya?ml|toml|ini)$|\.env|\.config\.[jt]s$"), "config")
        .otherwise("code")
    )


def written_files(calls: DataFrame, writers: tuple[str, ...] = ("write_file",), item_tools: tuple[str, ...] = ("update_item", "add_item"), document: str = "prd.json", folder: str | None = None) -> DataFrame:
    """run, category, path: distinct files that tool calls (run, tool, path) wrote; changes of items count as their document.

    Which tools write and which change items, and where items are kept, are parameters.
    """
    path = F.when(F.col("tool").isin(*writers), F.nullif(F.col("path"), F.lit(""))).when(F.col("tool").isin(*item_tools), document)
    return calls.select("run", path.alias("path")).where("path is not null").distinct().select("run", written_category(F.col("path"), document, folder).alias("category"), "path")


def by_file(items: DataFrame, owners: DataFrame, default: str) -> DataFrame:
    """Items with the file that each lies in: its own, else its owner's (id, file), else the default."""
    return items.join(owners.select("id", F.col("file").alias("owner")), "id", "left").withColumn("file", F.coalesce(F.nullif(F.col("source_file"), F.lit("")), "owner", F.lit(default))).drop("owner")


def component_usage(usage: DataFrame, imports: DataFrame) -> DataFrame:
    """from, to, component, uses: uses of components (file, component, n) summed by where the file's imports (file, component, target) point."""
    return usage.join(imports, ["file", "component"]).groupBy(F.col("file").alias("from"), F.col("target").alias("to"), "component").agg(F.sum("n").alias("uses"))


def component_summary(edges: DataFrame, n: int = 20) -> DataFrame:
    """component, to, uses: the most used components."""
    return edges.groupBy("component", "to").agg(F.sum("uses").alias("uses")).orderBy(F.desc("uses"), "to", "component").limit(n)
