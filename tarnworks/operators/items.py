"""Work items by their tags, texts and references: facets, branches, criteria, merges, impact, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnworks.functions.scalars import half_up, priority_rank
from tarnworks.functions.text import facet_value, is_facet, keywords, matched_keywords

#: Rank of how much a change means.
SIGNIFICANCE = {"patch": 0, "minor": 1, "major": 2}
#: Weight of requirements by how much risk is tolerated.
RISK_MULTIPLIERS = {"low": 3, "medium": 2, "high": 1}


def tagged(items: DataFrame, *wanted: str) -> DataFrame:
    """Items with any of the tags."""
    return items.where(F.arrays_overlap("tags", F.array(*map(F.lit, wanted))))


def passing_facets(items: DataFrame, statuses: list[str], wanted: list[str]) -> DataFrame:
    """Items of one of the statuses with all of the tags; an empty list asks nothing."""
    keep = F.lit(True)
    if statuses:
        keep = keep & F.col("status").isin(*statuses)
    if wanted:
        keep = keep & (F.size(F.array_except(F.array(*map(F.lit, wanted)), "tags")) == 0)
    return items.where(keep)


def facet_distribution(items: DataFrame, key: str) -> DataFrame:
    return items.select(facet_value(F.col("tags"), key).alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("items"))


def facets(items: DataFrame) -> DataFrame:
    """id, key, value: every facet of each item, the last of a key."""
    rows = items.select("id", F.posexplode("tags").alias("n", "tag")).where(is_facet(F.col("tag")))
    parts = F.split("tag", ":")
    return rows.select("id", "n", parts[0].alias("key"), parts[1].alias("value")).groupBy("id", "key").agg(F.max_by("value", "n").alias("value"))


def within_branch(completed_at: Column, created_at: Column) -> Column:
    """Whether an item was completed since its branch began; without a beginning always, without completion never."""
    return F.when(created_at.isNull(), True).otherwise(F.coalesce(completed_at >= created_at, F.lit(False)))


def is_breaking(title: Column, description: Column, tags: Column, criteria: Column) -> Column:
    pattern = r"(?i)breaking[- ]change|\bbreaking\b|backwards?[- ]incompatible"
    text = F.concat_ws(" ", title, description)
    return text.rlike(pattern) | F.exists(tags, lambda t: t.rlike(pattern)) | F.exists(criteria, lambda t: t.rlike(pattern))


def significance(breaking: Column, level: Column, priority: Column) -> Column:
    """patch, minor or major: the greatest that applies."""
    rank = F.greatest(F.when(breaking | (level == "epic") | (priority == "critical"), 2).otherwise(0), F.when(level == "feature", 1).otherwise(0))
    return F.when(rank == 2, "major").when(rank == 1, "minor").otherwise("patch")


def references(messages: DataFrame, items: DataFrame, pattern: str = r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})") -> DataFrame:
    """id, item: identifiers that a message names, of items that exist."""
    found = messages.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(pattern), F.lit(1)))).alias("item"))
    return found.join(items.select(F.col("id").alias("item")), "item", "left_semi").select("id", "item")


def criteria_coverage(criteria: DataFrame, tests: DataFrame, least: int = 2) -> DataFrame:
    """criterion, test, shared: tests that share at least so many keywords with a criterion, through the keywords."""
    a = criteria.select("criterion", F.explode(keywords(F.col("text"))).alias("word"))
    b = tests.select("test", F.explode(keywords(F.col("text"))).alias("word"))
    return a.join(b, "word").groupBy("criterion", "test").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)


def traceability(items: DataFrame) -> DataFrame:
    """requirement, items: who is held to what."""
    return items.select("id", F.explode("requirements").alias("requirement")).groupBy("requirement").agg(F.array_sort(F.collect_set("id")).alias("items"))


def merged_into(items: DataFrame, merges: DataFrame) -> DataFrame:
    """Items after some were merged into survivors (gone, survivor): blockers point to survivors, once, not to themselves."""
    to = merges.select(F.col("gone").alias("b"), "survivor")
    rows = items.select("id", F.explode_outer("blocked_by").alias("b")).join(to, "b", "left").select("id", F.coalesce("survivor", "b").alias("b"))
    blockers = rows.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("b") != F.col("id"), F.col("b")))).alias("blocked_by"))
    return items.drop("blocked_by").join(blockers, "id").join(merges.select(F.col("gone").alias("id")), "id", "left_anti")


def without_references(items: DataFrame, removed: DataFrame) -> DataFrame:
    """Items with blockers that were removed taken out."""
    gone = removed.select(F.col("id").alias("b"), F.lit(True).alias("gone"))
    rows = items.select("id", F.explode_outer("blocked_by").alias("b")).join(gone, "b", "left")
    return items.drop("blocked_by").join(rows.groupBy("id").agg(F.array_sort(F.collect_set(F.when(F.col("gone").isNull(), F.col("b")))).alias("blocked_by")), "id")


def epic_impact(pairs: DataFrame, items: DataFrame, removed: DataFrame) -> DataFrame:
    """Per root: work items and share completed, before and after the removal of some."""
    roots = items.where("parent_id is null").select(F.col("id").alias("ancestor"))
    work = items.where(F.col("level").isin("task", "subtask") & (F.col("status") != "deleted")).select("id", (F.col("status") == "completed").alias("done"))
    rows = pairs.join(roots, "ancestor").join(work, "id").join(removed.select("id", F.lit(True).alias("gone")), "id", "left").withColumn("stays", F.col("gone").isNull())
    share = lambda a, b: half_up(100.0 * a / F.nullif(b, F.lit(0)))
    stays, done = F.col("stays"), F.col("done")
    return rows.groupBy(F.col("ancestor").alias("id")).agg(F.count("*").alias("before"), F.count_if(stays).alias("after"), share(F.count_if(done), F.count("*")).alias("percent_before"), share(F.count_if(done & stays), F.count_if(stays)).alias("percent_after"))


def pending_leaves(items: DataFrame) -> DataFrame:
    """Leaves that wait or are blocked."""
    parents = items.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    return items.join(parents, "id", "left_anti").where(F.col("status").isin("pending", "blocked")).select("id")


def requirement_scores(pairs: DataFrame, requirements: DataFrame, tolerance: str = "medium") -> DataFrame:
    """Per item: what its own and inherited requirements add, each once: 1, and more by priority (medium if none) and category.

    requirements: id, requirement, priority, category. The less risk is tolerated, the more those weigh.
    """
    m = RISK_MULTIPLIERS[tolerance]
    p, c = F.coalesce("priority", F.lit("medium")), F.col("category")
    worth = 1 + F.when(p == "critical", 3 * m).when(p == "high", 2 * m).when(p == "medium", 1).otherwise(0) + F.when(c == "security", 2 * m).when(c == "performance", m).otherwise(0)
    rows = pairs.join(requirements.withColumnRenamed("id", "ancestor"), "ancestor")
    nearest = rows.groupBy("id", "requirement").agg(F.min_by(F.struct("priority", "category"), "distance").alias("r")).select("id", "r.priority", "r.category")
    return nearest.groupBy("id").agg(F.sum(worth).alias("score"))


def scope_creep(before: Column, now: Column, share: float = 0.5) -> Column:
    return F.coalesce((now - before) / F.nullif(before, F.lit(0)) > share, F.lit(False))


def with_deletions(x: Column, most: int) -> Column:
    """A text and all that is left of it after deleting up to ``most`` characters, each once."""

    def without_one(c):
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
        return F.when(F.length(c) > 0, cut).otherwise(F.array().cast("array<string>"))

    found = level = F.array(x)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, without_one)))
        found = F.concat(found, level)
    return F.array_distinct(found)


def suggestions(typed: DataFrame, commands: DataFrame, most: int = 2) -> DataFrame:
    """typed, command, distance: commands up to ``most`` edits away, of all ``commands``.

    Texts within so many edits have a common rest after as many deletions in each, so they meet by equality of rests,
    whatever the number of commands.
    """
    a = typed.select("typed").distinct().withColumn("rest", F.explode(with_deletions(F.col("typed"), most)))
    b = commands.select("command").distinct().withColumn("rest", F.explode(with_deletions(F.col("command"), most)))
    pairs = a.join(b, "rest").select("typed", "command").distinct()
    return pairs.withColumn("distance", F.levenshtein("typed", "command")).where((F.col("distance") >= 1) & (F.col("distance") <= most)).orderBy("typed", "distance", "command")


def upserted(links: Column, system: str, work_item: str, link: Column) -> Column:
    """An array of links with the one of this system and item replaced or added at the end."""
    return F.concat(F.filter(links, lambda x: ~((x["system"] == system) & (x["work_item"] == work_item))), F.array(link))


def survivors(rows: DataFrame) -> DataFrame:
    """Per cluster: the richest item (most filled fields, longest description, least identifier) with the tags of all."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("description", "priority", "title")), F.lit(0)) + F.size("tags")
    order = F.struct((-filled).alias("filled"), (-F.length(F.coalesce("description", F.lit("")))).alias("length"), "id")
    return rows.groupBy("cluster").agg(F.min_by("id", order).alias("id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("tags")))).alias("tags"), F.count("*").alias("merged"))


def branch_scope(items: DataFrame, created_at: Column) -> DataFrame:
    """Items with included, and why not: not completed, or completed before the branch began."""
    inside = within_branch(F.col("completed_at"), created_at)
    why = F.when(inside, None).when(F.col("completed_at").isNull(), "not completed").otherwise("before the branch")
    return items.withColumns({"included": inside, "reason": why})


def tasks_by_keywords(items: DataFrame, wanted: Column) -> DataFrame:
    """id, score: items by how many of the words their title and description contain, then by priority."""
    score = matched_keywords(wanted, F.concat_ws(" ", "title", "description"))
    return items.withColumn("score", score.cast("long")).where("score > 0").orderBy(F.desc("score"), priority_rank(F.col("priority")), "id").select("id", "score")


def merged_fields(rows: DataFrame) -> DataFrame:
    """cluster, tags, acceptance: what the items of a cluster have, each once, in order."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return rows.groupBy("cluster").agg(union("tags"), union("acceptance"))


def of_live(rows: DataFrame, pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (id) of items that aren't deleted and lie below none that is."""
    gone = pairs.join(items.where("status = 'deleted'").select(F.col("id").alias("ancestor")), "ancestor").select("id").distinct()
    return rows.join(gone, "id", "left_anti")


def requirement_coverage(pairs: DataFrame, items: DataFrame, requirements: DataFrame) -> DataFrame:
    """level, own, inherited, none, percent: work items with requirements of their own, only above them, and without any."""
    held = pairs.join(requirements.select(F.col("id").alias("ancestor")).distinct(), "ancestor").groupBy("id").agg(F.min("distance").alias("nearest"))
    near = F.col("nearest")
    out = of_live(items, pairs, items).join(held, "id", "left").groupBy("level").agg(F.count_if(near == 0).alias("own"), F.count_if(near > 0).alias("inherited"), F.count_if(near.isNull()).alias("none"))
    covered = F.col("own") + F.col("inherited")
    return out.withColumn("percent", half_up(covered / (covered + F.col("none")) * 100))


def requirement_breakdown(pairs: DataFrame, items: DataFrame, requirements: DataFrame) -> DataFrame:
    """by, value, n: distinct requirements of live items by category, kind of validation and priority.

    ``requirements``: id, place, requirement, category, validation_type, priority. What a repeated requirement is, its
    first place decides; one without a priority is unset.
    """
    kinds = ("category", "validation_type", "priority")
    first = of_live(requirements, pairs, items).groupBy("requirement").agg(F.min_by(F.struct("category", "validation_type", F.coalesce("priority", F.lit("unset")).alias("priority")), "place").alias("x"))
    rows = first.select(F.explode(F.array(*(F.struct(F.lit(k).alias("by"), F.col(f"x.{k}").alias("value")) for k in kinds))).alias("x"))
    return rows.groupBy("x.by", "x.value").agg(F.count("*").alias("n"))
