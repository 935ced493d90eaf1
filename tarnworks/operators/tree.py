"""Work-item trees kept as an adjacency table: id, parent_id, level, status, priority and what else a check needs.

``lineage`` gives each item its ancestors, by one join a level; ``closure`` is every (ancestor, item) pair; roll-ups, inherited values, searches
with their ancestors and pruning are groupings or joins over it. Its size is the sum of depths, not of squares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.functions.scalars import half_up, priority_rank, total_interval_ms
from tarnworks.functions.text import normalize
from tarnworks.operators.graph import nodes_on_cycles
from tarnworks.operators.items import requirement_scores
from tarnworks.operators.similarity import measured, name_score
from tarnworks.session import cut

CONTAINERS, WORK_ITEMS = ("epic", "feature"), ("task", "subtask")
DONE = ("completed", "deferred")
#: Level and the levels that may hold it; none: a root.
LATTICE = {"epic": (None,), "feature": ("epic",), "task": ("feature", "epic"), "subtask": ("task", "subtask")}
#: Weights of the five parts of a tree's health.
HEALTH_WEIGHTS = {"depth": 0.15, "balance": 0.20, "granularity": 0.20, "completeness": 0.25, "staleness": 0.20}
STATUSES = ("completed", "in_progress", "pending", "deferred", "blocked")


def closure(items: DataFrame, most_levels: int = 32) -> DataFrame:
    """ancestor, id, distance for every item and each of its ancestors, itself included.

    The distance doubles in each join, so five joins reach 32 levels; an empty step ends it. A deeper tree, or a
    cycle of parents, raises an error.
    """
    pairs = items.select(F.col("id").alias("ancestor"), "id", F.lit(0).alias("distance"))
    parents = items.where("parent_id is not null").select(F.col("parent_id").alias("ancestor"), "id", F.lit(1).alias("distance"))
    known, reach = cut(pairs.union(parents)), 1
    while True:
        upper = known.where("distance > 0").select(F.col("ancestor").alias("top"), F.col("id").alias("middle"), F.col("distance").alias("d"))
        longer = cut(known.where(F.col("distance") == reach).join(upper, F.col("ancestor") == F.col("middle")).select(F.col("top").alias("ancestor"), "id", (F.col("distance") + F.col("d")).alias("distance")))
        if longer.isEmpty():
            return known
        if reach >= most_levels:
            raise ValueError(f"items lie more than {most_levels} levels deep")
        known, reach = known.union(longer), reach * 2


def lineage(items: DataFrame, levels: int) -> DataFrame:
    """id and up: the item and its ancestors, nearest first, for a tree of at most ``levels`` levels.

    One join a level, and each carries one row an item; an item below the last level raises an error.
    """
    parent = items.select(F.col("id").alias("p"), F.col("parent_id").alias("above"))
    out = items.select("id", F.array("id").alias("up"), F.col("parent_id").alias("next"))
    for _ in range(1, levels):
        step = F.when(F.col("p").isNotNull(), F.array_append("up", F.col("p"))).otherwise(F.col("up"))
        out = out.join(parent, F.col("next") == F.col("p"), "left").select("id", step.alias("up"), F.col("above").alias("next"))
    deeper = F.raise_error(F.concat(F.lit(f"below level {levels}: "), F.col("id").cast("string")))
    return out.select("id", F.when(F.col("next").isNull(), F.col("up")).otherwise(deeper).alias("up"))


def closure_of_levels(items: DataFrame, levels: int) -> DataFrame:
    """``closure`` for a tree of known depth, without looking at data: ``lineage`` unfolded."""
    return lineage(items, levels).select(F.posexplode("up").alias("distance", "ancestor"), "id").select("ancestor", "id", "distance")


def walk(items: DataFrame, levels: int) -> DataFrame:
    """Each item with its depth and the path from its root."""
    return lineage(items, levels).select("id", (F.size("up") - 1).alias("depth"), F.array_join(F.reverse("up"), "/").alias("path"))


def rollup(pairs: DataFrame, facts: DataFrame, *values: str) -> DataFrame:
    """Per item: sums over itself, over its descendants and over both, with rows counted. ``facts`` have item_id.

    Facts are summed by item before they meet the ancestors, so a hot item is one row by then.
    """
    own = facts.groupBy(F.col("item_id").alias("id")).agg(*(F.sum(v).alias(v) for v in values), F.count("*").alias("n"))
    joined = pairs.join(own, "id", "left")
    out = []
    for v in (*values, "n"):
        x = F.coalesce(v, F.lit(0))
        out += [F.sum(F.when(F.col("distance") == 0, x).otherwise(0)).alias(f"self_{v}"), F.sum(F.when(F.col("distance") > 0, x).otherwise(0)).alias(f"below_{v}"), F.sum(x).alias(f"total_{v}")]
    return joined.groupBy(F.col("ancestor").alias("id")).agg(*out)


def orphans(facts: DataFrame, items: DataFrame) -> DataFrame:
    return facts.join(items.select(F.col("id").alias("item_id")), "item_id", "left_anti")


def duration_rollup(pairs: DataFrame, items: DataFrame, now: Column) -> DataFrame:
    """Per item: milliseconds of all intervals below and whether any is open."""
    own = items.select("id", total_interval_ms(F.col("intervals"), now).alias("ms"), F.exists("intervals", lambda i: i["end"].isNull()).alias("running"))
    return pairs.join(own, "id").groupBy(F.col("ancestor").alias("id")).agg(F.sum("ms").alias("total_ms"), F.bool_or("running").alias("is_running"))


def status_stats(items: DataFrame, *keys: str) -> DataFrame:
    """Counts by status over tasks, subtasks and childless features; deleted ones apart from the total."""
    parents = items.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    childless = items.where("level = 'feature'").join(parents, "id", "left_anti")
    counted = items.where(F.col("level").isin(*WORK_ITEMS)).unionByName(childless)
    per = [F.count_if(F.col("status") == s).alias(s) for s in (*STATUSES, "failing", "deleted")]
    return counted.groupBy(*keys).agg(F.count_if(F.col("status") != "deleted").alias("total"), *per)


def epic_progress(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """``status_stats`` under each root, with percent complete."""
    roots = items.where("parent_id is null").select(F.col("id").alias("ancestor"))
    under = pairs.join(roots, "ancestor").select("id", F.col("ancestor").alias("root"))
    out = status_stats(items.join(under, "id"), "root")
    return out.withColumn("percent", F.when(F.col("total") > 0, half_up(100.0 * F.col("completed") / F.col("total"))).otherwise(0))


def priority_distribution(items: DataFrame) -> DataFrame:
    """Work items by priority; deleted ones count too."""
    return items.where(F.col("level").isin(*WORK_ITEMS)).groupBy(F.coalesce("priority", F.lit("unset")).alias("priority")).count()


def level_breakdown(items: DataFrame) -> DataFrame:
    live = F.col("status") != "deleted"
    out = items.groupBy("level").agg(F.count_if(live).alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES), F.count_if(~live).alias("deleted"))
    return out.where("total > 0")


def live_children(items: DataFrame) -> DataFrame:
    return items.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count_if(F.col("status") != "deleted").alias("live"), F.count("*").alias("children"), F.bool_and(F.col("status").isin(*DONE, "deleted")).alias("all_done"))


def sibling_completion(items: DataFrame) -> DataFrame:
    """Share of done among live siblings, 0 for an only one."""
    w = Window.partitionBy("parent_id")
    live, done = F.count_if(F.col("status") != "deleted").over(w), F.count_if(F.col("status").isin(*DONE)).over(w)
    return items.withColumn("sibling_ratio", F.when(live > 1, done / live).otherwise(0.0))


def dependents(items: DataFrame) -> DataFrame:
    """How many items each blocks."""
    return items.select(F.explode("blocked_by").alias("id")).groupBy("id").agg(F.count("*").alias("dependents"))


def actionable(items: DataFrame, blocked_by: DataFrame | None = None) -> DataFrame:
    """Items to work on: leaves, or with all children done; not finished, blocked or deleted; all blockers completed.

    ``blocked_by``: (id, blocker), if items are blocked at all.
    """
    kids = live_children(items)
    open_ = items.where(~F.col("status").isin("completed", "deferred", "blocked", "deleted")).join(kids, "id", "left")
    out = open_.where(F.coalesce("all_done", F.lit(True))).drop("live", "children", "all_done")
    if blocked_by is not None:
        unmet = blocked_by.join(items.where("status = 'completed'").select(F.col("id").alias("blocker")), "blocker", "left_anti").select("id").distinct()
        out = out.join(unmet, "id", "left_anti")
    return out


def ranked(candidates: DataFrame, pairs: DataFrame, items: DataFrame, n: int, requirements: DataFrame | None = None, blocked_by: DataFrame | None = None, tolerance: str = "medium") -> DataFrame:
    """The best ``n``: failing, then in progress; priority; requirements' score; the best priority above; siblings
    done; how many items wait for it; title in a reader's order, and the identifier.

    ``requirements``: id, requirement, priority, category; ``blocked_by``: (id, blocker).
    """
    urgency = F.when(F.col("status") == "failing", 0).when(F.col("status") == "in_progress", 1).otherwise(2)
    above = pairs.where("distance > 0").join(items.select(F.col("id").alias("ancestor"), priority_rank(F.col("priority")).alias("rank")), "ancestor").groupBy("id").agg(F.min("rank").alias("above"))
    siblings = sibling_completion(items).select("id", "sibling_ratio")
    rows = candidates.join(above, "id", "left").join(siblings, "id")
    zero = F.lit(0).cast("long")
    rows = rows.join(requirement_scores(pairs, requirements, tolerance), "id", "left") if requirements is not None else rows.withColumn("score", zero)
    rows = rows.join(blocked_by.groupBy(F.col("blocker").alias("id")).agg(F.count("*").alias("waiting")), "id", "left") if blocked_by is not None else rows.withColumn("waiting", zero)
    rows = rows.select("id", "status", "priority", "title", urgency.alias("urgency"), priority_rank(F.col("priority")).alias("rank"), F.coalesce("score", zero).alias("score"), F.coalesce("above", F.lit(2)).alias("above"), "sibling_ratio", F.coalesce("waiting", zero).alias("waiting"))
    return rows.orderBy("urgency", "rank", F.desc("score"), "above", F.desc("sibling_ratio"), F.desc("waiting"), F.collate("title", "UNICODE"), "id").limit(n)


def structure_checks(items: DataFrame, now: str, stuck_hours: int = 48, most_children: int = 20, least_children: int = 2, blocked_by: DataFrame | None = None, pairs: DataFrame | None = None, most_levels: int = 5, most_roots: int = 15) -> DataFrame:
    """check, id: empty containers, stuck items, misplaced levels, unsound timestamps, dangling parents, sizes.

    With ``blocked_by`` (id, blocker) also blocked items that nothing blocks, and cycles of blockers; with ``pairs``
    also items deeper than ``most_levels``; and one row without id if there are too many live roots. The checks of an
    item are made together, over one join with its children's counts and one with its parent.
    """
    up = items.select(F.col("id").alias("parent_id"), F.col("level").alias("parent_level"), F.col("status").alias("parent_status"))
    rows = items.join(live_children(items).select("id", "live"), "id", "left").join(up, "parent_id", "left")
    if blocked_by is not None:
        rows = rows.join(blocked_by.select("id", F.lit(True).alias("waits")).distinct(), "id", "left")
    if pairs is not None:
        rows = rows.join(pairs.groupBy("id").agg((F.max("distance") + 1).alias("levels")), "id", "left")
    misplaced = F.lit(False)
    for level, holders in LATTICE.items():
        fits = F.col("parent_level").isNull() & F.col("parent_id").isNull() if None in holders else F.coalesce(F.col("parent_level").isin(*[h for h in holders if h]), F.lit(False))
        misplaced = misplaced | ((F.col("level") == level) & ~fits)
    old = F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")) > stuck_hours * 3600
    container, live = F.col("level").isin(*CONTAINERS), F.coalesce("live", F.lit(0))
    checks = {
        "empty_container": container & (live == 0) & ~F.col("status").isin(*DONE, "deleted"),
        "stuck": (F.col("status") == "in_progress") & (F.col("started_at").isNull() | old),
        "misplaced": misplaced,
        "dangling_parent": F.col("parent_id").isNotNull() & F.col("parent_level").isNull(),
        "completed_before_start": F.col("completed_at") < F.col("started_at"),
        "done_parent_open_child": (F.col("parent_status") == "completed") & F.col("status").isin("pending", "in_progress"),
        "too_many_children": container & (live > most_children),
        "too_few_children": container & (live > 0) & (live < least_children),
    }
    if blocked_by is not None:
        checks["blocked_by_nothing"] = (F.col("status") == "blocked") & F.col("waits").isNull()
    if pairs is not None:
        checks["too_deep"] = (F.col("levels") > most_levels) & (F.col("status") != "deleted")
    named = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in checks.items())))
    out = rows.select(F.explode(named).alias("check"), "id")
    roots = items.where("parent_id is null and status != 'deleted'").agg(F.count("*").alias("n")).where(F.col("n") > most_roots)
    out = out.unionByName(roots.select(F.lit("too_many_roots").alias("check"), F.lit(None).cast(items.schema["id"].dataType).alias("id")))
    if blocked_by is not None:
        cycles = nodes_on_cycles(blocked_by.select(F.col("id").alias("from"), F.col("blocker").alias("to")))
        if cycles is not None:
            out = out.unionByName(cycles.select(F.lit("blocker_cycle").alias("check"), F.col("node").alias("id")))
    return out


def prunable(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Roots of the greatest subtrees in which all that isn't deleted is completed, with their sizes."""
    state = pairs.join(items.select("id", "status"), "id").groupBy(F.col("ancestor").alias("id")).agg(F.bool_and(F.col("status").isin("completed", "deleted")).alias("done"), F.count("*").alias("size"))
    whole = state.where("done").join(items.where("status = 'completed'").select("id", "parent_id"), "id")
    return whole.join(whole.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "size")


def auto_completable(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Open items with children that would complete by themselves, bottom-up: all children finished or such items.

    An unfinished item that can't complete so (a leaf, or blocked, failing or deleted) holds back its ancestors, as far up as
    the first that is finished itself, which hides what lies below it.
    """
    kids = items.where("parent_id is not null").select(F.col("parent_id").alias("id")).distinct()
    state = items.join(kids.withColumn("has_kids", F.lit(True)), "id", "left").withColumns({"over": F.col("status").isin(*DONE), "open": F.col("status").isin("pending", "in_progress") & F.col("has_kids").isNotNull()})
    holds = state.where(~F.col("over") & ~F.col("open")).select("id")
    above = pairs.where("distance > 0").join(holds, "id")
    over = state.where("over").select(F.col("id").alias("ancestor"))
    hidden = above.join(over, "ancestor").groupBy("id").agg(F.min("distance").alias("upto"))
    held_back = above.join(hidden, "id", "left").where("upto is null or distance < upto").select(F.col("ancestor").alias("id")).distinct()
    return state.where("open").join(held_back, "id", "left_anti").select("id")


def completable_parents(items: DataFrame) -> DataFrame:
    """Open items all of whose children are finished: one level of ``auto_completable``."""
    done = items.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.bool_and(F.col("status").isin(*DONE)).alias("done"))
    return items.where(F.col("status").isin("pending", "in_progress")).join(done.where("done"), "id").select("id")


def parent_resets(pairs: DataFrame, items: DataFrame, parents: DataFrame) -> DataFrame:
    """parent, id: completed items to open again from each of ``parents`` (id) upward, which got a new child; the first
    that isn't completed ends the walk."""
    chain = pairs.join(parents.select("id").distinct(), "id").join(items.select(F.col("id").alias("ancestor"), "status"), "ancestor")
    stop = chain.where("status != 'completed'").groupBy("id").agg(F.min("distance").alias("upto"))
    return chain.join(stop, "id", "left").where("upto is null or distance < upto").select(F.col("id").alias("parent"), F.col("ancestor").alias("id"))


def visible(pairs: DataFrame, items: DataFrame, matches: Column) -> DataFrame:
    """Items that match, and their ancestors."""
    return pairs.join(items.where(matches).select("id"), "id").select(F.col("ancestor").alias("id")).distinct()


def inherited(pairs: DataFrame, requirements: DataFrame) -> DataFrame:
    """id, requirement, distance: what each item is held to, its own first, each requirement once from the nearest."""
    rows = pairs.join(requirements.select(F.col("id").alias("ancestor"), "requirement"), "ancestor")
    return rows.groupBy("id", "requirement").agg(F.min("distance").alias("distance"))


def health(items: DataFrame, now: str, stale_hours: int = 48) -> DataFrame:
    """One row: five scores from 0 to 100 and their weighted mean.

    Items have title, description, n_criteria and started_at besides.
    """
    kids = live_children(items)
    live = items.where("status != 'deleted'").join(kids.select("id", "live"), "id", "left").withColumn("live", F.coalesce("live", F.lit(0)))
    work, box = F.col("level").isin(*WORK_ITEMS), F.col("level").isin(*CONTAINERS)
    described, criteria = F.coalesce(F.trim("description") != "", F.lit(False)), F.coalesce(F.col("n_criteria") > 0, F.lit(False))
    root = F.col("parent_id").isNull()
    active = ~F.col("status").isin("completed", "deferred")
    stale = (F.col("status") == "in_progress") & (F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")) > stale_hours * 3600)
    n = F.count("*")
    ratio = lambda a, b: F.coalesce(F.count_if(a) / F.nullif(F.count_if(b), F.lit(0)), F.lit(0.0))
    violations = F.count_if(root & (F.col("level") != "epic")) + 2 * F.count_if(root & work)
    earned = F.count_if(described & (work | box)) + F.count_if(work & criteria) + F.count_if(work & F.col("priority").isNotNull()) + F.count_if(box & (F.col("live") > 0))
    possible = 3 * F.count_if(work) + 2 * F.count_if(box)
    parts = live.agg(
        half_up(F.greatest(F.lit(0.0), 100 - violations / n * 200)).alias("depth"),
        F.when(F.count_if(work) == 0, 100).otherwise(half_up(F.greatest(F.lit(0.0), 100 - ratio(work & ~described, work) * 30 - ratio(work & ~criteria, work) * 20 - ratio(work & (F.length("title") < 10), work) * 15 - ratio(box & (F.col("live") == 1), box) * 15))).alias("granularity"),
        F.coalesce(half_up(earned / F.nullif(possible, F.lit(0)) * 100), F.lit(100)).alias("completeness"),
        half_up(F.greatest(F.lit(0.0), 100 - ratio(active & stale, active) * 150)).alias("staleness"),
    )
    groups = live.where(box).groupBy("parent_id").agg(F.count("*").alias("m"), F.when((F.count("*") >= 2) & (F.avg("live") > 0), F.stddev_pop("live") / F.avg("live")).alias("cv"))
    balance = groups.where("m >= 2").agg(F.coalesce(half_up(F.greatest(F.lit(0.0), 100 - F.avg("cv") * 50)), F.lit(100)).alias("balance"))
    rows = parts.crossJoin(balance)  # one row each
    return rows.withColumn("overall", half_up(sum(F.col(k) * w for k, w in HEALTH_WEIGHTS.items())))


def without_subtrees(pairs: DataFrame, items: DataFrame, roots: DataFrame) -> DataFrame:
    """Items that aren't one of the roots (id) or below one."""
    gone = pairs.join(roots.select(F.col("id").alias("ancestor")), "ancestor").select("id").distinct()
    return items.join(gone, "id", "left_anti")


def checked_moves(moves: DataFrame, pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Moves (id, to) with what forbids each: unknown, below itself, or a level that may not hold it; null if nothing does."""
    known = items.select("id", "level")
    below = pairs.select(F.col("ancestor").alias("id"), F.col("id").alias("to"), F.lit(True).alias("below"))
    rows = moves.join(known, "id", "left").join(known.select(F.col("id").alias("to"), F.col("level").alias("to_level")), "to", "left").join(below, ["id", "to"], "left")
    fits = F.lit(False)
    for level, holders in LATTICE.items():
        inner = F.col("to").isNull() if holders == (None,) else F.coalesce(F.col("to_level").isin(*holders), F.lit(False))
        fits = fits | ((F.col("level") == level) & inner)
    unknown = F.col("level").isNull() | (F.col("to").isNotNull() & F.col("to_level").isNull())
    return rows.select("id", "to", F.when(unknown, "unknown").when(F.col("below"), "below itself").when(~fits, "level").alias("problem"))


def moved(items: DataFrame, moves: DataFrame) -> DataFrame:
    """Items with the parents that the moves (id, to) give them."""
    to = moves.select("id", "to", F.lit(True).alias("moves"))
    return items.join(to, "id", "left").withColumn("parent_id", F.when(F.col("moves"), F.col("to")).otherwise(F.col("parent_id"))).drop("to", "moves")


def distinct_tags(items: DataFrame) -> DataFrame:
    return items.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def selection_reasons(items: DataFrame, blocked_by: DataFrame) -> DataFrame:
    """Leaves and items with all children done, counted by why each is or isn't to be worked on; the first that applies.

    ``blocked_by``: (id, blocker).
    """
    kids = live_children(items)
    unmet = blocked_by.join(items.where("status = 'completed'").select(F.col("id").alias("blocker")), "blocker", "left_anti").select("id", F.lit(True).alias("unmet")).distinct()
    rows = items.where("status != 'deleted'").join(kids, "id", "left").where(F.coalesce("all_done", F.lit(True))).join(unmet, "id", "left")
    status = F.col("status")
    why = F.when(status == "completed", "completed").when(status == "deferred", "deferred").when(status == "blocked", "blocked").when(F.coalesce("unmet", F.lit(False)), "unresolved").when(status == "in_progress", "in_progress").otherwise("actionable")
    return rows.groupBy(why.alias("reason")).agg(F.count("*").alias("items"))


def resolved_items(items: DataFrame, wanted: DataFrame, levels: int) -> DataFrame:
    """wanted, id: the item that has each text as its identifier, else the first in the tree's order with that title."""
    texts = wanted.select("wanted").distinct()
    by_id = texts.join(items.select(F.col("id").alias("wanted"), "id"), "wanted")
    paths = walk(items, levels).select("id", "path")
    titled = items.select("id", F.lower(F.trim("title")).alias("t")).join(paths, "id")
    by_title = texts.join(by_id.select("wanted"), "wanted", "left_anti").withColumn("t", F.lower(F.trim("wanted"))).join(titled, "t").groupBy("wanted").agg(F.min_by("id", "path").alias("id"))
    return by_id.unionByName(by_title)


def inserted(items: DataFrame, new: DataFrame) -> DataFrame:
    """Items and new ones (with the same columns) whose level their parent may hold; others are left out."""
    up = items.select(F.col("id").alias("parent_id"), F.col("level").alias("_up"))
    rows = new.join(up, "parent_id", "left").join(items.select(F.col("id")), "id", "left_anti")
    fits = F.lit(False)
    for level, holders in LATTICE.items():
        fits = fits | ((F.col("level") == level) & (F.col("parent_id").isNull() if holders == (None,) else F.coalesce(F.col("_up").isin(*holders), F.lit(False))))
    return items.unionByName(rows.where(fits).select(items.columns))


def updated(items: DataFrame, changes: DataFrame, *fields: str) -> DataFrame:
    """Items with the fields of ``changes`` (id and fields) where these aren't null."""
    new = changes.select("id", *(F.col(f).alias(f"_{f}") for f in fields))
    return items.join(new, "id", "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*(f"_{f}" for f in fields))


def reorganisations(items: DataFrame, most: int = 15, least: int = 2) -> DataFrame:
    """kind, id, other, confidence: what a tree's shape suggests.

    move: a feature without a parent; split: a container of more live children than ``most``; merge: one of fewer than
    ``least`` (but some) into the container beside it with the likest title, the least identifier of equally like ones;
    collapse: a container that isn't completed and whose only live child is a container. Deleted items count nowhere.
    A parent's small containers are compared with all its containers. Pairs of like titles among siblings come from
    ``sibling_duplicates``.
    """
    kids = live_children(items)
    live = items.where("status != 'deleted'").join(kids.select("id", "live"), "id", "left").withColumn("live", F.coalesce("live", F.lit(0)))
    box, none = F.col("level").isin(*CONTAINERS), F.lit(None).cast("string")
    move = live.where((F.col("level") == "feature") & F.col("parent_id").isNull()).select(F.lit("move").alias("kind"), "id", none.alias("other"), F.lit(0.8).alias("confidence"))
    split = live.where(box & (F.col("live") > most)).select(F.lit("split"), "id", none, F.lit(0.6))
    titled = live.where(box).select("id", "parent_id", "live", measured(normalize(F.coalesce("title", F.lit("")))).alias("m"))
    beside = titled.select(F.col("id").alias("other"), F.col("parent_id").alias("p"), F.col("m").alias("n"))
    pairs = titled.where((F.col("live") > 0) & (F.col("live") < least)).join(beside, F.col("parent_id").eqNullSafe(F.col("p")) & (F.col("id") != F.col("other")))
    best = pairs.groupBy("id").agg(F.min_by("other", F.struct(-name_score(F.col("m"), F.col("n")), "other")).alias("other"))
    merge = best.select(F.lit("merge"), "id", "other", F.lit(0.5))
    only = live.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.min("id").alias("other"), F.count("*").alias("n"), F.bool_and(box).alias("container")).where("n = 1 and container")
    collapse = live.where(box & (F.col("status") != "completed")).join(only, "id").select(F.lit("collapse"), "id", "other", F.lit(0.65))
    return move.union(split).union(merge).union(collapse)


def reshaped(items: DataFrame, actions: DataFrame) -> DataFrame:
    """Items after actions (kind, id, to): move to another parent, merge into an item, delete, each item by one at most.

    All actions count as made at once: a merged item's children go to its survivor, and only the deleted item itself is
    marked (``without_subtrees`` finds what lies below). ``reshape.Reshaped`` applies changes in order, chains of merges
    and whole subtrees included.
    """
    act = actions.groupBy("id").agg(F.min(F.struct("kind", "to")).alias("a")).select("id", "a.kind", "a.to")
    into = act.where("kind = 'merge'").select(F.col("id").alias("parent_id"), F.col("to").alias("survivor"))
    rows = items.join(act, "id", "left").join(into, "parent_id", "left")
    parent = F.when(F.col("kind") == "move", F.col("to")).otherwise(F.coalesce("survivor", "parent_id"))
    status = F.when(F.col("kind").isin("merge", "delete"), "deleted").otherwise(F.col("status"))
    return rows.withColumns({"parent_id": parent, "status": status}).select(items.columns)


def proposals_of_scan(rows: DataFrame) -> DataFrame:
    """epic, feature, task: scan rows (kind, name, file, source) placed under a feature and an epic.

    A row's feature is itself if it is one, else the feature of its file, else of its source, else one named after its
    directory; a feature's epic is its source's, else one named after the source.
    """
    first = lambda kind, key: rows.where(F.col("kind") == kind).groupBy(key).agg(F.min("name").alias(f"{kind}_by_{key}"))
    placed = rows.join(first("feature", "file"), "file", "left").join(first("feature", "source"), "source", "left").join(first("epic", "source"), "source", "left")
    directory = F.coalesce(F.nullif(F.regexp_extract("file", r"^([^/]+)/", 1), F.lit("")), F.lit("general"))
    feature = F.when(F.col("kind") == "feature", F.col("name")).otherwise(F.coalesce("feature_by_file", "feature_by_source", directory))
    return placed.where("kind != 'epic'").select(F.coalesce("epic_by_source", "source").alias("epic"), feature.alias("feature"), F.when(F.col("kind") == "task", F.col("name")).alias("task"))


def items_in_order(items: DataFrame, levels: int) -> DataFrame:
    """Items with their place in the tree's canonical order: siblings by priority, then title, parents before children."""
    key = items.select("id", F.struct(priority_rank(F.col("priority"), 4).alias("rank"), F.coalesce("title", F.lit("")).alias("title"), "id").alias("key"))
    rows = closure_of_levels(items, levels).join(key.select(F.col("id").alias("ancestor"), "key"), "ancestor")
    path = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("o"), "key"))), lambda x: x["key"])
    return items.join(rows.groupBy("id").agg(path.alias("order")), "id")
