"""Queries over the work-item tree, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnworks.functions import scalars
from tarnworks.operators import tree as op
from tarnworks.plans.tables import CLOSURE, ITEMS, TREE_LEVELS, TREE_NOW, items, table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def closed(spark, sf_dir):
    rows = items(spark, sf_dir)
    return op.closure_of_levels(rows, TREE_LEVELS), rows


@query(f"WITH {CLOSURE} SELECT id, max(distance) AS depth, string_agg(ancestor, '/' ORDER BY distance DESC) AS path FROM closure GROUP BY 1")
def tree_walk(spark, sf_dir):
    return op.walk(items(spark, sf_dir), TREE_LEVELS)


@query(f"""WITH {CLOSURE}, f AS (SELECT 'O:' || l_orderkey AS id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT c.*, coalesce(quantity, 0) AS q, coalesce(n, 0) AS n FROM closure c LEFT JOIN f USING (id))
SELECT ancestor AS id, CAST(sum(CASE WHEN distance = 0 THEN q ELSE 0 END) AS BIGINT) AS self_quantity, CAST(sum(CASE WHEN distance > 0 THEN q ELSE 0 END) AS BIGINT) AS below_quantity, CAST(sum(q) AS BIGINT) AS total_quantity,
 CAST(sum(CASE WHEN distance = 0 THEN n ELSE 0 END) AS BIGINT) AS self_n, CAST(sum(CASE WHEN distance > 0 THEN n ELSE 0 END) AS BIGINT) AS below_n, CAST(sum(n) AS BIGINT) AS total_n FROM j GROUP BY 1""")
def tree_rollup(spark, sf_dir):
    pairs, _ = closed(spark, sf_dir)
    facts = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("O:"), F.col("l_orderkey")).alias("item_id"), F.col("l_quantity").cast("long").alias("quantity"))
    return op.rollup(pairs, facts, "quantity")


STATUS_COLUMNS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in (*op.STATUSES, "failing", "deleted"))
COUNTED = "(level IN ('task', 'subtask') OR level = 'feature' AND id NOT IN (SELECT parent_id FROM items WHERE parent_id IS NOT NULL))"


@query(f"""WITH {CLOSURE}, g AS (SELECT ancestor AS root, count(*) FILTER (status <> 'deleted') AS total, {STATUS_COLUMNS} FROM closure JOIN items USING (id) WHERE ancestor LIKE 'R:%' AND {COUNTED} GROUP BY 1)
SELECT *, CASE WHEN total > 0 THEN CAST(floor(100.0 * completed / total + 0.5) AS BIGINT) ELSE 0 END AS percent FROM g""")
def epic_progress(spark, sf_dir):
    return op.epic_progress(*closed(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT count(*) FILTER (status <> 'deleted') AS total, {STATUS_COLUMNS} FROM items WHERE {COUNTED}")
def tree_stats(spark, sf_dir):
    return op.status_stats(items(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT coalesce(priority, 'unset') AS priority, count(*) AS count FROM items WHERE level IN ('task', 'subtask') GROUP BY 1")
def priority_distribution(spark, sf_dir):
    return op.priority_distribution(items(spark, sf_dir))


@query(f"WITH {ITEMS} SELECT level, count(*) FILTER (status <> 'deleted') AS total, {', '.join(f'''count(*) FILTER (status = '{s}') AS {s}''' for s in op.STATUSES)}, count(*) FILTER (status = 'deleted') AS deleted FROM items GROUP BY 1")
def level_breakdown(spark, sf_dir):
    return op.level_breakdown(items(spark, sf_dir))


@query(f"""WITH {CLOSURE}, own AS (SELECT 'O:' || o_orderkey AS id, CAST(sum(CASE WHEN l_linenumber = 2 AND o_orderkey % 5 = 0 THEN greatest(0, epoch_ms(TIMESTAMP '{TREE_NOW}') - epoch_ms(o_orderdate)) WHEN l_linenumber = 3 THEN greatest(0, epoch_ms(o_orderdate) - epoch_ms(l_shipdate)) ELSE greatest(0, epoch_ms(l_shipdate) - epoch_ms(o_orderdate)) END) AS BIGINT) AS ms,
 bool_or(l_linenumber = 2 AND o_orderkey % 5 = 0) AS running FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT ancestor AS id, CAST(coalesce(sum(ms), 0) AS BIGINT) AS total_ms, coalesce(bool_or(running), false) AS is_running FROM closure LEFT JOIN own USING (id) GROUP BY 1""")
def duration_rollup(spark, sf_dir):
    """Every item; some intervals are open, some run backward."""
    pairs, rows = closed(spark, sf_dir)
    spans = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    line, begun, shipped = F.col("l_linenumber"), F.col("o_orderdate"), F.col("l_shipdate")
    start, end = F.when(line == 3, shipped).otherwise(begun), F.when((line == 2) & (F.col("o_orderkey") % 5 == 0), None).when(line == 3, begun).otherwise(shipped)
    spans = spans.groupBy(F.concat(F.lit("O:"), F.col("o_orderkey")).alias("id")).agg(F.collect_list(F.struct(start.alias("start"), end.alias("end"))).alias("intervals"))
    none = F.array().cast("array<struct<start:timestamp,end:timestamp>>")
    held = rows.join(spans, "id", "left").withColumn("intervals", F.coalesce("intervals", none))
    return op.duration_rollup(pairs, held, F.lit(TREE_NOW).cast("timestamp"))


@query(f"""WITH {CLOSURE}, own AS (SELECT 'O:' || o_orderkey AS id, sum(CASE WHEN l_shipdate > o_orderdate THEN epoch_ms(l_shipdate) - epoch_ms(o_orderdate) ELSE 0 END) AS ms FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT ancestor AS id, CAST(coalesce(sum(ms), 0) AS BIGINT) AS total_ms, false AS is_running FROM closure LEFT JOIN own USING (id) GROUP BY 1""")
def item_durations(spark, sf_dir):
    pairs, rows = closed(spark, sf_dir)
    spans = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    spans = spans.groupBy(F.concat(F.lit("O:"), F.col("o_orderkey")).alias("id")).agg(F.collect_list(F.struct(F.col("o_orderdate").alias("start"), F.col("l_shipdate").alias("end"))).alias("intervals"))
    none = F.array().cast("array<struct<start:timestamp,end:timestamp>>")
    held = rows.join(spans, "id", "left").withColumn("intervals", F.coalesce("intervals", none))
    return op.duration_rollup(pairs, held, F.lit(TREE_NOW).cast("timestamp"))


@query(f"""WITH own AS (SELECT o_orderkey, CAST(sum(CASE WHEN l_shipdate > o_orderdate THEN epoch_ms(l_shipdate) - epoch_ms(o_orderdate) ELSE 0 END) AS BIGINT) AS ms, max(l_shipdate) AS last FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN coalesce(ms, 0) WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderstatus = 'P' THEN greatest(0, epoch_ms(TIMESTAMP '{TREE_NOW}') - epoch_ms(o_orderdate))
 WHEN o_orderkey % 5 = 1 THEN 0 WHEN o_orderkey % 2 = 0 THEN coalesce(greatest(0, epoch_ms(last) - epoch_ms(o_orderdate)), 0) ELSE 86400000 END AS ms, o_orderstatus = 'P' AS is_running FROM orders LEFT JOIN own USING (o_orderkey) WHERE o_orderkey % 3 <> 0 OR ms IS NOT NULL""")
def elapsed_times(spark, sf_dir):
    """Orders as items with intervals (every third), else with a start, perhaps an end, or neither."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    orders, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    spans = orders.join(line, k == F.col("l_orderkey")).groupBy("o_orderkey").agg(F.collect_list(F.struct(F.col("o_orderdate").alias("start"), F.col("l_shipdate").alias("end"))).alias("intervals"), F.max("l_shipdate").alias("last"))
    rows = orders.join(spans, "o_orderkey", "left").where((k % 3 != 0) | F.col("intervals").isNotNull())
    intervals = F.when(k % 3 == 0, F.col("intervals"))
    started = F.when(k % 11 != 0, F.col("o_orderdate"))
    ended = F.when((k % 2 == 0) & (k % 5 != 1), F.col("last"))
    completed = F.when((k % 2 != 0) & (k % 5 != 1), F.col("o_orderdate") + F.expr("interval 1 day"))
    status = F.when(F.col("o_orderstatus") == "P", "in_progress").otherwise("completed")
    ms = scalars.elapsed_ms(status, intervals, started, ended, completed, F.lit(TREE_NOW).cast("timestamp"))
    return rows.select("o_orderkey", ms.alias("ms"), (status == "in_progress").alias("is_running"))


RANK = "CASE {c} WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 2 END"


BLOCKERS = "blocked AS (SELECT 'O:' || o_orderkey AS id, 'O:' || (o_orderkey - o_orderkey % 7) AS blocker FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0)"
HELD_TO = "q AS (SELECT id, priority, CASE WHEN length(title) % 3 = 0 THEN 'security' ELSE 'other' END AS category FROM items WHERE level <> 'subtask' OR right(id, 1) = '4')"


def blockers(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where((k % 3 == 0) & (k % 7 != 0)).select(F.concat(F.lit("O:"), k).alias("id"), F.concat(F.lit("O:"), k - k % 7).alias("blocker"))


def held_to(rows):
    category = F.when(F.length("title") % 3 == 0, "security").otherwise("other")
    return rows.where("level != 'subtask' or id like '%4'").select("id", F.col("id").alias("requirement"), "priority", category.alias("category"))


@query(f"""WITH {CLOSURE}, {BLOCKERS}, {HELD_TO}, kids AS (SELECT parent_id AS id, bool_and(status IN ('completed', 'deferred', 'deleted')) AS all_done FROM items WHERE parent_id IS NOT NULL GROUP BY 1),
 unmet AS (SELECT DISTINCT id FROM blocked WHERE blocker NOT IN (SELECT id FROM items WHERE status = 'completed')),
 a AS (SELECT i.* FROM items i LEFT JOIN kids USING (id) WHERE status NOT IN ('completed', 'deferred', 'blocked', 'deleted') AND coalesce(all_done, true) AND i.id NOT IN (SELECT id FROM unmet)),
 up AS (SELECT c.id, min({RANK.format(c='p.priority')}) AS above FROM closure c JOIN items p ON p.id = c.ancestor WHERE distance > 0 GROUP BY 1),
 req AS (SELECT c.id, CAST(sum(1 + CASE coalesce(q.priority, 'medium') WHEN 'critical' THEN 6 WHEN 'high' THEN 4 WHEN 'medium' THEN 1 ELSE 0 END + CASE WHEN category = 'security' THEN 4 ELSE 0 END) AS BIGINT) AS score FROM closure c JOIN q ON q.id = c.ancestor GROUP BY 1),
 dep AS (SELECT blocker AS id, count(*) AS waiting FROM blocked GROUP BY 1),
 sib AS (SELECT id, CASE WHEN count(*) FILTER (status <> 'deleted') OVER w > 1 THEN count(*) FILTER (status IN ('completed', 'deferred')) OVER w / count(*) FILTER (status <> 'deleted') OVER w ELSE 0.0 END AS sibling_ratio FROM items WINDOW w AS (PARTITION BY parent_id))
SELECT a.id, status, priority, title, CASE status WHEN 'failing' THEN 0 WHEN 'in_progress' THEN 1 ELSE 2 END AS urgency, {RANK.format(c='priority')} AS rank, coalesce(score, 0) AS score, coalesce(above, 2) AS above, CAST(sibling_ratio AS DOUBLE) AS sibling_ratio, coalesce(waiting, 0) AS waiting
FROM a LEFT JOIN up USING (id) LEFT JOIN req USING (id) LEFT JOIN dep USING (id) JOIN sib USING (id) ORDER BY urgency, rank, score DESC, above, sibling_ratio DESC, waiting DESC, title, id LIMIT 20""")
def actionable_top20(spark, sf_dir):
    pairs, rows = closed(spark, sf_dir)
    waits = blockers(spark, sf_dir)
    return op.ranked(op.actionable(rows, waits), pairs, rows, 20, held_to(rows), waits)


@query(SQL["actionable_top20"].replace("LIMIT 20", "LIMIT 1"))
def next_task(spark, sf_dir):
    pairs, rows = closed(spark, sf_dir)
    waits = blockers(spark, sf_dir)
    return op.ranked(op.actionable(rows, waits), pairs, rows, 1, held_to(rows), waits)


@query(f"""WITH {ITEMS}, live AS (SELECT parent_id AS id, count(*) AS live FROM items WHERE parent_id IS NOT NULL AND status <> 'deleted' GROUP BY 1), h AS (SELECT i.*, coalesce(live, 0) AS live, p.status AS ps, p.level AS pl FROM items i LEFT JOIN live USING (id) LEFT JOIN items p ON i.parent_id = p.id)
SELECT 'empty_container' AS check, id FROM h WHERE level IN ('epic', 'feature') AND live = 0
UNION ALL SELECT 'stuck', id FROM h WHERE status = 'in_progress' AND (started_at IS NULL OR epoch(TIMESTAMP '{TREE_NOW}') - epoch(started_at) > 172800)
UNION ALL SELECT 'done_parent_open_child', id FROM h WHERE ps = 'completed' AND status IN ('pending', 'in_progress')
UNION ALL SELECT 'too_many_children', id FROM h WHERE level IN ('epic', 'feature') AND live > 20
UNION ALL SELECT 'too_few_children', id FROM h WHERE level IN ('epic', 'feature') AND live = 1""")
def structure_checks(spark, sf_dir):
    return op.structure_checks(items(spark, sf_dir).withColumn("completed_at", F.lit(None).cast("timestamp")), TREE_NOW)


#: The tree with faults: orders without a customer, customers under regions and at the top, orders completed too early, cycles of blockers.
FAULTY = ITEMS + """, faulty AS (SELECT id, CASE WHEN level = 'task' AND right(id, 2) = '03' THEN 'R:1' WHEN level = 'task' AND right(id, 2) = '05' THEN NULL WHEN level = 'subtask' AND right(id, 3) = '007' THEN 'C:none' WHEN level = 'subtask' AND right(id, 3) = '008' THEN 'N:1' ELSE parent_id END AS parent_id,
 level, CASE WHEN right(id, 3) = '009' THEN 'blocked' ELSE status END AS status, title, priority, started_at, CASE WHEN right(id, 2) = '11' THEN started_at - INTERVAL 1 DAY END AS completed_at FROM items),
 waits AS (SELECT 'O:' || o_orderkey AS id, 'O:' || CASE o_orderkey % 100 WHEN 1 THEN o_orderkey + 1 WHEN 2 THEN o_orderkey - 1 WHEN 9 THEN o_orderkey ELSE o_orderkey + 1 END AS blocker FROM orders WHERE o_orderkey % 100 IN (1, 2, 6, 9) AND o_orderkey % 1000 <> 9)"""


@query(f"""WITH {FAULTY}, h AS (SELECT f.*, p.level AS pl FROM faulty f LEFT JOIN faulty p ON f.parent_id = p.id)
SELECT 'misplaced' AS check, id FROM h WHERE level = 'epic' AND parent_id IS NOT NULL OR level = 'feature' AND coalesce(pl, '') <> 'epic' OR level = 'task' AND coalesce(pl, '') NOT IN ('feature', 'epic') OR level = 'subtask' AND coalesce(pl, '') NOT IN ('task', 'subtask')
UNION ALL SELECT 'dangling_parent', id FROM h WHERE parent_id IS NOT NULL AND pl IS NULL
UNION ALL SELECT 'completed_before_start', id FROM h WHERE completed_at < started_at
UNION ALL SELECT 'blocked_by_nothing', id FROM h WHERE status = 'blocked' AND id NOT IN (SELECT id FROM waits)
UNION ALL SELECT 'too_many_roots', NULL FROM faulty WHERE parent_id IS NULL AND status <> 'deleted' HAVING count(*) > 8
UNION ALL SELECT 'blocker_cycle', a.id FROM waits a JOIN waits b ON a.blocker = b.id AND b.blocker = a.id""")
def structure_faults(spark, sf_dir):
    rows, k = items(spark, sf_dir), F.col("o_orderkey")
    ends = lambda s: F.endswith("id", F.lit(s))
    task, sub = F.col("level") == "task", F.col("level") == "subtask"
    parent = F.when(task & ends("03"), "R:1").when(task & ends("05"), None).when(sub & ends("007"), "C:none").when(sub & ends("008"), "N:1").otherwise(F.col("parent_id"))
    rows = rows.withColumns({"parent_id": parent, "status": F.when(ends("009"), "blocked").otherwise(F.col("status")), "completed_at": F.when(ends("11"), F.col("started_at") - F.expr("interval 1 day"))})
    other = F.when(k % 100 == 1, k + 1).when(k % 100 == 2, k - 1).when(k % 100 == 9, k).otherwise(k + 1)
    waits = table(spark, sf_dir, "orders").where((k % 100).isin(1, 2, 6, 9) & (k % 1000 != 9)).select(F.concat(F.lit("O:"), k).alias("id"), F.concat(F.lit("O:"), other).alias("blocker"))
    found = op.structure_checks(rows, TREE_NOW, blocked_by=waits, most_roots=8)
    return found.where(F.col("check").isin("misplaced", "dangling_parent", "completed_before_start", "blocked_by_nothing", "too_many_roots", "blocker_cycle"))


@query(f"WITH {CLOSURE} SELECT 'too_deep' AS check, id FROM closure JOIN items USING (id) WHERE status <> 'deleted' GROUP BY id HAVING max(distance) + 1 > 3")
def deep_items(spark, sf_dir):
    pairs, rows = closed(spark, sf_dir)
    return op.structure_checks(rows.withColumn("completed_at", F.lit(None).cast("timestamp")), TREE_NOW, pairs=pairs, most_levels=3).where(F.col("check") == "too_deep")


@query(f"""WITH {CLOSURE}, s AS (SELECT ancestor AS id, bool_and(status IN ('completed', 'deleted')) AS done, count(*) AS size FROM closure JOIN items USING (id) GROUP BY 1), w AS (SELECT s.id, size, parent_id FROM s JOIN items USING (id) WHERE done AND status = 'completed')
SELECT id, size FROM w WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM w)""")
def prunable(spark, sf_dir):
    return op.prunable(*closed(spark, sf_dir))


#: The tree with most orders completed, so that some parents complete by themselves; some customers are blocked, one region's nations deferred, and some orders deleted.
RIPE = ITEMS + """, ripe AS (SELECT id, parent_id, level, CASE WHEN level = 'subtask' AND right(id, 2) = '63' THEN 'deleted' WHEN level = 'subtask' AND right(id, 2) NOT IN ('17', '40') THEN 'completed' WHEN level = 'subtask' THEN 'pending' WHEN level = 'task' AND right(id, 2) = '29' THEN 'blocked' WHEN level = 'task' THEN 'in_progress' WHEN level = 'feature' AND parent_id IN ('R:1', 'R:3') THEN 'deferred' WHEN id = 'R:3' THEN 'completed' ELSE status END AS status FROM items)"""
LEVELS_UP = "d1 AS (SELECT id, status IN ('completed', 'deferred') AS over, level IN ('epic', 'feature', 'task') AND status IN ('pending', 'in_progress') AND id IN (SELECT parent_id FROM ripe WHERE parent_id IS NOT NULL) AS open, parent_id, level FROM ripe)"


def ripe(spark, sf_dir):
    rows, level = items(spark, sf_dir), F.col("level")
    left = F.substring(F.concat(F.lit("  "), F.col("id")), -2, 2).isin("17", "40")
    status = F.when((level == "subtask") & F.endswith("id", F.lit("63")), "deleted").when((level == "subtask") & ~left, "completed").when(level == "subtask", "pending").when((level == "task") & F.endswith("id", F.lit("29")), "blocked").when(level == "task", "in_progress")
    return rows.withColumn("status", status.when((level == "feature") & F.col("parent_id").isin("R:1", "R:3"), "deferred").when(F.col("id") == "R:3", "completed").otherwise(F.col("status")))


@query(f"""WITH {RIPE}, {LEVELS_UP}, vt AS (SELECT id, over OR open AND NOT EXISTS (SELECT 1 FROM d1 c WHERE c.parent_id = d1.id AND NOT c.over) AS done, open, over, parent_id FROM d1 WHERE level = 'task'),
 vf AS (SELECT id, over OR open AND NOT EXISTS (SELECT 1 FROM vt c WHERE c.parent_id = d1.id AND NOT c.done) AS done, open, over, parent_id FROM d1 WHERE level = 'feature'),
 ve AS (SELECT id, over OR open AND NOT EXISTS (SELECT 1 FROM vf c WHERE c.parent_id = d1.id AND NOT c.done) AS done, open, over, parent_id FROM d1 WHERE level = 'epic')
SELECT id FROM (SELECT * FROM vt UNION ALL SELECT * FROM vf UNION ALL SELECT * FROM ve) WHERE open AND NOT over AND done""")
def auto_completable(spark, sf_dir):
    rows = ripe(spark, sf_dir)
    return op.auto_completable(op.closure_of_levels(rows, TREE_LEVELS), rows)


@query(f"WITH {RIPE} SELECT p.id FROM ripe p JOIN ripe c ON c.parent_id = p.id WHERE p.status IN ('pending', 'in_progress') GROUP BY 1 HAVING bool_and(c.status IN ('completed', 'deferred'))")
def completable_parents(spark, sf_dir):
    return op.completable_parents(ripe(spark, sf_dir))


@query(f"""WITH {RIPE}, chain AS (SELECT t.id AS parent, t.id, 0 AS n, t.status FROM ripe t WHERE level = 'subtask' UNION ALL SELECT t.id, p.id, 1, p.status FROM ripe t JOIN ripe p ON p.id = t.parent_id WHERE t.level = 'subtask'
 UNION ALL SELECT t.id, g.id, 2, g.status FROM ripe t JOIN ripe p ON p.id = t.parent_id JOIN ripe g ON g.id = p.parent_id WHERE t.level = 'subtask'), stop AS (SELECT parent, min(n) AS upto FROM chain WHERE status <> 'completed' GROUP BY 1)
SELECT parent, id FROM chain LEFT JOIN stop USING (parent) WHERE upto IS NULL OR n < upto""")
def parent_resets(spark, sf_dir):
    rows = ripe(spark, sf_dir)
    return op.parent_resets(op.closure_of_levels(rows, TREE_LEVELS).where("distance < 3"), rows, rows.where("level = 'subtask'"))


@query(f"WITH {CLOSURE} SELECT DISTINCT ancestor AS id FROM closure JOIN items USING (id) WHERE priority = 'critical' AND status = 'in_progress'")
def visible_with_ancestors(spark, sf_dir):
    return op.visible(*closed(spark, sf_dir), (F.col("priority") == "critical") & (F.col("status") == "in_progress"))


REQUIREMENTS = "SELECT 'N:' || n_nationkey AS id, 'nation ' || (n_nationkey % 4) AS requirement FROM nation UNION ALL SELECT 'R:' || r_regionkey, 'nation ' || (r_regionkey % 4) FROM region UNION ALL SELECT 'C:' || c_custkey, c_mktsegment FROM customer"


@query(f"WITH {CLOSURE}, r AS ({REQUIREMENTS}) SELECT c.id, requirement, min(distance) AS distance FROM closure c JOIN r ON r.id = c.ancestor GROUP BY 1, 2")
def requirements_inherited(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    named = lambda k: F.concat(F.lit("nation "), F.col(k) % 4)
    rows = t("nation").select(F.concat(F.lit("N:"), F.col("n_nationkey")).alias("id"), named("n_nationkey").alias("requirement"))
    rows = rows.union(t("region").select(F.concat(F.lit("R:"), F.col("r_regionkey")), named("r_regionkey"))).union(t("customer").select(F.concat(F.lit("C:"), F.col("c_custkey")), "c_mktsegment"))
    return op.inherited(closed(spark, sf_dir)[0], rows)


@query(f"""WITH {ITEMS}, kids AS (SELECT parent_id AS id, count(*) FILTER (status <> 'deleted') AS live FROM items WHERE parent_id IS NOT NULL GROUP BY 1), h AS (SELECT i.*, coalesce(live, 0) AS live, level IN ('task', 'subtask') AS work, level IN ('epic', 'feature') AS box,
  status = 'in_progress' AND epoch(TIMESTAMP '{TREE_NOW}') - epoch(started_at) > 172800 AS stale, status NOT IN ('completed', 'deferred') AS active, length(title) % 3 <> 0 AS described, length(title) % 2 = 0 AS criteria FROM items i LEFT JOIN kids USING (id)),
 p AS (SELECT floor(greatest(0.0, 100 - (count(*) FILTER (parent_id IS NULL AND level <> 'epic') + 2 * count(*) FILTER (parent_id IS NULL AND work)) / count(*) * 200) + 0.5) AS depth,
  floor(greatest(0.0, 100 - count(*) FILTER (work AND NOT described) / count(*) FILTER (work) * 30 - count(*) FILTER (work AND NOT criteria) / count(*) FILTER (work) * 20 - count(*) FILTER (work AND length(title) < 10) / count(*) FILTER (work) * 15 - count(*) FILTER (box AND live = 1) / count(*) FILTER (box) * 15) + 0.5) AS granularity,
  floor((count(*) FILTER (described) + count(*) FILTER (work AND criteria) + count(*) FILTER (work AND priority IS NOT NULL) + count(*) FILTER (box AND live > 0)) / (3 * count(*) FILTER (work) + 2 * count(*) FILTER (box)) * 100 + 0.5) AS completeness,
  floor(greatest(0.0, 100 - count(*) FILTER (active AND coalesce(stale, false)) / count(*) FILTER (active) * 150) + 0.5) AS staleness FROM h),
 cv AS (SELECT parent_id, count(*) AS m, stddev_pop(live) / nullif(avg(live), 0) AS cv FROM h WHERE box GROUP BY 1 HAVING count(*) >= 2), b AS (SELECT floor(greatest(0.0, 100 - avg(cv) * 50) + 0.5) AS balance FROM cv)
SELECT CAST(depth AS BIGINT) AS depth, CAST(granularity AS BIGINT) AS granularity, CAST(completeness AS BIGINT) AS completeness, CAST(staleness AS BIGINT) AS staleness, CAST(balance AS BIGINT) AS balance,
 CAST(floor(depth * 0.15 + balance * 0.2 + granularity * 0.2 + completeness * 0.25 + staleness * 0.2 + 0.5) AS BIGINT) AS overall FROM p, b""")
def health_scores(spark, sf_dir):
    rows = items(spark, sf_dir).withColumns({"description": F.when(F.length("title") % 3 != 0, F.lit("x")), "n_criteria": F.when(F.length("title") % 2 == 0, 1).otherwise(0)})
    out = op.health(rows, TREE_NOW)
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("depth", "granularity", "completeness", "staleness", "balance", "overall")))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def orphaned_facts(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return op.orphans(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")), held).select(F.col("item_id").alias("o_orderkey"))
