"""Queries over files, imports, findings and references, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnworks.operators import inventory as op
from tarnworks.operators import items as it
from tarnworks.plans.tables import CLOSURE, ITEMS, TRADE, ZONES, items, table, trade, zones
from tarnworks.plans.trees import closed

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT p_brand AS language, p_type AS role, CAST(p_size % 5 AS VARCHAR) AS category, count(*) AS files, CAST(sum(p_size) AS BIGINT) AS lines FROM part GROUP BY GROUPING SETS ((language), (role), (category), ())")
def inventory_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("language"), F.col("p_type").alias("role"), (F.col("p_size") % 5).cast("string").alias("category"), F.col("p_size").cast("long").alias("lines"))
    return op.file_summary(rows)


@query("""WITH f AS (SELECT s_nationkey AS k, count(*) AS files FROM supplier GROUP BY 1), e AS (SELECT s_nationkey AS k, count(*) AS edges, count(DISTINCT l_partkey) AS packages, count(*) FILTER (l_returnflag = 'R') AS cycles FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
 r AS (SELECT f.k AS nation, files * 40 AS files, edges, packages, cycles // 10 AS cycles, edges / (files * 40) AS pf, packages / (files * 40) AS o FROM f JOIN e USING (k))
SELECT nation, files, edges, CASE WHEN edges = 0 OR files = 0 THEN 'absent' WHEN edges / files < 0.25 THEN 'sparse' ELSE 'rich' END AS density,
 CAST(floor(0.4 * greatest(0.0, 100 - 500 * cycles / files) + 0.3 * CASE WHEN pf <= 8 THEN 100.0 WHEN pf <= 15 THEN 100 - (pf - 8) / 7 * 50 ELSE greatest(0.0, 50 - (pf - 15) * 5) END + 0.3 * CASE WHEN o <= 3 THEN 100.0 ELSE greatest(0.0, 100 - (o - 3) * 20) END + 0.5) AS BIGINT) AS health FROM r""")
def import_health(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    files = s.groupBy(F.col("s_nationkey").alias("nation")).agg((F.count("*") * 40).alias("files"))
    edges = table(spark, sf_dir, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("edges"), F.count_distinct("l_partkey").alias("packages"), F.floor(F.count_if(F.col("l_returnflag") == "R") / 10).alias("cycles"))
    rows = files.join(edges, "nation")
    return rows.select("nation", "files", "edges", op.import_density(F.col("edges"), F.col("files")).alias("density"), op.import_health(F.col("cycles"), F.col("edges"), F.col("packages"), F.col("files")).cast("long").alias("health"))


@query(f"""WITH {TRADE}, {ZONES}, z AS (SELECT a.zone AS a, b.zone AS b FROM trade JOIN zones a ON a.path = src JOIN zones b ON b.path = dst), e AS (SELECT a AS zone, CASE WHEN a = b THEN 'inside' ELSE 'out' END AS kind FROM z UNION ALL SELECT b, 'into' FROM z WHERE a <> b)
SELECT zone, count(*) FILTER (kind = 'inside') AS inside, count(*) FILTER (kind = 'out') AS "out", count(*) FILTER (kind = 'into') AS "into" FROM e GROUP BY 1""")
def zone_call_stats(spark, sf_dir):
    return op.zone_call_stats(trade(spark, sf_dir), zones(spark, sf_dir))


@query(f"""WITH {TRADE}, {ZONES}, z AS (SELECT src, dst, a.zone AS a, b.zone AS b FROM trade JOIN zones a ON a.path = src JOIN zones b ON b.path = dst WHERE a.zone <> b.zone) SELECT path, other_zone, count(*) AS n FROM (SELECT src AS path, b AS other_zone FROM z UNION ALL SELECT dst, a FROM z) GROUP BY 1, 2""")
def connection_map(spark, sf_dir):
    return op.connection_map(trade(spark, sf_dir), zones(spark, sf_dir))


PATHS = r"p AS (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^?#]+)', 1) AS path FROM pages)"


@query(rf"""WITH {PATHS}, k AS (SELECT DISTINCT regexp_extract(path, '([^/]+)$', 1) AS known FROM p UNION SELECT DISTINCT 'x/' || path FROM p WHERE length(path) % 2 = 0)
SELECT path AS changed, known FROM p JOIN k ON path = known OR ends_with(path, '/' || known) OR ends_with(known, '/' || path)""")
def suffix_matches(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1).alias("path")).distinct()
    known = p.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path")).union(p.where(F.length("path") % 2 == 0).select(F.concat(F.lit("x/"), "path"))).distinct()
    return op.suffix_matches(p, known)


@query(rf"""WITH {PATHS}, r AS (SELECT DISTINCT regexp_extract(path, '^([^/]+)', 1) AS root FROM p UNION SELECT DISTINCT regexp_extract(path, '^([^/]+/[^/]+)', 1) FROM p WHERE length(path) % 3 = 0)
SELECT path, arg_max(root, length(root)) AS root FROM p JOIN r ON path = root OR starts_with(path, root || '/') GROUP BY 1""")
def package_prefixes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"^[a-z]+://([^?#]+)", 1).alias("path")).distinct()
    roots = p.select(F.regexp_extract("path", r"^([^/]+)", 1).alias("root")).union(p.where(F.length("path") % 3 == 0).select(F.regexp_extract("path", r"^([^/]+/[^/]+)", 1))).distinct()
    return op.package_prefix(p, roots)


@query("""WITH s AS (SELECT p_name AS path, least(1.0, CASE WHEN p_name LIKE 'small%' THEN 0.5 ELSE 0 END + CASE WHEN p_name LIKE '%ring%' THEN 0.35 ELSE 0 END) AS a, least(1.0, CASE WHEN p_name LIKE '%widget%' THEN 0.6 ELSE 0 END + CASE WHEN p_name LIKE '%ring%' THEN 0.3 ELSE 0 END) AS b FROM (SELECT DISTINCT p_name FROM part))
SELECT path, CASE WHEN greatest(a, b) >= 0.4 THEN CASE WHEN a >= b THEN 'tool' ELSE 'part' END END AS archetype, floor(greatest(a, b) * 10000.0 + 0.5) / 10000.0 AS score, CASE WHEN greatest(a, b) >= 0.4 AND least(a, b) >= 0.3 THEN CASE WHEN a >= b THEN 'part' ELSE 'tool' END END AS second FROM s""")
def archetypes(spark, sf_dir):
    rules = [("tool", "^small", 0.5), ("tool", "ring", 0.35), ("part", "widget", 0.6), ("part", "ring", 0.3)]
    return op.classified(table(spark, sf_dir, "part").select(F.col("p_name").alias("path")).distinct(), rules)


@query("""WITH f AS (SELECT event_id AS id, CAST(user_id % 5 AS VARCHAR) AS scope, event_type AS category, CASE WHEN value > 50 THEN 'critical' WHEN value > 10 THEN 'warning' ELSE 'info' END AS severity FROM events), r AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY scope, category ORDER BY id) - 1) / 3) AS BIGINT) AS part FROM f)
SELECT scope, category, part, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM r GROUP BY 1, 2, 3""")
def recommendation_chunks(spark, sf_dir):
    severity = F.when(F.col("value") > 50, "critical").when(F.col("value") > 10, "warning").otherwise("info")
    return op.recommendations(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 5).cast("string").alias("scope"), F.col("event_type").alias("category"), severity.alias("severity")))


@query("""WITH c AS (SELECT p_brand AS community, split_part(p_name, ' ', 1) AS directory, count(*) AS n FROM part GROUP BY 1, 2), b AS (SELECT community, arg_min(directory, (-n, directory)) AS zone, CAST(sum(n) AS BIGINT) AS size FROM c GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY zone ORDER BY size DESC, community) AS rn FROM b)
SELECT community, CASE WHEN rn = 1 THEN zone ELSE zone || '-' || rn END AS zone FROM r""")
def zone_names(spark, sf_dir):
    return op.derived_zone_names(table(spark, sf_dir, "part").select(F.col("p_brand").alias("community"), F.split("p_name", " ")[0].alias("directory")))


@query("SELECT split_part(p_type, ' ', 1) AS value, count(*) AS items FROM part GROUP BY 1")
def facet_distribution(spark, sf_dir):
    tags = F.array(F.lit("x"), F.concat(F.lit("kind:"), F.split("p_type", " ")[0]))
    return it.facet_distribution(table(spark, sf_dir, "part").select(tags.alias("tags")), "kind")


@query(f"""WITH {CLOSURE}, w AS (SELECT id, status = 'completed' AS done, id LIKE '%7' AS gone FROM items WHERE level IN ('task', 'subtask')), r AS (SELECT ancestor AS id, done, NOT gone AS stays FROM closure JOIN w USING (id) WHERE ancestor LIKE 'R:%')
SELECT id, count(*) AS before, count(*) FILTER (stays) AS after, CAST(floor(100.0 * count(*) FILTER (done) / count(*) + 0.5) AS BIGINT) AS percent_before, CAST(floor(100.0 * count(*) FILTER (done AND stays) / count(*) FILTER (stays) + 0.5) AS BIGINT) AS percent_after FROM r GROUP BY 1""")
def epic_impact(spark, sf_dir):
    pairs, rows = closed(spark, sf_dir)
    return it.epic_impact(pairs, rows, rows.where("id like '%7'"))


@query(f"WITH {ITEMS} SELECT id FROM items WHERE status IN ('pending', 'blocked') AND id NOT IN (SELECT parent_id FROM items WHERE parent_id IS NOT NULL)")
def pending_leaves(spark, sf_dir):
    return it.pending_leaves(items(spark, sf_dir))


@query(f"""WITH {CLOSURE}, q AS (SELECT id, priority, CASE WHEN length(title) % 3 = 0 THEN 'security' ELSE 'other' END AS category FROM items WHERE level <> 'subtask')
SELECT c.id, CAST(sum(1 + CASE coalesce(q.priority, 'medium') WHEN 'critical' THEN 6 WHEN 'high' THEN 4 WHEN 'medium' THEN 1 ELSE 0 END + CASE WHEN category = 'security' THEN 4 ELSE 0 END) AS BIGINT) AS score FROM closure c JOIN q ON q.id = c.ancestor GROUP BY 1""")
def requirement_scores(spark, sf_dir):
    pairs, rows = closed(spark, sf_dir)
    category = F.when(F.length("title") % 3 == 0, "security").otherwise("other")
    return it.requirement_scores(pairs, rows.where("level != 'subtask'").select("id", F.col("id").alias("requirement"), "priority", category.alias("category")))


@query("""WITH t AS (SELECT CAST(p_partkey % 40 AS VARCHAR) AS typed, p_name AS name FROM part), k AS (SELECT DISTINCT p_brand AS typed FROM part), c AS (SELECT DISTINCT 'Brand#' || (p_partkey % 9) AS command FROM part)
SELECT typed, command, CAST(levenshtein(typed, command) AS INT) AS distance FROM k, c WHERE levenshtein(typed, command) BETWEEN 1 AND 2""")
def command_suggestions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return it.suggestions(part.select(F.col("p_brand").alias("typed")).distinct(), part.select(F.concat(F.lit("Brand#"), F.col("p_partkey") % 9).alias("command")).distinct())
