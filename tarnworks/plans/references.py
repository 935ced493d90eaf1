"""Queries over references between items, files, findings and merges, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnworks.functions import text
from tarnworks.operators import findings as fd
from tarnworks.operators import history as hs
from tarnworks.operators import inventory as inv
from tarnworks.operators import items as it
from tarnworks.operators import sync, telemetry
from tarnworks.operators import tree as tr
from tarnworks.operators.reshape import ACTION, Reshaped
from tarnworks.plans.columns import picked, picked_sql
from tarnworks.plans.tables import CLOSURE, ITEMS, TREE_LEVELS, items, table
from tarnworks.plans.texts import likeness
from tarnworks.plans.trees import closed

QUERIES, SQL = {}, {}
#: Items that are deleted or lie below one that is.
GONE = "SELECT c.id FROM closure c JOIN items a ON a.id = c.ancestor WHERE a.status = 'deleted'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add



@query(f"WITH {ITEMS} SELECT event_id AS id, 'c:' || (user_id * 11) AS item FROM events WHERE 'C:' || (user_id * 11) IN (SELECT id FROM items) UNION SELECT event_id, 'o:' || event_id FROM events WHERE event_id % 2 = 0 AND 'O:' || event_id IN (SELECT id FROM items)")
def message_references(spark, sf_dir):
    said = F.concat(F.lit("Closes C:"), F.col("user_id") * 11, F.lit(" and c:"), F.col("user_id") * 11, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(", see O:"), "event_id")).otherwise(""))
    known = items(spark, sf_dir).select(F.lower("id").alias("id"))
    return it.references(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), said.alias("text")), known, r"([co]:\d+)").select("id", "item")


@query("""WITH n AS (SELECT DISTINCT p_name AS name FROM part), w AS (SELECT name, unnest(string_split(name, ' ')) AS word FROM n WHERE name <> ''), d AS (SELECT DISTINCT name, word FROM w WHERE length(word) > 2), t AS (SELECT DISTINCT p_type AS type FROM part)
SELECT a.name AS criterion, b.name AS test, count(*) AS shared FROM d a JOIN d b USING (word) GROUP BY 1, 2 HAVING count(*) >= 2""")
def criteria_tests(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    return it.criteria_coverage(names.select(F.col("name").alias("criterion"), F.col("name").alias("text")), names.select(F.col("name").alias("test"), F.concat(F.lit("the "), "name").alias("text")))


@query("SELECT requirement, array_to_string(list_sort(list_distinct(list(CAST(id AS VARCHAR)))), ',') AS items FROM (SELECT p_partkey AS id, p_brand AS requirement FROM part UNION ALL SELECT p_partkey, p_type FROM part) GROUP BY 1")
def traceability(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), F.array("p_brand", "p_type").alias("requirements"))
    return it.traceability(rows).withColumn("items", F.array_join("items", ","))


def waiting(spark, sf_dir):
    """Orders with blockers: the half, the third and the next key."""
    k = F.col("o_orderkey")
    half, third = F.floor(k / 2).cast("long"), F.floor(k / 3).cast("long")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k % 4 == 3, F.array().cast("array<bigint>")).otherwise(F.array(half, third)).alias("blocked_by"))


WAITING = "w AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 3 THEN [] ELSE [o_orderkey // 2, o_orderkey // 3] END AS blocked_by FROM orders), f AS (SELECT id, unnest(blocked_by) AS b FROM w)"


@query(f"""WITH {WAITING}, m AS (SELECT id, CASE WHEN b % 10 = 7 THEN b - 1 ELSE b END AS b FROM f), g AS (SELECT id, list_sort(list_distinct(list(b) FILTER (b <> id))) AS bs FROM m GROUP BY 1)
SELECT w.id, coalesce(array_to_string(bs, ','), '') AS blocked_by FROM w LEFT JOIN g USING (id) WHERE w.id % 10 <> 7""")
def merged_items(spark, sf_dir):
    merges = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 7").select(F.col("o_orderkey").alias("gone"), (F.col("o_orderkey") - 1).alias("survivor"))
    return it.merged_into(waiting(spark, sf_dir), merges).select("id", F.array_join("blocked_by", ",").alias("blocked_by"))


@query(f"WITH {WAITING}, g AS (SELECT id, list_sort(list_distinct(list(b))) AS bs FROM f WHERE b NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 = 0) GROUP BY 1) SELECT w.id, coalesce(array_to_string(bs, ','), '') AS blocked_by FROM w LEFT JOIN g USING (id)")
def cleaned_references(spark, sf_dir):
    removed = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("id"))
    return it.without_references(waiting(spark, sf_dir), removed).select("id", F.array_join("blocked_by", ",").alias("blocked_by"))


@query(f"WITH {WAITING} SELECT b AS id, count(*) AS dependents FROM f GROUP BY 1")
def dependents(spark, sf_dir):
    return tr.dependents(waiting(spark, sf_dir))


@query("""WITH c AS (SELECT CAST(l_suppkey % 40 AS VARCHAR) AS file, 'f' || (l_partkey % 300) AS callee FROM lineitem), f AS (SELECT DISTINCT CAST(p_partkey % 50 AS VARCHAR) AS file, 'f' || (p_partkey % 200) AS name FROM part UNION SELECT '77', 'f250'), i AS (SELECT DISTINCT CAST(l_suppkey % 40 AS VARCHAR) AS src, CAST(l_orderkey % 50 AS VARCHAR) AS dst FROM lineitem WHERE l_orderkey % 6 = 0),
 near AS (SELECT src AS file, name AS callee, min(f.file) AS near FROM i JOIN f ON f.file = dst GROUP BY 1, 2), single AS (SELECT name AS callee, min(file) AS single FROM f GROUP BY 1 HAVING count(DISTINCT file) = 1),
 r AS (SELECT c.file, c.callee, o.file AS own, near, single FROM c LEFT JOIN f o ON o.file = c.file AND o.name = c.callee LEFT JOIN near n ON n.file = c.file AND n.callee = c.callee LEFT JOIN single s ON s.callee = c.callee)
SELECT file, callee, coalesce(own, near, single) AS target, CASE WHEN own IS NOT NULL THEN 'own' WHEN near IS NOT NULL THEN 'imported' WHEN single IS NOT NULL THEN 'single' ELSE 'unresolved' END AS how, count(*) AS calls FROM r GROUP BY 1, 2, 3, 4""")
def resolved_calls(spark, sf_dir):
    line, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    s = lambda c: c.cast("string")
    calls = line.select(s(F.col("l_suppkey") % 40).alias("file"), F.concat(F.lit("f"), F.col("l_partkey") % 300).alias("callee"))
    functions = part.select(s(F.col("p_partkey") % 50).alias("file"), F.concat(F.lit("f"), F.col("p_partkey") % 200).alias("name")).distinct().union(part.limit(1).select(F.lit("77"), F.lit("f250")))
    imports = line.where("l_orderkey % 6 = 0").select(s(F.col("l_suppkey") % 40).alias("from"), s(F.col("l_orderkey") % 50).alias("to")).distinct()
    return inv.resolved_calls(calls, functions, imports).groupBy("file", "callee", "target", "how").agg(F.count("*").alias("calls"))


@query("""WITH u AS (SELECT l_suppkey AS file, l_partkey % 25 AS component, CAST(l_quantity AS BIGINT) AS n FROM lineitem), i AS (SELECT DISTINCT l_suppkey AS file, l_partkey % 25 AS component, l_partkey % 5 AS target FROM lineitem WHERE l_orderkey % 9 = 0)
SELECT component, "to", CAST(sum(uses) AS BIGINT) AS uses FROM (SELECT file AS "from", target AS "to", component, sum(n) AS uses FROM u JOIN i USING (file, component) GROUP BY 1, 2, 3) GROUP BY 1, 2 ORDER BY uses DESC, "to", component LIMIT 20""")
def used_components(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    usage = line.select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 25).alias("component"), F.col("l_quantity").cast("long").alias("n"))
    imports = line.where("l_orderkey % 9 = 0").select(F.col("l_suppkey").alias("file"), (F.col("l_partkey") % 25).alias("component"), (F.col("l_partkey") % 5).alias("target")).distinct()
    return hs.component_summary(hs.component_usage(usage, imports))


@query("SELECT p_brand AS file, p_name AS name FROM (SELECT DISTINCT p_brand, p_name FROM part) WHERE (p_brand, p_name) NOT IN (SELECT (p_brand, p_name) FROM part WHERE p_size < 20) AND (p_brand, p_name) NOT IN (SELECT (p_brand, p_name) FROM part WHERE p_partkey % 4 = 0)")
def dead_exports(spark, sf_dir):
    from tarnworks.operators.graph import dead_exports as dead

    part = table(spark, sf_dir, "part")
    named = lambda rows: rows.select(F.col("p_brand").alias("file"), F.col("p_name").alias("name")).distinct()
    return dead(named(part), named(part.where("p_size < 20")), named(part.where("p_partkey % 4 = 0")))


@query("""WITH e AS (SELECT DISTINCT s_name AS src, 'entry' || n_regionkey AS dst, 'R' || n_regionkey AS package FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2) SELECT src AS "from", dst AS "to", package FROM e""")
def external_edges(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    external = rows.groupBy(F.concat(F.lit("R"), "n_regionkey").alias("package")).agg(F.collect_list("s_name").alias("importedBy"))
    packages = n.where("n_regionkey != 2").select(F.concat(F.lit("R"), "n_regionkey").alias("package"), F.concat(F.lit("entry"), "n_regionkey").alias("entry")).distinct()
    return inv.external_edges(external, packages)


@query("""WITH z AS (SELECT s_name, 'Z' || s_nationkey AS zone FROM supplier), e AS (SELECT DISTINCT s_name, 'R' || n_regionkey AS package FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey <> 2) SELECT zone AS from_zone, package AS to_zone, count(*) AS n FROM e JOIN z USING (s_name) GROUP BY 1, 2""")
def external_flows(spark, sf_dir):
    zones = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("path"), F.concat(F.lit("Z"), "s_nationkey").alias("zone"))
    edges = external_edges(spark, sf_dir)
    homes = edges.select(F.col("to").alias("path"), F.col("package").alias("zone")).distinct()
    from tarnworks.operators.graph import zone_flows

    return zone_flows(edges.select("from", "to"), zones.unionByName(homes))


@query("""WITH p AS (SELECT DISTINCT 'P' || l_partkey AS path FROM lineitem WHERE l_partkey % 50 = 0), e AS (SELECT DISTINCT 'P' || l_partkey AS a, 'S' || l_suppkey AS b FROM lineitem)
SELECT p.path, p_size AS lines, p_brand AS zone, (SELECT array_to_string(list_sort(list(b)), ',') FROM e WHERE a = p.path) AS imports, NULL::VARCHAR AS imported_by FROM p LEFT JOIN part ON 'P' || p_partkey = p.path""")
def file_info(spark, sf_dir):
    part, line = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    name = lambda p, c: F.concat(F.lit(p), c)
    asked = line.where("l_partkey % 50 = 0").select(name("P", "l_partkey").alias("path")).distinct()
    edges = line.select(name("P", "l_partkey").alias("from"), name("S", "l_suppkey").alias("to"))
    rows = inv.file_info(asked, part.select(name("P", "p_partkey").alias("path"), F.col("p_size").alias("lines")), part.select(name("P", "p_partkey").alias("path"), F.col("p_brand").alias("zone")), edges)
    return rows.select("path", "lines", "zone", F.array_join("imports", ",").alias("imports"), F.array_join("imported_by", ",").alias("imported_by"))


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_name LIKE '%ring%' AND p_type = 'ECONOMY') AS total FROM part WHERE p_name LIKE '%ring%' AND p_type = 'ECONOMY' ORDER BY p_partkey LIMIT 50 OFFSET 5")
def file_search_page(spark, sf_dir):
    rows = table(spark, sf_dir, "part").where(F.contains(F.lower("p_name"), F.lit("ring")) & (F.col("p_type") == "ECONOMY")).select("p_partkey", "p_name")
    return inv.page(rows, 50, "p_partkey", offset=5)


@query("SELECT p_brand AS zone, count(*) AS files, CAST(sum(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END) AS BIGINT) AS lines FROM part GROUP BY 1")
def zone_line_counts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return inv.zone_summary(part.select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("zone")), part.where("p_partkey % 3 != 0").select(F.col("p_partkey").alias("path"), F.col("p_size").cast("long").alias("lines")))


@query("""WITH z AS (SELECT p_brand AS b, p_type AS t, count(DISTINCT p_partkey) AS n, avg(p_size) / 100.0 AS c FROM part GROUP BY 1, 2) SELECT lower(t) AS key, min(CASE WHEN right(b, 1) = '1' THEN upper(t) || ' ' ELSE lower(t) END) AS name, floor(sum(c * n) / sum(n) * 10000.0 + 0.5) / 10000.0 AS cohesion, floor(sum((1 - c) * n) / sum(n) * 10000.0 + 0.5) / 10000.0 AS coupling, CAST(sum(n) AS BIGINT) AS files FROM z GROUP BY 1""")
def merged_zones(spark, sf_dir):
    name = F.when(F.endswith("p_brand", F.lit("1")), F.concat(F.upper("p_type"), F.lit(" "))).otherwise(F.lower("p_type"))
    zones = table(spark, sf_dir, "part").groupBy("p_brand", name.alias("name")).agg(F.collect_set("p_partkey").alias("files"), (F.avg("p_size") / 100.0).alias("cohesion"), (1 - F.avg("p_size") / 100.0).alias("coupling"))
    return inv.merged_zones(zones).withColumn("files", F.size("files").cast("long"))


@query("SELECT p_partkey AS path, CASE WHEN p_partkey % 2 = 0 THEN p_type WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 5 = 0 THEN 'rest' END AS archetype FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0")
def merged_classes(spark, sf_dir):
    layer = lambda n, c: table(spark, sf_dir, "part").where(f"p_partkey % {n} = 0").select(F.col("p_partkey").alias("path"), c.alias("archetype"))
    return inv.merged_classes(layer(2, F.col("p_type")), layer(3, F.col("p_brand")), layer(5, F.lit("rest")))


@query("""WITH f AS (SELECT o_orderkey AS id, unnest(['P' || (o_orderkey % 3000) || '.ts', 'P' || (o_orderkey % 2500) || '.ts', 'some words']) AS path FROM orders) SELECT id FROM f WHERE path LIKE '%.ts' GROUP BY 1 HAVING NOT bool_or(path IN (SELECT 'P' || p_partkey || '.ts' FROM part))""")
def stale_findings(spark, sf_dir):
    named = lambda n: F.concat(F.lit("P"), F.col("o_orderkey") % n, F.lit(".ts"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.array(named(3000), named(2500), F.lit("some words")).alias("related"))
    return inv.stale_findings(rows, table(spark, sf_dir, "part").select(F.concat(F.lit("P"), "p_partkey", F.lit(".ts")).alias("path")))


HASHED = "f AS (SELECT event_id AS id, substr(sha256(CAST(event_id AS VARCHAR)), 1, 12) AS hash FROM events), a AS (SELECT CASE WHEN id % 3 = 0 THEN hash ELSE substr(hash, 1, 4 + CAST(id % 7 AS INT)) END AS hash FROM f WHERE id % 10 = 1)"


@query(f"WITH {HASHED}, s AS (SELECT DISTINCT hash FROM a WHERE length(hash) < 12), m AS (SELECT s.hash, min(f.id) AS id, count(DISTINCT f.id) AS n FROM s JOIN f ON starts_with(f.hash, s.hash) GROUP BY 1) SELECT id FROM f WHERE hash IN (SELECT hash FROM a) UNION SELECT id FROM m WHERE n = 1")
def acknowledged(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 12).alias("hash"))
    known = rows.where("id % 10 = 1").select(F.when(F.col("id") % 3 == 0, F.col("hash")).otherwise(F.substring("hash", F.lit(1), (4 + F.col("id") % 7).cast("int"))).alias("hash"))
    return inv.acknowledged(rows, known)


#: Texts of findings that differ by a word or more, by key.
SAID = ("cache is read in many places of the code", "the cache is read in many places of code", "login has no test of its own", "log in has no tests of its own", "unused export of a helper", "zone is too large for one team")


@query(f"""WITH f AS (SELECT p_partkey AS id, p_type AS type, p_brand AS scope, {picked_sql('p_partkey', *SAID)} AS text FROM part), k AS (SELECT DISTINCT type, scope, text FROM f WHERE id % 7 = 0), g AS (SELECT DISTINCT text AS t, list_distinct(list_transform(range(1, length(text)), lambda i: substring(text, CAST(i AS BIGINT), 2))) AS g FROM f)
SELECT DISTINCT f.id FROM f JOIN k USING (type, scope) JOIN g a ON a.t = f.text JOIN g b ON b.t = k.text WHERE f.id % 7 = 0 OR 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) >= 0.65""")
def known_findings(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_type").alias("type"), F.col("p_brand").alias("scope"), F.sha2(k.cast("string"), 256).alias("hash"), picked(k, *SAID).alias("text"))
    return fd.known_by_text(rows, rows.where("id % 7 = 0").drop("id"))


@query(f"WITH f AS (SELECT p_partkey AS id, {picked_sql('p_partkey', 'Duplicated code in two files', 'The zone should be split', 'naming convention differs', 'it might be slow', 'If this grows, then split the zone', 'a well-defined API', 'unit test has coupling', 'x is not detected by any cluster')} AS text, {picked_sql('p_partkey', 'anti-pattern', 'pattern', 'observation')} AS type, {picked_sql('p_partkey', 'warning', 'critical', 'info', 'warning', 'warning')} AS severity, p_partkey % 2 AS round FROM part)" + """
SELECT id, CASE WHEN text LIKE 'Dup%' THEN 'code' WHEN text LIKE '%zone%' THEN 'structural' WHEN text LIKE 'naming%' THEN 'documentation' END AS category, text LIKE 'it might%' OR text LIKE 'If this%' AS supposed,
 CASE WHEN round >= 1 AND (text LIKE '%well-defined%' OR type = 'anti-pattern' AND text LIKE 'unit test%' OR text LIKE '%not detected%') THEN 'info' ELSE severity END AS severity FROM f""")
def finding_classes(spark, sf_dir):
    k = F.col("p_partkey")
    said = picked(k, "Duplicated code in two files", "The zone should be split", "naming convention differs", "it might be slow", "If this grows, then split the zone", "a well-defined API", "unit test has coupling", "x is not detected by any cluster")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), said.alias("text"), picked(k, "anti-pattern", "pattern", "observation").alias("type"), picked(k, "warning", "critical", "info", "warning", "warning").alias("severity"), (k % 2).alias("round"))
    return rows.select("id", fd.category(F.col("text")).alias("category"), fd.is_supposition(F.col("text")).alias("supposed"), fd.enforced_severity(F.col("text"), F.col("type"), F.col("severity"), F.col("round")).alias("severity"))


def graded(spark, sf_dir):
    k = F.col("event_id")
    related = F.transform(F.sequence(F.lit(1).cast("long"), k % 7 + 1), lambda i: F.concat(F.lit("f"), (k * i) % 90))
    return table(spark, sf_dir, "events").select(k.alias("id"), (k % 3).alias("round"), picked(k, *fd.TYPE_ORDER).alias("type"), F.concat(F.lit("z"), F.col("user_id") % 9).alias("scope"), picked(k, "critical", "warning", "info", "warning").alias("severity"), F.concat(F.lit("t"), k).alias("text"), related.alias("related"))


GRADED = f"g AS (SELECT event_id AS id, event_id % 3 AS round, {picked_sql('event_id', *fd.TYPE_ORDER)} AS type, 'z' || (user_id % 9) AS scope, {picked_sql('event_id', 'critical', 'warning', 'info', 'warning')} AS severity, 't' || event_id AS text, list_transform(range(1, event_id % 7 + 2), lambda i: 'f' || ((event_id * i) % 90)) AS related FROM events)"


@query(f"WITH {GRADED} SELECT id, row_number() OVER (ORDER BY round, CASE type WHEN 'observation' THEN 0 WHEN 'pattern' THEN 1 WHEN 'relationship' THEN 2 WHEN 'anti-pattern' THEN 3 ELSE 4 END, scope, text) AS place FROM g ORDER BY place LIMIT 100")
def findings_in_order(spark, sf_dir):
    from pyspark.sql import Window

    first = fd.ordered(graded(spark, sf_dir)).limit(100)
    place = F.row_number().over(Window.orderBy("round", fd.rank_in(F.col("type"), fd.TYPE_ORDER), "scope", "text"))
    return first.select("id", place.cast("long").alias("place"))


@query(f"""WITH {GRADED}, z AS (SELECT 'z' || k AS scope, 1 - CASE WHEN k % 3 = 0 THEN 0.2 ELSE 0.6 END + 0.4 AS penalty, ' Files: a' || k || ', b, c' AS shown FROM range(0, 8) t(k)),
 n AS (SELECT g.* REPLACE (text || repeat('x', id % 100) AS text), CASE WHEN severity = 'critical' THEN 'fix' WHEN type = 'suggestion' THEN 'suggestion' WHEN severity = 'info' THEN NULL WHEN type = 'anti-pattern' THEN 'refactor' WHEN type = 'observation' THEN 'other' ELSE 'extract' END AS step,
  len(related) + coalesce(penalty, 0) AS impact, len(related) >= 4 OR coalesce(penalty, 0) >= 1.2 AS wide, coalesce(shown, '') AS shown FROM g LEFT JOIN z USING (scope)),
 s AS (SELECT step, scope, count(*) AS findings, sum(impact) AS impact, bool_or(wide) AS wide, bool_or(severity = 'warning') AS warns, min_by(text, id) AS text, min(shown) AS shown FROM n WHERE step IS NOT NULL GROUP BY step, scope, CASE WHEN step IN ('suggestion', 'other') THEN id END)
SELECT CASE WHEN step = 'fix' THEN 'high' WHEN step = 'suggestion' AND NOT warns THEN 'low' WHEN wide THEN 'high' ELSE 'medium' END AS priority, CASE WHEN step IN ('fix', 'extract') THEN step ELSE 'refactor' END AS category, scope,
 CASE WHEN findings = 1 THEN CASE WHEN length(text) <= 80 THEN text ELSE left(text, 79) || '…' END ELSE CASE WHEN length(text) <= 60 THEN text ELSE left(text, 59) || '…' END || ' (+' || (findings - 1) || ' related)' END AS title,
 text || CASE WHEN step = 'suggestion' THEN '' ELSE shown END AS description, findings, floor(impact * 1000 + 0.5) / 1000 AS impact FROM s""")
def next_steps(spark, sf_dir):
    zones = spark.range(0, 8).select(F.concat(F.lit("z"), "id").alias("zone"), F.when(F.col("id") % 3 == 0, 0.2).otherwise(0.6).alias("cohesion"), F.lit(0.4).alias("coupling"), F.array(F.concat(F.lit("a"), "id"), F.lit("b"), F.lit("c"), F.lit("d")).alias("files"))
    rows = graded(spark, sf_dir).withColumn("text", F.concat("text", F.repeat(F.lit("x"), (F.col("id") % 100).cast("int"))))
    return fd.next_steps(rows, zones).withColumn("impact", F.floor(F.col("impact") * 1000 + 0.5) / 1000)


def overridden(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), picked(k, "completed", "completed", "pending").alias("status"), F.when(k % 5 == 0, "config-override").alias("resolution"), F.array("p_brand", F.lit("structural-debt"), F.concat(F.lit("finding:"), k)).alias("tags"), F.when(k % 6 == 0, F.lit("why")).alias("override"))


@query("SELECT p_brand AS zone, count(*) AS overrides FROM part WHERE p_partkey % 3 <> 2 AND p_partkey % 5 = 0 GROUP BY 1 HAVING count(*) >= 3")
def override_escalations(spark, sf_dir):
    return fd.override_escalations(overridden(spark, sf_dir))


@query("SELECT count(*) AS items, count(*) FILTER (p_partkey % 6 = 0) AS overridden, count(*) FILTER (p_partkey % 6 <> 0) AS others FROM part")
def override_summary(spark, sf_dir):
    return fd.override_summary(overridden(spark, sf_dir))


@query("SELECT 'a/' || p_brand AS path, min(CASE WHEN p_partkey % 4 = 1 THEN 'pin' ELSE p_type END) AS zone FROM (SELECT * FROM part WHERE p_partkey < 25) GROUP BY 1")
def pinned_files(spark, sf_dir):
    part = table(spark, sf_dir, "part").where("p_partkey < 25")
    rows = inv.pinned(part.select(F.col("p_partkey").alias("path"), F.col("p_type").alias("zone")), part.where("p_partkey % 4 = 1").select(F.col("p_partkey").alias("path"), F.lit("pin").alias("zone")))
    return rows.join(part.select(F.col("p_partkey").alias("path"), "p_brand"), "path").groupBy(F.concat(F.lit("a/"), "p_brand").alias("path")).agg(F.min("zone").alias("zone"))


#: Every fifth part lies in its type's directory, the others a level deeper, every 35th at the root; two of three have zones.
FILED = """p AS (SELECT CASE WHEN p_partkey % 35 = 0 THEN p_partkey::VARCHAR ELSE 'r/' || p_type || CASE WHEN p_partkey % 5 = 0 THEN '/' ELSE '/' || p_brand || '/' END || p_partkey END AS path, p_partkey AS k FROM part),
 h AS (SELECT parse_dirpath(path) AS dir, 'Z' || (k % 4) AS zone, count(*) AS n FROM p WHERE k % 3 <> 0 GROUP BY 1, 2), b AS (SELECT dir, arg_min(zone, (-n, zone)) AS zone FROM h GROUP BY 1)"""


def filed(spark, sf_dir):
    k = F.col("p_partkey")
    folder = F.concat_ws("/", F.lit("r"), "p_type", F.when(k % 5 != 0, F.col("p_brand")), k)
    rows = table(spark, sf_dir, "part").select(F.when(k % 35 == 0, k.cast("string")).otherwise(folder).alias("path"), k)
    return rows.where("p_partkey % 3 = 0").select("path"), rows.where("p_partkey % 3 != 0").select("path", F.concat(F.lit("Z"), k % 4).alias("zone"))


@query(f"""WITH {FILED} SELECT path, coalesce(near.zone, up.zone) AS zone FROM p LEFT JOIN b near ON near.dir = parse_dirpath(path) AND near.dir <> '' LEFT JOIN b up ON up.dir = parse_dirpath(parse_dirpath(path)) AND up.dir <> '' WHERE k % 3 = 0 AND coalesce(near.zone, up.zone) IS NOT NULL""")
def zones_by_proximity(spark, sf_dir):
    return inv.assigned_by_proximity(*filed(spark, sf_dir))


@query("""WITH r AS (SELECT p_partkey AS id, p_name AS cluster, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS description, CASE WHEN p_partkey % 4 <> 0 THEN 'high' END AS priority, [p_brand] AS tags FROM part)
SELECT cluster, arg_min(id, (-(CASE WHEN description IS NULL THEN 0 ELSE 1 END + CASE WHEN priority IS NULL THEN 0 ELSE 1 END + 1 + 1), -length(coalesce(description, '')), id)) AS id, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, count(*) AS merged FROM r GROUP BY 1""")
def survivors(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name").alias("cluster"), F.col("p_name").alias("title"), F.when(k % 3 == 0, F.col("p_type")).alias("description"), F.when(k % 4 != 0, "high").alias("priority"), F.array("p_brand").alias("tags"))
    return it.survivors(rows).withColumn("tags", F.array_join("tags", ","))


@query("SELECT p_name AS cluster, array_to_string(list_sort(list_distinct(list(p_brand))), ',') AS tags, array_to_string(list_sort(list_distinct(list(p_type))), ',') AS acceptance FROM part GROUP BY 1")
def merged_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("cluster"), F.array("p_brand").alias("tags"), F.array("p_type").alias("acceptance"))
    return it.merged_fields(rows).select("cluster", F.array_join("tags", ",").alias("tags"), F.array_join("acceptance", ",").alias("acceptance"))


@query(f"""WITH {CLOSURE}, r AS (SELECT id FROM items WHERE level = 'feature' AND right(id, 1) IN ('1', '2') OR level = 'subtask' AND right(id, 1) = '3'), h AS (SELECT c.id, min(distance) AS nearest FROM closure c JOIN r ON r.id = c.ancestor GROUP BY 1)
SELECT level, count(*) FILTER (nearest = 0) AS own, count(*) FILTER (nearest > 0) AS inherited, count(*) FILTER (nearest IS NULL) AS "none", floor(count(nearest) / count(*) * 100 + 0.5)::BIGINT AS percent FROM items LEFT JOIN h USING (id) WHERE id NOT IN ({GONE}) GROUP BY 1""")
def requirement_coverage(spark, sf_dir):
    pairs, rows = closed(spark, sf_dir)
    held = rows.where("level = 'feature' and right(id, 1) in ('1', '2') or level = 'subtask' and right(id, 1) = '3'").select("id")
    return it.requirement_coverage(pairs, rows, held)


@query(f"""WITH {CLOSURE}, r AS (SELECT 'C:' || c_custkey AS id, c_custkey AS place, 'Q' || (c_custkey % 50) AS requirement, c_mktsegment AS category, CASE WHEN c_custkey % 3 = 0 THEN 'manual' ELSE 'automated' END AS validation_type, CASE WHEN c_custkey % 4 <> 0 THEN 'p' || (c_custkey % 4) END AS priority FROM customer),
 f AS (SELECT arg_min(category, place) AS category, arg_min(validation_type, place) AS validation_type, arg_min(coalesce(priority, 'unset'), place) AS priority FROM r WHERE id NOT IN ({GONE}) GROUP BY requirement)
SELECT "by", value, count(*) AS n FROM (SELECT 'category' AS "by", category AS value FROM f UNION ALL SELECT 'validation_type', validation_type FROM f UNION ALL SELECT 'priority', priority FROM f) GROUP BY 1, 2""")
def requirement_breakdown(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit("C:"), k).alias("id"), k.alias("place"), F.concat(F.lit("Q"), k % 50).alias("requirement"), F.col("c_mktsegment").alias("category"), F.when(k % 3 == 0, "manual").otherwise("automated").alias("validation_type"), F.when(k % 4 != 0, F.concat(F.lit("p"), k % 4)).alias("priority"))
    return it.requirement_breakdown(*closed(spark, sf_dir), rows)


@query(f"""WITH {ITEMS}, s AS (SELECT id, priority, len(list_filter(['0001', 'custom', 'order 1'], lambda w: contains(lower(title || ' ' || level), w))) AS score FROM items) SELECT id, score FROM s WHERE score > 0""")
def tasks_by_keywords(spark, sf_dir):
    rows = items(spark, sf_dir).withColumn("description", F.col("level"))
    return it.tasks_by_keywords(rows, F.array(F.lit("0001"), F.lit("custom"), F.lit("order 1")))


@query("""WITH b AS (SELECT 'O:' || o_orderkey AS id, 'O:' || (o_orderkey - o_orderkey % 7) AS blocker FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0),""" + f""" {ITEMS}, kids AS (SELECT parent_id AS id, bool_and(status IN ('completed', 'deferred', 'deleted')) AS all_done FROM items WHERE parent_id IS NOT NULL GROUP BY 1),
 u AS (SELECT DISTINCT id FROM b WHERE blocker NOT IN (SELECT id FROM items WHERE status = 'completed'))
SELECT CASE WHEN status IN ('completed', 'deferred', 'blocked') THEN status WHEN u.id IS NOT NULL THEN 'unresolved' WHEN status = 'in_progress' THEN 'in_progress' ELSE 'actionable' END AS reason, count(*) AS items FROM items LEFT JOIN kids USING (id) LEFT JOIN u USING (id) WHERE status <> 'deleted' AND coalesce(all_done, true) GROUP BY 1""")
def selection_reasons(spark, sf_dir):
    from tarnworks.plans.trees import blockers

    return tr.selection_reasons(items(spark, sf_dir), blockers(spark, sf_dir))


@query("SELECT event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 WHEN 'view' THEN 3 ELSE 2 END, ts, event_id) AS place FROM events")
def queue_order(spark, sf_dir):
    kind = F.col("event_type")
    priority = F.when(kind == "error", "critical").when(kind == "purchase", "high").when(kind == "view", "low")
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("queue"), priority.alias("priority"), F.col("ts").alias("enqueued_at"))
    return telemetry.queue_order(rows).select("id", F.col("place").cast("long").alias("place"))


@query("""WITH s AS (SELECT user_id AS task, epoch_ms(ts) AS t, CAST(value * 10000000 AS BIGINT) AS rss, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC) AS rn FROM events) SELECT task, max(rss) AS peak, arg_max(rss, t) AS last, count(*) AS samples, arg_max(rss, t) >= 536870912 AS leaking FROM s WHERE rn <= 30 GROUP BY 1""")
def memory_peaks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task"), F.unix_millis(F.col("ts").cast("timestamp")).alias("epoch_ms"), F.round(F.col("value") * 10000000).cast("long").alias("rss"))
    return telemetry.memory_peaks(rows, last=30)


@query("""SELECT 'S' || l_suppkey AS "from", 'P' || l_partkey AS "to" FROM lineitem WHERE l_suppkey % 3 <> 0 UNION ALL SELECT 'S' || s_suppkey, 'new' FROM supplier WHERE s_suppkey % 3 = 0""")
def refreshed_edges(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.concat(F.lit("S"), "s_suppkey").alias("path"))
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("from"), F.concat(F.lit("P"), "l_partkey").alias("to"))
    return sync.refreshed_edges(edges, supplier, supplier.select(F.col("path").alias("from"), F.lit("new").alias("to")))


@query(f"WITH {CLOSURE} SELECT id FROM items WHERE id NOT IN (SELECT id FROM closure WHERE ancestor IN ('R:2', 'N:3'))")
def without_subtrees(spark, sf_dir):
    pairs, rows = closed(spark, sf_dir)
    return tr.without_subtrees(pairs, rows, rows.where("id in ('R:2', 'N:3')")).select("id")


MOVES = "m AS (SELECT 'O:' || o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'C:' || (o_orderkey % 100) WHEN 1 THEN 'N:1' WHEN 2 THEN 'X:1' WHEN 3 THEN 'O:' || (o_orderkey - 1) ELSE NULL END AS \"to\" FROM orders WHERE o_orderkey % 10 = 3 OR o_orderkey % 5 <> 3 UNION ALL SELECT 'R:1', 'N:1' UNION ALL SELECT 'N:1', 'R:0')"


def moves(spark, sf_dir):
    k = F.col("o_orderkey")
    to = F.when(k % 5 == 0, F.concat(F.lit("C:"), k % 100)).when(k % 5 == 1, "N:1").when(k % 5 == 2, "X:1").when(k % 5 == 3, F.concat(F.lit("O:"), k - 1))
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 3 or o_orderkey % 5 != 3").select(F.concat(F.lit("O:"), k).alias("id"), to.alias("to"))
    return rows.union(spark.createDataFrame([("R:1", "N:1"), ("N:1", "R:0")], "id string, to string"))


@query(f"""WITH {CLOSURE}, {MOVES} SELECT m.id, m."to", CASE WHEN i.id IS NULL OR m."to" IS NOT NULL AND t.id IS NULL THEN 'unknown' WHEN c.id IS NOT NULL THEN 'below itself' WHEN NOT coalesce(CASE i.level WHEN 'epic' THEN m."to" IS NULL WHEN 'feature' THEN t.level = 'epic' WHEN 'task' THEN t.level IN ('feature', 'epic') ELSE t.level IN ('task', 'subtask') END, false) THEN 'level' END AS problem
FROM m LEFT JOIN items i ON i.id = m.id LEFT JOIN items t ON t.id = m."to" LEFT JOIN closure c ON c.ancestor = m.id AND c.id = m."to" """)
def checked_moves(spark, sf_dir):
    pairs, rows = closed(spark, sf_dir)
    return tr.checked_moves(moves(spark, sf_dir), pairs, rows)


@query(f"""WITH {ITEMS}, {MOVES} SELECT i.id, CASE WHEN m.id IS NOT NULL THEN m."to" ELSE i.parent_id END AS parent_id FROM items i LEFT JOIN m ON m.id = i.id""")
def moved_items(spark, sf_dir):
    return tr.moved(items(spark, sf_dir), moves(spark, sf_dir)).select("id", "parent_id")


@query(f"""WITH {ITEMS}, w(wanted) AS (SELECT 'C:5' UNION ALL SELECT ' nation_3 ' UNION ALL SELECT 'order ' || (o_orderkey * 3) FROM orders UNION ALL SELECT 'nothing')
SELECT DISTINCT wanted, coalesce(a.id, b.id) AS id FROM w LEFT JOIN items a ON a.id = wanted LEFT JOIN items b ON lower(trim(b.title)) = lower(trim(wanted)) WHERE coalesce(a.id, b.id) IS NOT NULL""")
def resolved_items(spark, sf_dir):
    asked = spark.createDataFrame([("C:5",), (" nation_3 ",), ("nothing",)], "wanted string").union(table(spark, sf_dir, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey") * 3)))
    return tr.resolved_items(items(spark, sf_dir), asked, TREE_LEVELS)


@query(f"""WITH {ITEMS} SELECT id, parent_id, level, status FROM items UNION ALL SELECT 'new' || o_orderkey, 'C:' || o_custkey, 'subtask', 'pending' FROM orders WHERE o_orderkey % 4 = 0""")
def inserted_items(spark, sf_dir):
    rows = items(spark, sf_dir).select("id", "parent_id", "level", "status")
    k = F.col("o_orderkey")
    parent = F.when(k % 4 == 0, F.concat(F.lit("C:"), "o_custkey")).when(k % 4 == 1, "N:1").when(k % 4 == 2, "C:none")
    new = table(spark, sf_dir, "orders").select(F.concat(F.lit("new"), k).alias("id"), parent.alias("parent_id"), F.lit("subtask").alias("level"), F.lit("pending").alias("status"))
    return tr.inserted(rows, new)


@query(f"""WITH {ITEMS} SELECT id, CASE WHEN right(id, 1) = '1' THEN 'deferred' ELSE status END AS status, CASE WHEN right(id, 1) = '1' AND level = 'task' THEN 'new' ELSE title END AS title FROM items""")
def updated_items(spark, sf_dir):
    rows = items(spark, sf_dir)
    change = rows.where("right(id, 1) = '1'").select("id", F.lit("deferred").alias("status"), F.when(F.col("level") == "task", "new").alias("title"))
    return tr.updated(rows, change, "status", "title").select("id", "status", "title")


#: The tree with two features at the top, few live children in some features, and one region with a single live feature.
LOPSIDED = ITEMS + """, lop AS (SELECT id, CASE WHEN id IN ('N:3', 'N:4') THEN NULL ELSE parent_id END AS parent_id, level, title, CASE WHEN level = 'task' AND parent_id IN ('N:1', 'N:5', 'N:9', 'N:13') AND length(id) > 4 THEN 'deleted' WHEN level = 'feature' AND parent_id = 'R:2' AND id <> 'N:12' THEN 'deleted' WHEN id = 'N:5' THEN 'completed' ELSE status END AS status FROM items)"""


def lopsided(spark, sf_dir):
    up, level = F.col("parent_id"), F.col("level")
    few = (level == "task") & up.isin("N:1", "N:5", "N:9", "N:13") & (F.length("id") > 4)
    single = (level == "feature") & (up == "R:2") & (F.col("id") != "N:12")
    status = F.when(few | single, "deleted").when(F.col("id") == "N:5", "completed").otherwise(F.col("status"))
    return items(spark, sf_dir).withColumns({"status": status, "parent_id": F.when(F.col("id").isin("N:3", "N:4"), None).otherwise(up)})


@query(f"""WITH {LOPSIDED}, {likeness("SELECT lower(title) AS t FROM lop WHERE level IN ('epic', 'feature')")}, k AS (SELECT parent_id AS id, count(*) AS live, min(id) AS one, bool_and(level IN ('epic', 'feature')) AS box FROM lop WHERE parent_id IS NOT NULL AND status <> 'deleted' GROUP BY 1),
 h AS (SELECT lop.*, coalesce(live, 0) AS live FROM lop LEFT JOIN k USING (id) WHERE status <> 'deleted'),
 p AS (SELECT x.id, y.id AS other, row_number() OVER (PARTITION BY x.id ORDER BY score DESC, y.id) AS rn FROM h x JOIN h y ON x.parent_id IS NOT DISTINCT FROM y.parent_id AND x.id <> y.id AND x.level IN ('epic', 'feature') AND y.level IN ('epic', 'feature') JOIN sc ON a = lower(x.title) AND b = lower(y.title) WHERE x.live > 0 AND x.live < 8)
SELECT 'move' AS kind, id, NULL AS other, 0.8::DOUBLE AS confidence FROM h WHERE level = 'feature' AND parent_id IS NULL UNION ALL SELECT 'split', id, NULL, 0.6 FROM h WHERE level IN ('epic', 'feature') AND live > 15
UNION ALL SELECT 'merge', id, other, 0.5 FROM p WHERE rn = 1 UNION ALL SELECT 'collapse', h.id, one, 0.65 FROM h JOIN k USING (id) WHERE k.live = 1 AND k.box AND h.status <> 'completed' AND h.level IN ('epic', 'feature')""")
def reorganisations(spark, sf_dir):
    return tr.reorganisations(lopsided(spark, sf_dir), least=8)


@query(f"""WITH {ITEMS}, a AS (SELECT id, CASE WHEN level = 'subtask' THEN 'move' WHEN level = 'task' THEN 'merge' ELSE 'delete' END AS kind, CASE WHEN level = 'subtask' THEN 'C:1' WHEN level = 'task' THEN 'C:2' END AS "to" FROM items WHERE right(id, 1) = '7' AND level <> 'epic')
SELECT i.id, CASE WHEN a.kind = 'move' THEN a."to" ELSE coalesce(m."to", i.parent_id) END AS parent_id, CASE WHEN a.kind IN ('merge', 'delete') THEN 'deleted' ELSE i.status END AS status FROM items i LEFT JOIN a ON a.id = i.id LEFT JOIN a m ON m.id = i.parent_id AND m.kind = 'merge'""")
def reshaped_tree(spark, sf_dir):
    rows, level = items(spark, sf_dir), F.col("level")
    act = rows.where("right(id, 1) = '7' and level != 'epic'").select("id", F.when(level == "subtask", "move").when(level == "task", "merge").otherwise("delete").alias("kind"), F.when(level == "subtask", "C:1").when(level == "task", "C:2").alias("to"))
    return tr.reshaped(rows, act).select("id", "parent_id", "status")


@query(f"""WITH {ITEMS}, l AS (SELECT n_regionkey AS r, max(n_nationkey) AS lead FROM nation GROUP BY 1), n AS (SELECT 'N:' || n_nationkey AS id, 'N:' || lead AS lead FROM nation JOIN l ON r = n_regionkey),
 d AS (SELECT id FROM items WHERE level = 'task' AND right(id, 1) = '5')
SELECT i.id, CASE WHEN i.level = 'task' THEN coalesce(n.lead, i.parent_id) ELSE i.parent_id END AS parent_id, CASE WHEN i.id IN (SELECT id FROM d) OR i.parent_id IN (SELECT id FROM d) OR i.level = 'feature' AND i.id NOT IN (SELECT lead FROM n) THEN 'deleted' ELSE i.status END AS status,
 CASE WHEN i.level = 'feature' AND i.id IN (SELECT lead FROM n) THEN 'late' ELSE i.title END AS title FROM items i LEFT JOIN n ON n.id = i.parent_id""")
def changes_in_order(spark, sf_dir):
    """Each nation merged into the next of its region, in turn; then all renamed, which only the last ones take; then some
    customers deleted with their orders."""
    from pyspark.sql import Window

    nation = table(spark, sf_dir, "nation").withColumn("next", F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    name = lambda c: F.concat(F.lit("N:"), c)
    kind = lambda k: F.lit(k).alias("kind")
    merges = nation.where("next is not null").select((F.col("n_nationkey") + 1).alias("seq"), kind("merge"), name(F.col("next")).alias("id"), F.array(name(F.col("n_nationkey"))).alias("members"))
    renames = nation.select((F.col("n_nationkey") + 100).alias("seq"), kind("update"), name(F.col("n_nationkey")).alias("id"), F.lit("late").alias("title"))
    rows = items(spark, sf_dir).withColumn("description", F.lit(None).cast("string"))
    drops = rows.where("level = 'task' and right(id, 1) = '5'").select((F.substring("id", 3, 20).cast("long") + 1000).alias("seq"), kind("delete"), "id")
    actions = spark.createDataFrame([], ACTION)
    for part in (merges, renames, drops):
        actions = actions.unionByName(part.withColumn("seq", F.col("seq").cast("long")), allowMissingColumns=True)
    return Reshaped(rows, actions).items().select("id", "parent_id", "status", "title")


SCAN = f"s AS (SELECT {picked_sql('p_partkey', 'task', 'feature', 'task', 'epic', 'task')} AS kind, p_name AS name, 'd' || (p_size % 6) || '/' || p_brand AS file, p_type AS source FROM part)"


@query(f"""WITH {SCAN}, ff AS (SELECT file, min(name) AS a FROM s WHERE kind = 'feature' GROUP BY 1), fs AS (SELECT source, min(name) AS b FROM s WHERE kind = 'feature' GROUP BY 1), es AS (SELECT source, min(name) AS c FROM s WHERE kind = 'epic' GROUP BY 1)
SELECT epic, feature, task, count(*) AS n FROM (SELECT coalesce(c, source) AS epic, CASE WHEN kind = 'feature' THEN name ELSE coalesce(a, b, split_part(file, '/', 1)) END AS feature, CASE WHEN kind = 'task' THEN name END AS task FROM s LEFT JOIN ff USING (file) LEFT JOIN fs USING (source) LEFT JOIN es USING (source) WHERE kind <> 'epic') GROUP BY 1, 2, 3""")
def scan_proposals(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(picked(F.col("p_partkey"), "task", "feature", "task", "epic", "task").alias("kind"), F.col("p_name").alias("name"), F.concat(F.lit("d"), F.col("p_size") % 6, F.lit("/"), "p_brand").alias("file"), F.col("p_type").alias("source"))
    return tr.proposals_of_scan(rows).groupBy("epic", "feature", "task").agg(F.count("*").alias("n"))


@query(f"""WITH {ITEMS}, k AS (SELECT id, parent_id, (CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, title, id) AS key FROM items)
SELECT a.id, row_number() OVER (ORDER BY p.key, a.key) AS place FROM k a JOIN k p ON a.parent_id = p.id WHERE a.id LIKE 'N:%'""")
def features_in_order(spark, sf_dir):
    from pyspark.sql import Window

    rows = tr.items_in_order(items(spark, sf_dir), TREE_LEVELS).where("level = 'feature'")
    return rows.select("id", F.row_number().over(Window.orderBy("order")).cast("long").alias("place"))


@query("""SELECT file, count(*) AS items FROM (SELECT CASE WHEN p_partkey % 4 = 0 THEN p_brand || '.md' WHEN p_partkey % 4 = 1 THEN 'owner' || (p_partkey % 3) ELSE 'default.md' END AS file FROM part) GROUP BY 1""")
def items_by_file(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 4 == 0, F.concat("p_brand", F.lit(".md"))).when(k % 4 == 1, "").alias("source_file"))
    owners = table(spark, sf_dir, "part").where("p_partkey % 4 = 1 or p_partkey % 4 = 0").select(k.alias("id"), F.concat(F.lit("owner"), k % 3).alias("file"))
    return hs.by_file(rows, owners, "default.md").groupBy("file").agg(F.count("*").alias("items"))


@query(f"WITH c AS (SELECT conv_id AS run, {picked_sql('turn', 'write_file', 'update_item', 'read', 'write_file')} AS tool, {picked_sql('(turn + conv_id)', 'src/a.ts', 'tests/b.py', 'docs/c.MD', 'x.yaml', '', 'lib/d.spec.tsx')} AS path FROM conversations), w AS (SELECT DISTINCT run, CASE WHEN tool = 'write_file' THEN nullif(path, '') WHEN tool = 'update_item' THEN 'prd.json' END AS path FROM c)" + """
SELECT run, CASE path WHEN 'prd.json' THEN 'metadata' WHEN 'tests/b.py' THEN 'test' WHEN 'lib/d.spec.tsx' THEN 'test' WHEN 'docs/c.MD' THEN 'docs' WHEN 'x.yaml' THEN 'config' ELSE 'code' END AS category, path FROM w WHERE path IS NOT NULL""")
def written_files(spark, sf_dir):
    calls = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run"), picked(F.col("turn"), "write_file", "update_item", "read", "write_file").alias("tool"), picked(F.col("turn") + F.col("conv_id"), "src/a.ts", "tests/b.py", "docs/c.MD", "x.yaml", "", "lib/d.spec.tsx").alias("path"))
    return hs.written_files(calls)


@query("SELECT l_orderkey AS sha, count(*) FILTER (l_returnflag = 'A') AS added, count(*) FILTER (l_returnflag = 'N') AS modified, count(*) FILTER (l_returnflag = 'R') AS deleted, 0::BIGINT AS renamed, 0::BIGINT AS copied, 0::BIGINT AS other, count(*) AS total FROM lineitem GROUP BY 1")
def change_summary(spark, sf_dir):
    flag = F.col("l_returnflag")
    return hs.change_summary(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.when(flag == "A", "added").when(flag == "N", "modified").otherwise("deleted").alias("change")))


def uuid_of(key):
    h = F.sha2(key.cast("string"), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


UUID_SQL = "(substr(sha256(CAST({k} AS VARCHAR)), 1, 8) || '-' || substr(sha256(CAST({k} AS VARCHAR)), 9, 4) || '-' || substr(sha256(CAST({k} AS VARCHAR)), 13, 4) || '-' || substr(sha256(CAST({k} AS VARCHAR)), 17, 4) || '-' || substr(sha256(CAST({k} AS VARCHAR)), 21, 12))"


def merge_tables(spark, sf_dir):
    """Purchases as merges that name parts in their text or branch, other events as runs for parts; parts below 1,900 are known."""
    e, u = F.col("event_id"), F.col("user_id")
    events = table(spark, sf_dir, "events").withColumn("part", e % 2000)
    branch = F.when(e % 4 == 0, F.concat(F.lit("Merge branch 'task/"), uuid_of(F.col("part")), F.lit("-x'"))).when(e % 4 == 1, F.concat(F.lit("Merge pull request #7 from me/fix-"), F.substring(uuid_of(F.col("part") + 1), 1, 8), F.lit("-y"))).otherwise(F.lit("Merge nothing"))
    body = F.when(e % 3 == 0, F.concat(F.lit("for "), F.upper(uuid_of(F.col("part") + 2)), F.lit(" and "), uuid_of(F.lit(123456789)))).otherwise("")
    merges = events.where("event_type = 'purchase'").select(F.concat(F.lit("m"), e).alias("sha"), branch.alias("subject"), body.alias("body"), F.col("ts").alias("merged_at"), u.alias("series"))
    runs = events.where("event_type in ('click', 'view')").select(uuid_of(F.col("part")).alias("item"), F.col("ts").alias("ended"), u.alias("series"))
    known = table(spark, sf_dir, "part").where("p_partkey < 1900").select(uuid_of(F.col("p_partkey")).alias("id"))
    return merges, known, runs


MERGES = f"""e AS (SELECT *, event_id % 2000 AS part FROM events), known AS (SELECT {UUID_SQL.format(k='p_partkey')} AS id FROM part WHERE p_partkey < 1900), m AS (SELECT 'm' || event_id AS sha, event_id, part, ts, user_id FROM e WHERE event_type = 'purchase'),
 r AS (SELECT {UUID_SQL.format(k='part')} AS item, ts, user_id FROM e WHERE event_type IN ('click', 'view')),
 g AS (SELECT sha, {UUID_SQL.format(k='(part + 2)')} AS item, 'commit-message' AS attribution FROM m WHERE event_id % 3 = 0 UNION SELECT sha, {UUID_SQL.format(k='part')}, 'commit-message' FROM m WHERE event_id % 4 = 0 UNION SELECT sha, {UUID_SQL.format(k='part')}, 'branch-name' FROM m WHERE event_id % 4 = 0 UNION SELECT sha, {UUID_SQL.format(k='(part + 1)')}, 'branch-name' FROM m WHERE event_id % 4 = 1
 UNION SELECT (SELECT m.sha FROM m WHERE m.user_id = r.user_id AND m.ts >= r.ts ORDER BY m.ts, m.sha LIMIT 1) AS sha, r.item, 'run' FROM r WHERE EXISTS (SELECT 1 FROM m WHERE m.user_id = r.user_id AND m.ts >= r.ts AND m.ts < r.ts + INTERVAL 24 HOUR)),
 edges AS (SELECT * FROM g WHERE item IN (SELECT id FROM known))"""


@query(f"WITH {MERGES} SELECT sha, item, attribution FROM edges")
def merge_graph(spark, sf_dir):
    return hs.merge_graph(*merge_tables(spark, sf_dir), series=F.col("series"))


@query(f"WITH {MERGES} SELECT count(*) AS merges, count(*) FILTER (sha IN (SELECT sha FROM edges)) AS linked, count(*) FILTER (sha NOT IN (SELECT sha FROM edges)) AS unlinked, (SELECT count(DISTINCT item) FROM edges) AS items FROM m")
def merge_linkage(spark, sf_dir):
    merges, known, runs = merge_tables(spark, sf_dir)
    return hs.linkage(merges, hs.merge_graph(merges, known, runs, series=F.col("series")))
