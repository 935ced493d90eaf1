"""Queries over a workspace of member projects, its routes and the names that its zones keep."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnworks.operators import routes, zoning
from tarnworks.operators import workspaces as op
from tarnworks.plans.tables import table

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def members(spark, sf_dir):
    """Nations as projects in their region's directory, which is a project too; every other nation names an entry."""
    first = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.min("c_custkey").alias("first"))
    nation = table(spark, sf_dir, "nation").join(first, "n_nationkey", "left")
    k, folder = F.col("n_nationkey"), lambda c: F.concat(F.lit("packages/r"), F.col(c))
    entry = F.when(k % 2 == 0, F.concat(F.lit("src/c"), "first", F.lit(".ts")))
    nations = nation.select(F.concat(F.lit("n"), k).alias("member"), F.concat(folder("n_regionkey"), F.lit("/n"), k, F.lit("/")).alias("prefix"), F.concat(F.lit("@w/n"), k).alias("package"), entry.alias("entry"))
    regions = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey"), folder("r_regionkey"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    return nations.union(regions)


MEMBERS = """first AS (SELECT c_nationkey AS k, min(c_custkey) AS c FROM customer GROUP BY 1), members AS (SELECT 'n' || n_nationkey AS member, 'packages/r' || n_regionkey || '/n' || n_nationkey AS dir, '@w/n' || n_nationkey AS package, CASE WHEN n_nationkey % 2 = 0 THEN 'src/c' || c || '.ts' END AS entry FROM nation LEFT JOIN first ON k = n_nationkey
 UNION ALL SELECT 'r' || r_regionkey, 'packages/r' || r_regionkey, NULL, NULL FROM region)"""


def own(c):
    return F.concat(F.lit("src/c"), c, F.lit(".ts"))


def files(spark, sf_dir):
    """Customers as files of their nation's project."""
    k = F.col("c_custkey")
    language = F.when(k % 4 == 0, "Python").otherwise("TypeScript")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("member"), own(k).alias("path"), language.alias("language"), F.lower("c_mktsegment").alias("role"), F.when(k % 3 > 0, F.concat(F.lit("z"), k % 3)).alias("category"), (k % 97).alias("lines"))


FILES = MEMBERS + """, files AS (SELECT member, dir || '/src/c' || c_custkey || '.ts' AS path, CASE WHEN c_custkey % 4 = 0 THEN 'Python' ELSE 'TypeScript' END AS language, lower(c_mktsegment) AS role, CASE WHEN c_custkey % 3 > 0 THEN 'z' || (c_custkey % 3) END AS category, c_custkey % 97 AS lines FROM customer JOIN members ON member = 'n' || c_nationkey)"""


@query(f"WITH {FILES} SELECT 'files' AS measure, '' AS key, count(*) AS n FROM files UNION ALL SELECT 'lines', '', CAST(sum(lines) AS BIGINT) FROM files UNION ALL SELECT 'language', language, count(*) FROM files GROUP BY 2 UNION ALL SELECT 'role', role, count(*) FROM files GROUP BY 2 UNION ALL SELECT 'category', category, count(*) FROM files WHERE category IS NOT NULL GROUP BY 2")
def workspace_inventory(spark, sf_dir):
    return op.inventory_totals(op.united(members(spark, sf_dir), files(spark, sf_dir), "path"))


def bought(spark, sf_dir):
    """An order as an import of the customer's file: of another file of the project, and of a package."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    package = F.when(k % 3 > 0, F.concat(F.lit("@w/n"), k % 30)).otherwise(F.concat(F.lit("lib"), k % 8))
    return rows.select(F.concat(F.lit("n"), "c_nationkey").alias("member"), own(F.col("c_custkey")).alias("path"), own(k % 40).alias("to"), package.alias("package"))


BOUGHT = MEMBERS + """, bought AS (SELECT member, dir || '/src/c' || c_custkey || '.ts' AS path, dir || '/src/c' || (o_orderkey % 40) || '.ts' AS other, CASE WHEN o_orderkey % 3 > 0 THEN '@w/n' || (o_orderkey % 30) ELSE 'lib' || (o_orderkey % 8) END AS package FROM orders JOIN customer ON c_custkey = o_custkey JOIN members ON member = 'n' || c_nationkey)"""


def united_edges(spark, sf_dir):
    return op.united(members(spark, sf_dir), bought(spark, sf_dir).select("member", F.col("path").alias("from"), "to"), "from", "to")


@query(f"WITH {BOUGHT} SELECT count(*) AS edges, count(DISTINCT package) AS packages, CAST(0 AS BIGINT) AS circular, floor(count(*) / count(DISTINCT path) * 100 + 0.5) / 100 AS per_file FROM bought")
def workspace_imports(spark, sf_dir):
    return op.import_totals(united_edges(spark, sf_dir), bought(spark, sf_dir))


@query(f"WITH {BOUGHT} SELECT other AS path, count(*) AS n FROM bought GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def workspace_most_imported(spark, sf_dir):
    return op.most_imported(united_edges(spark, sf_dir))


def zones(spark, sf_dir):
    """Files of a member whose category is known, by category."""
    return files(spark, sf_dir).where("category is not null").select("member", F.col("category").alias("zone"), "path")


@query(f"""WITH {BOUGHT}, z AS (SELECT member, 'n' || c_nationkey || ':z' || (c_custkey % 3) AS zone, c_custkey AS c, dir || '/src/c' || c_custkey || '.ts' AS path, 'src/c' || c_custkey || '.ts' AS own FROM customer JOIN members ON member = 'n' || c_nationkey WHERE c_custkey % 3 > 0),
 opts AS (SELECT z.member, 0 AS k, z.zone, 0 AS place, path FROM z JOIN members m ON m.member = z.member AND m.entry = z.own UNION ALL SELECT member, 1, zone, c, path FROM z WHERE c % 10 = 1 UNION ALL SELECT member, 2, zone, 0, path FROM z),
 best AS (SELECT *, row_number() OVER (PARTITION BY member ORDER BY k, zone, place, path) AS rn FROM opts)
SELECT DISTINCT b.path AS "from", t.path AS "to", f.zone AS from_zone, t.zone AS to_zone FROM bought b JOIN members m ON m.package = b.package AND m.member <> b.member JOIN best t ON t.member = m.member AND rn = 1 JOIN z f ON f.path = b.path""")
def workspace_crossings(spark, sf_dir):
    own_zones = zones(spark, sf_dir)
    number = F.regexp_extract("path", r"(\d+)\.ts$", 1).cast("long")
    entries = own_zones.withColumn("place", number).where("place % 10 = 1")
    named = members(spark, sf_dir)
    return op.member_crossings(named, bought(spark, sf_dir).select("member", "package", "path"), op.united_zones(named, own_zones), entries)


@query(f"""WITH {MEMBERS}, f AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN 'tools' ELSE 'packages/r' || (o_orderkey % 6) || CASE WHEN o_orderkey % 5 > 0 THEN '/n' || (o_orderkey % 25) ELSE '' END END || '/o' || o_orderkey AS path FROM orders)
SELECT path, arg_max(member, length(dir)) AS member FROM f LEFT JOIN members ON starts_with(path, dir || '/') GROUP BY 1""")
def innermost_members(spark, sf_dir):
    k = F.col("o_orderkey")
    inside = F.concat(F.lit("packages/r"), k % 6, F.when(k % 5 > 0, F.concat(F.lit("/n"), k % 25)).otherwise(""))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.when(k % 7 == 0, "tools").otherwise(inside), F.lit("/o"), k).alias("path"))
    return op.innermost_members(rows, members(spark, sf_dir))


@query("""WITH RECURSIVE m AS (SELECT o_orderkey AS file, CASE WHEN o_orderkey % 4 > 0 THEN '/' || o_orderpriority || '/' || (o_orderkey % 11) END AS route, CASE WHEN o_orderkey < 3 THEN NULL WHEN o_orderkey % 101 = 100 THEN -1 ELSE o_orderkey // 3 END AS parent FROM orders),
 t AS (SELECT file, route, CAST(NULL AS BIGINT) AS near, route AS path, CASE WHEN route IS NULL THEN 0 ELSE 1 END AS n FROM m WHERE parent IS NULL
  UNION ALL SELECT m.file, m.route, CASE WHEN t.route IS NOT NULL THEN t.file ELSE t.near END, CASE WHEN m.route IS NULL THEN t.path WHEN t.path IS NULL THEN m.route ELSE t.path || ' > ' || m.route END, t.n + CASE WHEN m.route IS NULL THEN 0 ELSE 1 END FROM t JOIN m ON m.parent = t.file)
SELECT file, route, near AS parent, n - 1 AS depth, path FROM t WHERE route IS NOT NULL""")
def route_tree(spark, sf_dir):
    k = F.col("o_orderkey")
    route = F.when(k % 4 > 0, F.concat(F.lit("/"), "o_orderpriority", F.lit("/"), k % 11))
    parent = F.when(k < 3, F.lit(None)).when(k % 101 == 100, -1).otherwise(F.floor(k / 3)).cast("long")
    modules = table(spark, sf_dir, "orders").select(k.cast("string").alias("file"), route.alias("route"), parent.cast("string").alias("parent"))
    return routes.route_tree(modules).withColumns({c: F.col(c).cast("long") for c in ("file", "parent")})


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS path, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS b FROM part), bf AS (SELECT path, CASE WHEN path % 3 > 0 THEN 'a' || (b // 2) ELSE 'b' || (b // 3) END AS name FROM p),
 n AS (SELECT b, name, count(*) AS n FROM p JOIN bf USING (path) GROUP BY 1, 2), o AS (SELECT n.b, n.name, least(n / (SELECT count(*) FROM p WHERE p.b = n.b), n / (SELECT count(*) FROM bf WHERE bf.name = n.name)) AS overlap FROM n),
 w AS (SELECT b, list(name ORDER BY overlap DESC, name) AS names, row_number() OVER (ORDER BY b DESC) AS i FROM o WHERE overlap >= 0.2 GROUP BY b),
 r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS used, CAST(NULL AS BIGINT) AS b, CAST(NULL AS VARCHAR) AS name
  UNION ALL SELECT w.i, CASE WHEN f.name IS NULL THEN r.used ELSE list_append(r.used, f.name) END, w.b, f.name FROM r JOIN w ON w.i = r.i + 1, LATERAL (SELECT list_filter(w.names, lambda x: NOT list_contains(r.used, x))[1] AS name) f)
SELECT 'Brand#' || b AS zone, name FROM r WHERE name IS NOT NULL""")
def kept_zone_names_in_turn(spark, sf_dir):
    """The zone of the highest brand chooses first."""
    part = table(spark, sf_dir, "part")
    b = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("long")
    name = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("a"), F.floor(b / 2))).otherwise(F.concat(F.lit("b"), F.floor(b / 3)))
    return zoning.kept_names(part.select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("zone"), (-b).alias("place")), part.select(F.col("p_partkey").alias("path"), name.alias("zone")), 0.2)
