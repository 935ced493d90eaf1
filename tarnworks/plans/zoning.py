"""Queries over zones made from graphs, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnworks.operators import graph
from tarnworks.operators import zoning as op
from tarnworks.plans.tables import TRADE, table, trade

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def weighed(spark, sf_dir):
    """Trade between nations as an undirected graph, weighed by line items."""
    return graph.undirected(trade(spark, sf_dir).withColumn("weight", F.lit(1.0)))


WEIGHED = f"{TRADE}, g AS (SELECT src, dst, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT src, dst, 1 AS w FROM trade WHERE src <> dst UNION ALL SELECT dst, src, 1 FROM trade WHERE src <> dst) GROUP BY 1, 2)"


@query(f"WITH {WEIGHED} SELECT src, dst, w FROM g")
def undirected_graph(spark, sf_dir):
    return weighed(spark, sf_dir)


@query(f"WITH {WEIGHED} SELECT median(w) AS median FROM g WHERE src < dst")
def median_edge_weight(spark, sf_dir):
    return op.median_weight(weighed(spark, sf_dir))


def regions(spark, sf_dir):
    """Nations with their region as the zone before."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("node"), F.concat(F.lit("Z"), "n_regionkey").alias("zone"))


BEFORE = "b AS (SELECT 'N' || n_nationkey AS node, 'Z' || n_regionkey AS zone FROM nation), z AS (SELECT zone, min(node) AS hub, count(*) AS n FROM b GROUP BY 1)"


@query(f"""WITH {WEIGHED}, {BEFORE}, med AS (SELECT median(w) AS m FROM g WHERE src < dst), h AS (SELECT * FROM b JOIN z USING (zone) WHERE n > 1), x AS (
 SELECT a.node AS src, hub AS dst, 1.0 AS x FROM h a WHERE node <> hub UNION ALL SELECT hub, node, 1.0 FROM h WHERE node <> hub
 UNION ALL SELECT g.src, g.dst, 2.0 FROM g JOIN h a ON a.node = g.src JOIN h c ON c.node = g.dst AND c.zone = a.zone WHERE a.node <> a.hub AND c.node <> c.hub)
SELECT src, dst, CAST(sum(x) * any_value(m) * 0.5 AS DOUBLE) AS w FROM x, med GROUP BY 1, 2""")
def stability_edges(spark, sf_dir):
    """With at most 8 pairs a zone, the zones of five nations count as large."""
    return op.stability_edges(weighed(spark, sf_dir), regions(spark, sf_dir), most_pairs=8)


@query(f"""WITH {WEIGHED}, {BEFORE}, med AS (SELECT median(w) AS m FROM g WHERE src < dst) SELECT a.node AS src, c.node AS dst, m * 0.5 AS w FROM b a JOIN b c USING (zone), med WHERE a.node <> c.node""")
def stability_cliques(spark, sf_dir):
    return op.stability_edges(weighed(spark, sf_dir), regions(spark, sf_dir))


def small_members(spark, sf_dir):
    """Nations in communities of one, two and many."""
    k = F.col("n_nationkey")
    name = F.when(k < 4, F.concat(F.lit("s"), k)).when(k < 8, F.concat(F.lit("t"), F.floor(k / 2))).otherwise(F.concat(F.lit("u"), k % 3))
    return table(spark, sf_dir, "nation").select(F.lit("c").alias("component"), F.concat(F.lit("N"), k).alias("node"), name.alias("community"))


MEMBERS = "mem AS (SELECT 'N' || n_nationkey AS node, CASE WHEN n_nationkey < 4 THEN 's' || n_nationkey WHEN n_nationkey < 8 THEN 't' || (n_nationkey // 2) ELSE 'u' || (n_nationkey % 3) END AS community FROM nation)"


@query(f"""WITH {WEIGHED}, {MEMBERS}, size AS (SELECT community, count(*) AS size FROM mem GROUP BY 1) SELECT a.community AS a, b.community AS b, CAST(sum(w) AS DOUBLE) AS w, count(*) AS n, 0::BIGINT AS size FROM g JOIN mem a ON a.node = src JOIN mem b ON b.node = dst GROUP BY 1, 2 UNION ALL SELECT community, NULL, 0.0, 0, size FROM size""")
def contracted_graph(spark, sf_dir):
    return op.contracted(small_members(spark, sf_dir), weighed(spark, sf_dir))


@query()
def merged_small(spark, sf_dir):
    return op.regrouped(small_members(spark, sf_dir), weighed(spark, sf_dir), op.small)


@query()
def merged_satellites(spark, sf_dir):
    return op.regrouped(small_members(spark, sf_dir), weighed(spark, sf_dir), op.satellites)


@query()
def merged_both_ways(spark, sf_dir):
    return op.regrouped(small_members(spark, sf_dir), weighed(spark, sf_dir), op.tied_both_ways, "n")


@query()
def capped_zones(spark, sf_dir):
    return op.regrouped(small_members(spark, sf_dir), weighed(spark, sf_dir), lambda g: op.capped(g, 4), by_component=False)


@query()
def split_zones(spark, sf_dir):
    members = table(spark, sf_dir, "nation").select(F.lit("c").alias("component"), F.concat(F.lit("N"), "n_nationkey").alias("node"), F.lit("all").alias("community"))
    return op.split_large(members, weighed(spark, sf_dir), 6)


@query("""WITH m AS (SELECT p_partkey AS node, p_brand AS community, CASE WHEN p_brand < 'Brand#2' THEN 'a' ELSE p_type END AS value FROM part), c AS (SELECT community, value, count(*) AS n FROM m GROUP BY 1, 2), s AS (SELECT community, sum(n) AS size, arg_min(value, (-n, value)) AS key, max(n) AS best FROM c GROUP BY 1) SELECT community, key FROM s WHERE best >= 0.7 * size""")
def dominant_keys(spark, sf_dir):
    members = table(spark, sf_dir, "part").select(F.lit("c").alias("component"), F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"), F.when(F.col("p_brand") < "Brand#2", "a").otherwise(F.col("p_type")).alias("v"))
    return op.dominant(members, F.col("v"))


@query("""WITH m AS (SELECT p_partkey AS node, p_brand AS community FROM part), k AS (SELECT DISTINCT p_brand AS community, substr(p_brand, 1, 7) AS key FROM part), s AS (SELECT community, key, count(*) AS size FROM m JOIN k USING (community) GROUP BY 1, 2), t AS (SELECT key, arg_min(community, (-size, community)) AS target FROM s GROUP BY 1)
SELECT node, target AS community FROM m JOIN k USING (community) JOIN t USING (key)""")
def zones_merged_by_key(spark, sf_dir):
    members = table(spark, sf_dir, "part").select(F.lit("c").alias("component"), F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    keys = table(spark, sf_dir, "part").select(F.col("p_brand").alias("community"), F.substring("p_brand", 1, 7).alias("key")).distinct()
    return op.merged_by_key(members, keys).select("node", "community")


@query("""WITH z AS (SELECT p_partkey AS path, p_brand AS zone FROM part), b AS (SELECT p_partkey AS path, CASE WHEN p_partkey % 4 = 0 THEN 'old other' ELSE 'old ' || p_brand END AS name FROM part WHERE p_partkey % 9 <> 0), n AS (SELECT zone, name, count(*) AS n FROM z JOIN b USING (path) GROUP BY 1, 2), nz AS (SELECT zone, count(*) AS c FROM z GROUP BY 1), nb AS (SELECT name, count(*) AS c FROM b GROUP BY 1),
 o AS (SELECT zone, name, least(n / nz.c, n / nb.c) AS overlap FROM n JOIN nz USING (zone) JOIN nb USING (name)) SELECT zone, name FROM o WHERE overlap >= 0.5""")
def kept_zone_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    before = part.where("p_partkey % 9 != 0").select(F.col("p_partkey").alias("path"), F.when(F.col("p_partkey") % 4 == 0, "old other").otherwise(F.concat(F.lit("old "), "p_brand")).alias("zone"))
    return op.kept_names(part.select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("zone")), before)


@query("SELECT 'src/' || lower(p_type) || '/' || p_partkey || '.ts' AS path, CASE WHEN p_type = 'ECONOMY' THEN 'economy' WHEN p_partkey BETWEEN 10 AND 19 THEN 'teens' ELSE p_brand END AS zone FROM part")
def anchored_zones(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), "p_partkey", F.lit(".ts")).alias("path"), F.col("p_brand").alias("zone"))
    return op.anchored(rows, [("economy", "src/economy/**"), ("teens", "src/*/1?.ts")])


@query("""WITH f AS (SELECT 'd' || (p_size % 4) || '/' || p_partkey AS path, 'd' || (p_size % 4) AS dir, p_partkey AS k, p_brand AS zone FROM part), p AS (SELECT path, dir, k, 'Brand#' || (k % 25 + 1) AS zone FROM f WHERE k % 20 = 0), c AS (SELECT p.path, p.zone, f.dir AS there, count(*) AS n FROM p JOIN f ON f.zone = p.zone AND f.path <> p.path GROUP BY 1, 2, 3),
 b AS (SELECT path, zone, arg_min(there, (-n, there)) AS there FROM c GROUP BY 1, 2), e AS (SELECT 'd' || (a.p_size % 4) || '/' || a.p_partkey AS x, 'd' || (b.p_size % 4) || '/' || b.p_partkey AS y FROM part a JOIN part b ON b.p_partkey IN (a.p_partkey + 1, a.p_partkey * 2)),
 l AS (SELECT b.path, b.zone, count(*) AS n FROM b JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) u ON u.x = b.path JOIN f ON f.path = u.y AND f.zone = b.zone GROUP BY 1, 2)
SELECT b.path, b.zone, dir AS directory, there, coalesce(n, 0) AS edges FROM b JOIN f USING (path) LEFT JOIN l ON l.path = b.path AND l.zone = b.zone WHERE dir <> there""")
def pin_divergence(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    place = F.concat(F.lit("d"), F.col("p_size") % 4, F.lit("/"), F.col("p_partkey"))
    zones = part.select(place.alias("path"), F.col("p_brand").alias("zone"))
    pins = part.where("p_partkey % 20 = 0").select(place.alias("path"), F.concat(F.lit("Brand#"), F.col("p_partkey") % 25 + 1).alias("zone"))
    a, b = part.select(F.explode(F.array_distinct(F.array(F.col("p_partkey") + 1, F.col("p_partkey") * 2))).alias("other"), place.alias("from")), part.select(F.col("p_partkey").alias("other"), place.alias("to"))
    return op.pin_divergence(pins, zones, a.join(b, "other").select("from", "to"))


@query("""WITH f AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN 'top' || p_partkey ELSE p_type || '/' || p_partkey END AS path FROM part), t AS (SELECT path, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '.' END AS top FROM f) SELECT path, top || '#' || CAST(floor((row_number() OVER (PARTITION BY top ORDER BY path) - 1) / 100) AS BIGINT) AS chunk FROM t""")
def directory_chunks(spark, sf_dir):
    k = F.col("p_partkey")
    return op.dependency_chunks(table(spark, sf_dir, "part").select(F.when(k % 10 == 0, F.concat(F.lit("top"), k)).otherwise(F.concat_ws("/", "p_type", k)).alias("path")), 100)


def repository(spark, sf_dir):
    """Groups of customers and suppliers as files in a folder for each region and nation, joined by trade."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey", F.lit("/n"), "n_nationkey").alias("nation"))
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem").where("l_linenumber = 1"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    a, b = n.toDF("c_nationkey", "cn"), n.toDF("s_nationkey", "sn")
    near = rows.join(a, "c_nationkey").join(b, "s_nationkey").where("cn = sn or o_orderkey % 40 = 0")
    edges = near.groupBy(F.concat_ws("/", "cn", F.concat(F.lit("c"), F.col("c_custkey") % 6)).alias("from"), F.concat_ws("/", "sn", F.concat(F.lit("s"), F.col("s_suppkey") % 10)).alias("to")).agg(F.count("*").cast("double").alias("weight"))
    return edges, edges.select(F.col("from").alias("path")).union(edges.select("to")).distinct()


@query()
def zone_pipeline(spark, sf_dir):
    return op.zones_of(*repository(spark, sf_dir))


@query()
def zone_subdivision(spark, sf_dir):
    edges, files = repository(spark, sf_dir)
    return op.subdivided(edges, files.select("path", F.lit("all").alias("zone")), depth=1)
