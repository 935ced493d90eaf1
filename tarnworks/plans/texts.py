"""Queries over names and texts: n-grams, keywords, hashes, slugs, rules, search, duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnworks.functions import tables
from tarnworks.functions import text as fn
from tarnworks.operators import search as find
from tarnworks.operators import similarity as op
from tarnworks.plans.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


NAMES = "n AS (SELECT DISTINCT p_name AS name FROM part)"


def names(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()


GRAMS = "g AS (SELECT name, list_distinct(list_transform(range(1, greatest(1, length(name) - {n} + 2)), lambda i: substring(name, CAST(i AS BIGINT), {n}))) AS g FROM n)"
DICE, JACCARD = "2.0 * len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g))", "len(list_intersect(x.g, y.g)) / (len(x.g) + len(y.g) - len(list_intersect(x.g, y.g)))"


def all_gram_pairs(n, measure, least, shared):
    return lambda spark, sf_dir: op.gram_pairs(names(spark, sf_dir), n, measure, least, shared)


def all_gram_pairs_sql(n, score, least):
    return f"WITH {NAMES}, {GRAMS.format(n=n)}, s AS (SELECT x.name AS a, y.name AS b, {score} AS score FROM g x JOIN g y ON x.name < y.name) SELECT * FROM s WHERE score >= {least}"


for _suffix, _least in (("", 0.7), ("_all", 0.5)):  # over all names, whatever their first word
    QUERIES[f"dice_bigrams{_suffix}"], SQL[f"dice_bigrams{_suffix}"] = all_gram_pairs(2, fn.dice, _least, _least / (2 - _least)), all_gram_pairs_sql(2, DICE, _least)
    QUERIES[f"trigram_jaccard{_suffix}"], SQL[f"trigram_jaccard{_suffix}"] = all_gram_pairs(3, fn.jaccard, _least, _least), all_gram_pairs_sql(3, JACCARD, _least)


@query("SELECT doc_id, substr(sha256(lower(regexp_replace(source || '|' || lang || '|' || n_chars, '[0-9]+', 'N', 'g'))), 1, 12) AS hash FROM documents")
def finding_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.finding_hash(F.col("source"), F.col("lang"), F.col("n_chars").cast("string")).alias("hash"))


@query("SELECT source, substr(sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))), 1, 16) AS hash FROM documents GROUP BY 1")
def group_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(fn.group_hash(F.col("doc_id").cast("string")).alias("hash"))


QUERY_WORDS = ("small", "widget", "ring", "red")


@query(f"""SELECT p_partkey, len(list_filter([{', '.join(f"'{w}'" for w in QUERY_WORDS)}], lambda w: contains(lower(p_name), w))) AS matched FROM part WHERE len(list_filter([{', '.join(f"'{w}'" for w in QUERY_WORDS)}], lambda w: contains(lower(p_name), w))) > 0""")
def keyword_match(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", fn.matched_keywords(F.array(*map(F.lit, QUERY_WORDS)), F.col("p_name")).cast("long").alias("matched"))
    return rows.where("matched > 0")


@query("SELECT DISTINCT lang, list_filter(regexp_extract_all(lower(source), '[a-z]+'), lambda x: length(x) > 2)[1] AS word FROM documents")
def source_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", F.get(F.filter(F.regexp_extract_all(F.lower("source"), F.lit("([a-z]+)")), lambda w: F.length(w) > 2), F.lit(0)).alias("word")).distinct()


@query("""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1) AS path FROM pages) SELECT page_id, CASE WHEN regexp_matches(path, '^/en(/|$)') THEN 'docs' WHEN regexp_matches(path, '^/(fr|de)(/|$)') THEN 'asset' WHEN path = '' THEN 'none' ELSE 'other' END AS role, CASE WHEN path = '' THEN 'root' ELSE coalesce(nullif(split_part(substr(path, 2), '/', 1), ''), 'root') END AS category FROM p""")
def classify_rules(spark, sf_dir):
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^?#]*)", 1)
    role = F.when(path.rlike("^/en(/|$)"), "docs").when(path.rlike("^/(fr|de)(/|$)"), "asset").when(path == "", "none").otherwise("other")
    head = F.coalesce(F.nullif(F.split(F.substring(path, 2, 1000), "/")[0], F.lit("")), F.lit("root"))
    return table(spark, sf_dir, "pages").select("page_id", role.alias("role"), F.when(path == "", "root").otherwise(head).alias("category"))


@query("""WITH s AS (SELECT p_partkey, replace(p_name, ' ', '-') AS slug, p_brand FROM part), c AS (SELECT *, row_number() OVER (PARTITION BY p_brand, slug ORDER BY p_partkey) AS rn FROM s) SELECT p_partkey, CASE WHEN rn = 1 THEN slug ELSE slug || '-' || rn END AS slug FROM c""")
def slug_dedupe(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", fn.slug("p_name").alias("slug"))
    rn = F.row_number().over(Window.partitionBy("p_brand", "slug").orderBy("p_partkey"))
    return rows.withColumn("rn", rn).select("p_partkey", F.when(F.col("rn") == 1, F.col("slug")).otherwise(F.concat_ws("-", "slug", "rn")).alias("slug"))


WORDS = "list_filter(regexp_split_to_array(regexp_replace({t}, '[^a-z0-9\\s\\-_]', ' ', 'g'), '\\s+'), lambda w: w <> '')"


@query(f"""WITH i AS (SELECT p_partkey AS id, lower(p_name) AS title, lower(p_type) AS tags, lower(p_brand) AS description FROM part), f AS (SELECT id, 'title' AS field, title AS text, 10 AS weight FROM i UNION ALL SELECT id, 'tags', tags, 6 FROM i UNION ALL SELECT id, 'description', description, 3 FROM i),
 w AS (SELECT *, {WORDS.format(t='text')} AS words FROM f), h AS (SELECT id, field, weight, len(list_filter(words, lambda w: contains(w, 'ring'))) > 0 AS p0, len(list_filter(words, lambda w: starts_with(w, 'sma'))) > 0 AS p1, contains(text, 'small ring') AS p2 FROM w),
 s AS (SELECT id, CAST(sum(weight * (CAST(p0 AS INT) + CAST(p1 AS INT) + 2 * CAST(p2 AS INT))) AS BIGINT) AS score, bool_or(p0) AS a, bool_or(p1) AS b, bool_or(p2) AS c FROM h GROUP BY 1)
SELECT id, score, CAST(3 AS BIGINT) AS parts FROM s WHERE a AND b AND c ORDER BY score DESC, id LIMIT 50""")
def search_topk(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("tags"), F.col("p_brand").alias("description"))
    return find.search(rows, 'ring sma "small ring"')


@query("""WITH f AS (SELECT p_partkey AS id, 'title' AS field, lower(p_name) AS text FROM part UNION ALL SELECT p_partkey, 'tags', lower(p_type) FROM part), w AS (SELECT id, field, unnest(string_split(text, ' ')) AS word FROM f),
 q AS (SELECT unnest(['ring', 'in', 'mal', 'cono', 'sma', 'widgets']) AS query) SELECT DISTINCT query, id, field FROM w JOIN q ON word = query OR length(query) >= 3 AND starts_with(word, query) OR length(query) >= 4 AND contains(word, query)""")
def search_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("tags"))
    terms = spark.createDataFrame([(q,) for q in ("ring", "in", "mal", "cono", "sma", "widgets")], "query string")
    return find.matches(find.postings(rows), terms)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unlabelled_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def likeness(names: str) -> str:
    """CTE sc (a, b, score) of all pairs of the texts (t) that ``names`` gives."""
    verbs = "CASE f " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in op.VERBS.items()) + " END"
    stop = "[" + ", ".join(f"'{w}'" for w in op.NAME_STOP_WORDS) + "]"
    pairs = lambda t: f"list_distinct(list_transform(range(1, greatest(1, length({t}))), lambda i: substr({t}, CAST(i AS INT), 2)))"
    words = lambda t: f"list_distinct(list_filter(string_split({t}, ' '), lambda w: w <> ''))"

    def plain(t, g, w):
        near = f"len(list_filter(x.{w}, lambda p: NOT list_contains(y.{w}, p) AND len(list_filter(y.{w}, lambda q: starts_with(q, p) OR starts_with(p, q))) > 0))"
        by_words = f"CASE WHEN len(x.{w}) = 0 OR len(y.{w}) = 0 THEN 0 ELSE (len(list_intersect(x.{w}, y.{w})) + 0.8::DOUBLE * {near}) / (len(list_distinct(list_concat(x.{w}, y.{w}))) - {near}) END"
        by_grams = f"CASE WHEN len(x.{g}) = 0 OR len(y.{g}) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(x.{g}, y.{g})) / (len(x.{g}) + len(y.{g})) END"
        holds = f"greatest(0.7::DOUBLE, least(length(x.{t}), length(y.{t}))::DOUBLE / greatest(length(x.{t}), length(y.{t})))"
        return f"CASE WHEN x.{t} = '' OR y.{t} = '' THEN 0 WHEN contains(x.{t}, y.{t}) OR contains(y.{t}, x.{t}) THEN {holds} ELSE greatest({by_grams}, {by_words}) END"

    by_verb = f"least(1.0::DOUBLE, 0.85::DOUBLE * ({plain('ct', 'cg', 'cw')}) + CASE WHEN x.verb = y.verb THEN 0.15::DOUBLE ELSE 0 END)"
    return f"""src AS (SELECT DISTINCT t FROM ({names}) WHERE t <> ''), v AS (SELECT t, string_split(t, ' ') AS ws, regexp_replace(string_split(t, ' ')[1], ':$', '') AS f FROM src),
 u AS (SELECT t, {verbs} AS verb, CASE WHEN f = 'set' AND ws[2] = 'up' THEN ws[3:] ELSE ws[2:] END AS rest FROM v), c AS (SELECT t, verb, coalesce(array_to_string(list_filter(rest, lambda w: NOT list_contains({stop}, w)), ' '), '') AS ct FROM u),
 m AS (SELECT t, verb, ct, {pairs('t')} AS g, {words('t')} AS w, {pairs('ct')} AS cg, {words('ct')} AS cw FROM c),
 sc AS (SELECT x.t AS a, y.t AS b, CASE WHEN x.t = y.t THEN 1.0::DOUBLE WHEN x.verb IS NOT NULL AND y.verb IS NOT NULL AND x.ct <> '' AND y.ct <> '' THEN {by_verb} ELSE {plain('t', 'g', 'w')} END AS score FROM m x, m y)"""


SHOWN = "floor(score * 1000000 + 0.5) / 1000000 AS score"


def shown(rows):
    return rows.withColumn("score", F.floor(F.col("score") * 1000000 + 0.5) / 1000000)


TITLES = "SELECT p_partkey, lower(CASE p_size % 4 WHEN 0 THEN 'add ' WHEN 1 THEN 'build the ' WHEN 2 THEN 'fix: ' ELSE '' END || p_name) AS t FROM part"


def titles(spark, sf_dir):
    """Names of parts, some after a verb."""
    verb = F.when(F.col("p_size") % 4 == 0, "add ").when(F.col("p_size") % 4 == 1, "build the ").when(F.col("p_size") % 4 == 2, "fix: ").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat(verb, "p_name")).alias("name"))


@query(f"WITH {likeness('SELECT p_name AS t FROM part')} SELECT a, b, {SHOWN} FROM sc WHERE a < b AND score >= 0.7")
def similar_names(spark, sf_dir):
    return shown(op.similar_pairs(names(spark, sf_dir), 0.7))


@query(f"WITH {likeness(TITLES)} SELECT a, b, {SHOWN} FROM sc WHERE a < b AND score >= 0.8")
def similar_titles(spark, sf_dir):
    return shown(op.similar_pairs(titles(spark, sf_dir), 0.8))


@query(f"""WITH RECURSIVE {likeness('SELECT p_name AS t FROM part')}, l AS (SELECT a, b FROM sc WHERE a <> b AND (a < b AND score >= 0.8 OR (b, a) IN (SELECT (z.a, z.b) FROM sc z WHERE z.a < z.b AND z.score >= 0.8))),
 r AS (SELECT DISTINCT a AS name, a AS other FROM l UNION SELECT r.name, l.b FROM r JOIN l ON l.a = r.other), k AS (SELECT name, min(other) AS cluster FROM r GROUP BY 1)
SELECT p_partkey, p_name, coalesce(cluster, p_name) AS cluster FROM part LEFT JOIN k ON name = p_name""")
def duplicate_clusters(spark, sf_dir):
    return op.duplicate_groups(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", 0.8)


#: Pairs in either order count if the one in alphabetical order does; the score is then that of the order asked for.
ALIKE = "(x.score >= {least} AND (x.a = x.b OR CASE WHEN x.a < x.b THEN x.score ELSE (SELECT y.score FROM sc y WHERE y.a = x.b AND y.b = x.a) END >= {least}))"


def best_sql(proposals, items, least):
    return f"""h AS (SELECT x.a AS p, x.b AS i, x.score FROM sc x WHERE x.a IN ({proposals}) AND x.b IN ({items}) AND {ALIKE.format(least=least)}), best AS (SELECT p, i, score, row_number() OVER (PARTITION BY p ORDER BY score DESC, i) AS rn FROM h)"""


EVEN, ODD = "SELECT 'add ' || p_name AS t FROM part WHERE p_partkey % 2 = 0", "SELECT p_name AS t FROM part WHERE p_partkey % 2 = 1"


@query(f"WITH {likeness(f'{EVEN} UNION {ODD}')}, {best_sql(EVEN, ODD, 0.7)} SELECT p AS proposal, i AS item, {SHOWN} FROM best WHERE rn = 1")
def entity_matches(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return shown(op.best_matches(part.where("p_partkey % 2 = 0").select(F.concat(F.lit("add "), "p_name").alias("name")), part.where("p_partkey % 2 = 1").select(F.col("p_name").alias("name"))))


@query(f"""WITH {likeness("SELECT p_name AS t FROM part WHERE p_partkey % 3 = 1 UNION SELECT 'the ' || p_name FROM part WHERE p_partkey % 3 = 0")},
 d AS (SELECT a, b, score, CASE WHEN a < b THEN score ELSE (SELECT y.score FROM sc y WHERE y.a = x.b AND y.b = x.a) END AS ordered FROM sc x),
 e AS (SELECT n.p_partkey AS node, i.p_partkey AS item, CASE WHEN a = b THEN 1.0::DOUBLE WHEN length(a) >= 5 AND length(b) >= 5 AND (contains(a, b) OR contains(b, a)) THEN 0.95::DOUBLE ELSE score END AS score
  FROM part n JOIN d ON d.a = 'the ' || n.p_name JOIN part i ON i.p_name = d.b AND i.p_type = n.p_type WHERE n.p_partkey % 3 = 0 AND i.p_partkey % 3 = 1 AND (a = b OR ordered >= 0.7)),
 f AS (SELECT node, item, score, row_number() OVER (PARTITION BY node ORDER BY score DESC, item) AS rn FROM e WHERE score >= 0.7)
SELECT node, item, {SHOWN}, CASE WHEN score = 1 THEN 'exact_title' ELSE 'semantic_title' END AS reason FROM f WHERE rn = 1""")
def matched_nodes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    row = lambda k, title: part.where(f"p_partkey % 3 = {k}").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("level"), title.alias("title"))
    return shown(op.matched_nodes(row(0, F.concat(F.lit("the "), "p_name")), row(1, F.col("p_name"))))


NEW, OLD = "SELECT 'add ' || p_name AS t FROM part WHERE p_partkey % 7 = 0", "SELECT 'build ' || p_name AS t FROM part WHERE p_partkey % 7 = 1 AND p_size <= 25"


@query(f"""WITH {likeness(f'{NEW} UNION {OLD}')}, {best_sql(NEW, OLD, 0.7)}, n AS (SELECT p_partkey AS id, 'add ' || p_name AS t FROM part WHERE p_partkey % 7 = 0), o AS (SELECT 'build ' || p_name AS t, min(p_partkey) AS other FROM part WHERE p_partkey % 7 = 1 AND p_size <= 25 GROUP BY 1),
 lead AS (SELECT t, min(id) AS other FROM n GROUP BY 1),
 w AS (SELECT n.id, lead.other, coalesce((SELECT s.score FROM sc s WHERE s.a = least(n.t, lead.t) AND s.b = greatest(n.t, lead.t)), 0) AS score FROM n, lead WHERE lead.other < n.id),
 z AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY other) AS rn FROM w WHERE score >= 0.95)
SELECT n.id, o.other, {SHOWN}, 'tree' AS kind FROM best JOIN n ON n.t = p JOIN o ON o.t = i WHERE rn = 1 UNION ALL SELECT id, other, {SHOWN}, 'batch' FROM z WHERE rn = 1""")
def recommendation_conflicts(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    new = part.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("id"), F.concat(F.lit("add "), "p_name").alias("title"))
    return shown(op.conflicts(new, part.where("p_partkey % 7 = 1").select(F.col("p_partkey").alias("id"), F.concat(F.lit("build "), "p_name").alias("title"), F.when(F.col("p_size") > 25, "completed").otherwise("pending").alias("status"))))


FIXES, SMALL = "SELECT 'fix ' || p_name AS t FROM part", "SELECT p_name AS t FROM part WHERE p_name LIKE 'small%'"


@query(f"WITH {likeness(f'{FIXES} UNION {SMALL}')}, {best_sql(FIXES, SMALL, 0.7)} SELECT DISTINCT 'fix ' || p_name AS name FROM part WHERE 'fix ' || p_name NOT IN (SELECT p FROM best)")
def unmatched_proposals(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return op.unmatched(part.select(F.concat(F.lit("fix "), "p_name").alias("name")).distinct(), part.where("p_name like 'small%'").select(F.col("p_name").alias("name")).distinct())


@query(f"""WITH {likeness('SELECT lower(p_name) AS t FROM part UNION SELECT lower(p_type) FROM part UNION SELECT lower(p_brand) FROM part')},
 f AS (SELECT p_partkey AS id, lower(p_name) AS t, CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) END AS d, list_distinct([lower(p_type), lower(p_brand)]) AS g, lower(p_brand) AS c FROM part), e AS (SELECT * FROM f WHERE id < 20),
 p AS (SELECT f.id AS feature, e.id AS epic, x.score AS s, coalesce(y.score, 0) AS d, z.score AS k, len(list_intersect(f.g, e.g)) / len(list_distinct(list_concat(f.g, e.g))) AS g
  FROM f JOIN e ON true JOIN sc x ON x.a = f.t AND x.b = e.t LEFT JOIN sc y ON y.a = f.d AND y.b = e.d JOIN sc z ON z.a = f.c AND z.b = e.c),
 q AS (SELECT feature, epic, s * CASE WHEN d > 0 THEN 0.45::DOUBLE ELSE 0.45::DOUBLE + 0.25::DOUBLE END + CASE WHEN d > 0 THEN d * 0.25::DOUBLE ELSE 0 END + g * 0.10::DOUBLE + k * 0.20::DOUBLE AS score FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY score DESC, epic) AS rn FROM q WHERE score >= 0.15)
SELECT feature, epic, {SHOWN} FROM r WHERE rn <= 5""")
def epics_of_features(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    row = lambda t: t.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")).alias("description"), F.array("p_type", F.lower("p_brand")).alias("tags"), F.col("p_brand").alias("children"))
    return shown(op.epics_of_features(row(part), row(part.where("p_partkey < 20"))))


@query(f"""WITH {likeness('SELECT p_name AS t FROM part')} SELECT x.p_partkey AS a, y.p_partkey AS b, {SHOWN} FROM part x JOIN part y ON x.p_partkey % 50 = y.p_partkey % 50 AND x.p_partkey < y.p_partkey
 JOIN sc ON sc.a = least(x.p_name, y.p_name) AND sc.b = greatest(x.p_name, y.p_name) WHERE score >= 0.75""")
def sibling_duplicates(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 50).alias("parent_id"), F.lit("task").alias("level"), F.lit("pending").alias("status"), F.col("p_name").alias("title"))
    return shown(op.sibling_duplicates(rows))


BLENDS = "WITH b AS (SELECT p_partkey, (p_partkey % 101) / 100.0 AS n, (p_partkey % 37) / 36.0 AS d, (p_partkey % 5) / 4.0 AS g FROM part) SELECT p_partkey, floor(greatest(n, CASE WHEN d >= 0.8 THEN d * 0.9 + n * 0.1 WHEN d >= 0.5 THEN n * 0.6 + d * 0.4 ELSE n END) * 1000000 + 0.5) / 1000000 AS blended, floor((n * CASE WHEN d > 0 THEN 0.45 ELSE 0.7 END + d * 0.25 + g * 0.1 + n * 0.2) * 1000000 + 0.5) / 1000000 AS combined, floor(greatest(n, n * 0.75 + d * 0.25, d * 0.7) * 1000000 + 0.5) / 1000000 AS node FROM b"


@query(BLENDS)
def blended_scores(spark, sf_dir):
    k = F.col("p_partkey")
    n, d, g = (k % 101) / 100.0, (k % 37) / 36.0, (k % 5) / 4.0
    shown = lambda c: F.floor(c * 1000000 + 0.5) / 1000000
    return table(spark, sf_dir, "part").select("p_partkey", shown(op.blended(n, d)).alias("blended"), shown(op.combined(n, d, g, n)).alias("combined"), shown(op.node_score(n, d)).alias("node"))


STOP_WORDS = "[" + ", ".join(f"'{w}'" for w in find.SEARCH_STOP_WORDS) + "]"


@query(f"""WITH q AS (SELECT '"' || role || ' Said" ' || CASE WHEN turn % 2 = 0 THEN text ELSE replace(text, '. ', ' OR ') END AS raw FROM conversations), r AS (SELECT raw, regexp_replace(raw, '"[^"]+"', ' ', 'g') AS rest FROM q),
 p AS (SELECT 'phrase' AS kind, unnest(list_filter(list_transform(regexp_extract_all(raw, '"([^"]+)"', 1), lambda x: lower(trim(x))), lambda x: x <> '')) AS part, regexp_matches(rest, '\\bOR\\b') AS either FROM r
  UNION ALL SELECT 'term', unnest(list_filter(string_split_regex(regexp_replace(lower(regexp_replace(rest, '\\bOR\\b', ' ', 'g')), '[^a-z0-9\\s\\-_]', ' ', 'g'), '\\s+'), lambda x: x <> '' AND NOT list_contains({STOP_WORDS}, x))), regexp_matches(rest, '\\bOR\\b') FROM r)
SELECT kind, part, either, count(*) AS n FROM p GROUP BY 1, 2, 3""")
def query_parts(spark, sf_dir):
    """Turns of conversations as searches, by a table function in SQL."""
    tables.registered(spark)
    raw = F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.replace("text", F.lit(". "), F.lit(" OR ")))
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit('"'), "role", F.lit(' Said" '), raw).alias("raw"))
    return spark.sql("SELECT p.kind, p.part, p.either, count(*) AS n FROM {rows} q, LATERAL query_parts(q.raw) p GROUP BY ALL", rows=rows)


@query("""SELECT event_id, 0 AS place, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS at, CAST(NULL AS DOUBLE) AS value FROM events
UNION ALL SELECT event_id, 3, event_id + 9007199254740993, event_type, value FROM events""")
def log_lines(spark, sf_dir):
    """Logs of lines, some of them blank or broken, as rows with fields that the call names."""
    tables.registered(spark)
    e = table(spark, sf_dir, "events")
    last = F.to_json(F.struct((F.col("event_id") + 9007199254740993).alias("k"), F.col("event_type").alias("at"), "value"))
    logs = e.select("event_id", F.concat_ws("\n", "props", F.lit(""), F.lit('{"k": 1'), last, F.lit("[1]")).alias("text"))
    return spark.sql("SELECT q.event_id, r.* FROM {logs} q, LATERAL json_lines(q.text, 'k bigint, at string, value double') r", logs=logs)
