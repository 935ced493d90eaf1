"""Queries of column expressions over whole tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnworks.functions import envelopes, scalars, text
from tarnworks.operators import items as it
from tarnworks.plans.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def picked(key, *values):
    """One of the texts, by a key's remainder."""
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def picked_sql(key, *values):
    return f"[{', '.join(chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for v in values)}][{key} % {len(values)} + 1]"


BRANCHES = ("main", "feature/x-", "feat-", "HOTFIX/", "bug/", "release-", "rel/", "develop", "topic/feature/", "fix")


@query(f"""WITH b AS (SELECT p_partkey, {picked_sql('p_partkey', *BRANCHES)} || CASE WHEN p_partkey % 10 IN (0, 7) THEN '' ELSE CAST(p_partkey AS VARCHAR) END AS name FROM part)
SELECT p_partkey, CASE WHEN lower(name) IN ('main', 'master', 'develop', 'trunk') THEN 'main' WHEN regexp_matches(lower(name), '^(feature|feat)[/-]') THEN 'feature' WHEN regexp_matches(lower(name), '^hotfix[/-]') THEN 'hotfix' WHEN regexp_matches(lower(name), '^(bugfix|fix|bug)[/-]') THEN 'bugfix' WHEN regexp_matches(lower(name), '^(release|rel)[/-]') THEN 'release' ELSE 'other' END AS kind FROM b""")
def branch_kinds(spark, sf_dir):
    name = F.concat(picked(F.col("p_partkey"), *BRANCHES), F.when((F.col("p_partkey") % 10).isin(0, 7), "").otherwise(F.col("p_partkey").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", text.branch_kind(name).alias("kind"))


@query("""SELECT o_orderkey, o_orderstatus <> 'P' AND o_orderdate >= TIMESTAMP '1998-01-01 00:00:00' AS included, CASE WHEN o_orderstatus = 'P' THEN 'not completed' WHEN o_orderdate < TIMESTAMP '1998-01-01 00:00:00' THEN 'before the branch' END AS reason FROM orders""")
def branch_scopes(spark, sf_dir):
    done = F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate"))
    rows = table(spark, sf_dir, "orders").withColumn("completed_at", done)
    return it.branch_scope(rows, F.lit("1998-01-01 00:00:00").cast("timestamp")).select("o_orderkey", "included", "reason")


TITLES = ("small fix", "Breaking change of names", "not BREAKING", "backward-incompatible move", "unbreaking", "plain")
TAGGED = ("x", "breaking-change", "y:z")


@query(f"""WITH t AS (SELECT p_partkey, {picked_sql('p_partkey', *TITLES)} AS title, {picked_sql('p_partkey', *TAGGED)} AS tag, {picked_sql('p_partkey', 'epic', 'feature', 'task', 'task', 'subtask')} AS level, {picked_sql('p_partkey', 'low', 'critical', 'high', 'medium', 'medium', 'low', 'low')} AS priority FROM part),
 b AS (SELECT *, regexp_matches(title || ' ' || tag, '(?i)breaking[- ]change|\\bbreaking\\b|backwards?[- ]incompatible') AS breaking FROM t)
SELECT p_partkey, breaking, CASE WHEN breaking OR level = 'epic' OR priority = 'critical' THEN 'major' WHEN level = 'feature' THEN 'minor' ELSE 'patch' END AS significance FROM b""")
def significances(spark, sf_dir):
    none = F.array().cast("array<string>")
    breaking = it.is_breaking(picked(F.col("p_partkey"), *TITLES), F.lit(None).cast("string"), F.array(picked(F.col("p_partkey"), *TAGGED)), none)
    level, priority = picked(F.col("p_partkey"), "epic", "feature", "task", "task", "subtask"), picked(F.col("p_partkey"), "low", "critical", "high", "medium", "medium", "low", "low")
    rows = table(spark, sf_dir, "part").select("p_partkey", breaking.alias("breaking"), level.alias("level"), priority.alias("priority"))
    return rows.select("p_partkey", "breaking", it.significance(F.col("breaking"), F.col("level"), F.col("priority")).alias("significance"))


def tagged_parts(spark, sf_dir):
    tags = F.array(F.concat(F.lit("kind:"), "p_type"), F.concat(F.lit("size:"), F.col("p_size") % 7), "p_brand", F.concat(F.lit("size:"), F.col("p_size") % 5), F.lit(":odd"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), tags.alias("tags"), picked(F.col("p_partkey"), "pending", "completed", "blocked").alias("status"))


TAGS = "t AS (SELECT p_partkey AS id, ['kind:' || p_type, 'size:' || (p_size % 7), p_brand, 'size:' || (p_size % 5), ':odd'] AS tags, ['pending', 'completed', 'blocked'][p_partkey % 3 + 1] AS status FROM part)"


@query(f"WITH {TAGS} SELECT id FROM t WHERE list_has_any(tags, ['size:3', 'Brand#4'])")
def tagged_items(spark, sf_dir):
    return it.tagged(tagged_parts(spark, sf_dir), "size:3", "Brand#4").select("id")


@query(f"WITH {TAGS} SELECT id FROM t WHERE status IN ('pending', 'blocked') AND list_has_all(tags, ['size:3', 'kind:ECONOMY'])")
def facet_filter(spark, sf_dir):
    return it.passing_facets(tagged_parts(spark, sf_dir), ["pending", "blocked"], ["size:3", "kind:ECONOMY"]).select("id")


@query("SELECT p_partkey AS id, 'kind' AS key, p_type AS value FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size % 5 AS VARCHAR) FROM part")
def item_facets(spark, sf_dir):
    return it.facets(tagged_parts(spark, sf_dir))


@query(f"WITH {TAGS} SELECT DISTINCT unnest(tags) AS tag FROM t")
def all_tags(spark, sf_dir):
    from tarnworks.operators.tree import distinct_tags

    return distinct_tags(tagged_parts(spark, sf_dir))


@query("""SELECT user_id, count(*) AS used, CASE WHEN user_id % 4 = 0 THEN 5 WHEN user_id % 3 = 0 THEN 40 WHEN user_id % 5 <> 0 THEN 100 END AS budget, CASE WHEN user_id % 4 = 0 THEN 'model' WHEN user_id % 3 = 0 THEN 'vendor' WHEN user_id % 5 <> 0 THEN 'global' ELSE 'none' END AS reason FROM events GROUP BY user_id""")
def weekly_budgets(spark, sf_dir):
    u = F.col("user_id")
    budget, reason = scalars.weekly_budget(F.when(u % 4 == 0, 5), F.when(u % 3 == 0, 40), F.when(u % 5 != 0, 100))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("used")).withColumns({"budget": budget, "reason": reason})


@query("SELECT event_id, CASE WHEN value >= 95 THEN 'reject' WHEN value >= 80 THEN 'delay' ELSE 'allow' END AS decision, CAST(least(30000, 2000 * pow(2, user_id % 10)) AS BIGINT) AS wait_ms FROM events")
def memory_decisions(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", scalars.memory_decision(F.col("value")).alias("decision"), scalars.backoff_ms(F.col("user_id") % 10).alias("wait_ms"))


@query("SELECT p_brand, CASE WHEN count(*) >= 2 AND avg(p_size) <> 0 THEN floor(stddev_pop(p_size) / avg(p_size) * 10000.0 + 0.5) / 10000.0 END AS variation FROM part GROUP BY 1")
def size_variation(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(scalars.half_up(scalars.variation(F.col("p_size")), 4).alias("variation"))


STATUSES = ("pending", "in_progress", "completed", "failing", "deferred", "blocked", "deleted")
ALLOWED = "t(a, b) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, bs in scalars.TRANSITIONS.items() for b in (*bs, a)) + ")"


@query(f"WITH {ALLOWED}, m AS (SELECT p_partkey, {picked_sql('p_partkey', *STATUSES)} AS a, {picked_sql('(p_partkey // 7)', *STATUSES)} AS b FROM part) SELECT p_partkey, EXISTS (SELECT 1 FROM t WHERE t.a = m.a AND t.b = m.b) AS allowed FROM m")
def transitions(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.may_follow(picked(F.col("p_partkey"), *STATUSES), picked(F.floor(F.col("p_partkey") / 7).cast("long"), *STATUSES)).alias("allowed"))


METRICS = ("12", " 3.5 ", "took 7 of 9.25 s", "none", "-4", "v1.2 at -8")


@query(f"WITH m AS (SELECT p_partkey, {picked_sql('p_partkey', *METRICS)} AS t FROM part) SELECT p_partkey, coalesce(TRY_CAST(trim(t) AS DOUBLE), TRY_CAST(list_extract(regexp_extract_all(t, '(-?\\d+(?:\\.\\d+)?)', 1), -1) AS DOUBLE)) AS metric FROM m")
def metric_values(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.metric_value(picked(F.col("p_partkey"), *METRICS)).alias("metric"))


@query("""WITH w AS (SELECT DISTINCT p_name, p_type FROM part), k AS (SELECT p_name, p_type, list_filter(regexp_split_to_array(regexp_replace(lower('Add the ' || p_name || ' to a test_case, when all of ' || p_type || 's-x are in'), '[^a-z0-9\\-_\\s]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'to', 'a', 'when', 'all', 'of', 'are', 'in')) AS k FROM w)
SELECT p_name, p_type, list_aggregate(list_sort(list_distinct(k)), 'string_agg', ',') AS words FROM k""")
def keyword_sets(spark, sf_dir):
    said = F.concat(F.lit("Add the "), "p_name", F.lit(" to a test_case, when all of "), "p_type", F.lit("s-x are in"))
    return table(spark, sf_dir, "part").select("p_name", "p_type").distinct().select("p_name", "p_type", F.array_join(F.array_sort(text.keywords(said)), ",").alias("words"))


PATHS = ("src/a.test.ts", "tests/x.py", "dist/b.js", "package.json", "docs/a.md", "img/logo.PNG", "Makefile", "packages/web/src/app.tsx", "bin/run", "lib/x_test.go", "README.rst", "api/types.d.ts")


@query("WITH r(k, path, role, category, package) AS (VALUES (0, 'src/a.test.ts', 'test', 'root', 'src'), (1, 'tests/x.py', 'test', 'tests', 'tests'), (2, 'dist/b.js', 'generated', 'dist', 'dist'), (3, 'package.json', 'config', 'root', 'package.json'), (4, 'docs/a.md', 'docs', 'docs', 'docs'), (5, 'img/logo.PNG', 'asset', 'img', 'img'), (6, 'Makefile', 'build', 'root', 'Makefile'), (7, 'packages/web/src/app.tsx', 'source', 'web', 'packages'), (8, 'bin/run', 'other', 'bin', 'bin'), (9, 'lib/x_test.go', 'test', 'root', 'lib'), (10, 'README.rst', 'docs', 'root', 'README.rst'), (11, 'api/types.d.ts', 'generated', 'api', 'api')) SELECT p_partkey, path, role, category, package FROM part JOIN r ON p_partkey % 12 = k")
def path_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", picked(F.col("p_partkey"), *PATHS).alias("path"))
    return rows.select("*", text.file_role(F.col("path")).alias("role"), text.first_directory(F.col("path")).alias("category"), text.package_name(F.col("path")).alias("package"))


LINES = ("OVERVIEW & GOALS", "Scope:", "-----", "Plain line.", "Overview:x", "1. It must start [high].", "P1 later", "===")


@query(f"WITH l AS (SELECT p_partkey, {picked_sql('p_partkey', *LINES)} AS line FROM part) SELECT p_partkey, line IN ('OVERVIEW & GOALS') AS capitals, line = 'Scope:' AS colon, line IN ('-----', '===') AS separator, CASE WHEN line LIKE '%[high]%' THEN 'high' WHEN line LIKE 'P1%' THEN 'high' END AS priority FROM l")
def line_kinds(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", picked(F.col("p_partkey"), *LINES).alias("line"))
    line = F.col("line")
    return rows.select("p_partkey", text.is_capitals_header(line).alias("capitals"), text.is_colon_header(line).alias("colon"), text.is_separator(line).alias("separator"), text.priority_tag(line).alias("priority"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'It must do ' || user_id || ' things.' || CASE WHEN event_id % 3 = 0 THEN '|This should hold!' ELSE '' END ELSE CASE WHEN event_id % 3 = 0 THEN 'This should hold!' ELSE '' END END AS sentences, 'src/m' || user_id || '/a.ts,lib/b.py' AS paths, 'Ann B.,Zoe' AS authors FROM events""")
def text_parts(spark, sf_dir):
    first = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("It must do "), "user_id", F.lit(" things. "))).otherwise("It does. ")
    second = F.when(F.col("event_id") % 3 == 0, "This should hold! ").otherwise("")
    said = F.concat(first, second, F.lit("Nothing else"))
    message = F.concat(F.lit("touch src/m"), "user_id", F.lit("/a.ts and lib/b.py\n\nCo-authored-by: Ann B. <a@b.c>\nco-authored-by: Zoe"))
    joined = lambda c, by: F.array_join(c, by)
    return table(spark, sf_dir, "events").select("event_id", joined(text.requirement_sentences(said), "|").alias("sentences"), joined(text.file_paths(message), ",").alias("paths"), joined(text.co_authors(message), ",").alias("authors"))


@query("SELECT user_id, CASE WHEN user_id % 3 = 2 THEN 'big-4-x' ELSE 'big-4' END AS model, 'a=' || chr(39) || 'b' || chr(39) || user_id AS code FROM events")
def normalized_texts(spark, sf_dir):
    u = F.col("user_id")
    model = F.when(u % 3 == 0, "big-4-20250101").when(u % 3 == 1, "big-4-2025-01-01").otherwise("big-4-x")
    code = F.concat(F.lit('a = "b" /* note */ '), u, F.lit(" // rest"))
    return table(spark, sf_dir, "events").select("user_id", text.without_date_suffix(model).alias("model"), text.comparable(code).alias("code"))


GLOBS = (("all_ts", "src/**/*.ts"), ("one", "src/?.ts"), ("top", "*.md"))
GLOB_PATHS = ("src/a.ts", "src/x/y/b.ts", "README.md", "docs/a.md", "src/ab.tsx")


@query(f"WITH p AS (SELECT p_partkey, {picked_sql('p_partkey', *GLOB_PATHS)} AS path FROM part) SELECT p_partkey, path IN ('src/a.ts', 'src/x/y/b.ts') AS all_ts, path = 'src/a.ts' AS one, path = 'README.md' AS top FROM p")
def glob_matches(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", picked(F.col("p_partkey"), *GLOB_PATHS).alias("path"))
    return rows.select("p_partkey", *(F.col("path").rlike(text.glob_pattern(g)).alias(n) for n, g in GLOBS))


SLUGS = ("  Add: the  Login!", "---", "a_b - c", "x" * 50)


@query(f"WITH t AS (SELECT p_partkey % 4 AS k, CAST(p_partkey + 100000000 AS VARCHAR) AS id, p_partkey FROM part) SELECT p_partkey, CASE k WHEN 0 THEN 'add-the-login' WHEN 1 THEN substr(id, 1, 8) WHEN 2 THEN 'a_b-c' ELSE '{'x' * 40}' END AS slug FROM t")
def item_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.item_slug(picked(F.col("p_partkey"), *SLUGS), (F.col("p_partkey") + 100000000).cast("string")).alias("slug"))


@query("""WITH w AS (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 13 AS n FROM part)
SELECT p_partkey, CAST(CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE least(10, greatest(1, n + CASE WHEN a = b THEN n + 1 ELSE 0 END)) END AS BIGINT) AS weight FROM w""")
def import_weights(spark, sf_dir):
    first, second = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    code = F.concat(F.lit("import { "), first, F.lit(", "), second, F.lit(" } ;"), F.repeat(F.concat(F.lit(" "), first, F.lit("();")), (F.col("p_partkey") % 13).cast("int")))
    symbols = F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit("*"), F.lit("default"), F.lit("unknown"))).otherwise(F.array(first))
    return table(spark, sf_dir, "part").select("p_partkey", text.import_weight(symbols, text.identifier_counts(code)).alias("weight"))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def counted_kinds(spark, sf_dir):
    """Counts as a map, read back by key."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(text.counted_map(F.collect_list("event_type")).alias("n"))
    at = lambda k: F.coalesce(F.try_element_at("n", F.lit(k)), F.lit(0).cast("long"))
    return rows.select("user_id", at("click").alias("clicks"), at("error").alias("errors"))


ANSWERS = ('{"a": 1}', 'Here: ```json\n{"a": 2}\n``` done', 'so {"a": 3} it is', 'list [1, 2] only', "nothing", '{"a": broken')


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN '1' WHEN 1 THEN '2' WHEN 2 THEN '3' END AS a, event_id % 6 = 3 AS listed FROM events""")
def tolerant_answers(spark, sf_dir):
    answer = picked(F.col("event_id"), *ANSWERS)
    rows = table(spark, sf_dir, "events").select("event_id", envelopes.tolerant_json(answer).alias("j"))
    return rows.select("event_id", F.get_json_object("j", "$.a").alias("a"), F.coalesce(F.get_json_object("j", "$.zones[1]") == "2", F.lit(False)).alias("listed"))


def envelope(spark, sf_dir):
    """Usage as four vendors tell it, some of it missing."""
    e, n = F.col("event_id"), F.floor("value").cast("long")
    body = F.when(e % 4 == 0, F.concat(F.lit('{"input_tokens":'), n, F.lit(',"output_tokens":'), e % 9, F.lit(',"cache_read_input_tokens":'), e % 5, F.lit("}"))).when(e % 4 == 1, F.concat(F.lit('{"total_input_tokens":'), n, F.lit("}"))).when(e % 4 == 2, F.concat(F.lit('{"type":"x","usage":{"input_tokens":'), n, F.lit(',"output_tokens":"many"}}'))).otherwise(F.concat(F.lit('{"usage":{"prompt_tokens":'), n, F.lit(',"completion_tokens":7}}')))
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"))


@query("""WITH v AS (SELECT event_id AS e, CAST(floor(value) AS BIGINT) AS n FROM events)
SELECT e AS event_id, 'api' AS dialect, CASE WHEN e % 4 = 0 THEN n ELSE 0 END AS input, CASE WHEN e % 4 = 0 THEN e % 9 ELSE 0 END AS output, CASE WHEN e % 4 = 0 THEN e % 5 ELSE 0 END AS cached, CASE WHEN e % 4 = 0 THEN 'complete' ELSE 'unavailable' END AS status FROM v
UNION ALL SELECT e, 'cli', CASE WHEN e % 4 < 2 THEN n ELSE 0 END, CASE WHEN e % 4 = 0 THEN e % 9 ELSE 0 END, CASE WHEN e % 4 = 0 THEN e % 5 ELSE 0 END, CASE e % 4 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'unavailable' END FROM v
UNION ALL SELECT e, 'stream', CASE WHEN e % 4 < 3 THEN n ELSE 0 END, CASE WHEN e % 4 = 0 THEN e % 9 ELSE 0 END, CASE WHEN e % 4 = 0 THEN e % 5 ELSE 0 END, CASE e % 4 WHEN 0 THEN 'complete' WHEN 3 THEN 'unavailable' ELSE 'partial' END FROM v
UNION ALL SELECT e, 'prompt', CASE WHEN e % 4 <> 1 THEN n ELSE 0 END, CASE e % 4 WHEN 0 THEN e % 9 WHEN 3 THEN 7 ELSE 0 END, CASE WHEN e % 4 = 0 THEN e % 5 ELSE 0 END, CASE e % 4 WHEN 0 THEN 'complete' WHEN 3 THEN 'complete' WHEN 2 THEN 'partial' ELSE 'unavailable' END FROM v""")
def usage_envelopes(spark, sf_dir):
    rows, out = envelope(spark, sf_dir), None
    for dialect in ("api", "cli", "stream", "prompt"):
        part = rows.withColumn("u", envelopes.usage(F.col("body"), dialect)).select("event_id", F.lit(dialect).alias("dialect"), "u.input", "u.output", F.col("u.cache_read").alias("cached"), "u.status")
        out = part if out is None else out.unionByName(part)
    return out


@query("""WITH r AS (SELECT user_id, CASE user_id % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'google' ELSE 'other' END AS vendor, CASE WHEN user_id % 7 = 0 THEN 0 ELSE CAST(sum(floor(value)) AS BIGINT) END AS i, CASE WHEN user_id % 5 = 0 THEN 0 ELSE count(*) END AS o, count(*) AS turns, count(*) FILTER (event_type = 'error') AS silent FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_filter([CASE WHEN vendor IN ('codex', 'google') AND i = 0 AND o = 0 THEN 'no_tokens' END, CASE WHEN vendor = 'codex' AND i = 0 THEN 'no_input' END, CASE WHEN vendor = 'codex' AND o = 0 THEN 'no_output' END, CASE WHEN i > 0 AND (i < 2000 * 0.75 OR i > 2000 * 1.25) THEN 'odd_input' END, CASE WHEN o > 0 AND (o < 200 * 0.75 OR o > 200 * 1.25) THEN 'odd_output' END, CASE WHEN silent > 0 AND silent < turns THEN 'silent_turns' END], lambda x: x IS NOT NULL), ',') AS issues FROM r""")
def usage_issues(spark, sf_dir):
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum(F.floor("value")).cast("long").alias("i"), F.count("*").alias("turns"), F.count_if(F.col("event_type") == "error").alias("silent"))
    vendor = F.when(u % 3 == 0, "codex").when(u % 3 == 1, "google").otherwise("other")
    i, o = F.when(u % 7 == 0, 0).otherwise(F.col("i")), F.when(u % 5 == 0, 0).otherwise(F.col("turns"))
    return rows.select("user_id", F.array_join(envelopes.usage_issues(vendor, i, o, F.col("turns"), F.col("silent"), F.lit(2000), F.lit(200), F.lit(50)), ",").alias("issues"))


@query("WITH i AS (SELECT user_id, unnest(CASE WHEN sum(value) > 1000 THEN ['much', 'many'] WHEN count(*) > 100 THEN ['many'] ELSE [] END) AS issue FROM events GROUP BY 1) SELECT issue, count(*) AS reports FROM i GROUP BY 1")
def issue_frequency(spark, sf_dir):
    from tarnworks.operators.telemetry import issue_frequency as frequency

    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sum("value").alias("v"), F.count("*").alias("n"))
    issues = F.when(F.col("v") > 1000, F.array(F.lit("much"), F.lit("many"))).when(F.col("n") > 100, F.array(F.lit("many"))).otherwise(F.array().cast("array<string>"))
    return frequency(rows.select(issues.alias("issues")))


@query("SELECT user_id, count(*) - 150 > 0.1 * 150 AS creeping, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 'u' || user_id END AS name FROM events GROUP BY user_id")
def scope_creep(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    name = scalars.blank_to_null(F.when(F.col("user_id") % 3 == 0, "  ").otherwise(F.concat(F.lit(" u"), "user_id", F.lit(" "))))
    return rows.select("user_id", it.scope_creep(F.lit(150), F.col("n"), 0.1).alias("creeping"), name.alias("name"))


ROUTES = ("users.$id.tsx", "(lang).about.tsx", "_index.tsx", "_layout.tsx", "files.$.ts", "blog._edit.post.jsx")


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '/users/:id' WHEN 1 THEN '/lang/about' WHEN 2 THEN '/' WHEN 4 THEN '/files/*' WHEN 5 THEN '/blog/_edit/post' END AS route FROM part")
def route_patterns(spark, sf_dir):
    from tarnworks.operators.inventory import route_patterns as patterns

    return table(spark, sf_dir, "part").select("p_partkey", patterns(picked(F.col("p_partkey"), *ROUTES)).alias("route"))
