import random

import pytest
from pyspark.sql import functions as F

from tarnworks.functions import scalars, text
from tarnworks.operators import graph, inventory, search, similarity, tree, zoning
from tarnworks.operators import items as work_items
from tarnworks.sources import readers


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_rounding_and_scalars(spark):
    assert value(spark, scalars.half_up(F.lit(1.005), 2)) == 1.0
    assert value(spark, scalars.half_up(F.lit(-2.5))) == -2
    assert value(spark, scalars.period_key(F.lit("2027-01-01").cast("timestamp"), "week")) == "2026-W53"
    assert [value(spark, scalars.budget_severity(F.lit(u), F.lit(b), 70)) for u, b in ((4000, 5000), (5000, 5000), (10, 5000), (10, 0))] == ["warning", "exceeded", "ok", "ok"]
    assert value(spark, scalars.may_follow(F.lit("completed"), F.lit("pending"))) is False
    assert value(spark, scalars.may_follow(F.lit("pending"), F.lit("completed"))) is True
    assert value(spark, scalars.risk_level(F.lit(0.2), F.lit(0.8))) == "catastrophic"
    assert value(spark, scalars.risk_level(F.lit(0.2), F.lit(0.8), F.lit("integration"))) == "healthy"
    assert value(spark, scalars.metric_value(F.lit("took 3 of 4.5 s"))) == 4.5
    assert value(spark, scalars.nearest_rank(F.array(*map(F.lit, (5, 1, 2, 3, 4))), 0.9)) == 5
    assert value(spark, scalars.backoff_ms(F.lit(9))) == 30_000


def test_text(spark):
    assert value(spark, text.grams(F.lit("a"), 2)) == []
    assert value(spark, text.facet_value(F.array(F.lit("x"), F.lit("team:a:b")), "team")) == "a:b"
    assert value(spark, text.package_name(F.lit("@scope/name/deep"))) == "@scope/name"
    assert value(spark, text.file_role(F.lit("src/a.test.ts"))) == "test"
    assert value(spark, text.first_directory(F.lit("packages/web/x.ts"))) == "web"
    assert value(spark, text.slug(F.lit("Déjà vu: the Übergröße & more"))) == "deja-vu-the-ubergroe-more"
    assert value(spark, text.without_date_suffix(F.lit("model-20250101"))) == "model"
    assert value(spark, text.comparable(F.lit('a = "b" // c'))) == "a='b'"


def sets_score(a, b):
    """Similarity of two texts from their sets of bigrams and words."""
    (ga, wa), (gb, wb) = (({*map("".join, zip(t, t[1:]))}, {*t.split()}) for t in (a, b))
    near = {x for x in wa - wb for y in wb if y.startswith(x) or x.startswith(y)}
    scores = [2 * len(ga & gb) / len([*ga, *gb])] if ga and gb else []
    scores += [(len(wa & wb) + 0.8 * len(near)) / (len(wa | wb) - len(near))] if wa and wb else []
    if a and b and (a in b or b in a):
        scores = [1.0 if a == b else max(0.7, min(map(len, (a, b))) / max(map(len, (a, b))))]
    return max(scores, default=0.0)


def verbs_score(a, b):
    def split(t):
        first, *rest = t.split(" ")
        verb = similarity.VERBS.get(first.removesuffix(":"))
        if first.removesuffix(":") == "set" and rest[:1] == ["up"]:
            rest = rest[1:]
        return verb, " ".join(w for w in rest if w not in similarity.NAME_STOP_WORDS)

    (va, ca), (vb, cb) = split(a), split(b)
    if a != b and va and vb and ca and cb:
        return min(1.0, 0.85 * sets_score(ca, cb) + 0.15 * (va == vb))
    return sets_score(a, b)


@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.95])
def test_similar_pairs_miss_none(spark, threshold):
    rng = random.Random(1)
    words = ["login", "log", "cache", "caching", "user", "flow", "fix", "add", "blogging", "page", "x", "xy", "set", "up", "set:", "the", "create:", "p", "é"]
    names = sorted({" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(160)})
    found = {(r.a, r.b): r.score for r in similarity.similar_pairs(spark.createDataFrame([(n,) for n in names], "name string"), threshold).collect()}
    expected = {(a, b): s for i, a in enumerate(names) for b in names[i + 1 :] if (s := verbs_score(a, b)) >= threshold}
    assert found == pytest.approx(expected)
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in expected:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    got = {r.name: r.cluster for r in similarity.clusters(spark.createDataFrame(list(expected), "a string, b string")).collect()}
    assert got == {n: root(n) for n in names if any(n in p for p in expected)}


def test_closures_agree_and_roll_up(spark):
    rng = random.Random(3)
    rows = [(f"i{k}", f"i{rng.randrange(k)}" if k and rng.random() < 0.9 else None) for k in range(120)]
    items = spark.createDataFrame(rows, "id string, parent_id string")
    pairs = tree.closure(items)
    expected, parent = set(), dict(rows)
    for i, _ in rows:
        at, d = i, 0
        while at is not None:
            expected.add((at, i, d))
            at, d = parent[at], d + 1
    assert {tuple(r) for r in pairs.select("ancestor", "id", "distance").collect()} == expected and pairs.count() == len(expected)
    facts = [(f"i{rng.randrange(130)}", rng.randrange(10)) for _ in range(300)]
    table = spark.createDataFrame(facts, "item_id string, tokens long")
    rolled = {r.id: r for r in tree.rollup(pairs, table, "tokens").collect()}
    for i, _ in rows:
        assert rolled[i].total_tokens == rolled[i].self_tokens + sum(rolled[c].total_tokens for c, p in rows if p == i)
    assert tree.orphans(table, items).count() == sum(i not in parent for i, _ in facts)


def test_two_cliques(spark):
    clique = lambda names: [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    edges = clique(["a1", "a2", "a3", "a4"]) + clique(["b1", "b2", "b3", "b4"]) + [("a1", "b1")]
    table = graph.undirected(spark.createDataFrame(edges, "from string, to string").withColumn("weight", F.lit(1.0)))
    home = {r.node: r.community for r in graph.louvain(table.withColumn("g", F.lit(1)), "g", resolution=0.5).collect()}
    assert len({home[n] for n in home if n[0] == "a"}) == len({home[n] for n in home if n[0] == "b"}) == 1 and len(set(home.values())) == 2


def test_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("x", "x")], "from string, to string")
    assert {(r.node, r.component, r["size"]) for r in graph.in_cycles(edges, 3).collect()} == {("a", "a", 3), ("b", "a", 3), ("c", "a", 3), ("x", "x", 1)}
    assert {(r["from"], r["to"]) for r in graph.cyclic_core(edges, 3).collect()} == {("a", "b"), ("b", "c"), ("c", "a"), ("x", "x")}


def test_search(spark):
    items = spark.createDataFrame([(1, "Login flow", "user authentication page", "auth"), (2, "Cache", "speed up login", "perf"), (3, "Other", None, None)], "id int, title string, description string, tags string")
    assert [(r.id, r.score) for r in search.search(items, "login").collect()] == [(1, 10), (2, 3)]
    assert [r.id for r in search.search(items, "login cache").collect()] == [2]
    assert {r.id for r in search.search(items, "login OR other").collect()} == {1, 2, 3}
    assert [r.id for r in search.search(items, '"login flow"').collect()] == [1]
    assert [r.id for r in search.search(items, "aut").collect()] == [1]
    assert search.search(items, "the of").count() == 0
    assert search.postings(items).where("term = 'login'").count() == 2


def test_tree_changes(spark):
    rows = [("e", None, "epic", "pending"), ("f", "e", "feature", "pending"), ("g", "e", "feature", "completed"), ("t", "f", "task", "pending"), ("s", "t", "subtask", "completed"), ("u", "g", "task", "in_progress")]
    items = spark.createDataFrame(rows, "id string, parent_id string, level string, status string")
    pairs = tree.closure_of_levels(items, 4)
    moves = spark.createDataFrame([("t", "g"), ("f", "t"), ("s", "f"), ("x", "e"), ("e", None)], "id string, to string")
    assert {r.id: r.problem for r in tree.checked_moves(moves, pairs, items).collect()} == {"t": None, "f": "below itself", "s": "level", "x": "unknown", "e": None}
    assert {r.id for r in tree.without_subtrees(pairs, items, items.where("id = 'f'")).collect()} == {"e", "g", "u"}
    after = tree.moved(items, moves.where("id = 't'"))
    assert {r.id: r.parent_id for r in after.collect()}["t"] == "g" and after.count() == 6
    blocked = spark.createDataFrame([("t", "u")], "id string, blocker string")
    assert {r.reason: r["items"] for r in tree.selection_reasons(items, blocked).collect()} == {"completed": 1, "unresolved": 1, "in_progress": 1}


def test_lines(spark):
    assert value(spark, text.is_capitals_header(F.lit("SCOPE AND GOALS"))) and not value(spark, text.is_capitals_header(F.lit("Scope")))
    assert value(spark, text.is_separator(F.lit("-----"))) and value(spark, text.is_colon_header(F.lit("Open points:")))
    assert value(spark, text.priority_tag(F.lit("Login [High]"))) == "high" and value(spark, text.priority_tag(F.lit("P0: down"))) == "critical"
    assert value(spark, text.co_authors(F.lit("x\n\nCo-authored-by: Ada L <a@b>"))) == ["Ada L"]
    assert value(spark, text.requirement_sentences(F.lit("It is red. It must be blue! Fine."))) == ["It must be blue!"]


def test_memory_and_queue(spark):
    from tarnworks.operators import telemetry

    samples = spark.createDataFrame([("a", 1, 10), ("a", 2, 700), ("a", 3, 600), ("b", 1, 5)], "task string, epoch_ms long, rss long")
    assert {r.task: (r.peak, r.last, r.leaking) for r in telemetry.memory_peaks(samples, 600).collect()} == {"a": (700, 600, True), "b": (5, 5, False)}
    waiting = spark.createDataFrame([("q", "low", 1, "x"), ("q", "critical", 9, "y"), ("q", "low", 1, "a")], "queue string, priority string, enqueued_at int, id string")
    assert [r.id for r in telemetry.queue_order(waiting).orderBy("place").collect()] == ["y", "a", "x"]


def test_gram_pairs_whatever_the_first_word(spark):
    import itertools
    import random

    from tarnworks.functions.text import dice, jaccard

    rng = random.Random(5)
    names = sorted({" ".join(rng.choices(["cold", "old", "rod", "rods", "bold", "ring", "rings", "a"], k=rng.randint(1, 3))) for _ in range(60)} | {"cold rod", "old rod"})
    frame = spark.createDataFrame([(x,) for x in names], "name string")
    for n, measure, least, shared in ((2, dice, 0.5, 0.5 / 1.5), (3, jaccard, 0.4, 0.4), (2, dice, 0.9, 0.9 / 1.1)):
        own = {x: {x[i : i + n] for i in range(len(x) - n + 1)} for x in names}
        score = (lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 0) if measure is dice else (lambda a, b: len(a & b) / len(a | b) if a or b else 0)
        expected = {(a, b) for a, b in itertools.combinations(names, 2) if score(own[a], own[b]) >= least}
        got = {(r.a, r.b) for r in similarity.gram_pairs(frame, n, measure, least, shared).collect()}
        assert got == expected and ("cold rod", "old rod") in got


def test_durations_of_every_item(spark, sf_dir):
    from tarnworks.plans import trees
    from tarnworks.plans.tables import items

    got = {r.id: r.total_ms for r in trees.QUERIES["item_durations"](spark, sf_dir).collect()}
    rows = items(spark, sf_dir).collect()
    assert sorted(got) == sorted(r.id for r in rows)
    above = {}
    for r in rows:
        if r.parent_id is not None:
            above[r.parent_id] = above.get(r.parent_id, 0) + got[r.id]
    assert sum(above.values()) > 0 and all(got[k] == v for k, v in above.items())  # containers have no time of their own


def test_chains_have_no_longest_length(spark):
    from tarnworks.operators import graph

    rows = [(k, k - 1) for k in range(1, 19)] + [(18, 3), (50, 51), (51, 50), (52, 51), (53, 52), (60, 60)]
    got = {r.id: r.length for r in graph.chain_lengths(spark.createDataFrame(rows, "id long, blocker long").coalesce(1)).collect()}
    assert got == {k: k for k in range(1, 19)} | {52: 1, 53: 2}


def test_clusters_of_long_chains(spark):
    names = [f"n{k:03d}" for k in range(80)]
    order = [names[0], *reversed(names[1:40]), *names[40:]]
    pairs = [tuple(sorted(p)) for p in zip(order, order[1:])]
    got = similarity.clusters(spark.createDataFrame(pairs, "a string, b string").coalesce(1)).collect()
    assert {r.name: r.cluster for r in got} == dict.fromkeys(names, names[0])


def test_suggestions_from_many_commands(spark):
    from tarnworks.operators import items

    commands = spark.createDataFrame([(f"command{k:03d}x",) for k in range(300)], "command string").coalesce(1)
    typed = spark.createDataFrame([(f"command{k:03d}",) for k in range(300)], "typed string").coalesce(1)
    got = work_items.suggestions(typed, commands, 1).collect()
    assert {(r.typed, r.command) for r in got} >= {(f"command{k:03d}", f"command{k:03d}x") for k in range(300)}


def node_level(edges, home, rule):
    """A rule of ``zoning`` by its words, node by node: weights are summed anew from the edges before each merge."""
    home = dict(home)

    def sizes():
        out = {}
        for c in home.values():
            out[c] = out.get(c, 0) + 1
        return out

    def flows(c, count=False):
        out = {}
        for (a, b), w in edges.items():
            if home[a] == c:
                out[home[b]] = out.get(home[b], 0) + (1 if count else w)
        return out

    def strongest(c):
        near = [(-w, o) for o, w in flows(c).items() if o != c]
        return min(near)[1] if near else None

    def join(gone, into):
        for n, c in home.items():
            if c == gone:
                home[n] = into

    if rule == "small":
        while True:
            merged = False
            for c in sorted(c for c, n in sizes().items() if n < 3):
                if 0 < sizes().get(c, 0) < 3 and (into := strongest(c)):
                    join(c, into)
                    merged = True
            if not merged:
                return home
    if rule == "satellites":
        for _ in range(10):
            merged = False
            for c in sorted(c for c, n in sizes().items() if n <= 8):
                f = flows(c)
                inside, outside = f.get(c, 0) / 2, sum(w for o, w in f.items() if o != c)
                if c in sizes() and inside + outside and outside / (inside + outside) >= 0.3 and (into := strongest(c)):
                    join(c, into)
                    merged = True
            if not merged:
                break
        return home
    if rule == "both":
        own = {c: flows(c, True).get(c, 0) / 2 for c in sizes()}
        pairs = sorted((-w / min(own[a], own[b]), a, b) for a in own for b, w in flows(a, True).items() if a < b and min(own[a], own[b]) and w / min(own[a], own[b]) >= 0.4)
        gone = set()
        for _, a, b in pairs:
            if not {a, b} & gone:
                n = sizes()
                source, into = (a, b) if n[a] < n[b] else (b, a)
                join(source, into)
                gone.add(source)
        return home
    while len(n := sizes()) > 4:
        pairs = [(-2 * w, a, b) for a in n for b, w in flows(a).items() if a < b]
        if pairs:
            _, a, b = min(pairs)
            join(*((a, b) if n[a] < n[b] else (b, a)))
        else:
            b, a = sorted(n, key=lambda c: (n[c], c))[:2]
            join(b, a)
    return home


def random_graph(rng, nodes, links):
    out = {}
    for _ in range(links):
        a, b = rng.sample(range(nodes), 2)
        w = float(rng.randint(1, 4))
        for x, y in ((a, b), (b, a)):
            out[f"n{x:03d}", f"n{y:03d}"] = out.get((f"n{x:03d}", f"n{y:03d}"), 0.0) + w
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_zone_rules_equal_node_by_node(spark, seed):
    rng = random.Random(seed)
    edges = random_graph(rng, 60, 90)
    nodes = sorted({a for a, _ in edges})
    home = {n: f"c{rng.randrange(22):02d}" for n in nodes}
    parts = {}

    def root(n):
        while parts.setdefault(n, n) != n:
            n = parts[n]
        return n

    for a, b in edges:
        parts[root(a)] = root(b)
    for c in set(home.values()):  # a community lies in one component
        first = root(next(n for n in nodes if home[n] == c))
        for n in nodes:
            if home[n] == c and root(n) != first:
                home[n] = f"{c}-{root(n)}"
    members = spark.createDataFrame([(root(n), n, c) for n, c in home.items()], "component string, node string, community string")
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, w double")
    rules = {"small": (zoning.small, "w", True), "satellites": (zoning.satellites, "w", True), "both": (zoning.tied_both_ways, "n", True), "cap": (lambda g: zoning.capped(g, 4), "w", False)}
    for name, (rule, value, local) in rules.items():
        got = {r.node: r.community for r in zoning.regrouped(members, frame, rule, value, local).collect()}
        assert got == node_level(edges, home, name), name


def test_communities_by_component_equal_the_whole_graph(spark):
    rng = random.Random(5)
    edges = random_graph(rng, 40, 45)
    frame = spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "src string, dst string, w double")
    near = {}
    for (a, b), w in edges.items():
        near.setdefault(a, {})[b] = w
    whole = graph.local_moves(near, 1.0, 100)
    assert {r.node: r.community for r in zoning.communities(frame).collect()} == whole
    started = {n: f"s{int(n[1:]) % 4}" for n in near}
    start = spark.createDataFrame(list(started.items()), "node string, community string")
    rows = zoning.communities(frame, start=start).collect()
    assert len(rows) == len(near) and {r.community for r in rows} <= set(started.values()) | set(near)
    with pytest.raises(Exception, match="more than 3"):
        graph.louvain(frame.withColumn("g", F.lit("x")), "g", most_nodes=3).collect()


def test_large_communities_are_split(spark):
    cliques = [[f"d{k}/sub{k}/f{i}" for i in range(8)] for k in range(3)]
    edges = [(a, b, 1.0) for c in cliques for a in c for b in c if a != b] + [(cliques[k][0], cliques[k + 1][0], 1.0) for k in range(2)] + [(cliques[k + 1][0], cliques[k][0], 1.0) for k in range(2)]
    members = spark.createDataFrame([("p", n, "all") for c in cliques for n in c], "component string, node string, community string")
    got = {r.node: r.community for r in zoning.split_large(members, spark.createDataFrame(edges, "src string, dst string, w double"), 10).collect()}
    assert len(set(got.values())) == 3 and all(len({got[n] for n in c}) == 1 for c in cliques)
    assert zoning.by_directory(["a/b/x", "a/b/y", "a/c/x", "a/c/y"]) == {"a/b/x": "dir-0", "a/b/y": "dir-0", "a/c/x": "dir-1", "a/c/y": "dir-1"}
    assert zoning.by_directory(["x", "y"]) == {} and zoning.limits(100) == (15, 8)


def test_zones_of_a_repository(spark):
    edges = [(f"{d}/a{i}.ts", f"{d}/a{j}.ts", 2.0) for d in ("web", "core", "cli") for i in range(6) for j in range(i)] + [("web/a0.ts", "core/a0.ts", 1.0)]
    files = sorted({f for a, b, _ in edges for f in (a, b)} | {"web/lonely.ts", "docs/x.md"})
    frame = spark.createDataFrame(edges, "from string, to string, weight double")
    paths = spark.createDataFrame([(f,) for f in files], "path string")
    zones = {r.path: r.zone for r in zoning.zones_of(frame, paths, percent=50.0).collect()}
    assert sorted(zones) == files
    assert all(len({zones[f] for f in files if f.startswith(d + "/a")}) == 1 for d in ("web", "core", "cli"))
    assert len({zones[f"{d}/a1.ts"] for d in ("web", "core", "cli")}) == 3 and zones["web/lonely.ts"] == zones["web/a1.ts"]
    pins = spark.createDataFrame([("web/a1.ts", "mine")], "path string, zone string")
    again = {r.path: r.zone for r in zoning.zones_of(frame, paths, before=spark.createDataFrame(list(zones.items()), "node string, zone string"), pins=pins, percent=50.0).collect()}
    assert again["web/a1.ts"] == "mine" and again["core/a1.ts"] == again["core/a2.ts"]


@pytest.mark.parametrize("most", [None, 1, 4, 9])
def test_proximity_equals_dealing_one_by_one(spark, most):
    rng = random.Random(11)
    folder = lambda: "/".join(rng.choice("abc") for _ in range(rng.randint(0, 3)))
    named = lambda n, k: sorted({f"{f}/{n}{i}" if (f := folder()) else f"{n}{i}" for i in range(k)})
    zoned, loose = [(f, rng.choice("XYZW")) for f in named("z", 24)], named("l", 40)
    sizes, counts, expected = {}, {}, {}
    for path, zone in zoned:
        sizes[zone] = sizes.get(zone, 0) + 1
        held = counts.setdefault(path.rpartition("/")[0], {})
        held[zone] = held.get(zone, 0) + 1
    for path in loose:
        at = path.rpartition("/")[0]
        while at and path not in expected:
            free = [(-n, z) for z, n in counts.get(at, {}).items() if most is None or sizes[z] < most]
            if free:
                expected[path] = min(free)[1]
                sizes[expected[path]] += 1
            at = at.rpartition("/")[0]
    left, right = spark.createDataFrame([(f,) for f in loose], "path string"), spark.createDataFrame(zoned, "path string, zone string")
    assert {r.path: r.zone for r in inventory.assigned_by_proximity(left, right, most).collect()} == expected
    assert inventory.assigned_by_proximity(left.limit(0), right, most).count() == 0


def test_long_chains_and_deep_trees(spark):
    pairs = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(46)], "a string, b string")
    assert {r.cluster for r in similarity.clusters(pairs).collect()} == {"n000"}
    deps = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (99, 100)], "id long, blocker long")
    lengths = {r.id: r.length for r in graph.chain_lengths(deps).collect()}
    assert lengths[0] == 40 and lengths[39] == 1 and lengths[99] == 1 and 100 not in lengths
    rows = spark.createDataFrame([(f"i{k}", f"i{k - 1}" if k else None) for k in range(6)], "id string, parent_id string")
    assert {(r.ancestor, r.id, r.distance) for r in tree.closure_of_levels(rows, 6).collect()} == {(r.ancestor, r.id, r.distance) for r in tree.closure(rows).collect()}
    with pytest.raises(Exception, match="below level 4"):
        tree.closure_of_levels(rows, 4).collect()
    with pytest.raises(ValueError, match="levels deep"):
        tree.closure(rows, 2)


def test_completion_stops_at_what_cannot_complete(spark):
    rows = [
        ("e", None, "pending"), ("f1", "e", "pending"), ("t1", "f1", "completed"), ("f2", "e", "blocked"), ("t2", "f2", "completed"),
        ("g", None, "in_progress"), ("g1", "g", "pending"), ("g2", "g1", "completed"), ("g3", "g", "completed"), ("g4", "g3", "pending"),
        ("leaf", None, "pending"), ("h", None, "pending"), ("h1", "h", "deleted"), ("i", None, "pending"), ("i1", "i", "pending"), ("i2", "i1", "deleted"), ("i3", "i1", "completed"),
    ]
    items = spark.createDataFrame(rows, "id string, parent_id string, status string")
    assert {r.id for r in tree.auto_completable(tree.closure(items), items).collect()} == {"f1", "g", "g1"}
    resets = tree.parent_resets(tree.closure(items), items, items.where("id in ('g4', 'g2')"))
    assert {(r.parent, r.id) for r in resets.collect()} == {("g2", "g2")}


def test_search_keeps_stop_words_in_fields(spark):
    items = spark.createDataFrame([("1", "It should work", None), ("2", "shout", None)], "id string, title string, description string")
    assert {r.id for r in search.search(items, "shou").collect()} == {"1", "2"}
    assert search.search(items, "should").count() == 0  # no term is left of the query


def test_matches_conflicts_and_epics(spark):
    nodes = spark.createDataFrame([(1, "task", "Add login flow"), (2, "task", "login"), (3, "epic", "login page"), (4, "task", "zzz")], "id long, level string, title string")
    items = spark.createDataFrame([(10, "task", "add login  flow", "pending"), (11, "task", "the login flow", "pending"), (12, "task", "billing", "completed")], "id long, level string, title string, status string")
    got = {r.node: (r.item, r.score, r.reason) for r in similarity.matched_nodes(nodes, items).collect()}
    assert got == {1: (10, 1.0, "exact_title"), 2: (10, 0.95, "semantic_title")}
    new = spark.createDataFrame([(20, "login flow"), (21, "Login flow"), (22, "billing"), (23, "other words")], "id long, title string")
    found = {(r.id, r.other, r.kind) for r in similarity.conflicts(new, items).collect()}
    assert found == {(20, 10, "tree"), (21, 10, "tree"), (21, 20, "batch")} or found == {(20, 11, "tree"), (21, 11, "tree"), (21, 20, "batch")}
    left = similarity.unmatched(new.select(F.col("title").alias("name")), items.select(F.col("title").alias("name")))
    assert {r.name for r in left.collect()} == {"other words"}
    side = "id long, title string, description string, tags array<string>, children string"
    features = spark.createDataFrame([(1, "login page", "users sign in", ["Auth"], "form")], side)
    epics = spark.createDataFrame([(5, "login", None, ["auth"], ""), (6, "payments", "users sign in", [], "form"), (7, "xyz", None, None, None)], side)
    best = [(r.epic, round(r.score, 4)) for r in similarity.epics_of_features(features, epics).orderBy(F.desc("score")).collect()]
    expected = sorted(((5, 0.7 * sets_score("login page", "login") + 0.1), (6, 0.45 * sets_score("login page", "payments") + 0.25 + 0.2)), key=lambda x: -x[1])
    assert best == [(k, round(v, 4)) for k, v in expected if v >= 0.15]


def test_inventory_reuses_rows_and_keeps_empty_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "empty.py").write_text("")
    (tmp_path / "b.log").write_text("x")
    first = readers.inventory(spark, str(tmp_path), rules=["*.log"])
    rows = {r.path.rsplit("/", 1)[1]: r for r in first.collect()}
    assert set(rows) == {"a.py", "empty.py"} and rows["empty.py"].size == rows["empty.py"].lines == 0 and rows["a.py"].lines == 1
    known = spark.createDataFrame([(*rows["a.py"][:3], "kept", 7, "Python")], first.schema)
    again = {r.path.rsplit("/", 1)[1]: r for r in readers.inventory(spark, str(tmp_path), rules=["*.log"], before=known).collect()}
    assert again["a.py"].hash == "kept" and again["a.py"].lines == 7 and set(again) == set(rows)


def test_suggestions_equal_all_pairs(spark):
    rng = random.Random(12)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(120)})
    typed, commands = words[::2], words[1::2] + words[:10]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    got = work_items.suggestions(spark.createDataFrame([(t,) for t in typed], "typed string"), spark.createDataFrame([(c,) for c in commands], "command string")).collect()
    assert {(r.typed, r.command, r.distance) for r in got} == {(t, c, d) for t in typed for c in set(commands) if 1 <= (d := edits(t, c)) <= 2}


def test_ball_around_nodes_without_edges(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], ["from", "to"])
    around = lambda nodes, e: {(r.node, r.distance) for r in graph.ball(e, spark.createDataFrame(nodes, "node string"), 2).collect()}
    assert around([("a",), ("z",)], edges) == {("a", 0), ("b", 1), ("c", 2), ("z", 0)}
    assert around([(None,)], edges.limit(0)) == {(None, 0)}


def test_the_ball_takes_every_pair_above_the_mean(spark, tmp_path):
    import duckdb

    from tarnworks.plans import graphs

    # edges of 0 to 1, 1 to 2, 2 to 3 and 3 to 0: 21, 21, 20 and 18; the mean is 20
    tables = {
        "lineitem": "SELECT k AS l_orderkey, k AS l_suppkey FROM (SELECT explode(flatten(array(array_repeat(0L, 21), array_repeat(1L, 21), array_repeat(2L, 20), array_repeat(3L, 18)))) AS k)",
        "orders": "SELECT id AS o_orderkey, (id + 1) % 4 AS o_custkey FROM range(4)",
        "customer": "SELECT id AS c_custkey, CAST(id AS INT) AS c_nationkey FROM range(4)",
        "supplier": "SELECT id AS s_suppkey, CAST(id AS INT) AS s_nationkey FROM range(4)",
    }
    con = duckdb.connect()
    for name, sql in tables.items():
        spark.sql(sql).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = {tuple(r) for r in graphs.khop_ball(spark, str(tmp_path)).select("node", "distance").collect()}
    assert got == {("N0", 0), ("N1", 1), ("N2", 2)}
    assert {tuple(r) for r in con.execute(graphs.SQL["khop_ball"]).fetchall()} == got
