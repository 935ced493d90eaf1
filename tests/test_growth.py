"""Steps whose rows must grow with their input, not with the square of a group of equal rows."""

from tarnworks.operators import findings, graph, similarity, zoning


def most_rows(df) -> int:
    """Rows of the step of the plan that makes most, once ``df`` is collected."""
    df.collect()

    def walk(plan):
        metrics = plan.metrics()
        own = metrics.apply("numOutputRows").value() if metrics.contains("numOutputRows") else 0
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return max(own, walk(plan.executedPlan()))
        if kind.endswith("QueryStageExec"):
            return max(own, walk(plan.plan()))
        children = plan.children()
        return max([own, *(walk(children.apply(i)) for i in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


def test_known_findings_meet_once_a_text(spark):
    said = "CASE id % 2 WHEN 0 THEN 'the cache is read in many places' ELSE 'cache is read in many places of it' END"
    rows = spark.range(2000).selectExpr("id", "'t' AS type", "'s' AS scope", "CAST(id AS STRING) AS hash", f"{said} AS text")
    out = findings.known_by_text(rows, rows.where("id = 0").drop("id"))
    assert most_rows(out) <= 4000 and out.count() == 2000


def test_nodes_and_items_of_one_title_meet_once(spark):
    rows = spark.range(1200).selectExpr("id", "'task' AS level", "CASE WHEN id % 3 = 0 THEN 'cold rod' ELSE 'the cold rod' END AS title")
    out = similarity.matched_nodes(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))
    assert most_rows(out) <= 2400
    assert {(r.node % 3 == 0, r.item, r.score) for r in out.collect()} == {(True, 3, 1.0), (False, 1, 1.0)} and out.count() == 600


def test_pins_meet_directories_not_files(spark):
    zones = spark.range(1000).selectExpr("CASE WHEN id < 500 THEN concat('a/', id) WHEN id < 999 THEN concat('b/', id) ELSE 'c/999' END AS path", "'z' AS zone")
    pins = spark.sql("SELECT concat('a/', id) AS path, 'z' AS zone FROM range(100) UNION ALL SELECT concat('b/', id), 'z' FROM range(500, 600) UNION ALL SELECT 'a/7', 'z' UNION ALL SELECT 'c/999', 'z' UNION ALL SELECT 'd/1', 'z'")
    out = zoning.pin_divergence(pins, zones, spark.createDataFrame([("a/3", "d/1"), ("d/1", "x"), ("c/999", "b/600")], '"from" string, to string'.replace('"', "")))
    assert most_rows(out) <= 2000
    got = {r.path: (r.directory, r.there, r.edges) for r in out.collect()}
    # without its own file a has 499 files, as b has; ties go to the lesser directory
    assert got == {**{f"b/{k}": ("b", "a", 0) for k in range(500, 600)}, "c/999": ("c", "a", 1), "d/1": ("d", "a", 1)}


def test_siblings_of_one_title_spread_over_tasks(spark):
    from pyspark.sql import functions as F

    rows = spark.range(300).selectExpr("id", "IF(id < 200, 1L, NULL) AS parent_id", "'task' AS level", "'pending' AS status", "IF(id % 10 = 0, 'a cold rod', 'cold rod') AS title")
    out = similarity.sibling_duplicates(rows, 0.75, most=500).withColumn("task", F.spark_partition_id())
    found = out.collect()
    expected = {(a, b) for a in range(300) for b in range(a + 1, 300) if (a < 200) == (b < 200)}
    assert {(r.a, r.b) for r in found} == expected and len(found) == len(expected)
    per_task = {}
    for r in found:
        per_task[r.task] = per_task.get(r.task, 0) + 1
    assert max(per_task.values()) < len(found) / 5


def test_rounds_of_chains_broadcast_nothing(spark, monkeypatch):
    plans = []
    for name in ("cut", "cut_afresh"):
        plain = getattr(graph, name)
        monkeypatch.setattr(graph, name, lambda df, plain=plain: plans.append(df._jdf.queryExecution().executedPlan().toString()) or plain(df))
    deps = spark.range(1, 40).selectExpr("id", "id DIV 2 AS blocker")
    assert {r.id: r.length for r in graph.chain_lengths(deps).collect()} == {k: k.bit_length() for k in range(1, 40)}
    assert len(plans) > 5 and not any("BroadcastHashJoin" in p for p in plans)


def test_best_matches_score_texts_not_rows(spark):
    rows = spark.range(2000).selectExpr("id", "IF(id % 2 = 0, 'add cold rod', 'add  Warm rod') AS name")
    out = similarity.best_matches(rows.select("name"), rows.where("id % 2 = 0").selectExpr("'cold rod' AS name"))
    assert most_rows(out) <= 20
    assert [(r.proposal, r.item) for r in out.collect()] == [("add cold rod", "cold rod")]


def test_rounds_of_labels_move_labels_and_messages_only(spark, monkeypatch):
    plans, plain = [], graph.cut_afresh
    monkeypatch.setattr(graph, "cut_afresh", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]) or plain(df))
    pairs = sorted({(k % 12, (k * k + 3) % 15) for k in range(60)})
    rows = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "`from` string, `to` string").selectExpr("*", "CAST(length(`from`) AS DOUBLE) AS weight")
    edges = graph.undirected(rows)
    got = {r.node: r.community for r in graph.propagated_labels(graph.undirected(rows, parallel=True), 3).collect()}
    held = [tuple(r) for r in edges.selectExpr("src", "dst", "w").collect()]
    rank = {r.n: r.h for r in spark.createDataFrame([(s,) for s in {h[0] for h in held}], "n string").selectExpr("n", "-xxhash64(n) AS h").collect()}
    labels = {s: s for s, _, _ in held}
    for _ in range(3):
        sums = {}
        for s, d, w in held:
            sums.setdefault(s, {}).setdefault(labels[d], []).append(w)
        labels = {s: max(own, key=lambda c: (sum(own[c]), rank[c])) for s, own in sums.items()}
    assert got == labels
    assert max(p.count("Exchange hashpartitioning") for p in plans) <= 2


def test_rounds_of_changes_leave_out_what_no_change_concerns(spark, monkeypatch):
    from tarnworks.operators import reshape

    sizes, plain = [], reshape.Reshaped._spans
    monkeypatch.setattr(reshape.Reshaped, "_spans", lambda self, *a: sizes.append(self.start.count()) or plain(self, *a))
    text = lambda c: f"CAST(NULL AS STRING) AS {c}"
    items = spark.range(300).selectExpr("concat('t', id) AS id", "IF(id < 3, NULL, concat('t', id % 3)) AS parent_id", "IF(id < 3, 'epic', 'feature') AS level", "'pending' AS status", "'x' AS title", text("description"), text("priority"))
    actions = spark.createDataFrame([(1, "merge", "t1", None, ["t0"], *[None] * 6), (2, "delete", "t1", None, None, *[None] * 6), (3, "delete", "t5", None, None, *[None] * 6)], reshape.ACTION)
    got = {r.id: (r.parent_id, r.status) for r in reshape.Reshaped(items, actions).items().collect()}
    assert sizes[-1] == 300 and max(sizes[:-1]) == 4  # t0, t1, t5 and t2 above it
    gone = {k for k in range(300) if k % 3 < 2} | {5}
    assert got == {f"t{k}": (None if k < 3 else f"t{1 if k % 3 == 0 else k % 3}", "deleted" if k in gone else "pending") for k in range(300)}


def test_rounds_of_rings_grow_with_their_length_only(spark, monkeypatch):
    from tarnworks.operators import cycles

    rounds, plain, met = [], cycles.cut_afresh, {}
    monkeypatch.setattr(cycles, "cut_afresh", lambda df: rounds.append(1) or plain(df))
    for n, length in ((2, 5), (600, 5), (40, 2)):
        ids = spark.range(n * length).withColumnRenamed("id", "k")
        rings = ids.selectExpr("-k - 1 AS `from`", f"IF(k % {length} = {length - 1}, {length} - 2 - k, -k - 2) AS `to`", "CAST(NULL AS INT) AS level", "CAST(NULL AS LONG) AS chain")
        rounds.clear()
        met[n, length] = cycles.chains(rings), len(rounds)
    assert met[2, 5][1] == met[600, 5][1]
    for (n, length), ((found, out), _) in met.items():
        # the least node of a ring stays out and names it; the others lead up to it
        least = lambda k: -(k // length + 1) * length  # noqa: B023, E731
        ends = {r[0]: (r[1], r[2]) for r in found.collect()}
        assert ends == {-k - 1: (least(k), length - 2 - k % length) for k in range(n * length) if -k - 1 != least(k)}
        assert {(r["from"], r.to) for r in out.select("from", "to").collect()} == {(least(k) + 1, least(k)) for k in range(0, n * length, length)}


def test_dead_ends_go_before_chains_are_followed(spark, monkeypatch):
    from tarnworks.operators import cycles

    sizes, plain = [], cycles.chains
    monkeypatch.setattr(cycles, "chains", lambda edges: sizes.append(edges.count()) or plain(edges))
    edges = spark.range(1000).selectExpr("id + 10 AS `from`", "id % 2 AS `to`").union(spark.sql("VALUES (0L, 1L), (1L, 2L), (2L, 0L)"))
    assert [tuple(r) for r in cycles.Components(edges).summary().collect()] == [(0, 3, 3)]
    assert max(sizes) == 3


def test_few_edges_left_need_no_rounds(spark, monkeypatch):
    from tarnworks.operators import cycles

    rounds, plain = [], cycles.cut_afresh
    monkeypatch.setattr(cycles, "cut_afresh", lambda df: rounds.append(1) or plain(df))
    # a ladder of 20 nodes and one of 8, an edge between them, loops on a ladder's node, on one between and on one apart
    pairs = {(k, k + d) for k in range(18) for d in (1, 2)} | {(18, 19), (19, 0), (18, 0), (7, 7), (5, 40), (40, 40), (40, 101), (90, 90)}
    pairs |= {(100 + k, 100 + (k + d) % 8) for k in range(8) for d in (1, 3)} | {(101, 200), (200, 201)}
    edges, met = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in pairs], "`from` string, `to` string"), {}
    for few in (cycles.WALKED, 0):
        rounds.clear()
        found = cycles.Components(edges, few) if few == 0 else cycles.Components(edges)
        met[few] = len(rounds)
        assert {tuple(r) for r in found.summary().collect()} == {("n000", 20, 40), ("n040", 1, 1), ("n090", 1, 1), ("n100", 8, 16)}
        path = [(r.component, int(r.node[1:])) for r in cycles.numbered(found.cycles()).orderBy("component", "place").collect()]
        for component in ("n000", "n040", "n090", "n100"):
            own = [node for c, node in path if c == component]
            assert own and all(p in pairs for p in zip(own, own[1:] + own[:1]))
    assert met[cycles.WALKED] <= 10 < met[0]


def test_chains_within_a_task_take_no_round(spark, monkeypatch):
    from tarnworks.operators import cycles

    rounds, plain, coalesced = [], cycles.cut_afresh, "spark.sql.adaptive.coalescePartitions.enabled"
    monkeypatch.setattr(cycles, "cut_afresh", lambda df: rounds.append(1) or plain(df))
    before = spark.conf.get(coalesced)
    # rings of 30 and a chain from 1000 to 1099, in turn and dealt so that neighbours lie far apart
    steps = {k: k - k % 30 + (k + 1) % 30 for k in range(210)} | {k: k + 1 for k in range(1000, 1100)}
    for spread in (1, 7919):
        name = lambda k: k * spread % 10007  # noqa: B023, E731
        edges = spark.createDataFrame([(name(a), name(b), None, None) for a, b in steps.items()], "`from` long, `to` long, level int, chain long")
        want = {name(k): (name(1099), 1099 - k) for k in range(1001, 1100)}  # 1000 has no edge in, 1100 none out
        for ring in range(0, 210, 30):
            least = min(range(ring, ring + 30), key=name)
            want |= {name(k): (name(least), (least - k - 1) % 30) for k in range(ring, ring + 30) if k != least}
        for whole in ("true", "false"):
            rounds.clear()
            spark.conf.set(coalesced, whole)
            try:
                ends, out = cycles.chains(edges)
                met = len(rounds)
                assert {r.node: (r.own, r.steps) for r in ends.collect()} == want
                assert out.count() == 8
            finally:
                spark.conf.set(coalesced, before)
            assert (met == 0) == (whole == "true")
