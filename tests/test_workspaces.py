"""Routes, workspaces, names of zones in turn, and the best epics, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tarnworks.operators import inventory, routes, similarity, workspaces, zoning

from tests.test_operators import verbs_score


def test_route_patterns(spark):
    known = {"_index.tsx": "/", "index.ts": "/", "users.tsx": "/users", "users.$id.tsx": "/users/:id", "users.$id_.edit.tsx": "/users/:id/edit", "_auth.tsx": None, "_auth.login.tsx": "/login", "a.b.c.tsx": "/a/b/c", "$.tsx": "/*", "lang.($lang).tsx": "/lang/:lang?", "(lang).x.tsx": "/lang/x", "users._index.tsx": "/users", "blog._edit.tsx": "/blog/_edit", "_auth._index.tsx": None, "../components/Button.tsx": None}
    rows = spark.createDataFrame([(k,) for k in known], "name string").select("name", inventory.route_patterns(F.col("name")).alias("x")).collect()
    assert {r.name: r.x for r in rows} == known


def plain_tree(modules):
    out = []

    def walk(parent, near, path):
        below, todo = [], [f for f, _, p in modules if p == parent]
        while todo:  # spliced layouts
            f = todo.pop()
            if modules_by[f][1] is None:
                todo += [g for g, _, p in modules if p == f]
            else:
                below.append(f)
        for f in sorted(below, key=lambda f: (modules_by[f][1], f)):
            out.append((f, modules_by[f][1], near, len(path), " > ".join([*path, modules_by[f][1]])))
            walk(f, f, [*path, modules_by[f][1]])

    modules_by = {m[0]: m for m in modules}
    walk(None, None, [])
    return out


def test_route_tree_splices_layouts_and_leaves_rings_out(spark):
    rng = random.Random(3)
    modules = [(f"f{k}", None if rng.random() < 0.4 else f"/{rng.randint(0, 5)}", None if k < 3 else f"f{rng.randint(max(0, k - 6), k - 1)}") for k in range(60)]
    modules += [("lost", "/x", "missing"), ("under", "/y", "lost"), ("ring1", "/a", "ring2"), ("ring2", None, "ring1"), ("hangs", "/b", "ring1"), ("self", "/c", "self")]
    got = routes.route_tree(spark.createDataFrame(modules, "file string, route string, parent string"))
    assert [tuple(r) for r in got.collect()] == plain_tree(modules)
    none = spark.createDataFrame([], "file string, route string, parent string")
    assert routes.route_tree(none).collect() == []


def test_zones_choose_names_in_turn(spark):
    for seed in range(3):
        rng = random.Random(seed)
        now = [(f"p{k}", f"z{rng.randint(0, 5)}") for k in range(70)]
        old = [(f"p{k}", f"o{rng.randint(0, 5)}") for k in range(5, 75)]
        turn = {z: rng.randint(0, 3) for _, z in now}
        free, expected = {o for _, o in old}, {}
        for z in sorted({z for _, z in now}, key=lambda z: (turn[z], z)):
            files = {p for p, x in now if x == z}
            shares = {}
            for o in free:
                before = {p for p, x in old if x == o}
                shares[o] = min(len(files & before) / len(files), len(files & before) / len(before))
            best = min((o for o in free if shares[o] >= 0.15), key=lambda o: (-shares[o], o), default=None)
            if best:
                expected[z] = best
                free.remove(best)
        zones = spark.createDataFrame([(p, z, turn[z]) for p, z in now], "path string, zone string, place int")
        rows = zoning.kept_names(zones, spark.createDataFrame(old, "path string, zone string"), 0.15).collect()
        assert {r.zone: r.name for r in rows} == expected and len(expected) > 2


def test_members_of_a_workspace(spark):
    members = spark.createDataFrame([("root", ".", None, None), ("a", "packages/a/", "@w/a", "src/main.ts"), ("deep", "./packages/a/deep", "@w/deep", "gone.ts"), ("bare", "bare", "@w/bare", None), ("none", ".hidden", "@w/none", None)], "member string, prefix string, package string, entry string")
    rows = spark.createDataFrame([("root", "x.ts"), ("a", "x.ts"), ("deep", "x.ts"), ("none", "x.ts"), ("unknown", "x.ts")], "member string, path string")
    assert {r.path for r in workspaces.united(members, rows, "path").collect()} == {"x.ts", "packages/a/x.ts", "packages/a/deep/x.ts", ".hidden/x.ts"}
    asked = spark.createDataFrame([("packages/a/deep/y/z.ts",), ("packages/a/deeper.ts",), ("other.ts",), (None,)], "path string")
    assert {r.path: r.member for r in workspaces.innermost_members(asked, members).collect()} == {"packages/a/deep/y/z.ts": "deep", "packages/a/deeper.ts": "a", "other.ts": "root", None: None}
    zones = workspaces.united_zones(members, spark.createDataFrame([("a", "z", "src/main.ts"), ("a", "z", "src/b.ts"), ("deep", "y", "q.ts"), ("deep", "z", "r.ts"), ("bare", "k", "s.ts"), ("bare", "k", "t.ts")], "member string, zone string, path string"))
    entries = spark.createDataFrame([("deep", "z", "r.ts", 0)], "member string, zone string, path string, place int")
    imports = spark.createDataFrame([("a", "@w/deep", "src/b.ts"), ("a", "@w/deep", "src/b.ts"), ("a", "@w/a", "src/b.ts"), ("deep", "@w/a", "q.ts"), ("a", "@w/bare", "src/main.ts"), ("a", "react", "src/b.ts"), ("a", "@w/none", "src/b.ts"), ("a", "@w/deep", "unzoned.ts")], "member string, package string, path string")
    got = {tuple(r) for r in workspaces.member_crossings(members, imports, zones, entries).select("from", "to", "from_zone", "to_zone").collect()}
    assert got == {("packages/a/src/b.ts", "packages/a/deep/r.ts", "a:z", "deep:z"), ("packages/a/deep/q.ts", "packages/a/src/main.ts", "deep:y", "a:z"), ("packages/a/src/main.ts", "bare/s.ts", "a:z", "bare:k")}


def test_totals_of_nothing(spark):
    edges, externals = spark.createDataFrame([], "from string, to string"), spark.createDataFrame([], "package string")
    assert tuple(workspaces.import_totals(edges, externals).first()) == (0, 0, 0, 0.0)
    assert workspaces.most_imported(edges).collect() == []
    files = spark.createDataFrame([("p", None, "test", None, None)], "path string, language string, role string, category string, lines long")
    assert {tuple(r) for r in workspaces.inventory_totals(files).collect()} == {("files", "", 1), ("lines", "", 0), ("role", "test", 1)}


def test_best_epics_equal_all_pairs(spark):
    rng = random.Random(5)
    words = ["add", "fix", "set up", "the", "login", "logout", "log", "cache", "caching", "api", "tests", "x", "of"]
    phrase = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    row = lambda k: (k, phrase(4), rng.choice([None, "", phrase(5)]), rng.choice([None, [], ["A"], ["a", "b", "b"]]), rng.choice(["", "login", phrase(2)]))
    features, epics = [row(k) for k in range(40)], [row(100 + k) for k in range(30)]
    features += [(k + 50, *features[1][1:]) for k in range(3)]
    epics += [(k + 150, "add login", "the api", ["a"], "") for k in range(9)]  # more equal ones than are asked for
    features.append((60, "build login", None, [], None))

    def score(f, e):
        t, d, c = (verbs_score(a, b) if (a := (f[i] or "").strip()) and (b := (e[i] or "").strip()) else 0.0 for i in (1, 2, 4))
        x, y = ({w.lower() for w in r[3] or ()} for r in (f, e))
        g = len(x & y) / len(x | y) if x | y else 0.0
        return t * (0.45 if d > 0 else 0.7) + (d * 0.25 if d > 0 else 0.0) + g * 0.1 + c * 0.2

    schema = "id long, title string, description string, tags array<string>, children string"
    for least, most in ((0.15, 5), (0.5, 2)):
        expected = {}
        for f in features:
            best = sorted((-round(s, 9), e[0]) for e in epics if (s := score(f, e)) >= least)[:most]
            expected |= {(f[0], e): -s for s, e in best}
        rows = similarity.epics_of_features(spark.createDataFrame(features, schema), spark.createDataFrame(epics, schema), least, most).collect()
        got = {(r.feature, r.epic): r.score for r in rows}
        assert got == pytest.approx(expected) and len(rows) == len(expected)
    with pytest.raises(ValueError):
        similarity.epics_of_features(spark.createDataFrame(features, schema), spark.createDataFrame(epics, schema), 0.1)
