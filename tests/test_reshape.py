"""Changes applied in order by joins equal a plain loop over them."""

import random

import pytest

from tarnworks.operators.reshape import ACTION, Reshaped
from tarnworks.operators.tree import LATTICE

ITEM = "id string, parent_id string, level string, status string, title string, description string, priority string, extra long"


def action(seq, kind, id_, to=None, members=None, title=None, description=None, priority=None, level=None, names=None, parts=None):
    return (seq, kind, id_, to, members, title, description, priority, level, names, parts)


def plain(items, actions):
    tree = {i[0]: dict(zip(("id", "parent_id", "level", "status", "title", "description", "priority", "extra"), i)) for i in items}
    gone, problems = set(), []
    there = lambda x: x in tree and x not in gone

    def above(x):
        out = []
        while x is not None and x not in out:
            out.append(x)
            x = tree[x]["parent_id"]
        return out

    def below(x):
        return [y for y in tree if there(y) and x in above(y)]

    def go(seq, x, to):
        if not there(x) or to is not None and not there(to):
            return problems.append((seq, x, "not there"))
        if to is not None and x in above(to):
            return problems.append((seq, x, "below itself"))
        if (tree[to]["level"] if to is not None else None) not in LATTICE[tree[x]["level"]]:
            return problems.append((seq, x, "level"))
        tree[x]["parent_id"] = to

    def make(seq, x, beside, **own):
        if x in tree:
            return problems.append((seq, x, "already there"))
        tree[x] = {"id": x, "parent_id": tree[beside]["parent_id"], "status": "pending", "title": None, "description": None, "priority": None, "level": None, "extra": None} | own

    def put(seq, x, **own):
        if not there(x):
            return problems.append((seq, x, "not there"))
        tree[x] |= {k: v for k, v in own.items() if v}

    for seq, kind, x, to, members, title, description, priority, level, names, parts in sorted(actions, key=lambda a: a[0]):
        if kind == "move":
            go(seq, x, to)
        elif kind == "update":
            put(seq, x, title=title, description=description, priority=priority)
        elif kind == "obsolete":
            put(seq, x, status="deferred")
        elif kind == "merge":
            put(seq, x, title=title, description=description)
            for m in members:
                if not there(m) or not there(x):
                    problems.append((seq, m, "not there"))
                elif m in above(x):
                    problems.append((seq, m, "below itself"))
                else:
                    for y in [y for y in tree if there(y) and tree[y]["parent_id"] == m]:
                        tree[y]["parent_id"] = x
                    gone.add(m)
        elif kind in ("delete", "split"):
            for k, p in enumerate(parts or () if kind == "split" else (), 1):
                name = p[0] or f"{x}-{k}"
                if there(x):
                    make(seq, name, x, title=p[1], level=p[2], description=p[3], priority=p[4])
                else:
                    problems.append((seq, name, "not there"))
            if there(x):
                gone |= set(below(x))
            else:
                problems.append((seq, x, "not there"))
        elif kind == "group" and members:
            if not all(map(there, members)):
                problems += [(seq, y, "a member is missing") for y in [x, *members, *members]]
                continue
            make(seq, x, members[0], title=title, level=level)
            for m in members:
                put(seq, m, title=(names or {}).get(m))
                go(seq, m, x)
    return {k: tuple(v.values()) for k, v in tree.items()}, gone, sorted(problems)


ORDER = ("id", "parent_id", "level", "status", "title", "description", "priority", "extra")


def compare(spark, items, actions):
    done = Reshaped(spark.createDataFrame(items, ITEM), spark.createDataFrame(actions, ACTION))
    tree, gone, problems = plain(items, actions)
    got = {r.id: r for r in done.items().collect()}
    assert got.keys() == tree.keys() and {k for k, r in got.items() if r.status == "deleted"} == gone
    for k, row in tree.items():
        own = dict(zip(("id", "parent_id", "level", "status", "title", "description", "priority", "extra"), row)) if k in {i[0] for i in items} else None
        if own and k not in gone:
            assert tuple(got[k][c] for c in ORDER) == tuple(own[c] for c in ORDER), k
        elif k not in gone:
            assert got[k].parent_id == row[1], k
    assert sorted(tuple(r) for r in done.problems().collect()) == problems


BASE = [
    ("e1", None, "epic", "pending", "Epic", None, None, 1), ("e2", None, "epic", "pending", "Other", None, None, 2), ("f1", "e1", "feature", "pending", "F1", None, "low", 3), ("f2", "e1", "feature", "pending", "F2", "d", None, 4), ("f3", "e2", "feature", "pending", "F3", None, None, 5),
    ("t1", "f1", "task", "pending", "T1", None, None, 6), ("t2", "f2", "task", "completed", "T2", None, None, 7), ("t3", "f3", "task", "pending", "T3", None, None, 8), ("s1", "t1", "subtask", "pending", "S1", None, None, 9), ("s2", "t2", "subtask", "pending", "S2", None, None, None),
]


def test_chains_of_merges_and_what_comes_too_late(spark):
    compare(spark, BASE, [
        action(1, "merge", "f2", members=["f1"], title="Both"),
        action(2, "merge", "f3", members=["f2", "zz"]),
        action(3, "move", "t1", "f2"),  # f2 is gone
        action(4, "move", "t1", "e1"),
        action(5, "merge", "f1", members=["f3"]),  # f1 is gone
        action(6, "obsolete", "t2"),
        action(7, "update", "t2", title="", description="new", priority="high"),
    ])


def test_deletion_takes_what_is_below_at_its_time(spark):
    compare(spark, BASE, [
        action(1, "move", "t1", "f3"),
        action(2, "delete", "f1"),
        action(3, "delete", "f3"),  # with t1 and s1 by now
        action(4, "move", "s1", "t2"),
        action(5, "split", "f2", parts=[("n1", "New", "feature", None, "high"), (None, "Second", "feature", "d", None)]),
        action(6, "move", "t2", "n1"),  # went with f2
        action(7, "update", "n1", title="Renamed"),
        action(8, "merge", "n1", members=["f2-2"]),
    ])


def test_groups_and_impossible_moves(spark):
    compare(spark, BASE, [
        action(1, "group", "g1", members=["t1", "t2"], title="Group", level="feature", names={"t2": "Named"}),
        action(2, "group", "g2", members=["t3", "none"], title="No", level="feature"),
        action(3, "move", "e1", "f1"),
        action(4, "move", "f1", "t1"),
        action(5, "merge", "t1", members=["g1"]),  # above it
        action(6, "merge", "f2", members=["g1"]),
        action(7, "move", "f2", "e2"),
        action(8, "group", "g1", members=["t1"], title="Twice", level="feature"),
        action(9, "move", "f3", None),
    ])


@pytest.mark.parametrize("seed", range(2))
def test_random_sequences(spark, seed):
    rng, names = random.Random(seed), [i[0] for i in BASE]
    actions = []
    for seq in range(1, 19):
        kind = rng.choice(["move", "move", "move", "merge", "update", "obsolete", "delete", "split", "group"] if seq > 6 else ["move", "move", "merge", "update"])
        x, others = rng.choice(names), rng.sample(names, rng.randint(1, 2))
        if kind == "split":
            actions.append(action(seq, kind, x, parts=[(f"n{seq}", "n", "task", None, None)]))
            names.append(f"n{seq}")
        elif kind == "group":
            actions.append(action(seq, kind, f"g{seq}", members=others, title="g", level=rng.choice(["feature", "task"])))
            names.append(f"g{seq}")
        else:
            actions.append(action(seq, kind, x, to=rng.choice([*names, None]) if kind == "move" else None, members=[o for o in others if o != x] if kind == "merge" else None, title=rng.choice(["a", "b", ""])))
    compare(spark, BASE, actions)


def test_nothing_to_do(spark):
    done = Reshaped(spark.createDataFrame(BASE, ITEM), spark.createDataFrame([], ACTION))
    assert done.items().count() == len(BASE) and done.problems().count() == 0
