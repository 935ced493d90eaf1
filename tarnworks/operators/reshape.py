"""A sequence of changes to a tree, applied in order, as joins.

Whether a change can be made depends on those before it: what it names must be there at its turn. So changes are taken
apart into events (an item goes under another, is merged into another, is dropped with all below it, is made beside
another, gets new values), and validity is settled in rounds: from the events held valid follows who is whose parent
when, and who is there when; from that, which events are valid. An event depends only on earlier ones, so the rounds
end, after as many as the longest chain of dependent changes.

Who is whose parent when is a table of spans. A merge ends the spans of the children of the item that it takes away, and
starts others under its survivor; chains of merges repeat that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.operators.tree import LATTICE
from tarnworks.session import cut, cut_afresh

#: Events of one change at most.
ROOM = 1 << 20
EVER = 1 << 62
ACTION = (
    "seq long, kind string, id string, to string, members array<string>, title string, description string, priority string, level string, "
    "names map<string,string>, parts array<struct<id:string,title:string,level:string,description:string,priority:string>>"
)


def events_of(actions: DataFrame) -> DataFrame:
    """o (place in the whole order), seq, kind, x, to, and the values that an item is made with or gets."""
    start = F.col("seq") * ROOM
    null = lambda c, kind="string": F.lit(None).cast(kind).alias(c)
    values = ("title", "description", "priority", "level", "status")

    def event(rows, o, kind, x, to=None, **own):
        return rows.select(o.alias("o"), "seq", F.lit(kind).alias("kind"), x.alias("x"), (F.lit(None).cast("string") if to is None else to).alias("to"), *(own[v].alias(v) if v in own else null(v) for v in values))

    each = actions.select("*", F.posexplode("members").alias("k", "member"))
    part = actions.where("kind = 'split'").select("*", F.posexplode("parts").alias("k", "p"))
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    pending = F.lit("pending")
    parts = [
        event(actions.where("kind = 'move'"), start, "move", F.col("id"), F.col("to")),
        event(actions.where("kind in ('merge', 'update')"), start, "set", F.col("id"), title=given("title"), description=given("description"), priority=F.when(F.col("kind") == "update", given("priority"))),
        event(actions.where("kind = 'obsolete'"), start, "set", F.col("id"), status=F.lit("deferred")),
        event(each.where("kind = 'merge'"), start + 1 + F.col("k"), "merge", F.col("member"), F.col("id")),
        event(part, start + F.col("k"), "make", F.coalesce("p.id", F.concat_ws("-", "id", F.col("k") + 1)), F.col("id"), title=F.col("p.title"), description=F.col("p.description"), priority=F.col("p.priority"), level=F.col("p.level"), status=pending),
        event(actions.where("kind in ('split', 'delete')"), start + ROOM - 1, "drop", F.col("id")),
        event(actions.where("kind = 'group' and size(members) > 0"), start, "make", F.col("id"), F.col("members")[0], title=F.col("title"), level=F.col("level"), status=pending),
        event(each.where("kind = 'group'"), start + 1 + 2 * F.col("k"), "set", F.col("member"), title=F.nullif(F.try_element_at("names", F.col("member")), F.lit(""))),
        event(each.where("kind = 'group'"), start + 2 + 2 * F.col("k"), "move", F.col("member"), F.col("id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Reshaped:
    """``items`` (id, parent_id, level, status, title, description, priority and more) after ``actions`` (see ``ACTION``).

    move: an item goes to a parent that may hold its level and isn't below it (no parent: to the top). merge: members
    leave, their children go to ``id``; a member above the survivor stays. update: new values where they aren't empty.
    obsolete: deferred. delete: an item and all below it leave. split: new items beside one that then is deleted.
    group: a new item beside the first member, to which all members move; nothing happens if a member is missing.
    What can't be done is left out and listed in ``problems``. Items that leave stay in ``items`` as deleted.
    """

    def __init__(self, items: DataFrame, actions: DataFrame):
        self.source = items
        self.events = cut(events_of(actions))
        groups = actions.where("kind = 'group'").select("seq", F.explode("members").alias("x"))
        self.groups = cut(groups)
        made = self.events.where("kind = 'make'")
        every = cut(items.select(F.col("id").alias("x"), F.col("parent_id").alias("p"), F.lit(-1).cast("long").alias("o"), "level"))
        # what events name, and what is above that, says which are valid; all others only follow
        self.start = cut_afresh(every.join(self._concerned(every), "x", "left_semi"))
        valid = self.events.select("o", F.lit(None).cast("string").alias("problem"))
        parents = made.select("o", F.lit(None).cast("string").alias("p")).where("false")
        for _ in range(self.events.count() + 2):
            self._born(valid)
            self._spans(valid, parents)
            self._gone(valid)
            new = cut_afresh(self._judged())
            made_under = cut_afresh(made.select("o", F.col("to").alias("x")).join(self.spans, "x").where(self._at(F.col("o"))).select("o", "p"))
            key = lambda t, c: t.select("o", F.coalesce(c, F.lit("")).alias("c"))
            same = key(new, "problem").exceptAll(key(valid, "problem")).isEmpty() and key(made_under, "p").exceptAll(key(parents, "p")).isEmpty()
            valid, parents = new, made_under
            if same:
                break
        else:
            raise RuntimeError("changes that depend on each other never settled")
        self.valid, self.start = valid, every
        self._spans(valid, parents)
        self._gone(valid)

    def _concerned(self, every: DataFrame) -> DataFrame:
        """x: names in events, and all that is above them at first."""
        names = self.events.select("x").union(self.events.select("to")).union(self.groups.select("x"))
        rim = found = cut_afresh(names.where("x is not null").distinct())
        while not rim.isEmpty():
            up = every.join(rim, "x", "left_semi").where("p is not null").select(F.col("p").alias("x")).distinct()
            rim = cut_afresh(up.join(found, "x", "left_anti"))
            found = cut_afresh(found.unionByName(rim))
        return found

    @staticmethod
    def _at(o: Column) -> Column:
        return (F.col("from") < o) & (o <= F.col("until"))

    def _born(self, valid: DataFrame) -> None:
        """x, born, level of every item that is ever there."""
        made = self.events.where("kind = 'make'").join(valid.where("problem is null").select("o"), "o").join(self.start.select("x"), "x", "left_anti")
        first = made.groupBy("x").agg(F.min("o").alias("born"), F.min_by("level", "o").alias("level"))
        self.known = cut_afresh(self.start.select("x", F.lit(-1).cast("long").alias("born"), "level").unionByName(first))

    def _spans(self, valid: DataFrame, parents: DataFrame) -> None:
        """x, p, from, until: whose parent is whom, after ``from`` and up to ``until``."""
        good = self.events.join(valid.where("problem is null").select("o"), "o")
        moves = good.where("kind = 'move'").select("x", F.col("to").alias("p"), "o")
        made = good.where("kind = 'make'").join(parents, "o", "left").select("x", "p", "o")
        last = F.lead("o").over(Window.partitionBy("x").orderBy("o"))
        spans = self.start.select("x", "p", "o").unionByName(moves).unionByName(made).select("x", "p", F.col("o").alias("from"), F.coalesce(last, F.lit(EVER)).alias("until"))
        merges = cut(good.where("kind = 'merge'").groupBy(F.col("x").alias("p")).agg(F.min("o").alias("at"), F.min_by("to", "o").alias("survivor")))
        settled, open_ = None, spans
        while True:
            met = open_.join(merges, "p", "left").withColumn("splits", F.coalesce((F.col("from") < F.col("at")) & (F.col("at") < F.col("until")), F.lit(False)))
            met = cut_afresh(met)
            done = met.select("x", "p", "from", F.when(F.col("splits"), F.col("at")).otherwise(F.col("until")).alias("until"))
            settled = done if settled is None else settled.unionByName(done)
            open_ = met.where("splits").select("x", F.col("survivor").alias("p"), F.col("at").alias("from"), "until")
            if open_.isEmpty():
                break
        self.spans = cut_afresh(settled)

    def _gone(self, valid: DataFrame) -> None:
        """x, removed: when items leave."""
        good = self.events.join(valid.where("problem is null").select("o"), "o")
        rim = dropped = cut_afresh(good.where("kind = 'drop'").select("x", "o"))
        while not rim.isEmpty():  # events wrongly held valid may make rings, so what was met isn't met again
            below = rim.toDF("p", "o").join(self.spans, "p").where(self._at(F.col("o"))).select("x", "o").distinct()
            rim = cut_afresh(below.join(dropped, ["x", "o"], "left_anti"))
            dropped = cut_afresh(dropped.unionByName(rim))
        gone = good.where("kind = 'merge'").select("x", "o").unionByName(dropped)
        self.removed = cut_afresh(gone.groupBy("x").agg(F.min("o").alias("removed")))

    def _there(self, rows: DataFrame, column: str, flag: str) -> DataFrame:
        """``rows`` with whether the item in ``column`` is there just before ``o``, whether its name is taken, and its level."""
        known = self.known.join(self.removed, "x", "left").select(F.col("x").alias(column), "born", "removed", F.col("level").alias(f"{flag}_level"))
        there = F.col("born").isNotNull() & (F.col("born") < F.col("o")) & (F.col("removed").isNull() | (F.col("removed") >= F.col("o")))
        return rows.join(known, column, "left").withColumns({flag: there, f"{flag}_taken": F.coalesce(F.col("born") < F.col("o"), F.lit(False))}).drop("born", "removed")

    def _judged(self) -> DataFrame:
        """o, problem of every event."""
        rows = self._there(self._there(self.events.select("o", "seq", "kind", "x", "to"), "x", "own"), "to", "other")
        # what is above the item that another is to go under
        above = cut_afresh(rows.where("kind in ('move', 'merge') and to is not null").select("o", "x", F.col("to").alias("up")))
        hits, seen = above.where("x = up").select("o"), above
        while True:
            above = cut_afresh(above.select("o", F.col("x").alias("mine"), F.col("up").alias("x")).join(self.spans, "x").where(self._at(F.col("o")) & F.col("p").isNotNull()).select("o", F.col("mine").alias("x"), F.col("p").alias("up")))
            above = above.join(seen, ["o", "x", "up"], "left_anti")
            if above.isEmpty():
                break
            seen = cut_afresh(seen.unionByName(above))
            hits = hits.unionByName(above.where("x = up").select("o"))
        rows = rows.join(hits.distinct().withColumn("circular", F.lit(True)), "o", "left")
        members = self.groups.join(self.events.select("seq").distinct(), "seq").withColumn("o", F.col("seq") * ROOM)
        missing = self._there(members, "x", "own").groupBy("seq").agg(F.bool_and("own").alias("complete"))
        rows = rows.join(missing, "seq", "left")
        fits = F.lit(False)
        for level, holders in LATTICE.items():
            inner = F.lit(False)
            if None in holders:
                inner = F.col("to").isNull()
            if any(holders):
                inner = inner | F.coalesce(F.col("other_level").isin(*[h for h in holders if h]), F.lit(False))
            fits = fits | ((F.col("own_level") == level) & inner)
        kind = F.col("kind")
        problem = (
            F.when(F.coalesce(~F.col("complete"), F.lit(False)), "a member is missing")
            .when((kind != "make") & ~F.col("own"), "not there")
            .when(kind.isin("make", "merge") & ~F.col("other"), "not there")
            .when((kind == "make") & F.col("own_taken"), "already there")
            .when((kind == "move") & F.col("to").isNotNull() & ~F.col("other"), "not there")
            .when(F.coalesce("circular", F.lit(False)), "below itself")
            .when((kind == "move") & ~fits, "level")
        )
        return rows.select("o", problem.alias("problem"))

    def problems(self) -> DataFrame:
        """seq, id, problem of each event that was left out."""
        return self.events.join(self.valid.where("problem is not null"), "o").select("seq", F.col("x").alias("id"), "problem")

    def items(self) -> DataFrame:
        good = self.events.join(self.valid.where("problem is null").select("o"), "o")
        made = good.where("kind = 'make'").select(F.col("x").alias("id"), F.lit(None).cast("string").alias("parent_id"), "level", "status", "title", "description", "priority")
        rows = self.source.unionByName(made, allowMissingColumns=True)
        new = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("o"))).alias(f"_{c}")
        fields = ("title", "description", "priority", "status")
        values = good.where("kind = 'set'").groupBy(F.col("x").alias("id")).agg(*map(new, fields))
        last = self.spans.where(F.col("until") == EVER).select(F.col("x").alias("id"), F.col("p").alias("_p"))
        rows = rows.join(values, "id", "left").join(last, "id", "left").join(self.removed.withColumnRenamed("x", "id"), "id", "left")
        status = F.when(F.col("removed").isNotNull(), "deleted").otherwise(F.coalesce("_status", "status"))
        own = {"parent_id": F.col("_p"), "status": status} | {c: F.coalesce(f"_{c}", c) for c in fields[:3]}
        return rows.select(*(own[c].alias(c) if c in own else F.col(c) for c in self.source.columns))
