"""Names that mean the same: verb-aware similarity, candidate pairs without a cross join, clusters, best matches.

A score is a column expression over arrays (bigrams and words of a name, and of what follows its verb). Candidates come
from distinct normalised texts: a pair above a threshold shares one of the rarest bigrams of each, or a word of one
that is among its rarest starts or is started by a word of the other, or one text holds the other and so the rarest
bigram of it. Names with verbs also meet by what follows the verb, at the threshold that their score needs there. So
candidates miss no pair, and no group of equal names is multiplied.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.functions.text import dice, grams, normalize
from tarnworks.session import cut, cut_afresh

#: Verbs that start a name, and what each counts as.
VERBS = {
    "add": "implement",
    "implement": "implement",
    "create": "implement",
    "build": "implement",
    "setup": "implement",
    "set": "implement",
    "introduce": "implement",
    "fix": "fix",
    "resolve": "fix",
    "repair": "fix",
    "patch": "fix",
    "refactor": "refactor",
    "restructure": "refactor",
    "reorganize": "refactor",
    "clean": "refactor",
    "update": "update",
    "upgrade": "update",
    "improve": "update",
    "enhance": "update",
    "optimize": "update",
    "remove": "remove",
    "delete": "remove",
    "drop": "remove",
    "investigate": "investigate",
    "analyze": "investigate",
    "review": "investigate",
    "audit": "investigate",
}
#: Words that names leave out when compared.
NAME_STOP_WORDS = ("the", "a", "an", "and", "or", "for", "to", "in", "of", "on", "with", "is", "be", "up", "by", "at", "as", "its", "it", "this", "that")


def parts_of(text: Column) -> Column:
    """A text with its distinct bigrams and words, which scores compare."""
    return F.struct(text.alias("t"), grams(text, 2).alias("g"), F.array_distinct(F.filter(F.split(text, " "), lambda w: w != "")).alias("w"))


def verb_of(name: Column) -> Column:
    """What the verb at the start of a normalised name counts as, or null."""
    known = F.create_map(*(F.lit(x) for kv in VERBS.items() for x in kv))
    return F.try_element_at(known, F.regexp_replace(F.split(name, " ")[0], ":$", ""))


def content_of(name: Column) -> Column:
    """The words after a name's verb but for ``NAME_STOP_WORDS``; "set up" is one verb."""
    words = F.split(name, " ")
    pair = (F.regexp_replace(words[0], ":$", "") == "set") & (F.get(words, F.lit(1)) == "up")
    rest = F.slice(words, F.when(F.coalesce(pair, F.lit(False)), 3).otherwise(2), F.size(words) + 1)
    return F.array_join(F.filter(rest, lambda w: ~w.isin(*NAME_STOP_WORDS)), " ")


def measured(name: Column) -> Column:
    return F.struct(parts_of(name).alias("whole"), verb_of(name).alias("verb"), parts_of(content_of(name)).alias("content"))


def plain_score(x: Column, y: Column) -> Column:
    """Of two ``parts_of`` texts; words that start each other earn part credit, so the order of the two matters."""
    none = lambda c: F.size(c) == 0
    lengths = F.array_sort(F.array(F.length(x["t"]), F.length(y["t"])))
    starting = F.size(F.filter(F.array_except(x["w"], y["w"]), lambda p: F.exists(y["w"], lambda q: F.startswith(q, p) | F.startswith(p, q))))
    by_words = F.when(none(x["w"]) | none(y["w"]), 0.0).otherwise((F.size(F.array_intersect(x["w"], y["w"])) + 0.8 * starting) / (F.size(F.array_union(x["w"], y["w"])) - starting))
    by_grams = F.when(none(x["g"]) | none(y["g"]), 0.0).otherwise(dice(x["g"], y["g"]))
    held = F.contains(x["t"], y["t"]) | F.contains(y["t"], x["t"])
    whole = F.when(held, F.greatest(F.lit(0.7), lengths[0] / lengths[1])).otherwise(F.greatest(by_grams, by_words))
    return F.when((x["t"] == "") | (y["t"] == ""), 0.0).otherwise(whole)


#: What likeness after the verb counts, and what an equal verb adds.
CONTENT_WEIGHT, VERB_WEIGHT = 0.85, 0.15


def name_score(x: Column, y: Column) -> Column:
    """Of two ``measured`` names: mostly by what follows the verb if both have one, else as they are."""
    verbs = x["verb"].isNotNull() & y["verb"].isNotNull() & (x["content"]["t"] != "") & (y["content"]["t"] != "")
    by_verb = CONTENT_WEIGHT * plain_score(x["content"], y["content"]) + F.when(x["verb"] == y["verb"], VERB_WEIGHT).otherwise(0.0)
    equal = (x["whole"]["t"] == y["whole"]["t"]) & (x["whole"]["t"] != "")
    return F.when(equal, 1.0).when(verbs, F.least(F.lit(1.0), by_verb)).otherwise(plain_score(x["whole"], y["whole"]))


def similarity(a: Column | str, b: Column | str) -> Column:
    """Score of two normalised names, from 0 to 1; null counts as empty."""
    a, b = (F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (a, b))
    return F.transform(F.array(F.struct(measured(a).alias("x"), measured(b).alias("y"))), lambda p: name_score(p["x"], p["y"]))[0]


def rarest(rows: DataFrame, key: str, kept: Column) -> DataFrame:
    """Of each text's keys (t, key) the ``kept`` rarest; ``kept`` may use their number ``n``."""
    frequency = rows.groupBy(key).agg(F.count("*").alias("df"))
    ordered = rows.join(frequency, key).groupBy("t").agg(F.array_sort(F.collect_list(F.struct("df", key))).alias("x")).withColumn("n", F.size("x"))
    return ordered.select("t", "n", F.explode(F.slice("x", F.lit(1), F.greatest(F.lit(1), F.least(F.col("n"), kept)))).alias("x")).select("t", "n", f"x.{key}")


def meeting(texts: DataFrame, threshold: float) -> DataFrame:
    """x, y (both ways, unequal): all pairs of distinct ``texts`` (t) whose ``plain_score`` may reach the threshold."""
    held = cut(texts.where("t != ''").select("t").distinct())
    per_gram = cut(held.select("t", F.explode(grams(F.col("t"), 2)).alias("key")))
    share = threshold / (2 - threshold)  # of a text's bigrams that a similar one has
    keys = cut(rarest(per_gram, "key", F.col("n") - F.ceil(F.col("n") * share - 1e-9).cast("int") + 1).select("t", "key"))
    by_gram = keys.toDF("x", "key").join(keys.toDF("y", "key"), "key").select("x", "y")

    one = held.where("length(t) = 1").select("t", F.col("t").alias("key"))
    probes = rarest(per_gram, "key", F.lit(1)).select("t", "key").unionByName(one)
    letters = held.select("t", F.explode(F.array_distinct(F.split("t", ""))).alias("key")).join(one.select("key").distinct(), "key", "left_semi").select("t", "key")
    holding = probes.toDF("x", "key").join(per_gram.unionByName(letters).toDF("y", "key"), "key").where("x != y and contains(y, x)").select("x", "y")

    words = cut(held.select("t", F.explode(F.array_distinct(F.filter(F.split("t", " "), lambda w: w != ""))).alias("key")))
    least = F.ceil((F.col("n") + 1) * threshold / (1 + threshold) - 1e-9).cast("int")  # words that match, of n and one at least
    few = cut(rarest(words, "key", F.col("n") - least + 1))
    starts = lambda rows: rows.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda k: F.substring(F.col("key"), F.lit(1), k))))
    all_words = words.join(words.groupBy("t").agg(F.count("*").alias("m")), "t").withColumnRenamed("t", "y")
    left = few.withColumnRenamed("t", "x")
    fits = F.col("m") * threshold <= F.col("n") + 1e-9
    by_word = left.join(starts(all_words), "key").where(fits).select("x", "y").union(starts(left).join(all_words, "key").where(fits).select("x", "y"))
    found = by_gram.union(holding).union(by_word).where("x != y")
    return found.union(found.select("y", "x")).distinct()


def similar_pairs(names: DataFrame, threshold: float = 0.7) -> DataFrame:
    """a, b (a before b) and their score, for distinct normalised ``names`` (name) at or above the threshold, above 0.15."""
    own = cut(names.select("name").where("name != ''").distinct().withColumn("m", measured(F.col("name"))))
    whole = meeting(own.select(F.col("name").alias("t")), threshold).toDF("a", "b")
    verbed = own.where("m.verb is not null and m.content.t != ''").select("name", F.col("m.content.t").alias("t"))
    alike = meeting(verbed.select("t"), (threshold - VERB_WEIGHT) / CONTENT_WEIGHT).union(verbed.select("t", F.col("t").alias("y")).distinct())
    by_content = verbed.toDF("a", "x").join(alike, "x").join(verbed.toDF("b", "y"), "y").select("a", "b")
    pairs = whole.union(by_content).where("a < b").distinct()
    scored = pairs.join(own.toDF("a", "ma"), "a").join(own.toDF("b", "mb"), "b").select("a", "b", name_score(F.col("ma"), F.col("mb")).alias("score"))
    return scored.where(F.col("score") >= threshold)


def gram_pairs(names: DataFrame, n: int, measure: Callable[[Column, Column], Column], least: float, shared: float) -> DataFrame:
    """a, b (a before b) and score of all distinct ``names`` (name) whose sets of ``n``-grams measure at or above ``least``.

    ``shared``: the least share of its grams that a name then has in common with the other. So two such names meet
    in one of their rarest grams, whatever their words.
    """
    held = cut(names.select("name").distinct().withColumn("g", grams(F.col("name"), n)))
    per_gram = held.select("name", F.explode("g").alias("gram"))
    frequency = per_gram.groupBy("gram").agg(F.count("*").alias("df"))
    ordered = per_gram.join(frequency, "gram").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("x"))
    kept = F.size("x") - F.ceil(F.size("x") * shared - 1e-9).cast("int") + 1
    keys = cut(ordered.select("name", F.explode(F.slice("x", F.lit(1), F.least(kept, F.size("x")))).alias("x")).select("name", "x.gram"))
    pairs = keys.toDF("a", "gram").join(keys.toDF("b", "gram"), "gram").where("a < b").select("a", "b").distinct()
    scored = pairs.join(held.toDF("a", "ga"), "a").join(held.toDF("b", "gb"), "b").select("a", "b", measure(F.col("ga"), F.col("gb")).alias("score"))
    return scored.where(F.col("score") >= least)


def clusters(pairs: DataFrame) -> DataFrame:
    """name, cluster (its least name) over all pairs: labels spread until none changes.

    In each round all names of a label move to the least label next to any of them, and on to where the moves end.
    """
    both = cut_afresh(pairs.select("a", "b").union(pairs.select("b", "a")).distinct())
    labels = cut_afresh(both.select(F.col("a").alias("name")).distinct().withColumn("cluster", F.col("name")))
    while True:
        near = both.join(labels.select(F.col("name").alias("b"), F.col("cluster").alias("near")), "b").groupBy(F.col("a").alias("name")).agg(F.min("near").alias("near"))
        moves = cut_afresh(labels.join(near, "name").groupBy("cluster").agg(F.min("near").alias("near")).select("cluster", F.least("cluster", "near").alias("next")))
        if moves.where("next < cluster").isEmpty():
            return labels
        while True:
            onward = moves.select(F.col("cluster").alias("next"), F.col("next").alias("last"))
            jumped = cut_afresh(moves.join(onward, "next").select("cluster", F.col("last").alias("next"), (F.col("last") < F.col("next")).alias("jumped")))
            moves = jumped.select("cluster", "next")
            if jumped.where("jumped").isEmpty():
                break
        labels = cut_afresh(labels.join(moves, "cluster").select("name", F.col("next").alias("cluster")))


def duplicate_groups(items: DataFrame, name: str, threshold: float = 0.7) -> DataFrame:
    """``items`` with the cluster of their name; equal names share one, whether or not anything else is similar."""
    rows = items.withColumn("_name", normalize(F.col(name)))
    found = clusters(similar_pairs(rows.select(F.col("_name").alias("name")), threshold)).withColumnRenamed("name", "_name")
    return rows.join(found, "_name", "left").withColumn("cluster", F.coalesce("cluster", "_name")).drop("_name")


def best_matches(proposals: DataFrame, items: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Each proposal's most similar item at or above the threshold: proposal, item, score; ties to the lesser name."""
    # once cut, the test of a score isn't pushed down to every row of a name
    p, i = (cut(t.select(normalize(F.col("name")).alias("name")).distinct()) for t in (proposals, items))
    pairs = cut(similar_pairs(p.union(i), threshold))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("p", "i").union(p.select(F.col("name").alias("p"), F.col("name").alias("i")))
    kept = both.join(p.withColumnRenamed("name", "p"), "p").join(i.withColumnRenamed("name", "i"), "i").withColumn("score", similarity("p", "i"))
    kept = cut(kept.where(F.col("score") >= threshold))
    best = kept.groupBy("p").agg(F.max("score").alias("score"))
    return kept.join(best, ["p", "score"]).groupBy(F.col("p").alias("proposal"), "score").agg(F.min("i").alias("item"))


def blended(name_score: Column, description_score: Column) -> Column:
    """Score of two results with descriptions; very like descriptions count most, somewhat like ones in part."""
    mixed = F.when(description_score >= 0.8, description_score * 0.9 + name_score * 0.1).when(description_score >= 0.5, name_score * 0.6 + description_score * 0.4)
    return F.greatest(name_score, F.coalesce(mixed, name_score))


#: Weights of title, description, tags and children's titles.
CORRELATION_WEIGHTS = {"title": 0.45, "description": 0.25, "tags": 0.10, "children": 0.20}


def combined(title: Column, description: Column, tags: Column, children: Column) -> Column:
    """Weighted score; without a likeness of descriptions its weight is the title's."""
    w = CORRELATION_WEIGHTS
    described = description > 0
    return title * F.when(described, w["title"]).otherwise(w["title"] + w["description"]) + F.when(described, description * w["description"]).otherwise(0.0) + tags * w["tags"] + children * w["children"]


def node_score(title_score: Column, content_score: Column) -> Column:
    """Score of a proposal's node and an item of its level with unequal titles."""
    return F.greatest(title_score, title_score * 0.75 + content_score * 0.25, content_score * 0.7)


def by_rarity(texts: DataFrame, keys: Column, name: str) -> DataFrame:
    """``texts`` (kind, t) with their distinct keys in a column, those that fewest texts of the kind have first."""
    rows = texts.select("kind", "t", F.explode(keys).alias("key"))
    counted = rows.join(rows.groupBy("kind", "key").agg(F.count("*").alias("df")), ["kind", "key"])
    ordered = counted.groupBy("kind", "t").agg(F.array_sort(F.collect_list(F.struct("df", "key")))["key"].alias(name))
    return texts.join(ordered, ["kind", "t"], "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))


def meeting_across(left: DataFrame, right: DataFrame, least: Column) -> DataFrame:
    """kind, x of ``left``, y of ``right``: pairs of a kind whose ``plain_score`` may reach ``least``, a column over kind.

    Both sides have kind, t, and bigrams and words by rarity (grams, words), in one order for both sides.
    """
    first = lambda rows, name, kept: rows.select("kind", "t", F.explode(F.slice(name, F.lit(1), F.greatest(F.lit(1), F.least(F.size(name), kept)))).alias("key"), F.size(name).alias("n"))
    every = lambda rows, name: rows.select("kind", "t", F.explode(name).alias("key"), F.size(name).alias("m"))
    met = lambda a, b: a.withColumnRenamed("t", "x").join(b.withColumnRenamed("t", "y"), ["kind", "key"])
    few = F.size("grams") - F.ceil(F.size("grams") * least / (2 - least) - 1e-9).cast("int") + 1
    by_gram = met(first(left, "grams", few), first(right, "grams", few)).select("kind", "x", "y")

    def holding(a, b):  # texts of a in texts of b: by a bigram, or by the letter of a text that is no longer
        ones = a.where("length(t) = 1").select("kind", "t", F.col("t").alias("key"))
        letters = b.select("kind", "t", F.explode(F.array_distinct(F.split("t", ""))).alias("key")).join(ones.select("kind", "key").distinct(), ["kind", "key"], "left_semi").select("kind", "t", "key")
        probes = first(a, "grams", F.lit(1)).select("kind", "t", "key").unionByName(ones)
        return met(probes, every(b, "grams").select("kind", "t", "key").unionByName(letters)).where("contains(y, x)")

    held = holding(left, right).select("kind", "x", "y").union(holding(right, left).select("kind", F.col("y").alias("x"), F.col("x").alias("y")))
    starts = lambda rows: rows.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda k: F.substring(F.col("key"), F.lit(1), k))))
    kept = F.size("words") - F.ceil((F.size("words") + 1) * least / (1 + least) - 1e-9).cast("int") + 1
    own, theirs = first(left, "words", kept), every(right, "words")
    by_word = met(own, starts(theirs)).unionByName(met(starts(own), theirs)).where(F.col("m") * least <= F.col("n") + 1e-9).select("kind", "x", "y")
    return by_gram.union(held).union(by_word).distinct()


#: Scores at which the best epics are sought in turn, down to the least one asked for.
RUNGS = (0.45,)


def epics_of_features(features: DataFrame, epics: DataFrame, least: float = 0.15, most: int = 5) -> DataFrame:
    """feature, epic, score: for each feature (id, title, description, tags, children) the best epics, at or above a score.

    The best are found from the top: at each of ``RUNGS``, then at ``least``, all pairs that reach the score are found,
    and a feature that has enough of them is done and leaves. Tags add at most a tenth, so title, description or
    children of such a pair have a likeness of at least (score - 0.1) / 0.9, and meet by their rarest bigrams and words
    as in ``meeting_across``, or by equal verbs where these alone suffice. Features, and epics, that agree in all
    columns are compared once; of equal epics the first ``most`` are kept, as no feature needs more. Ties go to the
    lesser epic. ``least`` must exceed 0.1, what tags alone can earn.
    """
    if least <= CORRELATION_WEIGHTS["tags"]:
        raise ValueError("a score that tags alone can reach lets every pair pass")
    own = ["title", "description", "children"]
    text = lambda c: F.coalesce(normalize(F.col(c)), F.lit(""))
    tags = F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col("tags"), F.array().cast("array<string>")), F.lower)))
    plain = lambda t: t.select("id", *(text(c).alias(c) for c in own), tags.alias("tags"))
    features, epics = cut(plain(features)), plain(epics)
    left = features.groupBy(*own, "tags").agg(F.min("id").alias("f"))
    rank = F.row_number().over(Window.partitionBy(*own, "tags").orderBy("id"))
    first = cut(epics.withColumn("k", rank).where(F.col("k") <= most))
    right = first.groupBy(*own, "tags").agg(F.min("id").alias("e"), F.count("*").alias("n"))
    with_parts = lambda t: t.select("*", *(measured(F.col(c)).alias(f"{c}_m") for c in own))
    left, right = cut(with_parts(left)), cut(with_parts(right))

    # names of either side by field; what follows a verb is a text of another kind, with a threshold of its own
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("name"), F.col(f"{c}_m").alias("m")) for c in own)))
    named = lambda t, i: t.select(i, fields.alias("x")).select(i, "x.field", "x.name", "x.m").where("name != ''")
    lefts, rights = named(left, "f"), named(right, "e")
    verbed = (F.col("m.verb").isNotNull()) & (F.col("m.content.t") != "")
    kinds = lambda t: t.select(F.col("field").alias("kind"), F.col("name").alias("t")).union(t.where(verbed).select(F.concat("field", F.lit("+")), F.col("m.content.t"))).distinct()
    every = cut(kinds(lefts).union(kinds(rights)).distinct())
    words = F.array_distinct(F.filter(F.split("t", " "), lambda w: w != ""))
    index = cut(by_rarity(by_rarity(every, grams(F.col("t"), 2), "grams"), words, "words"))
    there = cut(index.join(kinds(rights), ["kind", "t"], "left_semi"))
    names = cut(rights.select("field", "name", "m").distinct())

    found, open_ = None, left
    for score in [*(r for r in RUNGS if r > least), least]:
        alike = (score - CORRELATION_WEIGHTS["tags"]) / (1 - CORRELATION_WEIGHTS["tags"]) - 1e-9
        after = alike / CONTENT_WEIGHT if alike <= VERB_WEIGHT else (alike - VERB_WEIGHT) / CONTENT_WEIGHT
        mine = named(open_, "f")
        here = index.join(kinds(mine), ["kind", "t"], "left_semi")
        texts = cut(meeting_across(here, there, F.when(F.endswith("kind", F.lit("+")), after).otherwise(alike)))
        asked = mine.select("field", "name", "m").distinct()
        x = asked.select("field", F.col("name").alias("x"), F.col("m.verb").alias("xv"), F.when(verbed, F.col("m.content.t")).alias("xc"))
        y = names.select("field", F.col("name").alias("y"), F.col("m.verb").alias("yv"), F.when(verbed, F.col("m.content.t")).alias("yc"))
        rest = texts.where(F.endswith("kind", F.lit("+"))).select(F.expr("substring(kind, 1, length(kind) - 1)").alias("field"), F.col("x").alias("xc"), F.col("y").alias("yc"))
        pairs = texts.where(~F.endswith("kind", F.lit("+"))).select(F.col("kind").alias("field"), "x", "y")
        pairs = pairs.union(x.join(rest, ["field", "xc"]).join(y, ["field", "yc"]).select("field", "x", "y"))
        if alike <= VERB_WEIGHT:
            pairs = pairs.union(x.where("xc is not null").join(y.where("yc is not null"), (x["field"] == y["field"]) & (F.col("xv") == F.col("yv"))).select(x["field"], "x", "y"))
        pairs = pairs.distinct().join(asked.toDF("field", "x", "xm"), ["field", "x"]).join(names.toDF("field", "y", "ym"), ["field", "y"])
        pairs = cut(pairs.where(name_score(F.col("xm"), F.col("ym")) >= alike).select("field", "x", "y"))
        both = mine.select("f", "field", F.col("name").alias("x")).join(pairs, ["field", "x"]).join(rights.select("e", "field", F.col("name").alias("y")), ["field", "y"]).select("f", "e").distinct()
        scored = cut(both.join(side(open_, "f"), "f").join(side(right, "e"), "e").select("f", "e", "n", correlation().alias("score")).where(F.col("score") >= score))
        enough = scored.groupBy("f").agg(F.sum("n").alias("n")).where(F.col("n") >= most).select("f")
        last = score == least
        part = scored if last else scored.join(enough, "f", "left_semi")
        found = part if found is None else found.union(part)
        if not last:
            open_ = cut(open_.join(enough, "f", "left_anti"))
    ids = first.join(right.select(*own, "tags", "e"), [*own, "tags"]).select("e", F.col("id").alias("epic"))
    best = F.row_number().over(Window.partitionBy("f").orderBy(F.desc("score"), "epic"))
    ranked = found.select("f", "e", "score").join(ids, "e").withColumn("k", best).where(F.col("k") <= most)
    classes = features.join(left.select(*own, "tags", "f"), [*own, "tags"]).select("f", F.col("id").alias("feature"))
    return classes.join(ranked, "f").select("feature", "epic", "score")


def side(rows: DataFrame, name: str) -> DataFrame:
    """Columns of ``epics_of_features`` with a name before them."""
    extra = ["n"] if "n" in rows.columns else []
    return rows.select(name, *extra, *(F.col(f"{c}_m").alias(f"{name}_{c}") for c in ("title", "description", "children")), F.col("tags").alias(f"{name}_tags"))


def correlation() -> Column:
    """Weighted score of a pair of sides ``f`` and ``e``."""
    t, d, k = (name_score(F.col(f"f_{c}"), F.col(f"e_{c}")) for c in ("title", "description", "children"))
    union = F.size(F.array_union("f_tags", "e_tags"))
    tags = F.when(union > 0, F.size(F.array_intersect("f_tags", "e_tags")) / union).otherwise(0.0)
    return combined(t, d, tags, k)


def matched_nodes(nodes: DataFrame, items: DataFrame) -> DataFrame:
    """node, item, score, reason: each proposal's node (id, level, title) with the best item of its level.

    Equal titles score 1, one that holds the other (5 letters or more) 0.95, else their similarity from 0.7 on; ties to
    the lesser identifier. Titles meet as ``similar_pairs`` has them, which finds every holding one; those of a level once,
    the least identifier of equal items standing for them.
    """
    a, b = (t.select("id", "level", normalize(F.col("title")).alias("t")) for t in (nodes, items))
    titles = cut(a.select("level", F.col("t").alias("a")).distinct())
    first = cut(b.groupBy("level", F.col("t").alias("b")).agg(F.min("id").alias("item")))
    alike = cut(similar_pairs(titles.select(F.col("a").alias("name")).union(first.select("b")), 0.7))
    both = alike.select("a", "b").union(alike.select("b", "a")).union(titles.select("a", F.col("a").alias("b")).distinct())
    rows = titles.join(both, "a").join(first, ["level", "b"])
    holds = (F.length("a") >= 5) & (F.length("b") >= 5) & (F.contains("a", F.col("b")) | F.contains("b", F.col("a")))
    score = F.when(F.col("a") == F.col("b"), 1.0).when(holds, 0.95).otherwise(similarity("a", "b"))
    rows = rows.withColumn("score", score).where("score >= 0.7")
    reason = F.when(F.col("score") == 1, "exact_title").otherwise("semantic_title")
    best = lambda t, *key: t.groupBy(*key).agg(F.min_by("item", F.struct((-F.col("score")).alias("o"), "item")).alias("item"), F.max("score").alias("score"))
    named = a.select(F.col("id").alias("node"), "level", F.col("t").alias("a")).join(best(rows, "level", "a"), ["level", "a"])
    return best(named, "node").select("node", "item", "score", reason.alias("reason"))


def conflicts(recommendations: DataFrame, items: DataFrame, in_tree: float = 0.7, in_batch: float = 0.95) -> DataFrame:
    """id, other, score, kind: recommendations (id, title) that repeat an open item, or an earlier one of the batch."""
    title = lambda t, c: t.select(F.col("id").alias(c), normalize(F.col("title")).alias(f"{c}_t"))
    new, old = title(recommendations, "id"), title(items.where("status != 'completed'"), "other")
    texts = cut(new.select(F.col("id_t").alias("name")).distinct())
    tree = best_matches(texts, old.select(F.col("other_t").alias("name")), in_tree)
    first = old.groupBy("other_t").agg(F.min("other").alias("other"))
    tree = tree.join(new, F.col("proposal") == F.col("id_t")).join(first, F.col("item") == F.col("other_t")).select("id", "other", "score", F.lit("tree").alias("kind"))
    alike = cut(similar_pairs(texts, in_batch))
    alike = alike.union(alike.select("b", "a", "score")).union(texts.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("score")))
    least = new.groupBy(F.col("id_t").alias("b")).agg(F.min("id").alias("other"))  # the earliest of a title stands for it
    batch = new.join(alike, F.col("id_t") == F.col("a")).join(least, "b").where("other < id").groupBy("id").agg(F.min("other").alias("other"), F.min_by("score", "other").alias("score"))
    return tree.unionByName(batch.select("id", "other", "score", F.lit("batch").alias("kind")))


def sibling_duplicates(items: DataFrame, least: float = 0.75, most: int = 1_000_000) -> DataFrame:
    """a, b, score: open siblings of one level with like titles, each pair once; titles meet as ``similar_pairs`` has them.

    Titles of a parent meet once, with the number of their items; pairs of titles are then dealt in chunks that compare
    at most about ``most`` items, some four to a task, as the rows made say more of the work than those read.
    """
    own = cut(items.where("status not in ('deleted', 'completed')").select("id", "parent_id", "level", normalize(F.col("title")).alias("t")))
    alike = cut(similar_pairs(own.select(F.col("t").alias("name")), least))
    sizes = cut(own.groupBy("parent_id", "level", "t").agg(F.count("*").alias("n")))
    both = alike.union(alike.select("b", "a", "score")).union(sizes.select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("score")).distinct())
    there = sizes.toDF("p", "l", "b", "m")
    same = F.col("parent_id").eqNullSafe(F.col("p")) & (F.col("level") == F.col("l"))
    met = sizes.withColumnRenamed("t", "a").join(both, "a").join(there, "b").where(same)
    met = cut(met.select("parent_id", "level", "a", "b", "score", (F.col("n") * F.col("m")).alias("rows"), F.ceil(F.col("n") * F.col("m") / most).alias("parts"), F.monotonically_increasing_id().alias("pair")))
    rows = met.agg(F.sum("rows")).first()[0] or 0
    tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / (4 * most)))

    def dealt(side, name, chunk):
        key = met.select(F.col("parent_id").alias("p"), F.col("level").alias("l"), F.col(side).alias("x"), "pair", "parts", "score")
        found = own.join(key, F.col("parent_id").eqNullSafe(F.col("p")) & (F.col("level") == F.col("l")) & (F.col("t") == F.col("x")))
        return found.select("pair", chunk.alias("chunk"), F.col("id").alias(name), *(["score"] if side == "a" else [])).repartition(tasks, "pair", "chunk")

    left = dealt("a", "id", F.pmod(F.xxhash64("id"), F.col("parts")))
    right = dealt("b", "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    return left.join(right, ["pair", "chunk"]).where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"), "score")


def unmatched(proposals: DataFrame, items: DataFrame, least: float = 0.7) -> DataFrame:
    """Proposals (name) that no item (name) is like."""
    found = best_matches(proposals, items, least).select("proposal")
    return proposals.withColumn("_n", normalize(F.col("name"))).join(found.select(F.col("proposal").alias("_n")), "_n", "left_anti").drop("_n")
