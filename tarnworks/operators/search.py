"""Weighted search over a table's fields: postings, term expansion, phrases, AND and OR, top-k."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a match in each field is worth.
FIELD_WEIGHTS = {"title": 10, "tags": 6, "description": 3, "acceptance": 2}
#: Words that queries leave out; fields keep theirs, so a part of a query word may still meet them.
SEARCH_STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "shall",
    "should", "may", "might", "must", "can", "could",
    "and", "but", "or", "nor", "not", "so", "if", "then",
    "for", "in", "on", "at", "to", "of", "by", "with", "from",
)


@dataclass
class Query:
    terms: list[str] = field(default_factory=list)
    phrases: list[str] = field(default_factory=list)
    either: bool = False


def tokens(text: str) -> list[str]:
    return [t for t in re.split(r"\s+", re.sub(r"[^a-z0-9\s\-_]", " ", text.lower())) if t and t not in SEARCH_STOP_WORDS]


def parsed(raw: str) -> Query:
    """Quoted phrases, and words; an upper-case OR between words makes any part enough."""
    phrases = [p for m in re.findall(r'"([^"]+)"', raw) if (p := m.strip().lower())]
    rest = re.sub(r'"[^"]+"', " ", raw)
    either = re.search(r"\bOR\b", rest) is not None
    return Query(tokens(re.sub(r"\bOR\b", " ", rest)), phrases, either)


def fields_of(items: DataFrame) -> DataFrame:
    """id, field, text: a row for each searched field of each item, lower-cased."""
    stack = ", ".join(f"'{f}', `{f}`" for f in FIELD_WEIGHTS if f in items.columns)
    n = sum(f in items.columns for f in FIELD_WEIGHTS)
    return items.selectExpr("id", f"stack({n}, {stack}) as (field, text)").where("text is not null").withColumn("text", F.lower("text"))


def postings(items: DataFrame) -> DataFrame:
    """term, id, field, position: the inverted index, for many queries over one corpus."""
    return fields_of(items).select("id", "field", F.posexplode(field_words()).alias("position", "term"))


def field_words():
    return F.filter(F.split(F.regexp_replace("text", r"[^a-z0-9\s\-_]", " "), r"\s+"), lambda w: w != "")


def matches(index: DataFrame, terms: DataFrame) -> DataFrame:
    """query, id, field for each of ``terms`` (query, a word) that an index of postings holds; once a field.

    The terms meet the distinct words of the index, not the postings: by the word itself, by its starts of three
    letters or more, and by its runs of four or more letters, so that every join is by equality.
    """
    known = index.select("term").distinct()
    n = F.length("term")
    starts = F.when(n >= 3, F.transform(F.sequence(F.lit(3), F.greatest(n, F.lit(3))), lambda k: F.substring("term", F.lit(1), k))).otherwise(F.array("term"))
    of_length = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - k + 1)), lambda i: F.substring("term", i, k))
    runs = F.when(n >= 4, F.flatten(F.transform(F.sequence(F.lit(4), F.greatest(n, F.lit(4))), of_length))).otherwise(F.array().cast("array<string>"))
    keys = known.select("term", F.explode(F.array_distinct(F.concat(F.array("term"), starts, runs))).alias("query"))
    return keys.join(terms.select("query").distinct(), "query").join(index, "term").select("query", "id", "field").distinct()


def search(items: DataFrame, raw: str, limit: int = 50) -> DataFrame:
    """id, score, parts: items by score, those with a match in the title first, then by identifier.

    A term matches a word that equals it, starts with it (3 letters or more) or contains it (4 or more), once a field.
    A phrase matches a field that contains it and is worth twice. All parts must match unless the query says OR.
    Fields are scanned once for all parts; no index is shuffled for a single query.
    """
    query = parsed(raw)
    rows = fields_of(items)
    words = field_words()
    weight = F.when(F.lit(False), 0)
    for name, w in FIELD_WEIGHTS.items():
        weight = weight.when(F.col("field") == name, w)

    def has(term):
        if len(term) >= 4:
            return F.exists("words", lambda w: F.contains(w, F.lit(term)))
        if len(term) >= 3:
            return F.exists("words", lambda w: F.startswith(w, F.lit(term)))
        return F.array_contains("words", term)

    tests = [(has(t), 1) for t in query.terms] + [(F.contains(F.col("text"), F.lit(p)), 2) for p in query.phrases]
    if not tests:
        return items.select("id", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("parts")).limit(0)
    hits = rows.withColumn("words", words).select("id", "field", weight.alias("weight"), *(t.alias(f"p{k}") for k, (t, _) in enumerate(tests)))
    score = sum(F.col(f"p{k}").cast("long") * F.col("weight") * times for k, (_, times) in enumerate(tests))
    out = hits.groupBy("id").agg(F.sum(score).cast("long").alias("score"), *(F.bool_or(f"p{k}").alias(f"p{k}") for k in range(len(tests))), F.bool_or((F.col("field") == "title") & (score > 0)).alias("in_title"))
    parts = sum(F.col(f"p{k}").cast("long") for k in range(len(tests)))
    out = out.withColumn("parts", parts).where(F.col("parts") >= (1 if query.either or len(tests) == 1 else len(tests)))
    return out.orderBy(F.desc("score"), F.desc("in_title"), "id").limit(limit).select("id", "score", "parts")
