"""Findings about code: what kind each is, how severe, whether it is known, in what order, and what to do next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnworks.functions.text import dice, grams, normalize
from tarnworks.session import cut

#: Patterns of findings about code, about structure and about documentation, in this order.
CATEGORY_PATTERNS = {
    "code": (
        r"\bduplicat(?:ed|ion|e)\b",
        r"\b(?:dead\s+code|unused\s+export|unused\s+import|god\s+function|god\s+class)\b",
        r"\b(?:circular\s+(?:dep\w*|import)|cycle)\b",
        r"\b(?:anti-?pattern|code\s+smell|tight(?:ly)?\s+coupl)",
        r"\b(?:fan-?in\s+hotspot|hub\s+function|tightly\s+coupled\s+modules)\b",
        r"\b(?:missing\s+(?:abstraction|interface|error\s+handling))\b",
        r"\b(?:leaky\s+abstraction|internal\s+detail|implementation\s+detail)\b",
    ),
    "structural": (
        r"\bzone\b.*\b(?:boundar|split|merg|sprawl|span|assignment|misassign|placement|belongs?\s+in)",
        r"\b(?:directory|dir)\b.*\b(?:sprawl|consolidat|scatter|spread)",
        r"\b(?:belongs?\s+in\b.*\bzone|should\s+(?:be\s+in|move\s+to)\b.*\bzone|misplaced|wrong\s+zone)",
        r"\bzone[\s-]?level\b.*\bcoupling\b",
        r"\b(?:should\s+be\s+(?:split|merged)|should\s+(?:split|merg))\b",
        r"\b(?:split|merg\w*)\b.*\bzone\b",
        r"\btoo\s+(?:many|few)\s+(?:files|zones|directories)\b",
        r"\bzone\b.*\b(?:too\s+large|too\s+small)\b",
    ),
    "documentation": (
        r"\bnaming\s+(?:inconsisten|convention)",
        r"\bshould\s+be\s+(?:renamed|documented)\b",
        r"\b(?:implicit\s+convention|undocumented)\b",
        r"\b(?:jsdoc|readme|comment)\b.*\b(?:missing|needed|should)\b",
    ),
}
#: Starts of sentences that only suppose something, and what tells so near the start.
SUPPOSITIONS = (r"^if\s+", r"^when\s+(?:this|these|that|those)\s+", r"^(should|might|may|could|potentially|possibly|perhaps)\s+", r"^it\s+(may|might|could|appears|seems)\s+", r"(^|\s)(if\s+(?:this|these|those|that)\s)")
#: Words of praise, of tests tied to what they test, and of zones that an analysis doesn't see.
PRAISE = (
    "successfully", "exemplary", "masterful", "clean separation", "well-defined", "well-isolated", "clean design", "good architecture",
    "perfectly maintained", "exceptional", "zero-circular", "clean.*hierarchy", "correctly implements", "proper implementation",
)
TEST_COUPLING = ("test coupling to implementation", "test.*suite.*direct calls.*internals", "unit test.*coupling", "test-to-implementation coupling")
UNSEEN_ZONES = ("missing from zone detection", "not.*(?:appear|present|detected).*(?:zone|cluster)")
#: Order of types, and of severities.
TYPE_ORDER = ("observation", "pattern", "relationship", "anti-pattern", "suggestion")
SEVERITY_ORDER = ("critical", "warning", "info")


def any_of(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (text.rlike(f"(?i){p}") for p in patterns))


def category(text: Column) -> Column:
    """code, structural or documentation, the first whose patterns fit; null if none do."""
    return reduce(lambda c, kv: c.when(any_of(text, kv[1]), kv[0]), CATEGORY_PATTERNS.items(), F.when(F.lit(False), ""))


def is_supposition(text: Column) -> Column:
    """Whether the first 120 characters only suppose something."""
    return F.coalesce(any_of(F.lower(F.substring(F.trim(text), 1, 120)), SUPPOSITIONS), F.lit(False))


def enforced_severity(text: Column, kind: Column, severity: Column, round_: Column) -> Column:
    """Findings of a later round than 0 that praise, complain of tests tied to code, or miss zones are only informative."""
    low = any_of(text, PRAISE) | (kind == "anti-pattern") & any_of(text, TEST_COUPLING) | any_of(text, UNSEEN_ZONES)
    return F.when((round_ >= 1) & low, "info").otherwise(severity)


def rank_in(value: Column, order: tuple[str, ...], others: int = 99) -> Column:
    return reduce(lambda c, kv: c.when(value == kv[1], kv[0]), enumerate(order), F.when(F.lit(False), 0)).otherwise(others)


def ordered(findings: DataFrame) -> DataFrame:
    """Findings by round, type, scope and text."""
    return findings.orderBy("round", rank_in(F.col("type"), TYPE_ORDER), "scope", "text")


def known_by_text(findings: DataFrame, known: DataFrame, least: float = 0.65) -> DataFrame:
    """id of findings (id, type, scope, hash, text) that a known one (type, scope, hash, text) matches by hash, or by bigrams of the text within
    type and scope. Texts meet through bigrams rare enough that any pair above the threshold shares one; equal ones meet once."""
    by_hash = findings.join(known.select("hash").distinct(), "hash", "left_semi").select("id")
    place = ["type", "scope"]
    said = findings.select("id", *place, normalize(F.col("text")).alias("t"))
    a, b = cut(said.select(*place, "t").distinct()), cut(known.select(*place, normalize(F.col("text")).alias("t")).distinct())
    every = b.select(F.explode(grams(F.col("t"), 2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))

    def rare(rows):
        found = rows.select(*place, "t", F.explode(grams(F.col("t"), 2)).alias("gram")).join(every, "gram", "left").groupBy(*place, "t").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("x"))
        kept = F.size("x") - F.ceil(F.size("x") * (least / (2 - least)) - 1e-9).cast("int") + 1
        return found.select(*place, "t", F.explode(F.slice("x", F.lit(1), F.least(kept, F.size("x")))).alias("x")).select(*place, "t", F.col("x.gram").alias("gram"))

    pairs = rare(a).join(rare(b).withColumnRenamed("t", "k"), [*place, "gram"]).select(*place, "t", "k").distinct()
    alike = pairs.where(dice(grams(F.col("t"), 2), grams(F.col("k"), 2)) >= least).select(*place, "t").distinct()
    return by_hash.union(said.join(alike, [*place, "t"], "left_semi").select("id")).distinct()


#: Related files of one finding, and a zone's lack of cohesion plus its coupling, from which on it matters more.
MANY_RELATED, UNSOUND = 4, 1.2


def shortened(text: Column, most: int) -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 1), F.lit("…")))


def next_steps(findings: DataFrame, zones: DataFrame) -> DataFrame:
    """priority, category, scope, title, description, findings, impact: what to do, the most urgent first.

    One step for the critical findings of a scope (to fix), one for its warnings of anti-patterns (to refactor), one for
    its warnings of relations and patterns (to extract); suggestions and warnings of other types are a step each (to
    refactor). Critical ones are high, others high if a finding has ``MANY_RELATED`` files or an ``UNSOUND`` zone, else
    medium; suggestions that don't warn are low. Findings come in the order of ``id``; ``zones`` (zone, cohesion,
    coupling, files) gives the files that a description names.
    """
    kind, warns = F.col("type"), F.col("severity") == "warning"
    step = F.when(F.col("severity") == "critical", "fix").when(kind == "suggestion", "suggestion").when(warns & (kind == "anti-pattern"), "refactor").when(warns & kind.isin("relationship", "pattern"), "extract").when(warns, "other")
    penalty = 1 - F.col("cohesion") + F.col("coupling")
    related = F.greatest(F.coalesce(F.size("related"), F.lit(0)), F.lit(0))
    known = zones.select(F.col("zone").alias("scope"), penalty.alias("penalty"), F.slice("files", 1, 3).alias("shown"))
    rows = findings.withColumn("step", step).where("step is not null").join(known, "scope", "left").withColumns({"impact": related + F.coalesce("penalty", F.lit(0.0)), "wide": (related >= MANY_RELATED) | (F.coalesce("penalty", F.lit(0.0)) >= UNSOUND)})
    alone = F.when(F.col("step").isin("suggestion", "other"), F.col("id"))
    first = F.min(F.struct("id", "text", "shown")).alias("first")
    steps = rows.groupBy("step", "scope", alone.alias("alone")).agg(F.count("*").alias("findings"), F.sum("impact").alias("impact"), F.bool_or("wide").alias("wide"), F.bool_or(warns).alias("warns"), first)
    text = F.col("first.text")
    title = F.when(F.col("findings") == 1, shortened(text, 80)).otherwise(F.concat(shortened(text, 60), F.lit(" (+"), F.col("findings") - 1, F.lit(" related)")))
    files = F.when((F.col("step") != "suggestion") & (F.size("first.shown") > 0), F.concat(F.lit(" Files: "), F.array_join("first.shown", ", "))).otherwise("")
    priority = F.when(F.col("step") == "fix", "high").when((F.col("step") == "suggestion") & ~F.col("warns"), "low").when(F.col("wide"), "high").otherwise("medium")
    category = F.when(F.col("step").isin("fix", "extract"), F.col("step")).otherwise("refactor")
    out = steps.select(priority.alias("priority"), category.alias("category"), "scope", title.alias("title"), F.concat(text, files).alias("description"), "findings", "impact", rank_in(F.col("step"), ("fix", "refactor", "extract", "suggestion", "other")).alias("o"), F.col("first.id").alias("i"))
    return out.orderBy(rank_in(F.col("priority"), ("high", "medium", "low")), F.desc("impact"), F.desc("findings"), "o", "i").drop("o", "i")


def override_escalations(items: DataFrame, least: int = 3) -> DataFrame:
    """zone, overrides: zones with so many completed items that were settled by overriding a setting."""
    tags = F.filter("tags", lambda t: ~F.startswith(t, F.lit("finding:")) & (t != "structural-debt"))
    rows = items.where("status = 'completed' and resolution = 'config-override'").select(F.explode(tags).alias("zone"))
    return rows.groupBy("zone").agg(F.count("*").alias("overrides")).where(F.col("overrides") >= least).orderBy(F.desc("overrides"), "zone")


def override_summary(items: DataFrame) -> DataFrame:
    """One row: items, those that an override made, and the others; deleted ones count too."""
    return items.agg(F.count("*").alias("items"), F.count("override").alias("overridden"), (F.count("*") - F.count("override")).alias("others"))
