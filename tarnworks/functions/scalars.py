"""Column expressions for numbers, dates, money and states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: US dollars per million tokens.
INPUT_USD, OUTPUT_USD = 3.0, 15.0
#: Rank of each priority, and rank of a missing one.
PRIORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}
#: Which status may follow which.
TRANSITIONS = {
    "pending": ("in_progress", "deferred", "blocked", "completed", "deleted"),
    "in_progress": ("completed", "failing", "blocked", "deferred", "pending", "deleted"),
    "completed": ("failing", "deleted"),
    "failing": ("in_progress", "pending", "deferred", "deleted"),
    "deferred": ("pending", "in_progress", "blocked", "deleted"),
    "blocked": ("pending", "in_progress", "deferred", "deleted"),
    "deleted": (),
}
#: Least cohesion and most coupling of a healthy zone, by the zone's type and by default, and the margin beyond both to the worst level.
ZONE_LIMITS = {
    "domain": (0.4, 0.6),
    "integration": (0.2, 0.8),
    "test": (0.1, 0.9),
    "infrastructure": (0.0, 1.0),
    "gateway": (0.1, 0.9),
    "orchestration": (0.2, 0.8),
}
COHESION_FLOOR, COUPLING_CEILING, WORST_COHESION, WORST_COUPLING = 0.4, 0.6, 0.3, 0.7


def half_up(x: Column, places: int = 0) -> Column:
    """Rounded toward plus infinity at a half, on the double product."""
    return F.floor(x * float(10**places) + 0.5) / float(10**places) if places else F.floor(x + 0.5)


def blank_to_null(x: Column) -> Column:
    return F.nullif(F.trim(x), F.lit(""))


def in_range(ts: Column, since: str | None, until: str | None) -> Column:
    """Inclusive on ISO strings; a missing bound doesn't bound."""
    keep = F.lit(True)
    if since:
        keep = keep & (ts >= since)
    return keep & (ts <= until) if until else keep


def period_key(ts: Column, period: str) -> Column:
    """Day, ISO week or month of a timestamp, in UTC."""
    if period == "day":
        return F.date_format(ts, "yyyy-MM-dd")
    if period == "month":
        return F.date_format(ts, "yyyy-MM")
    if period != "week":
        raise ValueError(period)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def cost(input_tokens: Column, output_tokens: Column) -> Column:
    return input_tokens / 1e6 * INPUT_USD + output_tokens / 1e6 * OUTPUT_USD


def budget_severity(used: Column, budget: Column, warn_at: float = 80.0) -> Column:
    """ok, warning or exceeded; a budget of zero or less, or none, is unlimited."""
    percent = used * 100.0 / budget
    return F.when(budget.isNull() | (budget <= 0), "ok").when(percent >= 100, "exceeded").when(percent >= warn_at, "warning").otherwise("ok")


def weekly_budget(by_model: Column, by_vendor: Column, overall: Column) -> tuple[Column, Column]:
    """The first budget that is set, and where it comes from."""
    reason = F.when(by_model.isNotNull(), "model").when(by_vendor.isNotNull(), "vendor").when(overall.isNotNull(), "global").otherwise("none")
    return F.coalesce(by_model, by_vendor, overall), reason


def priority_rank(priority: Column, missing: int = 2) -> Column:
    ranks = reduce(lambda c, kv: c.when(priority == kv[0], kv[1]), list(PRIORITY_RANK.items())[1:], F.when(priority == "critical", 0))
    return ranks.otherwise(missing)


def may_follow(before: Column, after: Column) -> Column:
    """Whether a status may follow another; itself always may."""
    allowed = before == after
    for name, nexts in TRANSITIONS.items():
        allowed = allowed | ((before == name) & after.isin(*nexts))
    return allowed


def risk_score(cohesion: Column, coupling: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((1 - cohesion) + coupling) / 2))


def risk_level(cohesion: Column, coupling: Column, zone_type: Column | None = None) -> Column:
    """healthy, at-risk (one limit passed), critical (both) or catastrophic (both by far)."""

    def by_type(k, default):
        if zone_type is None:
            return F.lit(default)
        return reduce(lambda c, kv: c.when(zone_type == kv[0], kv[1][k]), list(ZONE_LIMITS.items())[1:], F.when(zone_type == "domain", ZONE_LIMITS["domain"][k])).otherwise(default)

    floor, ceiling = by_type(0, COHESION_FLOOR), by_type(1, COUPLING_CEILING)
    worst_cohesion, worst_coupling = F.lit(WORST_COHESION), F.lit(WORST_COUPLING)
    if zone_type is not None:
        typed = zone_type.isin(*ZONE_LIMITS)
        worst_cohesion = F.when(typed, F.greatest(F.lit(0.0), floor - (COHESION_FLOOR - WORST_COHESION))).otherwise(worst_cohesion)
        worst_coupling = F.when(typed, F.least(F.lit(1.0), ceiling + (WORST_COUPLING - COUPLING_CEILING))).otherwise(worst_coupling)
    low, high = cohesion < floor, coupling > ceiling
    return F.when(low & high & (cohesion < worst_cohesion) & (coupling > worst_coupling), "catastrophic").when(low & high, "critical").when(low | high, "at-risk").otherwise("healthy")


def heartbeat_status(seconds: Column) -> Column:
    return F.when(seconds >= 120, "unresponsive").when(seconds >= 60, "warning").otherwise("healthy")


def memory_decision(percent: Column) -> Column:
    return F.when(percent >= 95, "reject").when(percent >= 80, "delay").otherwise("allow")


def backoff_ms(attempt: Column, base: int = 2000, most: int = 30_000) -> Column:
    return F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), attempt)).cast("long")


def nearest_rank(values: Column, share: float) -> Column:
    """Sorted values at floor(n * share), counted from 0."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.least(F.size(ordered), F.floor(F.size(ordered) * share).cast("int") + 1))


def variation(values: Column) -> Column:
    """Coefficient of variation over the population, as an aggregate; null under two values or for a mean of 0."""
    return F.when((F.count(values) >= 2) & (F.avg(values) != 0), F.stddev_pop(values) / F.avg(values))


def interval_ms(start: Column, end: Column) -> Column:
    """Milliseconds of an interval; a backward one counts nothing."""
    span = F.unix_millis(end) - F.unix_millis(start)
    return F.when(span > 0, span).otherwise(F.lit(0)).cast("long")


def total_interval_ms(intervals: Column, now: Column) -> Column:
    """Sum over an array of (start, end); an open interval runs to ``now``."""
    return F.aggregate(intervals, F.lit(0).cast("long"), lambda a, i: a + F.coalesce(interval_ms(i["start"], F.coalesce(i["end"], now)), F.lit(0).cast("long")))


def elapsed_ms(status: Column, intervals: Column, started: Column, ended: Column, completed: Column, now: Column) -> Column:
    """Milliseconds of work on an item: those of its intervals, or from start to end where it has none.

    Without intervals, an item in progress runs to ``now``; the end is ``ended``, else ``completed``. An item without a
    start, or with an end before it, took none.
    """
    end = F.when(status == "in_progress", now).otherwise(F.coalesce(ended, completed))
    whole = F.coalesce(interval_ms(started, end), F.lit(0).cast("long"))
    return F.when(F.size(intervals) > 0, total_interval_ms(intervals, now)).otherwise(whole)


def metric_value(text: Column) -> Column:
    """The whole text as a number, else the last number in it."""
    found = F.regexp_extract_all(text, F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1))
    return F.coalesce(F.try_cast(F.trim(text), "double") if hasattr(F, "try_cast") else F.trim(text).try_cast("double"), F.get(found, F.size(found) - 1).try_cast("double"))
