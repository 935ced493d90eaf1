"""Column expressions for names, keywords, n-grams, paths and fingerprints."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that keywords leave out.
STOP_WORDS = (
    "a", "an", "the", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "shall",
    "should", "may", "might", "must", "can", "could",
    "and", "but", "or", "nor", "not", "no", "so", "if", "then",
    "for", "in", "on", "at", "to", "of", "by", "with", "from",
    "up", "out", "off", "over", "under", "into", "through",
    "that", "this", "it", "its",
    "test", "tests", "when", "each", "all", "any",
)


def normalize(x: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(x)), r"\s+", " ")


def grams(x: Column, n: int) -> Column:
    """Distinct runs of ``n`` characters; none in shorter texts."""
    return F.when(F.length(x) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """2 |a ∩ b| / (|a| + |b|); 0 if both are empty."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def keywords(x: Column) -> Column:
    """Distinct words of more than two characters that aren't stop words; hyphens and underscores stay."""
    cleaned = F.split(F.regexp_replace(F.lower(x), r"[^a-z0-9\-_\s]", " "), r"\s+")
    return F.array_distinct(F.filter(cleaned, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def matched_keywords(words: Column, text: Column) -> Column:
    """How many of the words a text contains, with slashes, dots and hyphens as spaces."""
    plain = F.translate(F.lower(text), "/\\.-", "    ")
    return F.size(F.filter(words, lambda w: F.contains(plain, w)))


def facet_value(tags: Column, key: str) -> Column:
    """What follows ``key:`` in the first tag that starts so."""
    found = F.filter(tags, lambda t: F.startswith(t, F.lit(f"{key}:")))
    return F.substring(F.get(found, F.lit(0)), len(key) + 2, 1 << 30)


def is_facet(tag: Column) -> Column:
    return tag.rlike(r"^[^:]+:[^:]+$")


def finding_hash(*parts: Column) -> Column:
    """Twelve hex digits; numbers don't count."""
    joined = F.concat_ws("|", *parts)
    return F.substring(F.sha2(F.lower(F.regexp_replace(joined, r"\d+", "N")), 256), 1, 12)


def group_hash(members: Column) -> Column:
    """Aggregate: sixteen hex digits of the sorted members."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(members)), "\n"), 256), 1, 16)


def branch_kind(name: Column) -> Column:
    low = F.lower(name)
    return (
        F.when(low.isin("main", "master", "develop", "trunk"), "main")
        .when(low.rlike(r"^(feature|feat)[/-]"), "feature")
        .when(low.rlike(r"^hotfix[/-]"), "hotfix")
        .when(low.rlike(r"^(bugfix|fix|bug)[/-]"), "bugfix")
        .when(low.rlike(r"^(release|rel)[/-]"), "release")
        .otherwise("other")
    )


def file_role(path: Column) -> Column:
    """test, generated, config, docs, asset, build, source or other, the first that fits."""
    low = F.lower(path)
    return (
        F.when(low.rlike(r"(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]*\.py$|_test\.go$"), "test")
        .when(low.rlike(r"(^|/)(dist|generated|__generated__)/|\.(min\.js|d\.ts|map|lock)$"), "generated")
        .when(low.rlike(r"\.(json|ya?ml|toml|ini|env)$|(^|/)\.[^/]+rc(\.[a-z]+)?$|\.config\.[a-z]+$"), "config")
        .when(low.rlike(r"\.(md|mdx|rst|txt)$|(^|/)docs?/"), "docs")
        .when(low.rlike(r"\.(png|jpe?g|gif|svg|ico|woff2?|ttf|css|scss)$"), "asset")
        .when(low.rlike(r"(^|/)(makefile|dockerfile|gulpfile[^/]*|webpack[^/]*)$"), "build")
        .when(low.rlike(r"\.(tsx?|jsx?|mjs|cjs|py|go|rs|java|kt|swift|rb|c|cc|cpp|h|scala)$"), "source")
        .otherwise("other")
    )


def first_directory(path: Column, skip: tuple[str, ...] = ("src", "lib", "app", "packages")) -> Column:
    """First path segment that isn't generic; root if there is none."""
    segments = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    return F.coalesce(F.get(F.filter(segments, lambda s: ~s.isin(*skip) & (s != "")), F.lit(0)), F.lit("root"))


def package_name(specifier: Column) -> Column:
    """Package of an import, with its scope if it has one."""
    return F.regexp_extract(specifier, r"^(@[^/]+/[^/]+|[^/]+)", 1)


def without_date_suffix(model: Column) -> Column:
    """A model's name without a date at its end."""
    return F.regexp_replace(F.regexp_replace(model, r"-\d{8}$", ""), r"-\d{4}-\d{2}-\d{2}$", "")


def comparable(code: Column) -> Column:
    """Code without comments, white space and kinds of quotes."""
    bare = F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    return F.regexp_replace(F.regexp_replace(bare, r"[`\"]", "'"), r"\s+", "")


def file_paths(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"((?:[\w.-]+/)+[\w.-]+\.[A-Za-z]{1,5})"), F.lit(1))


@F.pandas_udf(StringType())
def slug(titles: pd.Series) -> pd.Series:
    """ASCII words joined by hyphens, at most 40 characters, cut between words."""

    def one(title):
        if title is None:
            return None
        plain = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode().lower()
        words = "".join(c if c.isalnum() else " " for c in plain).split()
        out = ""
        for w in words:
            if out and len(out) + 1 + len(w) > 40:
                break
            out = f"{out}-{w}" if out else w[:40]
        return out

    return titles.map(one)


def is_capitals_header(line: Column) -> Column:
    """A short line of capitals, without end punctuation."""
    return line.rlike(r"^[A-Z][A-Z0-9 &/\-]{2,59}$")


def is_colon_header(line: Column) -> Column:
    return line.rlike(r"^[A-Z][^:.!?]{1,58}:$")


def is_separator(line: Column) -> Column:
    return line.rlike(r"^\s*([-=*_])\1{2,}\s*$")


def priority_tag(line: Column) -> Column:
    """Priority named in brackets or after a P: [high], (critical), P0 to P3."""
    named = F.lower(F.regexp_extract(line, r"(?i)[\[(](critical|high|medium|low)[\])]", 1))
    level = F.regexp_extract(line, r"\bP([0-3])\b", 1)
    return F.when(named != "", named).when(level != "", F.element_at(F.array(*map(F.lit, ("critical", "high", "medium", "low"))), level.try_cast("int") + 1))


def co_authors(message: Column) -> Column:
    return F.regexp_extract_all(message, F.lit(r"(?im)^co-authored-by:\s*([^<\n]+?)\s*(?:<|$)"), F.lit(1))


def requirement_sentences(x: Column) -> Column:
    """Sentences that say what must, shall or should be."""
    return F.filter(F.split(x, r"(?<=[.!?])\s+"), lambda s: s.rlike(r"(?i)\b(must|shall|should|required to|needs to)\b"))


def glob_pattern(glob: str) -> str:
    """Regular expression of a path pattern: ** any depth, * within a segment, ? one character."""
    parts = re.split(r"(\*\*/?|\*|\?)", glob)
    shown = {"**": ".*", "**/": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(shown[p] if p in shown else re.escape(p) for p in parts) + "$"


def item_slug(title: Column, item: Column) -> Column:
    """Lower-case words of ASCII letters, digits and underscores joined by hyphens, at most 40 characters; else the start of the identifier."""
    words = F.regexp_replace(F.regexp_replace(F.lower(F.trim(title)), r"[^A-Za-z0-9_\s-]", ""), r"[\s-]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(words, r"^-+|-+$", ""), 1, 40), r"-+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.substring(item, 1, 8))


def source_branch(subject: Column) -> Column:
    """The branch that a merge's subject names, without the owner of a pull request or the name of a remote."""
    pull = F.regexp_extract(subject, r"^Merge pull request #\d+ from (?:[^\s/]*/)?(\S+)", 1)
    remote = F.regexp_extract(subject, r"^Merge remote-tracking branch '(?:[^'/]*/)?([^']+)'", 1)
    plain = F.regexp_extract(subject, r"^Merge branch '([^']+)'", 1)
    return F.coalesce(*(F.nullif(x, F.lit("")) for x in (pull, remote, plain)))


def identifier_counts(code: Column) -> Column:
    """Map from each identifier of a text to how often it occurs."""
    found = F.array_sort(F.regexp_extract_all(code, F.lit(r"([A-Za-z_$][A-Za-z0-9_$]*)"), F.lit(1)))
    names = F.array_distinct(found)
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.size(F.filter(found, lambda x: x == n)).cast("long"))))


def import_weight(symbols: Column, counts: Column, most: int = 10) -> Column:
    """Uses of imported names beyond the import itself, 1 at least and ``most`` at most; 1 if none is counted."""
    named = F.filter(symbols, lambda s: ~s.isin("*", "default") & F.map_contains_key(counts, s))
    total = F.aggregate(named, F.lit(0).cast("long"), lambda a, s: a + F.greatest(F.lit(0).cast("long"), F.element_at(counts, s) - 1))
    return F.least(F.lit(most).cast("long"), F.greatest(F.lit(1).cast("long"), total))


def counted_map(values: Column) -> Column:
    """Map from each value of an array to how often it occurs, in the values' order."""
    names = F.array_sort(F.array_distinct(values))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n, F.size(F.filter(values, lambda x: x == n)).cast("long"))))
