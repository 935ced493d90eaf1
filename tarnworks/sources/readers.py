"""Readers: logs, run records, manifests, inventories, work-item folders, history text, tracker exports.

Malformed records are skipped, not fatal; unknown fields survive in a map where a table is read for writing back.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnworks.functions.text import glob_pattern

LOG_SCHEMA = "timestamp string, event string, itemId string, detail string, _corrupt string"
TOKENS = "struct<input:bigint,output:bigint,cacheCreationInput:bigint,cacheReadInput:bigint>"
RUN_SCHEMA = (
    f"id string, taskId string, taskTitle string, startedAt string, finishedAt string, lastActivityAt string, status string, turns int, model string, vendor string, error string, retryAttempts int, tokenUsage {TOKENS}, "
    "turnTokenUsage array<struct<turn:int,input:bigint,output:bigint,cacheCreationInput:bigint,cacheReadInput:bigint,vendor:string,model:string>>, toolCalls array<struct<turn:int,tool:string,input:string,output:string,durationMs:bigint>>, _corrupt string"
)
#: Which log events carry usage, and the command each stands for.
LOG_COMMANDS = {"analyze_token_usage": "analyze", "smart_add_token_usage": "smart-add"}
#: Language of each file extension.
LANGUAGES = {"ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "go": "Go", "rs": "Rust", "java": "Java", "kt": "Kotlin", "swift": "Swift", "rb": "Ruby", "c": "C", "h": "C", "cpp": "C++", "cs": "C#", "scala": "Scala", "sh": "Shell", "css": "CSS", "html": "HTML", "json": "JSON", "yaml": "YAML", "yml": "YAML", "md": "Markdown", "sql": "SQL", "toml": "TOML"}


def log_entries(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and unparsable ones are left out."""
    rows = spark.read.schema(LOG_SCHEMA).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.where("_corrupt is null and event is not null").drop("_corrupt")


def run_records(spark: SparkSession, path: str, newest: int | None = None) -> DataFrame:
    """Run files, plain or gzipped, one a run: the plain one if both exist; by start, newest first."""
    rows = spark.read.schema(RUN_SCHEMA).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    rows = rows.where("_corrupt is null and id is not null").withColumn("file", F.col("_metadata.file_name")).drop("_corrupt")
    best = F.row_number().over(Window.partitionBy("id").orderBy(F.endswith("file", F.lit(".gz")), "file"))
    rows = rows.withColumn("rn", best).where("rn = 1").drop("rn", "file")
    if newest is not None:
        rows = rows.orderBy(F.desc("id")).limit(newest)
    return rows.orderBy(F.desc("startedAt"))


def events_of_runs(runs: DataFrame) -> DataFrame:
    """Usage events: one a turn, or one a run without turns, and one more with the run's cache counts if no turn has any."""
    turned = F.coalesce(F.size("turnTokenUsage") > 0, F.lit(False))
    named = lambda x: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("unknown"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    columns = ("ts", "command", "package", "input", "output", "cache_creation", "cache_read", "calls", "vendor", "model")
    turn = runs.where(turned).select("*", F.explode("turnTokenUsage").alias("t"))
    per_turn = turn.select(F.col("startedAt"), F.lit("run"), F.lit("runs"), zero(F.col("t.input")), zero(F.col("t.output")), zero(F.col("t.cacheCreationInput")), zero(F.col("t.cacheReadInput")), F.lit(1).cast("long"), named(F.coalesce("t.vendor", "vendor")), named(F.coalesce("t.model", "model"))).toDF(*columns)
    usage = F.col("tokenUsage")
    per_run = runs.where(~turned & usage.isNotNull()).select(F.col("startedAt"), F.lit("run"), F.lit("runs"), zero(usage["input"]), zero(usage["output"]), zero(usage["cacheCreationInput"]), zero(usage["cacheReadInput"]), F.lit(1).cast("long"), named(F.col("vendor")), named(F.col("model"))).toDF(*columns)
    uncached = turned & ~F.exists("turnTokenUsage", lambda t: t["cacheCreationInput"].isNotNull() | t["cacheReadInput"].isNotNull())
    cached = (zero(usage["cacheCreationInput"]) + zero(usage["cacheReadInput"])) > 0
    none = F.lit(0).cast("long")
    rest = runs.where(uncached & cached).select(F.col("startedAt"), F.lit("run"), F.lit("runs"), none, none, zero(usage["cacheCreationInput"]), zero(usage["cacheReadInput"]), none, named(F.col("vendor")), named(F.col("model"))).toDF(*columns)
    return per_turn.unionByName(per_run).unionByName(rest)


def events_of_log(entries: DataFrame) -> DataFrame:
    """Usage events of a log, their counts from the detail's JSON."""
    command = F.element_at(F.create_map(*(F.lit(x) for kv in LOG_COMMANDS.items() for x in kv)), F.col("event"))
    detail = F.from_json("detail", "calls bigint, inputTokens bigint, outputTokens bigint, vendor string, model string")
    rows = entries.where(F.col("event").isin(*LOG_COMMANDS)).withColumn("d", detail).where("d is not null and d.inputTokens is not null")
    named = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit("unknown"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    return rows.select(F.col("timestamp").alias("ts"), command.alias("command"), F.lit("log").alias("package"), zero("d.inputTokens").alias("input"), zero("d.outputTokens").alias("output"), F.lit(0).cast("long").alias("cache_creation"), F.lit(0).cast("long").alias("cache_read"), zero("d.calls").alias("calls"), named("d.vendor").alias("vendor"), named("d.model").alias("model"))


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether a path is ignored by the lines of an ignore file, the last that fits deciding.

    A line is a path pattern; one with a slash before its end is tied to the top, others fit at any depth; a slash at
    the end means folders, and all below a folder that fits is ignored; ! brings back; # starts a comment.
    """
    out = F.lit(False)
    for line in rules:
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        back, rule = rule.startswith("!"), rule.removeprefix("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        lead = "^" if "/" in rule else "(^|/)"
        pattern = lead + glob_pattern(rule.lstrip("/"))[1:-1] + ("/" if folder else "(/|$)")
        out = F.when(path.rlike(pattern), not back).otherwise(out)
    return out


def inventory(spark: SparkSession, path: str, ignore: tuple[str, ...] = ("node_modules", ".git", "dist"), rules: list[str] | None = None, before: DataFrame | None = None) -> DataFrame:
    """path, size, modified, hash, lines, language of every file below a folder; binary and empty files have no lines.

    ``rules``: lines of an ignore file, for paths from the folder on. With ``before``, an earlier inventory, files of
    the same size and time keep its row, and their content isn't read again. The reader leaves out files of no bytes, so
    these come from its listing.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    rows = reader.load(path)
    listed = spark.createDataFrame([(re.sub("^file:/+", "file:/", unquote(f)),) for f in rows.inputFiles()] or [("",)], "path string")
    there = rows.select("path", "length", "modificationTime")
    empty = listed.where("path != ''").join(there.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(b"").alias("content"))
    top = F.regexp_replace("path", "^.*?" + re.escape(path.rstrip("/").split("://")[-1]) + "/", "")
    skip = F.col("path").rlike("/(" + "|".join(map(re.escape, ignore)) + ")/") | ignored(top, rules or [])
    known = None
    if before is not None:
        same = before.select("path", F.col("size").alias("length"), F.col("modified").alias("modificationTime"))
        known = before.join(there, "path").where("size = length and modified = modificationTime").select(before.columns)
        rows = rows.join(there.join(same, ["path", "length", "modificationTime"], "left_anti").select("path"), "path", "left_semi")
    kept = rows.unionByName(empty).where(~skip)
    text = F.decode("content", "ISO-8859-1")
    binary = F.instr(F.substring(text, 1, 8192), "\0") > 0
    newlines = F.length(text) - F.length(F.translate(text, "\n", ""))
    lines = F.when(binary | (F.length("content") == 0), 0).otherwise(newlines + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1))
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    language = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), extension), F.lit("Other"))
    out = kept.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("hash"), lines.cast("long").alias("lines"), language.alias("language"))
    return out if known is None else out.unionByName(known.select(out.columns))


def manifest_event(manifests: DataFrame, now: str) -> DataFrame:
    """Usage events of manifests (a column ``text`` of JSON), one of each that has usage; ``now`` where it has no time."""
    m = F.from_json("text", "generatedAt string, tokenUsage struct<calls:bigint,inputTokens:bigint,outputTokens:bigint>")
    rows = manifests.select(m.alias("m")).where("m.tokenUsage is not null")
    zero = lambda c: F.coalesce(F.col(f"m.tokenUsage.{c}"), F.lit(0).cast("long"))
    return rows.select(F.coalesce("m.generatedAt", F.lit(now)).alias("ts"), F.lit("analyze").alias("command"), F.lit("manifest").alias("package"), zero("inputTokens").alias("input"), zero("outputTokens").alias("output"), zero("calls").alias("calls"))


def scan_results(**scans: DataFrame) -> DataFrame:
    """source, name, kind, file, detail: what several scanners found, in one table."""
    text = lambda t, c: (F.col(c) if c in t.columns else F.lit(None)).cast("string").alias(c)
    return reduce(DataFrame.unionByName, (t.select(F.lit(name).alias("source"), *(text(t, c) for c in ("name", "kind", "file", "detail"))) for name, t in scans.items()))


def merge_commits(log: DataFrame, record: str = "\x1e", field: str = "\x1f") -> DataFrame:
    """Commits of delimited history text (a column ``text``): records of six fields; shorter ones are skipped."""
    parts = F.transform(F.split("text", record), lambda r: F.split(F.regexp_replace(r, r"^\s+|\s+$", ""), field))
    rows = log.select(F.posexplode(parts).alias("n", "f")).where(F.size("f") >= 6)
    return rows.select("n", *(F.col("f")[k].alias(c) for k, c in enumerate(("sha", "parents", "merged_at", "author", "subject", "body")))).withColumn("parents", F.split("parents", " "))


def changed_files(lines: DataFrame, marker: str = "commit ") -> DataFrame:
    """sha, status, path, old_path from numbered lines (n, line): a marker line opens a commit; renames have two paths."""
    sha = F.when(F.startswith("line", F.lit(marker)), F.substring("line", len(marker) + 1, 100))
    filled = lines.withColumn("sha", F.last(sha, ignorenulls=True).over(Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    f = F.split("line", "\t")
    moved = F.substring(f[0], 1, 1).isin("R", "C")
    rows = filled.where(~F.startswith("line", F.lit(marker)) & (F.size(f) >= 2) & F.col("sha").isNotNull())
    return rows.select("sha", F.substring(f[0], 1, 1).alias("status"), F.when(moved, F.get(f, F.lit(2))).otherwise(f[1]).alias("path"), F.when(moved, f[1]).alias("old_path"))


def line_totals(lines: DataFrame) -> DataFrame:
    """One row: added and removed lines over TAB-separated counts; binary files have none."""
    f = F.split("line", "\t")
    return lines.agg(F.coalesce(F.sum(f[0].try_cast("long")), F.lit(0)).alias("added"), F.coalesce(F.sum(F.get(f, F.lit(1)).try_cast("long")), F.lit(0)).alias("removed"))


def module_requirements(text: DataFrame) -> DataFrame:
    """path, version of each requirement in module files (a column ``text``), in blocks or on lines of their own."""
    found = F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:require\s+)?([\w.\-]+\.[\w.\-/]+\s+v[\w.\-+]+)"), F.lit(1))
    return text.select(F.explode(found).alias("r")).select(F.split("r", r"\s+")[0].alias("path"), F.split("r", r"\s+")[1].alias("version"))


def front_matter(text: str) -> tuple[dict, str] | None:
    """Keys and values between the opening fences, and what follows; None if there is none or it is malformed."""
    m = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?(.*)", text, re.DOTALL)
    if not m:
        return None
    out: dict = {}
    key = None
    for line in m[1].splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if item := re.match(r"\s*-\s+(.*)", line):
            if key is None or not isinstance(out.setdefault(key, []), list):
                return None
            out[key].append(item[1].strip().strip("\"'"))
        elif pair := re.match(r"([A-Za-z_][\w-]*):\s*(.*)", line):
            key, value = pair[1], pair[2].strip()
            if value.startswith("[") and value.endswith("]"):
                out[key] = [v.strip().strip("\"'") for v in value[1:-1].split(",") if v.strip()]
            elif value in ("", "|", ">"):
                out[key] = []
            else:
                out[key] = value.strip("\"'")
        else:
            return None
    return out, m[2]


ITEM_SCHEMA = "id string, parent_path string, path string, level string, status string, priority string, title string, description string, tags array<string>, blocked_by array<string>, acceptance array<string>, extra map<string,string>, warning string"
KNOWN = {"id", "level", "status", "priority", "title", "description", "tags", "blockedBy", "acceptanceCriteria"}


def folder_tree(spark: SparkSession, path: str) -> DataFrame:
    """Work items of a folder tree of Markdown files with front matter; malformed files give a warning row.

    An item's parent is the nearest folder above that holds one; ``with_parents`` resolves it.
    """
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path")).where("path like '%.md'")

    def parse(batches):
        for batch in batches:
            rows = []
            for text, file in zip(batch["value"], batch["path"]):
                folder = file.rsplit("/", 1)[0]
                got = front_matter(text)
                if got is None or "id" not in got[0]:
                    rows.append((None, folder.rsplit("/", 1)[0], folder, *[None] * 5, [], [], [], {}, f"no usable front matter in {file}"))
                    continue
                f, body = got
                lists = [f.get(k) if isinstance(f.get(k), list) else [f[k]] if f.get(k) else [] for k in ("tags", "blockedBy", "acceptanceCriteria")]
                extra = {k: json.dumps(v) for k, v in f.items() if k not in KNOWN}
                title = f.get("title") or next((line.lstrip("# ").strip() for line in body.splitlines() if line.startswith("#")), None)
                rows.append((f["id"], folder.rsplit("/", 1)[0], folder, f.get("level"), f.get("status"), f.get("priority"), title, f.get("description") or None, *lists, extra, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ITEM_SCHEMA.split(", ") if c.split()[0] in ("id", "parent_path", "path", "level", "status", "priority", "title", "description", "tags", "blocked_by", "acceptance", "extra", "warning")])

    return files.mapInPandas(parse, ITEM_SCHEMA)


def with_parents(items: DataFrame) -> DataFrame:
    """``folder_tree`` rows with parent_id, from the item in the folder above."""
    above = items.where("id is not null").select(F.col("path").alias("parent_path"), F.col("id").alias("parent_id"))
    return items.join(above, "parent_path", "left")


def tracker_items(rows: DataFrame, key: str, parent: str, kind: str, levels: dict[str, str], status: str, statuses: dict[str, str], title: str) -> DataFrame:
    """Flat rows of an issue tracker as work items; kinds and states map to levels and statuses, others to task and pending.

    A parent that isn't among the rows makes a root.
    """
    mapped = lambda c, m, default: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in m.items() for x in kv)), F.lower(F.col(c))), F.lit(default))
    held = rows.select(F.col(key).alias("_p")).distinct()
    out = rows.join(held, F.col(parent) == F.col("_p"), "left")
    return out.select(F.col(key).cast("string").alias("id"), F.col("_p").cast("string").alias("parent_id"), mapped(kind, levels, "task").alias("level"), mapped(status, statuses, "pending").alias("status"), F.col(title).alias("title"))


def dated_documents(files: DataFrame) -> DataFrame:
    """path, branch, date of document files named prd_{branch}_{date}.json, oldest first; undated ones before all."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    dated = r"^prd_(.+)_(\d{4}-\d{2}-\d{2})\.json$"
    rows = files.where(name.rlike(r"^prd(_.+)?\.json$"))
    return rows.select("path", F.nullif(F.regexp_extract(name, dated, 1), F.lit("")).alias("branch"), F.nullif(F.regexp_extract(name, dated, 2), F.lit("")).alias("date")).orderBy(F.asc_nulls_first("date"), "path")
