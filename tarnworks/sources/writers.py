"""Writers: canonical JSON, gzipped archives, Markdown, one folder a group, capped histories."""

from __future__ import annotations

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def canonical_json(rows: DataFrame, path: str, *order: str) -> None:
    """JSON lines in a total order, fields by name."""
    rows.select(*sorted(rows.columns)).orderBy(*order).write.mode("overwrite").json(path)


def archive(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("compression", "gzip").json(path)


def by_group(rows: DataFrame, path: str, group: str) -> None:
    """One folder for each group; only folders of groups in ``rows`` are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).json(path)


def capped(history: DataFrame, batch: DataFrame, order: str, most: int) -> DataFrame:
    """History and a new batch, the newest ``most`` of both."""
    return history.unionByName(batch).orderBy(F.desc(order)).limit(most)


def markdown(items: DataFrame) -> DataFrame:
    """id, text: each work item as Markdown with front matter that ``folder_tree`` reads back."""
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\n"))).otherwise("")
    many = lambda name, value: F.when(F.size(value) > 0, F.concat(F.lit(f"{name}:\n"), F.array_join(F.transform(value, lambda v: F.concat(F.lit("  - "), v)), "\n"), F.lit("\n"))).otherwise("")
    fields = [line(c, F.col(c)) for c in ("id", "level", "status", "priority", "title", "description")]
    lists = [many("tags", F.col("tags")), many("blockedBy", F.col("blocked_by")), many("acceptanceCriteria", F.col("acceptance"))]
    return items.select("id", F.concat(F.lit("---\n"), *fields, *lists, F.lit("---\n# "), F.coalesce("title", F.lit("")), F.lit("\n")).alias("text"))


def numbered_duplicates(rows: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """Names made unique within their group: the first stays, later ones get -2, -3 and so on."""
    rn = F.row_number().over(Window.partitionBy(group, name).orderBy(order))
    return rows.withColumn("rn", rn).withColumn(name, F.when(F.col("rn") == 1, F.col(name)).otherwise(F.concat_ws("-", name, "rn"))).drop("rn")


def text_files(rows: DataFrame, root: str) -> int:
    """Write each row (path, text) as a file of its own below ``root``, which all tasks see; returns how many.

    A file is written under another name and renamed, so that a repeated task leaves a whole one.
    """

    def save(batches):
        fs, base = pafs.FileSystem.from_uri(root)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                folder, _, name = f"{base}/{path}".rpartition("/")
                fs.create_dir(folder, recursive=True)
                with fs.open_output_stream(f"{folder}/.{name}.part") as sink:
                    sink.write(text.encode())
                fs.move(f"{folder}/.{name}.part", f"{folder}/{name}")
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select("path", "text").mapInPandas(save, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
