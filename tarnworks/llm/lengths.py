"""Exact histogram of encoded lengths.

Every task encodes its documents and sends on a count for each length it met; the counts are summed once and
written, so texts are encoded once however often the histogram is read. From the histogram, suffix sums answer totals,
quantiles and what is left after truncation, for any context limit.

A null or empty text has length 0; repeated rows count each; texts of any length are encoded whole; an empty table
gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnworks.llm.common import Work
from tarnworks.llm.tokens import encoder

#: Lengths are summed within blocks of this many, then over blocks, so no task sorts all of them.
BLOCK = 4096


def length_histogram(docs: DataFrame, vocabulary: str) -> DataFrame:
    """length, n_docs."""

    def run(batches):
        counts: Counter = Counter()
        encode = encoder(vocabulary).encode
        for batch in batches:
            counts.update(len(encode(t)) // 4 for t in batch["text"])
        if counts:
            yield pd.DataFrame({"length": list(counts), "n_docs": list(counts.values())})

    parts = docs.select("text").mapInPandas(run, "length long, n_docs long")
    return Work(docs.sparkSession, "lengths").cut(parts.groupBy("length").agg(F.sum("n_docs").alias("n_docs")), "histogram")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L: documents and tokens in longer documents, the total and the truncated total at L, and the
    share of documents of at most L (the quantile that L answers)."""
    rows = histogram.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("block_docs"), F.sum("tokens").alias("block_tokens"))
    later, every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    blocks = blocks.select(
        "block",
        *(F.coalesce(F.sum(f"block_{c}").over(later), F.lit(0)).alias(f"later_{c}") for c in ("docs", "tokens")),
        *(F.sum(f"block_{c}").over(every).alias(f"all_{c}") for c in ("docs", "tokens")),
    )
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(blocks, "block")
    rows = rows.withColumns({f"longer_{c}": F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"later_{c}") for c, v in (("docs", "n_docs"), ("tokens", "tokens"))})
    return rows.select(
        F.col("length").alias("n_tokens"),
        "n_docs",
        "longer_docs",
        "longer_tokens",
        F.col("all_docs").alias("total_docs"),
        F.col("all_tokens").alias("total_tokens"),
        (F.col("all_tokens") - F.col("longer_tokens") + F.col("length") * F.col("longer_docs")).alias("truncated_tokens"),
        (1 - F.col("longer_docs") / F.col("all_docs")).alias("quantile"),
    )
