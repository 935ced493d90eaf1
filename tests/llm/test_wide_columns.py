"""Identifiers above 2 ** 53 beside nulls, and columns that pandas can't hold, stay what they are; hostile markup takes linear time."""

import random
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnworks.llm import cnn, decontaminate, entries, htmltext, minhash, pii, sstable
from tarnworks.llm.common import Work
from tarnworks.llm.tokens import vocabulary_path

from .docs import PROSE

WIDE = 9007199254740993
IDS = (WIDE, None, WIDE + 2, WIDE + 4, -WIDE)


@pytest.fixture(scope="module")
def wide(spark):
    rows = [(i, f"{PROSE * 3} mail a{k}@b.org {' '.join(f'w{k}x{j}' for j in range(60))}") for k, i in enumerate(IDS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "length(text) + 0L n_chars")
    extra = {"wide": F.coalesce("doc_id", F.lit(None)).cast("long"), "exact": F.lit(Decimal("12345678901234567890.123456789")).cast("decimal(38,9)"), "early": F.expr("timestamp'0001-01-02'"), "day": F.expr("date'0001-01-01'"), "m": F.create_map(F.lit("k"), F.col("doc_id")), "a": F.array(F.struct(F.col("doc_id").alias("x"))), "b": F.lit(b"\0\xff"), "score": F.lit(None).cast("long"), "h": F.lit(None).cast("int")}
    return docs.withColumns(extra).coalesce(1)


def ids(df, column="doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=str)


def test_identifiers_stay(spark, wide):
    expected = sorted(IDS, key=str)
    assert ids(pii.pii_digest(wide)) == expected and ids(pii.find_pii(wide)) == expected
    assert ids(minhash.near_duplicates(wide)) == expected
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    assert ids(cnn.quality_classifier(wide, labels)) == expected
    benchmark = spark.createDataFrame([(WIDE, PROSE)], "item_id long, text string")
    leaks = decontaminate.find_leaks(wide, benchmark)
    assert ids(leaks) == expected and {r.item_id for r in leaks.collect()} == {WIDE}
    work = Work(spark, "wide")
    manifest = sstable.write_shards(wide, work, vocabulary_path())
    assert ids(sstable.read_shards(manifest)) == expected
    (path,) = sstable.shards_of(manifest, WIDE + 2)
    assert len(sstable.ShardReader(path).get(WIDE + 2)) == 1 and not sstable.ShardReader(path).get(WIDE + 1)
    pages = wide.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<article><p>"), "text", F.lit("</p></article>")).alias("html"))
    assert ids(htmltext.extract_text(pages), "page_id") == expected


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_leave_other_columns_alone(spark, wide, name, monkeypatch):
    if name == "quality_classifier":
        monkeypatch.setattr(cnn, "fit", lambda texts, labels: 0.9)
    own = {r.doc_id: r for r in wide.collect()}
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, wide, "/root/testdata/sf0.001")
    assert got.columns == wide.columns
    rows = got.collect()
    assert rows and all(r == own[r.doc_id] for r in rows)
    if name in ("quality_classifier", "decontamination"):
        assert len(rows) == len(IDS)


def test_queries_take_wide_identifiers(spark, wide, tmp_path):
    for table in ("documents", "labels", "benchmark", "pages"):
        rows = {"documents": wide, "labels": wide.selectExpr("doc_id", "1 quality", "0 toxic"), "benchmark": wide.selectExpr("doc_id item_id", "text"), "pages": wide.selectExpr("doc_id page_id", "'u' url", "text html")}[table]
        rows.write.parquet(f"{tmp_path}/{table}.parquet")
    for name in ("op1_pii", "op5_token_shards", "op9_mixing", "op11_suffix_dedup", "op12_manifest"):
        assert ids(entries.QUERIES[name](spark, str(tmp_path))) == sorted(IDS, key=str), name


@pytest.mark.parametrize("part", ["<div>", "</p><div>", "<b>", "<", "<p>x", "<td>x", "<tr><td>", "<li>x", "<a \"", "<a '\" ", "<!--", "<option>", "x<"])
def test_hostile_markup_parses_in_linear_time(part):
    nodes, started = htmltext.parse(part * (1_000_000 // len(part))), time.process_time()
    assert nodes
    small = time.process_time()
    htmltext.parse(part * (100_000 // len(part)))
    small = time.process_time() - small
    large = time.process_time()
    htmltext.parse(part * (1_000_000 // len(part)))
    assert time.process_time() - large < 60 * max(small, 0.02) and started


def test_unclosed_before_closing():
    page = "<div>" * 40_000 + "</p>" * 40_000 + "<p>text" + "</div>" * 40_000
    assert [x.text for x in htmltext.parse(page) if x.tag == "#text"] == ["text"]


def test_places_of_open_elements_equal_a_search():
    """Against a walk over all open elements."""
    rng = random.Random(5)
    for _ in range(300):
        open_ = htmltext.Open()
        for k in range(1, rng.randrange(2, 30)):
            open_.push(k, rng.choice(["p", "div", "td", "tr", "table", "b", "li", "ul"]))
            if rng.random() < 0.3:
                open_.cut(rng.randrange(1, len(open_.nodes) + 1))
        tags = set(rng.sample(["p", "td", "tr", "li", "ul"], 2))
        after = rng.randrange(len(open_.nodes))
        own = [k for k in range(1, len(open_.tags)) if open_.tags[k] in tags]
        assert open_.last(tags) == max(own, default=0)
        assert open_.first_after(tags, after) == min((k for k in own if k > after), default=0)
        assert open_.blocks == [k for k in range(1, len(open_.tags)) if open_.tags[k] in htmltext.BLOCK]
