"""Table functions for lateral joins in SQL: the lines of a log as rows, the parts of a search as rows.

``registered`` gives a session both::

    SELECT r.* FROM logs, LATERAL json_lines(logs.text, 'timestamp string, calls bigint') r
    SELECT p.* FROM searches, LATERAL query_parts(searches.raw) p
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tarnworks.operators.search import parsed
from tarnworks.sources.formats import converted

#: Types that a field of ``json_lines`` may have.
KINDS: dict[str, DataType] = {"string": StringType(), "bigint": LongType(), "double": DoubleType(), "boolean": BooleanType()}


def named_fields(text: str) -> list[tuple[str, str]]:
    """Names and types of a list as "name type, name type"."""
    fields = [tuple(part.split()) for part in text.split(",")]
    for field in fields:
        if len(field) != 2 or field[1].lower() not in KINDS:
            raise ValueError(f"fields are 'name type, ...' with types {', '.join(KINDS)}; got {' '.join(field)!r}")
    return [(name, kind.lower()) for name, kind in fields]


class JsonLines:
    """place and the fields of each line of a text that is a JSON object; others, and blank ones, give no row.

    ``place`` counts all lines from 0. Missing fields, and those of another type, are null;
    objects and lists are strings of JSON. A null text has no lines.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(fields.value, str):
            raise ValueError("fields must be a constant string")
        schema = StructType().add("place", IntegerType())
        for name, kind in named_fields(fields.value):
            schema = schema.add(name, KINDS[kind])
        return AnalyzeResult(schema)

    def __init__(self):
        self.fields = None

    def eval(self, text: str | None, fields: str) -> Iterator[tuple]:
        self.fields = self.fields or named_fields(fields)
        for place, line in enumerate((text or "").split("\n")):
            try:
                entry = json.loads(line)
            except (ValueError, RecursionError):
                continue
            if isinstance(entry, dict):
                yield place, *(converted(entry.get(name), KINDS[kind]) for name, kind in self.fields)


class QueryParts:
    """kind (term or phrase), part and either (whether one part is enough) of a search, as ``search.parsed`` reads it."""

    def eval(self, raw: str | None) -> Iterator[tuple[str, str, bool]]:
        query = parsed(raw or "")
        for kind, parts in (("phrase", query.phrases), ("term", query.terms)):
            for part in parts:
                yield kind, part, query.either


def registered(spark: SparkSession) -> None:
    """``json_lines`` and ``query_parts`` as functions of the session's SQL; rows come back as Arrow batches."""
    spark.udtf.register("json_lines", udtf(JsonLines, useArrow=True))
    spark.udtf.register("query_parts", udtf(QueryParts, returnType="kind string, part string, either boolean", useArrow=True))
