"""Column expressions for answers of language models: JSON among other text, token counts, plausibility of counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def tolerant_json(answer: Column) -> Column:
    """A JSON object or array (as text) that is the answer, or stands in its fence, or from its first brace to its last; an
    array between brackets comes last, as the member ``zones`` of an object. Null if none can be read."""
    whole = lambda x: F.when(F.try_parse_json(x).isNotNull() & F.trim(x).rlike(r"^[\[{]"), F.trim(x))
    found = lambda pattern: F.nullif(F.regexp_extract(answer, pattern, 1), F.lit(""))
    listed = whole(found(r"(?s)(\[.*\])"))
    return F.coalesce(whole(answer), whole(F.trim(found(r"(?s)```(?:json)?\s*\n?(.*?)\n?```"))), whole(found(r"(?s)(\{.*\})")), F.when(listed.isNotNull(), F.concat(F.lit('{"zones":'), listed, F.lit(',"insights":[]}'))))


def number_at(json: Column, *names: str) -> Column:
    """The first of the members that is there, if it is a number."""
    first = F.coalesce(*(F.get_json_object(json, f"$.{n}") for n in names))
    return F.when(first.rlike(NUMBER), first.cast("double").cast("long"))


def presence(input_: Column, output: Column) -> Column:
    """complete, partial or unavailable."""
    return F.when(input_.isNotNull() & output.isNotNull(), "complete").when(input_.isNotNull() | output.isNotNull(), "partial").otherwise("unavailable")


def usage(json: Column, dialect: str) -> Column:
    """Struct of input, output, cache_creation, cache_read and status of an answer's envelope (JSON text).

    Dialects: ``api``; ``cli`` with totals under other names; ``stream``, where a nested usage counts if the top has
    nothing; ``prompt``, with prompt and completion tokens, nested or not. Missing counts are 0.
    """
    inputs, outputs = (("input_tokens",), ("output_tokens",)) if dialect == "api" else (("input_tokens", "prompt_tokens"), ("output_tokens", "completion_tokens")) if dialect == "prompt" else (("input_tokens", "total_input_tokens"), ("output_tokens", "total_output_tokens"))
    at = json
    if dialect in ("stream", "prompt"):
        nested = F.get_json_object(json, "$.usage")
        bare = number_at(json, *inputs).isNull() & number_at(json, *outputs).isNull()
        at = F.when(bare & nested.rlike(r"^\{"), nested).otherwise(json)
    i, o = number_at(at, *inputs), number_at(at, *outputs)
    more = lambda name: F.greatest(F.lit(0).cast("long"), F.coalesce(number_at(at, name), F.lit(0).cast("long")))
    zero = F.lit(0).cast("long")
    return F.struct(F.coalesce(i, zero).alias("input"), F.coalesce(o, zero).alias("output"), more("cache_creation_input_tokens").alias("cache_creation"), more("cache_read_input_tokens").alias("cache_read"), presence(i, o).alias("status"))


def outside(value: Column, expected: Column, percent: Column) -> Column:
    """Whether a positive count lies outside its expected range, so many percent wide in all."""
    share = percent / 200
    return (value > 0) & ((value < expected * (1 - share)) | (value > expected * (1 + share)))


def usage_issues(vendor: Column, input_: Column, output: Column, turns: Column, silent: Column, expected_input: Column, expected_output: Column, percent: Column) -> Column:
    """Array of what is odd about a run's counts: nothing reported, one side missing, far from what is expected, some turns silent."""
    strict = vendor == "codex"
    tests = {
        "no_tokens": vendor.isin("codex", "google") & (input_ == 0) & (output == 0),
        "no_input": strict & (input_ == 0),
        "no_output": strict & (output == 0),
        "odd_input": outside(input_, expected_input, percent),
        "odd_output": outside(output, expected_output, percent),
        "silent_turns": (silent > 0) & (silent < turns),
    }
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))
