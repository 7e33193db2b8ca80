"""Tables of model responses: reasoning tags, tool calls and context for the answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convolens.functions.arrays import let
from convolens.functions.text import strip

# --- fixed values -------------------------------------------------------------------------------
THINK_BLOCK = r"(?s)<think>.*?</think>"
THINK_TAG = r"</?think>"
CALL_START = r'(?s)\{.*?"function_call".*?\}'
FLAT_CALL = r'(?s)\{[^{}]*"function_call"[^{}]*\{[^{}]*\}[^{}]*\}'
MIN_RESPONSE_LENGTH = 10
# -------------------------------------------------------------------------------------------------
# An object with up to two levels of objects inside, so a call keeps its arguments. Possessive
# repeats neither recurse per character nor try a text again in other ways.
NESTED_OBJECT = r"\{(?:[^{}]++|\{(?:[^{}]++|\{[^{}]*+\})*+\})*+\}"
CALL_KEY = '"function_call"'


def tidy(response: Column) -> Column:
    """Back-ticks become quotes; blanks at the ends go."""
    return strip(F.translate(response, "`", "'"))


def strip_reasoning(response: Column) -> Column:
    """The response without reasoning tags.

    When fewer than ten characters remain, the first function-call text of the original, if any,
    takes their place.
    """
    untagged = F.regexp_replace(F.regexp_replace(response, THINK_BLOCK, ""), THINK_TAG, "")
    # Texts without the key never meet the pattern, which tries every open brace.
    call = F.when(response.contains(CALL_KEY), F.regexp_extract(response, CALL_START, 0)).otherwise("")
    return let(
        strip(untagged),
        lambda bare: F.when(
            F.length(bare) < MIN_RESPONSE_LENGTH, F.when(call != "", call).otherwise(bare)
        ).otherwise(bare),
    )


def extract_call(response: Column, mode: str = "lossless") -> Column:
    """The response's JSON as a variant: the whole tidied text, else the first part that parses.

    ``reference`` looks for parts with the two original patterns, which cut a call with an
    arguments object short; ``lossless`` looks for balanced objects that name a function call.
    """
    if mode not in ("lossless", "reference"):
        raise ValueError("mode is 'lossless' or 'reference'")

    def parts(clean: Column) -> Column:
        if mode == "reference":
            return F.concat(
                F.regexp_extract_all(clean, F.lit(FLAT_CALL), 0),
                F.regexp_extract_all(clean, F.lit(CALL_START), 0),
            )
        return F.filter(
            F.regexp_extract_all(clean, F.lit(NESTED_OBJECT), 0),
            lambda p: p.contains(CALL_KEY),
        )

    def parse(clean: Column) -> Column:
        parsed = F.filter(F.transform(parts(clean), F.try_parse_json), lambda v: v.isNotNull())
        inside = F.when(clean.contains(CALL_KEY), F.try_element_at(parsed, F.lit(1)))
        return F.coalesce(F.try_parse_json(clean), inside)

    return let(strip_reasoning(tidy(response)), parse)


def is_call(value: Column) -> Column:
    """Whether a variant is an object with a function call."""
    return F.coalesce(
        F.schema_of_variant(F.try_variant_get(value, "$.function_call", "variant")).isNotNull(),
        F.lit(False),
    )


def tool_calls(responses: DataFrame, text_col: str = "response", mode: str = "lossless") -> DataFrame:
    """Add ``is_call``, ``name`` and ``arguments`` (a variant) to a table of responses."""

    def fields(call: Column) -> Column:
        part = lambda path, kind: F.try_variant_get(call, path, kind)
        return F.struct(
            is_call(call).alias("is_call"),
            part("$.function_call.name", "string").alias("name"),
            part("$.function_call.arguments", "variant").alias("arguments"),
        )

    found = responses.withColumn("_found", let(extract_call(F.col(text_col), mode), fields))
    return found.select(*responses.columns, "_found.*")


def pack_context(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """``(query_id, text, context)``: each question beside its hits as one JSON array.

    ``hits`` come from a search and hold at most 2k rows per question.
    """
    ordered = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("score")).alias("rank"),
                *["chat_id", "seq", "user", "date_time", "message", "message_type", "score", "method"],
            )
        )
    )
    listed = hits.groupBy("query_id").agg(ordered.alias("_hits"))
    shown = F.transform("_hits", lambda h: h.dropFields("rank"))
    joined = questions.select("query_id", "text").join(listed, "query_id", "left")
    return joined.select(
        "query_id", "text", F.coalesce(F.to_json(shown), F.lit("[]")).alias("context")
    )
