"""Model review as tables: prompts and request bodies out, responses back in as findings.

Sending the requests is left to a batch inference service that reads and writes tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.json import STRICT_JSON, computed_once, json_document_sql, text_at
from siftlake.model import STAGE_SEMANTIC, JudgeConfig

# The prompt around the language name and the code.
PROMPT_START = "Review this "
PROMPT_MIDDLE = " code for AI-generated code quality issues:\n\n"
PROMPT_END = (
    "\n\n\nCheck for:\n"
    "- Overly verbose or unnecessary abstractions\n"
    "- Missing error handling\n"
    "- Unreasonable dependency choices\n"
    "- Template-like or boilerplate code\n"
    "- Logic that looks correct but has subtle bugs\n"
    "- Lack of edge case handling\n\n"
    "Rate on a scale of 0-100 and provide a brief explanation."
)


# Bodies from this size on may exceed the engine's limit of one value once they are read.
LARGE_BODY = 16 << 20


def prompt_of(language: Column, snippet: Column) -> Column:
    name = F.coalesce(language, F.lit("unknown"))
    return F.concat(F.lit(PROMPT_START), name, F.lit(PROMPT_MIDDLE), snippet, F.lit(PROMPT_END))


def prompts(files: DataFrame, config: JudgeConfig, head_only: bool = False) -> DataFrame:
    """Prompts for every readable file, one per ``chunk`` of as many characters as the model takes.

    The chunks of a file, from 0, are its whole text. With ``head_only`` there is just chunk 0.
    """
    size = config.max_input_chars
    last = F.lit(0) if head_only else F.expr(f"cast((greatest(char_length(text), 1) - 1) div {size} as int)")
    chunks = files.filter(F.col("text").isNotNull()).withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    snippet = F.substring("text", F.col("chunk") * size + 1, F.lit(size))
    return chunks.select("file_id", "path", "chunk", prompt_of(F.col("language"), snippet).alias("prompt"))


def request_bodies(files: DataFrame, config: JudgeConfig, head_only: bool = False) -> DataFrame:
    """The JSON body to send for each prompt."""
    message = F.struct(F.col("prompt").alias("content"), F.lit("user").alias("role"))
    body = F.struct(
        F.lit(config.max_tokens).alias("max_tokens"),
        F.array(message).alias("messages"),
        F.lit(config.model).alias("model"),
    )
    provider = F.lit(config.provider).alias("provider")
    return prompts(files, config, head_only).select("file_id", "chunk", provider, F.to_json(body).alias("body"))


# Where each provider puts its answer, and the schema that leads there through the outer objects alone.
_ANSWERS = {
    "anthropic": ("$.content[0].text", "struct<content: array<struct<text: variant>>>", "get(o.content, 0).text"),
    "openai": ("$.choices[0].message.content", "struct<choices: array<struct<message: struct<content: variant>>>>", "get(o.choices, 0).message.content"),
}


def _read_responses(responses: DataFrame) -> DataFrame:
    """The successful responses with the ``answer`` they hold, if any, and whether the body was read as ``one`` value.

    A body that cannot be read as one value may exceed the engine's limit of a value. It is then read along its
    outer objects, so that only the answer itself has to keep to the limit.
    """
    succeeded = responses.filter(F.col("status").between(200, 299))
    parsed = succeeded.select("file_id", "provider", "body", computed_once(F.expr(json_document_sql("body"))).alias("one"))

    def answer(name: str) -> str:
        path, schema, value = _ANSWERS[name]
        read = f"from_json(concat('[', body, ']'), 'array<{schema}>', {STRICT_JSON})"
        own = f"get(transform(filter(array({read}), n -> size(n) = 1), n -> get(transform(n, o -> {value}), 0)), 0)"
        large = f"if(octet_length(body) > {LARGE_BODY}, {text_at(own, '$')}, null)"
        return f"if(one is not null, {text_at('one', path)}, {large})"

    # Providers other than the first use the form of the second.
    text = F.expr(f"case provider when 'anthropic' then {answer('anthropic')} else {answer('openai')} end")
    return parsed.select("file_id", "provider", F.col("one").isNotNull().alias("one"), F.octet_length("body").alias("bytes"), computed_once(text).alias("answer"))


def response_texts(responses: DataFrame) -> DataFrame:
    """The answer of each successful response; failed or unreadable ones are dropped, see ``rejected_responses``."""
    read = _read_responses(responses)
    return read.filter(F.col("answer").isNotNull()).select("file_id", F.col("answer").alias("explanation"))


def rejected_responses(responses: DataFrame) -> DataFrame:
    """Responses that give no finding, and why: ``file_id``, ``provider``, ``reason``."""
    failed = responses.filter(~F.coalesce(F.col("status").between(200, 299), F.lit(False)))
    failed = failed.select("file_id", "provider", F.concat(F.lit("status "), F.coalesce(F.col("status").cast("string"), F.lit("missing"))).alias("reason"))
    unread = _read_responses(responses).filter("answer is null")
    reason = F.when(F.col("one"), "no answer text").when(F.col("bytes") > LARGE_BODY, "larger than one value may be, or no answer text")
    return failed.unionByName(unread.select("file_id", "provider", reason.otherwise("not one JSON value").alias("reason")))


def judge_findings(files: DataFrame, responses: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One informational finding per file with an answer; ``keep`` names columns of the files to add."""
    answered = files.select("file_id", "path", *keep).join(response_texts(responses), "file_id")
    return answered.select(
        "file_id",
        "path",
        F.lit(STAGE_SEMANTIC).alias("stage_ord"),
        F.lit(1).alias("rule_ord"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit("ai_semantic").alias("category"),
        F.lit("info").alias("severity"),
        F.lit("SEM001").alias("code"),
        F.lit("AI semantic review completed").alias("message"),
        F.lit(None).cast("bigint").alias("line"),
        F.lit(None).cast("bigint").alias("column"),
        F.lit(None).cast("string").alias("suggestion"),
        F.col("explanation").alias("ai_explanation"),
        *keep,
    )
