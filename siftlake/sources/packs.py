"""Rule packs: JSON files of user rules."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftlake.functions.json import computed_once, is_object, json_document_sql, text_at, type_at
from siftlake.functions.patterns import PatternError, compile_rule
from siftlake.functions.severity import rule_severity
from siftlake.model import Rule
from siftlake.sources.tree import list_tree, read_texts

# A pack to start from. Its second pattern looks ahead, which the dialect does not have, so the pack as
# a whole is rejected when loaded; its first rule alone is sound.
EXAMPLE_PACK = {
    "name": "house-rules",
    "version": "0.1.0",
    "description": "Two rules to copy and change",
    "rules": [
        {
            "code": "LOCAL001",
            "name": "Breakpoint left in",
            "pattern": r"\bbreakpoint\(\)",
            "severity": "warning",
            "message": "A breakpoint stops the program here",
            "suggestion": "Delete the call",
            "languages": ["python"],
            "include": ["src/**"],
            "exclude": [],
        },
        {
            "code": "LOCAL002",
            "name": "Sleep without a reason",
            "pattern": r"sleep\(\d+\)(?!\s*#)",
            "severity": "info",
            "message": "A fixed pause needs a comment that says why",
            "suggestion": "Add the reason, or wait for a condition",
            "languages": [],
            "include": [],
            "exclude": ["**/test/**"],
        },
    ],
}

_RULE_TEXTS = ["code", "name", "pattern", "message"]
_RULE_LISTS = ["languages", "include", "exclude"]


def _all_texts(value: str, path: str) -> str:
    """SQL: the path is absent or a list of strings."""
    present = f"try_variant_get({value}, '{path}', 'variant')"
    items = f"try_variant_get({value}, '{path}', 'array<variant>')"
    only_texts = f"forall({items}, item -> coalesce(schema_of_variant(item), 'VOID') = 'STRING')"
    return f"({present} is null or coalesce({only_texts}, false))"


def _default_text(value: str, path: str) -> str:
    """SQL: the path is absent or a string; unlike an optional field, null is an error."""
    return f"(try_variant_get({value}, '{path}', 'variant') is null or {type_at(value, path)} = 'STRING')"


def _texts(value: str, path: str) -> str:
    return f"coalesce(try_variant_get({value}, '{path}', 'array<string>'), array())"


_VALID_RULE = " and ".join(
    [is_object("r", "$")]
    + [f"{type_at('r', f'$.{name}')} = 'STRING'" for name in _RULE_TEXTS]
    + [_default_text("r", "$.severity"), f"{type_at('r', '$.suggestion')} in ('STRING', 'VOID')"]
    + [_all_texts("r", f"$.{name}") for name in _RULE_LISTS]
)
_VALID_PACK = " and ".join(
    [
        is_object("pack_json", "$"),
        f"{type_at('pack_json', '$.name')} = 'STRING'",
        _default_text("pack_json", "$.version"),
        _default_text("pack_json", "$.description"),
        f"coalesce(forall(try_variant_get(pack_json, '$.rules', 'array<variant>'), r -> {_VALID_RULE}), false)",
    ]
)
_RULE_STRUCT = (
    "named_struct("
    + ", ".join(f"'{name}', {text_at('r', f'$.{name}')}" for name in _RULE_TEXTS)
    + f", 'severity', coalesce({text_at('r', '$.severity')}, 'warning')"
    + f", 'suggestion', {text_at('r', '$.suggestion')}, "
    + ", ".join(f"'{name}', {_texts('r', f'$.{name}')}" for name in _RULE_LISTS)
    + ")"
)


@F.pandas_udf(StringType())
def first_pattern_problem(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Why a pack's patterns are not usable, or NULL."""

    known: dict[str, str | None] = {}

    def problem(pattern: str) -> str | None:
        if pattern not in known:
            try:
                compile_rule(pattern)
                known[pattern] = None
            except PatternError as error:
                known[pattern] = f"{pattern}: {error}"
        return known[pattern]

    def first(patterns) -> str | None:
        return next(filter(None, map(problem, patterns)), None) if patterns is not None else None

    for batch in batches:
        yield batch.map(first).astype("object").where(lambda column: column.notna(), None)


def parse_rule_packs(packs: DataFrame) -> DataFrame:
    """Read raw packs (dir_ord, path, raw) strictly; ``reason`` tells why a pack is rejected.

    One invalid rule rejects its whole pack.
    """
    document = computed_once(F.expr(json_document_sql("raw")))
    parsed = packs.select("dir_ord", "path", document.alias("pack_json"))
    rules = f"transform(try_variant_get(pack_json, '$.rules', 'array<variant>'), r -> {_RULE_STRUCT})"
    pack = F.struct(
        F.expr(text_at("pack_json", "$.name")).alias("name"),
        F.expr(f"coalesce({text_at('pack_json', '$.version')}, '0.1.0')").alias("version"),
        F.expr(f"coalesce({text_at('pack_json', '$.description')}, '')").alias("description"),
        F.expr(f"if({_VALID_PACK}, {rules}, null)").alias("rules"),
    )
    fields = parsed.select("dir_ord", "path", computed_once(pack).alias("pack")).select("dir_ord", "path", "pack.*")
    problem = first_pattern_problem(F.expr("rules.pattern"))
    return fields.withColumn("reason", F.when(F.col("rules").isNull(), "not a rule pack").otherwise(problem))


def valid_packs(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason")


def rejected_packs(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("dir_ord", "path", "reason")


def pack_rules(packs: DataFrame) -> DataFrame:
    """The rules of valid packs, one row each, with severity normalised."""
    exploded = packs.select("dir_ord", "path", F.col("name").alias("pack"), F.posexplode("rules").alias("at", "rule"))
    columns = exploded.select("dir_ord", "path", "pack", "at", "rule.*")
    return columns.withColumn("severity", rule_severity(F.col("severity")))


def pack_summary(packs: DataFrame) -> DataFrame:
    """Name, version, description and number of rules of each pack, empty packs included."""
    return packs.select("path", "name", "version", "description", F.size("rules").alias("rules"))


def pack_totals(packs: DataFrame) -> DataFrame:
    """One row: how many packs and how many rules in all."""
    return packs.agg(
        F.count(F.lit(1)).alias("packs"), F.coalesce(F.sum(F.size("rules")), F.lit(0)).cast("bigint").alias("rules")
    )


def example_pack(spark: SparkSession) -> DataFrame:
    """The example pack as a raw pack row, ready to be parsed or written as a template."""
    row = (0, "example-rules.json", json.dumps(EXAMPLE_PACK, indent=2))
    return spark.createDataFrame([row], "dir_ord int, path string, raw string")


def rules_of_packs(packs: DataFrame) -> list[Rule]:
    """The rules in loading order, for use in a scan. Rules are settings: they are few."""
    return [
        Rule(
            row.code,
            row.pattern,
            row.severity,
            row.message,
            row.suggestion,
            tuple(row.languages),
            tuple(row.include),
            tuple(row.exclude),
            pack=row.pack,
            name=row.name,
        )
        for row in pack_rules(packs).orderBy("dir_ord", "path", "at").toLocalIterator()
    ]


def split_pack_dirs(listed: str) -> list[str]:
    """Directories of a list separated by ``;`` or ``:``; empty entries are dropped."""
    return [name for part in listed.split(";") for name in part.split(":") if name]


def load_rule_packs(spark: SparkSession, dirs: Sequence[str]) -> DataFrame:
    """The ``*.json`` files right inside each directory, in directory order; missing ones are skipped."""
    listing = list_tree(spark, list(dirs), ignore=())
    owner = F.substring_index("file_id", ":", 1).cast("int")
    roots = F.array(*[F.lit(str(name).rstrip("/")) for name in dirs])
    inside = F.concat(F.get(roots, owner), F.lit("/"), F.substring_index("path", "/", -1)) == F.col("path")
    named = listing.filter(F.col("path").rlike(r"[^/]\.json\z") & inside)
    texts = read_texts(named.select("file_id", "path", owner.alias("dir_ord")))
    return parse_rule_packs(texts.select("dir_ord", "path", F.col("text").alias("raw")))
