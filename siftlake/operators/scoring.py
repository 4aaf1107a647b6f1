"""Per-file quality scores from findings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.paths import stem
from siftlake.model import (
    CLEAN_SCORES,
    LANGUAGES,
    PENALTIES,
    SEVERITIES,
    TEST_FILE_SCORE,
    TOTAL_COLUMNS,
    UNKNOWN_LANGUAGE_TEST_SCORE,
    WEIGHTS,
)

_PREFIX = {"security": "security", "performance": "performance", "ai_semantic": "ai"}


def totals_of_findings(findings: DataFrame) -> DataFrame:
    """Counts and penalties per file.

    All aggregates are sums, combined before the shuffle, so a file that holds most of the
    findings still arrives as one small row per task.
    """
    severity, category = F.col("severity"), F.col("category")
    sums = [
        F.count_if(severity == "error").alias("errors"),
        F.count_if(severity == "warning").alias("warnings"),
        F.count(F.lit(1)).alias("total"),
    ]
    for name, penalties in PENALTIES.items():
        penalty = F.lit(0.0)
        for level, value in zip(SEVERITIES, penalties):
            penalty = F.when(severity == level, value).otherwise(penalty)
        in_category = category == name
        sums.append(F.count_if(in_category).alias(f"{_PREFIX[name]}_count"))
        sums.append(F.sum(F.when(in_category, penalty).otherwise(0.0)).alias(f"{_PREFIX[name]}_penalty"))
    return findings.groupBy("file_id").agg(*sums)


def with_totals(files: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach totals to every file; files without findings get zeros.

    ``totals`` hold at most one row per file, so the join cannot fan out.
    """
    joined = files.select("file_id", "path", "language", "ord").join(totals, "file_id", "left")
    filled = [F.coalesce(F.col(name), _zero(name)).alias(name) for name in TOTAL_COLUMNS]
    return joined.select("file_id", "path", "language", "ord", *filled)


def add_totals(known: DataFrame, more: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Add further totals to files whose totals are known; both have one row per file at most."""
    renamed = more.select("file_id", *[F.col(name).alias(f"more_{name}") for name in TOTAL_COLUMNS])
    sums = [
        (F.col(name) + F.coalesce(F.col(f"more_{name}"), _zero(name))).alias(name) for name in TOTAL_COLUMNS
    ]
    return known.join(renamed, "file_id", "left").select("file_id", "path", "language", "ord", *keep, *sums)


def _zero(name: str) -> Column:
    return F.lit(0.0) if name.endswith("penalty") else F.lit(0).cast("bigint")


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), value))


def code_quality_score(errors: Column, warnings: Column, total: Column) -> Column:
    weighted = errors.cast("double") * 10.0 + warnings.cast("double") * 3.0
    scored = clamp((F.lit(1.0) - weighted / (total.cast("double") * 10.0 + 1.0)) * 100.0)
    return F.when(total > 0, scored).otherwise(100.0)


def penalty_score(category: str, count: Column, penalty: Column) -> Column:
    return F.when(count == 0, CLEAN_SCORES[category]).otherwise(clamp(F.lit(100.0) - penalty))


def test_score(path: Column, language: Column) -> Column:
    estimate = F.lit(UNKNOWN_LANGUAGE_TEST_SCORE)
    for record in LANGUAGES:
        estimate = F.when(language == record.name, record.test_score).otherwise(estimate)
    return F.when(stem(path).contains("test"), TEST_FILE_SCORE).otherwise(estimate)


def overall_score(scores: dict[str, Column]) -> Column:
    return reduce(add, [F.lit(weight) * scores[name] for name, weight in WEIGHTS])


def score_totals(totals: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Scores of files whose totals are known: a plain projection. ``keep`` names columns to pass through."""
    dimensions = {
        "security": penalty_score("security", F.col("security_count"), F.col("security_penalty")),
        "code_quality": code_quality_score(F.col("errors"), F.col("warnings"), F.col("total")),
        "performance": penalty_score("performance", F.col("performance_count"), F.col("performance_penalty")),
        "test_coverage": test_score(F.col("path"), F.col("language")),
        "ai_risk": penalty_score("ai_semantic", F.col("ai_count"), F.col("ai_penalty")),
    }
    scored = totals.select(
        *["file_id", "path", "language", "ord", *keep, "errors", "warnings", "total"],
        *[value.alias(name) for name, value in dimensions.items()],
    )
    return scored.withColumn("overall", overall_score({name: F.col(name) for name in dimensions}))


def score(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Scores of all files, with findings or without."""
    return score_totals(with_totals(files, totals_of_findings(findings)))
