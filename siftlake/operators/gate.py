"""Corpus summary, worst file, thresholds and the pass/fail outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.text import whole_number
from siftlake.model import CRITICAL_SECURITY, Thresholds


def _corpus_sums() -> list[Column]:
    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name)

    return [F.count(F.lit(1)).alias("files"), total("total").alias("findings"), total("errors"), total("warnings")]


def corpus_summary(scores: DataFrame) -> DataFrame:
    """One row: files, findings, errors and warnings."""
    return scores.agg(*_corpus_sums())


def worst_file(scores: DataFrame) -> DataFrame:
    """The file with the lowest overall score, the first in order among equals; no row for no files.

    ``min_by`` keeps one candidate per task, so nothing is sorted.
    """
    row = F.struct(*scores.columns)
    lowest = scores.agg(F.min_by(row, F.struct("overall", "ord")).alias("worst"))
    return lowest.filter(F.col("worst").isNotNull()).select("worst.*")


def critical_failures(scores: DataFrame) -> DataFrame:
    """A message when the worst file's security score is critical."""
    message = F.concat(F.lit("security score "), whole_number(F.col("security")), F.lit(" below critical threshold"))
    critical = worst_file(scores).filter(F.col("security") < CRITICAL_SECURITY)
    return critical.select("file_id", "path", "security", message.alias("message"))


def threshold_violations(scores: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Up to three rows per file, one for each score below its limit."""
    thresholds = thresholds or Thresholds()
    limits = [
        ("security", thresholds.security),
        ("code_quality", thresholds.code_quality),
        ("overall", thresholds.overall),
    ]
    checks = F.array(
        *[
            F.struct(
                F.lit(at).alias("check_ord"),
                F.lit(name).alias("dimension"),
                F.col(name).alias("value"),
                F.lit(float(limit)).alias("limit"),
            )
            for at, (name, limit) in enumerate(limits)
        ]
    )
    # Exploding the expression itself lets Spark evaluate it once per file.
    rows = scores.select("file_id", "path", "ord", F.inline(checks)).filter(F.col("value") < F.col("limit"))
    location = F.coalesce(F.col("path"), F.col("file_id"))
    message = F.concat(
        location,
        *[F.lit(": "), F.col("dimension"), F.lit(" "), whole_number(F.col("value"))],
        *[F.lit(" < threshold "), whole_number(F.col("limit"))],
    )
    return rows.withColumn("message", message)


def _violation_count(thresholds: Thresholds) -> Column:
    below = [
        F.col("security") < thresholds.security,
        F.col("code_quality") < thresholds.code_quality,
        F.col("overall") < thresholds.overall,
    ]
    return sum((F.when(check, 1).otherwise(0) for check in below), F.lit(0))


def gate_outcome(scores: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """One row: errors fail first, then threshold violations, else pass."""
    violations = F.coalesce(F.sum(_violation_count(thresholds or Thresholds())), F.lit(0)).cast("bigint")
    outcome = (
        F.when(F.col("errors") > 0, "fail_errors").when(F.col("violations") > 0, "fail_thresholds").otherwise("pass")
    )
    return scores.agg(*_corpus_sums(), violations.alias("violations")).withColumn("outcome", outcome)


def ci_outputs(scores: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """The outputs of a check step: findings, errors and the result word."""
    result = F.when(F.col("outcome") == "pass", "pass").otherwise("fail")
    return gate_outcome(scores, thresholds).select("findings", "errors", result.alias("result"))
