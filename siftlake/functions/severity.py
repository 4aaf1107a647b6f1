"""Severity expressions used by rules, reports and gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.model import SEVERITIES


def rule_severity(severity: Column) -> Column:
    """Severity of a rule-pack rule: any case, unknown words become ``info``."""
    lowered = F.lower(severity)
    return F.when(lowered.isin("error", "warning"), lowered).otherwise("info")


def report_severity(severity: Column, default: str) -> Column:
    """Severity of a linter diagnostic: exact words only, else the linter's default."""
    return F.when(severity.isin("error", "warning"), severity).otherwise(default)


def ruff_severity(code: Column) -> Column:
    return (
        F.when(code.startswith("E") | code.startswith("F"), "error")
        .when(code.startswith("W") | code.startswith("B") | code.startswith("SIM"), "warning")
        .otherwise("info")
    )


def clippy_severity(level: Column) -> Column:
    return report_severity(F.coalesce(level, F.lit("warning")), "info")


def severity_rank(severity: Column) -> Column:
    rank = F.lit(None).cast("int")
    for position, name in enumerate(SEVERITIES):
        rank = F.when(severity == name, F.lit(position)).otherwise(rank)
    return rank


def is_error(severity: Column) -> Column:
    return severity == "error"


def is_security(category: Column) -> Column:
    return category == "security"


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "info", "note").otherwise(severity)


def diagnostic_severity(severity: Column) -> Column:
    """Editor severity name; unknown words become ``hint``."""
    lowered = F.lower(severity)
    return (
        F.when(lowered.isin("error", "warning"), lowered)
        .when(lowered == "info", "information")
        .otherwise("hint")
    )
