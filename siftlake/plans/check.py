"""The whole check as one plan: files to findings, scores, gate and reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.model import Rule, Thresholds
from siftlake.operators import gate, reports
from siftlake.operators.judge import judge_findings, rejected_responses
from siftlake.operators.scan import findings_of_hits, scan_hits, totals_of_hits
from siftlake.operators.scoring import add_totals, score_totals, totals_of_findings
from siftlake.session import shared_dir
from siftlake.sources.builtin import builtin_rules
from siftlake.sources.lint import parse_lint, rejected_lines, rejected_reports


@dataclass(frozen=True)
class Check:
    """The tables of one check; all are lazy except where ``materialize`` wrote the hits."""

    files: DataFrame
    findings: DataFrame
    scores: DataFrame
    stages: list[str]
    unmatched_findings: DataFrame | None = None
    rejected_reports: DataFrame | None = None
    rejected_lines: DataFrame | None = None
    rejected_responses: DataFrame | None = None
    rules: Sequence[Rule] = ()
    scored: DataFrame | None = None
    others: DataFrame | None = None

    def json_report(self, per_document: int = reports.FINDINGS_PER_DOCUMENT) -> DataFrame:
        """One JSON document per file. What the scan found comes from the file's own row, without a shuffle."""
        return reports.json_report_of_hits(self.scored, self.rules, self.others, per_document)

    def text_report(self) -> DataFrame:
        return reports.text_report(self.scores, self.placed_findings())

    def placed_findings(self) -> DataFrame:
        """The findings with the ``ord`` of their file, which orders reports."""
        found = findings_of_hits(self.files, self.rules, ["ord"])
        return found if self.others is None else found.unionByName(self.others)

    def outcome(self, thresholds: Thresholds | None = None) -> DataFrame:
        return gate.gate_outcome(self.scores, thresholds)


def of_known_files(findings: DataFrame, files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Findings whose file is known, with that file's path and the columns ``keep`` of it."""
    known = files.select("file_id", F.col("path").alias("file_path"), *keep)
    joined = findings.join(known, "file_id").withColumn("path", F.col("file_path"))
    return joined.select(*findings.columns, *keep)


def check(
    files: DataFrame,
    rules: Sequence[Rule] | None = None,
    lint_reports: DataFrame | None = None,
    judge_responses: DataFrame | None = None,
    materialize: bool = False,
    security_scan: bool = True,
) -> Check:
    """Scan files and merge linter reports and model reviews into findings and scores.

    The scan reduces every file to one row of match lines. With ``materialize`` those rows are
    written to the shared folder once; findings, scores and every report then read them rather
    than scan the texts again, and lost executors cost no rescan. Scores of the scan need no
    shuffle: only lint and review findings, which arrive separately, are joined by file.
    A linter finding belongs to the file of its report and takes its path; those of reports on files that
    are not part of the check are kept apart as ``unmatched_findings``, so every finding has a score. What could not be
    read is listed with a reason as ``rejected_reports``, ``rejected_lines`` and ``rejected_responses``.
    Without ``security_scan`` no rules are run and files are scored by the other findings alone.
    """
    rules = [] if not security_scan else builtin_rules() if rules is None else rules
    spark = files.sparkSession
    hits = scan_hits(files, rules)
    if materialize:
        target = shared_dir(spark, "hits")
        hits.write.parquet(target)
        hits = spark.read.parquet(target)
    # Names alone: from the written hits if there are any, else from the files, so that no text is scanned for them.
    known = (hits if materialize else files).select("file_id", "path", "ord")
    found = findings_of_hits(hits, rules)
    stages, others, rejected = ["Preprocess"], [], {}
    if lint_reports is not None:
        stages.append("Lint")
        lint = parse_lint(lint_reports)
        others.append(of_known_files(lint, known, ["ord"]))
        rejected["unmatched_findings"] = lint.join(known.select("file_id"), "file_id", "left_anti")
        rejected["rejected_reports"] = rejected_reports(lint_reports)
        rejected["rejected_lines"] = rejected_lines(lint_reports.filter("tool = 'clippy'"))
    if security_scan:
        stages.append("Security")
    if judge_responses is not None:
        stages.append("Semantic")
        others.append(judge_findings(known, judge_responses, ["ord"]))
        rejected["rejected_responses"] = rejected_responses(judge_responses)
    more = reduce(DataFrame.unionByName, others) if others else None
    findings = found if more is None else found.unionByName(more.drop("ord"))
    totals = totals_of_hits(hits, rules, ["lines"])
    if more is not None:
        totals = add_totals(totals, totals_of_findings(more), ["lines"])
    scored = score_totals(totals, ["lines"])
    scores, stages = scored.drop("lines"), [*stages, "Aggregate"]
    return Check(hits, findings, scores, stages, **rejected, rules=rules, scored=scored, others=more)
