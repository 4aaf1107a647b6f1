"""Pattern scan: at most one finding per file and rule, at the rule's first match.

The scan is a narrow projection. Rules become literal expressions, so every text is read
once, nothing is shuffled, and the text itself never travels further than its own task.
Each rule is tried in rising order of cost: language and path filters, literals that every
match contains, and only then the pattern.
"""

from __future__ import annotations

import warnings
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlake.functions.json import computed_once
from siftlake.functions.paths import any_glob_sql
from siftlake.functions.patterns import CompiledPattern, PatternError, compile_rule, is_sign_group
from siftlake.functions.text import first_match_line_sql, fold_case, sql_string
from siftlake.model import PENALTIES, STAGE_SECURITY, TOTAL_COLUMNS, Rule
from siftlake.operators.rule_index import Needles, candidate_rules, first_match_lines, matched_sql

# Rules written out as expressions: so many cost about as much as the transfer to the index of literals that
# larger sets are matched through, with the same findings and again in one pass.
LITERAL_RULES = 40

_SLOW = "__slow_lines"
_CANDIDATES = "__candidate_rules"
_FOLDED = "__folded_text"


def usable_rules(rules: Sequence[Rule]) -> list[tuple[int, Rule, CompiledPattern]]:
    """Rules with their number and compiled pattern; a rule outside the dialect is left out."""
    usable = []
    for number, rule in enumerate(rules, start=1):
        try:
            usable.append((number, rule, compile_rule(rule.pattern, rule.linear)))
        except PatternError as problem:
            warnings.warn(f"rule {rule.code} skipped: {problem}", stacklevel=2)
    return usable


def rule_filter_sql(rule: Rule) -> list[str]:
    """Language, include and exclude filters of a rule. A file without language passes the first."""
    filters = []
    if rule.languages:
        names = ", ".join(sql_string(name.lower()) for name in rule.languages)
        filters.append(f"(language is null or language in ({names}))")
    if rule.include:
        filters.append(any_glob_sql("path", rule.include))
    if rule.exclude:
        filters.append(f"not {any_glob_sql('path', rule.exclude)}")
    return filters


def _candidate_sql(rule: Rule, compiled: CompiledPattern, shared: dict[str, str]) -> list[str]:
    """Conditions cheaper than the pattern itself, cheapest first."""
    subject = _subject(compiled)
    tests = [_any_literal_sql(subject, group) for group in compiled.needles]
    return rule_filter_sql(rule) + [shared.get(test, test) for test in tests]


def _any_literal_sql(subject: str, group: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"contains({subject}, {sql_string(literal)})" for literal in group) + ")"


def _shared_tests(rules: list[tuple[int, Rule, CompiledPattern]]) -> dict[str, str]:
    """Columns for the tests on signs that several rules have in common."""
    tests = Counter(
        _any_literal_sql(_subject(compiled), group)
        for _, _, compiled in rules
        for group in compiled.needles
        if is_sign_group(group)
    )
    return {test: f"__signs_{at}" for at, test in enumerate(test for test, uses in tests.items() if uses > 1)}


def _subject(compiled: CompiledPattern) -> str:
    return _FOLDED if compiled.folded else "text"


def _slow_rule_lines(patterns: list[str]):
    """First-match line of each pattern by a linear-time engine, one Arrow batch at a time."""

    @F.arrow_udf("array<bigint>")
    def lines(texts: pa.Array) -> pa.Array:
        found = np.zeros((len(texts), len(patterns)), np.int64)
        missing = np.ones(found.shape, bool)
        for at, pattern in enumerate(patterns):
            rows, lines_of_rows = first_match_lines(texts, pattern)
            found[rows, at] = lines_of_rows
            missing[rows, at] = False
        offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(patterns)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel(), mask=missing.ravel()))

    return lines


def _prepared(files: DataFrame, rules: list[tuple[int, Rule, CompiledPattern]]) -> tuple[DataFrame, str]:
    """The files with what the rules need, and SQL for the array of first-match lines by rule."""
    if len(rules) > LITERAL_RULES:
        files, matched = _indexed(files, rules)
        lines = f"map_from_entries({matched})"
        return files, f"transform(sequence(0, {len(rules) - 1}), at -> try_element_at({lines}, at))"
    if any(compiled.folded for _, _, compiled in rules):
        files = files.withColumn(_FOLDED, fold_case(F.col("text")))
    shared = _shared_tests(rules)
    if shared:
        files = files.withColumns({name: F.expr(test) for test, name in shared.items()})
    slow = [(rule, compiled) for _, rule, compiled in rules if not compiled.linear and compiled.arrow]
    if slow:
        # Texts no slow rule can match are passed as NULL, so they do not leave the JVM.
        candidates = [" and ".join(_candidate_sql(rule, compiled, shared) or ["true"]) for rule, compiled in slow]
        engine = _slow_rule_lines([compiled.arrow for _, compiled in slow])
        files = files.withColumn(_SLOW, engine(F.expr(f"case when {' or '.join(candidates)} then text end")))
    lines = []
    position = {id(rule): at for at, (rule, _) in enumerate(slow)}
    for _, rule, compiled in rules:
        conditions = _candidate_sql(rule, compiled, shared)
        if id(rule) in position:
            line = f"{_SLOW}[{position[id(rule)]}]"
        else:
            conditions.append(f"{_subject(compiled)} rlike {sql_string(compiled.java)}")
            line = first_match_line_sql(_subject(compiled), compiled.java, compiled.nullable)
        lines.append(f"case when {' and '.join(conditions)} then {line} end" if conditions else line)
    return files, f"cast(array({', '.join(lines)}) as array<bigint>)"


def _indexed(files: DataFrame, rules: list[tuple[int, Rule, CompiledPattern]]) -> tuple[DataFrame, str]:
    """The files with the rules that may match each, and SQL for those that do, as (at, line)."""
    compiled = [compiled for _, _, compiled in rules]
    if any(one.folded for one in compiled):
        files = files.withColumn(_FOLDED, fold_case(F.col("text")))
    # Every broadcast rule takes a few hundred bytes.
    index = candidate_rules(files.sparkSession.sparkContext.broadcast(Needles.of(compiled)))
    files = files.withColumn(_CANDIDATES, index("text"))
    return files, matched_sql([(rule, one) for _, rule, one in rules], _CANDIDATES, _FOLDED)


def scan(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings of all rules over all files: one pass, no shuffle."""
    compiled = usable_rules(rules)
    if len(compiled) > LITERAL_RULES:
        prepared, matched = _indexed(files, compiled)
        hits = prepared.select("file_id", "path", F.inline(F.expr(matched)))
        return _as_findings(hits, compiled)
    prepared, lines = _prepared(files, compiled)
    # Exploding the expression itself, not a column, keeps Spark from evaluating it twice.
    hits = prepared.select("file_id", "path", F.posexplode(F.expr(lines)).alias("at", "line"))
    return _as_findings(hits.filter(F.col("line").isNotNull()), compiled)


def scan_hits(files: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """One row per file without its text: the lines of all rules' first matches as an array.

    This is the compact result to write once and derive both findings and scores from.
    ``keep`` names further columns of the files to pass through. The array is computed once per
    file, whatever filters on scores or findings follow.
    """
    prepared, lines = _prepared(files, usable_rules(rules))
    return prepared.select("file_id", "path", "language", "ord", *keep, computed_once(F.expr(lines)).alias("lines"))


def findings_of_hits(hits: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """The findings of all files; ``keep`` names columns of the hits to add to each."""
    exploded = hits.select("file_id", "path", *keep, F.posexplode("lines").alias("at", "line"))
    return _as_findings(exploded.filter(F.col("line").isNotNull()), usable_rules(rules), keep)


def items_of_hits(rules: Sequence[Rule]) -> Column:
    """A file's findings as an array in report order, from its lines: a projection of the hits."""
    fields = ", ".join(f"'{name}', {sql}" for name, sql in _finding_fields(usable_rules(rules), "h.at", "h.line").items())
    hits = "filter(transform(lines, (line, at) -> named_struct('at', at, 'line', line)), h -> h.line is not null)"
    return F.expr(f"transform({hits}, h -> named_struct({fields}))")


def totals_of_hits(hits: DataFrame, rules: Sequence[Rule], keep: Sequence[str] = ()) -> DataFrame:
    """Per-file counts and penalties straight from the hits: still one row per file, no shuffle.

    ``keep`` names further columns of the hits to pass through.
    """
    severities = _array_sql([rule.severity for _, rule, _ in usable_rules(rules)], "string")

    def count(severity: str) -> Column:
        return F.expr(f"size(filter(lines, (line, at) -> line is not null and get({severities}, at) = '{severity}'))")

    error, warning, info = PENALTIES["security"]
    counted = hits.select(
        "file_id",
        "path",
        "language",
        "ord",
        *keep,
        count("error").cast("bigint").alias("errors"),
        count("warning").cast("bigint").alias("warnings"),
        count("info").cast("bigint").alias("infos"),
    )
    total = F.col("errors") + F.col("warnings") + F.col("infos")
    penalty = F.col("errors") * error + F.col("warnings") * warning + F.col("infos") * info
    return counted.withColumns(
        {
            "total": total,
            "security_count": total,
            "security_penalty": penalty,
            "performance_count": F.lit(0).cast("bigint"),
            "performance_penalty": F.lit(0.0),
            "ai_count": F.lit(0).cast("bigint"),
            "ai_penalty": F.lit(0.0),
        }
    ).select("file_id", "path", "language", "ord", *keep, *TOTAL_COLUMNS)


def _array_sql(values: list, type_name: str) -> str:
    literals = ["null" if v is None else sql_string(v) if isinstance(v, str) else str(v) for v in values]
    return f"cast(array({', '.join(literals)}) as array<{type_name}>)"


def _finding_fields(rules: list[tuple[int, Rule, CompiledPattern]], at: str, line: str) -> dict[str, str]:
    """SQL for the fields of a finding but for its file, by the position of its rule."""

    def of_rule(values: list, type_name: str) -> str:
        return f"get({_array_sql(values, type_name)}, {at})"

    return {
        "stage_ord": str(STAGE_SECURITY),
        "rule_ord": of_rule([number for number, _, _ in rules], "int"),
        "seq": "0L",
        "category": "'security'",
        "severity": of_rule([rule.severity for _, rule, _ in rules], "string"),
        "code": of_rule([rule.code for _, rule, _ in rules], "string"),
        "message": of_rule([rule.message for _, rule, _ in rules], "string"),
        "line": line,
        "column": "cast(null as bigint)",
        "suggestion": of_rule([rule.suggestion for _, rule, _ in rules], "string"),
        "ai_explanation": "cast(null as string)",
    }


def _as_findings(
    hits: DataFrame, rules: list[tuple[int, Rule, CompiledPattern]], keep: Sequence[str] = ()
) -> DataFrame:
    """Look up the rule of each hit by its position."""
    fields = [f"{sql} as {name}" for name, sql in _finding_fields(rules, "at", "line").items()]
    return hits.selectExpr("file_id", "path", *fields, *keep)
