"""Linter reports as findings.

Each report row holds the raw output of one linter for one file. Diagnostics are read as ``variant``
because types matter: one with a missing, null or wrongly typed field voids its
whole report, and plain JSON decoding would silently convert or drop such a field. Reports above the
engine's limit of one value are split, and each diagnostic is a value of its own. ``rejected_reports``
lists the reports that are void, ``rejected_lines`` the unreadable ones of line-wise reports.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions.paths import extension
from siftlake.functions.json import is_object as _is_object
from siftlake.functions.json import computed_once, json_document_sql, json_list_sql, key_count_sql, type_at
from siftlake.functions.json import text_at as _text
from siftlake.functions.json import whole_number_at as _count
from siftlake.functions.severity import clippy_severity, report_severity, ruff_severity
from siftlake.model import LINTERS, STAGE_LINT

# Lines and bytes of a report handed on at once; only a single longer line exceeds them.
LINES_PER_BATCH, BATCH_BYTES = 2000, 4 << 20
# The engine's limit of one value read from JSON.
VALUE_BYTES = 128 << 20


def _needs_text(path: str) -> str:
    return f"{type_at('d', path)} = 'STRING'"


def _may_have_text(path: str) -> str:
    return f"{type_at('d', path)} in ('STRING', 'VOID')"


def _may_have_count(path: str) -> str:
    return f"({type_at('d', path)} = 'VOID' or {_count('d', path)} is not null)"


def _may_have_object(path: str) -> str:
    return f"({type_at('d', path)} = 'VOID' or {_is_object('d', path)})"


# Where each linter keeps its diagnostics and which fields it must and may have.
_ARRAYS = {"ruff": "diagnostics", "biome": "diagnostics", "oxlint": "results", "golangci-lint": "issues"}
_CHECKS = {
    "ruff": [
        _needs_text("$.code"),
        _needs_text("$.message"),
        _is_object("d", "$.location"),
        f"{_count('d', '$.location.row')} is not null",
    ],
    "biome": [
        _needs_text("$.message"),
        _may_have_text("$.code"),
        _may_have_text("$.severity"),
        _may_have_object("$.location"),
        _may_have_count("$.location.line"),
    ],
    "oxlint": [
        _needs_text("$.message"),
        _may_have_text("$.code"),
        _may_have_text("$.severity"),
        _may_have_count("$.line"),
        _may_have_count("$.column"),
    ],
    "golangci-lint": [
        _needs_text("$.text"),
        _needs_text("$.from_linter"),
        _may_have_text("$.severity"),
        _may_have_object("$.location"),
        _may_have_count("$.location.line"),
    ],
}
_FIELDS = {
    "ruff": {"code": _text("d", "$.code"), "message": _text("d", "$.message"), "line": _count("d", "$.location.row")},
    "biome": {
        "code": f"coalesce({_text('d', '$.code')}, 'BIOME')",
        "message": _text("d", "$.message"),
        "line": _count("d", "$.location.line"),
    },
    "oxlint": {
        "code": f"coalesce({_text('d', '$.code')}, 'OXLLINT')",
        "message": _text("d", "$.message"),
        "line": _count("d", "$.line"),
    },
    "golangci-lint": {
        "code": _text("d", "$.from_linter"),
        "message": _text("d", "$.text"),
        "line": f"coalesce({_count('d', '$.location.line')}, 1L)",
    },
}
_DEFAULT_SEVERITY = {"biome": "error", "oxlint": "error", "golangci-lint": "info"}


def parse_lint(reports: DataFrame, tool: str | None = None) -> DataFrame:
    """Findings of the reports of one linter, or of all.

    ``reports`` has file_id, path, raw and, unless one tool is named, tool. Reports of all tools
    take two passes: one for those that hold a single JSON document, one for those by line.
    """
    if tool is None:
        documents = _document_diagnostics(reports.filter(F.col("tool").isin(*_ARRAYS)), list(_ARRAYS))
        lines = _clippy_messages(reports.filter(F.col("tool") == "clippy"))
        diagnostics = documents.unionByName(lines)
    elif tool == "clippy":
        diagnostics = _clippy_messages(reports)
    else:
        diagnostics = _document_diagnostics(reports.withColumn("tool", F.lit(tool)), [tool])
    number = F.lit(None).cast("int")
    for at, name in enumerate(LINTERS, start=1):
        number = F.when(F.col("tool") == name, at).otherwise(number)
    return diagnostics.select(
        "file_id",
        "path",
        F.lit(STAGE_LINT).alias("stage_ord"),
        number.alias("rule_ord"),
        F.col("seq").cast("bigint").alias("seq"),
        F.lit("lint").alias("category"),
        "severity",
        "code",
        "message",
        "line",
        F.lit(None).cast("bigint").alias("column"),
        F.lit(None).cast("string").alias("suggestion"),
        F.lit(None).cast("string").alias("ai_explanation"),
    )


def _is_sound(tool: str) -> str:
    """SQL for whether all diagnostics of a report are sound; NULL when it has no list of them."""
    return f"forall(report.items, d -> {' and '.join(['d is not null', _is_object('d', '$'), *_CHECKS[tool]])})"


def _items_sql(tool: str) -> str:
    """SQL for a report's diagnostics as structs; NULL when any of them is not sound."""
    fields = {**_FIELDS[tool], "severity": "cast(null as string)" if tool == "ruff" else _text("d", "$.severity")}
    struct = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    return f"case when {_is_sound(tool)} then transform(report.items, d -> named_struct({struct})) end"


def _opened(reports: DataFrame, tools: list[str]) -> DataFrame:
    """Each report with its list of diagnostics as ``report``."""
    lists = " ".join(f"when '{tool}' then {json_list_sql('raw', _ARRAYS[tool])}" for tool in tools)
    return reports.selectExpr("file_id", "path", "tool", "raw", f"case tool {lists} end as report")


def rejected_reports(reports: DataFrame, tool: str | None = None) -> DataFrame:
    """Reports that give no findings because they are void: ``file_id``, ``tool``, ``reason``.

    Of the linters with one JSON document a report; clippy's unreadable lines are skipped one by one.
    """
    if tool is not None:
        reports = reports.withColumn("tool", F.lit(tool))
    tools = [name for name in _ARRAYS if tool in (None, name)]
    parsed = _opened(reports.filter(F.col("tool").isin(*tools)), tools)
    reasons = []
    for name in tools:
        keys = key_count_sql("raw", _ARRAYS[name])
        # Only golangci-lint may leave out its list, or give null for it.
        may_miss = f"get_json_object(raw, '$.{_ARRAYS[name]}') is null" if name == "golangci-lint" else "false"
        reasons.append(
            f"when '{name}' then case when report is null and {keys} > 1 then 'repeated key {_ARRAYS[name]}' "
            f"when report is null or {keys} is null then 'not one JSON object' "
            f"when report.items is null then if({may_miss}, null, 'no list {_ARRAYS[name]}') "
            f"when not {_is_sound(name)} then 'unsound diagnostic' end"
        )
    reason = computed_once(F.expr(f"case tool {' '.join(reasons)} end"))
    return parsed.select("file_id", "tool", reason.alias("reason")).filter("reason is not null")


def _document_diagnostics(reports: DataFrame, tools: list[str]) -> DataFrame:
    parsed = _opened(reports, tools)
    by_tool = " ".join(f"when '{tool}' then {_items_sql(tool)}" for tool in tools)
    items = parsed.selectExpr("file_id", "path", "tool", f"posexplode(case tool {by_tool} end) as (seq, d)")
    severity = ruff_severity(F.col("d.code"))
    for tool, default in _DEFAULT_SEVERITY.items():
        severity = F.when(F.col("tool") == tool, report_severity(F.col("d.severity"), default)).otherwise(severity)
    return items.select("file_id", "path", "tool", "seq", severity.alias("severity"), "d.code", "d.message", "d.line")


def _report_lines(batches: Iterator[pa.RecordBatch], messages: bool) -> Iterator[pa.RecordBatch]:
    """The lines of reports in bounded batches, or only those that may be compiler messages.

    Reports are split many at a time. A long one is read line after line and never held as a list of lines.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("raw")), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        short = np.flatnonzero((sizes >= 0) & (sizes <= BATCH_BYTES))
        if len(short):
            parts = np.cumsum(sizes[short]) // BATCH_BYTES
            for rows in np.split(short, np.flatnonzero(np.diff(parts)) + 1):
                yield from _split_lines(batch.take(pa.array(rows)), messages)
        for at in np.flatnonzero(sizes > BATCH_BYTES).tolist():
            yield from _streamed_lines(batch.slice(at, 1), messages)


def _split_lines(reports: pa.RecordBatch, messages: bool) -> Iterator[pa.RecordBatch]:
    listed = pc.split_pattern(reports.column("raw"), "\n")
    owner, text = pc.list_parent_indices(listed).to_numpy(), pc.list_flatten(listed)
    # A report has a line at least, so the first line of each is where its number first occurs.
    seq = np.arange(len(owner)) - np.searchsorted(owner, owner)
    yield from _line_batches(reports, owner, seq, text, messages)


def _streamed_lines(report: pa.RecordBatch, messages: bool) -> Iterator[pa.RecordBatch]:
    data = report.column("raw")[0].as_buffer().to_pybytes()
    seq, place = 0, 0
    while place <= len(data):
        lines, size = [], 0
        while place <= len(data) and len(lines) < LINES_PER_BATCH and size < BATCH_BYTES:
            end = data.find(b"\n", place)
            end = len(data) if end < 0 else end
            lines.append(data[place:end])
            size += end - place
            place = end + 1
        text = pa.array(lines, pa.binary()).cast(pa.string())
        yield from _line_batches(report, np.zeros(len(lines), np.int64), np.arange(seq, seq + len(lines)), text, messages)
        seq += len(lines)


def _line_batches(
    reports: pa.RecordBatch, owner: np.ndarray, seq: np.ndarray, text: pa.Array, messages: bool
) -> Iterator[pa.RecordBatch]:
    kept = np.arange(len(owner))
    if messages:
        # A line names its reason in plain letters, unless some of them are escaped.
        named = pc.or_(pc.match_substring(text, "compiler-message"), pc.match_substring(text, "\\"))
        kept = np.flatnonzero(named.to_numpy(zero_copy_only=False))
    for at in range(0, len(kept), LINES_PER_BATCH):
        rows = kept[at : at + LINES_PER_BATCH]
        owners = pa.array(owner[rows])
        columns = [reports.column("file_id").take(owners), reports.column("path").take(owners), pa.array(seq[rows].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([*columns, text.take(pa.array(rows))], ["file_id", "path", "seq", "raw_line"])


def _clippy_lines(reports: DataFrame, messages: bool = False) -> DataFrame:
    """The lines of reports on Rust files, each with the JSON document it holds, if any; all, or those that may be ``messages``."""
    files = reports.filter(extension(F.col("path")) == "rs")
    lines = files.select("file_id", "path", "raw").mapInArrow(
        lambda batches: _report_lines(batches, messages), "file_id string, path string, seq int, raw_line string"
    )
    return lines.select("file_id", "path", "seq", "raw_line", computed_once(F.expr(json_document_sql("raw_line"))).alias("m"))


def rejected_lines(reports: DataFrame) -> DataFrame:
    """Lines of clippy reports that begin as a message but cannot be read: ``file_id``, ``line`` from 1, ``bytes``, ``reason``.

    Other lines that are no JSON are the build's own output. A line may be unreadable because it exceeds the
    engine's limit of one value; its neighbours are read all the same.
    """
    large = F.col("bytes") > VALUE_BYTES
    lines = _clippy_lines(reports).filter("m is null and raw_line like '{%'")
    measured = lines.select("file_id", (F.col("seq") + 1).alias("line"), F.octet_length("raw_line").cast("bigint").alias("bytes"))
    return measured.withColumn("reason", F.when(large, "larger than one value may be").otherwise("not one JSON value"))


def _clippy_messages(reports: DataFrame) -> DataFrame:
    """Compiler messages of Rust files: one JSON document per line; see ``rejected_lines`` for unreadable ones.

    A build reports on all files of a crate; a message belongs to the report's file when one
    of its spans lies in a file of that name. The line is that of the first span, in any file.
    """
    parsed = _clippy_lines(reports, messages=True).select("file_id", "path", "seq", "m")
    same_name = F.expr(
        "exists(try_variant_get(m, '$.message.spans', 'array<variant>'), "
        f"s -> substring_index({_text('s', '$.file_name')}, '/', -1) = substring_index(path, '/', -1))"
    )
    messages = parsed.filter(F.expr(_text("m", "$.reason")) == "compiler-message")
    messages = messages.filter(F.expr(f"{_text('m', '$.message.message')} is not null")).filter(same_name)
    return messages.select(
        "file_id",
        "path",
        F.lit("clippy").alias("tool"),
        "seq",
        clippy_severity(F.expr(_text("m", "$.message.level"))).alias("severity"),
        F.expr(f"coalesce({_text('m', '$.message.code.code')}, 'CLIPPY')").alias("code"),
        F.expr(_text("m", "$.message.message")).alias("message"),
        F.expr(_count("m", "$.message.spans[0].line_start")).alias("line"),
    )
