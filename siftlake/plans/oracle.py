"""The registered queries in plain SQL, as an independent statement of their results."""

from __future__ import annotations

import json

from siftlake.operators.judge import PROMPT_END, PROMPT_MIDDLE, PROMPT_START
from siftlake.plans import fixtures as fx
from siftlake.plans.suite import JUDGE
from siftlake.sources.builtin import RULE_CATALOGUE, builtin_rules

# Unicode-aware spellings of the classes that this dialect reads as ASCII.
_WORD = r"\p{L}\p{M}\p{Nd}\p{Pc}"
_SPACE = r"[\s\p{Z}\x{85}\x0b]"


def _quote(text: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if text is None else "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_quote(v) for v in values) + "]"


def _portable(pattern: str) -> str:
    return pattern.replace(r"[\w", f"[{_WORD}").replace(r"\w", f"[{_WORD}]").replace(r"\s", _SPACE)


def _rules(rules) -> str:
    rows = ",\n".join(
        f"({n}, {_quote(r.code)}, {_quote(r.severity)}, {_quote(r.message)}, {_quote(r.suggestion)}, {_quote(_portable(r.pattern))})"
        for n, r in enumerate(rules, start=1)
    )
    return f"rules(rule_ord, code, severity, message, suggestion, pattern) AS (VALUES {rows})"


_BUILTIN = _rules(builtin_rules())
_TEXT_RULES = _rules(fx.TEXT_PACK)
_TALK_RULES = _rules(fx.TEXT_PACK + fx.TALK_PACK).replace(r"\bthe\b", rf"(?:^|[^{_WORD}])the(?:$|[^{_WORD}])")
_PAGE_RULES = _rules(builtin_rules() + fx.TEXT_PACK)
_FILTER_RULES = _rules(fx.FILTER_PACK)

_PATH = (
    f"({_list(fx.DIRECTORIES)})[doc_id % 6 + 1] || '/' || ({_list(fx.STEMS)})[(doc_id // 6) % 4 + 1] || '_' || doc_id "
    f"|| ({_list(fx.EXTENSIONS)})[(doc_id // 24) % 10 + 1]"
)
_EXT = r"regexp_extract(path, '(?:^|/)[^/]+\.([^./]*)$', 1)"
_LANGUAGE = (
    f"CASE {_EXT} WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' "
    "WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' END"
)
_NAME = "split_part(path, '/', -1)"
_STEM = rf"regexp_replace({_NAME}, '^(.+)\.[^.]*$', '\1')"

_DOCS = "files AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS language, text, doc_id AS ord FROM documents)"
_PATHS = f"paths AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS file_id, {_PATH} AS path FROM documents)"
_SEEDED = (
    f"seeded AS (SELECT doc_id, text || chr(10) || ({_list(fx.SNIPPETS)})[doc_id % 15 + 1] AS text, {_PATH} AS path FROM documents), "
    f"files AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, path, {_LANGUAGE} AS language, text, doc_id AS ord FROM seeded)"
)
_PAGES = f"files AS (SELECT CAST(page_id AS VARCHAR) AS file_id, url AS path, CAST(NULL AS VARCHAR) AS language, html AS text, page_id AS ord FROM pages)"
_TURNS = "files AS (SELECT conv_id || ':' || turn AS file_id, CAST(NULL AS VARCHAR) AS path, CAST(NULL AS VARCHAR) AS language, text, CAST(NULL AS BIGINT) AS ord FROM conversations)"

# Line feeds before the first match, plus one.
_HITS = (
    "hits AS (SELECT f.file_id, f.path, f.language, f.ord, r.*, "
    "regexp_extract(f.text, '(?s:^(.*?))(?:' || r.pattern || ')', 1) AS lead "
    "FROM files f JOIN rules r ON regexp_matches(f.text, r.pattern){where})"
)
_FOUND = (
    "found AS (SELECT file_id, path, language, ord, 1 AS stage_ord, rule_ord, 'security' AS category, severity, code, message, "
    "CAST(1 + length(lead) - length(replace(lead, chr(10), '')) AS BIGINT) AS line, suggestion FROM hits)"
)
_FINDING = "file_id, rule_ord, severity, code, message, line, suggestion"


def _scan(files: str, rules: str, select: str, where: str = "") -> str:
    return f"WITH {files}, {rules}, {_HITS.format(where=where)}, {_FOUND} {select}"


def _totals(source: str) -> str:
    def penalty(category: str, values: tuple[int, int, int]) -> str:
        error, warning, info = values
        cases = f"CASE severity WHEN 'error' THEN {error}.0 WHEN 'warning' THEN {warning}.0 ELSE {info}.0 END"
        return f"CAST(sum(CASE WHEN category = '{category}' THEN {cases} ELSE 0.0 END) AS DOUBLE)"

    return (
        "totals AS (SELECT file_id, count(*) FILTER (severity = 'error') AS errors, "
        "count(*) FILTER (severity = 'warning') AS warnings, count(*) AS total, "
        "count(*) FILTER (category = 'security') AS n_sec, count(*) FILTER (category = 'performance') AS n_perf, "
        f"count(*) FILTER (category = 'ai_semantic') AS n_ai, {penalty('security', (15, 5, 2))} AS p_sec, "
        f"{penalty('performance', (20, 8, 3))} AS p_perf, {penalty('ai_semantic', (10, 3, 1))} AS p_ai "
        f"FROM {source} GROUP BY file_id)"
    )


_SCORES = (
    "counted AS (SELECT f.file_id, f.path, f.language, f.ord, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, "
    "coalesce(total, 0) AS total, coalesce(n_sec, 0) AS n_sec, coalesce(n_perf, 0) AS n_perf, coalesce(n_ai, 0) AS n_ai, "
    "p_sec, p_perf, p_ai FROM files f LEFT JOIN totals t ON f.file_id = t.file_id), "
    "dims AS (SELECT *, "
    "CASE WHEN n_sec = 0 THEN 100.0 ELSE greatest(0.0, least(100.0, 100.0 - p_sec)) END::DOUBLE AS security, "
    "CASE WHEN total = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(100.0::DOUBLE, "
    "(1.0::DOUBLE - (errors::DOUBLE * 10 + warnings::DOUBLE * 3) / (total::DOUBLE * 10 + 1)) * 100)) END AS code_quality, "
    "CASE WHEN n_perf = 0 THEN 90.0 ELSE greatest(0.0, least(100.0, 100.0 - p_perf)) END::DOUBLE AS performance, "
    f"CASE WHEN contains({_STEM}, 'test') THEN 95.0 WHEN language IN ('go', 'rust') THEN 70.0 "
    "WHEN language IN ('python', 'javascript', 'typescript') THEN 65.0 ELSE 50.0 END::DOUBLE AS test_coverage, "
    "CASE WHEN n_ai = 0 THEN 75.0 ELSE greatest(0.0, least(100.0, 100.0 - p_ai)) END::DOUBLE AS ai_risk FROM counted), "
    "scores AS (SELECT *, 0.35::DOUBLE * security + 0.25::DOUBLE * code_quality + 0.20::DOUBLE * performance "
    "+ 0.10::DOUBLE * test_coverage + 0.10::DOUBLE * ai_risk AS overall FROM dims)"
)
_SEEDED_SCORES = f"WITH {_SEEDED}, {_BUILTIN}, {_HITS.format(where='')}, {_FOUND}, {_totals('found')}, {_SCORES} "

_DOCUMENT_OF_EVENT = "event_id % (SELECT max(doc_id) + 1 FROM documents)"
_EVENT_FINDINGS = (
    f"found AS (SELECT CAST({_DOCUMENT_OF_EVENT} AS VARCHAR) AS file_id, "
    "CASE event_type WHEN 'view' THEN 'performance' WHEN 'error' THEN 'security' WHEN 'purchase' THEN 'ai_semantic' "
    "WHEN 'click' THEN 'lint' ELSE 'best_practice' END AS category, "
    "(['error', 'warning', 'info'])[(event_id // 2000) % 3 + 1] AS severity FROM events)"
)
_EVENT_FILES = f"files AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, path, {_LANGUAGE} AS language, doc_id AS ord FROM (SELECT doc_id, {_PATH} AS path FROM documents))"
_EVENT_SCORES = f"WITH {_EVENT_FILES}, {_EVENT_FINDINGS}, {_totals('found')}, {_SCORES} "


def _r(name: str) -> str:
    return f"round({name}, 6) AS {name}"


_DIMENSIONS = ["security", "code_quality", "performance", "test_coverage", "ai_risk", "overall"]
_ROUNDED = ", ".join(_r(name) for name in _DIMENSIONS)


def _display(value: str) -> str:
    return f"CAST(CAST(round_even({value}, 0) AS BIGINT) AS VARCHAR)"


_GLOB_REGEX = {
    "*.py": r"^[^/]*\.py$",
    "src/*": r"^src/[^/]*$",
    "src/**": r"^src/.*$",
    "**/test/**": r"^(.*/)?test/.*$",
    "**/*.rs": r"^(.*/)?[^/]*\.rs$",
    "lib/m?d_*": r"^lib/m[^/]d_[^/]*$",
    "**/test_*.?s*": r"^(.*/)?test_[^/]*\.[^/]s[^/]*$",
    "**": r"^.*$",
    "*": r"^[^/]*$",
    "pkg/**/latest*": r"^pkg/(.*/)?latest[^/]*$",
}

_RULE_WHERE = (
    " WHERE CASE r.code WHEN 'FILT001' THEN f.language IS NULL OR f.language = 'python' "
    "WHEN 'FILT002' THEN regexp_matches(f.path, '^src/[^/]*$') OR starts_with(f.path, 'lib/') "
    r"WHEN 'FILT003' THEN NOT (regexp_matches(f.path, '^(.*/)?test/.*$') OR regexp_matches(f.path, '\.go$')) "
    "WHEN 'FILT004' THEN f.language IS NULL OR f.language IN ('javascript', 'typescript') "
    r"WHEN 'FILT005' THEN regexp_matches(f.path, '\.py$') OR regexp_matches(f.path, '^(.*/)?[^/]a[^/]*$') "
    r"WHEN 'FILT006' THEN regexp_matches(f.path, '^src/test/main_[^/]\.[^/]*$') END"
)

_CHANGED = (
    "changed AS (SELECT DISTINCT path FROM paths WHERE doc_id % 5 = 0 OR doc_id % 7 = 0), "
    "listed AS (SELECT path FROM changed UNION SELECT 'gone/file_' || doc_id || '.py' FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0)"
)
_IGNORED = "len(list_intersect(string_split(path, '/'), ['.git', 'node_modules', '__pycache__', 'target', 'venv'])) > 0"


def _text_json(field: str) -> str:
    return f"CASE WHEN json_type(d, '{field}') = 'VARCHAR' THEN json_extract_string(d, '{field}') END"


def _optional(field: str, kind: str) -> str:
    return f"coalesce(json_type(d, '{field}'), 'NULL') IN ('NULL', '{kind}')"


_LINT = {
    "ruff": (
        "$.diagnostics",
        "json_type(d, '$.code') = 'VARCHAR' AND json_type(d, '$.message') = 'VARCHAR' AND json_type(d, '$.location.row') = 'UBIGINT'",
        "json_extract_string(d, '$.code')",
        "json_extract_string(d, '$.message')",
        "CAST(json_extract_string(d, '$.location.row') AS BIGINT)",
        "CASE WHEN code[1] IN ('E', 'F') THEN 'error' WHEN code[1] IN ('W', 'B') OR code LIKE 'SIM%' THEN 'warning' ELSE 'info' END",
    ),
    "biome": (
        "$.diagnostics",
        "json_type(d, '$.message') = 'VARCHAR' AND " + _optional("$.code", "VARCHAR") + " AND " + _optional("$.severity", "VARCHAR")
        + " AND " + _optional("$.location", "OBJECT") + " AND " + _optional("$.location.line", "UBIGINT"),
        "coalesce(json_extract_string(d, '$.code'), 'BIOME')",
        "json_extract_string(d, '$.message')",
        "CAST(json_extract_string(d, '$.location.line') AS BIGINT)",
        "CASE WHEN json_extract_string(d, '$.severity') IN ('error', 'warning') THEN json_extract_string(d, '$.severity') ELSE 'error' END",
    ),
    "oxlint": (
        "$.results",
        "json_type(d, '$.message') = 'VARCHAR' AND " + _optional("$.code", "VARCHAR") + " AND " + _optional("$.severity", "VARCHAR")
        + " AND " + _optional("$.line", "UBIGINT") + " AND " + _optional("$.column", "UBIGINT"),
        "coalesce(json_extract_string(d, '$.code'), 'OXLLINT')",
        "json_extract_string(d, '$.message')",
        "CAST(json_extract_string(d, '$.line') AS BIGINT)",
        "CASE WHEN json_extract_string(d, '$.severity') IN ('error', 'warning') THEN json_extract_string(d, '$.severity') ELSE 'error' END",
    ),
    "golangci-lint": (
        "$.issues",
        "json_type(d, '$.text') = 'VARCHAR' AND json_type(d, '$.from_linter') = 'VARCHAR' AND " + _optional("$.severity", "VARCHAR")
        + " AND " + _optional("$.location", "OBJECT") + " AND " + _optional("$.location.line", "UBIGINT"),
        "json_extract_string(d, '$.from_linter')",
        "json_extract_string(d, '$.text')",
        "coalesce(CAST(json_extract_string(d, '$.location.line') AS BIGINT), 1)",
        "CASE WHEN json_extract_string(d, '$.severity') IN ('error', 'warning') THEN json_extract_string(d, '$.severity') ELSE 'info' END",
    ),
}


def _lint_items(tool: str) -> str:
    array, check, code, message, line, severity = _LINT[tool]
    return (
        f"reports AS (SELECT CAST(event_id AS VARCHAR) AS file_id, {fx.REPORT_PATHS[tool]} AS path, {fx.RAW_REPORTS[tool]} AS raw FROM events), "
        f"items AS (SELECT file_id, path, CASE WHEN json_valid(raw) THEN json_extract(raw, '{array}[*]') END AS ds FROM reports), "
        "flat AS (SELECT file_id, path, unnest(ds) AS d, generate_subscripts(ds, 1) - 1 AS seq FROM items), "
        f"checked AS (SELECT *, bool_and(coalesce({check}, false)) OVER (PARTITION BY file_id) AS sound FROM flat), "
        f"lint AS (SELECT file_id, path, CAST(seq AS BIGINT) AS seq, {severity} AS severity, code, {message} AS message, {line} AS line "
        f"FROM (SELECT *, {code} AS code FROM checked WHERE sound))"
    )


_CLIPPY = (
    f"WITH reports AS (SELECT CAST(event_id AS VARCHAR) AS file_id, {fx.REPORT_PATHS['clippy']} AS path, {fx.RAW_REPORTS['clippy']} AS raw FROM events), "
    "lines AS (SELECT file_id, path, string_split(raw, chr(10)) AS ls FROM reports WHERE path LIKE '%.rs'), "
    "flat AS (SELECT file_id, path, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS seq FROM lines), "
    "docs AS (SELECT file_id, path, seq, CASE WHEN json_valid(l) THEN CAST(l AS JSON) END AS d FROM flat) "
    "SELECT file_id, path, CAST(seq AS BIGINT) AS seq, CASE coalesce(json_extract_string(d, '$.message.level'), 'warning') "
    "WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'info' END AS severity, "
    "coalesce(json_extract_string(d, '$.message.code.code'), 'CLIPPY') AS code, json_extract_string(d, '$.message.message') AS message, "
    "CAST(json_extract_string(d, '$.message.spans[0].line_start') AS BIGINT) AS line FROM docs "
    "WHERE json_extract_string(d, '$.reason') = 'compiler-message' AND (split_part(path, '/', -1) = "
    "split_part(json_extract_string(d, '$.message.spans[0].file_name'), '/', -1) OR split_part(path, '/', -1) = "
    "split_part(json_extract_string(d, '$.message.spans[1].file_name'), '/', -1))"
)

_ANSWERS = (
    f"answers AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, {_PATH} AS path, CASE WHEN json_valid({fx.RAW_RESPONSE}) THEN "
    f"CASE WHEN {fx.RESPONSE_PROVIDER} = 'anthropic' THEN json_extract_string({fx.RAW_RESPONSE}, '$.content[0].text') "
    f"ELSE json_extract_string({fx.RAW_RESPONSE}, '$.choices[0].message.content') END END AS ai_explanation "
    f"FROM documents WHERE {fx.RESPONSE_STATUS} BETWEEN 200 AND 299)"
)

_PROMPT = (
    f"{_quote(PROMPT_START)} || coalesce(language, 'unknown') || {_quote(PROMPT_MIDDLE)} "
    f"|| substring(text, chunk * {JUDGE.max_input_chars} + 1, {JUDGE.max_input_chars}) || {_quote(PROMPT_END)}"
)
_CHUNKS = (
    f"chunks AS (SELECT *, CAST(unnest(generate_series(0, (greatest(length(text), 1) - 1) // {JUDGE.max_input_chars})) AS INTEGER) AS chunk "
    "FROM files WHERE text IS NOT NULL)"
)

# The union of all stages; the linter's reports are keyed by event and given to one document each.
_ALL_FOUND = (
    f"WITH {_SEEDED}, {_BUILTIN}, {_HITS.format(where='')}, {_FOUND.replace('found AS', 'scanned AS')}, {_lint_items('ruff')}, {_ANSWERS}, "
    "found AS (SELECT file_id, stage_ord, category, severity, code FROM scanned UNION ALL "
    f"SELECT CAST({_DOCUMENT_OF_EVENT} AS VARCHAR), 0, 'lint', severity, code FROM (SELECT CAST(file_id AS BIGINT) AS event_id, * FROM lint) UNION ALL "
    "SELECT file_id, 2, 'ai_semantic', 'info', 'SEM001' FROM answers WHERE ai_explanation IS NOT NULL)"
)

_VERSION_HITS = (
    f"versions AS (SELECT doc_id, text || chr(10) || ({_list(fx.SNIPPETS)})[doc_id % 15 + 1] AS text, "
    "'src/file_' || (doc_id % 97) || '.py' AS path FROM documents), "
    "files AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, path, 'python' AS language, text, doc_id AS ord FROM versions v WHERE newest)"
)

_PACK_STATE = (
    f"packs AS (SELECT CAST(p_partkey % 3 AS INTEGER) AS dir_ord, p_partkey || '.json' AS path, {fx.RAW_PACK} AS raw, *, "
    "p_partkey % 23 = 0 OR (p_partkey % 3 <> 0 AND p_partkey % 19 = 0) OR (p_partkey % 13 <> 0 AND p_partkey % 17 = 0) AS bad_format, "
    "p_partkey % 13 <> 0 AND (p_partkey % 7 = 0 OR p_partkey % 11 = 0) AS bad_pattern FROM part)"
)

_JSON_FINDING = (
    "to_json({'category': category, 'severity': severity, 'code': code, 'message': message, 'file': f.path, 'line': line, "
    "'column': NULL, 'suggestion': suggestion, 'ai_explanation': NULL})"
)
_RULE_ID = (
    "CAST(floor(length(code) + rule_ord / 4) AS BIGINT)"
)


def _sarif() -> str:
    result = (
        """'{"ruleId":"' || code || '","level":"' || CASE severity WHEN 'info' THEN 'note' ELSE severity END || '","message":{"text":' """
        """|| to_json(message) || '},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"' || path || '"},"region":{"startLine":' """
        """|| line || '}}}]}'"""
    )
    rule = (
        """'{"id":"' || code || '","shortDescription":{"text":"' || code || '"},"fullDescription":{"text":' || to_json(message) || '}}'"""
    )
    start = '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"siftlake","version":"0.1.0","rules":['
    return _scan(
        _SEEDED,
        _BUILTIN,
        f", rendered AS (SELECT {_RULE_ID} AS log, file_id, rule_ord, {result} AS result, {rule} AS rule FROM found) "
        f"SELECT log, CAST(0 AS BIGINT) AS part, {_quote(start)} || string_agg(DISTINCT rule, ',' ORDER BY rule) || ']}}}},\"results\":[' "
        "|| string_agg(result, ',' ORDER BY file_id, rule_ord) || ']}]}' AS sarif FROM rendered GROUP BY log",
    ).replace("]}}}},", "]}},")


_LOC = "coalesce(path, file_id)"
_TEXT = _SEEDED_SCORES + (
    ", summary AS (SELECT count(*) AS files, sum(total) AS total, sum(errors) AS errors, sum(warnings) AS warnings FROM scores) "
    "SELECT 0 AS section, CAST(0 AS BIGINT) AS ord, number, text FROM (SELECT 0 AS number, '  Code audit report' AS text FROM summary "
    "UNION ALL SELECT 1, '  Files analyzed: ' || files FROM summary UNION ALL SELECT 2, '  Total findings: ' || total FROM summary "
    "UNION ALL SELECT 3, '  ✗ ' || errors || ' error(s)' FROM summary WHERE errors > 0 "
    "UNION ALL SELECT 4, '  ⚠ ' || warnings || ' warning(s)' FROM summary WHERE warnings > 0 "
    "UNION ALL SELECT 5, '  ✓ No issues found!' FROM summary WHERE total = 0) "
    f"UNION ALL SELECT 1, ord, 0, '  📊 Scores for ' || path || ': ' || {_display('overall')} || '/100' || "
    f"CASE WHEN security < 70 THEN ' (security:' || {_display('security')} || '!)' ELSE '' END FROM scores "
    "UNION ALL SELECT 2, ord, 0, '  ' || path || ':' FROM scores WHERE total > 0 "
    "UNION ALL SELECT 2, ord, 0, '  ' || path || ':' || line || ' [' || CASE severity WHEN 'error' THEN 'ERROR' WHEN 'warning' THEN 'WARN' "
    "ELSE 'INFO' END || '] ' || code || ' ' || message FROM found "
    "UNION ALL SELECT 2, ord, 1, '    → ' || suggestion FROM found WHERE suggestion IS NOT NULL"
)

# The same lines with the place of their finding, to be numbered in order.
_ORDERED = (
    _TEXT.replace(") SELECT 0 AS section, CAST(0 AS BIGINT) AS ord,", "), report AS (SELECT 0 AS section, CAST(0 AS BIGINT) AS ord, -1 AS item,")
    .replace("SELECT 1, ord, 0,", "SELECT 1, ord, -1, 0,")
    .replace("SELECT 2, ord, 0, '  ' || path || ':' FROM", "SELECT 2, ord, -1, 0, '  ' || path || ':' FROM")
    .replace("SELECT 2, ord, 0, '  ' || path || ':' || line", "SELECT 2, ord, rule_ord, 0, '  ' || path || ':' || line")
    .replace("SELECT 2, ord, 1,", "SELECT 2, ord, rule_ord, 1,")
    + ") SELECT row_number() OVER (ORDER BY section, ord, item, number) AS line, text FROM report"
)

ORACLE_SQL: dict[str, str] = {
    "scan_documents": _scan(_DOCS, _BUILTIN, f"SELECT {_FINDING} FROM found"),
    "scan_pages_pack": _scan(_PAGES, _PAGE_RULES, f"SELECT path, {_FINDING} FROM found"),
    "scan_conversations_pack": _scan(_TURNS, _TALK_RULES, f"SELECT {_FINDING} FROM found"),
    "scan_documents_pack": _scan(_DOCS, _TEXT_RULES, f"SELECT {_FINDING} FROM found"),
    "scan_seeded": _scan(_SEEDED, _BUILTIN, f"SELECT path, stage_ord, category, {_FINDING} FROM found"),
    "scan_lines": _scan(
        _SEEDED,
        _BUILTIN,
        "SELECT rule_ord, count(*) AS hits, min(line) AS first_line, max(line) AS last_line, CAST(sum(line) AS BIGINT) AS line_sum "
        "FROM found GROUP BY rule_ord",
    ),
    "scan_loaded_packs": _scan(
        _DOCS,
        _BUILTIN + ", sources AS (SELECT DISTINCT source, substr(source, 4) AS number FROM documents)",
        ", numbered AS (SELECT f.file_id, upper(s.source) AS code, regexp_extract(f.text, '(?s:^(.*?))(?:[^0-9]' || s.number || '[^0-9])', 1) "
        "AS lead FROM files f JOIN sources s ON regexp_matches(f.text, '[^0-9]' || s.number || '[^0-9]')) "
        "SELECT file_id, code, severity, line FROM found UNION ALL SELECT file_id, code, 'info', "
        "CAST(1 + length(lead) - length(replace(lead, chr(10), '')) AS BIGINT) FROM numbered",
    ),
    "scan_many_rules": _scan(
        _DOCS,
        _BUILTIN + ", words AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(text, '[a-z]{7,}'))) AS word FROM benchmark)",
        ", worded AS (SELECT f.file_id, w.item_id || '-' || w.word AS code, regexp_extract(f.text, '(?s:^(.*?))(?:[^a-z]' || w.word || '[^a-z])', 1) "
        "AS lead FROM files f JOIN words w ON contains(f.text, w.word) AND regexp_matches(f.text, '[^a-z]' || w.word || '[^a-z]')) "
        "SELECT file_id, code, severity, line FROM found UNION ALL SELECT file_id, code, 'warning', "
        "CAST(1 + length(lead) - length(replace(lead, chr(10), '')) AS BIGINT) FROM worded",
    ),
    "rule_filters": _scan(_SEEDED, _FILTER_RULES, f"SELECT {_FINDING} FROM found", _RULE_WHERE),
    "decode_texts": f"WITH {_DOCS}, {_BUILTIN}, {_HITS.format(where=' WHERE f.ord % 10 <> 0')}, {_FOUND} "
    "SELECT f.file_id, f.ord % 10 <> 0 AS readable, count(g.file_id) AS total FROM files f "
    "LEFT JOIN found g ON f.file_id = g.file_id GROUP BY f.file_id, f.ord",
    "language_detect": f"WITH {_PATHS} SELECT path, {_EXT} AS extension, {_STEM} AS stem, {_LANGUAGE} AS language, "
    f"CASE {_LANGUAGE} WHEN 'python' THEN 'Python' WHEN 'javascript' THEN 'JavaScript' WHEN 'typescript' THEN 'TypeScript' "
    f"WHEN 'go' THEN 'Go' WHEN 'rust' THEN 'Rust' END AS display, CASE {_LANGUAGE} WHEN 'python' THEN 'ruff' "
    "WHEN 'javascript' THEN 'biome' WHEN 'typescript' THEN 'biome' WHEN 'go' THEN 'golangci-lint' WHEN 'rust' THEN 'clippy' END AS linter FROM paths",
    "language_counts": f"WITH {_PATHS} SELECT language, count(*) AS files FROM (SELECT {_LANGUAGE} AS language FROM paths) "
    "WHERE language IS NOT NULL GROUP BY language",
    "language_extensions": f"WITH {_PATHS}, listed(extension, language, display, wire, linter) AS (VALUES ('py', 'python', 'Python', 'python', 'ruff'), "
    "('js', 'javascript', 'JavaScript', 'java_script', 'biome'), ('jsx', 'javascript', 'JavaScript', 'java_script', 'biome'), "
    "('ts', 'typescript', 'TypeScript', 'type_script', 'biome'), ('tsx', 'typescript', 'TypeScript', 'type_script', 'biome'), "
    "('go', 'go', 'Go', 'go', 'golangci-lint'), ('rs', 'rust', 'Rust', 'rust', 'clippy')) "
    f"SELECT l.language, display, wire, linter, extension, (SELECT count(*) FROM paths WHERE {_EXT} = l.extension) AS files FROM listed l",
    "language_include": f"WITH {_PATHS} SELECT path, {_LANGUAGE} AS language FROM paths WHERE {_LANGUAGE} IN ('go', 'rust')",
    "ignore_filter": f"WITH {_PATHS} SELECT file_id, path FROM paths WHERE NOT ({_IGNORED})",
    "glob_filter": f"WITH {_PATHS} SELECT path, "
    + ", ".join(f"regexp_matches(path, {_quote(_GLOB_REGEX[glob])}) AS glob_{at}" for at, glob in enumerate(fx.GLOBS))
    + " FROM paths",
    "changed_union": f"WITH {_PATHS}, {_CHANGED} SELECT path FROM listed",
    "changed_semi": f"WITH {_PATHS}, {_CHANGED} SELECT file_id, path FROM paths WHERE path IN (SELECT path FROM changed)",
    "changed_scan": _scan(
        _SEEDED,
        _BUILTIN,
        "SELECT path, rule_ord, line FROM found",
        " WHERE f.language IS NOT NULL AND (f.ord % 5 = 0 OR f.ord % 7 = 0)",
    ),
    "changed_fallback": _scan(
        _SEEDED,
        _BUILTIN,
        f"SELECT path, rule_ord, line FROM found WHERE NOT ({_IGNORED})",
        " WHERE f.language IS NOT NULL",
    ),
    "source_tree_scan": _scan(
        _SEEDED,
        _BUILTIN,
        f"SELECT path, rule_ord, line FROM found WHERE NOT ({_IGNORED})",
        " WHERE f.language IS NOT NULL",
    ),
    "tree_targets": f"WITH {_SEEDED}, supported AS (SELECT path, language, length(text) AS chars FROM files WHERE language IS NOT NULL) "
    f"SELECT 0 AS target, * FROM supported WHERE NOT ({_IGNORED}) "
    f"UNION ALL SELECT unnest([1, 2]), * FROM supported WHERE starts_with(path, '{fx.DIRECTORIES[0]}/') "
    f"UNION ALL SELECT 3, * FROM supported WHERE path = '{fx.FIRST_FILE}'",
    "file_counts": _SEEDED_SCORES + "SELECT file_id, errors, warnings, total FROM scores",
    "event_counts": _EVENT_SCORES + "SELECT file_id, errors, warnings, total FROM scores",
    "score_quality": _EVENT_SCORES + f"SELECT file_id, {_r('code_quality')} FROM scores",
    "score_security": _EVENT_SCORES + f"SELECT file_id, {_r('security')} FROM scores",
    "score_performance": _EVENT_SCORES + f"SELECT file_id, {_r('performance')} FROM scores",
    "score_tests": _EVENT_SCORES + f"SELECT file_id, {_r('test_coverage')} FROM scores",
    "score_ai": _EVENT_SCORES + f"SELECT file_id, {_r('ai_risk')} FROM scores",
    "score_overall": _EVENT_SCORES + f"SELECT file_id, {_r('overall')} FROM scores",
    "score_seeded": _SEEDED_SCORES + f"SELECT file_id, {_ROUNDED} FROM scores",
    "worst_file": _EVENT_SCORES + f"SELECT file_id, path, {_r('overall')} FROM scores ORDER BY scores.overall, ord LIMIT 1",
    "critical_threshold": _EVENT_SCORES.replace(
        _DOCUMENT_OF_EVENT,
        f"CASE WHEN event_id % 2 = 0 THEN {_DOCUMENT_OF_EVENT} ELSE ({_DOCUMENT_OF_EVENT}) * ({_DOCUMENT_OF_EVENT}) "
        "// (SELECT max(doc_id) + 1 FROM documents) END",
    )
    + f"SELECT file_id, path, security, 'security score ' || {_display('security')} || ' below critical threshold' AS message "
    "FROM (SELECT * FROM scores ORDER BY overall, ord LIMIT 1) WHERE security < 50",
    "threshold_violations": _SEEDED_SCORES
    + ", checks AS (SELECT file_id, path, 'security' AS dimension, security AS value, 70.0::DOUBLE AS lim FROM scores UNION ALL "
    "SELECT file_id, path, 'code_quality', code_quality, 60.0 FROM scores UNION ALL SELECT file_id, path, 'overall', overall, 50.0 FROM scores) "
    f"SELECT file_id, dimension, {_r('value')}, lim AS \"limit\", path || ': ' || dimension || ' ' || {_display('checks.value')} "
    f"|| ' < threshold ' || {_display('lim')} AS message FROM checks WHERE checks.value < lim",
    "gate_outcome": _SEEDED_SCORES
    + ", sums AS (SELECT count(*) AS files, CAST(sum(total) AS BIGINT) AS findings, CAST(sum(errors) AS BIGINT) AS errors, "
    "CAST(sum(warnings) AS BIGINT) AS warnings, CAST(sum((security < 70)::INT + (code_quality < 60)::INT + (overall < 50)::INT) AS BIGINT) "
    "AS violations FROM scores) SELECT *, CASE WHEN errors > 0 THEN 'fail_errors' WHEN violations > 0 THEN 'fail_thresholds' ELSE 'pass' END "
    "AS outcome FROM sums",
    "corpus_summary": _EVENT_SCORES
    + "SELECT count(*) AS files, CAST(sum(total) AS BIGINT) AS findings, CAST(sum(errors) AS BIGINT) AS errors, "
    "CAST(sum(warnings) AS BIGINT) AS warnings FROM scores",
    "ci_outputs": _SEEDED_SCORES
    + "SELECT CAST(sum(total) AS BIGINT) AS findings, CAST(sum(errors) AS BIGINT) AS errors, CASE WHEN sum(errors) > 0 OR "
    "count(*) FILTER (security < 70 OR code_quality < 60 OR overall < 50) > 0 THEN 'fail' ELSE 'pass' END AS result FROM scores",
    "findings_union": _ALL_FOUND
    + " SELECT stage_ord, category, severity, code, count(*) AS findings, CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END "
    "AS severity_rank, severity = 'error' AS is_error, category = 'security' AS is_security FROM found GROUP BY ALL",
    "full_scores": _ALL_FOUND
    + f", {_totals('found')}, {_SCORES} SELECT file_id, errors, warnings, total, {_r('code_quality')}, {_r('overall')} FROM scores",
    "unmatched_lint": f"WITH {_lint_items('ruff')} SELECT CAST(file_id AS BIGINT) IN (SELECT doc_id FROM documents) AS has_file, "
    "code, severity, count(*) AS findings FROM lint GROUP BY ALL",
    "low_scores": _SEEDED_SCORES
    + f"SELECT file_id, path, total, {_r('security')}, {_r('overall')} FROM scores WHERE overall < 60 OR security < 70",
    "sarif_results": _scan(
        _SEEDED,
        _BUILTIN,
        "SELECT file_id, stage_ord, rule_ord, code AS rule_id, CASE severity WHEN 'info' THEN 'note' ELSE severity END AS level, message, "
        "path AS uri, line AS start_line, CAST(NULL AS BIGINT) AS start_column FROM found",
    ),
    "sarif_rules": _scan(_SEEDED, _BUILTIN, "SELECT DISTINCT code AS id, message AS description FROM found"),
    "sarif_logs": _sarif(),
    "findings_table": _scan(
        _SEEDED, _BUILTIN, "SELECT file_id, path, code, severity, line FROM found WHERE CAST(file_id AS BIGINT) % 5 <> 0 OR severity = 'error'"
    ),
    "diagnostics": _scan(
        _SEEDED,
        _BUILTIN,
        "SELECT file_id, path, stage_ord, rule_ord, line - 1 AS line, '[' || code || '] ' || message AS message, "
        "CASE severity WHEN 'info' THEN 'information' ELSE severity END AS severity, code, 'Suggestion: ' || suggestion AS related FROM found",
    ),
    "json_report": _SEEDED_SCORES
    + f", lists AS (SELECT file_id, list({_JSON_FINDING} ORDER BY rule_ord) AS items FROM found f GROUP BY file_id) "
    "SELECT s.file_id, CAST(0 AS BIGINT) AS part, '{\"path\":' || to_json(s.path) || ',\"language\":' || "
    "coalesce(to_json(CASE language WHEN 'javascript' THEN 'java_script' WHEN 'typescript' THEN 'type_script' ELSE language END), 'null') "
    "|| ',\"findings\":[' || coalesce(array_to_string(items, ','), '') || '],\"scores\":' || "
    "to_json({" + ", ".join(f"'{name}': round({name}, 6)" for name in _DIMENSIONS) + "}) || '}' AS json "
    "FROM scores s LEFT JOIN lists l ON s.file_id = l.file_id",
    "run_summary": _SEEDED_SCORES
    + ", worst AS (SELECT * FROM scores ORDER BY overall, ord LIMIT 1) SELECT "
    "'{\"stages_completed\":[\"Preprocess\",\"Security\",\"Aggregate\"],\"total_findings\":' || (SELECT sum(total) FROM scores) || "
    "',\"failed_thresholds\":[' || (SELECT CASE WHEN security < 50 THEN '\"security score ' || "
    + _display("security")
    + " || ' below critical threshold\"' ELSE '' END FROM worst) || '],\"exit_code\":0}' AS json",
    "text_report": _TEXT,
    "ordered_report": _ORDERED,
    "score_bands": _EVENT_SCORES
    + "SELECT file_id, CASE WHEN overall >= 80 THEN 'green' WHEN overall >= 60 THEN 'yellow' ELSE 'red' END AS band, "
    "security < 70 AS security_flag FROM scores",
    "rule_listing": _scan(
        _SEEDED,
        _BUILTIN,
        ", listed(code, name, description) AS (VALUES "
        + ", ".join(f"({', '.join(_quote(v) for v in row)})" for row in RULE_CATALOGUE)
        + ") SELECT l.code, l.name, l.description, count(f.code) AS findings FROM listed l LEFT JOIN found f ON l.code = f.code GROUP BY ALL",
    ),
    "pack_summary": f"WITH {_PACK_STATE} SELECT path, 'pack-' || p_partkey AS name, CASE WHEN p_partkey % 3 = 0 THEN '2.1' ELSE '0.1.0' END "
    "AS version, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END AS description, CASE WHEN p_partkey % 13 = 0 THEN 0 "
    "WHEN p_partkey % 5 = 0 THEN 2 ELSE 1 END AS rules FROM packs WHERE NOT bad_format AND NOT bad_pattern",
    "pack_rules": f"WITH {_PACK_STATE}, flat AS (SELECT *, unnest(json_extract(raw, '$.rules[*]')) AS d, "
    "generate_subscripts(json_extract(raw, '$.rules[*]'), 1) - 1 AS pos FROM packs WHERE NOT bad_format AND NOT bad_pattern) "
    "SELECT dir_ord, path, 'pack-' || p_partkey AS pack, CAST(pos AS INTEGER) AS at, json_extract_string(d, '$.code') AS code, "
    "json_extract_string(d, '$.pattern') AS pattern, CASE lower(coalesce(json_extract_string(d, '$.severity'), 'warning')) "
    "WHEN 'error' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'info' END AS severity, "
    "CAST(coalesce(json_array_length(d, '$.languages'), 0) AS INTEGER) AS n_languages FROM flat",
    "pack_totals": f"WITH {_PACK_STATE} SELECT count(*) AS packs, CAST(sum(CASE WHEN p_partkey % 13 = 0 THEN 0 WHEN p_partkey % 5 = 0 THEN 2 "
    "ELSE 1 END) AS BIGINT) AS rules FROM packs WHERE NOT bad_format AND NOT bad_pattern",
    "pack_dirs": f"WITH {_PACK_STATE}, placed AS (SELECT *, CASE dir_ord WHEN 1 THEN 0 WHEN 0 THEN 2 ELSE 3 END AS place FROM packs) "
    "SELECT place AS dir_ord, path, unnest(json_extract_string(raw, '$.rules[*].code')) AS code, CAST(NULL AS BOOLEAN) AS bad_format "
    "FROM placed WHERE NOT bad_format AND NOT bad_pattern "
    "UNION ALL SELECT place, path, NULL, bad_format FROM placed WHERE bad_format OR bad_pattern "
    "UNION ALL SELECT 0, 'example-rules.json', NULL, false",
    "pack_rejected": f"WITH {_PACK_STATE} SELECT path, bad_format FROM packs WHERE bad_format OR bad_pattern",
    **{
        name: f"WITH {_lint_items(tool)} SELECT file_id, path, seq, severity, code, message, line FROM lint"
        for name, tool in {
            "lint_ruff": "ruff",
            "lint_biome": "biome",
            "lint_oxlint": "oxlint",
            "lint_golangci": "golangci-lint",
        }.items()
    },
    "lint_clippy": _CLIPPY,
    "prompts": f"WITH {_SEEDED}, {_CHUNKS} SELECT file_id, path, chunk, {_PROMPT} AS prompt FROM chunks",
    "request_bodies": f"WITH {_SEEDED}, {_CHUNKS} SELECT file_id, chunk, '{JUDGE.provider}' AS provider, '{{\"max_tokens\":{JUDGE.max_tokens},"
    f"\"messages\":[{{\"content\":' || to_json({_PROMPT}) || ',\"role\":\"user\"}}],\"model\":{json.dumps(JUDGE.model)}}}' AS body FROM chunks",
    "judge_findings": f"WITH {_ANSWERS} SELECT file_id, path, 'info' AS severity, 'SEM001' AS code, 'AI semantic review completed' AS message, "
    "ai_explanation FROM answers WHERE ai_explanation IS NOT NULL",
    "rejected_responses": f"SELECT CAST(doc_id AS VARCHAR) AS file_id, {fx.RESPONSE_PROVIDER} AS provider, CASE WHEN doc_id % 10 = 3 THEN 'status 429' "
    "WHEN doc_id % 9 = 0 THEN 'not one JSON value' ELSE 'no answer text' END AS reason FROM documents "
    "WHERE doc_id % 10 = 3 OR doc_id % 9 = 0 OR NOT CASE WHEN doc_id % 4 < 2 THEN doc_id % 2 = 0 AND doc_id % 8 <> 0 ELSE doc_id % 2 = 1 END",
    "custom_finder": "WITH counted AS (SELECT CAST(doc_id AS VARCHAR) AS file_id, contains(text, 'system') AS refused, "
    "length(text) - length(replace(text, chr(10), '')) + 1 AS n FROM documents) "
    "SELECT file_id, CASE WHEN NOT refused THEN 'warning' END AS severity, CASE WHEN NOT refused THEN 'LONG' END AS code, "
    "CASE WHEN NOT refused THEN n || ' lines' END AS message, CAST(CASE WHEN NOT refused THEN 51 END AS BIGINT) AS line, "
    "CASE WHEN refused THEN 'refused' END AS finder_error FROM counted WHERE refused OR n > 50",
    "stream_scan": _scan(_VERSION_HITS.replace("WHERE newest", ""), _BUILTIN, f"SELECT path, {_FINDING} FROM found"),
    "stream_latest": _scan(
        _VERSION_HITS.replace("newest", "doc_id = (SELECT max(doc_id) FROM versions w WHERE w.path = v.path)"),
        _BUILTIN,
        "SELECT path, file_id, rule_ord, line FROM found",
    ),
    "stream_expiring": _scan(
        _VERSION_HITS.replace("(doc_id % 97)", "(doc_id % 97 + doc_id // 400 * 97)").replace(
            "newest", "doc_id = (SELECT max(doc_id) FROM versions w WHERE w.path = v.path) AND doc_id >= (SELECT max(doc_id) - 600 FROM versions)"
        ),
        _BUILTIN,
        "SELECT path, file_id, rule_ord, line FROM found",
    ),
}
