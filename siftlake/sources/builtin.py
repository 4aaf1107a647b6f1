"""The built-in rule catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlake.model import LANGUAGES, Rule

# Code, severity, pattern, message and suggestion of each rule, in scan order.
_RULES = [
    (
        "SEC001",
        "error",
        r"""(?i)(?:execute|query|exec)\s*\(\s*['"].*SELECT\s+.*['"]\s*\+""",
        "Potential SQL injection: string concatenation in query",
        "Use parameterized queries instead",
    ),
    (
        "SEC001",
        "error",
        r"""(?i)(?:execute|query|exec)\s*\(f['"]""",
        "Potential SQL injection: f-string in query",
        "Use parameterized queries instead",
    ),
    (
        "SEC002",
        "error",
        r"(?i)innerHTML\s*=",
        "Potential XSS: setting innerHTML",
        "Use textContent or a sanitization library",
    ),
    (
        "SEC002",
        "warning",
        r"(?i)document\.write\s*\(",
        "Potential XSS: document.write()",
        "Use DOM manipulation methods instead",
    ),
    (
        "SEC003",
        "error",
        r"""(?i)(?:api[_-]?key|secret[_-]?key|password|token)\s*[:=]\s*['"]\w{8,}['"]""",
        "Possible hardcoded secret detected",
        "Use environment variables or a secrets manager",
    ),
    (
        "SEC003",
        "error",
        r"(?:AKIA|sk-[a-zA-Z0-9]{20,})",
        "Possible AWS/access key detected",
        "Move credentials to environment variables",
    ),
    (
        "SEC004",
        "warning",
        r"(?i)md5(?:hash|sum|5)?\s*\(",
        "Weak hash function (MD5) detected",
        "Use SHA-256 or bcrypt for password hashing",
    ),
    (
        "SEC004",
        "warning",
        r"(?i)DES(?:ede)?\s*(?:Encrypt|Cipher|\.new)",
        "Weak encryption algorithm (DES) detected",
        "Use AES-256-GCM instead",
    ),
    (
        "SEC005",
        "warning",
        r"(?i)print\s*\(.*(?:password|secret|token|key)",
        "Debug print may leak sensitive data",
        "Remove debug prints before committing",
    ),
    (
        "SEC006",
        "error",
        r"(?i)eval\s*\(",
        "eval() is dangerous — potential code injection",
        "Use JSON.parse() or a safe alternative",
    ),
    (
        "SEC007",
        "error",
        r"(?i)(?:subprocess|exec|system|popen|os\.system).*\+",
        "Potential command injection: string concatenation",
        "Use parameterized APIs or whitelist inputs",
    ),
    (
        "SEC008",
        "error",
        r"(?i)(?:\.\./|\\\.\.|%2e%2e)",
        "Potential path traversal vulnerability",
        "Validate and sanitize user-provided paths",
    ),
    (
        "SEC009",
        "error",
        r"(?i)(?:http[s]?://|ftp://).*\$\w+",
        "Potential SSRF: dynamic URL construction",
        "Validate URLs against an allowlist",
    ),
]

# Code, name and description of each listed rule.
RULE_CATALOGUE = [
    ("SEC001", "Potential SQL injection", "String concatenation in queries"),
    ("SEC002", "Potential XSS", "innerHTML, document.write"),
    ("SEC003", "Hardcoded secrets", "API keys, passwords, tokens in source"),
    ("SEC004", "Weak cryptography", "MD5, DES algorithms"),
    ("SEC005", "Debug logging leaks", "Print statements with sensitive data"),
    ("SEC006", "Unsafe eval", "eval() usage"),
    ("SEC007", "Command injection", "String concat in subprocess/system calls"),
    ("SEC008", "Path traversal", ".. or %2e%2e patterns"),
    ("SEC009", "SSRF", "Dynamic URL construction"),
]

# Forms of the rules containing ``.*`` that visit every line once. The plain patterns retry
# the rest of the line from every occurrence of their first word, which takes quadratic time on
# a long line. In a line, only the first such word counts: whatever may follow a later one also
# follows the first. So each form starts at a line start and commits to the first word. White
# space inside the leading part may reach over a line end; that case is a separate alternative,
# and a line can be entered that way only once. Both report the same line as the plain pattern.
_GAP = r"[^\S\n]*+"
_SQL_CALL = r"(?:execute|query|exec)"
_SQL_SAME_LINE = rf"^(?>.*?{_SQL_CALL}{_GAP}\({_GAP}['\"])"
_SQL_NEXT_LINE = rf"{_SQL_CALL}(?:{_GAP}\n\s*+\(\s*+['\"]|{_GAP}\({_GAP}\n\s*+['\"])"
_SQL_REST = r"(?:(?>.*?SELECT[^\S\n]++)|.*SELECT[^\S\n]*+\n\s*+).*['\"]\s*+\+"
_LEAKED = r".*(?:password|secret|token|key)"
_LINEAR_FORMS = {
    1: rf"(?m)(?:{_SQL_SAME_LINE}|{_SQL_NEXT_LINE}){_SQL_REST}",
    9: rf"(?m)(?:^(?>.*?print{_GAP}\()|print{_GAP}\n\s*+\(){_LEAKED}",
    11: r"(?m)^(?>.*?(?:subprocess|exec|system|popen)).*\+",
    13: r"(?m)^(?>.*?(?:https?://|ftp://)).*\$\w",
}


def builtin_rules() -> list[Rule]:
    """The built-in rules in scan order."""
    return [
        Rule(code, pattern, severity, message, suggestion, linear=_LINEAR_FORMS.get(number))
        for number, (code, severity, pattern, message, suggestion) in enumerate(_RULES, start=1)
    ]


def rule_catalogue(spark: SparkSession) -> DataFrame:
    """The rule listing: one row per code."""
    return spark.createDataFrame(RULE_CATALOGUE, "code string, name string, description string")


def language_table(spark: SparkSession) -> DataFrame:
    """The supported languages with their display name, extensions and default linter."""
    rows = [(r.name, r.display, r.wire, list(r.extensions), r.linter) for r in LANGUAGES]
    return spark.createDataFrame(
        rows, "language string, display string, wire string, extensions array<string>, linter string"
    )


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as a table, numbered in scan order."""
    rows = [
        (number, r.pack, r.code, r.pattern, r.severity, r.message, r.suggestion)
        + (list(r.languages), list(r.include), list(r.exclude))
        for number, r in enumerate(rules, start=1)
    ]
    return spark.createDataFrame(
        rows,
        "rule_ord int, pack string, code string, pattern string, severity string, message string, "
        "suggestion string, languages array<string>, include array<string>, exclude array<string>",
    )
