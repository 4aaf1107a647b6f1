"""Record shapes and fixed values shared by every module.

Files, rules and findings are plain tables. ``FILES``, ``FINDINGS`` and ``TOTALS``
name their columns; everything else in the package takes and returns DataFrames
of these shapes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

FILES = "file_id string, path string, language string, text string, ord bigint"

FINDINGS = (
    "file_id string, path string, stage_ord int, rule_ord int, seq bigint, "
    "category string, severity string, code string, message string, "
    "line bigint, column bigint, suggestion string, ai_explanation string"
)
FINDING_COLUMNS = [part.split()[0] for part in FINDINGS.split(", ")]

# Columns a file is scored from: counts of all findings and penalty sums per category.
TOTAL_COLUMNS = [
    "errors",
    "warnings",
    "total",
    "security_count",
    "security_penalty",
    "performance_count",
    "performance_penalty",
    "ai_count",
    "ai_penalty",
]

# Stage order in reports.
STAGE_LINT, STAGE_SECURITY, STAGE_SEMANTIC = 0, 1, 2

# Severities in order of weight.
SEVERITIES = ["error", "warning", "info"]

# Finding categories.
CATEGORIES = ["lint", "security", "performance", "testing", "ai_semantic", "best_practice"]

# Penalty per finding by category, for error, warning and info.
PENALTIES = {
    "security": (15.0, 5.0, 2.0),
    "performance": (20.0, 8.0, 3.0),
    "ai_semantic": (10.0, 3.0, 1.0),
}

# Score of a dimension in which a file has no finding.
CLEAN_SCORES = {"security": 100.0, "performance": 90.0, "ai_semantic": 75.0}

# Weight of each dimension in the overall score, in summing order.
WEIGHTS = [
    ("security", 0.35),
    ("code_quality", 0.25),
    ("performance", 0.20),
    ("test_coverage", 0.10),
    ("ai_risk", 0.10),
]

# Names skipped while walking a source tree.
DEFAULT_IGNORE = [".git", "node_modules", "__pycache__", "target", "venv"]


@dataclass(frozen=True)
class Language:
    name: str
    display: str
    wire: str
    extensions: tuple[str, ...]
    linter: str
    test_score: float


# Supported languages, their file extensions, default linter and test estimate.
LANGUAGES = [
    Language("python", "Python", "python", ("py",), "ruff", 65.0),
    Language("javascript", "JavaScript", "java_script", ("js", "jsx"), "biome", 65.0),
    Language("typescript", "TypeScript", "type_script", ("ts", "tsx"), "biome", 65.0),
    Language("go", "Go", "go", ("go",), "golangci-lint", 70.0),
    Language("rust", "Rust", "rust", ("rs",), "clippy", 70.0),
]
TEST_FILE_SCORE = 95.0
UNKNOWN_LANGUAGE_TEST_SCORE = 50.0

# Linters in the order their findings are listed.
LINTERS = ["ruff", "biome", "oxlint", "golangci-lint", "clippy"]


@dataclass(frozen=True)
class Thresholds:
    """Lowest accepted scores; a score equal to its limit passes."""

    security: float = 70.0
    code_quality: float = 60.0
    overall: float = 50.0


CRITICAL_SECURITY = 50.0


@dataclass(frozen=True)
class JudgeConfig:
    """Model settings written into the request table."""

    provider: str
    model: str
    max_tokens: int = 500
    max_input_chars: int = 4000


@dataclass(frozen=True)
class Rule:
    """One pattern rule. ``linear`` may give an equivalent pattern without backtracking."""

    code: str
    pattern: str
    severity: str
    message: str
    suggestion: str | None = None
    languages: tuple[str, ...] = field(default=())
    include: tuple[str, ...] = field(default=())
    exclude: tuple[str, ...] = field(default=())
    pack: str = "builtin"
    name: str = ""
    linear: str | None = None
