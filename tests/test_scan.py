import random
import re

import pytest
from pyspark.sql import functions as F

from siftlake.functions.patterns import JAVA_FLAGS, compile_rule
from siftlake.functions.text import first_match_line_sql, sql_string
from siftlake.model import Rule
from siftlake.operators.rule_index import Needles, RuleIndex
from siftlake.operators.scan import findings_of_hits, scan, scan_hits, totals_of_hits
from siftlake.operators.scoring import score, totals_of_findings
from siftlake.sources.builtin import builtin_rules, rules_table

# A module of a made-up shop, with one issue of most kinds.
SAMPLE = """import hashlib

TOKEN = "t-4711-and-more-letters"


class Basket:
    def total(self, formula):
        return eval(formula)

    def show(self, page, note):
        page.innerHTML = note

    def key(self, parts):
        return hashlib.md5("|".join(parts))

    def log(self, password):
        print("changed to", password)
"""

HITS = [
    ("""pool.query('select price from shop where city = "' + city + '"')""", "SEC001"),
    ("Exec(f'delete {row}'", "SEC001"),
    ("menu.InnerHTML\t= label", "SEC002"),
    ("window.Document.Write (footer)", "SEC002"),
    ("Secret-Key: 'blue_moon_2024'", "SEC003"),
    ("v = sk-ABCdef0123456789ABCdef", "SEC003"),
    ("region AKIA", "SEC003"),
    ("md5sum (block)", "SEC004"),
    ("desede Cipher", "SEC004"),
    ("Print('the secret is out')", "SEC005"),
    ("1 + EVAL  (expr)", "SEC006"),
    ("popen(cmd + arg)", "SEC007"),
    ("%2E%2e/etc", "SEC008"),
    ("ftp://files.test/pub/$release", "SEC009"),
]
MISSES = [
    "pool.query('select price from shop where city = ?', [city])",
    "rows = parse(payload)",
    'print("all good")',
    'token = env.get("SERVICE")',
    "run(['date', zone])",
    'menu.textContent = "x"',
    "sha512(block)",
    "akia",
]
UNICODE = [
    ("token='ééééééééé'", {"SEC003"}),
    ("eval\u00a0(x)", {"SEC006"}),
    ("system\rfoo+", {"SEC007"}),
    ("PA\u017f\u017fWORD = 'abcdefgh1'", {"SEC003"}),
    ("to\u212aen = 'abcdefgh1'", {"SEC003"}),
    ("pr\u0130nt(password)", set()),
    ("system\nfoo+", set()),
]


def codes(files, rules=None):
    found = scan(files, rules or builtin_rules())
    return [(r.file_id, r.code, r.line) for r in found.orderBy("ord" if "ord" in found.columns else "file_id", "rule_ord").collect()]


def test_every_rule_hits_and_near_misses_do_not(make_files):
    texts = [text for text, _ in HITS] + MISSES
    found = codes(make_files([("a.py", text) for text in texts]))
    by_file = {}
    for file_id, code, _ in found:
        by_file.setdefault(int(file_id), set()).add(code)
    for at, (_, code) in enumerate(HITS):
        assert code in by_file.get(at, set()), HITS[at]
    for at in range(len(HITS), len(texts)):
        assert at not in by_file, texts[at]


def test_unicode_classes_and_case(make_files):
    found = codes(make_files([("a.py", text) for text, _ in UNICODE]))
    for at, (text, expected) in enumerate(UNICODE):
        assert {code for file_id, code, _ in found if int(file_id) == at} == expected, repr(text)


def test_sample_findings_and_scores(make_files):
    files = make_files([("testdata/test_sample.py", SAMPLE)])
    found = [(r.code, r.line, r.severity) for r in scan(files, builtin_rules()).orderBy("rule_ord").collect()]
    # Rules in order; the token is no key or password by name, so nothing is said about it.
    assert found == [("SEC002", 11, "error"), ("SEC004", 14, "warning"), ("SEC005", 17, "warning"), ("SEC006", 8, "error")]
    row = score(files, scan(files, builtin_rules())).collect()[0]
    # Two errors and two warnings: 100 - 2 * 15 - 2 * 5, and 1 - (2 * 10 + 2 * 3) / (4 * 10 + 1).
    assert (row.security, row.performance, row.test_coverage, row.ai_risk) == (60.0, 90.0, 95.0, 75.0)
    assert row.code_quality == pytest.approx(100 * (1 - 26 / 41), abs=1e-6)
    assert row.overall == pytest.approx(0.35 * 60 + 0.25 * row.code_quality + 0.2 * 90 + 0.1 * 95 + 0.1 * 75, abs=1e-6)


def test_many_rules_find_what_few_do(make_files, monkeypatch):
    """The same findings through the index as through expressions, with filters, folding and slow patterns."""
    words = [f"word{n}" for n in range(90)]
    odd = [
        Rule("ODD1", "x*", "info", "m"), Rule("ODD2", r"(?i)ſtrasse|kelvin", "info", "m"), Rule("ODD3", r"(a+)+b", "warning", "m"),
        Rule("ODD4", r"\(", "info", "m", include=("src/**",)), Rule("ODD5", "password", "info", "m", exclude=("**/test/**",)),
        Rule("ODD6", "word1", "info", "m", languages=("go", "Python")), Rule("ODD7", r"É+t", "info", "m"), Rule("ODD8", r"\d{3,}", "info", "m"),
    ]
    rules = builtin_rules() + odd + [Rule(f"W{n}", rf"\b{w}\b" if n % 2 else rf"(?i){w.upper()}[^0-9]", "info", "m") for n, w in enumerate(words)]
    texts = [text for text, _ in HITS] + MISSES + [text for text, _ in UNICODE] + ["", None, "aaab", "\n\nKELVIN straße ſtrasse", "ÉÉt 123 (", "İ kelvin"]
    texts += ["\n".join(words[at : at + 40]) + " " for at in range(0, 90, 13)] + [" ".join(w.upper() for w in words)]
    files = make_files([(f"{'src' if n % 3 else 'a/test'}/f{n}.{'go' if n % 2 else 'js'}", text) for n, text in enumerate(texts)])
    monkeypatch.setattr("siftlake.operators.scan.LITERAL_RULES", 5)
    many = sorted(map(repr, scan(files, rules).collect()))
    hits = scan_hits(files, rules)
    dense, totals = findings_of_hits(hits, rules), sorted(map(repr, totals_of_hits(hits, rules).collect()))
    assert sorted(map(repr, dense.collect())) == many
    monkeypatch.setattr("siftlake.operators.scan.LITERAL_RULES", 10_000)
    few = sorted(map(repr, scan(files, rules).collect()))
    assert [a for a in few if a not in many] == [a for a in many if a not in few] == [] and len(many) > 300
    assert sorted(map(repr, totals_of_hits(scan_hits(files, rules), rules).collect())) == totals


def test_line_numbers(make_files):
    texts = ["eval(x)", "a\neval(x)", "a\r\n\n😀é\neval(x)\neval(y)", "\n\n\neval\n(x)"]
    assert [line for _, _, line in codes(make_files([("a.py", t) for t in texts]))] == [1, 2, 4, 4]


def test_patterns_that_match_nothing_report_the_first_match(make_files):
    rules = [Rule("A", "x*", "info", "m"), Rule("B", r"(?m)$", "info", "m"), Rule("C", r"\b", "info", "m"), Rule("D", r"b*\z", "info", "m")]
    found = codes(make_files([("a.py", "\n\nabb"), ("a.py", "xx\ny")]), rules)
    assert found == [("0", "A", 1), ("0", "B", 1), ("0", "C", 3), ("0", "D", 3), ("1", "A", 1), ("1", "B", 1), ("1", "C", 1), ("1", "D", 2)]


def test_filters(make_files):
    rules = [
        Rule("LANG", "x", "info", "m", languages=("PYTHON", "go")),
        Rule("INC", "x", "info", "m", include=("src/*", "**/*.txt")),
        Rule("EXC", "x", "info", "m", exclude=("**/test/**",)),
        Rule("BOTH", "x", "info", "m", include=("src/**",), exclude=("src/test/*",)),
    ]
    paths = ["src/a.py", "src/test/b.js", "c.txt", "src/d.go", None]
    found = codes(make_files([(path, "x") for path in paths]), rules)
    expected = {
        "0": {"LANG", "INC", "EXC", "BOTH"},
        "1": set(),
        "2": {"LANG", "INC", "EXC"},
        "3": {"LANG", "INC", "EXC", "BOTH"},
        "4": {"LANG", "EXC"},
    }
    assert {n: {code for file_id, code, _ in found if file_id == n} for n in expected} == expected


def test_unreadable_text_has_no_findings_and_a_clean_score(make_files):
    files = make_files([("a.rs", None)])
    assert scan(files, builtin_rules()).count() == 0
    row = score(files, scan(files, builtin_rules())).collect()[0]
    assert (row.security, row.code_quality, row.test_coverage) == (100.0, 100.0, 70.0)


def test_bad_rule_is_skipped_alone(make_files):
    rules = [Rule("BAD", "(?!x)", "error", "m"), Rule("GOOD", "x", "error", "m")]
    with pytest.warns(UserWarning, match="BAD"):
        found = scan(make_files([("a.py", "x")]), rules).collect()
    assert [(r.code, r.rule_ord) for r in found] == [("GOOD", 2)]


def test_hits_give_the_same_findings_and_totals(make_files):
    files = make_files([("a.py", text) for text, _ in HITS] + [("b.go", "clean")])
    rules = builtin_rules() + [Rule("EXTRA", r"[\w.]+\(", "info", "call")]
    hits = scan_hits(files, rules)
    direct = scan(files, rules)
    assert sorted(map(str, findings_of_hits(hits, rules).collect())) == sorted(map(str, direct.collect()))
    columns = ["file_id", "errors", "warnings", "total", "security_count", "security_penalty"]
    narrow = {r.file_id: r for r in totals_of_hits(hits, rules).select(columns).collect() if r.total}
    grouped = {r.file_id: r for r in totals_of_findings(direct).select(columns).collect()}
    assert narrow == grouped


def test_partitioning_does_not_matter(make_files):
    files = make_files([("a.py", text) for text, _ in HITS])
    one, many = (sorted(codes(files.repartition(n))) for n in (1, 7))
    assert one == many


def test_many_rules(make_files):
    rules = [Rule(f"R{n}", f"word{n}\\b", "info", "m") for n in range(1200)]
    found = codes(make_files([("a.py", "word5\nword1100 word999"), ("a.py", "word0")]), rules)
    assert sorted(found) == [("0", "R1100", 2), ("0", "R5", 1), ("0", "R999", 2), ("1", "R0", 1)]


TOKENS = (
    "execute exec( exec query ( \n \n ' \" SELECT\t select\n SELECT + + print print( password key system popen subprocess "
    "http:// https:// ftp:// $a $ x \t f \r"
).split(" ") + [" ", " "]


def random_texts(count, seed):
    source = random.Random(seed)
    return ["".join(source.choice(TOKENS) for _ in range(source.randint(1, 24))) for _ in range(count)]


def test_linear_forms_and_both_engines_agree(spark, make_files):
    """Rules with a form that avoids backtracking: same lines as the plain pattern in both engines."""
    texts = random_texts(6000, seed=7)
    texts += ["exec\n(\n'SELECT\n\n'\n+", "exec('a SELECT b SELECT c' \n + x", "exec('\nexec('SELECT '+", "print\n\n(\nkey print(key"]
    texts += ["print (x) print\n( password", "exec (exec\n('SELECT\t' +", "exec('SELECT exec\n('SELECT '+", "exec( 'SELECTSELECT \n'+"]
    files = make_files([("a.py", text) for text in texts]).repartition(8)
    linear = [rule for rule in builtin_rules() if rule.linear]
    plain = [Rule(r.code, r.pattern, r.severity, r.message) for r in linear]
    by_form = {(f, n): line for f, n, line in _lines(scan(files, linear))}
    by_arrow = {(f, n): line for f, n, line in _lines(scan(files, plain))}
    by_java = {}
    for number, rule in enumerate(linear, start=1):
        pattern = JAVA_FLAGS + rule.pattern
        hits = files.filter(F.expr(f"text rlike {sql_string(pattern)}"))
        for row in hits.select("file_id", F.expr(first_match_line_sql("text", pattern)).alias("line")).collect():
            by_java[(row.file_id, number)] = row.line
    assert by_form == by_java
    assert by_arrow == by_java
    assert all(sum(n == number for _, n in by_java) > 100 for number in range(2, 5))


def _lines(found):
    return [(r.file_id, r.rule_ord, r.line) for r in found.collect()]


def test_long_lines_take_linear_time(make_files):
    """A quadratic scan of these lines would take hours."""
    texts = ["exec('SELECT " * 60_000, "print(" * 120_000, "system " * 120_000, "http://x " * 90_000, "a" * 1_000_000 + "@"]
    texts = [text + "+$@" if at != 1 else text + "$+@" for at, text in enumerate(texts)]
    rules = builtin_rules() + [Rule("MAIL", r"[\w.+-]+@[\w-]+\.[\w.]+", "info", "m")]
    found = codes(make_files([("a.py", text) for text in texts]), rules)
    assert ("2", "SEC007", 1) in found and not [f for f in found if f[1] == "MAIL"]


def test_rules_table(spark):
    table = rules_table(spark, builtin_rules())
    assert table.count() == 13 and table.select("code").distinct().count() == 9


def test_short_patterns_are_tried_around_their_literals(make_files, monkeypatch):
    """First lines of patterns with short matches, in the index and as expressions, and none of them left to try again."""
    patterns = [
        r"[^a-z]needle[^a-z]", r"[a-z]{0,9}needle", r"(?:a\n|b)?(needle|pin)s?.", r"n{0,3}.{0,20}eedle[^x]{2}", r".\n[^b]{1,4}needles", r"pins[0-9\n]{1,3}?😀",
    ]
    pieces = ["needle", "needles", "pin", "pins", "a", "b", "n", "x", "\n", "\n", " ", "7", "😀", "É"]
    source = random.Random(3)
    texts = ["".join(source.choice(pieces) for _ in range(source.randint(1, 40))) for _ in range(1500)] + ["", None, "needle", "\nneedle\n", "a\nneedle"]
    compiled = [compile_rule(pattern) for pattern in patterns]
    assert all(one.short for one in compiled)
    index = RuleIndex(Needles.of(compiled))
    expected = {}
    for n, text in enumerate(texts):
        first = [(at, re.search(pattern, text)) for at, pattern in enumerate(patterns)] if text is not None else []
        lines = [(at, match.start()) for at, match in first if match]
        expected[n] = [(at, text.count("\n", 0, start) + 1) for at, start in lines]
        assert text is None or index.rules_in(text) == expected[n]
    rules = [Rule(f"R{at}", pattern, "info", "m") for at, pattern in enumerate(patterns)]
    files = make_files([("a.py", text) for text in texts])
    listed = sorted((str(n), f"R{at}", line) for n, lines in expected.items() for at, line in lines)
    assert sorted(codes(files, rules)) == listed and len(listed) > 1000
    monkeypatch.setattr("siftlake.operators.scan.LITERAL_RULES", 1)
    assert sorted(codes(files, rules)) == listed


@pytest.mark.parametrize("pattern", [r"\bneedle", r"^needle", r"needle$", r"needle\w", "needle+", "(?i)needle", "(?s)needle.", "needle.{200}", r"(?i:n)eedle"])
def test_patterns_that_look_further_are_not_short(pattern):
    assert compile_rule(pattern).short is None
