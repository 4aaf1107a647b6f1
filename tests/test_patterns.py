import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlake.functions.patterns import PatternError, compile_rule
from siftlake.functions.text import sql_string

REJECTED = [
    r"//\s*TODO(?!.*#\d+)", "[invalid", r"(a)\1", "a{", "a++", r"\Qa\E", "a)", "(a", "(?<=a)b", "(?<!a)b", "(?>a)", "a{,3}",
    r"[a--b]", "*a", "(?U)a*", r"\Z", r"\G", r"\h", r"\R", r"[[:nope:]]", r"\b{start}", "(?P<n>a)(?P=n)", "a\\",
]


@pytest.mark.parametrize("pattern", REJECTED)
def test_outside_the_dialect(pattern):
    with pytest.raises(PatternError):
        compile_rule(pattern)


CASES = [
    (r"[[:alpha:]]+", "::", False), (r"[[:alpha:]]+", "a", True), (r"[[:^digit:]]", "5", False), (r"[[:punct:]]x", "[x", True),
    (r"a$", "a\n", False), (r"(?m)a$", "a\n", True), (r"(?m:a$)\n", "a\n", True), (r"(?P<year>\d{4})", "2024", True),
    (r"\p{Greek}", "α", True), (r"\p{Greek}", "a", False), (r"\pL", "é", True), (r"\P{L}", "é", False), (r"\x{1F600}", "😀", True),
    (r"\U0001F600", "😀", True), (r"\v", "\x0b", True), (r"\v", "\n", False), (r"[]a]", "]", True), (r"(?i)[A-Z]x", "kX", True),
    (r"(?i)ÉX", "éx", True), (r"(?s).b", "\nb", True), (r".b", "\nb", False), (r".b", "\rb", True), (r"\d", "٣", True),
    (r"\p{Alphabetic}+", "é", True), (r"\P{White_Space}", "\u00a0", False), (r"x{1500}", "x" * 1500, True), (r"[^\pL]", "é", False),
    (r"(?-u:\d)", "٣", False), (r"a\z", "a", True), (r"\Aa", "ba", False), (r"[\w-]+@", "é-@", True), (r"\$\{x\}", "${x}", True),
    (r"a{2}b{1,}c{0,2}", "aabb", True), (r"[^\S\n]x", "\tx", True), (r"(?i)k", "\u212a", True), (r"(?i)\Q", None, None),
]


@pytest.mark.parametrize("pattern, text, expected", [case for case in CASES if case[2] is not None])
def test_translation_matches(spark, pattern, text, expected):
    compiled = compile_rule(pattern)
    assert not compiled.folded or pattern.startswith("(?i)")
    subject = text.lower().replace("\u017f", "s") if compiled.folded else text
    row = spark.sql(f"select {sql_string(subject)} rlike {sql_string(compiled.java)} as hit").collect()[0]
    assert row.hit is expected
    for group in compiled.needles:
        assert not expected or any(literal in subject for literal in group)


def test_facts():
    rule = compile_rule(r"""(?i)(?:execute|query|exec)\s*\(f['"]""")
    assert rule.folded and rule.needles == (('"', "'"), ("exec", "query"), ("(f",))
    assert compile_rule("a*").nullable and not compile_rule("a+").nullable
    assert compile_rule(r"eval\s*\(").linear and compile_rule(r"\b\d+\.\d+\b").linear
    assert not compile_rule(r"[\w.]+@x").linear and not compile_rule(r"a.*b").linear and not compile_rule(r"a\s*\s*b").linear
    assert not compile_rule(r"(?i)K[a-z]*\d").linear and not compile_rule(r"(ab)*c").linear
    assert compile_rule(r"\bx+y").arrow is None
    assert not compile_rule("(?i)A(?-i:B)").folded


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.sampled_from(["a", "B", "(?:ab|c)", "[ab]", "x?", "c+", "d{2}", r"\(", "(?:e|f)?", r"\d", "(ab)"]), min_size=1, max_size=6
    ),
    st.text("aAbBcCdDeEfFxX(12", max_size=14),
    st.booleans(),
)
def test_needles_are_necessary(parts, text, ignore_case):
    pattern = ("(?i)" if ignore_case else "") + "".join(parts)
    compiled = compile_rule(pattern)
    subject = text.lower() if compiled.folded else text
    matched = re.search(pattern, text) is not None
    assert (re.search(re.sub(r"^\(\?dU\)", "", compiled.java), subject) is not None) == matched
    if matched:
        assert all(any(literal in subject for literal in group) for group in compiled.needles)
