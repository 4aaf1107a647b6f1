"""Rule patterns: from the portable rule dialect to the regex Spark runs.

Rules are written for a linear-time regex engine: Unicode classes, ``.`` stops only at a
line feed, no look-around and no back-references. ``compile_rule`` rewrites such a pattern
for Spark's ``rlike`` and ``split``, and works out cheap facts about it that keep the scan
fast: literals every match contains, whether it can match the empty string, and whether
it can be matched on lower-cased text without case-insensitive matching.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc

try:
    from re import _constants as sre
    from re import _parser as sre_parser
except ImportError:  # private modules: without them patterns are not analysed, only run
    sre = sre_parser = None

# ``d``: only a line feed ends a line. ``U``: Unicode classes and case folding.
JAVA_FLAGS = "(?dU)"

# Named ASCII classes and the ranges they stand for.
POSIX_CLASSES = {
    "alnum": "0-9A-Za-z",
    "alpha": "A-Za-z",
    "ascii": r"\x00-\x7F",
    "blank": r"\t ",
    "cntrl": r"\x00-\x1F\x7F",
    "digit": "0-9",
    "graph": "!-~",
    "lower": "a-z",
    "print": " -~",
    "punct": r"!-/:-@\[-`{-~",
    "space": r"\t\n\x0B\f\r ",
    "upper": "A-Z",
    "word": r"0-9A-Za-z_",
    "xdigit": "0-9A-Fa-f",
}

# Classes as the second regex engine (Arrow's) must spell them to be Unicode-aware.
UNICODE_CLASSES = {
    "w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}",
    "d": r"\p{Nd}",
    "s": r"\t\n\x0B\f\r \x{85}\p{Z}",
}

# Character properties that only the JVM's engine knows, and complaints of the
# second engine about the size of a pattern rather than its form.
JVM_PROPERTIES = {
    *["alphabetic", "control", "digit", "hex_digit", "ideographic", "join_control", "letter", "lowercase"],
    *["punctuation", "titlecase", "uppercase", "white_space"],
}
_ENGINE_LIMITS = ["repetition size", "pattern too large"]

# The most characters a match of a short pattern has.
SHORT_MATCH = 128

_PLAIN_ESCAPES = "aftnr"
_CLASS_ESCAPES = "wWsSdD"


class PatternError(ValueError):
    """The pattern is outside the portable dialect."""


@dataclass(frozen=True)
class CompiledPattern:
    java: str
    """Pattern for ``rlike`` and ``split``."""
    folded: bool
    """Match against ``fold_case(text)`` rather than the text itself."""
    needles: tuple[tuple[str, ...], ...]
    """Every match contains at least one literal of each group."""
    nullable: bool
    """The pattern may match the empty string."""
    linear: bool
    """Matching time cannot grow faster than the text."""
    arrow: str | None
    """The same pattern for Arrow's linear-time engine, if it can be expressed there."""
    short: tuple[str, int] | None = None
    """The same pattern for Python's engine and the most characters a match has, if it means the same there."""


def compile_rule(pattern: str, linear_form: str | None = None) -> CompiledPattern:
    """Check a rule pattern and translate it; raises ``PatternError`` when not portable."""
    java, arrow, probe = _translate(pattern)
    if arrow is not None:
        try:
            pc.match_substring_regex(pa.array([""]), arrow)
        except pa.ArrowInvalid as problem:
            if not any(limit in str(problem) for limit in _ENGINE_LIMITS):
                raise PatternError(str(problem)) from None
            arrow = None
    tree = _parse(probe)
    folding = pattern.startswith("(?i)") and _can_fold(pattern[4:], tree)
    needles = _needles(tree, folding) if tree is not None else ()
    # Python's parser gives the smallest width; assume zero when it cannot read the pattern.
    nullable = tree is None or tree.getwidth()[0] == 0
    linear = tree is not None and _linear_ends(tree) is not None
    if folding:
        java = _lower_literals(java.removeprefix("(?i)"))
    short = (probe, tree.getwidth()[1]) if tree is not None and not folding and _is_short(tree) else None
    if linear_form is not None:
        java, linear = _lower_literals(linear_form) if folding else linear_form, True
    return CompiledPattern(
        JAVA_FLAGS + java, folding, needles, nullable, linear, arrow if _arrow_is_exact(arrow) else None, short
    )


def _translate(pattern: str) -> tuple[str, str | None, str | None]:
    """Rewrite a pattern for Java, for Arrow and for Python's parser in one walk."""
    java: list[str] = []
    arrow: list[str] | None = []
    probe: list[str] | None = []
    multiline = [False]
    depth = 0  # nesting of character classes
    i, n = 0, len(pattern)

    def put(text: str, for_arrow: str | None = None, for_probe: str | None = None) -> None:
        nonlocal arrow, probe
        java.append(text)
        if arrow is not None:
            arrow.append(text if for_arrow is None else for_arrow)
        if probe is not None:
            probe.append(text if for_probe is None else for_probe)

    while i < n:
        char, rest = pattern[i], pattern[i:]
        if char == "\\":
            i += _escape(rest, depth, put)
            if rest[1:2] in ("W", "S", "D") and depth:
                arrow = None  # the other engine has no negated class inside a class
            if rest[1:2] in ("p", "P", "x", "u", "U"):
                probe = None
            if (named := re.match(r"\\[pP]\{\^?(\w+)\}", rest)) and named[1].lower() in JVM_PROPERTIES:
                arrow = None
            continue
        if depth:
            if named := re.match(r"\[:(\^?)(\w+):\]", rest):
                if named[2] not in POSIX_CLASSES:
                    raise PatternError(f"unknown class {named[0]}")
                body = POSIX_CLASSES[named[2]]
                put(f"[^{body}]" if named[1] else body, named[0], body)
                if named[1]:
                    probe = None
                i += len(named[0])
                continue
            if rest[:2] in ("--", "~~"):
                raise PatternError("class operators -- and ~~ are not supported")
            if rest[:2] == "&&" or char == "[":
                arrow = probe = None
            if char == "]":
                depth -= 1
            elif char == "[":
                depth += 1
            put(char)
            i += 1
            continue
        if char == "[":
            depth += 1
            opening = re.match(r"\[\^?\]?", rest)[0]
            # A bracket right after the opening is an ordinary character.
            put(opening.replace("]", r"\]"), opening, opening)
            i += len(opening)
            continue
        if char == "(":
            flags = multiline[-1]
            if group := re.match(r"\(\?P?<(?![=!])[^>]*>", rest):
                put("(", "(?:")
                i += len(group[0])
            elif group := re.match(r"\(\?([imsxu]*)(?:-([imsxu]+))?([:)])", rest):
                on, off = group[1], group[2] or ""
                flags = (flags or "m" in on) and "m" not in off
                java_on, java_off = on.replace("u", "U"), off.replace("u", "U")
                text = f"(?{java_on}{'-' + java_off if off else ''}{group[3]}"
                put(text, group[0], group[0])
                if set(on + off) & set("xu"):
                    arrow = None
                i += len(group[0])
                if group[3] == ")":
                    multiline[-1] = flags
                    continue
            elif rest.startswith("(?"):
                raise PatternError(f"unsupported group {rest[:4]}")
            else:
                put("(", "(?:")
                i += 1
            multiline.append(flags)
            continue
        if char == ")":
            if len(multiline) == 1:
                raise PatternError("unopened group")
            multiline.pop()
        if char == "{" and not re.match(r"\{\d+(,\d*)?\}", rest):
            raise PatternError("repetition without a count")
        if char == "$" and not multiline[-1]:
            put(r"\z", r"\z", r"\Z")
        else:
            put(char)
        i += 1
        if char in "*+?}" and rest[1:2] == "+":
            raise PatternError("possessive quantifiers are not supported")
    if depth or len(multiline) != 1:
        raise PatternError("unclosed group or class")
    return "".join(java), None if arrow is None else "".join(arrow), None if probe is None else "".join(probe)


def _arrow_is_exact(arrow: str | None) -> bool:
    """Word boundaries are the one thing the other engine takes from ASCII letters only."""
    return arrow is not None and not re.search(r"(?<!\\)(?:\\\\)*\\[bB]", arrow)


def _escape(rest: str, depth: int, put) -> int:
    """Translate one escape sequence; returns its length."""
    if len(rest) < 2:
        raise PatternError("incomplete escape")
    kind = rest[1]
    if kind in _CLASS_ESCAPES:
        body = UNICODE_CLASSES[kind.lower()]
        inside = body if kind.islower() else None
        put(rest[:2], inside if depth else f"[{'' if kind.islower() else '^'}{body}]")
        return 2
    if kind in "bB":
        if depth or rest[2:3] == "{":
            raise PatternError("unsupported word boundary")
        put(rest[:2])
        return 2
    if kind in "Az" and not depth:
        put(rest[:2], None, {"A": r"\A", "z": r"\Z"}[kind])
        return 2
    if kind in "pP":
        name = re.match(r"\\[pP](?:\{(\^?)([\w=:& -]+)\}|(\w))", rest)
        if not name:
            raise PatternError("incomplete class escape")
        inner = name[3] or name[2].split("=")[-1].split(":")[-1]
        negated = (kind == "P") != bool(name[1])
        java_name = inner if len(inner) <= 2 else "Is" + inner
        put(f"\\{'P' if negated else 'p'}{{{java_name}}}", f"\\{'P' if negated else 'p'}{{{inner}}}")
        return len(name[0])
    if kind in "xuU":
        code = re.match(r"\\[xuU]\{([0-9A-Fa-f]+)\}|\\x([0-9A-Fa-f]{2})|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", rest)
        if not code:
            raise PatternError("incomplete character escape")
        put(rf"\x{{{next(filter(None, code.groups()))}}}")
        return len(code[0])
    if kind in _PLAIN_ESCAPES:
        put(rest[:2])
        return 2
    if kind == "v":
        put(r"\x0B")
        return 2
    if kind.isascii() and (kind.isalnum() or kind in "<>"):
        raise PatternError(f"unsupported escape \\{kind}")
    put(rest[:2])
    return 2


def _parse(probe: str | None):
    if probe is None or sre_parser is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = sre_parser.parse(probe)
    except (re.error, OverflowError, RecursionError):
        return None
    return None if tree.state.flags & sre.SRE_FLAG_VERBOSE else tree


def _nodes(tree):
    """All nodes of a parse tree, outermost first."""
    for op, arg in tree:
        yield op, arg
        for child in arg if isinstance(arg, (tuple, list)) else ():
            for sub in child if isinstance(child, list) else (child,):
                if isinstance(sub, sre_parser.SubPattern):
                    yield from _nodes(sub)


def _is_short(tree) -> bool:
    """Whether matches are short and consist of plain characters and ranges, which all engines read alike.

    Nothing in such a pattern looks beyond the match, so it can be tried on a stretch of the text.
    """
    if tree.state.flags != sre.SRE_FLAG_UNICODE or tree.getwidth()[1] > SHORT_MATCH:
        return False
    plain = {sre.LITERAL, sre.NOT_LITERAL, sre.ANY, sre.BRANCH, sre.MAX_REPEAT, sre.MIN_REPEAT}
    return all(
        op in plain
        or (op is sre.IN and all(kind in (sre.NEGATE, sre.LITERAL, sre.RANGE) for kind, _ in arg))
        or (op is sre.SUBPATTERN and not arg[1] and not arg[2])
        for op, arg in _nodes(tree)
    )


def _can_fold(body: str, tree) -> bool:
    """Whether lower-casing pattern and text gives the same matches as ignoring case."""
    if tree is None or not body.isascii() or re.search(r"\(\?[a-zA-Z-]+[:)]", body):
        return False
    ranges = [value for op, arg in _nodes(tree) if op is sre.IN for kind, value in arg if kind is sre.RANGE]
    return all(_same_kind(chr(low), chr(high)) for low, high in ranges)


def _same_kind(first: str, last: str) -> bool:
    return any(kind(first) and kind(last) for kind in (str.isdigit, str.islower, str.isupper))


def _lower_literals(pattern: str) -> str:
    """Lower-case every letter that is not part of an escape."""
    return re.sub(r"\\.|[A-Z]+", lambda m: m[0] if m[0][0] == "\\" else m[0].lower(), pattern, flags=re.DOTALL)


def _needles(tree, folding: bool) -> tuple[tuple[str, ...], ...]:
    """Literals any match must contain, as groups of alternatives, in the order to try them."""
    if not folding and any(
        op is sre.SUBPATTERN and arg[1] & sre.SRE_FLAG_IGNORECASE for op, arg in _nodes(tree)
    ):
        return ()
    if not folding and tree.state.flags & sre.SRE_FLAG_IGNORECASE:
        return ()
    groups = _required(tree)
    if folding:
        groups = [{literal.lower() for literal in group} for group in groups]
    # A literal that contains another of its group adds nothing.
    groups = [{a for a in group if not any(b != a and b in a for b in group)} for group in groups]
    groups = [g for g in groups if not any(other != g and other < g for other in groups)]
    # A single letter or digit is in nearly every text.
    unique = {tuple(sorted(group)) for group in groups if not any(len(a) == 1 and a.isalnum() for a in group)}
    # Signs come first: they are missing from most prose, and found at once in most code.
    return tuple(sorted(unique, key=lambda g: (not is_sign_group(g), -min(map(len, g)), len(g), g)))


def is_sign_group(group: tuple[str, ...]) -> bool:
    return all(len(literal) == 1 for literal in group)


def _required(tree) -> list[set[str]]:
    groups: list[set[str]] = []
    run = ""
    for op, arg in tree:
        if op is sre.LITERAL:
            run += chr(arg)
            continue
        if run:
            groups.append({run})
            run = ""
        if op is sre.SUBPATTERN:
            groups += _required(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            groups += _required(arg[2])
        elif op is sre.BRANCH:
            best = [max(_required(branch), key=lambda g: min(map(len, g)), default=None) for branch in arg[1]]
            if all(best):
                groups.append(set().union(*best))
        elif op is sre.IN and len(arg) <= 4 and all(kind is sre.LITERAL for kind, _ in arg):
            groups.append({chr(value) for _, value in arg})
    if run:
        groups.append({run})
    return groups


_UNKNOWN: frozenset[str] = frozenset()
_BOUNDARY = r"\b"


def _linear_ends(tree, ends: frozenset[str] = _UNKNOWN) -> frozenset[str] | None:
    """The characters a match of ``tree`` can end with, or None when matching may be slow.

    Matching is fast when every open-ended repeat starts behind a character it cannot itself
    contain: two attempts then never walk the same stretch of text.
    """
    for op, arg in tree:
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            if high is sre.MAXREPEAT:
                if len(body) != 1 or not ends or any(_contains(body[0], end) for end in ends):
                    return None
                ends = _UNKNOWN
                continue
            inner = _linear_ends(body)
            if inner is None:
                return None
            optional = low == 0
            ends = _UNKNOWN if not inner or (optional and not ends) else inner | (ends if optional else inner)
        elif op is sre.SUBPATTERN:
            ends = _linear_ends(arg[3], ends)
            if ends is None:
                return None
        elif op is sre.BRANCH:
            branches = [_linear_ends(branch, ends) for branch in arg[1]]
            if None in branches:
                return None
            ends = frozenset().union(*branches) if all(branches) else _UNKNOWN
        elif op is sre.LITERAL:
            ends = frozenset(chr(arg))
        elif op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg):
            ends = frozenset(chr(value) for _, value in arg)
        elif op is sre.AT:
            ends = frozenset([_BOUNDARY]) if arg is sre.AT_BOUNDARY else ends
        else:
            ends = _UNKNOWN
    return ends


def _contains(node, char: str) -> bool:
    """Whether a one-character node covers a character; unknown nodes cover everything.

    Behind a word boundary, a node counts as covered unless it stays inside one word.
    """
    op, arg = node
    if char == _BOUNDARY:
        return op is not sre.IN or any(value not in (sre.CATEGORY_WORD, sre.CATEGORY_DIGIT) for _, value in arg)
    cases = {char, char.lower(), char.upper()}
    if op is sre.LITERAL:
        return chr(arg) in cases
    if op is sre.IN:
        negated = arg[0][0] is sre.NEGATE
        items = [item for item in arg if item[0] is not sre.NEGATE]
        return any(any(_covers(kind, value, c) for kind, value in items) != negated for c in cases)
    return True


def _covers(kind, value, char: str) -> bool:
    if kind is sre.LITERAL:
        return value == ord(char)
    if kind is sre.RANGE:
        return value[0] <= ord(char) <= value[1]
    # How Python's parser names the class escapes.
    tests = {
        sre.CATEGORY_WORD: r"\w",
        sre.CATEGORY_NOT_WORD: r"\W",
        sre.CATEGORY_SPACE: r"\s",
        sre.CATEGORY_NOT_SPACE: r"\S",
        sre.CATEGORY_DIGIT: r"\d",
        sre.CATEGORY_NOT_DIGIT: r"\D",
    }
    return value not in tests or bool(re.match(tests[value], char))
