"""Large rule sets in one pass: which rules can match a text is found by one automaton for all of them.

Every rule has literals that each of its matches contains. One set of alternatives per rule, the one
with the longest shortest literal, is put into an automaton that reads a text once, whatever the
number of rules. Patterns with short matches are tried around each place of their literals, so their cost does
not depend on the length of the text; of the others, those whose literals were all found are tried on the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import functions as F

from siftlake.functions.paths import glob_to_regex
from siftlake.functions.patterns import CompiledPattern
from siftlake.functions.text import sql_string
from siftlake.model import Rule

# Shorter literals are in most texts; looking for them one by one is cheaper than reporting each place.
INDEXED_LENGTH = 3

CANDIDATES = "array<struct<at:int,line:bigint>>"
_CANDIDATE = pa.struct([("at", pa.int32()), ("line", pa.int64())])


def first_match_lines(texts: pa.Array, pattern: str) -> tuple[np.ndarray, np.ndarray]:
    """The texts in which a linear-time engine finds the pattern, and the line of the first match in each."""
    matched = pc.fill_null(pc.match_substring_regex(texts, pattern), False)
    rows = np.flatnonzero(matched.to_numpy(zero_copy_only=False))
    if not len(rows):
        return rows, rows
    split = pc.extract_regex(texts.filter(matched), rf"(?P<lead>(?s:\A.*?))(?:{pattern})")
    breaks = pc.count_substring(pc.struct_field(split, "lead"), "\n")
    return rows, breaks.to_numpy(zero_copy_only=False) + 1


def fold(text: str) -> str:
    """Lower-cased, with the long s as s: every ASCII literal of a folded text is in it."""
    return text.lower().replace("\u017f", "s")


@dataclass(frozen=True)
class Needles:
    """What the automaton needs of each rule, small enough to send to every task."""

    groups: list[tuple[tuple[str, ...], ...]]
    folded: list[bool]
    slow: list[str | None]
    short: list[tuple[str, int] | None]

    @staticmethod
    def of(rules: Sequence[CompiledPattern]) -> Needles:
        return Needles(
            [rule.needles for rule in rules],
            [rule.folded for rule in rules],
            [rule.arrow if not rule.linear else None for rule in rules],
            [rule.short for rule in rules],
        )


class RuleIndex:
    """Finds the rules whose literals a text contains, and the first matches of those with short matches."""

    def __init__(self, needles: Needles) -> None:
        self.needles = needles
        self.automata = {}
        self.others: list[int] = []
        owners: dict[bool, dict[str, list[int]]] = {False: {}, True: {}}
        for at, (groups, folded) in enumerate(zip(needles.groups, needles.folded)):
            best = max(groups, key=lambda group: min(map(len, group)), default=())
            if not best or min(map(len, best)) < INDEXED_LENGTH:
                self.others.append(at)
                continue
            for literal in best:
                owners[folded].setdefault(literal, []).append(at)
        for folded, literals in owners.items():
            if literals:
                automaton = ahocorasick.Automaton()
                for literal, rules in literals.items():
                    short = [(at, re.compile(needles.short[at][0]).search, needles.short[at][1]) for at in rules if needles.short[at]]
                    automaton.add_word(literal, (len(literal), short, [at for at in rules if not needles.short[at]]))
                automaton.make_automaton()
                self.automata[folded] = automaton

    def rules_in(self, text: str) -> list[tuple[int, int]]:
        """The rules that may match ``text``, in order, with the line of the first match, or 0 where it was not tried.

        A rule with short matches is tried around the places of its literals, one after the other. A match that begins
        before the stretch around a place holds an earlier place, where it would have been found.
        """
        subjects = {False: text, True: fold(text) if any(self.needles.folded) else ""}
        maybe = set(self.others)
        lines: dict[int, int] = {}
        breaks, counted = 0, 0
        for folded, automaton in self.automata.items():
            for last, (length, short, others) in automaton.iter(subjects[folded]):
                if others:
                    maybe.update(others)
                for at, search, width in short:
                    if at in lines:
                        continue
                    first = max(0, last + 1 - width)
                    match = search(text, first, last + 1 - length + width)
                    if match is None:
                        continue
                    # One that begins before it may end beyond that stretch.
                    start = search(text, first, match.start() + width).start()
                    if start >= counted:
                        breaks += text.count("\n", counted, start)
                    else:
                        breaks -= text.count("\n", start, counted)
                    counted = start
                    lines[at] = breaks + 1
        lines.update((at, 0) for at in maybe if self._has_all(at, subjects))
        return sorted(lines.items())

    def _has_all(self, at: int, subjects: dict[bool, str]) -> bool:
        subject = subjects[self.needles.folded[at]]
        return all(any(literal in subject for literal in group) for group in self.needles.groups[at])


def candidate_rules(needles: Broadcast) -> Callable:
    """Arrow UDF: per text the rules that may match it, with the line where the pattern was tried here already.

    Those with short matches are tried by the index. Patterns that could backtrack are tried by the linear-time
    engine, on their candidates only.
    """
    built: list[RuleIndex] = []

    @F.arrow_udf(CANDIDATES)
    def candidates(texts: pa.Array) -> pa.Array:
        if not built:
            built.append(RuleIndex(needles.value))
        index = built[0]
        rows: list[list[tuple[int, int]]] = [index.rules_in(text) if text is not None else [] for text in texts.to_pylist()]
        owner = np.repeat(np.arange(len(rows)), [len(row) for row in rows])
        rules = np.array([at for row in rows for at, _ in row], np.int32)
        line = np.array([line for row in rows for _, line in row], np.int64)
        keep = np.ones(len(rules), bool)
        for at in np.unique(rules[line == 0]).tolist():
            pattern = index.needles.slow[at]
            if pattern is not None:
                places = np.flatnonzero(rules == at)
                found, lines = first_match_lines(texts.take(pa.array(owner[places])), pattern)
                keep[places] = False
                keep[places[found]], line[places[found]] = True, lines
        counts = np.bincount(owner[keep], minlength=len(rows)) if len(rows) else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        rules, line = rules[keep], line[keep]
        values = pa.StructArray.from_arrays([pa.array(rules), pa.array(line, mask=line == 0)], fields=list(_CANDIDATE))
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return candidates


def _texts_sql(values: Sequence[str | None]) -> str:
    listed = ", ".join("null" if value is None else sql_string(value) for value in values)
    return f"cast(array({listed}) as array<string>)"


def _any_glob(globs: Sequence[str]) -> str | None:
    return "|".join(f"(?:{glob_to_regex(glob)})" for glob in globs) or None


def matched_sql(rules: Sequence[tuple[Rule, CompiledPattern]], candidates: str, folded_text: str) -> str:
    """SQL for the matches among the candidates of a text: (at, line), in order of the rules.

    Rules are data here: each candidate looks up its pattern and filters by its number, so the size of
    the expression's code does not depend on how many rules there are.
    """
    patterns = _texts_sql([compiled.java for _, compiled in rules])
    # Splitting ignores an empty match at the very start.
    starts = _texts_sql([rf"\A(?:{compiled.java})" if compiled.nullable else None for _, compiled in rules])
    subject = "text"
    if any(compiled.folded for _, compiled in rules):
        folded = f"array({', '.join(str(compiled.folded).lower() for _, compiled in rules)})"
        subject = f"if(get({folded}, c.at), {folded_text}, text)"
    pattern = f"get({patterns}, c.at)"
    at_start = f"coalesce({subject} rlike get({starts}, c.at), false)"
    split = f"cast(size(split(split({subject}, {pattern}, 2)[0], '\n')) as bigint)"
    line = f"if({at_start}, 1L, {split})" if any(compiled.nullable for _, compiled in rules) else split
    conditions = [f"(c.line is not null or {subject} rlike {pattern})"]
    if any(rule.languages for rule, _ in rules):
        listed = ", ".join(f"{_texts_sql([name.lower() for name in rule.languages])}" if rule.languages else "null" for rule, _ in rules)
        conditions.append(f"(language is null or coalesce(array_contains(get(array({listed}), c.at), language), true))")
    for globs, wanted in ((lambda rule: rule.include, "true"), (lambda rule: rule.exclude, "false")):
        if any(globs(rule) for rule, _ in rules):
            regex = f"get({_texts_sql([_any_glob(globs(rule)) for rule, _ in rules])}, c.at)"
            conditions.append(f"({regex} is null or coalesce(path rlike {regex}, false) = {wanted})")
    # Cheap filters first, the pattern last.
    tests = " and ".join(conditions[1:] + conditions[:1])
    found = f"filter({candidates}, c -> {tests})"
    return f"transform({found}, c -> named_struct('at', c.at, 'line', coalesce(c.line, {line})))"
