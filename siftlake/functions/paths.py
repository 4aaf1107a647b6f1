"""Path expressions: names, extensions, languages, ignore lists and globs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.functions.text import sql_string
from siftlake.model import DEFAULT_IGNORE, LANGUAGES

_EXTENSION = r"(?:^|/)[^/]+\.([^./]*)$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Text after the last dot of the name; empty when the only dot leads the name."""
    return F.regexp_extract(path, _EXTENSION, 1)


def stem(path: Column) -> Column:
    """Name without its last extension; a leading dot belongs to the stem."""
    return F.regexp_replace(basename(path), r"(?s)(?<=.)\.[^.]*$", "")


def language_of(path: Column) -> Column:
    """Language by extension, case-sensitive; NULL when unsupported."""
    ext = extension(path)
    found = F.lit(None).cast("string")
    for language in reversed(LANGUAGES):
        found = F.when(ext.isin(*language.extensions), language.name).otherwise(found)
    return found


def language_field(language: Column, attribute: str) -> Column:
    """A property of the language record (``display``, ``wire``, ``linter``); NULL when unknown."""
    found = F.lit(None).cast("string")
    for record in reversed(LANGUAGES):
        found = F.when(language == record.name, getattr(record, attribute)).otherwise(found)
    return found


def is_ignored(relative_path: Column, ignore: Sequence[str] = tuple(DEFAULT_IGNORE)) -> Column:
    """True when any component below the target root equals an ignored name."""
    if not ignore:
        return F.lit(False)
    return F.arrays_overlap(F.split(relative_path, "/"), F.array(*[F.lit(name) for name in ignore]))


def glob_to_regex(glob: str) -> str:
    """``*`` and ``?`` stay inside one path segment, ``**`` crosses segments, ``**/`` may be empty."""
    parts = []
    for token in re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", glob):
        if token == "**/":
            parts.append(r"(?:[\s\S]*/)?")
        elif token == "**":
            parts.append(r"[\s\S]*")
        elif token == "*":
            parts.append("[^/]*")
        elif token == "?":
            parts.append("[^/]")
        else:
            parts.append(re.sub(r"([\\^$.|()\[\]{}+\-])", r"\\\1", token))
    return r"\A(?:" + "".join(parts) + r")\z"


def any_glob_sql(path: str, globs: Sequence[str]) -> str:
    """SQL that is true when a glob covers the whole path, and false for a missing path."""
    tests = " or ".join(f"{path} rlike {sql_string(glob_to_regex(glob))}" for glob in globs)
    return f"coalesce({tests}, false)"


def matches_any_glob(path: str, globs: Sequence[str]) -> Column:
    return F.expr(any_glob_sql(path, globs)) if globs else F.lit(False)
