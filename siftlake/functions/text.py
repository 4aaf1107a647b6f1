"""Text expressions: decoding, case folding, line numbers and number display."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that match an ASCII letter when case is ignored: capitals, long s, Kelvin sign.
_FOLD_FROM = string.ascii_uppercase + "\u017f\u212a"
_FOLD_TO = string.ascii_lowercase + "sk"
# Lower-casing leaves the long s as it is and turns dotted capital I into a plain i.
_LOWER_DIFFERS = ["\u017f", "\u0130"]


def decode_text(content: Column) -> Column:
    """UTF-8 text of a binary column; NULL when the bytes are not valid UTF-8."""
    return F.try_validate_utf8(content.cast("string"))


def fold_case(text: Column) -> Column:
    """Text on which a lower-case ASCII pattern matches as a case-insensitive one would.

    Lower-casing is many times faster than replacing characters one by one, and gives the same
    matches except on texts with one of two rare letters.
    """
    special = text.contains(_LOWER_DIFFERS[0]) | text.contains(_LOWER_DIFFERS[1])
    return F.when(special, F.translate(text, _FOLD_FROM, _FOLD_TO)).otherwise(F.lower(text))


def sql_string(value: str) -> str:
    """A string as a Spark SQL literal; ``${`` would otherwise name a variable."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'").replace("${", "\\u0024{")
    return f"'{escaped}'"


def first_match_line_sql(text: str, pattern: str, nullable: bool = True) -> str:
    """SQL for the line of the first match of a pattern that is known to match somewhere.

    Splitting ignores an empty match at the very start, so a pattern that may match the
    empty string is first tried at the start of the text.
    """
    line = f"cast(size(split(split({text}, {sql_string(pattern)}, 2)[0], '\n')) as bigint)"
    if nullable:
        at_start = sql_string(r"\A(?:" + pattern + ")")
        line = f"if({text} rlike {at_start}, 1L, {line})"
    return line


def whole_number(value: Column) -> Column:
    """Number shown without decimals, halves to the even neighbour."""
    return F.bround(value).cast("bigint").cast("string")
