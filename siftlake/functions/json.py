"""SQL for reading JSON values without converting their types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def computed_once(value: Column) -> Column:
    """A costly value as a generator of one row, so that it is computed once per row.

    Filters on an ordinary column are pushed below it by repeating its expression, once for
    every mention. They cannot be pushed below a generator.
    """
    return F.explode(F.array(value))


def json_document_sql(raw: str) -> str:
    """The one JSON value a text holds; NULL when it is no JSON or more follows the value.

    The parser stops after the first value, so the text is read as the elements of an array.
    """
    listed = f"try_variant_get(try_parse_json(concat('[', {raw}, ']')), '$', 'array<variant>')"
    # One mention of the parsed array, so that the text is parsed once.
    return f"get(get(filter(array({listed}), a -> size(a) = 1), 0), 0)"


# from_json is laxer than a JSON parser unless told otherwise.
STRICT_JSON = "map('allowSingleQuotes', 'false', 'allowNonNumericNumbers', 'false')"


def json_list_sql(raw: str, key: str) -> str:
    """A struct with the list under a key (``items``) of the one JSON object a text holds; NULL for any other text.

    A text that cannot be read as one value may exceed the engine's limit of a value. It is split by its outer
    object, and only its elements are read as variants. ``items`` is NULL when the key is missing or holds no list.
    """
    read = f"from_json(concat('[', {raw}, ']'), 'array<struct<`{key}`: array<variant>>>', {STRICT_JSON})"
    named = f"transform({read}, o -> if(o is null, null, named_struct('items', o.`{key}`)))"
    split = f"if({key_count_sql(raw, key)} <= 1, get(get(filter(array({named}), n -> size(n) = 1), 0), 0), null)"
    listed = f"named_struct('items', try_variant_get(r, '$.{key}', 'array<variant>'))"
    # One mention of the document, so that a text within the limit is parsed once.
    return f"get(transform(array({json_document_sql(raw)}), r -> if(r is not null, {listed}, {split})), 0)"


def key_count_sql(raw: str, key: str) -> str:
    """How often the outer object of a JSON text names a key; NULL when it holds no object."""
    return f"size(filter(json_object_keys({raw}), k -> k = '{key}'))"


def type_at(value: str, path: str) -> str:
    """The JSON type at a path; ``VOID`` for null and missing alike."""
    return f"coalesce(schema_of_variant(try_variant_get({value}, '{path}', 'variant')), 'VOID')"


def text_at(value: str, path: str) -> str:
    """A string at a path; NULL for any other type."""
    return f"case when {type_at(value, path)} = 'STRING' then variant_get({value}, '{path}', 'string') end"


def whole_number_at(value: str, path: str) -> str:
    """A non-negative whole number at a path; NULL for anything else."""
    number = f"case when {type_at(value, path)} = 'BIGINT' then variant_get({value}, '{path}', 'bigint') end"
    return f"nullif(greatest({number}, -1L), -1L)"


def is_object(value: str, path: str) -> str:
    """Whether there is an object at a path; only its own keys are looked at."""
    return f"try_variant_get({value}, '{path}', 'map<string,variant>') is not null"
