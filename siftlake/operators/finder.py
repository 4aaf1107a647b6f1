"""Custom finders: a Python function from (text, path) to findings, run on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.model import FINDING_COLUMNS, FINDINGS, STAGE_SECURITY

Finder = Callable[[str, str | None], Iterable[dict]]

_RESULT = (
    "category string, severity string, code string, message string, "
    "line bigint, column bigint, suggestion string, ai_explanation string"
)
_RESULT_COLUMNS = [part.split()[0] for part in _RESULT.split(", ")]
_DEFAULTS = {"category": "security", "severity": "info"}
_ROWS_PER_BATCH = 5000
_ARROW_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
_ARROW_RESULT = pa.schema(
    [(name, _ARROW_TYPES[kind]) for name, kind in (part.split() for part in FINDINGS.split(", "))]
    + [("finder_error", pa.string())]
)


def run_finder(files: DataFrame, finder: Finder, finder_ord: int = 1_000_000) -> DataFrame:
    """Findings of a finder over all readable files, with a ``finder_error`` column.

    When the finder fails on a file, that file yields one row that holds only the error; all
    other files are kept. ``finder_ord`` places its findings behind those of the rules.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in batched(_found(batch), _ROWS_PER_BATCH):
                yield pa.RecordBatch.from_pylist(list(rows), schema=_ARROW_RESULT)

    def _found(batch: pa.RecordBatch) -> Iterator[dict]:
        for file in batch.to_pylist():
            known = {"file_id": file["file_id"], "path": file["path"]}
            order = {"stage_ord": STAGE_SECURITY, "rule_ord": finder_ord}
            try:
                results = list(finder(file["text"], file["path"]))
                rows = [known | order | {"seq": seq} | _DEFAULTS | dict(row) for seq, row in enumerate(results)]
            except Exception as problem:  # noqa: BLE001 - any failure concerns this file only
                rows = [known | order | {"seq": 0, "finder_error": str(problem) or type(problem).__name__}]
            yield from rows

    readable = files.filter(F.col("text").isNotNull()).select("file_id", "path", "text")
    return readable.mapInArrow(find, FINDINGS + ", finder_error string")


def finder_findings(found: DataFrame) -> DataFrame:
    return found.filter(F.col("finder_error").isNull()).select(*FINDING_COLUMNS)


def finder_failures(found: DataFrame) -> DataFrame:
    return found.filter(F.col("finder_error").isNotNull()).select("file_id", "path", "finder_error")


def register_finder(spark: SparkSession, name: str, finder: Finder) -> None:
    """Make a finder callable from SQL: ``FROM files, LATERAL name(files.text, files.path)``.

    When the finder fails on a text, that text yields one row with only ``finder_error``.
    """

    class Find:
        def eval(self, text: str, path: str):
            try:
                rows = [_DEFAULTS | dict(row) for row in (finder(text, path) if text is not None else ())]
            except Exception as problem:  # noqa: BLE001 - any failure concerns this text only
                rows = [{"finder_error": str(problem) or type(problem).__name__}]
            for row in rows:
                yield tuple(row.get(column) for column in [*_RESULT_COLUMNS, "finder_error"])

    spark.udtf.register(name, F.udtf(Find, returnType=_RESULT + ", finder_error string", useArrow=True))
