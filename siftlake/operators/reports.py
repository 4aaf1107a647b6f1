"""Report projections: JSON, SARIF, text, editor diagnostics and score bands.

Reports are tables of finished lines or documents, written by Spark. Nothing is collected on
the driver, and no document grows without bound: large groups are split into parts.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions.paths import language_field
from siftlake.functions.severity import diagnostic_severity, is_error, sarif_level
from siftlake.functions.text import whole_number
from siftlake.model import FINDING_COLUMNS, FINDINGS, Rule
from siftlake.operators.gate import corpus_summary, critical_failures
from siftlake.operators.grouping import in_parts
from siftlake.operators.scan import items_of_hits
from siftlake.session import shared_dir

TOOL_NAME, TOOL_VERSION = "siftlake", "0.1.0"
TITLE = "Code audit report"
FINDINGS_PER_DOCUMENT = 10_000
SARIF_SHARDS = 16

_KEEP_NULLS = {"ignoreNullFields": "false"}
_ORDER = ["stage_ord", "rule_ord", "seq"]


def _location() -> Column:
    """The path of a file, or its id when it comes from a table without paths."""
    return F.coalesce(F.col("path"), F.col("file_id"))


# ---- JSON ---------------------------------------------------------------------------------


def _finding_json() -> Column:
    return F.struct(
        "category",
        "severity",
        "code",
        "message",
        _location().alias("file"),
        "line",
        "column",
        "suggestion",
        "ai_explanation",
    )


def json_report(scores: DataFrame, findings: DataFrame, per_document: int = FINDINGS_PER_DOCUMENT) -> DataFrame:
    """One JSON document per file: path, language, findings in report order and scores.

    A file with more findings than ``per_document`` has several documents, numbered by ``part``.
    """
    ordered = findings.select("file_id", F.struct(*_ORDER, _finding_json().alias("finding")).alias("item"))
    parts = in_parts(ordered, "file_id", per_document, ["item"])
    grouped = parts.groupBy("file_id", "part").agg(F.sort_array(F.collect_list("item")).alias("items"))
    findings_of_file = F.coalesce(F.col("items.finding"), F.array().cast(_ITEMS))
    joined = scores.join(grouped, "file_id", "left")
    part = F.coalesce("part", F.lit(0).cast("bigint"))
    return joined.select("file_id", "ord", part.alias("part"), _json_document(findings_of_file).alias("json"))


def _json_document(findings: Column) -> Column:
    score_struct = F.struct("security", "code_quality", "performance", "test_coverage", "ai_risk", "overall")
    document = F.struct(
        _location().alias("path"),
        language_field(F.col("language"), "wire").alias("language"),
        findings.alias("findings"),
        score_struct.alias("scores"),
    )
    return F.to_json(document, _KEEP_NULLS)


def json_report_of_hits(
    scored: DataFrame, rules: Sequence[Rule], others: DataFrame | None = None, per_document: int = FINDINGS_PER_DOCUMENT
) -> DataFrame:
    """:func:`json_report` for files that carry the ``lines`` of their hits next to their scores.

    The scan's findings, one per rule at most, are a projection of the file's row. ``others`` are findings that come from
    elsewhere; only they are grouped, and the two ordered arrays are merged in the first document of each file.
    """
    own = items_of_hits(rules)
    files = scored.withColumn("part", F.lit(0).cast("bigint"))
    if others is not None:
        item = F.struct(*[name for name in FINDING_COLUMNS if name not in ("file_id", "path")]).alias("item")
        parts = in_parts(others.select("file_id", item), "file_id", per_document, ["item"])
        grouped = parts.groupBy("file_id", "part").agg(F.sort_array(F.collect_list("item")).alias("items"))
        files = scored.join(grouped, "file_id", "left").withColumn("part", F.coalesce("part", F.lit(0).cast("bigint")))
        more = F.coalesce("items", F.slice(own, 1, 0))
        own = F.when(F.col("part") == 0, F.sort_array(F.concat(own, more))).otherwise(more)
    location = "coalesce(path, file_id)"
    names = [name for name in FINDING_COLUMNS if name not in ("file_id", "path", *_ORDER)]
    fields = ", ".join(f"'{name}', i.{name}" for name in names).replace("'line',", f"'file', {location}, 'line',")
    files = files.withColumn("__items", own)
    document = _json_document(F.expr(f"transform(__items, i -> named_struct({fields}))"))
    return files.select("file_id", "ord", "part", document.alias("json"))


_ITEMS = (
    "array<struct<category:string,severity:string,code:string,message:string,file:string,"
    "line:bigint,column:bigint,suggestion:string,ai_explanation:string>>"
)


def run_summary(scores: DataFrame, stages: list[str]) -> DataFrame:
    """The run record that goes with the JSON report: stages, total and critical failures."""
    failures = critical_failures(scores).agg(F.collect_list("message").alias("failed_thresholds"))
    # Both sides are single-row aggregates; the constant key keeps this an ordinary join.
    totals = corpus_summary(scores).select(F.lit(1).alias("run"), F.col("findings").alias("total_findings"))
    joined = totals.join(failures.withColumn("run", F.lit(1)), "run")
    return joined.select(
        F.array(*[F.lit(stage) for stage in stages]).alias("stages_completed"),
        "total_findings",
        "failed_thresholds",
        F.lit(0).alias("exit_code"),
    )


# ---- SARIF --------------------------------------------------------------------------------


def _sarif_region() -> Column:
    """Start line and column as far as known; NULL without a line."""
    start_column = F.when(F.col("column").isNotNull(), F.format_string(',"startColumn":%d', "column")).otherwise("")
    return F.concat(F.lit('{"startLine":'), F.col("line").cast("string"), start_column, F.lit("}"))


def sarif_results(findings: DataFrame) -> DataFrame:
    return findings.select(
        "file_id",
        *_ORDER,
        F.col("code").alias("rule_id"),
        sarif_level(F.col("severity")).alias("level"),
        F.col("message").alias("message"),
        _location().alias("uri"),
        F.col("line").alias("start_line"),
        F.when(F.col("line").isNotNull(), F.col("column")).alias("start_column"),
    )


def sarif_rules(findings: DataFrame) -> DataFrame:
    """The distinct pairs of code and message."""
    return findings.select(F.col("code").alias("id"), F.col("message").alias("description")).distinct()


def _quoted(text: Column) -> Column:
    """A string as a JSON string."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)\A\[(.*)\]\z", 1)


def _shard(shards: int) -> Column:
    """A number below ``shards`` that follows from the file and the place of a finding in it alone."""
    key = F.concat("file_id", F.lit(":"), F.expr("seq div 10000"))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("bigint") % shards


def _sarif_rows(findings: DataFrame, log: Column | None, keep: Sequence[str] = ()) -> DataFrame:
    """Each finding with its log, its place in it, its result and rule as JSON; ``keep`` names columns to add."""
    region = F.coalesce(_sarif_region(), F.lit("null"))
    result = F.concat(
        *[F.lit('{"ruleId":'), _quoted(F.col("code"))],
        *[F.lit(',"level":'), _quoted(sarif_level(F.col("severity")))],
        *[F.lit(',"message":{"text":'), _quoted(F.col("message"))],
        *[F.lit('},"locations":[{"physicalLocation":{"artifactLocation":{"uri":'), _quoted(_location())],
        *[F.lit('},"region":'), region, F.lit("}}]}")],
    )
    rule = F.concat(
        *[F.lit('{"id":'), _quoted(F.col("code")), F.lit(',"shortDescription":{"text":'), _quoted(F.col("code"))],
        *[F.lit('},"fullDescription":{"text":'), _quoted(F.col("message")), F.lit("}}")],
    )
    number = (F.lit(0) if log is None else log).cast("bigint").alias("log")
    return findings.select(number, "file_id", *_ORDER, result.alias("json"), rule.alias("rule"), *keep)


def _sarif_document(rules: Column, results: Column, information_uri: str | None) -> Column:
    """A SARIF document of arrays of finished rules and results."""
    about = f'"informationUri":{json.dumps(information_uri)},' if information_uri is not None else ""
    driver = F.lit(f'{{"version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{TOOL_NAME}","version":"{TOOL_VERSION}",{about}"rules":[')
    return F.concat(
        *[driver, F.array_join(rules, ",")],
        *[F.lit(']}},"results":['), F.array_join(results, ","), F.lit("]}]}")],
    )


def sarif_logs(
    findings: DataFrame, log: Column | None = None, shards: int = SARIF_SHARDS, information_uri: str | None = None
) -> DataFrame:
    """SARIF documents, one per value of ``log`` (all findings if not given) and shard that has results.

    A log's results are dealt to ``shards`` documents by a stable hash of their file, and of every ten thousand results of it,
    so a rerun gives the same documents, and the plan is the same at any size: one shuffle, before which each
    task gathers its results of a document. Choose as many shards as keep a document at the size that its readers take; each
    is valid by itself and lists the rules of its own results. ``information_uri`` names a page about the tool. For logs
    that must not be cut see ``whole_sarif_logs``.
    """
    rows = _sarif_rows(findings.withColumn("part", _shard(shards)), log, ["part"])
    documents = rows.groupBy("log", "part").agg(
        F.sort_array(F.collect_list(F.struct("file_id", *_ORDER, "json"))).alias("results"),
        F.sort_array(F.collect_set("rule")).alias("rules"),
    )
    return documents.select("log", "part", _sarif_document(F.col("rules"), F.col("results.json"), information_uri).alias("sarif"))


def whole_sarif_logs(findings: DataFrame, log: Column | None = None, information_uri: str | None = None) -> DataFrame:
    """One SARIF document per value of ``log`` (all findings if not given), with all its results by file and in report order.

    Results are sorted into ranges over all tasks, and each range of a log is joined to one text; only these texts meet in
    the task that finishes the document. The findings are read twice, once for the bounds of the ranges: let them come from
    a written table, as ``check(materialize=True)`` has it. A document can be no larger than one value, 2 GB.
    """
    tasks = int(findings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _sarif_rows(findings, log).repartitionByRange(tasks, "log", "file_id", *_ORDER)
    pieces = ranges.withColumn("range", F.spark_partition_id()).groupBy("log", "range").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("file_id", *_ORDER, "json")))["json"], ",").alias("json"),
        F.collect_set("rule").alias("rules"),
    )
    documents = pieces.groupBy("log").agg(
        F.sort_array(F.collect_list(F.struct("range", "json"))).alias("results"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules")))).alias("rules"),
    )
    sarif = _sarif_document(F.col("rules"), F.col("results.json"), information_uri)
    return documents.select("log", F.lit(0).cast("bigint").alias("part"), sarif.alias("sarif"))


# ---- Text ---------------------------------------------------------------------------------


def score_bands(scores: DataFrame) -> DataFrame:
    """The colour band of the overall score, and whether the security score is alarming."""
    band = F.when(F.col("overall") >= 80, "green").when(F.col("overall") >= 60, "yellow").otherwise("red")
    return scores.select("file_id", "overall", band.alias("band"), (F.col("security") < 70).alias("security_flag"))


def _summary_lines(scores: DataFrame) -> DataFrame:
    def counted(name: str, text: str) -> Column:
        return F.when(F.col(name) > 0, F.concat(F.lit(text.split("{}")[0]), F.col(name), F.lit(text.split("{}")[1])))

    lines = [
        F.lit(f"  {TITLE}"),
        F.concat(F.lit("  Files analyzed: "), F.col("files")),
        F.concat(F.lit("  Total findings: "), F.col("findings")),
        counted("errors", "  ✗ {} error(s)"),
        counted("warnings", "  ⚠ {} warning(s)"),
        F.when(F.col("findings") == 0, F.lit("  ✓ No issues found!")),
    ]
    summary = corpus_summary(scores).select(F.posexplode(F.array(*lines)).alias("number", "text"))
    zero = F.lit(0).cast("bigint")
    return summary.filter(F.col("text").isNotNull()).select(
        F.lit(0).alias("section"), zero.alias("ord"), zero.alias("item"), F.col("number").alias("number"), "text"
    )


def _score_lines(scores: DataFrame) -> DataFrame:
    alarm = F.when(F.col("security") < 70, F.concat(F.lit(" (security:"), whole_number(F.col("security")), F.lit("!)")))
    text = F.concat(
        *[F.lit("  📊 Scores for "), _location(), F.lit(": "), whole_number(F.col("overall")), F.lit("/100")],
        F.coalesce(alarm, F.lit("")),
    )
    zero = F.lit(0).cast("bigint")
    return scores.select(F.lit(1).alias("section"), "ord", zero.alias("item"), F.lit(0).alias("number"), text.alias("text"))


def _finding_order() -> Column:
    """Stage, rule and position of a finding as one sortable number."""
    return F.col("stage_ord").cast("bigint") * (1 << 56) + F.col("rule_ord").cast("bigint") * (1 << 32) + F.col("seq")


def _finding_lines(scores: DataFrame, findings: DataFrame) -> DataFrame:
    files = scores.filter(F.col("total") > 0)
    zero = F.lit(0).cast("bigint")
    heads = files.select(
        F.lit(2).alias("section"),
        "ord",
        (zero - 1).alias("item"),
        F.lit(0).alias("number"),
        F.concat(F.lit("  "), _location(), F.lit(":")).alias("text"),
    )
    mark = F.when(is_error(F.col("severity")), "ERROR").when(F.col("severity") == "warning", "WARN").otherwise("INFO")
    place = F.concat(_location(), F.coalesce(F.concat(F.lit(":"), F.col("line")), F.lit("")))
    text = F.concat(*[F.lit("  "), place, F.lit(" ["), mark, F.lit("] "), F.col("code"), F.lit(" "), F.col("message")])
    lines = F.array(text, F.concat(F.lit("    → "), F.col("suggestion")))
    placed = findings if "ord" in findings.columns else findings.join(scores.select("file_id", "ord"), "file_id")
    body = placed.select(
        F.lit(2).alias("section"), "ord", _finding_order().alias("item"), F.posexplode(lines).alias("number", "text")
    )
    return heads.unionByName(body.filter(F.col("text").isNotNull()))


def text_report(scores: DataFrame, findings: DataFrame) -> DataFrame:
    """The lines of the text report with their sort key; see ``ordered_lines``.

    Findings that bring the ``ord`` of their file need no join.
    """
    return reduce(
        DataFrame.unionByName, [_summary_lines(scores), _score_lines(scores), _finding_lines(scores, findings)]
    )


def ordered_lines(report: DataFrame) -> DataFrame:
    """Report lines in order: a range-partitioned sort, wanted only where the text is written."""
    return report.orderBy("section", "ord", "item", "number").select("text")


def numbered_lines(report: DataFrame) -> DataFrame:
    """Report lines in order with their number in the whole report, from 1.

    Lines are sorted into ranges and written once; the number of a line is its place in its range plus the sizes of
    the ranges before, of which there is one small row per task. No task sees more than its own range.
    """
    spark = report.sparkSession
    order = ["section", "ord", "item", "number"]
    ranges = report.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    # The id holds the number of the partition above its 33 lower bits, and the place in it below.
    place = F.monotonically_increasing_id()
    target = shared_dir(spark, "report-lines")
    ranges.select(F.shiftright(place, 33).alias("range"), place.bitwiseAND((1 << 33) - 1).alias("at"), "text").write.parquet(target)
    lines = spark.read.parquet(target)
    before = F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = lines.groupBy("range").agg(F.count(F.lit(1)).alias("size")).select("range", F.coalesce(before, F.lit(0)).alias("before"))
    return lines.join(F.broadcast(sizes), "range").select((F.col("before") + F.col("at") + 1).alias("line"), "text")


# ---- Editor ---------------------------------------------------------------------------------


def diagnostics(findings: DataFrame) -> DataFrame:
    """Findings as an editor shows them: zero-based lines and a message led by the code."""
    line = F.greatest(F.lit(0), F.coalesce(F.nullif("line", F.lit(0)), F.lit(1)) - 1).cast("bigint")
    related = F.when(F.col("suggestion") != "", F.concat(F.lit("Suggestion: "), F.col("suggestion")))
    return findings.select(
        "file_id",
        "path",
        *_ORDER,
        line.alias("line"),
        F.concat(F.lit("["), F.col("code"), F.lit("] "), F.col("message")).alias("message"),
        diagnostic_severity(F.col("severity")).alias("severity"),
        "code",
        related.alias("related"),
    )


# ---- Sinks ----------------------------------------------------------------------------------


def write_findings(findings: DataFrame, path: str) -> None:
    findings.select(*FINDING_COLUMNS).write.mode("overwrite").parquet(path)


def replace_findings(findings: DataFrame, scanned: DataFrame, path: str, buckets: int = 64) -> None:
    """Put the findings of the ``scanned`` files (file_id) in the place of those a findings table has of them.

    The table is partitioned by a hash of the file; only the partitions of scanned files are rewritten, first to the shared
    folder and then by dynamic overwrite, so a run that failed or is repeated leaves the same rows. A row without a
    file stands in every partition that was written, so that one left without findings is rewritten too.
    """
    spark = findings.sparkSession
    bucket = F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int").alias("bucket")
    files = scanned.select("file_id").where("file_id is not null").distinct()
    touched = files.select(bucket).distinct()
    marker = spark.createDataFrame([], FINDINGS)
    marker.write.mode("ignore").parquet(f"{path}/bucket=0")
    old = spark.read.schema(f"{FINDINGS}, bucket int").parquet(path).where("file_id is not null")
    kept = old.join(touched, "bucket", "left_semi").join(files, "file_id", "left_anti").select(*FINDING_COLUMNS, "bucket")
    new = findings.select(*FINDING_COLUMNS, bucket).join(files, "file_id", "left_semi").select(*FINDING_COLUMNS, "bucket")
    rows = kept.unionByName(new).unionByName(touched, allowMissingColumns=True)
    staged = shared_dir(spark, "findings")
    rows.write.parquet(staged)
    written = spark.read.parquet(staged).repartition("bucket").write.mode("overwrite").partitionBy("bucket")
    written.option("partitionOverwriteMode", "dynamic").parquet(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """What ``replace_findings`` keeps."""
    return spark.read.schema(f"{FINDINGS}, bucket int").parquet(path).where("file_id is not null").select(*FINDING_COLUMNS)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("overwrite").parquet(path)


def write_json(report: DataFrame, path: str) -> None:
    """JSON lines, one document per line."""
    report.select("json").write.mode("overwrite").text(path)


def write_sarif(logs: DataFrame, path: str) -> None:
    """One SARIF document per line; every line is a complete log."""
    logs.select("sarif").write.mode("overwrite").text(path)


def write_text(report: DataFrame, path: str) -> None:
    ordered_lines(report).write.mode("overwrite").text(path)
