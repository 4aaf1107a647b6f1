"""The registered queries: every operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.functions.paths import (
    any_glob_sql,
    extension,
    is_ignored,
    language_field,
    language_of,
    stem,
)
from siftlake.functions.severity import is_error, is_security, severity_rank
from siftlake.functions.text import decode_text
from siftlake.model import JudgeConfig
from siftlake.operators import changes, finder, gate, judge, reports, scan, scoring
from siftlake.plans import fixtures as fx
from siftlake.plans.check import Check, check
from siftlake.session import shared_dir
from siftlake.sources import packs, tree
from siftlake.sources.builtin import builtin_rules, language_table, rule_catalogue
from siftlake.sources.changes import parse_changed_paths
from siftlake.sources.lint import parse_lint
from siftlake.sources.tables import files_from_table, spread_tasks, supported_files
from siftlake.streaming import on_save

Query = Callable[[SparkSession, str], DataFrame]

EXPIRY = "10 minutes"
JUDGE = JudgeConfig(provider="anthropic", model="judge-1")
_FINDING = ["file_id", "rule_ord", "severity", "code", "message", "line", "suggestion"]
_LINT = ["file_id", "path", "seq", "severity", "code", "message", "line"]


def _rounded(name: str):
    return F.round(name, 6).alias(name)


def _seeded_check(spark: SparkSession, sf: str, materialize: bool = False) -> Check:
    return check(fx.seeded_files(spark, sf), materialize=materialize)


def _event_scores(spark: SparkSession, sf: str, skewed: bool = False) -> DataFrame:
    files = fx.paths_only(spark, sf).withColumn("language", language_of(F.col("path")))
    return scoring.score(files.withColumn("ord", F.col("file_id").cast("bigint")), fx.event_findings(spark, sf, skewed))


# ---- Scans ----------------------------------------------------------------------------------


def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan(fx.document_files(spark, sf), builtin_rules()).select(*_FINDING)


def scan_pages_pack(spark: SparkSession, sf: str) -> DataFrame:
    rules = builtin_rules() + fx.TEXT_PACK
    return scan.scan(fx.page_files(spark, sf), rules).select("path", *_FINDING)


def scan_conversations_pack(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan(fx.conversation_files(spark, sf), fx.TEXT_PACK + fx.TALK_PACK).select(*_FINDING)


def scan_documents_pack(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan(fx.document_files(spark, sf), fx.TEXT_PACK).select(*_FINDING)


def scan_seeded(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan(fx.seeded_files(spark, sf), builtin_rules()).select("path", "stage_ord", "category", *_FINDING)


def scan_lines(spark: SparkSession, sf: str) -> DataFrame:
    found = scan.scan(fx.seeded_files(spark, sf), builtin_rules())
    return found.groupBy("rule_ord").agg(
        F.count(F.lit(1)).alias("hits"),
        F.min("line").alias("first_line"),
        F.max("line").alias("last_line"),
        F.sum("line").alias("line_sum"),
    )


def scan_loaded_packs(spark: SparkSession, sf: str) -> DataFrame:
    """Built-in rules, then the rules of raw packs derived from the parts, over the documents."""
    raw = fx.word_packs(spark, sf)
    rules = builtin_rules() + packs.rules_of_packs(packs.valid_packs(packs.parse_rule_packs(raw)))
    return scan.scan(fx.document_files(spark, sf), rules).select("file_id", "code", "severity", "line")


def scan_many_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Built-in rules, then hundreds of pack rules, in one pass over the documents."""
    loaded = packs.rules_of_packs(packs.valid_packs(packs.parse_rule_packs(fx.item_packs(spark, sf))))
    return scan.scan(fx.document_files(spark, sf), builtin_rules() + loaded).select("file_id", "code", "severity", "line")


def rule_filters(spark: SparkSession, sf: str) -> DataFrame:
    return scan.scan(fx.seeded_files(spark, sf), fx.FILTER_PACK).select(*_FINDING)


def decode_texts(spark: SparkSession, sf: str) -> DataFrame:
    content = F.when(F.col("doc_id") % 10 == 0, F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))
    content = F.coalesce(content, F.encode("text", "UTF-8"))
    documents = fx.table(spark, sf, "documents").select("doc_id", decode_text(content).alias("text"))
    files = files_from_table(documents, "doc_id", "text")
    totals = scan.totals_of_hits(scan.scan_hits(files, builtin_rules()), builtin_rules())
    readable = files.select("file_id", F.col("text").isNotNull().alias("readable"))
    return readable.join(totals.select("file_id", "total"), "file_id")


# ---- Files and filters ------------------------------------------------------------------------


def language_detect(spark: SparkSession, sf: str) -> DataFrame:
    language = language_of(F.col("path"))
    return fx.paths_only(spark, sf).select(
        "path",
        extension(F.col("path")).alias("extension"),
        stem(F.col("path")).alias("stem"),
        language.alias("language"),
        language_field(language, "display").alias("display"),
        language_field(language, "linter").alias("linter"),
    )


def language_counts(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.paths_only(spark, sf).withColumn("language", language_of(F.col("path")))
    return supported_files(files).groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def language_extensions(spark: SparkSession, sf: str) -> DataFrame:
    """Every supported extension with its language, linter and number of files."""
    listed = language_table(spark).select("language", "display", "wire", "linter", F.explode("extensions").alias("extension"))
    files = fx.paths_only(spark, sf).groupBy(extension(F.col("path")).alias("extension")).agg(F.count(F.lit(1)).alias("n"))
    counted = listed.join(files, "extension", "left")
    return counted.select(*listed.columns, F.coalesce("n", F.lit(0).cast("bigint")).alias("files"))


def language_include(spark: SparkSession, sf: str) -> DataFrame:
    files = fx.paths_only(spark, sf).withColumn("language", language_of(F.col("path")))
    return supported_files(files, ["go", "rust"]).select("path", "language")


def ignore_filter(spark: SparkSession, sf: str) -> DataFrame:
    return fx.paths_only(spark, sf).filter(~is_ignored(F.col("path")))


def glob_filter(spark: SparkSession, sf: str) -> DataFrame:
    matched = [F.expr(any_glob_sql("path", [glob])).alias(f"glob_{at}") for at, glob in enumerate(fx.GLOBS)]
    return fx.paths_only(spark, sf).select("path", *matched)


def changed_union(spark: SparkSession, sf: str) -> DataFrame:
    return changes.changed_paths(parse_changed_paths(fx.change_lists(spark, sf)))


def changed_semi(spark: SparkSession, sf: str) -> DataFrame:
    listed = parse_changed_paths(fx.change_lists(spark, sf))
    return changes.existing_changes(fx.paths_only(spark, sf), listed)


def _changed_scan(spark: SparkSession, sf: str, listed: DataFrame) -> DataFrame:
    existing = fx.seeded_files(spark, sf)
    full = supported_files(existing.filter(~is_ignored(F.col("path"))))
    selected = changes.select_changed(existing, listed, full)
    return scan.scan(selected, builtin_rules()).select("path", "rule_ord", "line")


def changed_scan(spark: SparkSession, sf: str) -> DataFrame:
    return _changed_scan(spark, sf, parse_changed_paths(fx.change_lists(spark, sf)))


def changed_fallback(spark: SparkSession, sf: str) -> DataFrame:
    gone = parse_changed_paths(fx.change_lists(spark, sf)).filter(F.col("path").startswith("gone/"))
    return _changed_scan(spark, sf, gone)


def _written_tree(spark: SparkSession, sf: str) -> str:
    root = tree.store_of(shared_dir(spark, "tree")).root
    tree.write_tree(fx.seeded_files(spark, sf), root)
    return root


def source_tree_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as a file tree to the shared folder, then found and scanned there."""
    root = _written_tree(spark, sf)
    found = scan.scan(tree.source_tree(spark, [root]), builtin_rules())
    return found.select(F.substr("path", F.lit(len(root) + 2)).alias("path"), "rule_ord", "line")


def tree_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Supported files by target: a tree, one nested in it twice, a file of it, a missing folder."""
    root = _written_tree(spark, sf)
    targets = [root, f"{root}/{fx.DIRECTORIES[0]}", f"{root}/{fx.DIRECTORIES[0]}/", f"{root}/{fx.FIRST_FILE}", f"{root}/gone"]
    files = tree.source_tree(spark, targets)
    target = F.substring_index("file_id", ":", 1).cast("int").alias("target")
    path = F.substr("path", F.lit(len(root) + 2)).alias("path")
    return files.select(target, path, "language", F.length("text").cast("bigint").alias("chars"))


# ---- Scores -------------------------------------------------------------------------------------


def file_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _seeded_check(spark, sf).scores.select("file_id", "errors", "warnings", "total")


def _event_score(*names: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _event_scores(spark, sf).select("file_id", *[_rounded(name) for name in names])

    return query


def event_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _event_scores(spark, sf).select("file_id", "errors", "warnings", "total")


def score_seeded(spark: SparkSession, sf: str) -> DataFrame:
    dimensions = ["security", "code_quality", "performance", "test_coverage", "ai_risk", "overall"]
    return _seeded_check(spark, sf).scores.select("file_id", *[_rounded(name) for name in dimensions])


def worst_file(spark: SparkSession, sf: str) -> DataFrame:
    return gate.worst_file(_event_scores(spark, sf)).select("file_id", "path", _rounded("overall"))


def critical_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return gate.critical_failures(_event_scores(spark, sf, skewed=True))


def threshold_violations(spark: SparkSession, sf: str) -> DataFrame:
    rows = gate.threshold_violations(_seeded_check(spark, sf).scores)
    return rows.select("file_id", "dimension", _rounded("value"), "limit", "message")


def gate_outcome(spark: SparkSession, sf: str) -> DataFrame:
    return _seeded_check(spark, sf).outcome()


def corpus_summary(spark: SparkSession, sf: str) -> DataFrame:
    return gate.corpus_summary(_event_scores(spark, sf))


def ci_outputs(spark: SparkSession, sf: str) -> DataFrame:
    return gate.ci_outputs(_seeded_check(spark, sf).scores)


# ---- Reports --------------------------------------------------------------------------------------


def _full_check(spark: SparkSession, sf: str) -> Check:
    """Scan, linter reports and model reviews over the same files, by file id."""
    reports_by_file = fx.document_reports(spark, sf, "ruff")
    responses = fx.judge_responses(spark, sf)
    return check(fx.seeded_files(spark, sf), lint_reports=reports_by_file, judge_responses=responses)


def findings_union(spark: SparkSession, sf: str) -> DataFrame:
    found = _full_check(spark, sf).findings
    groups = found.groupBy("stage_ord", "category", "severity", "code").agg(F.count(F.lit(1)).alias("findings"))
    return groups.withColumns(
        {
            "severity_rank": severity_rank(F.col("severity")),
            "is_error": is_error(F.col("severity")),
            "is_security": is_security(F.col("category")),
        }
    )


def full_scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = _full_check(spark, sf).scores
    return scores.select("file_id", "errors", "warnings", "total", _rounded("code_quality"), _rounded("overall"))


def unmatched_lint(spark: SparkSession, sf: str) -> DataFrame:
    """Linter findings by whether their file is part of the check; reports are keyed by event, files by document."""
    result = check(fx.seeded_files(spark, sf), lint_reports=fx.lint_reports(spark, sf, "ruff"))
    matched = result.findings.where("category = 'lint'").select("code", "severity", F.lit(True).alias("has_file"))
    others = result.unmatched_findings.select("code", "severity", F.lit(False).alias("has_file"))
    return matched.unionByName(others).groupBy("has_file", "code", "severity").agg(F.count(F.lit(1)).alias("findings"))


def low_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Files that a review would start with; the filter must not scan any text again."""
    scores = _seeded_check(spark, sf).scores.where("overall < 60 or security < 70")
    return scores.select("file_id", "path", "total", _rounded("security"), _rounded("overall"))


def sarif_results(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sarif_results(_seeded_check(spark, sf).findings).drop("seq")


def sarif_rules(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sarif_rules(_seeded_check(spark, sf).findings)


def sarif_logs(spark: SparkSession, sf: str) -> DataFrame:
    by_rules = F.floor(F.length("code") + F.col("rule_ord") / 4)
    return reports.whole_sarif_logs(_seeded_check(spark, sf, materialize=True).findings, by_rules)


def findings_table(spark: SparkSession, sf: str) -> DataFrame:
    """All findings, then a second look at every fifth file that leaves its errors only, written twice."""
    target = shared_dir(spark, "findings-table")
    result = _seeded_check(spark, sf, materialize=True)
    again = result.findings.where("cast(file_id as bigint) % 5 = 0 and severity = 'error'")
    reports.replace_findings(result.findings, result.files, target)
    for _ in range(2):
        reports.replace_findings(again, result.files.where("cast(file_id as bigint) % 5 = 0"), target)
    return reports.read_findings(spark, target).select("file_id", "path", "code", "severity", "line")


def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return reports.diagnostics(_seeded_check(spark, sf).findings).drop("seq")


def json_report(spark: SparkSession, sf: str) -> DataFrame:
    result = _seeded_check(spark, sf)
    dimensions = ["security", "code_quality", "performance", "test_coverage", "ai_risk", "overall"]
    scored = result.scored.withColumns({name: F.round(name, 6) for name in dimensions})
    return reports.json_report_of_hits(scored, result.rules).select("file_id", "part", "json")


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    result = _seeded_check(spark, sf, materialize=True)
    summary = reports.run_summary(result.scores, result.stages)
    return summary.select(F.to_json(F.struct("*")).alias("json"))


def text_report(spark: SparkSession, sf: str) -> DataFrame:
    result = _seeded_check(spark, sf, materialize=True)
    return result.text_report().select("section", "ord", "number", "text")


def ordered_report(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of the text report, numbered."""
    return reports.numbered_lines(_seeded_check(spark, sf, materialize=True).text_report())


def score_bands(spark: SparkSession, sf: str) -> DataFrame:
    return reports.score_bands(_event_scores(spark, sf)).drop("overall")


def rule_listing(spark: SparkSession, sf: str) -> DataFrame:
    """The rule catalogue with the number of findings per code."""
    found = _seeded_check(spark, sf).findings.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    listed = rule_catalogue(spark).join(found, "code", "left")
    return listed.select("code", "name", "description", F.coalesce("n", F.lit(0).cast("bigint")).alias("findings"))


# ---- Rule packs, linters, model review, finders -------------------------------------------------------


def pack_summary(spark: SparkSession, sf: str) -> DataFrame:
    parsed = packs.parse_rule_packs(fx.raw_packs(spark, sf))
    return packs.pack_summary(packs.valid_packs(parsed))


def pack_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = packs.pack_rules(packs.valid_packs(packs.parse_rule_packs(fx.raw_packs(spark, sf))))
    return rules.select("dir_ord", "path", "pack", "at", "code", "pattern", "severity", F.size("languages").alias("n_languages"))


def pack_totals(spark: SparkSession, sf: str) -> DataFrame:
    return packs.pack_totals(packs.valid_packs(packs.parse_rule_packs(fx.raw_packs(spark, sf))))


def pack_rejected(spark: SparkSession, sf: str) -> DataFrame:
    rejected = packs.rejected_packs(packs.parse_rule_packs(fx.raw_packs(spark, sf)))
    return rejected.select("path", (F.col("reason") == "not a rule pack").alias("bad_format"))


def pack_dirs(spark: SparkSession, sf: str) -> DataFrame:
    """Raw packs written to ordered folders, among other files, and loaded from there: rules, or why there are none."""
    root = tree.store_of(shared_dir(spark, "packs")).root
    raw = fx.raw_packs(spark, sf).withColumn("folder", F.concat(F.lit("dir-"), F.col("dir_ord")))
    # Some packs also lie below their folder or under another ending, where they are not looked for.
    place = F.concat("folder", F.lit("/"), "path")
    decoys = F.array(place, F.concat("folder", F.lit("/below/"), "path"), F.concat(place, F.lit(".bak")))
    listed = F.when(F.col("path").endswith("0.json"), decoys).otherwise(F.array(place))
    example = packs.example_pack(spark).select(F.concat(F.lit("dir-1/"), "path").alias("path"), F.col("raw").alias("text"))
    tree.write_tree(raw.select(F.explode(listed).alias("path"), F.col("raw").alias("text")).unionByName(example), root)
    # The second folder is loaded first, and one does not exist.
    loaded = packs.load_rule_packs(spark, [f"{root}/dir-{at}" for at in (1, 7, 0, 2)])
    rules = packs.pack_rules(packs.valid_packs(loaded)).select("dir_ord", "path", "code", F.lit(None).cast("boolean").alias("bad_format"))
    rejected = packs.rejected_packs(loaded).select("dir_ord", "path", F.lit(None).cast("string").alias("code"), (F.col("reason") == "not a rule pack").alias("bad_format"))
    return rules.unionByName(rejected).withColumn("path", F.substring_index("path", "/", -1))


def rejected_responses(spark: SparkSession, sf: str) -> DataFrame:
    return judge.rejected_responses(fx.judge_responses(spark, sf))


def _lint(tool: str) -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return parse_lint(fx.lint_reports(spark, sf, tool), tool).select(*_LINT)

    return query


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    return judge.prompts(fx.seeded_files(spark, sf), JUDGE)


def request_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return judge.request_bodies(fx.seeded_files(spark, sf), JUDGE)


def judge_findings(spark: SparkSession, sf: str) -> DataFrame:
    found = judge.judge_findings(fx.paths_only(spark, sf), fx.judge_responses(spark, sf))
    return found.select("file_id", "path", "severity", "code", "message", "ai_explanation")


def long_texts(text: str, path: str | None) -> Iterator[dict]:
    """A finder: texts of more than 50 lines. It fails on some texts, as a finder may."""
    if "system" in text:
        raise ValueError("refused")
    lines = text.count("\n") + 1
    if lines > 50:
        yield {"code": "LONG", "message": f"{lines} lines", "severity": "warning", "line": 51}


def custom_finder(spark: SparkSession, sf: str) -> DataFrame:
    found = finder.run_finder(fx.document_files(spark, sf), long_texts)
    return found.select("file_id", "severity", "code", "message", "line", "finder_error")


# ---- Streams ------------------------------------------------------------------------------------------


def _document_stream(spark: SparkSession, sf: str) -> DataFrame:
    table = fx.table(spark, sf, "documents")
    # The table may be one file or a folder of files; a pattern is listed alike for both, a plain path must be a folder.
    stream = spark.readStream.schema(table.schema).parquet(f"{sf}/documents.parque[t]")
    tasks = spread_tasks(table)
    return stream.repartition(tasks, "doc_id") if tasks else stream


def stream_scan(spark: SparkSession, sf: str) -> DataFrame:
    target = shared_dir(spark, "stream-scan")
    versions = fx.file_versions(_document_stream(spark, sf))
    on_save.start_scan(versions, builtin_rules(), target, target + "-progress").awaitTermination()
    return spark.read.parquet(target).select("path", *_FINDING)


def stream_latest(spark: SparkSession, sf: str) -> DataFrame:
    target = shared_dir(spark, "stream-latest")
    versions = fx.file_versions(_document_stream(spark, sf))
    on_save.start_latest(versions, builtin_rules(), target, target + "-progress").awaitTermination()
    return on_save.read_latest(spark, target, builtin_rules()).select("path", "file_id", "rule_ord", "line")


def stream_expiring(spark: SparkSession, sf: str) -> DataFrame:
    """The latest findings of paths saved within ten minutes of the newest save."""
    target = shared_dir(spark, "stream-expiring")
    versions = fx.file_versions(_document_stream(spark, sf), moving=True)
    on_save.start_latest(versions, builtin_rules(), target, target + "-progress", EXPIRY).awaitTermination()
    return on_save.read_latest(spark, target, builtin_rules(), EXPIRY).select("path", "file_id", "rule_ord", "line")


QUERIES: dict[str, Query] = {
    "scan_documents": scan_documents,
    "scan_pages_pack": scan_pages_pack,
    "scan_conversations_pack": scan_conversations_pack,
    "scan_documents_pack": scan_documents_pack,
    "scan_seeded": scan_seeded,
    "scan_lines": scan_lines,
    "scan_loaded_packs": scan_loaded_packs,
    "scan_many_rules": scan_many_rules,
    "rule_filters": rule_filters,
    "decode_texts": decode_texts,
    "language_detect": language_detect,
    "language_counts": language_counts,
    "language_extensions": language_extensions,
    "language_include": language_include,
    "ignore_filter": ignore_filter,
    "glob_filter": glob_filter,
    "changed_union": changed_union,
    "changed_semi": changed_semi,
    "changed_scan": changed_scan,
    "changed_fallback": changed_fallback,
    "source_tree_scan": source_tree_scan,
    "tree_targets": tree_targets,
    "file_counts": file_counts,
    "event_counts": event_counts,
    "score_quality": _event_score("code_quality"),
    "score_security": _event_score("security"),
    "score_performance": _event_score("performance"),
    "score_tests": _event_score("test_coverage"),
    "score_ai": _event_score("ai_risk"),
    "score_overall": _event_score("overall"),
    "score_seeded": score_seeded,
    "worst_file": worst_file,
    "critical_threshold": critical_threshold,
    "threshold_violations": threshold_violations,
    "gate_outcome": gate_outcome,
    "corpus_summary": corpus_summary,
    "ci_outputs": ci_outputs,
    "findings_union": findings_union,
    "full_scores": full_scores,
    "unmatched_lint": unmatched_lint,
    "low_scores": low_scores,
    "sarif_results": sarif_results,
    "sarif_rules": sarif_rules,
    "sarif_logs": sarif_logs,
    "findings_table": findings_table,
    "diagnostics": diagnostics,
    "json_report": json_report,
    "run_summary": run_summary,
    "text_report": text_report,
    "ordered_report": ordered_report,
    "score_bands": score_bands,
    "rule_listing": rule_listing,
    "pack_summary": pack_summary,
    "pack_rules": pack_rules,
    "pack_totals": pack_totals,
    "pack_rejected": pack_rejected,
    "pack_dirs": pack_dirs,
    "lint_ruff": _lint("ruff"),
    "lint_biome": _lint("biome"),
    "lint_oxlint": _lint("oxlint"),
    "lint_golangci": _lint("golangci-lint"),
    "lint_clippy": _lint("clippy"),
    "prompts": prompts,
    "request_bodies": request_bodies,
    "judge_findings": judge_findings,
    "rejected_responses": rejected_responses,
    "custom_finder": custom_finder,
    "stream_scan": stream_scan,
    "stream_latest": stream_latest,
    "stream_expiring": stream_expiring,
}
