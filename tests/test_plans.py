"""Plans stay the ones wanted at scale: what is shuffled, what is read, what is computed once."""

import re

import pytest
from pyspark.sql import functions as F

from siftlake.model import Rule
from siftlake.operators.changes import existing_changes, select_changed
from siftlake.operators.judge import response_texts
from siftlake.operators.scan import scan, scan_hits, totals_of_hits
from siftlake.operators.scoring import score_totals
from siftlake.plans.check import check
from siftlake.sources.builtin import builtin_rules
from siftlake.sources.lint import parse_lint
from siftlake.sources.packs import pack_rules, parse_rule_packs, valid_packs
from siftlake.sources.tables import files_from_table, spread_small


def plan_of(table):
    return table._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A table with more columns than a scan needs."""
    path = str(tmp_path_factory.mktemp("stored") / "texts")
    table = spark.range(50).select("id", F.lit("eval(x)").alias("text"), F.lit("p").alias("other"), F.lit("a.py").alias("path"))
    table.write.parquet(path)
    return spark.read.parquet(path)


def test_scan_is_one_narrow_pass(stored):
    found = scan(files_from_table(stored, "id", "text"), builtin_rules())
    plan = plan_of(found)
    assert "Exchange" not in plan and "Python" not in plan
    assert plan.count("FileScan") == 1
    assert re.search(r"ReadSchema: struct<id:bigint,text:string>", plan)
    # Every pattern is tried once, and once more where the line of a hit is worked out.
    assert plan.count("innerhtml\\s*=") == 2
    # All of it runs in one stage of generated code.
    assert not re.search(r"^[ :+-]*(Project|Generate|Filter) ", plan, re.MULTILINE)
    assert "*(1) Generate posexplode" in plan and "*(2)" not in plan


def test_a_thousand_rules_are_one_narrow_pass(stored):
    rules = [Rule(f"R{n}", rf"word{n}\w", "info", "m") for n in range(1000)]
    for found in (scan(files_from_table(stored, "id", "text"), rules), scan_hits(files_from_table(stored, "id", "text"), rules)):
        plan = plan_of(found)
        assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Union" not in plan
        assert plan.count("ArrowEvalPython") == 1


def test_scores_of_a_scan_need_no_shuffle(stored):
    files = files_from_table(stored, "id", "text", "path")
    scores = score_totals(totals_of_hits(scan_hits(files, builtin_rules()), builtin_rules()))
    assert "Exchange" not in plan_of(scores)
    assert "Exchange" not in plan_of(check(files).scores)


@pytest.mark.parametrize("condition", ["true", "total > 0", "security < 70", "overall < 60"])
def test_filters_on_scores_do_not_scan_again(stored, condition):
    files = files_from_table(stored, "id", "text", "path")
    result = check(files)
    unfiltered = plan_of(result.scores).count("innerhtml\\s*=")
    assert plan_of(result.scores.where(condition)).count("innerhtml\\s*=") == unfiltered
    hits = scan_hits(files, builtin_rules()).where("size(filter(lines, l -> l > 3)) > 0 and size(lines) > 1")
    assert plan_of(hits).count("innerhtml\\s*=") == unfiltered


def test_every_linter_finding_of_a_known_file_is_scored(spark, stored):
    files = files_from_table(stored, "id", "text", "path")
    raw = '{"diagnostics":[{"code":"E1","message":"m","location":{"row":2}}]}'
    lint = spark.createDataFrame([("1", "other.py", "ruff", raw), ("gone", "b.py", "ruff", raw)], "file_id string, path string, tool string, raw string")
    result = check(files, lint_reports=lint)
    assert result.findings.count() == result.scores.agg(F.sum("total")).first()[0]
    assert [r.path for r in result.findings.where("category = 'lint'").collect()] == ["a.py"]
    assert [r.file_id for r in result.unmatched_findings.collect()] == ["gone"]


def test_linter_findings_are_summed_before_they_are_joined(spark, stored):
    files = files_from_table(stored, "id", "text", "path")
    lint = spark.createDataFrame([("1", "a.py", "ruff", "{}")], "file_id string, path string, tool string, raw string")
    plan = plan_of(check(files, lint_reports=lint).scores)
    lines = plan.splitlines()
    exchanges = [n for n, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(exchanges) <= 2
    summed = [n for n, line in enumerate(lines) if "HashAggregate" in line and "partial_count" in line]
    assert summed and summed[0] > exchanges[-1]
    # The texts stay where they are.
    assert not any("text#" in lines[n] for n in exchanges)


def test_json_is_parsed_once_per_row(spark, tmp_path):
    path = str(tmp_path / "raw")
    row = [("1", "a.rs", "clippy", "{}", 200, "openai", 0)]
    columns = "file_id string, path string, tool string, raw string, status int, provider string, dir_ord int"
    spark.createDataFrame(row, columns).write.parquet(path)
    raw = spark.read.parquet(path)
    tables = {
        "lint": parse_lint(raw, "ruff").filter("severity = 'error'"),
        "clippy": parse_lint(raw, "clippy").filter("line > 3"),
        "packs": pack_rules(valid_packs(parse_rule_packs(raw))),
        "responses": response_texts(raw.withColumnRenamed("raw", "body")),
    }
    for name, table in tables.items():
        assert plan_of(table).count("parseJson") == 1, name


def test_building_a_check_of_changes_starts_no_job(spark, stored):
    files = files_from_table(stored, "id", "text", "path")
    changes = spark.createDataFrame([("a.py", "staged")], "path string, source string")
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    joined = existing_changes(files, changes)
    selected = select_changed(files, changes, files)
    assert set(tracker.getJobIdsForGroup(None)) == before
    assert len(joined.collect()) == selected.count() == 50
    # The list turned out to be short.
    assert "BroadcastHashJoin" in plan_of(joined)


def test_only_small_tables_are_spread(spark, stored, monkeypatch):
    assert "REPARTITION_BY_NUM" in plan_of(spread_small(stored, "id"))
    monkeypatch.setattr("siftlake.sources.tables.SMALL_BYTES_PER_CORE", 0)
    assert "Exchange" not in plan_of(spread_small(stored, "id"))
