import json
import re
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siftlake.model import FINDINGS, Thresholds
from siftlake.operators import gate, reports
from siftlake.operators.grouping import in_parts
from siftlake.operators.scoring import overall_score, score
from siftlake.plans.check import check
from siftlake.plans.suite import QUERIES
from siftlake.sources.builtin import builtin_rules, rule_catalogue


def finding(file_id="0", category="lint", severity="error", code="C1", message="m", line=10, seq=0, column=None, **more):
    row = {"file_id": file_id, "path": "src/test.rs", "stage_ord": 0, "rule_ord": 1, "seq": seq, "category": category}
    row |= {"severity": severity, "code": code, "message": message, "line": line, "column": column}
    return row | {"suggestion": None, "ai_explanation": None} | more


@pytest.fixture
def make_findings(spark):
    return lambda *rows: spark.createDataFrame([tuple(row.values()) for row in rows], FINDINGS)


@pytest.fixture
def one_file(make_files):
    return make_files([("src/main.rs", "")])


def scores_of(files, findings):
    return score(files, findings).collect()[0]


def test_score_constants(spark, one_file, make_findings):
    none = make_findings(finding(file_id="other"))
    row = scores_of(one_file, none)
    assert (row.security, row.code_quality, row.performance, row.test_coverage, row.ai_risk) == (100.0, 100.0, 90.0, 70.0, 75.0)
    security = [finding(category="security"), finding(category="security", seq=1), finding(category="security", severity="warning")]
    assert scores_of(one_file, make_findings(security[0])).security == 85.0
    assert scores_of(one_file, make_findings(*security)).security == 65.0
    row = scores_of(one_file, make_findings(*[finding(severity="warning", seq=n) for n in range(3)]))
    assert row.security == 100.0 and row.code_quality == pytest.approx(70.967742, abs=1e-6)
    slow = [finding(category="performance", severity=s, seq=n) for n, s in enumerate(["error", "warning", "info"])]
    assert scores_of(one_file, make_findings(*slow)).performance == 69.0
    review = [finding(category="ai_semantic", severity=s, seq=n) for n, s in enumerate(["error", "warning", "info"])]
    assert scores_of(one_file, make_findings(*review)).ai_risk == 86.0
    many = [finding(category="security", seq=n) for n in range(9)]
    assert scores_of(one_file, make_findings(*many)).security == 0.0
    names = ["security", "code_quality", "performance", "test_coverage", "ai_risk"]
    values = dict(zip(names, (F.lit(float(v)) for v in (100, 80, 60, 40, 20))))
    assert spark.range(1).select(overall_score(values).alias("o")).collect()[0].o == pytest.approx(73.0)


def test_test_files(make_files, make_findings):
    files = make_files([("a/latest.py", ""), ("test/a.py", ""), ("a.Test.py", ""), ("x_test.md", ""), ("a.md", ""), ("b.go", ""), (None, "")])
    rows = score(files, make_findings(finding(file_id="none"))).orderBy("ord").collect()
    assert [row.test_coverage for row in rows] == [95.0, 65.0, 65.0, 95.0, 50.0, 70.0, 50.0]


def test_gate(spark, make_files, make_findings):
    files = make_files([("a.py", ""), ("b.py", ""), ("c.go", "")])

    def outcome(*rows, thresholds=None):
        scores = score(files, make_findings(*rows))
        return gate.gate_outcome(scores, thresholds).collect()[0], gate.ci_outputs(scores, thresholds).collect()[0]

    full, outputs = outcome(finding(file_id="1", category="security"))
    assert (full.outcome, full.errors, outputs.result) == ("fail_errors", 1, "fail")
    warnings = [finding(file_id="1", category="security", severity="warning", seq=n) for n in range(7)]
    full, outputs = outcome(*warnings)
    assert (full.outcome, full.violations, outputs.result, full.files, full.findings) == ("fail_thresholds", 1, "fail", 3, 7)
    full, outputs = outcome(*warnings, thresholds=Thresholds(security=65.0))
    assert (full.outcome, outputs.result, outputs.findings, outputs.errors) == ("pass", "pass", 7, 0)
    scores = score(files, make_findings(*warnings))
    violations = gate.threshold_violations(scores).collect()
    assert [v.message for v in violations] == ["b.py: security 65 < threshold 70"]
    assert gate.worst_file(scores).collect()[0].file_id == "1"
    assert gate.critical_failures(scores).count() == 0
    errors = [finding(file_id="2", category="security", seq=n) for n in range(4)]
    critical = gate.critical_failures(score(files, make_findings(*errors))).collect()
    assert [c.message for c in critical] == ["security score 40 below critical threshold"]


def test_worst_file_of_equals_is_the_first_and_of_none_is_none(make_files, make_findings):
    files = make_files([("a.py", ""), ("b.py", "")])
    scores = score(files.repartition(3), make_findings(finding(file_id="none")))
    assert gate.worst_file(scores).collect()[0].file_id == "0"
    empty = scores.filter("false")
    assert gate.worst_file(empty).count() == 0
    assert gate.gate_outcome(empty).collect()[0].outcome == "pass"


def test_sarif(one_file, make_findings):
    found = make_findings(
        finding(severity="error"), finding(severity="warning", seq=1, line=3, column=4, code="C\"2"),
        finding(severity="info", seq=2, line=None, message="a\nb"), finding(severity="error", seq=3),
    )
    assert reports.sarif_rules(found).count() == 3
    log = json.loads(reports.sarif_logs(found, shards=1).collect()[0].sarif)
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == 3
    assert [r["level"] for r in run["results"]] == ["error", "warning", "note", "error"]
    regions = [r["locations"][0]["physicalLocation"]["region"] for r in run["results"]]
    assert regions == [{"startLine": 10}, {"startLine": 3, "startColumn": 4}, None, {"startLine": 10}]
    about = json.loads(reports.sarif_logs(found, shards=1, information_uri="https://docs.test/a\"b").collect()[0].sarif)
    assert about["runs"][0]["tool"]["driver"].pop("informationUri") == "https://docs.test/a\"b" and about == log
    assert run["results"][1]["ruleId"] == 'C"2' and run["results"][2]["message"]["text"] == "a\nb"


def test_json_report(one_file, make_findings):
    found = make_findings(finding(seq=1, code="B"), finding(seq=0, code="A"), finding(seq=2, code="C", suggestion="fix"))
    rows = reports.json_report(score(one_file, found), found).collect()
    document = json.loads(rows[0].json)
    assert [f["code"] for f in document["findings"]] == ["A", "B", "C"]
    assert document["language"] == "rust" and document["findings"][0]["suggestion"] is None
    assert set(document["scores"]) == {"security", "code_quality", "performance", "test_coverage", "ai_risk", "overall"}
    empty = reports.json_report(score(one_file, found.filter("false")), found.filter("false")).collect()
    assert json.loads(empty[0].json)["findings"] == []


def test_hot_groups_are_split_and_stay_whole(spark):
    """One key with most rows, half of them equal: all rows come back, in bounded parts."""
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("hot").alias("key"),
        F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id")).alias("value"),
    )
    parts = in_parts(rows, "key", 500, ["value"])
    assert Counter(map(tuple, parts.select("key", "value").collect())) == Counter(map(tuple, rows.collect()))
    sizes = {(r.key, r.part): r["count"] for r in parts.groupBy("key", "part").count().collect()}
    hot = [size for (key, _), size in sizes.items() if key == "hot"]
    assert len(hot) == 40 and max(hot) < 700
    assert all(part == 0 for (key, part) in sizes if key != "hot")


def test_large_file_has_several_documents(one_file, make_findings):
    found = make_findings(*[finding(seq=n, code=f"C{n}") for n in range(95)])
    rows = reports.json_report(score(one_file, found), found, per_document=20).collect()
    codes = [f["code"] for row in rows for f in json.loads(row.json)["findings"]]
    assert sorted(codes) == sorted(f"C{n}" for n in range(95)) and len(rows) == 5


def test_sarif_shards(spark, make_findings):
    found = make_findings(*[finding(file_id=str(n % 40), path=f"f{n % 40}.py", seq=n * 500) for n in range(95)])
    logs = reports.sarif_logs(found, shards=8).collect()
    sizes = [len(json.loads(log.sarif)["runs"][0]["results"]) for log in logs]
    assert sum(sizes) == 95 and len({log.part for log in logs}) == len(logs) > 4
    assert sorted(map(tuple, reports.sarif_logs(found.repartition(5), shards=8).collect())) == sorted(map(tuple, logs))
    for rows in (found, found.filter("seq < 600")):
        assert len(re.findall("Exchange hashpartitioning", reports.sarif_logs(rows)._jdf.queryExecution().executedPlan().toString())) == 1


def test_json_report_of_hits_equals_that_of_findings(spark, make_files):
    files = make_files([("a.py", "eval(x)\nmd5(y)"), ("b.rs", "fine"), ("c.py", "document.write(z)")])
    raw = json.dumps({"diagnostics": [{"code": f"E{n}", "message": "m", "location": {"row": n + 1}} for n in range(50)]})
    lint = spark.createDataFrame([("0", "x.py", "ruff", raw), ("1", "b.rs", "ruff", raw[:20])], "file_id string, path string, tool string, raw string")
    body = json.dumps({"choices": [{"message": {"content": "good"}}]})
    answers = spark.createDataFrame([("0", "openai", 200, body)], "file_id string, provider string, status int, body string")
    alone, full = check(files, builtin_rules()), check(files, builtin_rules(), lint, answers)
    for result in (alone, full):
        expected = reports.json_report(result.scores, result.findings)
        assert sorted(map(repr, result.json_report().collect())) == sorted(map(repr, expected.collect()))
        assert sorted(map(repr, result.text_report().collect())) == sorted(map(repr, reports.text_report(result.scores, result.findings).collect()))
    assert "Exchange" not in alone.json_report()._jdf.queryExecution().executedPlan().toString()
    parts = full.json_report(per_document=20).where("file_id = '0'").collect()
    codes = [f["code"] for row in parts for f in json.loads(row.json)["findings"]]
    assert sorted(codes) == sorted([*[f"E{n}" for n in range(50)], "SEC004", "SEC006", "SEM001"]) and len(parts) == 3


def test_numbered_lines(spark):
    rows = [(n % 3, n % 50, n % 7, n, f"line {n}") for n in range(1000)]
    report = spark.createDataFrame(rows, "section int, ord bigint, item bigint, number int, text string").repartition(5)
    found = sorted((r.line, r.text) for r in reports.numbered_lines(report).collect())
    assert found == [(at, row[4]) for at, row in enumerate(sorted(rows), 1)]
    assert reports.numbered_lines(report.limit(0)).collect() == []


def test_findings_of_files_are_replaced(spark, make_findings, tmp_path):
    target = str(tmp_path / "table")
    first = make_findings(*[finding(file_id=str(n % 20), path="p", seq=n) for n in range(60)])
    scanned = spark.createDataFrame([(str(n),) for n in range(20)], "file_id string")

    def rows():
        return sorted((r.file_id, r.seq) for r in reports.read_findings(spark, target).collect())

    reports.replace_findings(first, scanned, target, 8)
    assert rows() == sorted((str(n % 20), n) for n in range(60))
    again = make_findings(finding(file_id="3", path="p", seq=900), finding(file_id="99", path="p", seq=1))
    some = scanned.where("file_id in ('3', '4', '5')")
    for _ in range(2):
        reports.replace_findings(again, some, target, 8)
        assert rows() == sorted([(str(n % 20), n) for n in range(60) if n % 20 not in (3, 4, 5)] + [("3", 900)])
    reports.replace_findings(first.limit(0), scanned, target, 8)
    assert rows() == []


def test_text_report_and_bands(make_files, make_findings, tmp_path):
    files = make_files([("a.py", ""), ("b.py", "")])
    found = make_findings(
        *[finding(file_id="1", path="b.py", category="security", seq=n, suggestion="fix" if n else None) for n in range(3)],
        finding(file_id="1", path="b.py", severity="info", line=None, seq=3),
    )
    scores = score(files, found)
    reports.write_text(reports.text_report(scores, found).coalesce(1), str(tmp_path / "out"))
    lines = [line for part in sorted((tmp_path / "out").glob("part-*")) for line in part.read_text().splitlines()]
    assert lines == [
        "  Code audit report", "  Files analyzed: 2", "  Total findings: 4", "  ✗ 3 error(s)",
        "  📊 Scores for a.py: 92/100", "  📊 Scores for b.py: 58/100 (security:55!)", "  b.py:",
        "  b.py:10 [ERROR] C1 m", "  b.py:10 [ERROR] C1 m", "    → fix", "  b.py:10 [ERROR] C1 m", "    → fix", "  b.py [INFO] C1 m",
    ]
    assert [tuple(r)[2:] for r in reports.score_bands(scores).orderBy("file_id").collect()] == [("green", False), ("red", True)]
    clean = reports.text_report(score(files, found.filter("false")), found.filter("false"))
    assert "  ✓ No issues found!" in [r.text for r in clean.collect()]


def test_diagnostics(make_findings):
    found = make_findings(finding(line=5, suggestion="s"), finding(line=None, severity="info"), finding(line=0, severity="Odd", suggestion=""))
    rows = reports.diagnostics(found).collect()
    assert [(r.line, r.severity, r.related) for r in rows] == [(4, "error", "Suggestion: s"), (0, "information", None), (0, "hint", None)]
    assert rows[0].message == "[C1] m"


def test_check_with_all_stages(spark, make_files):
    files = make_files([("a.py", "eval(x)"), ("b.py", "ok"), ("c.py", None)])
    raw = json.dumps({"diagnostics": [{"code": "E1", "message": "m", "location": {"row": 1}}]})
    lint = spark.createDataFrame([("1", "b.py", "ruff", raw)], "file_id string, path string, tool string, raw string")
    body = json.dumps({"content": [{"text": "fine"}]})
    answers = spark.createDataFrame([("0", "anthropic", 200, body)], "file_id string, provider string, status int, body string")
    seen = []
    for materialize in (False, True):
        result = check(files, builtin_rules(), lint, answers, materialize=materialize)
        seen.append(
            (
                sorted((f.file_id, f.stage_ord, f.code) for f in result.findings.collect()),
                sorted((s.file_id, s.errors, s.total, s.security, s.ai_risk) for s in result.scores.collect()),
                result.stages,
                [tuple(r) for r in reports.run_summary(result.scores, result.stages).collect()],
            )
        )
    assert seen[0] == seen[1]
    assert seen[0][0] == [("0", 1, "SEC006"), ("0", 2, "SEM001"), ("1", 0, "E1")]
    assert seen[0][1] == [("0", 1, 2, 85.0, 99.0), ("1", 1, 1, 100.0, 75.0), ("2", 0, 0, 100.0, 75.0)]
    assert seen[0][3] == [(["Preprocess", "Lint", "Security", "Semantic", "Aggregate"], 3, [], 0)]


@pytest.mark.parametrize("materialize", [False, True])
def test_check_without_rules(make_files, materialize):
    result = check(make_files([("a.py", "eval(x)")]), security_scan=False, materialize=materialize)
    assert result.findings.count() == 0 and result.stages == ["Preprocess", "Aggregate"]
    assert [(s.total, s.security) for s in result.scores.collect()] == [(0, 100.0)]


def test_sinks(spark, one_file, make_findings, tmp_path):
    found = make_findings(finding(), finding(seq=1))
    scores = score(one_file, found)
    reports.write_findings(found, str(tmp_path / "findings"))
    reports.write_scores(scores, str(tmp_path / "scores"))
    reports.write_json(reports.json_report(scores, found), str(tmp_path / "json"))
    reports.write_sarif(reports.sarif_logs(found, shards=1), str(tmp_path / "sarif"))
    assert spark.read.parquet(str(tmp_path / "findings")).count() == 2
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 1
    assert spark.read.json(str(tmp_path / "json")).select(F.size("findings")).collect()[0][0] == 2
    assert spark.read.json(str(tmp_path / "sarif")).count() == 1


def test_rule_catalogue(spark):
    assert {row.code for row in rule_catalogue(spark).collect()} == {rule.code for rule in builtin_rules()}


def test_whole_sarif_logs(spark, make_findings):
    """A log is one document with all its results in order, however its rows are spread."""
    found = make_findings(
        *[finding(file_id=str(n % 40), path=f"f{n % 40}.py", seq=n, code=f"C{n % 3}", message=f"m{n % 5}") for n in range(400)]
    )
    log = F.col("seq") % 2
    rows = sorted(map(tuple, reports.whole_sarif_logs(found.repartition(7), log).collect()))
    assert rows == sorted(map(tuple, reports.sarif_logs(found, log, shards=1).collect())) and len(rows) == 2
    assert len(json.loads(rows[0][2])["runs"][0]["results"]) == 200


def test_sarif_query_has_one_document_per_log(spark):
    if not Path("/root/testdata/sf0.001").exists():
        pytest.skip("needs the given tables")
    rows = QUERIES["sarif_logs"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 1 and len({row.log for row in rows}) == len(rows)
    for row in rows:
        results = json.loads(row.sarif)["runs"][0]["results"]
        files = [re.search(r"_(\d+)", r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"].split("/")[-1])[1] for r in results]
        assert files == sorted(files)
    assert sum(len(json.loads(row.sarif)["runs"][0]["results"]) for row in rows) == QUERIES["sarif_results"](spark, "/root/testdata/sf0.001").count()
