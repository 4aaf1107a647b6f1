"""Linter reports, rule packs, model reviews and streams."""

import json
import os

import pyarrow as pa
from pyspark.sql import functions as F

from siftlake.model import JudgeConfig
from siftlake.operators import judge
from siftlake.operators.judge import judge_findings, prompts, request_bodies
from siftlake.operators.scan import findings_of_hits, scan
from siftlake.sources import lint, packs
from siftlake.sources.builtin import builtin_rules
from siftlake.sources.lint import parse_lint, rejected_lines, rejected_reports
from siftlake.streaming import on_save

RUFF = {"code": "E501", "message": "m", "location": {"row": 3}}
SOUND = [
    ("ruff", {"diagnostics": [RUFF, RUFF | {"code": "W1"}, RUFF | {"code": "SIM1"}, RUFF | {"code": "C9", "extra": {}}]},
     [("error", "E501", 3), ("warning", "W1", 3), ("warning", "SIM1", 3), ("info", "C9", 3)]),
    ("ruff", {"diagnostics": [RUFF | {"code": "F841", "location": {"row": 0, "column": "x"}}]}, [("error", "F841", 0)]),
    ("biome", {"diagnostics": [{"message": "m", "location": None}]}, [("error", "BIOME", None)]),
    ("biome", {"diagnostics": [{"message": "m", "severity": "warning", "code": "a/b", "location": {"line": 9}}]}, [("warning", "a/b", 9)]),
    ("biome", {"diagnostics": [{"message": "m", "severity": "information", "location": {"line": None}}]}, [("error", "BIOME", None)]),
    ("oxlint", {"results": [{"message": "m", "line": 4, "column": 1, "severity": "Warning"}]}, [("error", "OXLLINT", 4)]),
    ("golangci-lint", {"issues": [{"text": "t", "from_linter": "vet"}]}, [("info", "vet", 1)]),
    ("golangci-lint", {"issues": [{"text": "t", "from_linter": "vet", "severity": "error", "location": {"line": 2}}]}, [("error", "vet", 2)]),
    ("golangci-lint", {"issues": None}, []),
    ("golangci-lint", {}, []),
]
BROKEN = [
    ("ruff", {"diagnostics": [RUFF, RUFF | {"code": 401}]}),
    ("ruff", {"diagnostics": [RUFF, RUFF | {"location": {"row": -1}}]}),
    ("ruff", {"diagnostics": [RUFF, RUFF | {"location": {"row": 1.0}}]}),
    ("ruff", {"diagnostics": [RUFF, RUFF | {"location": None}]}),
    ("ruff", {"diagnostics": [RUFF, {"code": "E1", "location": {"row": 1}}]}),
    ("ruff", {"diagnostics": [RUFF, None]}),
    ("ruff", {"diagnostics": None}),
    ("ruff", [RUFF]),
    ("biome", {"diagnostics": [{"message": "m", "code": 5}]}),
    ("biome", {"diagnostics": [{"message": "m", "location": {"line": "7"}}]}),
    ("oxlint", {"results": [{"message": "m", "column": -2}]}),
    ("oxlint", {"diagnostics": []}),
    ("golangci-lint", {"issues": [{"text": "t", "from_linter": None}]}),
    ("golangci-lint", {"Issues": [{"text": "t", "from_linter": "vet"}]}),
]


def reports(spark, rows):
    return spark.createDataFrame(rows, "file_id string, path string, tool string, raw string")


def test_sound_reports(spark):
    rows = [(str(n), "a.py", tool, json.dumps(report)) for n, (tool, report, _) in enumerate(SOUND)]
    found = parse_lint(reports(spark, rows)).orderBy("file_id", "seq").collect()
    for n, (_, _, expected) in enumerate(SOUND):
        assert [(f.severity, f.code, f.line) for f in found if f.file_id == str(n)] == expected, SOUND[n]


def test_one_bad_diagnostic_voids_the_report(spark):
    rows = [(str(n), "a.py", tool, json.dumps(report)) for n, (tool, report) in enumerate(BROKEN)]
    rows += [("x1", "a.py", "ruff", "not json"), ("x2", "a.py", "ruff", json.dumps(SOUND[0][1]) + " {}"), ("x3", "a.py", "ruff", None)]
    assert [f.file_id for f in parse_lint(reports(spark, rows)).collect()] == []


def test_large_reports_and_rejected_ones(spark):
    item = "concat('{\"code\":\"E1\",\"message\":\"', repeat('m', 10000), '\",\"location\":{\"row\":', n, '}}')"
    raw = f"concat('{{\"diagnostics\":[', array_join(transform(sequence(1, 14001 + id), n -> {item}), ','), ']}}')"
    large = spark.range(1).selectExpr("'big' as file_id", "'a.py' as path", "'ruff' as tool", f"{raw} as raw")
    assert large.selectExpr("octet_length(raw) > 140000000").first()[0]
    found = parse_lint(large).agg(F.count("seq"), F.max("line"), F.min("code")).first()
    assert tuple(found) == (14001, 14001, "E1") and rejected_reports(large).collect() == []
    more = [
        ("ruff", json.dumps({"diagnostics": [json.dumps(RUFF)]}), "unsound diagnostic"),
        ("ruff", '{"diagnostics": [], "diagnostics": [%s]}' % json.dumps(RUFF), "repeated key diagnostics"),
        ("ruff", "{'diagnostics': []}", "not one JSON object"),
        ("ruff", json.dumps({"diagnostics": [RUFF]})[:-3], "not one JSON object"),
        ("ruff", json.dumps({"diagnostics": [RUFF]}) + " {}", "not one JSON object"),
        ("ruff", None, "not one JSON object"),
        ("oxlint", json.dumps({"results": {}}), "no list results"),
        ("golangci-lint", json.dumps({"issues": {}}), "no list issues"),
    ]
    rows = [(f"m{n}", "a.py", tool, raw) for n, (tool, raw, _) in enumerate(more)]
    rows += [(f"s{n}", "a.py", tool, json.dumps(report)) for n, (tool, report, _) in enumerate(SOUND)]
    # A misspelt list is as good as none, which golangci-lint may leave out.
    rows += [(f"b{n}", "a.py", tool, json.dumps(report)) for n, (tool, report) in enumerate(BROKEN) if "Issues" not in report]
    table = reports(spark, rows)
    reasons = {(r.file_id, r.tool): r.reason for r in rejected_reports(table).collect()}
    assert set(reasons) == {(row[0], row[2]) for row in rows if row[0][0] != "s"}
    assert {n: reasons[f"m{n}", tool] for n, (tool, _, _) in enumerate(more)} == {n: reason for n, (*_, reason) in enumerate(more)}
    assert {f.file_id[0] for f in parse_lint(table).collect()} == {"s"}
    assert {r.file_id for r in rejected_reports(table, "ruff").collect()} >= {f"m{n}" for n in range(6)}


def clippy(spans, **message):
    return json.dumps({"reason": "compiler-message", "message": {"message": "t", "spans": spans} | message})


def test_clippy_lines(spark):
    here, there = {"file_name": "src/lib.rs", "line_start": 7}, {"file_name": "other/x.rs", "line_start": 9}
    lines = [
        "junk", json.dumps({"reason": "build-finished"}), clippy([here]), clippy([there]), clippy([there, here], level="error"),
        clippy([here], level="help", code={"code": "clippy::x"}), clippy([here], code=None), clippy([]), clippy([here], message=5),
        clippy([here | {"line_start": "7"}]), "", clippy([here]) + " trailing",
    ]
    raw = "\r\n".join(lines)
    found = parse_lint(reports(spark, [("1", "crate/lib.rs", "clippy", raw), ("2", "crate/lib.py", "clippy", raw)])).orderBy("seq").collect()
    assert [(f.file_id, f.severity, f.code, f.line) for f in found] == [
        ("1", "warning", "CLIPPY", 7), ("1", "error", "CLIPPY", 9), ("1", "info", "clippy::x", 7), ("1", "warning", "CLIPPY", 7),
        ("1", "warning", "CLIPPY", None),
    ]


def lines_of(raws, messages):
    batch = pa.RecordBatch.from_pydict({"file_id": [str(n) for n in range(len(raws))], "path": ["a.rs"] * len(raws), "raw": raws}, REPORT)
    return list(lint._report_lines(iter([batch]), messages))


REPORT = pa.schema([("file_id", pa.string()), ("path", pa.string()), ("raw", pa.string())])


def test_lines_of_many_reports_travel_together(monkeypatch):
    """Short reports share batches; the lines are the same when every report is read line after line."""
    raws = [[None, "", "junk\n" + clippy([]), "\n\n", '{"reason":"compiler\\u002dmessage"}\r\nx\n'][n % 5] for n in range(1000)]
    listed = [(str(n), seq, line) for n, raw in enumerate(raws) if raw is not None for seq, line in enumerate(raw.split("\n"))]
    may_be = [line for line in listed if "compiler" in line[2]]
    for size, most in ((lint.BATCH_BYTES, 2), (1000, 500), (1, 2000)):
        monkeypatch.setattr(lint, "BATCH_BYTES", size)
        for messages, expected in ((False, listed), (True, may_be)):
            batches = lines_of(raws, messages)
            found = [row for b in batches for row in zip(*(b.column(name).to_pylist() for name in ("file_id", "seq", "raw_line")))]
            assert sorted(found) == sorted(expected) and len(batches) <= most


def test_escaped_reasons_are_read(spark):
    line = clippy([{"file_name": "src/lib.rs", "line_start": 7}])
    raw = "\n".join([line.replace("compiler-message", "compiler\\u002dmessage"), line.replace("compiler-message", "compiler-artifact")])
    found = parse_lint(reports(spark, [("1", "crate/lib.rs", "clippy", raw)])).collect()
    assert [(f.seq, f.line) for f in found] == [(0, 7)]


def rule(**more):
    return {"code": "D1", "name": "n", "pattern": "test", "message": "found"} | more


PACKS = [
    ("a.json", {"name": "x", "rules": [rule()]}, True),
    ("b.json", {"name": "y", "version": "1", "description": "d", "rules": [rule(severity="ERROR", languages=["Go"]), rule(severity="odd")]}, True),
    ("c.json", {"name": "empty", "rules": []}, True),
    ("d.json", {"name": "x", "rules": [rule(), rule(pattern="[invalid")]}, False),
    ("e.json", {"name": "x", "rules": [rule(severity=None)]}, False),
    ("f.json", {"name": "x", "rules": [rule(languages=None)]}, False),
    ("g.json", {"name": "x", "rules": [rule(exclude=[1])]}, False),
    ("h.json", {"name": "x", "rules": [{"code": "D1", "name": "n", "pattern": "x"}]}, False),
    ("i.json", {"rules": []}, False),
    ("j.json", {"name": "x"}, False),
    ("k.json", [], False),
    ("l.json", {"name": "x", "rules": [rule(suggestion=None, extra=1)]}, True),
    ("m.json", packs.EXAMPLE_PACK, False),
    ("n.json", packs.EXAMPLE_PACK | {"rules": packs.EXAMPLE_PACK["rules"][:1]}, True),
]


def test_packs(spark, tmp_path, make_files):
    first, second = tmp_path / "first", tmp_path / "second"
    for directory in (first, second, first / "sub"):
        directory.mkdir()
    for name, content, _ in PACKS:
        (first / name).write_text(json.dumps(content))
    (first / "broken.json").write_text("{not json")
    (first / "readme.txt").write_text("{}")
    (first / ".json").write_text(json.dumps(PACKS[0][1]))
    (first / "sub" / "z.json").write_text(json.dumps(PACKS[0][1]))
    (second / "_late.json").write_text(json.dumps({"name": "late", "rules": [rule(code="LATE")]}))
    loaded = packs.load_rule_packs(spark, [str(second), str(tmp_path / "missing"), str(first)]).cache()
    accepted = {row.path.rsplit("/", 1)[1] for row in packs.valid_packs(loaded).collect()}
    assert accepted == {name for name, _, valid in PACKS if valid} | {"_late.json"}
    assert packs.rejected_packs(loaded).count() == sum(not valid for _, _, valid in PACKS) + 1
    rules = packs.rules_of_packs(packs.valid_packs(loaded))
    assert [r.code for r in rules] == ["LATE", "D1", "D1", "D1", "D1", "LOCAL001"]
    assert [r.severity for r in rules] == ["warning", "warning", "error", "info", "warning", "warning"]
    assert rules[2].languages == ("Go",) and rules[1].suggestion is None
    summary = {row.name: (row.version, row.rules) for row in packs.pack_summary(packs.valid_packs(loaded)).collect()}
    assert summary["empty"] == ("0.1.0", 0) and summary["y"] == ("1", 2)
    texts = [("src/a.py", "breakpoint()"), ("test/a.py", "breakpoint()"), ("src/a.js", "breakpoint()")]
    found = scan(make_files(texts), builtin_rules() + rules)
    assert [(f.file_id, f.code, f.rule_ord) for f in found.collect()] == [("0", "LOCAL001", 19)]


def test_pack_dirs():
    assert packs.split_pack_dirs("/a;/b::/c;") == ["/a", "/b", "/c"]


CONFIG = JudgeConfig(provider="anthropic", model="m", max_input_chars=5)


def test_prompts(make_files):
    files = make_files([("a.py", "😀éabcdef"), ("b", "x"), ("c.py", None)])
    rows = {r.file_id: r.prompt for r in prompts(files, CONFIG, head_only=True).collect()}
    assert set(rows) == {"0", "1"}
    chunks = prompts(files, CONFIG).orderBy("file_id", "chunk").collect()
    assert [(r.file_id, r.chunk) for r in chunks] == [("0", 0), ("0", 1), ("1", 0)]
    assert chunks[0].prompt == rows["0"] and "issues:\n\ndef\n\n\nCheck" in chunks[1].prompt
    assert rows["0"].startswith("Review this python code for AI-generated code quality issues:\n\n😀éabc\n\n\nCheck for:\n- Overly")
    assert rows["1"].startswith("Review this unknown code")
    body = json.loads(request_bodies(files, CONFIG).filter("file_id = '0' and chunk = 0").collect()[0].body)
    assert body == {"model": "m", "max_tokens": 500, "messages": [{"role": "user", "content": rows["0"]}]}


def test_responses(spark, make_files):
    anthropic, openai = {"content": [{"text": "A"}]}, {"choices": [{"message": {"content": "B"}}]}
    rows = [
        ("0", "anthropic", 200, anthropic), ("1", "openai", 299, openai), ("2", "anthropic", 200, openai), ("3", "other", 200, openai),
        ("4", "anthropic", 300, anthropic), ("5", "anthropic", 200, {"content": []}), ("6", "anthropic", 200, {"content": [{"text": 5}]}),
        ("7", "openai", 200, anthropic), ("8", "anthropic", 199, anthropic),
    ]
    answers = spark.createDataFrame(
        [(f, p, s, json.dumps(b)) for f, p, s, b in rows] + [("9", "openai", 200, "oops")],
        "file_id string, provider string, status int, body string",
    )
    found = judge_findings(make_files([("a.py", "")] * 10), answers).orderBy("file_id").collect()
    assert [(f.file_id, f.code, f.severity, f.line, f.ai_explanation) for f in found] == [
        ("0", "SEM001", "info", None, "A"), ("1", "SEM001", "info", None, "B"), ("3", "SEM001", "info", None, "B"),
    ]


VERSIONS = "file_id string, path string, language string, text string, ord bigint, version_ts timestamp"


def save(spark, path, rows):
    values = [(f, p, "python" if p.endswith(".py") else None, text, int(f), seconds) for f, p, text, seconds in rows]
    table = spark.createDataFrame(values, VERSIONS.replace("timestamp", "bigint"))
    table.withColumn("version_ts", F.timestamp_seconds("version_ts")).write.mode("append").parquet(path)


def test_one_line_too_large_for_a_value(spark):
    """A line of 140 MB is listed as rejected, and its neighbours are read."""
    message = '{"reason":"compiler-message","message":{"message":"m","level":"warning","code":null,"spans":[{"file_name":"src/a.rs","line_start":4}]}}'
    huge = "concat('{\"reason\":\"compiler-message\",\"pad\":\"', repeat('x', 140000000), '\"}')"
    raw = f"concat('{message}', '\n   Compiling x\n', {huge}, '\n{{broken\n', '{message}')"
    table = spark.range(1).selectExpr("'1' as file_id", "'src/a.rs' as path", "'clippy' as tool", f"{raw} as raw")
    assert [(r.seq, r.code, r.line) for r in parse_lint(table).orderBy("seq").collect()] == [(0, "CLIPPY", 4), (4, "CLIPPY", 4)]
    rejected = [(r.line, r.bytes > 140_000_000, r.reason) for r in rejected_lines(table).orderBy("line").collect()]
    assert rejected == [(3, True, "larger than one value may be"), (4, False, "not one JSON value")]


def test_large_responses_give_a_finding_or_a_reason(spark):
    pad = "repeat('x', 140000000)"
    bodies = [
        ("a", "openai", 200, f"concat('{{\"pad\":\"', {pad}, '\",\"choices\":[{{\"message\":{{\"content\":\"fine\"}}}}]}}')"),
        ("b", "anthropic", 200, f"concat('{{\"content\":[{{\"text\":\"', {pad}, '\"}}]}}')"),
        ("c", "anthropic", 200, "'{\"content\":[{\"text\":\"short\"}]}'"), ("d", "openai", 200, "'{\"choices\":[{\"message\":{\"content\":7}}]}'"),
        ("e", "openai", 500, "'x'"), ("f", "openai", 201, "'{} {}'"), ("g", "openai", 200, f"concat('{{\"pad\":\"', {pad}, '\"}}')"),
    ]
    table = None
    for file_id, provider, status, body in bodies:
        row = spark.range(1).selectExpr(f"'{file_id}' as file_id", f"'{provider}' as provider", f"{status} as status", f"{body} as body")
        table = row if table is None else table.unionByName(row)
    found = {r.file_id: r.explanation for r in judge.response_texts(table).select("file_id", F.left("explanation", F.lit(5)).alias("explanation")).collect()}
    reasons = {r.file_id: r.reason for r in judge.rejected_responses(table).collect()}
    assert found.keys() | reasons.keys() == set("abcdefg") and not found.keys() & reasons.keys()
    assert found["a"] == "fine" and found["c"] == "short"
    assert reasons["d"] == "no answer text" and reasons["e"] == "status 500" and reasons["f"] == "not one JSON value" and "larger" in reasons["g"]


def test_latest_findings_expire_and_stay_bounded(spark, tmp_path, monkeypatch):
    """Many runs: paths that are not saved any more are dropped, state and folders stay bounded, and all equals the batch."""
    monkeypatch.setattr(on_save, "SLOTS", 3)
    source, latest = str(tmp_path / "source"), str(tmp_path / "latest")
    rules, states = builtin_rules(), []
    for run in range(9):
        versions = [(str(run * 10 + n), f"{'always' if n == 0 else f'run{run}'}_{n}.py", "eval(1)" if (run + n) % 2 else "ok", 1000 * run + n) for n in range(6)]
        save(spark, source, [*versions, (str(run * 10 + 9), "always_0.py", "old eval(2)", 1000 * run - 1)])
        stream = spark.readStream.schema(VERSIONS).parquet(source)
        query = on_save.start_latest(stream, rules, latest, latest + "-progress", "2500 seconds")
        query.awaitTermination()
        states.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        found = sorted(map(tuple, on_save.read_latest(spark, latest, rules, "2500 seconds").select("path", "file_id", "line").collect()))
        table = on_save.latest_hits(spark.read.parquet(source), rules, "2500 seconds")
        assert found == sorted(map(tuple, findings_of_hits(table, rules).select("path", "file_id", "line").collect()))
        current = {r.path for r in table.collect()}
        assert current == {"always_0.py", *(f"run{r}_{n}.py" for r in range(max(0, run - 2), run + 1) for n in range(1, 6) if 1000 * r + n >= 1000 * run + 5 - 2500)}
    folders = [f for kind in ("base", "recent") for f in os.listdir(f"{latest}/{kind}") if "=" in f]
    assert len(folders) <= 2 + 3 + 1 and max(states) <= 6 * 7


def test_streams_equal_batch(spark, tmp_path):
    source, out, latest = (str(tmp_path / name) for name in ("source", "out", "latest"))
    rules = builtin_rules() + packs.rules_of_packs(spark.createDataFrame([], "dir_ord int, path string, name string, rules array<struct<code:string,name:string,pattern:string,message:string,severity:string,suggestion:string,languages:array<string>,include:array<string>,exclude:array<string>>>"))

    def run():
        versions = spark.readStream.schema(VERSIONS).parquet(source)
        on_save.start_scan(versions, rules, out, out + "-progress").awaitTermination()
        on_save.start_latest(versions, rules, latest, latest + "-progress").awaitTermination()
        current = on_save.read_latest(spark, latest, rules).select("path", "file_id", "code", "line").collect()
        return sorted(map(tuple, current))

    save(spark, source, [("1", "a.py", "eval(1)", 10), ("2", "b.py", "x\nmd5(1)", 11), ("3", "c.txt", "eval(1)", 12)])
    assert run() == [("a.py", "1", "SEC006", 1), ("b.py", "2", "SEC004", 2)]
    # A newer clean version clears, an older late one does not count, a new path adds.
    save(spark, source, [("4", "a.py", "fine", 20), ("5", "b.py", "eval(1)", 5), ("6", "d.py", "\neval(1)", 20)])
    assert run() == [("b.py", "2", "SEC004", 2), ("d.py", "6", "SEC006", 2)]
    batch = on_save.scan_versions(spark.read.parquet(source), rules).collect()
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch))
    table = on_save.latest_hits(spark.read.parquet(source), rules)
    assert {(r.path, r.file_id) for r in table.collect()} == {("a.py", "4"), ("b.py", "2"), ("d.py", "6")}
