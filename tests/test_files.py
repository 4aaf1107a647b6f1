import json
import os

import pyarrow.fs as fs
import pytest
from pyspark.sql import functions as F

from siftlake.functions.paths import any_glob_sql, is_ignored, language_field, language_of, stem
from siftlake.functions.text import decode_text, fold_case, whole_number
from siftlake.operators.changes import select_changed
from siftlake.operators.finder import finder_failures, finder_findings, register_finder, run_finder
from siftlake.plans.suite import source_tree_scan
from siftlake.sources.changes import parse_changed_paths
from siftlake.sources.tables import files_from_table, supported_files
from siftlake.sources.tree import LocalStore, RemoteStore, SourceTreeReader, list_tree, source_tree

GLOBS = [
    ("*.py", "test.py", True), ("*.py", "src/test.py", False), ("test.?s", "test.js", True), ("test.?s", "test.ts", True),
    ("test.?s", "test.py", False), ("**/test/**", "src/test/main.py", True), ("src/*.rs", "src/main.rs", True),
    ("src/*.rs", "src/mod/main.rs", False), ("**/*.rs", "main.rs", True), ("**/test", "a/b/test", True), ("src/**", "src/a/b", True),
    ("src/**", "other/file.rs", False), ("", "", True), ("", "test", False), ("*", "", True), ("*", "a/b", False), ("**", "a/b", True),
    ("a.c", "abc", False), ("[ab]", "a", False), ("[ab]", "[ab]", True), ("{a}+(b)", "{a}+(b)", True), ("***", "a/b", True),
    ("A*", "abc", False), ("é?", "éa", True), ("a?b", "a/b", False), ("**/a/**/b", "a/b", True), ("x**y", "x/1/y", True),
]
PATHS = [
    ("a.py", "python", "a"), ("src/b.PY", None, "b"), (".py", None, ".py"), ("..py", "python", "."), ("x.test.js", "javascript", "x.test"),
    ("x.jsx", "javascript", "x"), ("x.ts", "typescript", "x"), ("x.tsx", "typescript", "x"), ("d.py/x.go", "go", "x"), ("lib.rs", "rust", "lib"),
    ("noext", None, "noext"), ("d.rs/noext", None, "noext"), ("a.", None, "a"), ("a.py.txt", None, "a.py"),
]


def test_globs(spark):
    checks = [F.expr(any_glob_sql("path", [glob])).alias(f"g{n}") for n, (glob, _, _) in enumerate(GLOBS)]
    for path in {path for _, path, _ in GLOBS}:
        row = spark.createDataFrame([(path,)], "path string").select(*checks).collect()[0]
        for n, (glob, wanted, expected) in enumerate(GLOBS):
            if wanted == path:
                assert row[f"g{n}"] is expected, (glob, path)


def test_languages_and_stems(spark):
    table = spark.createDataFrame([(path,) for path, _, _ in PATHS], "path string")
    path = F.col("path")
    rows = table.select("path", language_of(path).alias("language"), stem(path).alias("stem")).collect()
    assert [tuple(row) for row in rows] == PATHS
    wire = table.select(language_field(language_of(path), "wire").alias("w")).distinct().collect()
    assert {row.w for row in wire} == {"python", "java_script", "type_script", "go", "rust", None}


def test_ignored_names_match_whole_components(spark):
    paths = [("a/target/b.py", True), ("target", True), ("targets/b.py", False), (".github/x", False), (".git/x", True), ("a/venv", True)]
    rows = spark.createDataFrame(paths, "path string, expected boolean").withColumn("got", is_ignored(F.col("path"))).collect()
    assert all(row.got == row.expected for row in rows)


def test_decoding_folding_and_rounding(spark):
    rows = spark.createDataFrame([(b"ok \xc3\xa9",), (b"\xff",), (b"\xc0\x80",), (b"",)], "content binary")
    assert [r.t for r in rows.select(decode_text(F.col("content")).alias("t")).collect()] == ["ok é", None, None, ""]
    texts = spark.createDataFrame([("ABC É",), ("ſKKİ",), ("İx",)], "t string")
    folded = [r.f for r in texts.select(fold_case(F.col("t")).alias("f")).collect()]
    assert folded[0] == "abc é" and folded[1].startswith("skk") and "i" not in folded[1] + folded[2]
    numbers = spark.createDataFrame([(0.5,), (1.5,), (2.5,), (84.49,)], "x double")
    assert [r.s for r in numbers.select(whole_number(F.col("x")).alias("s")).collect()] == ["0", "2", "2", "84"]


def test_table_rows_without_path(spark):
    files = files_from_table(spark.createDataFrame([(7, "x")], "id long, body string"), "id", "body")
    assert files.collect()[0].asDict() == {"file_id": "7", "path": None, "language": None, "text": "x", "ord": 7}
    named = spark.createDataFrame([("a-1", "x", 3), ("a-2", "y", 2)], "id string, body string, n int")
    orders = [row.ord for row in files_from_table(named, "id", "body").collect()]
    assert len(set(orders)) == 2 and None not in orders
    assert [row.ord for row in files_from_table(named, "id", "body", ord="n").collect()] == [3, 2]


@pytest.fixture
def tree(tmp_path):
    texts = {
        "src/__init__.py": b"import x\n", ".github/a.py": b"eval(1)", "node_modules/z.js": b"eval(1)", "src/bad.py": b"\xff eval(",
        "src/_private/e.rs": b"x\r\ny", "readme.md": b"no", "src/node_modules": b"a file", "deep/a/b/c/d.go": b"package x",
    }
    for name, content in texts.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(content)
    os.symlink(tmp_path / "src/__init__.py", tmp_path / "link.py")
    os.symlink(tmp_path / "src", tmp_path / "linked")
    return tmp_path


@pytest.mark.parametrize("tasks", [1, 2, 16])
def test_source_tree(spark, tree, tasks):
    targets = [str(tree), str(tree / "src/bad.py"), str(tree / "missing"), str(tree / "readme.md"), str(tree / "node_modules")]
    rows = source_tree(spark, targets, tasks=tasks).collect()
    found = sorted((row.path.removeprefix(f"{tree}/"), row.text) for row in rows)
    assert found == [
        (".github/a.py", "eval(1)"), ("deep/a/b/c/d.go", "package x"), ("node_modules/z.js", "eval(1)"),
        ("src/__init__.py", "import x\n"), ("src/_private/e.rs", "x\r\ny"), ("src/bad.py", None), ("src/bad.py", None),
    ]
    assert len({row.file_id for row in rows}) == len({row.ord for row in rows}) == len(rows)


def test_a_flat_directory_is_listed_in_shares(tmp_path):
    for n in range(500):
        (tmp_path / f"f{n}.py").write_text("x")
    options = {"targets": json.dumps([str(tmp_path)]), "ignore": "[]", "tasks": "4"}
    reader = SourceTreeReader(options)
    sizes = [len(list(reader.read(part))) for part in reader.partitions()]
    assert sum(sizes) == 500 and len(sizes) == 4 and min(sizes) > 80


def test_listing_can_ignore_nothing(spark, tree):
    assert list_tree(spark, [str(tree)], ignore=()).count() == 8


def test_changed_paths(spark):
    lists = spark.createDataFrame([("\n a.py \n\n\t\nb c.js\r\n", "staged"), ("", "working")], "raw string, source string")
    assert [tuple(r) for r in parse_changed_paths(lists).collect()] == [("a.py", "staged"), ("b c.js", "staged")]


def test_changed_files_and_fallback(spark, make_files):
    existing = make_files([("a.py", ""), ("b.md", ""), ("node_modules/c.js", ""), ("d.go", "")])
    full = supported_files(existing.filter(~is_ignored(F.col("path"))))
    listed = [("a.py", "staged"), ("a.py", "working"), ("gone.py", "staged"), ("node_modules/c.js", "working"), ("b.md", "working")]
    changes = spark.createDataFrame(listed, "path string, source string")

    def paths(changes, source="all"):
        return sorted(r.path for r in select_changed(existing, changes, full, source).collect())

    assert paths(changes) == ["a.py", "node_modules/c.js"]
    assert paths(changes, "staged") == ["a.py"]
    assert paths(changes.filter("path = 'gone.py'")) == ["a.py", "d.go"]
    assert paths(None) == ["a.py", "d.go"]
    assert paths(changes.filter("path = 'b.md'")) == []


def test_custom_finder(spark, make_files):
    def finder(text, path):
        if "bad" in text:
            raise ValueError("refused")
        for number, line in enumerate(text.split("\n"), start=1):
            if "x" in line:
                yield {"code": "X", "message": path, "severity": "error", "line": number}

    files = make_files([("a.py", "x\ny\nx"), ("b.py", "x bad"), ("c.py", None), ("d.py", "")])
    found = run_finder(files, finder)
    assert [(r.file_id, r.seq, r.line) for r in finder_findings(found).orderBy("seq").collect()] == [("0", 0, 1), ("0", 1, 3)]
    assert [(r.file_id, r.finder_error) for r in finder_failures(found).collect()] == [("1", "refused")]
    register_finder(spark, "find_x", lambda text, path: [{"code": "N", "message": str(len(text))}])
    files.createOrReplaceTempView("finder_files")
    rows = spark.sql("select f.path, x.severity, x.message from finder_files f, lateral find_x(f.text, f.path) x").collect()
    assert sorted(map(tuple, rows)) == [("a.py", "info", "5"), ("b.py", "info", "5"), ("d.py", "info", "0")]
    register_finder(spark, "find_y", lambda text, path: 1 / (len(text) - 5) and [{"code": "N", "message": path}])
    rows = spark.sql("select f.path, x.code, x.finder_error from finder_files f, lateral find_y(f.text, f.path) x").collect()
    assert sorted(map(repr, map(tuple, rows))) == [
        "('a.py', None, 'division by zero')", "('b.py', None, 'division by zero')", "('d.py', 'N', None)"
    ]


def test_trees_in_stores_that_cannot_be_reached_raise(spark, tmp_path, monkeypatch):
    (tmp_path / "a.py").write_text("x")
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert [r.path for r in list_tree(spark, [root]).collect()] == [f"{tmp_path}/a.py"]
    for root in ("hdfs://host/tree", "s3a://bucket/tree", "viewfs:/tree"):
        with pytest.raises((ValueError, OSError)):
            list_tree(spark, [root])
    monkeypatch.setattr("siftlake.plans.suite.shared_dir", lambda spark, name: f"s3a://host/shared/{name}")
    with pytest.raises((ValueError, OSError)):
        source_tree_scan(spark, "/root/testdata/sf0.001")


def test_trees_of_other_stores_are_listed_alike(tree, monkeypatch):
    """The reader over a store of Arrow's finds what it finds through the mounted file system, but for links."""
    os.remove(tree / "link.py")
    os.remove(tree / "linked")
    options = {"targets": json.dumps([f"far://{tree}", f"far://{tree}/src", f"far://{tree}/readme.md", f"far://{tree}/gone"]), "ignore": "[]", "tasks": "3"}

    def listed():
        reader = SourceTreeReader(options)
        return sorted((r[0].replace("far://", ""), r[3]) for part in reader.partitions() for r in reader.read(part))

    stores = {"far": lambda location: RemoteStore(location.removeprefix("far://"), fs.LocalFileSystem()), "near": lambda location: LocalStore(location.removeprefix("far://"))}
    found = {}
    for name, store in stores.items():
        monkeypatch.setattr("siftlake.sources.tree.store_of", store)
        found[name] = listed()
    assert found["far"] == found["near"] and len(found["far"]) == 8 + 4 + 1
    store = RemoteStore(f"{tree}", fs.LocalFileSystem())
    store.write(f"{tree}/new/deep/x.py", b"text")
    assert store.read(f"{tree}/new/deep/x.py") == b"text" and store.size(f"{tree}/new/deep/x.py") == 4
