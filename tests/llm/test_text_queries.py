"""Registered queries against their SQL, and the pipeline, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from siftlake.llm.queries import ORACLE_SQL, QUERIES

SF_DIR = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not SF_DIR.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in SF_DIR.glob("*.parquet"):
        connection.execute(f"create view {file.stem} as select * from '{file}'")
    return connection


def test_all_operators_are_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, database, name):
    found = QUERIES[name](spark, str(SF_DIR))
    result = database.execute(ORACLE_SQL[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(repr(tuple(row)) for row in found.select(*names).collect()) == sorted(map(repr, result.fetchall()))


def test_stages_work_on_what_was_kept(spark, tmp_path):
    # The smallest tables have too few toxic texts to learn from.
    sf_dir = SF_DIR.with_name("sf0.01")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        result = stage(spark, docs, str(sf_dir))
        result.write.parquet(str(tmp_path / name))
        result = spark.read.parquet(str(tmp_path / name))
        counts.append(result.count())
        if at < len(corpus_pipeline.STAGES) - 1:
            assert result.columns == columns
            docs = result
    toxic, unique, cut, mixed, tokens = counts[1:]
    assert 0 < unique < toxic < counts[0] and cut == unique and mixed == tokens
    assert result.where("not round_trip").count() == 0
    whole = corpus_pipeline.run(spark, str(sf_dir))
    assert sorted(map(repr, whole.select("doc_id", "ids").collect())) == sorted(map(repr, result.select("doc_id", "ids").collect()))


def test_stages_take_empty_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "a b c", None, "s", 5)], schema)
    for docs, left in ((odd, 4), (odd.limit(0), 0)):
        for name, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, str(SF_DIR))
            # One row has words; none is toxic, near another or repeated.
            assert docs.count() == left and docs.columns == odd.columns, name
        # A source without words has a target of none, so no row of it is taken; the one with words is all of the mix.
        for _, stage in corpus_pipeline.STAGES[3:]:
            docs = stage(spark, docs, str(SF_DIR))
        assert [(r.doc_id, r.round_trip) for r in docs.collect()] == ([(2, True)] if left else [])
