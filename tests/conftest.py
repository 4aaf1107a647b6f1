import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from siftlake.session import local_session  # noqa: E402

FILES = "file_id string, path string, language string, text string, ord bigint"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, **{"spark.checkpoint.dir": shared, "spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_files(spark):
    """Files from (path, text) pairs, in order."""
    from siftlake.functions.paths import language_of

    def make(pairs):
        rows = [(str(n), path, text, n) for n, (path, text) in enumerate(pairs)]
        table = spark.createDataFrame(rows, "file_id string, path string, text string, ord bigint")
        return table.select("file_id", "path", language_of(table.path).alias("language"), "text", "ord")

    return make
