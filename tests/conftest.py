import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from rankweave.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "local[4]", "tests",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__driver__memory="4g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_index(spark, tmp_path_factory):
    """Write an index over texts given as {doc_id: text}."""
    from rankweave.sources.index import write_index

    def make(texts, **options):
        rows = [(i, text, f"doc://{i}", f"title {i}") for i, text in texts.items()]
        docs = spark.createDataFrame(rows, "doc_id long, full_text string, url string, title string")
        return write_index(docs, str(tmp_path_factory.mktemp("index") / "v"), **options)
    return make


@pytest.fixture(scope="session")
def as_queries(spark):
    def make(texts):
        return spark.createDataFrame(list(texts.items()), "query_id long, text string")
    return make


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return [tuple(r) for r in picked.collect()]
