"""A few of the registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import check_oracle
from rankweave.plans import oracle, registry

SF_DIR = "/root/testdata/sf0.001"
PICKED = ("html_text", "ingest_pages", "load_qrels", "lemmatize_vocab", "bm25_batch", "vector_topk", "vector_ann",
          "hybrid_search", "legacy_rank", "backfill_embeddings", "compare_modes", "stream_ingest")

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="the tables are not here")


# Learned codes, and seconds: tested against exact search (test_product) and by counts (test_jobs).
NO_SQL = {"vector_product", "eval_latency"}


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.all_queries()) - NO_SQL == set(oracle.all_sql())


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in check_oracle.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = entry.queries()[name](spark, SF_DIR).toPandas()
    assert len(found) > 0
    assert check_oracle.same(found, con.execute(entry.oracle_sql()[name]).df()) == ""
