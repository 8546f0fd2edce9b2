"""Every query against its SQL twin, on the shared tables and on a skewed copy of them."""

import duckdb
import pytest
from harness import compare

from lorescope.operators import ordering
from lorescope.plans.catalog import QUERIES, TWINS
from lorescope.sources.tables import TABLES

SMALL = "/root/testdata/sf0.001"

# What each table looks like when one key holds a third of its rows.
SKEW = {
    "lineitem": "SELECT * REPLACE (CASE WHEN hash(l_partkey, l_suppkey, l_shipdate) % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey) FROM t",
    "orders": "SELECT * REPLACE (CASE WHEN hash(o_orderkey) % 3 = 0 THEN 5 ELSE o_custkey END AS o_custkey) FROM t",
    "events": "SELECT * REPLACE (CASE WHEN hash(event_id) % 3 = 0 THEN 'click' ELSE event_type END AS event_type) FROM t",
    "documents": "SELECT * REPLACE (CASE WHEN hash(doc_id) % 3 = 0 THEN 'src1' ELSE source END AS source) FROM t",
    "embeddings": "SELECT * REPLACE (CASE WHEN hash(vec_id) % 3 = 0 THEN 4 ELSE label END AS label) FROM t",
}


@pytest.fixture(scope="session")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for name in TABLES:
        source = f"read_parquet('{SMALL}/{name}.parquet')"
        body = SKEW.get(name, "SELECT * FROM t").replace("FROM t", f"FROM {source}")
        duckdb.sql(f"COPY ({body}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)
    assert set(QUERIES) == set(TWINS)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin(spark, name):
    assert compare(QUERIES[name](spark, SMALL), TWINS[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(TWINS))
def test_twin_with_hot_keys(spark, skewed, monkeypatch, name):
    # Groups count as large from 50 rows on, so that hot ones are ordered across tasks.
    monkeypatch.setattr(ordering, "GROUP_LIMIT", 50)
    assert compare(QUERIES[name](spark, skewed), TWINS[name], skewed) == ""
