import pytest
from oracle import connect, same

from billow.llm.queries import QUERIES, SQL

COLUMNS = {
    "p2_found": "name string, rank bigint, repository_id bigint",
    "p3_found": "field string, term string, mark string",
    "p4_found": "raw_value string, license_id string",
    "p5_found": "field string, repository_id_a bigint, repository_id_b bigint",
    "p6_found": "type string, name_a string, name_b string",
    "p7_ids": "doc_id bigint, ids array<int>",
    "p8_found": "doc_id bigint, item_id bigint",
    "p9_found": "doc_id bigint",
}


@pytest.fixture(scope="module")
def link(data):
    return connect(pytest.importorskip("duckdb"), data)


@pytest.mark.parametrize("name", SQL)
def test_query_equals_its_sql(spark, data, link, name):
    same(spark, data, link, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_no_duplicates(spark, data, name):
    df = QUERIES[name](spark, data)
    assert ", ".join(f"{c} {kind}" for c, kind in df.dtypes) == COLUMNS[name]
    rows = [str(r) for r in df.collect()]
    assert len(rows) == len(set(rows)) and rows
